"""List what a glob matches, inside a task, on local disk or an object store."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import urlsplit


def pattern_of(glob: str) -> re.Pattern[str]:
    """Return the pattern of a glob: ``*`` stays in a segment, ``**`` does not."""
    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif glob.startswith("**", at):
            out.append(".*")
            at += 2
        elif glob[at] == "*":
            out.append("[^/]*")
            at += 1
        elif glob[at] == "[" and "]" in glob[at + 2 :]:
            end = glob.index("]", at + 2)
            inner = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            at = end + 1
        else:
            out.append(re.escape(glob[at]))
            at += 1
    return re.compile("".join(out) + r"\Z", re.DOTALL)


def _fixed_folder(path: str) -> str:
    return re.sub(r"(^|/)[^/]*[*\[].*$", "", path)


def _local(path: str) -> Iterator[tuple[str, int]]:
    pattern, pending = pattern_of(path), [_fixed_folder(path) or "/"]
    deep = "**" in path
    levels = path.count("/")
    while pending:
        folder = pending.pop()
        with os.scandir(folder) as entries:
            for entry in sorted(entries, key=lambda found: found.name):
                if entry.is_dir():
                    if deep or entry.path.count("/") < levels:
                        pending.append(entry.path)
                elif pattern.match(entry.path):
                    yield entry.path, entry.stat().st_size


def matches(glob: str) -> Iterator[tuple[str, int]]:
    """Yield path and size of each file a glob matches."""
    parts = urlsplit(glob)
    if parts.scheme in ("", "file"):
        for path, size in _local(parts.path):
            yield (f"file://{path}" if parts.scheme else path), size
        return
    import pyarrow.fs as fs

    root = _fixed_folder(glob)
    store, inner = fs.FileSystem.from_uri(root)
    head = glob[: len(root) - len(inner)]
    pattern = pattern_of(glob[len(head) :])
    for info in store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=False)):
        if info.is_file and pattern.match(info.path):
            yield head + info.path, info.size
