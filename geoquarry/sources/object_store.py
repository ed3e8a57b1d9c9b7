"""Object stores: session settings for awkward bucket names, and opening files in tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrameReader, SparkSession

REGION = re.compile(r"^([a-z]{2}(?:-gov)?-[a-z]+-\d)\.")
DEFAULT_REGION = "us-east-1"


def bucket_settings(urls: Iterable[str]) -> dict[str, str]:
    """Return the Hadoop settings of each S3 bucket whose name holds a dot.

    The certificate of the virtual-hosted address covers one label, so such a
    bucket needs path-style access, and its region to find the endpoint.
    """
    hosts = {urlsplit(url).hostname for url in urls if re.match(r"^s3[an]?://", url)}
    settings: dict[str, str] = {}
    for bucket in sorted(host for host in hosts if host and "." in host):
        found = REGION.match(bucket)
        prefix = f"fs.s3a.bucket.{bucket}"
        settings[f"{prefix}.path.style.access"] = "true"
        settings[f"{prefix}.endpoint.region"] = found[1] if found else DEFAULT_REGION
    return settings


def reader_of(spark: SparkSession, urls: Iterable[str]) -> DataFrameReader:
    """Return a reader that has the settings of the buckets it is going to read."""
    return spark.read.options(**bucket_settings(urls))


def store_of(path: str) -> tuple[Any, str]:
    """Return the file system of a path or URL, and the name in it."""
    import pyarrow.fs as fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub(r"^file:(//(?=/))?", "", path).rstrip("/")
    store, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return store, inner.rstrip("/")


def open_input(path: str) -> Any:
    """Open a file for random access inside a task, on local disk or an object store."""
    store, inner = store_of(path)
    # Listings give the plain name, file metadata the percent-encoded one.
    local = path.startswith(("file:", "/")) and not os.path.exists(inner)
    return store.open_input_file(unquote(inner) if local else inner)
