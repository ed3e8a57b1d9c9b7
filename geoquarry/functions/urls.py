"""URL arithmetic as JVM column expressions: joining, object stores, names, local paths."""

from __future__ import annotations

from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoquarry.functions.bindings import as_column, let, record

if TYPE_CHECKING:
    from collections.abc import Callable

# RFC 3986, appendix B, with a strict scheme.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HOST = r"^(?:.*@)?(\[[^\]]*\]|[^:]*)"

# Hosts, schemes and patterns of the object stores.
GCS_HOST = "storage.googleapis.com"
DFS_SUFFIX = ".dfs.core.windows.net"
AZURE_SCHEMES = ("abfs", "abfss", "az")
RELATIVE_SCHEMES = ("", "http", "https", "ftp", "file")
STORE_ADDRESS = r"^(?i:s3|gs|abfss?|az):"
# Folders and a name without dots to fold, empty folders, query or fragment; a base and paths made of them.
_STEPS = r"(?:(?!\.{1,2}/)[^:/?#\x01]++/){0,64}+(?!\.{1,2}\z)[^:/?#\x01]*+\z"
PLAIN_BASE = r"^https?://[^/?#\x01]++/" + _STEPS
PLAIN_PATH = r"^(?:\./)?+" + _STEPS
PLAIN_ROOTED = r"^/(?!/)" + _STEPS
S3_WEBSITE = r"(?i)^(.+)\.s3-website[.-]([a-z0-9-]+)\.amazonaws\.com$"
S3_VIRTUAL = r"(?i)^(.+)\.s3(?:[.-]([a-z0-9-]+))?\.amazonaws\.com$"
S3_PATH = r"(?i)^s3(?:[.-]([a-z0-9-]+))?\.amazonaws\.com$"
REGION_PREFIX = r"^([a-z]{2}(?:-gov)?-[a-z]+-\d)\."
IMAGE_EXTENSION = r"(?i)\.(png|jpe?g|webp|gif|svg)($|[?#])"
UNSAFE_IN_PATHS = r"[^A-Za-z0-9._@+=-]"
EXTERNAL_FOLDER = "_external"


class UrlParts(NamedTuple):
    """The five parts of a URL; a missing part is the empty string."""

    scheme: Column
    netloc: Column
    path: Column
    query: Column
    fragment: Column

    @property
    def host(self) -> Column:
        """Return the host in lower case, without user and port."""
        return F.lower(F.regexp_extract(self.netloc, _HOST, 1))

    @property
    def user(self) -> Column:
        """Return the user name before ``@``."""
        return F.regexp_extract(self.netloc, r"^([^:@]*)(?::[^@]*)?@", 1)

    @property
    def tail(self) -> Column:
        """Return path, query and fragment as one text."""
        return F.concat(self.path, _prefixed("?", self.query), _prefixed("#", self.fragment))


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise(F.lit(""))


def with_parts(url: Column, body: Callable[[UrlParts], Column]) -> Column:
    """Split a URL once and build an expression from its parts."""

    # One match fills all five groups; a match per part would run the pattern five times.
    marked = F.regexp_replace(url, _URL, "$1\u0001$2\u0001$3\u0001$4\u0001$5")

    def named(found: Column) -> Column:
        pieces = [F.get(found, F.lit(index)) for index in range(5)]
        return body(UrlParts(F.lower(pieces[0]), *pieces[1:]))

    return let(F.split(marked, "\u0001"), named)


def last_segment(path: Column) -> Column:
    """Return the text after the last slash."""
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def percent_decode(text: Column) -> Column:
    """Decode each percent escape and leave ``+`` alone; malformed escapes stay as they are."""
    marked = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(marked), text)


def _with_low_scheme(href: Column) -> Column:
    """Return an absolute URL with its scheme in lower case."""
    at = F.instr(href, ":")
    return F.concat(F.lower(F.substring(href, F.lit(1), at - F.lit(1))), F.substring(href, at, F.length(href)))


def _origin(scheme: Column, netloc: Column) -> Column:
    """Return what comes before a path: nothing for a plain path."""
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), netloc)).when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise("")


def _fold_dots(segments: Column) -> Column:
    """Drop ``.`` and let ``..`` remove the segment before it."""
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.array_append(kept, part)),
    )
    dotted_end = F.element_at(segments, -1).isin(".", "..")
    return F.when(dotted_end, F.array_append(folded, F.lit(""))).otherwise(folded)


def join_url(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base`` (RFC 3986, section 5.2)."""
    return let(
        record(href=href, base=base),
        lambda pair: F.when(F.coalesce(pair["base"], F.lit("")) == "", pair["href"])
        .when(pair["href"] == "", pair["base"])
        .when(pair["href"].rlike(r"^(?i:https?)://[^?#]+$"), _with_low_scheme(pair["href"]))
        .when(pair["href"].rlike(STORE_ADDRESS), _with_low_scheme(pair["href"]))
        .when(pair["base"].rlike(PLAIN_BASE) & pair["href"].rlike(PLAIN_PATH), _below(pair["href"], pair["base"]))
        .when(
            pair["base"].rlike(PLAIN_BASE) & pair["href"].rlike(PLAIN_ROOTED),
            F.concat(F.regexp_extract(pair["base"], r"^(https?://[^/]+)", 1), pair["href"]),
        )
        .otherwise(
            with_parts(
                pair["href"],
                lambda own: with_parts(
                    pair["base"], lambda root: _resolve(pair["href"], own, root)
                ),
            )
        ),
    )


def _below(href: Column, base: Column) -> Column:
    """Resolve a plain path against a plain base: the usual case, without splitting either."""
    bare = F.when(href.startswith("./"), F.substring(href, F.lit(3), F.length(href))).otherwise(href)
    return F.concat(F.regexp_extract(base, r"(?s)^(.*/)", 1), bare)


def _resolve(href: Column, own: UrlParts, root: UrlParts) -> Column:
    scheme = F.when(own.scheme == "", root.scheme).otherwise(own.scheme)
    foreign = (scheme != root.scheme) | ~scheme.isin(*RELATIVE_SCHEMES)
    head = _origin(root.scheme, root.netloc)
    same_document = F.concat(
        head,
        root.path,
        _prefixed("?", F.when(own.query != "", own.query).otherwise(root.query)),
        _prefixed("#", own.fragment),
    )
    moved = F.concat(
        head,
        _merged_path(own.path, root.path),
        _prefixed("?", own.query),
        _prefixed("#", own.fragment),
    )
    return (
        F.when(foreign, F.when(own.scheme != "", _with_low_scheme(href)).otherwise(href))
        .when(own.netloc != "", F.concat(_origin(scheme, own.netloc), own.tail))
        .when(own.path == "", same_document)
        .otherwise(moved)
    )


def _merged_path(own: Column, root: Column) -> Column:
    folders = F.split(F.regexp_replace(root, r"(?s)/?[^/]*$", ""), "/")
    steps = F.split(own, "/")
    inner = F.filter(
        F.concat(folders, F.slice(steps, 1, F.size(steps) - 1)), lambda part: part != ""
    )
    merged = F.concat(F.array(F.lit("")), inner, F.slice(steps, -1, 1))
    segments = F.when(own.startswith("/"), steps).otherwise(merged)
    walked = let(segments, lambda found: F.array_join(_fold_dots(found), "/"))
    return let(
        walked,
        lambda path: F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)),
    )


def catalog_href(href: Column) -> Column:
    """Turn an S3 website endpoint into its HTTPS REST endpoint."""

    def rest(url: Column, parts: UrlParts) -> Column:
        return let(
            record(
                bucket=F.regexp_extract(parts.host, S3_WEBSITE, 1),
                region=F.regexp_extract(parts.host, S3_WEBSITE, 2),
            ),
            lambda site: F.when(site["bucket"] == "", url)
            .when(
                site["bucket"].contains("."),
                F.concat(
                    F.lit("https://s3."), site["region"], F.lit(".amazonaws.com/"),
                    site["bucket"], parts.tail,
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("https://"), site["bucket"], F.lit(".s3."), site["region"],
                    F.lit(".amazonaws.com"), parts.tail,
                )
            ),
        )

    return let(
        href,
        lambda url: F.when(
            url.contains(".s3-website"), with_parts(url, lambda parts: rest(url, parts))
        ).otherwise(url),
    )


def absolute_href(href: Column, base: Column | str) -> Column:
    """Resolve a document's href and upgrade website endpoints."""
    return catalog_href(join_url(href, as_column(base)))


def bucket_region(bucket: Column) -> Column:
    """Return the region a bucket name starts with, else NULL."""
    return F.nullif(F.regexp_extract(bucket, REGION_PREFIX, 1), F.lit(""))


def _s3_https(bucket: Column, tail: Column) -> Column:
    region = F.concat(bucket_region(bucket), F.lit("."))
    return F.when(
        bucket.contains("."),
        F.concat(
            F.lit("https://s3."), F.coalesce(region, F.lit("")), F.lit("amazonaws.com/"),
            bucket, tail,
        ),
    ).otherwise(F.concat(F.lit("https://"), bucket, F.lit(".s3.amazonaws.com"), tail))


def asset_href(
    href: Column, base: Column | str, account: Column | str | None = None
) -> Column:
    """Resolve an asset's href and give object-store addresses their HTTPS form.

    A short Azure address without a storage account stays as it is.
    """

    def store_form(url: Column, parts: UrlParts) -> Column:
        known = parts.host != ""
        azure = let(
            F.when(
                parts.host.endswith(DFS_SUFFIX),
                record(
                    container=percent_decode(parts.user),
                    account=F.regexp_replace(parts.host, r"\.dfs\.core\.windows\.net$", ""),
                ),
            ).otherwise(
                record(
                    container=parts.host,
                    account=F.coalesce(as_column(account).cast("string"), F.lit("")),
                )
            ),
            lambda place: F.when(
                (place["container"] != "") & (place["account"] != ""),
                F.concat(
                    F.lit("https://"), place["account"], F.lit(".blob.core.windows.net/"),
                    place["container"], parts.tail,
                ),
            ).otherwise(url),
        )
        return (
            F.when((parts.scheme == "s3") & known, _s3_https(parts.host, parts.tail))
            .when(
                (parts.scheme == "gs") & known,
                F.concat(F.lit(f"https://{GCS_HOST}/"), parts.host, parts.tail),
            )
            .when(parts.scheme.isin(*AZURE_SCHEMES), azure)
            .otherwise(url)
        )

    return let(
        absolute_href(href, base),
        lambda url: F.when(
            url.rlike(STORE_ADDRESS),
            with_parts(url, lambda parts: store_form(url, parts)),
        ).otherwise(url),
    )


def bucket_url(href: Column) -> Column:
    """Return the listable ``s3://`` or ``gs://`` form of an href, else NULL."""

    def listable(parts: UrlParts) -> Column:
        has_object = parts.path.rlike(r"/[^/]*/")
        return let(
            parts.host,
            lambda host: F.when(parts.scheme.isin("s3", "gs"), F.when(host != "", href))
            .when((parts.scheme != "https") | (host == ""), F.lit(None).cast("string"))
            .when(host == GCS_HOST, F.when(has_object, F.concat(F.lit("gs:/"), parts.path)))
            .when(host.rlike(S3_PATH), F.when(has_object, F.concat(F.lit("s3:/"), parts.path)))
            .when(
                host.rlike(S3_VIRTUAL),
                F.concat(F.lit("s3://"), F.regexp_extract(host, S3_VIRTUAL, 1), parts.path),
            ),
        )

    return with_parts(href, listable)


def is_http_url(value: Column) -> Column:
    """Return whether the text is an absolute http(s) URL with a host."""
    return F.coalesce(value.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def is_image(href: Column, media_type: Column) -> Column:
    """Return whether an http(s) href names a picture: by media type, else by extension."""
    media = F.lower(F.coalesce(media_type, F.lit("")))
    by_type = media.startswith("image/") & ~media.contains("tiff")
    return is_http_url(href) & F.when(media != "", by_type).otherwise(href.rlike(IMAGE_EXTENSION))


def url_path(url: Column) -> Column:
    """Return the path of a URL."""
    return F.regexp_extract(url, _URL, 3)


def is_glob(href: Column) -> Column:
    """Return whether the path holds ``*`` or ``[``; a ``?`` only starts the query."""
    return url_path(href).rlike(r"[*\[]")


def glob_root(href: Column) -> Column:
    """Return the folder before the first path segment that holds a glob character."""

    def root(parts: UrlParts) -> Column:
        kept = F.regexp_replace(parts.path, r"(?s)(^|/)[^/]*[*\[].*$", "")
        return F.concat(
            F.when(parts.scheme != "", F.concat(parts.scheme, F.lit(":"))).otherwise(F.lit("")),
            F.when(parts.netloc != "", F.concat(F.lit("//"), parts.netloc)).otherwise(F.lit("")),
            kept,
        )

    return with_parts(href, root)


def url_extension(url: Column) -> Column:
    """Return the lower-case extension of the file a URL names, else the empty text."""
    return F.lower(F.regexp_extract(last_segment(url_path(url)), r"(?s)\.([^.]*)$", 1))


def folder_name(href: Column) -> Column:
    """Name a document after its folder; a JSON file at the root gives its own stem."""

    def named(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        return F.when(F.size(segments) == 0, href).otherwise(
            percent_decode(
                F.when(~F.lower(last).endswith(".json"), last)
                .when(F.size(segments) > 1, F.get(segments, F.size(segments) - 2))
                .otherwise(F.regexp_replace(last, r"(?i)\.json$", ""))
            )
        )

    return let(F.filter(F.split(url_path(href), "/"), lambda part: part != ""), named)


def browser_url(href: Column, base: str) -> Column:
    """Return the viewer page of a document below the viewer address ``base``.

    NULL for an href that is not http(s).
    """
    address, _mark, query = base.partition("#")[0].partition("?")
    root = address if address.endswith("/") else address + "/"
    start = f"{root}?{query}#" if query else f"{root}#"

    def page(parts: UrlParts) -> Column:
        plain = F.when(parts.scheme != "https", F.concat(parts.scheme, F.lit(":/")))
        return F.concat(
            F.lit(f"{start}/external/"),
            F.coalesce(plain, F.lit("")),
            parts.netloc,
            F.lit("/"),
            F.regexp_replace(parts.path, "^/", ""),
            _prefixed("?", parts.query),
        )

    return F.when(is_http_url(href), with_parts(href, page))


def extension_blocked(url: Column, allowed: str | None) -> Column:
    """Return whether an allow-list of name endings (commas or blanks between) shuts a URL out."""
    if not allowed:
        return F.lit(False)
    endings = [entry.lower() for entry in allowed.replace(",", " ").split()]
    return let(
        F.lower(last_segment(url_path(url))),
        lambda name: ~F.exists(
            F.array(*(F.lit(entry) for entry in endings)), lambda entry: name.endswith(entry)
        ),
    )


def _safe_segments(path: Column) -> Column:
    return F.transform(
        F.filter(F.split(percent_decode(path), "/"), lambda part: ~part.isin("", ".", "..")),
        lambda part: F.regexp_replace(part, UNSAFE_IN_PATHS, "_"),
    )


def local_path(url: Column, root: Column | str) -> Column:
    """Return where a URL lands below the download folder.

    A URL below the root document's folder keeps its relative path, others go
    to ``_external/<host>/``. The path cannot climb out of the folder.
    """

    def place(own: UrlParts, top: UrlParts) -> Column:
        folder = F.concat(F.regexp_replace(top.path, r"/*[^/]*$", ""), F.lit("/"))
        inside = (own.scheme == top.scheme) & (own.netloc == top.netloc)
        segments = F.when(
            inside & own.path.startswith(folder),
            _safe_segments(F.substring(own.path, F.length(folder) + 1, F.length(own.path))),
        ).otherwise(
            F.concat(
                F.array(F.lit(EXTERNAL_FOLDER)),
                _safe_segments(own.netloc),
                _safe_segments(own.path),
            )
        )
        return let(
            F.array_join(segments, "/"),
            lambda joined: F.when(joined == "", F.lit("index"))
            .when(joined == EXTERNAL_FOLDER, F.lit(f"{EXTERNAL_FOLDER}/index"))
            .otherwise(joined),
        )

    return with_parts(url, lambda own: with_parts(as_column(root), lambda top: place(own, top)))


def clipped_path(href: Column, root: Column | str, suffix: str = ".clipped.parquet") -> Column:
    """Return where the clipped copy of a GeoParquet file goes, with the output's suffix.

    A glob writes one output named after the folder that holds its partitions.
    """
    glob_file = let(
        glob_root(href),
        lambda folder: F.concat(
            folder,
            F.lit("/"),
            F.coalesce(F.nullif(last_segment(folder), F.lit("")), F.lit("partitions")),
            F.lit(".parquet"),
        ),
    )
    named = F.when(is_glob(href), glob_file).otherwise(href)
    bare = F.regexp_replace(local_path(named, root), r"(?i)\.(geo)?parquet$", "")
    return F.concat(bare, F.lit(suffix))


def target_path(folder: str, path: Column) -> Column:
    """Return the file a planned path names below ``folder``, NULL when it would leave it."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.lit(0),
        lambda level, part: F.when(level < 0, level)
        .when(part.isin("", "."), level)
        .when(part == "..", level - 1)
        .otherwise(level + 1),
    )
    tidy = let(
        F.split(path, "/"),
        lambda parts: F.array_join(F.filter(_fold_dots(parts), lambda part: part != ""), "/"),
    )
    inside = ~path.startswith("/") & (depth >= 0)
    return F.when(inside, F.concat(F.lit(folder.rstrip("/") + "/"), tidy))


def url_parts_of(url: Column) -> Column:
    """Return a struct of ``scheme, netloc, host, path, query, fragment``."""
    return with_parts(
        url,
        lambda parts: record(
            scheme=parts.scheme,
            netloc=parts.netloc,
            host=parts.host,
            path=parts.path,
            query=parts.query,
            fragment=parts.fragment,
        ),
    )
