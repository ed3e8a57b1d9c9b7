"""Mark the files that layers already read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a layer source writes the path of a remote file.
PLAIN_PATH = "/vsicurl/"
OPTION_PATH = "/vsicurl?empty_dir=yes&url="


def quoted(url: Column) -> Column:
    """Percent-encode every reserved character of a URL."""
    encoded = F.url_encode(url)
    for form, standard in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(standard))
    return encoded


def _keys(text: Column) -> list[Column]:
    """Return two hashes that stand for a text, 128 bits in all."""
    return [F.xxhash64(text).alias("_one"), F.xxhash64(F.lit("2"), text).alias("_two")]


def _named_in(hits: DataFrame, path: Column, sources: DataFrame, marker: str) -> DataFrame:
    """Return the keys of the rows of ``hits`` whose ``path`` follows the marker in a source.

    A source contains ``marker + path`` exactly when the path is a prefix of
    what follows the marker, so the test becomes an equality join. Only
    prefixes as long as some path are formed, and only hashes move.
    """
    pieces = F.split(F.col("source"), F.lit("\\Q" + marker + "\\E"))
    after = sources.select(F.explode(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("rest"))
    # One row: there are no more lengths than the longest path has characters.
    lengths = hits.agg(F.sort_array(F.collect_set(F.length(path))).alias("sizes"), F.lit(1).alias("_all"))
    filled = after.where("rest <> ''").withColumn("_all", F.lit(1)).join(F.broadcast(lengths), "_all")
    fitting = F.filter("sizes", lambda size: (size > 0) & (size <= F.length("rest")))
    cut = filled.select("rest", F.explode(fitting).alias("size"))
    prefixes = cut.select(*_keys(F.expr("left(rest, size)")))
    return _semi(hits.select("_href_one", "_href_two", *_keys(path)), prefixes).select("_href_one", "_href_two")


def _semi(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.distinct().hint("merge"), ["_one", "_two"], "left_semi")


def mark_used(files: DataFrame, urls: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``used`` to ``files(href, read_url)``: whether a layer reads the file.

    ``urls.url`` are addresses that layers keep, ``sources.source`` their
    source texts. A file counts as used when its href or read URL is kept, its
    href is a source, or a source contains its path form.
    """
    own = [key.alias(f"_href{key_name}") for key, key_name in zip(_keys(F.col("href")), ("_one", "_two"), strict=True)]
    hits = files.where("href IS NOT NULL").select("href", *own)
    direct = urls.select(*_keys(F.col("url"))).union(sources.select(*_keys(F.col("source"))))
    by_href = _semi(hits.select("_href_one", "_href_two", *_keys(F.col("href"))), direct).select("_href_one", "_href_two")
    by_path = _named_in(hits, F.col("href"), sources, PLAIN_PATH)
    by_option = _named_in(hits, quoted(F.col("href")), sources, OPTION_PATH)
    used = by_href.union(by_path).union(by_option).distinct().withColumn("_by_href", F.lit(True)).hint("merge")
    reads = urls.where("url IS NOT NULL").select(*(key.alias(f"_read{key_name}") for key, key_name in zip(_keys(F.col("url")), ("_one", "_two"), strict=True)))
    reads = reads.distinct().withColumn("_by_read", F.lit(True)).hint("merge")
    read = [key.alias(f"_read{key_name}") for key, key_name in zip(_keys(F.col("read_url")), ("_one", "_two"), strict=True)]
    joined = files.select("*", *own, *read).join(used, ["_href_one", "_href_two"], "left").join(reads, ["_read_one", "_read_two"], "left")
    kept = F.col("href").isNotNull() & F.col("_by_href").isNotNull() | F.col("read_url").isNotNull() & F.col("_by_read").isNotNull()
    return joined.select(*files.columns, kept.alias("used"))
