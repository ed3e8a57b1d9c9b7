"""Substring dedup: passages of many words that an earlier document has are cut out.

Windows are dealt to shards by their rarest run of words, so that equal
windows meet in one shard. A shard holds the different passages around its
runs in an FM-index, streams them backwards through it, and reports the
windows that an earlier document has as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.llm.fm_index import FMIndex
from geoquarry.llm.sketches import bitmap, frequency_levels, frequency_slots, marked
from geoquarry.llm.text_arrays import STEP, Block, _powers, mixed, text_blocks

WINDOW = 50
RUN = 16
# Windows of a passage, and words that a shard should hold.
PASSAGE = 64
SHARD_WORDS = 400_000


def run_hashes(block: Block, run: int = RUN) -> np.ndarray:
    """Return a hash of every ``run`` words in a row of a block, across its texts."""
    block.find_words()
    words = block.hashes()
    if len(words) < run:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) - run + 1, np.uint64)
    for offset in range(run):
        sums *= STEP
        sums += words[offset : offset + len(sums)]
    return mixed(sums)


def _runs_inside(block: Block, run: int = RUN) -> np.ndarray:
    """Return the hashes of the runs that lie in one text."""
    hashes = run_hashes(block, run)
    inside = np.zeros(len(hashes) + 1, np.int64)
    first = np.minimum(block.bounds[:-1], len(hashes))
    last = np.clip(block.bounds[1:] - run + 1, first, len(hashes))
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    return hashes[np.cumsum(inside)[:-1] > 0]


class Passages:
    """The windows of a block's texts, cut into passages of one anchor each."""

    def __init__(self, block: Block, levels: np.ndarray, window: int) -> None:
        hashes = run_hashes(block)
        counts = np.maximum(np.diff(block.bounds) - window + 1, 0)
        self.text = np.zeros(0, np.int64)
        self.block = block
        if not counts.any():
            self.start = self.count = self.first = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        # Rare runs first, then by hash.
        least = levels[frequency_slots(hashes)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)
        width, span = 1, window - RUN + 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        rest = span - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        owner = np.repeat(np.arange(block.count), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = block.bounds[owner] + at
        anchor = least[place]
        cut = np.ones(len(anchor), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] == 0)
        begin = np.flatnonzero(cut)
        inside = np.arange(len(anchor)) - np.repeat(begin, np.diff(np.append(begin, len(anchor))))
        begin = np.flatnonzero(inside % PASSAGE == 0)
        self.count = np.diff(np.append(begin, len(anchor)))
        self.text, self.start, self.first, self.anchor = owner[begin], at[begin], place[begin], anchor[begin]

    def names(self, chosen: np.ndarray, window: int) -> np.ndarray:
        """Return a hash of the words of each chosen passage."""
        words = self.block.hashes()
        powers, back = _powers(STEP, len(words) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)], dtype=np.uint64)])
        low, size = self.first[chosen], self.count[chosen] + window - 1
        return mixed((sums[low + size] - sums[low]) * back[low] + size.astype(np.uint64))

    def bodies(self, chosen: np.ndarray, window: int) -> list[bytes]:
        """Return the words of each chosen passage, joined by one space."""
        block = self.block
        low, high = self.first[chosen], self.first[chosen] + self.count[chosen] + window - 1
        return [
            b" ".join(block.data[a:b].tobytes().split()) for a, b in zip(block.starts[low], block.ends[high - 1], strict=True)
        ]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def _anchors(texts: DataFrame, levels: np.ndarray, window: int) -> DataFrame:
    """Return ``anchor, doc_id, passages`` of all passages, once per text and anchor."""
    shared = texts.sparkSession.sparkContext.broadcast(levels.tobytes())  # 2 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                found = Passages(block, table, window)
                ids = batch.column(0).slice(block.first, block.count).take(pa.array(found.text))
                yield pa.RecordBatch.from_arrays([_long(found.anchor), ids], ["anchor", "doc_id"])

    return texts.select("doc_id", "text").mapInArrow(run, "anchor bigint, doc_id bigint")


def _passages(texts: DataFrame, levels: np.ndarray, repeated: np.ndarray, window: int, bodies: bool) -> DataFrame:
    """Return the passages whose anchors are marked, with their words or with their places."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((levels.tobytes(), repeated.tobytes()))  # 10 MB, fixed
    names = ["anchor", "name", "doc_id", *(["body"] if bodies else ["digest", "start", "count"])]
    fields = "anchor bigint, name bigint, doc_id bigint, " + ("body binary" if bodies else "digest bigint, start int, count int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, filter_ = (np.frombuffer(part, np.uint8) for part in shared.value)
        for batch in batches:
            for block in text_blocks(batch.column(2)):
                found = Passages(block, table, window)
                chosen = np.flatnonzero(marked(filter_, found.anchor))
                rows = batch.slice(block.first, block.count)
                take = pa.array(found.text[chosen])
                columns = [_long(found.anchor[chosen]), _long(found.names(chosen, window)) if len(chosen) else pa.array([], pa.int64()), rows.column(0).take(take)]
                if bodies:
                    columns.append(pa.array(found.bodies(chosen, window), pa.binary()))
                else:
                    columns += [
                        rows.column(1).take(take), pa.array(found.start[chosen].astype(np.int32)), pa.array(found.count[chosen].astype(np.int32)),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("doc_id", "digest", "text").mapInArrow(run, fields)


def searched(shard: pa.Table, window: int) -> pa.Table:
    """Search the passages of one shard in its index; return each one's windows that an earlier document has.

    ``spans`` are word ranges inside the passage, as flat pairs.
    """
    texts = shard.column("body").combine_chunks().cast(pa.large_binary()).cast(pa.large_string())
    hashes, sizes = [], []
    for block in text_blocks(texts):
        block.find_words()
        hashes.append(block.hashes())
        sizes.append(np.diff(block.bounds))
    _, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    index = FMIndex(numbers + 1, bounds, window)
    documents = shard.column("doc_id").to_numpy()
    least = index.block_least(documents)
    passage, start, block = index.window_blocks(window)
    early = least[block] < documents[passage]
    passage, start = passage[early], start[early]
    order = np.lexsort((start, passage))
    passage, start = passage[order], start[order]
    fresh = np.ones(len(passage), bool)
    fresh[1:] = (passage[1:] != passage[:-1]) | (start[1:] > start[:-1] + window)
    begin = np.flatnonzero(fresh)
    finish = np.append(begin[1:], len(passage))[: len(begin)] - 1
    spans = np.column_stack([start[begin], start[finish] + window]).astype(np.int32).reshape(-1)
    held = np.bincount(passage[begin], minlength=shard.num_rows) * 2
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(spans))
    return pa.table({"anchor": shard.column("anchor"), "name": shard.column("name"), "least": shard.column("doc_id"), "spans": lists})


def repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Return ``doc_id, digest, spans``: the word ranges of each text that windows of earlier documents cover.

    Earlier means a smaller ``doc_id``; null ids are neither earlier nor
    later than any. ``digest`` is a hash of the text and tells rows of equal
    id apart. Only texts with a range have a row. Windows are judged on the
    input.
    """
    if window < RUN:
        raise ValueError(f"A window has at least {RUN} words")
    prepared(docs)
    texts = _texts(docs)
    named = texts.filter("doc_id IS NOT NULL")
    levels = frequency_levels(named, _runs_inside)
    seen = _anchors(named, levels, window).groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("passages")
    )
    shared = seen.filter("low < high").select("anchor", "passages").checkpoint()
    total = shared.agg(F.sum("passages").alias("passages")).first()["passages"] or 0
    shards = max(1, -(-total * (window + PASSAGE // 4) // SHARD_WORDS))
    repeated = bitmap(shared.select("anchor"))
    bodies = _passages(named, levels, repeated, window, True)
    different = bodies.groupBy("anchor", "name", "body").agg(F.min("doc_id").alias("doc_id"))
    dealt = different.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    results = dealt.groupBy("shard").applyInArrow(
        lambda shard: searched(shard, window), "anchor bigint, name bigint, least bigint, spans array<int>"
    )
    places = _passages(named, levels, repeated, window, False)
    # A passage whose first document is another one goes as a whole.
    hit = places.join(results, ["anchor", "name"]).filter((F.col("doc_id") > F.col("least")) | (F.size("spans") > 0))
    whole = F.array(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("count") + (window - 1)).alias("end")))
    parts = F.transform(
        F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)),
        lambda at: F.struct((F.get("spans", at) + F.col("start")).alias("begin"), (F.get("spans", at + 1) + F.col("start")).alias("end")),
    )
    ranges = hit.select("doc_id", "digest", F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(parts)).alias("range"))
    return ranges.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("range")).alias("spans"))


def _cut(text: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """Return the number of words, of removed words, and the kept words joined by one space."""
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        gone[span["begin"]] += 1
        gone[span["end"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    kept = words if keep.all() else [word for word, stays in zip(words, keep, strict=True) if stays]
    return len(words), len(words) - len(kept), b" ".join(kept)


def with_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Add the column ``_spans`` of ``repeats`` to the documents, null without any; for internal use."""
    found = repeats(docs, window=window).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_its"), F.col("spans").alias("_spans")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.col("doc_id").cast("bigint") == F.col("_id")) & (F.xxhash64(text) == F.col("_its"))
    return docs.join(found, same, "left").drop("_id", "_its")


def kept_digests(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Return ``doc_id, n_words, n_removed, kept_sha256`` of every document.

    Null and empty texts have no words. Repeated rows have equal results: a
    row of the same id is not earlier. An empty table gives an empty one.
    """
    rows = with_repeats(docs.select("doc_id", F.col("text").cast("string").alias("text")), window=window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1), batch.column(2)
            made = [_cut((text.as_py() or "").encode(), span.as_py() or []) for text, span in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([row[0] for row in made], pa.int64()), pa.array([row[1] for row in made], pa.int64()),
                    pa.array([hashlib.sha256(row[2]).hexdigest() for row in made], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    fields = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "_spans").mapInArrow(run, fields)


def without_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Return the documents with repeated passages cut out of their texts; all other texts stay as they are.

    The kept words of a cut text are joined by one space. ``n_chars``, where
    the input has it, is the new length of a cut text.
    """
    names = docs.columns
    packed = docs.select(F.struct(*(docs[name] for name in names)).alias("_row"), "doc_id", F.col("text").cast("string").alias("text"))
    rows = with_repeats(packed, window=window)

    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [None if not span.is_valid else _cut((text.as_py() or "").encode(), span.as_py())[2].decode() for text, span in zip(texts, spans, strict=True)],
            pa.string(),
        )

    cut = rows.withColumn("_kept", kept("text", "_spans"))
    changed = F.col("_spans").isNotNull()

    def column(name: str) -> F.Column:
        old = F.col("_row").getField(name)
        if name == "text":
            return F.when(changed, F.col("_kept")).otherwise(old).alias(name)
        if name == "n_chars":
            return F.when(changed, F.length("_kept").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return cut.select(*(column(name) for name in names))
