"""Document fingerprints: MinHash signatures over five-word shingles, bands, and verified pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.llm.components import components, sent, settled
from geoquarry.llm.sketches import bitmap, marked
from geoquarry.llm.text_arrays import Block, shingle_hashes, text_blocks

SHINGLE = 5
PERMUTATIONS = 128
# A band is four places of a signature: a pair of similarity 0.8 shares one of them but for one in ten million.
BANDS = 32
SIMILARITY = 0.8
# So often a bucket's outsiders are compared with the first of them before all that is left is paired.
STARS = 2
# Longs of a set's parity sketch, and texts of a bucket that one task meets with all others of it.
PARITY_LONGS = 16
BLOCK_ROWS = 2_000
# One bucket of neighbouring ids for so many documents, with limits on how many.
BUCKET_ROWS = 2_000
MOST_BUCKETS = 100_000
# Ranges that a task compares, with limits on how many tasks.
TASK_RANGES = 1
FILTER_ROWS = 1_000
MOST_TASKS = 10_000

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_STRIDE = 1 << 15


def signatures(column: pa.Array) -> np.ndarray:
    """Return a row of ``PERMUTATIONS`` 16-bit minima per text.

    A permutation maps a shingle's hash x to the high bits of ``a * x + b``;
    two texts agree in one place with a chance of their Jaccard similarity.
    A text without words has the largest value everywhere.
    """
    parts = [np.zeros((0, PERMUTATIONS), np.uint16)]
    for block in text_blocks(column):
        parts.append(_minima(*_shingles(block)))
    return np.concatenate(parts)


def _shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Return the shingle hashes of a block of texts, and the bounds of each text's."""
    block.find_words()
    return shingle_hashes(block.hashes(), block.bounds, SHINGLE)


def _minima(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    count = len(bounds) - 1
    least = np.full((count, PERMUTATIONS), 0xFFFFFFFF, np.uint64)
    # Texts are worked on in strides that stay in the cache.
    first = 0
    while first < count:
        stop = max(int(np.searchsorted(bounds, bounds[first] + _STRIDE, "right")) - 1, first + 1)
        texts = np.arange(first, stop)[np.diff(bounds[first : stop + 1]) > 0]
        for low in range(bounds[first], bounds[stop], _STRIDE):
            high = min(low + _STRIDE, bounds[stop])
            here = texts[(bounds[texts] < high) & (bounds[texts + 1] > low)]
            begin = np.maximum(bounds[here], low) - low
            values = shingles[low:high]
            work = np.empty_like(values)
            for number in range(PERMUTATIONS):
                np.multiply(values, _FACTORS[number], out=work)
                np.add(work, _SHIFTS[number], out=work)
                found = np.minimum.reduceat(work, begin) >> np.uint64(32)
                least[here, number] = np.minimum(least[here, number], found)
        first = stop
    # The minima of large texts are small numbers; scramble before the low bits are kept.
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def _parities(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return each text's number of distinct shingles, and a bit per slot that an odd number of them falls into."""
    values = shingles.copy()
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        values[low:high].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[fresh]
    values = values[fresh]
    parity = np.zeros((len(bounds) - 1, PARITY_LONGS), np.uint64)
    place = (values >> np.uint64(6)) & np.uint64(PARITY_LONGS - 1)
    np.bitwise_xor.at(parity.reshape(-1), owner * PARITY_LONGS + place.astype(np.int64), np.uint64(1) << (values & np.uint64(63)))
    return np.bincount(owner, minlength=len(parity)), parity


def _hex(values: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in values]


def fingerprint(text: Column) -> Column:
    """Return a text's fingerprint as hexadecimal digits, four per permutation."""

    @F.arrow_udf("string")
    def made(column: pa.Array) -> pa.Array:
        return pa.array(_hex(signatures(column)), pa.string())

    return made(text)


def _sketched(text: Column) -> Column:
    """Return ``signature, n, parity`` of a text: its fingerprint, its number of distinct shingles, and their parities."""

    @F.arrow_udf("signature string, n bigint, parity array<bigint>")
    def made(column: pa.Array) -> pa.Array:
        signature, sizes, parity = [], [np.zeros(0, np.int64)], [np.zeros((0, PARITY_LONGS), np.uint64)]
        for block in text_blocks(column):
            shingles, bounds = _shingles(block)
            signature += _hex(_minima(shingles, bounds))
            size, odd = _parities(shingles, bounds)
            sizes.append(size)
            parity.append(odd)
        flat = np.concatenate(parity).reshape(-1).view(np.int64)
        places = pa.array(np.arange(len(column) + 1, dtype=np.int32) * PARITY_LONGS)
        fields = [pa.array(signature, pa.string()), pa.array(np.concatenate(sizes).astype(np.int64)), pa.ListArray.from_arrays(places, pa.array(flat))]
        return pa.StructArray.from_arrays(fields, ["signature", "n", "parity"])

    return made(text)


def _may_link(similarity: float) -> Column:
    """Return whether two sets ``n, parity`` and ``m, other`` can be alike.

    Slots of unequal parity, and the sizes, bound the symmetric difference
    from below, so no pair that is alike is left out.
    """
    odd = sum((F.bit_count(F.col("parity")[at].bitwiseXOR(F.col("other")[at])) for at in range(PARITY_LONGS)), F.lit(0))
    apart = F.greatest(odd, F.abs(F.col("n") - F.col("m")))
    # A little more than the bound: it is computed in doubles.
    return apart * (1 + similarity) <= (F.col("n") + F.col("m")) * ((1 - similarity) * (1 + 1e-9)) + 1e-9


def jaccard(left: Column, right: Column) -> Column:
    """Return the Jaccard similarity of the five-word shingle sets of two texts; two empty ones have 1."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for block in text_blocks(column):
            shingles, bounds = _shingles(block)
            yield from (np.unique(shingles[bounds[at] : bounds[at + 1]]) for at in range(block.count))

    @F.arrow_udf("double")
    def similar(one: pa.Array, two: pa.Array) -> pa.Array:
        values = []
        # One block of each side is held at a time, not the sets of the whole batch.
        for a, b in zip(sets(one), sets(two), strict=True):
            common = len(np.intersect1d(a, b, assume_unique=True))
            union = len(a) + len(b) - common
            values.append(common / union if union else 1.0)
        return pa.array(values, pa.float64())

    return similar(left, right)


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """Return ``doc_id, component_id`` of every document.

    Equal texts are one. Texts that share a band of their signatures are
    joined in Spark, and every link is verified on the whole texts.
    ``component_id`` is the smallest ``doc_id`` that links reach. Null and
    empty texts are alone. An empty table gives an empty one.
    """
    prepared(docs)
    return _grouped(docs, similarity).select("doc_id", "component_id")


def _grouped(docs: DataFrame, similarity: float) -> DataFrame:
    """Return ``doc_id, v, component_id`` of every document; ``v`` names its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("v"), text.alias("text"))
    found = _linked(rows.filter("text <> ''").select("v", "text"), similarity)
    placed = rows.select("doc_id", "v", (F.col("text") == "").alias("empty")).join(found, "v", "left")
    placed = placed.withColumn("component", F.coalesce("component", "v"))
    least = placed.filter("NOT empty").groupBy("component").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("empty"), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id"))
    return placed.join(least, "component", "left").select("doc_id", "v", own.alias("component_id"))


def _linked(texts: DataFrame, similarity: float) -> DataFrame:
    """Return ``v, component`` of the texts that share a band with another one.

    A bucket's texts are compared with its first text, then those outside of
    its component with the first of them. That joins copies without pairing
    them with each other. In the end all texts of a bucket that are still in
    different components are paired, so no link of two components is lost.
    Sketches of the sets rule out most pairs before any text moves.
    """
    width = 4 * PERMUTATIONS // BANDS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.xxhash64(band, F.substring("signature", band * width + 1, F.lit(width)))
    )
    named = texts.select("v", _sketched(F.col("text")).alias("s")).select("v", "s.*").select("v", bands.alias("bands"), "n", "parity")
    named = named.dropDuplicates(["v"]).checkpoint()
    sketches = named.select("v", "n", "parity")
    others = sketches.select(F.col("v").alias("w"), F.col("n").alias("m"), F.col("parity").alias("other"))
    possible = _may_link(similarity)
    shared = named.select("v", F.explode("bands").alias("band"))
    crowds = shared.groupBy("band").agg(F.count("*").alias("held")).filter("held > 1").select("band")
    shared, held = settled(shared.join(crowds, "band"))
    found, most = settled(shared.select("v").distinct().withColumn("component", F.col("v")), held)
    links = tried = None
    left, rest, met = shared, held, 0
    for turn in range(STARS + 1):
        rows, many = (left, rest) if turn < STARS else (shared, held)
        placed, _ = settled(rows.join(sent(found, most), "v").select("band", "v", "component"), many)
        if turn < STARS:
            leads = placed.groupBy("band").agg(F.min(F.struct("component", "v")).alias("lead"))
            leads = leads.select("band", F.col("lead.v").alias("w"), F.col("lead.component").alias("its"))
            outside = placed.join(sent(leads, many), "band").filter("component <> its")
            pairs, many = settled(outside.select(F.greatest("v", "w").alias("v"), F.least("v", "w").alias("w")).distinct(), many)
            pairs = sent(sent(pairs, many).join(sketches, "v"), many).join(others, "w").filter(possible).select("v", "w")
        else:
            pairs = _met(placed, sketches, possible)
        pairs, count = settled(pairs if tried is None else pairs.join(sent(tried, met), ["v", "w"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        met += count
        new = _verified(pairs, count, texts, similarity)
        links, _ = settled(new if links is None else links.unionByName(new), met)
        reached = components(links)
        found = found.select("v").join(sent(reached, 2 * met), "v", "left").select("v", F.coalesce("component", "v").alias("component"))
        found, _ = settled(found, most)
        if turn < STARS:
            now = found.select(F.col("v").alias("w"), F.col("component").alias("its"))
            left = outside.select("band", "v", "w").join(sent(found, most), "v").join(sent(now, most), "w").filter("component <> its")
            left, rest = settled(left.select("band", "v"), rest)
    return found


def _met(placed: DataFrame, sketches: DataFrame, possible: Column) -> DataFrame:
    """Return the pairs ``v, w`` of a band's texts in different components whose sketches allow a link, each once.

    Texts of a large bucket are dealt in blocks, each of which meets the whole bucket.
    """
    several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held"))
    several = several.filter("low < high").select("band", F.ceil(F.col("held") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = placed.join(several, "band").join(sketches, "v")
    one = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("blocks")
    two = rows.select(
        "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        *(F.col(name).alias(its) for name, its in (("v", "w"), ("component", "its"), ("n", "m"), ("parity", "other"))),
    )
    pairs = one.join(two, ["band", "block"]).filter(F.col("component") < F.col("its")).filter(possible)
    return pairs.select(F.greatest("v", "w").alias("v"), F.least("v", "w").alias("w")).distinct()


def _verified(pairs: DataFrame, count: int, texts: DataFrame, similarity: float) -> DataFrame:
    """Return the ``count`` pairs ``v, w`` as ``a, b`` whose whole texts are alike; only texts of pairs are moved."""
    names = pairs.select("v").unionByName(pairs.select(F.col("w").alias("v"))).distinct().checkpoint()
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(names).tobytes())  # 8 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_ = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            # Copies of a few rows at a time, not of the whole batch.
            for at in range(0, batch.num_rows, FILTER_ROWS):
                part = batch.slice(at, FILTER_ROWS)
                yield part.filter(pa.array(marked(map_, part.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    whole = texts.mapInArrow(run, "v bigint, text string").join(names, "v", "left_semi").groupBy("v").agg(F.first("text").alias("text")).checkpoint()
    both = sent(pairs, count).join(whole, "v").join(whole.select(F.col("v").alias("w"), F.col("text").alias("other")), "w")
    return both.filter(jaccard(F.col("text"), F.col("other")) >= similarity).select(F.col("v").alias("a"), F.col("w").alias("b"))


def _bucketed(docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Return what deals documents into ranges of ids, the largest ids in range 0; null ids come last of all."""
    totals = docs.agg(F.count("*").alias("rows")).first()
    wanted = int(min(max(totals["rows"] // BUCKET_ROWS, 1), MOST_BUCKETS))
    shares = [step / wanted for step in range(1, wanted)]
    edges: list[int] = []
    if shares:
        # So many numbers, and never more than MOST_BUCKETS.
        found = docs.agg(F.percentile_approx("doc_id", shares, 10 * wanted).alias("edges")).first()["edges"]
        edges = sorted(set(found or []))
    marks = np.array(edges, np.int64)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        place = len(marks) - np.searchsorted(marks, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
        place[np.asarray(ids.is_null())] = len(marks)
        return pa.array(place.astype(np.int32))

    return lambda rows: rows.withColumn("_range", range_of("doc_id"))


def with_next(docs: DataFrame) -> DataFrame:
    """Compare each document with its neighbour in falling order of ids, and with a copy edited from it.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, component_id``; the last is
    that of ``near_duplicates``. The neighbour of the last
    is the first; null ids come last, and rows of equal id are ordered by
    their text. Null texts count as empty: they have no characters, the
    fingerprint of no shingles, and a likeness of 1 with each other. An
    empty table gives an empty one.
    """
    prepared(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    range_ = _bucketed(rows)
    dealt = range_(rows)
    digest = F.xxhash64("text")
    # The first document of every range: one id and digest per range.
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("doc_id").isNotNull().alias("named"), digest.alias("digest"))
    heads = dealt.groupBy("_range").agg(F.max(order).alias("head")).collect()
    known = sorted(row["_range"] for row in heads)
    before = {here: known[place - 1] for place, here in enumerate(known)}  # range -1 is the last
    chosen = [(before[row["_range"]], row["head"]["id"] if row["head"]["named"] else None, row["head"]["digest"]) for row in heads]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(chosen, "_before int, _id bigint, _digest bigint")
    peeks = (
        rows.withColumn("_digest", digest)
        .join(F.broadcast(wanted.withColumnRenamed("_digest", "_its")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_its")))
        .groupBy("_before")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        .select("doc_id", "text", F.col("_before").alias("_range"), F.lit(1).alias("_peek"))
    )
    together = dealt.withColumn("_peek", F.lit(0)).select("doc_id", "text", "_range", "_peek").unionByName(peeks)
    together = together.withColumn("_v", digest).withColumn("_component", F.lit(None).cast("bigint"))
    # Components other than the document itself go to its range, ahead of the texts.
    groups = _grouped(docs, SIMILARITY).filter("NOT doc_id <=> component_id").distinct()
    ahead = range_(groups).select("doc_id", F.lit("").alias("text"), "_range", F.lit(-1).alias("_peek"), F.col("v").alias("_v"), F.col("component_id").alias("_component"))
    together = together.unionByName(ahead)
    # A task's texts go through Arrow in one batch, so tasks stay small: a few ranges each.
    tasks = min(max(len(known) // TASK_RANGES, spark.sparkContext.defaultParallelism), MOST_TASKS)
    sorted_ = together.repartition(tasks, "_range").sortWithinPartitions("_range", "_peek", F.desc_nulls_last("doc_id"), F.desc("_v"))
    fields = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, component_id bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        groups: dict[int, dict[tuple, int]] = {}  # of the ranges that are not done
        for batch in batches:
            first = pc.equal(batch.column(3), -1)
            for range_number, id_, name, component in zip(*(batch.filter(first).column(at).to_pylist() for at in (2, 0, 4, 5)), strict=True):
                groups.setdefault(range_number, {})[id_, name] = component
            texts = batch.filter(pc.invert(first)) if pc.any(first).as_py() else batch
            for piece in _pieces(texts):
                joined = piece if held is None else pa.concat_tables([held, piece]).combine_chunks()
                held = joined.slice(joined.num_rows - 1)
                made = _neighbours(joined, groups)
                done = held.column("_range")[0].as_py()
                groups = {number: own for number, own in groups.items() if number >= done}
                if made is not None:
                    yield made

    return sorted_.mapInArrow(run, fields)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Cut a batch so that no piece holds much text, besides single long texts."""
    for block in text_blocks(batch.column(1)):
        yield pa.Table.from_batches([batch.slice(block.first, block.count)])


def _neighbours(rows: pa.Table, groups: dict[int, dict[tuple, int]]) -> pa.RecordBatch | None:
    """Return the results of all rows but the last, whose neighbour is not here yet."""
    texts = rows.column("text").to_pylist()
    peek = rows.column("_peek").to_numpy()
    mine = np.flatnonzero(peek[:-1] == 0)
    if not len(mine):
        return None
    ids, ranges, names = (rows.column(name).to_pylist() for name in ("doc_id", "_range", "_v"))
    edited = []
    for at in mine:
        text, half = texts[at], len(texts[at]) // 2
        edited.append((text[: len(text) - half] + texts[at + 1][:half]) if half else text)
    plain = signatures(rows.column("text").combine_chunks() if isinstance(rows.column("text"), pa.ChunkedArray) else rows.column("text"))
    other = signatures(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            rows.column("doc_id").combine_chunks().take(pa.array(mine)),
            pa.array([len(texts[at]) for at in mine], pa.int64()),
            pa.array([hashlib.sha256(text.encode()).hexdigest() for text in edited]),
            pa.array(_hex(plain[mine])),
            pa.array(_hex(other)),
            pa.array((plain[mine] == other).mean(axis=1)),
            pa.array((plain[mine] == plain[mine + 1]).mean(axis=1)),
            pa.array([groups.get(ranges[at], {}).get((ids[at], names[at]), ids[at]) for at in mine], pa.int64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"],
    )
