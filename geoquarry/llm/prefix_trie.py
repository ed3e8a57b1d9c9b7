"""The trie of rebuilt conversations: counts and savings of every shared prefix.

Turns are numbered from ranges of the sorted table, so that no task holds a
whole conversation. A prefix has a digest that is the sum of digests of its
turns, each of which knows its depth; sums run along runs of ``RUN`` turns.
Runs are dealt to shards. A shard enumerates the distinct prefix digests of
its runs, gives each a slot by a minimal perfect hash (``node_table``), puts
what the ends of runs have into flat arrays, and adds it up through the
parents' slots, the deepest first. What shards say about one node is added
up by an aggregate.

The sum over a subtree needs no walk from shard to shard: a node belongs to
its smallest member, the own nodes of a conversation are the end of its
path, and what a node has is entered by the run of its owner alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.llm.node_table import NodeTable, distinct_pairs, gather_up
from geoquarry.llm.text_arrays import mixed
from geoquarry.session import scratch_path

FAMILY = 5
BORROWED = 9
# Turns of a conversation that go to one shard together, and rows of a shard.
RUN = 4096
SHARD_ROWS = 100_000
# Ids that are joined into one text before they are hashed in order.
PIECE = 65_536
LANES = ["lane0", "lane1", "lane2", "lane3"]
_LOW = np.uint64(0xFFFFFFFF)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back: a lost executor repeats nothing before."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def borrowed_turns(conv: Column) -> Column:
    """Return how many turns a conversation takes from the head of its family."""
    return (F.crc32(conv.cast("string")) % BORROWED).cast("int")


def _numbered_turns(conversations: DataFrame) -> DataFrame:
    """Return ``conv, pos, one, two, size`` of every turn; ``pos`` counts from 1 in the order of turns.

    Sorted ranges number their rows apart from each other. Only the first
    conversation of a range can have begun before it, so one number a range
    completes them.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.octet_length(text).cast("bigint").alias("size"),
        digest.alias("digest"),
    ).select("conv", "turn", "size", F.xxhash64("digest").alias("one"), F.xxhash64(F.lit(1), "digest").alias("two"))
    # Equal rows are in any order; the random number only lets ranges part them.
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("one").asc(), F.col("two").asc(), F.rand(5).asc()]
    ranges = turns.repartitionByRange(*order).sortWithinPartitions(*order[:4])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            number = np.arange(len(conv)) - np.repeat(begins, np.diff(np.append(begins, len(conv)))) + 1
            if conv[0] == last:
                number[: begins[1] if len(begins) > 1 else len(conv)] += done
            last, done = conv[-1], number[-1]
            columns = [batch.column(name) for name in ("conv", "one", "two", "size")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(number), pa.array(np.full(len(conv), part, np.int32))],
                ["conv", "one", "two", "size", "number", "part"],
            )

    counted = ranges.mapInArrow(count, "conv bigint, one bigint, two bigint, size bigint, number bigint, part int")
    counted = _stored(counted, "turns")
    # One row a range.
    ends = counted.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "number")).alias("last")).orderBy("part").collect()
    shifts, open_, before = [], None, 0
    for row in ends:
        shift = before if row["first"] == open_ else 0
        if shift:
            shifts.append((row["part"], row["first"], shift))
        open_ = row["last"]["conv"]
        before = row["last"]["number"] + (shift if open_ == row["first"] else 0)
    known = conversations.sparkSession.createDataFrame(shifts, "part int, conv bigint, shift bigint")
    placed = counted.join(F.broadcast(known), ["part", "conv"], "left")  # at most one row a range
    return placed.select("conv", (F.col("number") + F.coalesce("shift", F.lit(0))).alias("pos"), "one", "two", "size")


def _run_of(depth: Column) -> Column:
    return F.floor(F.greatest(depth - 1, F.lit(0)) / RUN).cast("bigint")


def _rebuilt(turns: DataFrame, salt: int) -> DataFrame:
    """Return ``conv, depth, run, one, two, size, whole`` of every rebuilt turn, and a row of depth 0 for each conversation."""
    head = F.col("conv") - F.col("conv") % FAMILY
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("turns"))
    lengths = sizes.select(F.col("conv").alias("head"), F.least("turns", F.lit(BORROWED)).cast("int").alias("there"))
    own = F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    convs = (
        sizes.withColumn("head", head)
        .withColumn("h", borrowed_turns(F.col("conv")))
        .join(lengths, "head", "left")
        .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
        .select("conv", "head", "h", "taken", "turns", (F.col("taken") + own).alias("whole"))
    )
    # A conversation meets its turns run by run, so that a long one is many keys.
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), _run_of(F.col("turns"))))).drop("turns")
    mine = turns.withColumn("block", _run_of(F.col("pos"))).join(blocks, ["conv", "block"]).filter("pos > h")
    mine = mine.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "one", "two", "size", "whole")
    first = turns.filter(F.col("pos") < BORROWED).filter(F.col("conv") % FAMILY == 0)
    lent = first.withColumnRenamed("conv", "head").join(convs, "head").filter("pos <= taken")
    lent = lent.select("conv", F.col("pos").alias("depth"), "one", "two", "size", "whole")
    roots = convs.select(
        "conv", F.lit(0).cast("bigint").alias("depth"), *(F.lit(0).cast("bigint").alias(name) for name in ("one", "two", "size")), "whole"
    )
    at_depth = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(salt), "depth", name)).otherwise(F.lit(0).cast("bigint")).alias(name) for name in ("one", "two")]
    every = mine.unionByName(lent).unionByName(roots)
    return every.select("conv", "depth", _run_of(F.col("depth")).alias("run"), *at_depth, "size", F.col("whole").cast("bigint").alias("whole"))


def _lane(number: int) -> Column:
    word = F.col("one" if number < 2 else "two")
    return F.shiftrightunsigned(word, 32) if number % 2 == 0 else word.bitwiseAND(F.lit(0xFFFFFFFF))


def _with_sums_before(rows: DataFrame) -> DataFrame:
    """Add to each row the lane sums of its conversation's earlier runs; only long conversations have any."""
    long = rows.filter(F.col("depth") == RUN + 1).select("conv")
    totals = rows.join(long, "conv", "left_semi").groupBy("conv", "run").agg(*(F.sum(_lane(n)).alias(LANES[n]) for n in range(4)))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select("conv", "run", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in LANES))
    if long.isEmpty():
        return rows.select("*", *(F.lit(0).cast("bigint").alias(name) for name in LANES))
    joined = rows.join(sums, ["conv", "run"], "left")
    return joined.select(*rows.columns, *(F.coalesce(name, F.lit(0)).alias(name) for name in LANES))


class _Shard:
    """The local trie of the runs of one shard, as flat arrays over slots."""

    def __init__(self, rows: pa.Table) -> None:
        get = {name: rows.column(name).to_numpy() for name in rows.column_names}
        order = np.lexsort((get["depth"], get["run"], get["conv"]))
        self.rows = {name: values[order] for name, values in get.items()}
        conv, run, depth = (self.rows[name] for name in ("conv", "run", "depth"))
        count = len(conv)
        fresh = np.ones(count, bool)
        fresh[1:] = (conv[1:] != conv[:-1]) | (run[1:] != run[:-1])
        self.begins = np.flatnonzero(fresh)
        self.ends = np.append(self.begins[1:], count) - 1
        spans = self.ends - self.begins + 1
        words = [self.rows[name].view(np.uint64) for name in ("one", "two")]
        now, before = [], []
        for number, name in enumerate(LANES):
            word = words[number // 2]
            lane = (word >> np.uint64(32)) if number % 2 == 0 else (word & _LOW)
            sums = np.cumsum(lane) + self.rows[name].astype(np.uint64)
            sums -= np.repeat(np.cumsum(lane)[self.begins] - lane[self.begins], spans)
            now.append(sums & _LOW)
            before.append((sums - lane) & _LOW)
        self.first, self.second = self._digests(now, depth)
        self.above = self._digests(before, depth - 1)
        self.table = NodeTable(*distinct_pairs(self.first, self.second))
        self.slot = self.table.slots(self.first, self.second)
        size = len(self.table)
        # Any row of a node tells its depth, turn and parent; all must agree.
        self.at = np.zeros(size, np.int64)
        self.at[self.slot] = np.arange(count)
        told = self.at[self.slot]
        same = depth == depth[told]
        for values in (*words, *self.above):
            same &= values == values[told]
        self.clash = not bool(same.all())
        self.parents = np.full(size, -1, np.int64)
        inner = np.flatnonzero(~fresh)
        self.parents[self.slot[inner]] = self.slot[inner - 1]
        self.depths = depth[self.at]

    @staticmethod
    def _digests(lanes: list[np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return two 64-bit words a prefix; the root has zeros, what is above it ones."""
        at = depth.astype(np.uint64)
        made = []
        for high, low in ((0, 1), (2, 3)):
            word = mixed(((lanes[high] << np.uint64(32)) | lanes[low]) ^ mixed(at))
            made.append(np.where(depth > 0, word, np.where(depth == 0, np.uint64(0), ~np.uint64(0))))
        return made[0], made[1]

    def summed(self, values: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
        gather_up(values, self.parents, self.depths, how)
        return values


_COUNTS = (
    "key1 bigint, key2 bigint, depth bigint, up1 bigint, up2 bigint, one bigint, two bigint, size bigint, "
    "n bigint, least bigint, clash boolean, ended bigint"
)


def _counts(rows: pa.Table) -> pa.Table:
    """Return the nodes of a shard with their members here, and the ends of conversations."""
    shard = _Shard(rows)
    conv = shard.rows["conv"]
    last = shard.slot[shard.ends]
    n = np.zeros(len(shard.table), np.int64)
    np.add.at(n, last, 1)
    least = np.full(len(shard.table), np.iinfo(np.int64).max)
    np.minimum.at(least, last, conv[shard.ends])
    shard.summed(n)
    shard.summed(least, np.minimum)
    done = shard.ends[shard.rows["depth"][shard.ends] == shard.rows["whole"][shard.ends]]
    at = np.concatenate([shard.at, done])
    missing = np.zeros(len(at), bool)
    missing[: len(shard.at)] = True

    def signed(values: np.ndarray) -> np.ndarray:
        return values[at].view(np.int64)

    def padded(values: np.ndarray) -> np.ndarray:
        return np.concatenate([values, np.zeros(len(done), np.int64)])

    columns = [
        signed(shard.first), signed(shard.second), shard.rows["depth"][at], signed(shard.above[0]), signed(shard.above[1]),
        shard.rows["one"][at], shard.rows["two"][at], shard.rows["size"][at], padded(n), padded(least), np.full(len(at), shard.clash),
    ]
    names = [field.split()[0] for field in _COUNTS.split(", ")]
    return pa.table([*(pa.array(values) for values in columns), pa.array(conv[at], mask=missing)], names)


def _sums(rows: pa.Table) -> pa.Table:
    """Return what the runs of a shard add to the subtree of each node."""
    shard = _Shard(rows)
    out = [pa.array(shard.table.first.view(np.int64)), pa.array(shard.table.second.view(np.int64))]
    for own, tail in (("saves", "saves_on"), ("leaf", "leaf_on")):
        values = np.zeros(len(shard.table), np.int64)
        np.add.at(values, shard.slot, shard.rows[own])
        np.add.at(values, shard.slot[shard.ends], shard.rows[tail][shard.ends])
        out.append(pa.array(shard.summed(values)))
    return pa.table(out, ["key1", "key2", "saves", "leaf"])


def _by_shard(rows: DataFrame, shards: int, work, fields: str) -> DataFrame:
    head = F.col("conv") - F.col("conv") % FAMILY
    return rows.withColumn("shard", F.pmod(F.xxhash64(head, "run"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(
        lambda table: work(table.drop_columns("shard")), fields
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """Return ``key1, key2, ends_sha256`` of nodes where conversations end; ids are joined in pieces before one task hashes them in order."""
    order = ["key1", "key2", "conv"]
    ranges = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, conv = (batch.column(name).to_numpy() for name in order)
            change = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            begins = np.unique(np.concatenate([[0], change, np.arange(0, len(conv), PIECE)])).astype(np.int64) if len(conv) else change
            names = conv.astype(str)
            bodies = [",".join(names[start:stop]) for start, stop in zip(begins, np.append(begins[1:], len(conv)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[begins]), pa.array(two[begins]), pa.array(conv[begins]), pa.array(bodies, pa.string())], [*order, "body"]
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for one, two, body in zip(*(batch.column(name).to_pylist() for name in ("key1", "key2", "body")), strict=True):
                if (one, two) == key:
                    state.update(b"," + body.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (one, two), hashlib.sha256(body.encode())
            yield _digest_batch(done)
        if key is not None:
            yield _digest_batch([(*key, state.hexdigest())])

    pieces = ranges.mapInArrow(joined, "key1 bigint, key2 bigint, conv bigint, body string")
    grouped = pieces.repartition("key1", "key2").sortWithinPartitions(*order)
    return grouped.mapInArrow(hashed, "key1 bigint, key2 bigint, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    columns = [pa.array([row[at] for row in rows], kind) for at, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["key1", "key2", "ends_sha256"])


def _counted_nodes(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Return the rebuilt rows, the nodes, the ends and the number of shards, all stored."""
    turns = _numbered_turns(conversations)
    for salt in range(4):
        rows = _stored(_with_sums_before(_rebuilt(turns, salt)), "rebuilt")
        shards = rows.count() // SHARD_ROWS + 1
        partial = _stored(_by_shard(rows, shards, _counts, _COUNTS), "counts")
        told = ["depth", "up1", "up2", "one", "two"]
        nodes = partial.filter("ended IS NULL").groupBy("key1", "key2").agg(
            F.sum("n").alias("n_convs"),
            F.min("least").alias("conv_id"),
            F.max("size").alias("size"),
            F.max(F.col("clash").cast("int")).alias("clash"),
            *(F.min(name).alias(name) for name in told),
            *(F.max(name).alias("_" + name) for name in told),
        )
        differ = F.lit(False)
        for name in told:
            differ = differ | (F.col(name) != F.col("_" + name))
        nodes = _stored(nodes.select("key1", "key2", "depth", "up1", "up2", "n_convs", "conv_id", "size", (differ | (F.col("clash") > 0)).alias("clash")), "nodes")
        if nodes.filter("clash").isEmpty():
            ends = partial.filter("ended IS NOT NULL").select("key1", "key2", F.col("ended").alias("conv"))
            return rows, nodes.drop("clash"), ends, shards
    raise RuntimeError("digests of different prefixes were equal four times in a row")


def _with_family(nodes: DataFrame, shards: int) -> DataFrame:
    """Add ``n_children`` and ``parent_conv_id``; the many children of one parent ask for it in ``shards`` parts."""
    kids = nodes.filter("depth > 0").groupBy(F.col("up1").alias("key1"), F.col("up2").alias("key2")).agg(F.count("*").alias("n_children"))
    asked = nodes.withColumn("part", F.pmod(F.xxhash64("key1", "key2"), F.lit(shards)))
    owners = nodes.select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    answers = asked.filter("depth > 0").select("up1", "up2", "part").distinct().join(owners, ["up1", "up2"])
    known = asked.join(answers, ["up1", "up2", "part"], "left").join(kids, ["key1", "key2"], "left")
    return known.select(*nodes.columns, "parent_conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Rebuild every conversation and return one row per distinct prefix of the rebuilt ones.

    ``conversations`` has ``conv_id, turn, role, text``. A conversation's
    turns are ordered by ``turn``, null first; equal turns by a digest of
    role and text, and repeated rows are turns of their own. Null role and
    text are empty. Rows without a ``conv_id`` belong to no conversation and
    are left out. The head of a family is ``conv_id - conv_id % 5``, with the
    sign of the remainder as SQL has it. An empty table gives an empty one,
    without a root. Further columns are ignored.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; ``conv_id`` and ``depth`` name a node.
    """
    prepared(conversations)
    rows, nodes, ends, shards = _counted_nodes(conversations)
    nodes = _stored(_with_family(nodes, shards), "family")
    owned = nodes.select(
        F.col("conv_id").alias("conv"),
        "depth",
        ((F.col("n_convs") - 1) * F.col("size")).alias("saves"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
    )
    # What a conversation owns beyond a run is entered at the run's end.
    later = owned.filter(F.col("depth") > RUN).withColumn("run", _run_of(F.col("depth"))).groupBy("conv", "run").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    entered = rows.select("conv", "depth", "run", "one", "two", *LANES).join(owned, ["conv", "depth"], "left")
    if later.isEmpty():
        entered = entered.withColumn("saves_on", F.lit(0).cast("bigint")).withColumn("leaf_on", F.lit(0).cast("bigint"))
    else:
        runs = rows.filter(F.col("depth") > RUN).select("conv", "run").distinct()
        runs = runs.unionByName(runs.select("conv", F.lit(0).cast("bigint").alias("run")).distinct())
        after = Window.partitionBy("conv").orderBy("run").rowsBetween(1, Window.unboundedFollowing)
        tails = runs.join(later, ["conv", "run"], "left").select("conv", "run", F.sum("saves").over(after).alias("saves_on"), F.sum("leaf").over(after).alias("leaf_on"))
        entered = entered.join(tails, ["conv", "run"], "left")
    filled = [F.coalesce(name, F.lit(0)).alias(name) for name in ("saves", "leaf", "saves_on", "leaf_on")]
    entered = entered.select("conv", "depth", "run", "one", "two", *LANES, *filled)
    partial = _by_shard(entered, shards, _sums, "key1 bigint, key2 bigint, saves bigint, leaf bigint")
    sums = partial.groupBy("key1", "key2").agg(F.sum("saves").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    digests = _end_digests(ends)
    joined = nodes.join(sums, ["key1", "key2"]).join(digests, ["key1", "key2"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
