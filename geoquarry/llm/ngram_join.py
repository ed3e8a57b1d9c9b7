"""N-gram Jaccard join: a grouped prefix join of word shingle sets, and its connected components.

Equal sets collapse first, then sets of equal size and equal prefix collapse
into groups. Groups that share a prefix element are candidates; they are
filtered, expanded to their members and verified on the whole texts. Sets
are ordered by a sketch of shingle frequencies over all documents, rare ones
first, so that common passages stay out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import prepared
from geoquarry.llm.components import components
from geoquarry.llm.sketches import bitmap, frequency_levels, frequency_slots, marked
from geoquarry.llm.text_arrays import Block, mixed, shingle_hashes, text_blocks

PARITY_LONGS = 8


@dataclass(frozen=True)
class Likeness:
    """Sets of ``words`` lower-cased words in a row link when ``100 * common >= percent * union``."""

    words: int = 5
    percent: int = 80

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Return how many first elements of a set must meet those of any set it links with."""
        return size - (self.percent * size + 99) // 100 + 1

    def sizes_fit(self, left: str, right: str) -> Column:
        """Return whether two set sizes allow a link."""
        low, high = F.least(left, right), F.greatest(left, right)
        return low * 100 >= high * self.percent

    def places_fit(self, size: str, place: str, other: str, its: str) -> Column:
        """Return whether two sets whose first common element stands at these places can link.

        No element before both places is common, so the rest of either set
        bounds what they share.
        """
        most = F.least(F.col(size) - F.col(place), F.col(other) - F.col(its))
        return most * 100 >= (F.col(size) + F.col(other) - most) * self.percent

    def far(self, difference: Column, left: str, right: str) -> Column:
        """Return whether a lower bound of the symmetric difference rules a link out."""
        return difference * (100 + self.percent) > (F.col(left) + F.col(right)) * (100 - self.percent)


def shingle_sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the distinct shingle hashes of each text, and the text each belongs to, sorted by both."""
    block.find_words()
    hashes, bounds = shingle_hashes(block.hashes(low=True), block.bounds, words)
    owner = np.repeat(np.arange(block.count), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], owner[fresh]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def described(texts: DataFrame, like: Likeness, levels: np.ndarray) -> DataFrame:
    """Return ``doc_id, digest, n, v, p, prefix, parity`` of every document.

    ``v`` names the set and ``p`` its prefix; ``parity`` has one bit per
    slot that an odd number of elements falls into, which bounds the
    symmetric difference of two sets from below.
    """
    shared = texts.sparkSession.sparkContext.broadcast(levels.tobytes())  # 2 MB, fixed
    bits = 64 * PARITY_LONGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for block in text_blocks(batch.column(2)):
                hashes, owner = shingle_sets(block, like.words)
                order = np.lexsort((hashes, level[frequency_slots(hashes)], owner))
                hashes, owner = hashes[order], owner[order]
                size = np.bincount(owner, minlength=block.count)
                begin = np.cumsum(size) - size
                names = np.zeros(block.count, np.uint64)
                np.add.at(names, owner, mixed(hashes))
                names = mixed(names + size.astype(np.uint64))
                take = np.where(size > 0, like.prefix(size), 0)
                within = np.arange(len(hashes)) - begin[owner]
                first = within < take[owner]
                heads = np.zeros(block.count, np.uint64)
                np.add.at(heads, owner[first], mixed(hashes[first] + within[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                flat = owner * bits + (hashes & np.uint64(bits - 1)).astype(np.int64)
                odd = (np.bincount(flat, minlength=block.count * bits) & 1).astype(np.uint8)
                parity = np.packbits(odd.reshape(block.count, bits), axis=1, bitorder="little").view(np.int64)
                rows = batch.slice(block.first, block.count)
                bounds = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), pa.array(size.astype(np.int64)), _long(names), _long(mixed(heads)),
                        pa.ListArray.from_arrays(pa.array(bounds), _long(hashes[first])),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(block.count + 1, dtype=np.int32) * PARITY_LONGS), pa.array(parity.reshape(-1))
                        ),
                    ],
                    ["doc_id", "digest", "n", "v", "p", "prefix", "parity"],
                )

    fields = "doc_id bigint, digest bigint, n bigint, v bigint, p bigint, prefix array<bigint>, parity array<bigint>"
    return texts.select("doc_id", "digest", "text").mapInArrow(run, fields)


def _texts_of(texts: DataFrame, names: DataFrame, like: Likeness) -> DataFrame:
    """Return ``v, text`` of the named sets, one text each.

    Tasks name the set of each text anew and drop most of the others by the
    bitmap before anything is shuffled.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(names.select("v")).tobytes())  # 8 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_ = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                hashes, owner = shingle_sets(block, like.words)
                size = np.bincount(owner, minlength=block.count)
                names_ = np.zeros(block.count, np.uint64)
                np.add.at(names_, owner, mixed(hashes))
                names_ = mixed(names_ + size.astype(np.uint64))
                at = np.flatnonzero(marked(map_, names_) & (size > 0))
                if len(at):
                    rows = batch.slice(block.first, block.count).column(0).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([_long(names_[at]), rows], ["v", "text"])

    found = texts.select("text").mapInArrow(run, "v bigint, text string")
    return found.join(names.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Return the pairs ``a, b`` of sets whose whole texts really link."""
    named = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    whole = _texts_of(texts, named.checkpoint(), like).checkpoint()
    both = pairs.join(whole.select(F.col("v").alias("a"), F.col("text").alias("left")), "a").join(
        whole.select(F.col("v").alias("b"), F.col("text").alias("right")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                sets = []
                for column in (2, 3):
                    own: list[np.ndarray] = []
                    for block in text_blocks(rows.column(column)):
                        hashes, owner = shingle_sets(block, like.words)
                        own += np.split(hashes, np.searchsorted(owner, np.arange(1, block.count)))
                    sets.append(own)
                for row, (left, right) in enumerate(zip(*sets, strict=True)):
                    common = len(np.intersect1d(left, right, assume_unique=True))
                    good[at + row] = 100 * common >= like.percent * (len(left) + len(right) - common)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["a", "b"])

    return both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def linked_sets(texts: DataFrame, base: DataFrame, like: Likeness) -> DataFrame:
    """Return ``v, component`` of all sets that link with another one.

    First every group is checked against one group of each of its prefix
    elements, the one in which the element stands foremost: it has the fewest
    rare elements of its own and so is closest to what the others copy. That
    joins copies without pairing them with each other. What remains are pairs
    across components; only members outside the component of an element's
    foremost group are paired with the element's other members, where sizes
    and places allow a link. The first common element of a true link passes
    the test of places, so none is lost.
    """
    sets = base.filter("n > 0").groupBy("v").agg(
        F.first("n").alias("n"), F.first("p").alias("p"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")
    ).checkpoint()
    groups = sets.groupBy("n", "p").agg(F.min("v").alias("g"), F.first("prefix").alias("prefix"))
    members = sets.select("n", "p", "v").join(groups.select("n", "p", "g"), ["n", "p"]).select("g", "v", "n").checkpoint()
    tokens = groups.select("g", "n", F.posexplode("prefix").alias("place", "token"))
    ends = tokens.groupBy("token").agg(
        F.min_by("g", "place").alias("low"), F.min("place").alias("its"), F.count("*").alias("held")
    ).filter("held > 1")
    shared = tokens.join(ends.drop("held"), "token").checkpoint()
    sizes = members.filter("g = v").select(F.col("g").alias("low"), F.col("n").alias("m"))
    near = shared.filter("g <> low").groupBy("g", "n", "low").agg(F.min("place").alias("place"), F.min("its").alias("its"))
    near = near.join(sizes, "low").filter(like.sizes_fit("n", "m") & like.places_fit("n", "place", "m", "its")).select("g", F.col("low").alias("other"))
    stars = near.join(members.select("g", "v"), "g").select(F.col("v").alias("a"), F.col("other").alias("b"))
    inside = members.filter("g <> v").select(F.col("v").alias("a"), F.col("g").alias("b"))
    first = _ordered(stars.unionByName(inside)).distinct()
    parities = sets.select("v", "n", "parity")
    first = _possible(first, parities, like).checkpoint()
    links = verified(first, texts, like).checkpoint()
    found = components(links).checkpoint()
    # Members of each shared element, with their components.
    spread = shared.select("token", "g", "place", "low").join(members, "g")
    spread = spread.join(found, "v", "left").select("token", "v", "n", "place", "low", F.coalesce("component", "v").alias("component"))
    lead = found.select(F.col("v").alias("low"), F.col("component").alias("lead"))
    spread = spread.join(lead, "low", "left").withColumn("lead", F.coalesce("lead", "low"))
    spread = spread.select("token", "v", "n", "place", "component", "lead").checkpoint()
    outside = spread.filter("component <> lead").select(
        "token", F.col("v").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("component").alias("ca")
    )
    across = (
        outside.join(spread, "token")
        .filter(F.col("component") != F.col("ca"))
        .filter(like.sizes_fit("na", "n") & like.places_fit("na", "pa", "n", "place"))
        .select("a", F.col("v").alias("b"))
    )
    # Different sets of one group are candidates of each other, too.
    crowd = members.groupBy("g").agg(F.count("*").alias("held")).filter("held > 1").select("g")
    crowd = members.join(crowd, "g").join(found, "v", "left").select("g", "v", F.coalesce("component", "v").alias("component"))
    mates = crowd.select("g", F.col("v").alias("a"), F.col("component").alias("ca")).join(crowd, "g").filter("ca < component")
    across = across.unionByName(mates.select("a", F.col("v").alias("b")))
    rest = _ordered(across).distinct().join(first, ["a", "b"], "left_anti")
    rest = _possible(rest, parities, like).checkpoint()
    more = verified(rest, texts, like)
    joined = found.filter("v <> component").select(F.col("v").alias("a"), F.col("component").alias("b"))
    return components(joined.unionByName(more))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _possible(pairs: DataFrame, parities: DataFrame, like: Likeness) -> DataFrame:
    """Drop pairs whose sizes or parities rule a link out; no true link is lost."""
    left = parities.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    right = parities.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").filter(like.sizes_fit("na", "nb"))
    apart = sum((F.bit_count(F.get("pa", F.lit(at)).bitwiseXOR(F.get("pb", F.lit(at)))) for at in range(PARITY_LONGS)), F.lit(0))
    return both.filter(~like.far(apart, "na", "nb")).select("a", "b")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def _classes(docs: DataFrame, like: Likeness) -> DataFrame:
    """Return ``doc_id, digest, n, v, component, component_id``, one row per row of the documents."""
    prepared(docs)
    texts = _texts(docs)
    base = described(texts, like, frequency_levels(texts, lambda block: shingle_sets(block, like.words)[0])).checkpoint()
    found = linked_sets(texts, base, like).checkpoint()
    rows = base.select("doc_id", "digest", "n", "v").join(found, "v", "left")
    # Documents without words stay alone: they are linked with nothing.
    rows = rows.withColumn("component", F.coalesce("component", "v"))
    least = rows.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "component", "left").select(
        "doc_id", "digest", "n", "v", "component", F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def jaccard_components(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Return ``doc_id, n_shingles, component_id`` per document.

    A text's set has its distinct shingles; with fewer words the whole
    sequence is one shingle; null texts and texts without words have an empty
    set and link with nothing. ``component_id`` is the smallest ``doc_id``
    that links reach, the document itself included; a null id is larger than
    all others. Repeated rows stay rows. An empty table gives an empty one.
    """
    return _classes(docs, like).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Keep one document of each component, with all columns: the smallest id, then the smallest digest of the text.

    A null id is larger than all others. Of rows equal in id and text one
    stays. Documents without words are no copies of anything and all stay.
    """
    classes = _classes(docs, like).checkpoint()
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    leads = classes.filter("n > 0").groupBy("component").agg(F.min(order).alias("lead"), F.max("n").alias("n"))
    leads = leads.select(F.col("lead.doc_id").alias("_id"), F.col("lead.digest").alias("_its"), F.lit(False).alias("_all"))
    wordless = classes.filter("n = 0").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_its"), F.lit(True).alias("_all")).distinct()
    repeats = classes.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_its")).agg(F.count("*").alias("_rows")).filter("_rows > 1")
    twice = repeats.select(F.col("_id").alias("_rid"), F.col("_its").alias("_rits"), "_rows")
    kept = leads.unionByName(wordless).join(twice, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_its") == F.col("_rits")), "left")
    kept = kept.select("_id", "_its", (F.col("_all") | F.col("_rows").isNull()).alias("_plain")).checkpoint()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(docs[name] for name in docs.columns)).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64(text).alias("_digest")
    )
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_its"))
    joined = rows.join(kept, same)
    # Equal rows are combined in their tasks before one of them is taken.
    once = joined.filter("NOT _plain").groupBy("_doc", "_digest").agg(F.first("_row").alias("_row"))
    return joined.filter("_plain").select("_row").unionByName(once.select("_row")).select("_row.*")
