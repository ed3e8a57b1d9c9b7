"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding.

A block of texts is cut into words by character classes, equal words are
encoded once, and all distinct words are merged side by side: a round joins
the leftmost pair of lowest rank in every word that still has one.
"""

from __future__ import annotations

import base64
import heapq
import io
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from geoquarry.llm.common import prepared
from geoquarry.llm.text_arrays import Block, span_hashes, text_blocks

# Words of more bytes are merged one by one with a heap.
SIDE_BY_SIDE = 64
# Bytes of text encoded at once: about 60 bytes of work arrays for each of them.
ENCODED_BYTES = 1 << 19
NONE = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)
# The characters that count as white space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Return the class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kinds.get(unicodedata.category(chr(code))[0], OTHER) for code in range(0x110000)), np.uint8, 0x110000)
    classes[list(WHITE_SPACE)] = SPACE
    return classes


def word_starts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Return where the words of the tokenizer's pattern begin; words tile the texts.

    ``texts`` are the bounds of the texts in ``codes``. Runs of letters,
    numbers and other signs take one space before them; a run of white space
    is one word up to its last character, which stands alone unless it is
    the space that the next run takes or the text ends; ``'s 't 're 've 'm
    'll 'd`` are words of their own when the quote stands alone.
    """
    size = len(codes)
    if not size:
        return np.zeros(0, np.int64)
    kinds = character_classes()[codes]
    fresh = np.zeros(size + 1, bool)
    fresh[texts] = True
    fresh[-1] = True
    cut = fresh[:-1].copy()
    cut[1:] |= kinds[1:] != kinds[:-1]
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], size)
    kind = kinds[begin]
    mark = np.zeros(size + 1, bool)
    mark[begin] = True
    gap = np.flatnonzero((kind == SPACE) & ~fresh[end])
    last = end[gap] - 1
    mark[last] = True
    taken = codes[last] == 0x20
    mark[end[gap[taken]]] = False
    quote = (kind == OTHER) & (end - begin == 1) & (codes[begin] == 0x27)
    quote[1:] &= ~((kind[:-1] == SPACE) & (codes[begin[1:] - 1] == 0x20)) | fresh[begin[1:]]
    quote[:-1] &= (kind[1:] == LETTER) & ~fresh[begin[1:]]
    quote[-1] = False
    at = np.flatnonzero(quote)
    one, stop = codes[end[at]], end[at + 1]
    two = codes[np.minimum(end[at] + 1, size - 1)]
    pair = stop - end[at] >= 2
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = pair & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    for found, width in ((at[short], 1), (at[long & ~short], 2)):
        mark[end[found]] = False
        mark[end[found] + width] = True  # at the end of the run something begins there anyway
    return np.flatnonzero(mark[:-1])


class Vocabulary:
    """Ranks of byte strings, as arrays for lookups."""

    def __init__(self, ranks: bytes) -> None:
        lines = (line.split() for line in io.BytesIO(ranks) if line.strip())
        self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in lines}
        self.single = np.array([self.ranks[bytes([byte])] for byte in range(256)], np.int32)
        pieces = list(self.ranks)
        ends = np.cumsum([len(piece) for piece in pieces])
        keys = span_hashes(np.frombuffer(b"".join(pieces), np.uint8), ends - [len(piece) for piece in pieces], ends)
        order = np.argsort(keys)
        self.whole = keys[order], np.array([self.ranks[piece] for piece in pieces], np.int32)[order]
        # Flat numbers, not objects; pieces differ, so each pair is met once.
        pairs, joined = array("q"), array("i")
        for piece, rank in self.ranks.items():
            for at in range(1, len(piece)):
                left, right = self.ranks.get(piece[:at]), self.ranks.get(piece[at:])
                if left is not None and right is not None:
                    pairs.append(left << 20 | right)
                    joined.append(rank)
        self._place(np.array(pairs, np.int64), np.array(joined, np.int32))

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Lay the pairs out in an open table with few probes."""
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots = self._slots(keys)
        self.probes = 0
        left = np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.keys[slots[left]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Return the rank of each joined pair, or ``NONE``."""
        keys = left.astype(np.int64) << 20 | right
        slots = self._slots(keys)
        found = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found == NONE) & (self.keys[slots] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            same = self.keys[slots[open_]] == keys[open_]
            found[open_[same]] = self.values[slots[open_[same]]]
            open_ = open_[~same & (self.keys[slots[open_]] >= 0)]
        return found

    def merge_one(self, word: bytes) -> list[int]:
        """Merge one word with a heap of pairs; for words of any length."""
        ids = [int(self.single[byte]) for byte in word]
        pieces: list[bytes | None] = [bytes([byte]) for byte in word]
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = [
            (self.ranks[word[at : at + 2]], at, 1, 1) for at in range(len(ids) - 1) if word[at : at + 2] in self.ranks
        ]
        heapq.heapify(heap)
        while heap:
            rank, at, mine, its = heapq.heappop(heap)
            other = after[at] if pieces[at] is not None else -1
            if other < 0 or len(pieces[at]) != mine or len(pieces[other]) != its:
                continue
            pieces[at], pieces[other] = pieces[at] + pieces[other], None
            ids[at], after[at] = rank, after[other]
            if after[at] >= 0:
                before[after[at]] = at
            for start in (before[at], at):
                if start >= 0 and after[start] >= 0:
                    joined = self.ranks.get(pieces[start] + pieces[after[start]])
                    if joined is not None:
                        heapq.heappush(heap, (joined, start, len(pieces[start]), len(pieces[after[start]])))
        return [token for token, piece in zip(ids, pieces, strict=True) if piece is not None]

    def fold(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode words given by their bytes; return all ids and the bounds of each word's."""
        count = len(starts)
        lengths = ends - starts
        results = np.empty(int(lengths.sum()), np.int32)  # each word has room for its bytes
        room = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.zeros(count, np.int64)
        keys, ranks = self.whole
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = keys[at] == hashes
        results[room[:-1][known]] = ranks[at[known]]
        sizes[known] = 1
        for word in np.flatnonzero(~known & (lengths > SIDE_BY_SIDE)):
            ids = self.merge_one(data[starts[word] : ends[word]].tobytes())
            results[room[word] : room[word] + len(ids)] = ids
            sizes[word] = len(ids)
        words = np.flatnonzero(~known & (lengths <= SIDE_BY_SIDE))
        flat = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(lengths[words])[:-1]]), lengths[words])
        tokens = self.single[data[flat + np.arange(len(flat))]]
        held = lengths[words]
        rank = self._ranks_inside(tokens, held)
        while len(words):
            begin = np.cumsum(held) - held
            least = np.minimum.reduceat(rank, begin)
            done = least == NONE
            if done.any():
                into = np.repeat(room[words[done]] - np.cumsum(held[done]) + held[done], held[done])
                ended = np.repeat(done, held)
                results[into + np.arange(len(into))] = tokens[ended]
                sizes[words[done]] = held[done]
                words, held, least = words[~done], held[~done], least[~done]
                tokens, rank = tokens[~ended], rank[~ended]
                if not len(words):
                    break
                begin = np.cumsum(held) - held
            lowest = np.flatnonzero(rank == np.repeat(least, held))
            owner = np.searchsorted(begin, lowest, "right") - 1
            first = np.ones(len(lowest), bool)
            first[1:] = owner[1:] != owner[:-1]
            spot = lowest[first]
            tokens[spot] = least
            keep = np.ones(len(tokens), bool)
            keep[spot + 1] = False
            tokens, rank = tokens[keep], rank[keep]
            held = held - 1
            spot = spot - np.arange(len(spot))
            begin = np.cumsum(held) - held
            finish = begin + held - 1
            rank[spot] = NONE
            inner = spot < finish
            rank[spot[inner]] = self.pair_ranks(tokens[spot[inner]], tokens[spot[inner] + 1])
            led = spot > begin
            rank[spot[led] - 1] = self.pair_ranks(tokens[spot[led] - 1], tokens[spot[led]])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(room[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return results[take], bounds

    def _ranks_inside(self, tokens: np.ndarray, held: np.ndarray) -> np.ndarray:
        rank = np.full(len(tokens), NONE, np.int32)
        if len(tokens) > 1:
            rank[:-1] = self.pair_ranks(tokens[:-1], tokens[1:])
            rank[np.cumsum(held) - 1] = NONE
        return rank

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Return the ids of all texts of a block and the bounds of each text's."""
        data = block.data
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        texts = np.searchsorted(places, block.offsets)
        begins = word_starts(codes, texts)
        starts = places[begins]
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(block.count + 1, np.int64)
        _, first, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        order = np.argsort(first)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        first = first[order]
        ids, bounds = self.fold(data, starts[first], ends[first])
        word = number[word]
        sizes = np.diff(bounds)[word]
        total = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(bounds[word] - total[:-1], sizes) + np.arange(total[-1])
        return ids[take], total[np.searchsorted(starts, block.offsets)]


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes) -> Vocabulary:
    """Return the vocabulary of a rank file's bytes, built once per worker."""
    return Vocabulary(ranks)


def encode(docs: DataFrame, ranks_path: str, *, keep: tuple[str, ...] = ("doc_id",), alias: str = "token_ids") -> DataFrame:
    """Return the columns ``keep`` and the token ids of each whole text as an array column.

    No special tokens are used. Null and empty texts have no ids; equal
    texts have equal ids; repeated rows stay; an empty table gives an empty
    one. The rank file is read by the driver and goes along once per
    executor; its size does not depend on the data.
    """
    spark = prepared(docs)
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    kept = [docs.schema[name] for name in keep]
    schema = StructType([*kept, StructField(alias, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared.value)
        for batch in batches:
            for block in text_blocks(batch.column(len(kept)), ENCODED_BYTES):
                ids, bounds = words.encode(block)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                rows = batch.slice(block.first, block.count)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], lists], [*keep, alias])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def decoded(ids: Column, ranks_path: str) -> Column:
    """Return the bytes of token ids: the binary pieces of a literal vocabulary, concatenated.

    A null array gives null, an unknown id gives null, no ids give no bytes.
    """
    with open(ranks_path, "rb") as file:
        lines = [line.split() for line in file.read().splitlines() if line.strip()]
    pieces: list[str] = [""] * (max(int(rank) for _, rank in lines) + 1)
    for piece, rank in lines:
        pieces[int(rank)] = base64.b64decode(piece).decode("latin-1")  # one character per byte
    listed = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.array_join(F.transform(ids, lambda token: F.element_at(listed, token + 1)), "")
    return F.encode(joined, "ISO-8859-1")


def bpe_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Return ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = F.col("token_ids")
    numbers = F.array_join(F.transform(ids, lambda token: token.cast("string")), " ")
    return encode(docs, path).select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2(decoded(ids, path), 256).alias("decoded_sha256"),
    )
