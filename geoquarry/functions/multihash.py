"""Multihash checksums: decoding as column text work, digests built in where Spark has them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquarry.functions.bindings import let, record

# Function codes of the multihash table and their names.
ALGORITHMS = {
    0x11: "sha1", 0x12: "sha256", 0x13: "sha512", 0x14: "sha3_512", 0x15: "sha3_384",
    0x16: "sha3_256", 0x17: "sha3_224", 0xB220: "blake2b",
}
# A byte with the high bit continues a number, one without it ends it.
_NUMBER = "((?:[89a-f][0-9a-f])*[0-7][0-9a-f])"
_SHAPE = f"^{_NUMBER}{_NUMBER}((?:[0-9a-f][0-9a-f])*)$"
CHUNK = 1024 * 1024


def _number(text: Column) -> Column:
    """Return the value of a variable-length number in hex, NULL beyond 9 bytes."""
    parts = F.regexp_extract_all(text, F.lit(".."), F.lit(0))
    low_bits = F.transform(parts, lambda part: F.conv(part, 16, 10).cast("bigint").bitwiseAND(F.lit(0x7F)))
    value = F.aggregate(
        F.reverse(low_bits), F.lit(0).cast("bigint"), lambda total, part: total * 128 + part
    )
    return F.when(F.length(text) <= 18, value)


def decode(checksum: Column) -> Column:
    """Return ``algorithm``, ``digest`` (hex) and ``error`` of a hex multihash.

    ``error`` names what keeps the checksum from being read, else NULL.
    """

    def pieces(text: Column) -> Column:
        return record(
            code=_number(F.regexp_extract(text, _SHAPE, 1)),
            length=_number(F.regexp_extract(text, _SHAPE, 2)),
            digest=F.regexp_extract(text, _SHAPE, 3),
            hexed=text.rlike("^(?:[0-9a-f][0-9a-f])*$"),
            shaped=text.rlike(_SHAPE),
        )

    names = F.create_map(*(F.lit(part) for pair in ALGORITHMS.items() for part in pair))

    def judged(found: Column) -> Column:
        name = F.element_at(names, found["code"].cast("int"))
        size = F.length(found["digest"]) / 2
        error = (
            F.when(~found["hexed"], "Not a hex string")
            .when(~found["shaped"] | found["code"].isNull() | found["length"].isNull(), "Truncated or oversized number")
            .when(size != found["length"], "The digest has another length than the multihash says")
            .when(name.isNull(), "Unsupported multihash function")
        )
        return record(
            algorithm=F.when(error.isNull(), name),
            digest=F.when(error.isNull(), found["digest"]),
            error=error,
        )

    text = F.lower(F.regexp_replace(checksum, r"\s+", ""))
    return F.when(checksum.isNotNull(), let(let(text, pieces), judged))


@F.arrow_udf(T.StringType())
def library_digest(content: pa.Array, algorithm: pa.Array, size: pa.Array) -> pa.Array:
    """Return hex digests that Spark has no function for; NULL content gives NULL."""
    out = []
    for data, name, length in zip(content, algorithm, size, strict=True):
        if not data.is_valid or not name.is_valid:
            out.append(None)
            continue
        out.append(hasher(name.as_py(), length.as_py(), data.as_buffer()).hexdigest())
    return pa.array(out, pa.string())


def hasher(name: str, size: int, data: bytes | pa.Buffer = b""):
    """Return a hash object for a function name and a digest size in bytes."""
    if name == "blake2b":
        return hashlib.blake2b(data, digest_size=size)
    return hashlib.new(name, data)


def content_matches(content: Column, decoded: Column) -> Column:
    """Return whether file content has the decoded digest; NULL for an unreadable checksum."""
    name, digest = decoded["algorithm"], decoded["digest"]
    rare = F.when(~name.isin("sha1", "sha256", "sha512"), content)
    other = library_digest(rare, name, (F.length(digest) / 2).cast("int"))
    actual = (
        F.when(name == "sha1", F.sha1(content))
        .when(name == "sha256", F.sha2(content, 256))
        .when(name == "sha512", F.sha2(content, 512))
        .otherwise(other)
    )
    return F.when(name.isNotNull(), actual == digest)


def verify_paths(files: DataFrame) -> DataFrame:
    """Hash stored files chunk by chunk: ``(path, checksum)`` in, ``(path, matches)`` out.

    A file of any size passes through one small buffer; ``matches`` is NULL
    for a checksum that cannot be read.
    """
    decoded = files.select("path", decode(F.col("checksum")).alias("d")).select("path", "d.algorithm", "d.digest")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from geoquarry.sources.object_store import open_input

        for batch in batches:
            verdicts = []
            for row in batch.to_pylist():
                if row["algorithm"] is None:
                    verdicts.append(None)
                    continue
                digest = hasher(row["algorithm"], len(row["digest"]) // 2)
                with open_input(row["path"]) as handle:
                    while chunk := handle.read(CHUNK):
                        digest.update(chunk)
                verdicts.append(digest.hexdigest() == row["digest"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(verdicts, pa.bool_())], names=["path", "matches"]
            )

    return decoded.mapInArrow(hashed, "path string, matches boolean")
