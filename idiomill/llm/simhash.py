"""SimHash near-duplicate detection: pigeonhole blocks, verified Hamming distance.

A 64-bit fingerprint is cut into ``distance + 2`` blocks. Two fingerprints that differ
in at most ``distance`` bits agree on at least two whole blocks, so every pair of blocks
is a join key (32 bits of key for the default distance of 2). Distinct fingerprints are
joined on those keys and verified by Hamming distance.

A key shared by many different fingerprints (a large group of near copies) is not paired
quadratically. For a distance of 2 its members are linked through fingerprints one bit
away: two of them differ in at most two bits exactly if they share such a neighbour. The
work is 65 rows for each member and no link is lost.

Defined results: null and empty texts, and texts without a word, have fingerprint zero
and are linked like any other; repeated rows are returned as often as they come; a null
doc_id keeps its row and never becomes a component id; columns other than doc_id and
the text are ignored; doc_id is cast to long, and one that cannot be cast is an error;
an empty table gives an empty result. Components settle in a number of rounds that grows
with the logarithm of their diameter; ``graph.components`` raises an error after 60.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, mix64
from .graph import components

DISTANCE = 2
SHINGLE = 3
SEED = 42
PAIRED_GROUP = 48
"""Key groups up to this many distinct fingerprints are paired; larger ones are linked through neighbours."""


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        hashes = [digest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def wide(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The SimHash fingerprint of 64 * lanes bits of a set of hashes, as that many unsigned integers.

    As in fingerprint() a bit is 1 if set in over half the hashes; each lane takes hashes of its own.
    """
    factors = mix64((np.arange(1, lanes + 1, dtype=np.uint64) << U64(32)) * GOLDEN) | U64(1)
    votes = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        part = mix64(hashes[at : at + 255, None] * factors)
        votes += np.add.reduce(np.unpackbits(part.reshape(-1).view(np.uint8), bitorder="little").reshape(len(part), -1), axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")


def _fingerprints(batches):
    for batch in batches:
        ids = batch.column(0)
        out = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(out)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) for every row; one pass, no shuffle."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(distance: int):
    """A column of the block-pair keys of fp, each tagged with its pair."""
    cuts = np.linspace(0, 64, distance + 3).astype(int)
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))

    def part(span):
        a, b = map(int, span)
        return F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << (b - a)) - 1))

    return F.array(
        *(
            F.struct(F.lit(k).alias("pair"), part(x).alias("p"), part(y).alias("q"))
            for k, (x, y) in enumerate(combinations(spans, 2))
        )
    )


def links(distinct: DataFrame, scratch: Scratch, distance: int = DISTANCE, paired: int = PAIRED_GROUP) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that join every pair within ``distance``.

    Small key groups give the verified pairs themselves. Large groups give, for each
    shared one-bit neighbour, edges to its smallest member; these have the same
    components as all verified pairs (every edge is between fingerprints that share a
    neighbour and so is itself a verified pair).
    """
    if distance != 2:
        raise ValueError("large key groups are linked through one-bit neighbours, which is exact for a distance of 2")
    keyed = distinct.select("fp", F.explode(_keys(distance)).alias("key")).select("fp", "key.*")
    sizes = scratch.keep(keyed.groupBy("pair", "p", "q").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    few, many = sizes.where(F.col("n") <= paired), sizes.where(F.col("n") > paired)
    member = keyed.join(few.select("pair", "p", "q"), ["pair", "p", "q"])
    other = member.withColumnRenamed("fp", "fp2")
    near = (
        member.join(other, ["pair", "p", "q"])
        .where((F.col("fp") > F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance))
        .select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    )
    crowd = keyed.join(many.select("pair", "p", "q"), ["pair", "p", "q"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in range(64)))
    around = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    heads = around.groupBy("hub").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    starred = around.join(heads, "hub").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    return near.unionByName(starred)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, text, key), "fp")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    root = components(links(distinct, scratch, distance), scratch)
    owned = distinct.join(root.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    names = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = scratch.keep(owned.join(names, "root").select("fp", "component_id"), "labels")
    return rows.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
