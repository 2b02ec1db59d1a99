"""Near copies by SimHash blocks and exact Jaccard similarity of word shingles.

A text is the set of its runs of SHINGLE words. Two texts are near copies if the Jaccard
similarity of their sets is SIMILARITY or more; groups are the connected components of
that relation.

The first step is SimHash: a fingerprint of 64 * LANES bits of each set. BLOCKS blocks of
it are keys, of two bits more than the number of texts has (so that unlike texts rarely
share one), and CHECK further words tell how far two fingerprints are apart. Texts that
share a block and differ in at most FAR of those bits are candidates. Every candidate is
verified on the whole sets, so dissimilar texts are never linked.

At a similarity of 0.8 two fingerprints differ in 15 % of their bits, so some pairs near
that limit share no block. An exact step for this rest follows: BANDS keys, each of ROWS
minima of the set under hashes of its own, of which two texts of similarity 0.8 share none
with a probability of (1 - 0.8^4)^24 = 3 * 10^-6, more similar ones more rarely. It starts
from the groups that SimHash found and compares only texts of different groups.

A key is not paired quadratically: all its members are first compared with its head, the
member that shares most keys. What that leaves in different components is then compared
pair by pair, save pairs that a bound excludes: their sizes, their distances from the head
where known (Jaccard distance is a metric), or the Hamming distance of their parity
bitmaps, which is never above the size of the symmetric difference of the sets. So every
pair that shares a band is compared, excluded by a bound that cannot err, or already linked.

Defined results: a text of fewer than SHINGLE words is one shingle; null, empty and
wordless texts are equal to each other; of a group the document with the smallest doc_id
stays, null ids come last and rows that share an id are ordered by a hash of their text;
of rows with equal id and text one stays; texts with equal 64-bit digests of their sets
count as equal. doc_id is cast to long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, mix64
from .graph import components
from .simhash import wide

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
STRETCH = 4096
LANES = 16
BLOCKS, BLOCK_BITS, LEAST_BITS, SPARE_BITS = 32, 28, 8, 2
CHECK, FAR = 2, 44
"""Of 128 bits two texts of similarity 0.8 differ in 19.4 with a standard deviation of 4.1, unlike ones in about 64."""
MAX_BITMAP = 64
"""Longs of a parity bitmap at most; it has two to four bits for each shingle up to that."""

_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * GOLDEN) | U64(1)


def shingles(data: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of a UTF-8 text."""
    words = (data or b"").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix64(out * GOLDEN + h[k : k + n])
    return np.unique(out)


def digest(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(s.tobytes(), 7), np.uint64).view(np.int64))


def bands(s: np.ndarray) -> np.ndarray:
    """The band keys of a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), STRETCH):
        low = np.minimum(low, (s[None, at : at + STRETCH] * _FACTORS[:, None]).min(axis=1))
    low = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * GOLDEN + low[:, r])
    return key.view(np.int64)


def blocks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash blocks of a set, and the words of its fingerprint that are in none."""
    f = wide(s, LANES)
    bits = np.unpackbits(f[CHECK:].view(np.uint8), bitorder="little").reshape(BLOCKS, BLOCK_BITS)
    return bits @ (1 << np.arange(BLOCK_BITS, dtype=np.int64)), f[:CHECK].view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """For each bit, the parity of the number of hashes that name it. The upper half folds onto the lower by XOR."""
    longs = 1
    while longs < MAX_BITMAP and longs * 32 < len(s):
        longs *= 2
    odd = np.bincount((s & U64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signed(size):
    def run(batches):
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(2).to_pylist()]
            marks = [blocks(s) for s in sets]
            cols = [
                *batch.columns[:2],
                pa.array([digest(s) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bitmap(s) for s in sets], pa.list_(pa.int64())),
                pa.array([m[0].astype(np.int32) for m in marks], pa.list_(pa.int32())),
                pa.array([m[1] for m in marks], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t", "node", "keys", "n", "bits", "blocks", "check"])

    return run


def _sets(size):
    def run(batches):
        for batch in batches:
            data = batch.column(0).to_pylist()
            for at in range(0, len(data), 500):
                sets = [shingles(t, size) for t in data[at : at + 500]]
                cols = [pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "items"])

    return run


def _differing(a, b):
    """Bits in which two bitmaps differ, the longer one folded to the length of the shorter."""

    def folded(x, y):
        half = F.size(y)
        low, high = F.slice(x, 1, half), F.slice(x, half + 1, half)
        return F.when(F.size(x) > half, F.zip_with(low, high, lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    bits = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def _same(a, b):
    return a["doc_id"].eqNullSafe(b["rep_id"]) & (a["t"] == b["rep_t"])


def _verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, scratch: Scratch, size: int, name: str) -> DataFrame:
    """pairs (u, v) with their Jaccard similarity j; the sets of only these nodes are made again from the texts."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = nodes.join(reps, "node").select("rep_id", "rep_t").distinct().hint("merge")
    texts = rows.join(wanted, _same(rows, wanted), "left_semi").select("data")
    sets = texts.mapInArrow(_sets(size), "node long, items array<long>").join(nodes.hint("merge"), "node", "left_semi")
    sets = scratch.keep(sets.groupBy("node").agg(F.first("items").alias("items")), f"{name}-sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}s")).hint("merge") for x in "uv")
    both = F.size(F.array_intersect("us", "vs"))
    met = pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("both"), (F.size("us") + F.size("vs")).alias("total"))
    out = scratch.keep(met.select("u", "v", (F.col("both") / (F.col("total") - F.col("both"))).alias("j")), name)
    scratch.drop(sets)
    return out


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("t"), body.cast("binary").alias("data"))


def _members(keyed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """keyed without rows whose key no other node has, and with the head of each key."""
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), f"{name}-shared")
    crowd = scratch.keep(keyed.join(shared, "key"), f"{name}-crowd")
    # the member whose keys have the most members is the nearest to all others
    heads = crowd.join(crowd.groupBy("node").agg(F.sum("k").alias("rank")), "node").groupBy("key").agg(F.max(F.struct("rank", "node")).alias("h"))
    heads = scratch.keep(heads.select("key", F.col("h.node").alias("head")), f"{name}-heads")
    scratch.drop(keyed, shared)
    return crowd.drop("k").join(heads, "key")


def _told(member: DataFrame, star: DataFrame) -> DataFrame:
    """member with the Jaccard distance of each node from its head, null where the two were not compared."""
    return member.join(star.select(F.col("u").alias("node"), F.col("v").alias("head"), (1 - F.col("j")).alias("far")), ["node", "head"], "left")


def _alike(n, n2, least):
    return F.least(n, n2) >= least * F.greatest(n, n2)


def _more(root: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    return components(root.select("u", F.col("root").alias("v")).unionByName(links), scratch)


def _settled(root: DataFrame, told: DataFrame, apart, one: DataFrame, rows: DataFrame, reps: DataFrame, scratch: Scratch, size: int, least: float, name: str) -> DataFrame:
    """(u, root): root and the links between members of a key that its head leaves in different components."""
    told = scratch.keep(told.join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")), f"{name}-told")
    parted = told.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    left = scratch.keep(told.join(parted, "key", "left_semi"), f"{name}-left")
    scratch.drop(told)
    known = left.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    maps = one.join(known.select("node").hint("merge"), "node", "left_semi").select("node", "bits")
    left = scratch.keep(left.join(known, "node").join(maps, "node"), f"{name}-bits")
    right = left.select(*(F.col(c).alias(f"{c}2") for c in left.columns))
    sizes = _alike(F.col("n"), F.col("n2"), least) & F.coalesce(F.abs(F.col("far") - F.col("far2")) <= 1 - least, F.lit(True))
    # Of a pair that shares several keys, the least one compares it.
    here = F.element_at(F.array_intersect("keys", "keys2"), 1) == F.col("key")
    close = _differing(F.col("bits"), F.col("bits2")) <= (F.col("n") + F.col("n2")) * ((1 - least) / (1 + least))
    rest = left.join(right.hint("merge"), (F.col("key") == F.col("key2")) & (F.col("root") < F.col("root2")) & sizes & apart & here & close)
    rest = scratch.keep(rest.select(F.col("node").alias("u"), F.col("node2").alias("v")), name)
    if not rest.isEmpty():
        root = _more(root, _verified(rest, rows, reps, scratch, size, f"{name}-compared").where(F.col("j") >= least).select("u", "v"), scratch)
    return root


def _by_simhash(one: DataFrame, rows: DataFrame, reps: DataFrame, scratch: Scratch, size: int, least: float) -> DataFrame:
    """(u, root): the components of the verified links between nodes that share a block of their fingerprints."""
    bits = min(max(one.count().bit_length() + SPARE_BITS, LEAST_BITS), BLOCK_BITS)
    keyed = one.select("node", "n", *(F.col("check")[i].alias(f"c{i}") for i in range(CHECK)), F.posexplode("blocks").alias("place", "block"))
    key = F.shiftleft(F.col("place").cast("long"), BLOCK_BITS).bitwiseOR(F.shiftright("block", BLOCK_BITS - bits).cast("long"))
    keyed = scratch.keep(keyed.withColumn("key", key).drop("place", "block"), "blocks")
    member = scratch.keep(_members(keyed, scratch, "blocks"), "block-members")
    other = [F.col(c).alias(f"{c}2") for c in ("n", *(f"c{i}" for i in range(CHECK)))]
    apart = sum((F.bit_count(F.col(f"c{i}").bitwiseXOR(F.col(f"c{i}2"))) for i in range(CHECK)), F.lit(0)) <= FAR
    head = member.where("node = head").select("key", *other)
    star = member.where("node <> head").join(head, "key").where(apart & _alike(F.col("n"), F.col("n2"), least))
    star = scratch.keep(star.select(F.col("node").alias("u"), F.col("head").alias("v")).distinct(), "block-star")
    star = _verified(star, rows, reps, scratch, size, "block-compared")
    root = components(star.where(F.col("j") >= least).select("u", "v"), scratch)
    told = _told(member.where("node <> head"), star)
    return _settled(root, told, apart, one, rows, reps, scratch, size, least, "block-rest")


def _rest(root: DataFrame, one: DataFrame, rows: DataFrame, reps: DataFrame, scratch: Scratch, size: int, least: float) -> DataFrame:
    """(u, root): root and the links that it lacks, of nodes that share a band."""
    keyed = scratch.keep(one.select("node", "n", F.explode("keys").alias("key")), "keyed")
    member = scratch.keep(_members(keyed, scratch, "bands").where("node <> head"), "members")
    a, b = (root.select(F.col("u").alias(x), F.col("root").alias(r)) for x, r in (("node", "ra"), ("head", "rb")))
    star = member.select("node", "head").distinct().join(a, "node", "left").join(b, "head", "left")
    star = star.where(F.coalesce("ra", "node") != F.coalesce("rb", "head")).select(F.col("node").alias("u"), F.col("head").alias("v"))
    star = _verified(scratch.keep(star, "star"), rows, reps, scratch, size, "compared")
    root = _more(root, star.where(F.col("j") >= least).select("u", "v"), scratch)
    return _settled(root, _told(member, star), F.lit(True), one, rows, reps, scratch, size, least, "rest")


def _grouped(docs: DataFrame, text: str, key: str, shingle: int, similarity: float, rest: bool = True):
    """(doc_id, t, node) of all rows, and for each node the doc_id and t of its group's first document."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    least = similarity - 1e-9
    rows = _rows(docs, text, key)
    schema = "doc_id long, t long, node long, keys array<long>, n long, bits array<long>, blocks array<int>, check array<long>"
    signed = scratch.keep(rows.mapInArrow(_signed(shingle), schema), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    reps = scratch.keep(signed.groupBy("node").agg(F.min(place).alias("r")).select("node", F.col("r.doc_id").alias("rep_id"), F.col("r.t").alias("rep_t")), "reps")
    own = reps.hint("merge")
    one = signed.join(own, (signed["node"] == own["node"]) & _same(signed, own), "left_semi")
    one = scratch.keep(one.dropDuplicates(["node"]).select("node", "n", "keys", "bits", "blocks", "check"), "one")
    root = _by_simhash(one, rows, reps, scratch, shingle, least)
    if rest:
        root = _rest(root, one, rows, reps, scratch, shingle, least)
    owned = reps.join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = owned.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "rep_t")).alias("r"))
    first = scratch.keep(owned.select("node", "root").join(first, "root").select("node", "r.rep_id", "r.rep_t"), "first")
    return signed.select("doc_id", "t", "node"), first


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, rest: bool = True) -> DataFrame:
    """(doc_id, component_id): one row for each row of docs; the id of a group is its smallest doc_id. rest: False for the links of SimHash alone."""
    signed, first = _grouped(docs, text, key, shingle, similarity, rest)
    return signed.join(first, "node").select("doc_id", F.col("rep_id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs of which each is the first document of its group."""
    _, first = _grouped(docs, text, key, shingle, similarity)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index(key), docs.columns.index(text)
    plain = plain.select("*", F.col(f"_{at[0]}").cast("long").alias("doc_id"), F.xxhash64(F.col(f"_{at[1]}").cast("string")).alias("t"))
    chosen = first.select("rep_id", "rep_t").distinct().hint("merge")
    stays = plain.join(chosen, _same(plain, chosen), "left_semi")
    names = [f"_{i}" for i in range(len(docs.columns))]
    one = stays.groupBy("doc_id", "t").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("r"))
    return one.select(*(F.col(f"r._{i}").alias(c) for i, c in enumerate(docs.columns)))
