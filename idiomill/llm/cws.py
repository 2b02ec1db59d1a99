"""Document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words (ASCII lower case) weighted by their count in the
text. For each sample j and term k, r and c are Gamma(2, 1) and b is uniform, all derived
from a hash of (j, k), so that they are the same wherever the term occurs. With
t = floor(ln w / r + b) the term's value is ln c - r (t - b) - r, and the sample is the
pair (k, t) with the least value. Two texts share a sample with a probability equal to
their generalised Jaccard similarity, sum of min over sum of max of the weights.

The variates come from one 64-bit hash: 16 bits select r by a table of quantiles, 16 bits
are b, and 20 bits select c by a table. A sample is stored as 16 bits, so unrelated samples
collide once in 65,536.

Defined results: null texts count as empty; texts without a word have the all-zero
fingerprint, which is fully alike to itself and unlike any other; a text of one word has
that word as its only term; whole texts are used, in slices of terms of bounded memory;
rows that share a doc_id are in order of their text, null ids come last, and rows of one
id or without one are one range, which streams through one task; ids that cannot be cast
to long are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import GOLDEN, MIX_A, MIX_B, U64, mix64

SAMPLES = 64
SLICE = 4096
"""Terms whose variates are in memory at once: SLICE x SAMPLES values for each array."""
TARGET_BYTES = 4 << 20
"""Text bytes of one range of documents."""
MAX_RANGES = 20_000
"""Ranges at most; their limits reach the driver. Rows of a range are streamed, so a larger range needs no more memory."""


class Sampler:
    def __init__(self, samples: int = SAMPLES):
        grid = np.concatenate([np.linspace(0, 1, 4001)[1:] ** 2, np.linspace(1, 40, 40001)[1:]])
        below = 1 - (1 + grid) * np.exp(-grid)

        def table(bits):
            return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), below, grid)

        self.r = table(16).astype(np.float32)
        self.ln_c = np.log(table(20)).astype(np.float32)
        self.salt = mix64((np.arange(1, samples + 1, dtype=np.uint64)) * GOLDEN)
        self.samples = samples

    def _bits(self, terms: np.ndarray) -> np.ndarray:
        z = terms[:, None] ^ self.salt[None, :]
        t = z >> U64(30)
        for multiplier, shift in ((MIX_A, 27), (MIX_B, 31)):
            z ^= t
            z *= multiplier
            np.right_shift(z, U64(shift), out=t)
        z ^= t
        return z

    def variates(self, terms: np.ndarray):
        """r, b and ln c for each term and sample."""
        z = self._bits(terms)
        halves = z.view(np.uint16).reshape(*z.shape, 4)
        b = halves[..., 1].astype(np.float32)
        b += np.float32(0.5)
        b *= np.float32(1 / 65536)
        return self.r.take(halves[..., 0]), b, self.ln_c.take((z >> U64(44)).astype(np.int32))

    def values(self, terms: np.ndarray) -> np.ndarray:
        """The value of each term and sample at weight 1, where t is 0; small slices stay in the processor's cache."""
        out = np.empty((len(terms), self.samples), np.float32)
        for a in range(0, len(terms), 256):
            r, b, ln_c = self.variates(terms[a : a + 256])
            np.subtract(np.float32(1), b, out=b)
            b *= r
            np.subtract(ln_c, b, out=out[a : a + 256])
        return out

    def codes(self, term: np.ndarray, t: np.ndarray) -> np.ndarray:
        """16 bits for each sample's (term, t)."""
        return (mix64(term ^ (t.astype(np.uint64) * GOLDEN)) >> U64(48)).astype(np.uint16)

    def sign(self, terms: np.ndarray, weights: np.ndarray, shared=None) -> np.ndarray | None:
        """The samples of one text; None if it has no term. shared: rows of precomputed variates."""
        if not len(terms):
            return None
        lanes = np.arange(self.samples)
        best = np.full(self.samples, np.inf, np.float32)
        term, at = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int32)
        for a in range(0, len(terms), SLICE):
            part = slice(a, a + SLICE)
            value = self.values(terms[part]) if shared is None else self.pool[shared[part]]
            # Most terms occur once, where t is 0 and the value needs no more arithmetic.
            more = np.flatnonzero(weights[part] > 1)
            if more.size:
                r, b, ln_c = self.variates(terms[part][more])
                t = np.floor(np.log(weights[part][more]).astype(np.float32)[:, None] / r + b)
                value[more] = ln_c - r * (t - b) - r
            low = value.argmin(axis=0)
            v = value[low, lanes]
            new = v < best
            best[new] = v[new]
            term[new], at[new] = terms[part][low[new]], 0
            if more.size:
                k = np.minimum(np.searchsorted(more, low), len(more) - 1)
                often = new & (more[k] == low)
                at[often] = t[k[often], lanes[often]].astype(np.int32)
        return self.codes(term, at)


_words: dict[bytes, int] = {}


def terms_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a text as hashes, ascending, and their counts."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(_words) > 200_000:
        _words.clear()
    known, digest = _words, xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        out.append(h)
    hashes = np.array(out, np.uint64)
    pairs = hashes if len(words) == 1 else hashes[:-1] * GOLDEN + (hashes[1:] ^ (hashes[1:] >> U64(29)))
    return np.unique(mix64(pairs), return_counts=True)


def text_of(codes: np.ndarray | None, samples: int = SAMPLES) -> str:
    return "0" * (4 * samples) if codes is None else codes.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of equal samples; two texts without terms are alike, one without terms is unlike others."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


_sampler: Sampler | None = None


def sampler() -> Sampler:
    global _sampler
    if _sampler is None:
        _sampler = Sampler()
    return _sampler


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _signed(rows):
    """Adds the fingerprints of the text and of the edited text to rows (id, text, edited text or None).

    Terms of neighbouring texts overlap (an edited text is made of two of them), so the
    variates of a group of rows are computed once for each distinct term.
    """
    s = sampler()
    bags = [(terms_of(t.encode()), terms_of(e.encode()) if e is not None else None) for _, t, e in rows]
    small = [b for two in bags for b in two if b is not None and len(b[0]) <= SLICE]
    terms = np.unique(np.concatenate([b[0] for b in small])) if small else np.empty(0, np.uint64)
    s.pool = s.values(terms) if len(terms) else None
    for (i, text, edited), two in zip(rows, bags, strict=True):
        signs = [
            None if b is None else s.sign(*b, np.searchsorted(terms, b[0]) if len(b[0]) <= SLICE else None) for b in two
        ]
        yield i, text, edited, *signs


def _stream(batches):
    """Rows in order of (bucket, ghost, descending doc_id): a row's next document is the row after it in its bucket."""
    held, kept, size = None, [], 0
    out: list = []

    pending = None  # a signed row that waits for its next document's fingerprint
    for batch in batches:
        for bucket, ghost, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or ""
            if held is not None:
                b, was_ghost, j, t = held
                if not was_ghost:
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half] if b == bucket else None
                    kept.append((b, False, j, t, edited))
                elif not (kept and kept[-1][1] and kept[-1][0] == b):
                    kept.append((b, True, j, t, None))
                size += len(t)
            held = (bucket, ghost, i, text)
            if size > 1 << 18:
                pending, rows = _paired(kept, pending)
                out += rows
                kept, size = [], 0
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
    if held is not None:
        kept.append((*held, None))
    pending, rows = _paired(kept, pending)
    out += rows
    if out:
        yield _batch(out)


def _paired(kept, pending):
    """Result rows of signed neighbours; the last signed row waits for the next call."""
    rows = []
    signed = _signed([(i, t, e) for _, _, i, t, e in kept])
    for (bucket, ghost, *_), (i, text, edited, own, changed) in zip(kept, signed, strict=True):
        if pending is not None and not pending[1] and pending[0] == bucket:
            _, _, j, t, e, a, c = pending
            rows.append((j, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(a), text_of(c), likeness(a, c), likeness(a, own)))
        pending = (bucket, ghost, i, text, edited, own, changed)
    return pending, rows


def _batch(rows):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def fingerprint_edits(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    Documents go in descending order of doc_id to ranges of about ``target_bytes``; the
    first document of a range also goes, as a ghost, to the end of the range before, so
    that every document meets its next one. Only the range limits and the largest id of
    each range reach the driver (one number for each range).

    The last document's next is the first. A single document is its own next. Rows with
    a null doc_id come last; equal ids are ordered by text.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("rank"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    spark = docs.sparkSession
    if total is None:
        return spark.createDataFrame([], SCHEMA)
    ranges = min(max(1, -(-total // target_bytes)), MAX_RANGES)
    cuts = sorted({int(x) for x in rows.approxQuantile("rank", [k / ranges for k in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    limits = np.array(cuts, np.int64)

    @pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, ids.to_numpy(), side="right").astype("int32"))

    tops = sorted(rows.select(bucket("rank").alias("bucket"), "rank").groupBy("bucket").agg(F.max("rank")).collect())
    ghosts: dict[int, list[int]] = {tops[-1][1]: [tops[0][0]]}
    for (b, _), (_, first) in zip(tops[1:], tops[:-1], strict=True):
        ghosts.setdefault(first, []).append(b)

    @pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        home = np.searchsorted(limits, ids.to_numpy(), side="right").tolist()
        return pd.Series([[b, *ghosts.get(i, ())] for b, i in zip(home, ids.tolist(), strict=True)])

    spread = rows.select("doc_id", "rank", "text", F.posexplode(places("rank")).alias("at", "bucket")).select(
        "bucket", (F.col("at") > 0).alias("ghost"), "doc_id", "rank", "text"
    )
    ordered = spread.repartition(ranges, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("rank"), "text")
    return ordered.select("bucket", "ghost", "doc_id", "text").mapInArrow(_stream, SCHEMA)
