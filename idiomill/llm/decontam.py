"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into words at white space and ASCII punctuation. A mask
such as ``1101011`` selects some of the words at a position and ignores the others;
equal hashes of the selected words of a benchmark item and a document are a hit, whatever
stands at the ignored positions. Around each hit the item is laid over the document, and
the overlap counts if some window of WINDOW words (or the whole item, if shorter) has at
least IDENTITY of its words equal at equal positions.

MASKS have a hit in every window of 13 words of which 11 are equal. An item shorter than
a window has masks of its own length: with e words that may differ, e + 1 masks, of which
mask r selects every (e + 1)th word from the r-th, so that one of them selects equal words
only. So no overlap that counts is without a hit.

All hits of a document are looked up, expanded and verified as arrays, in chunks of
bounded size. Where an item has more hits than there are ways to lay it over the
document (a text that repeats itself), all of these are verified instead of the hits.

The benchmark is indexed in blocks of BLOCK_WORDS words, or of one item that is longer;
one block at a time is broadcast, so what workers hold has a bound; a larger benchmark
takes more passes over the documents.

Defined results: null, empty and wordless texts or items match nothing; equal items each
get their own row; each (doc_id, item_id) is returned once for each row of docs; a null
doc_id keeps its rows, and ids that cannot be cast to long are an error; other columns
are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, mix64

# The spaced seeds, five words each.
MASKS = ("11111", "1101011", "11010011", "110010101", "1010010011")
WINDOW = 13
IDENTITY = 0.8
BLOCK_WORDS = 500_000
FILTER_BITS = 22
CHUNK = 1 << 20
"""Words or hits that are in arrays at once."""

_LOWER = bytes(ord(" ") if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _seeds(ids: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """A hash of the selected words at each position; 0 where one of them is unknown."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.full(n, salt + 1, np.uint64), np.ones(n, bool)
    for k, bit in enumerate(mask):
        if bit == "1":
            part = ids[k : k + n]
            h = (h ^ part) * GOLDEN + (h >> U64(31))
            known &= part > 0
    h = mix64(h) | U64(1)
    h[~known] = 0
    return h


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo[0] .. lo[0] + n[0] - 1, lo[1] .., end to end."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _chunks(sizes: np.ndarray):
    """Slices of about CHUNK in total, or of one entry."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
        yield slice(a, b)
        a = b


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], masks=MASKS, window=WINDOW, identity=IDENTITY):
        self.window, self.identity = window, identity
        self.vocab: dict[bytes, int] = {}
        self.ids: list[int] = []
        own, by_mask = [], {}
        for item_id, text in items:
            words = words_of(text)
            if words:
                by_mask.setdefault(min(len(words), window), []).append(len(own))
                self.ids.append(item_id)
                own.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64))
        self.size = np.array([len(x) for x in own], np.int64)
        self.flat = np.concatenate([*own, np.empty(0, np.uint64)])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.need = np.array([self._least(n) for n in np.minimum(self.size, window).tolist()], np.int64)
        self.masks: list[tuple[str, int]] = []
        hashes, at = [], []
        for n in sorted(by_mask, reverse=True):
            for mask in masks if n == window else self._whole(n):
                salt = len(self.masks)
                self.masks.append((mask, salt))
                for k in by_mask[n]:
                    h = _seeds(own[k], mask, salt)
                    hashes.append(h)
                    at.append(np.stack([np.full(len(h), k), np.arange(len(h))], 1))
        h = np.concatenate([*hashes, np.empty(0, np.uint64)])
        at = np.concatenate([*at, np.empty((0, 2), np.int64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.place = h[order], at[order, 0], at[order, 1]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _least(self, n: int) -> int:
        """Words that have to be equal in a window of n."""
        return math.ceil(self.identity * n - 1e-9)

    def _whole(self, n: int) -> list[str]:
        parts = n - self._least(n) + 1
        return ["".join("01"[i % parts == r] for i in range(n)) for r in range(min(parts, n))]

    def find(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, first word, matched words, compared words, best identity) of each item found."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        if not ids.any():
            return []
        found: dict[int, tuple] = {}
        for item, d in self._hits(ids):
            a = np.maximum(0, d)
            n = np.minimum(len(ids), d + self.size[item]) - a
            w = np.minimum(self.window, self.size[item])
            fits = n >= w
            item, d, a, n, w = (x[fits] for x in (item, d, a, n, w))
            for part in _chunks(n):
                self._verify(ids, *(x[part] for x in (item, d, a, n, w)), found)
        return [(self.ids[k], a, m, n, s) for k, (m, _, a, n, s) in sorted(found.items())]

    def _verify(self, ids, item, d, a, n, w, found):
        """Lays items over the document at diagonals d, where n words from a on are compared."""
        if not len(item):
            return
        end = np.cumsum(n)
        first = end - n
        own = _ranges(self.start[item] + a - d, n)
        sums = np.concatenate([[0], np.cumsum(ids[_ranges(a, n)] == self.flat[own])])
        back = np.repeat(w, n)
        at = np.arange(1, len(own) + 1) - back  # where the window that ends here begins
        inside = at >= np.repeat(first, n)
        equal = np.where(inside, sums[1:] - sums[np.maximum(at, 0)], -1)
        best = np.maximum.reduceat(equal, first)
        for k in np.flatnonzero(best >= self.need[item]).tolist():
            i = int(item[k])
            row = (int(sums[end[k]] - sums[first[k]]), -int(d[k]), int(a[k]), int(n[k]), int(best[k]) / int(w[k]))
            if i not in found or row > found[i]:
                found[i] = row

    def _hits(self, ids):
        """Arrays of items and diagonals (where the item's first word falls in the document) that seeds propose."""
        place, lo, n = [], [], []
        for mask, salt in self.masks:
            h = _seeds(ids, mask, salt)
            i = np.flatnonzero(self.filter[(h >> U64(64 - FILTER_BITS)).astype(np.int64)] & (h > 0))
            if i.size:
                begin, stop = np.searchsorted(self.hashes, h[i]), np.searchsorted(self.hashes, h[i], side="right")
                real = stop > begin
                place.append(i[real])
                lo.append(begin[real])
                n.append((stop - begin)[real])
        if not place:
            return
        place, lo, n = map(np.concatenate, (place, lo, n))
        dense = np.zeros(len(self.size), bool)
        if n.sum() > CHUNK:
            # How often each item is hit, from the distinct seeds of the document.
            seeds, times = np.unique(lo, return_counts=True)
            sizes = n[np.unique(lo, return_index=True)[1]]
            hits = np.zeros(len(self.size))
            for part in _chunks(sizes):
                at = _ranges(seeds[part], sizes[part])
                hits += np.bincount(self.item[at], np.repeat(times[part], sizes[part]), len(self.size))
            dense = hits > self.size + len(ids)
            for k in np.flatnonzero(dense).tolist():
                w = min(self.window, int(self.size[k]))
                d = np.arange(w - int(self.size[k]), len(ids) - w + 1)
                yield np.full(len(d), k), d
        for part in _chunks(n):
            at = _ranges(lo[part], n[part])
            item, d = self.item[at], np.repeat(place[part], n[part]) - self.place[at]
            rest = ~dense[item]
            code = np.unique(item[rest] << 32 | d[rest] + (1 << 31))
            yield code >> 32, (code & (1 << 32) - 1) - (1 << 31)


def _blocks(benchmark: DataFrame, block_words: int):
    """The items, as lists of ``block_words`` words at most or of one item; one list at least. The driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, size, none = [], 0, True
    for r in items.toLocalIterator(prefetchPartitions=True):
        words = len((r.text or "").split()) + (r.text or "").count("-")
        if block and size + words > block_words:
            yield block
            block, size, none = [], 0, False
        block.append((r.item_id, r.text))
        size += words
    if block or none:
        yield block


SCHEMA = "doc_id long, item_id long, first_word long, matched_words long, compared_words long, best_identity double"


def _one_by_one(docs: DataFrame, benchmark: DataFrame, block_words: int, step, label: str):
    """step(broadcast block) for each block. All but the last are written before the next block is broadcast."""
    context = docs.sparkSession.sparkContext
    scratch, shared, now = Scratch(docs.sparkSession, label), None, None
    for block in _blocks(benchmark, block_words):
        if shared is not None:
            yield scratch.keep(now, "block")
            shared.destroy()
        shared = context.broadcast(block)
        now = step(shared)
    yield now


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, **settings) -> DataFrame:
    """One row for each document and item that overlap."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for found in _one_by_one(docs, benchmark, block_words, lambda b: rows.mapInArrow(_finder(b, settings), SCHEMA), "overlaps"):
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shared, settings):
    def run(batches):
        index = Index(shared.value, **settings)
        for batch in batches:
            out = [
                (i, *row)
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for row in index.find(t)
            ]
            types = [pa.int64()] * 5 + [pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def without_overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, **settings) -> DataFrame:
    """The rows of docs whose text no benchmark item overlaps; a filter for each block of the benchmark, no shuffle."""
    left = [docs]
    step = lambda b: left[-1].where(~_overlapped(b, settings)(F.col("text").cast("string")))
    for rows in _one_by_one(docs, benchmark, block_words, step, "leaks"):
        left.append(rows)
    return left[-1]


def _overlapped(shared, settings):
    @F.pandas_udf("boolean")
    def any_overlap(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value, **settings)
        for part in texts:
            yield pd.Series([bool(index.find(t)) for t in part], dtype=bool)

    return any_overlap


# Every item laid over every document at every diagonal with an equal word.
ORACLE = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
tw AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM t),
bw AS (SELECT item_id, len(w) AS own, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j FROM b),
m AS (SELECT doc_id, item_id, size, own, p - j AS d, j FROM tw JOIN bw USING (word)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, d ORDER BY j RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS near FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, d) >= ceil(0.8 * least(own, 13))),
g AS (SELECT doc_id, item_id, d, count(*) AS matched, max(near) AS best, greatest(d, 0) AS first_word, least(any_value(size), d + any_value(own)) - greatest(d, 0) AS compared, least(any_value(own), 13) AS w FROM c GROUP BY doc_id, item_id, d),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, d) AS n FROM g WHERE compared >= w AND 5 * best >= 4 * w)
SELECT doc_id, item_id, first_word::BIGINT AS first_word, matched::BIGINT AS matched_words, compared::BIGINT AS compared_words, best / w AS best_identity FROM f WHERE n = 1
"""
