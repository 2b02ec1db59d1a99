"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier, that
is, if the longest previous factor at some start is LENGTH or more. Matches do not cross
documents, may overlap, and are judged on the input; the first copy stays.

A suffix order over all text is not needed for that. Every LENGTH-byte window has an
anchor, the 24-byte string inside it with the least hash (the leftmost of equals), so
equal windows have equal anchors at equal offsets. Round 1 of the exchange finds the
anchors that are repeated. A maximal run of windows with the same anchor is a piece, of
LENGTH to 176 bytes. Longest previous factors are taken in three places, each time over
suffixes in suffix order, with the true lengths of the prefixes that neighbours share,
and with previous and next smaller positions, found in one pass with a stack:

1. in a block, over the starts of its pieces: one whose factor is as long as the piece is
   repeated as a whole, and is not sent;
2. in round 2, in a bucket of anchors, over the starts of the pieces of all blocks;
3. there, over all starts of windows of the pieces of an anchor that are still different.

An anchor is crowded if a block has more than CROWDED different pieces of it, or more
than WIDESPREAD blocks have it. Its pieces are not brought together, as their number has
no bound: their windows are, whole, by a hash of their bytes; a block sends each window
once, and a bucket keeps the first of each. Hashes only choose buckets and anchors. Bytes
decide everywhere.

Defined results: null texts are empty; texts shorter than LENGTH stay whole; rows that
share a doc_id are in order of a hash of their text, and of equal rows one is the first;
null ids come last; ids that cannot be cast to long are an error; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import U64, Scratch, mix64
from .exchange import (
    WORTH_WAITING, Block, Names, Windows, answer_names, answer_windows, answers, ask, bits, blocks_of, by_bucket, each,
    grown, positions, slices, squeeze, unbits, unsqueeze,
)

LENGTH = 100
ANCHOR = 24
PART = 1 << 18
SORTED = 100_000
"""Suffixes that are put in order together; those of one anchor always are."""
ANCHOR_BYTES = 40
"""Bytes of text for each anchor, about; only the number of buckets depends on it."""
BUCKET_BYTES = (16 << 20, 128 << 20)
"""Bytes of text for each bucket, at least and at most."""
COLUMNS = [("doc_id", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]

_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_PLACE = 28


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Of documents that stand end to end: the hash of each anchor, and the first and last start of its windows."""
    w = length - ANCHOR + 1
    n = len(data) - ANCHOR + 1
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if n < w:
        return none
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    eight = np.ascontiguousarray(eight).view("<u8").ravel()
    h = eight[:n] * _A
    h ^= h >> U64(29)
    h += eight[8 : n + 8]
    h *= _B
    h ^= h >> U64(32)
    h += eight[16 : n + 16]
    h *= _C
    h ^= h >> U64(29)
    h *= _A
    h ^= h >> U64(32)
    del eight
    top = U64((1 << 64) - (1 << _PLACE))
    v = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    v[:n] = (h & top) | np.arange(n, dtype=np.uint64)
    rows = v.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - w + 1
    at = (np.minimum(after[:count], before[w - 1 : w - 1 + count]) & ~top).astype(np.int64)
    inside = np.zeros(count + 1, np.int8)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not s.size:
        return none
    p = at[s]
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    # The least hashes are small numbers; mixed again they spread over all buckets.
    return mix64(h[p[first]]), s[first], s[last]


def longest_previous(order: list[int], common: list[int]) -> list[int]:
    """The longest previous factor of each position.

    order: positions in suffix order; common[k]: the length that the suffixes k - 1 and k
    in that order have in common (common[0] is 0). A position on the stack waits for its
    next smaller one; below it lies its previous smaller one.
    """
    out = [0] * len(order)
    stack: list[tuple[int, int]] = []
    for k in range(len(order) + 1):
        p, shared = (order[k], common[k]) if k < len(order) else (-1, 0)
        while stack and p < stack[-1][0]:
            q, above = stack.pop()
            out[q] = max(above, shared)
            shared = min(above, shared)
        stack.append((p, shared))
    return out


def suffix_order(suffixes: list[bytes]) -> tuple[list[int], list[int]]:
    """The suffixes in suffix order, equal ones as they come, and what each has in common with the one before it."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    if len(order) < 2:
        return order, [0] * len(order)
    size = np.array([len(x) for x in suffixes])[order]
    shorter, width = np.minimum(size[1:], size[:-1]), int(size.max())
    common, step = [np.zeros(1, np.int64)], max(2, (1 << 24) // width)
    for a in range(0, len(order) - 1, step):
        part = b"".join([suffixes[k].ljust(width, b"\0") for k in order[a : a + step + 1]])
        rows = np.frombuffer(part, np.uint8).reshape(-1, width)
        same = rows[1:] == rows[:-1]
        common.append(np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), shorter[a : a + step]))
    return order, np.concatenate(common).tolist()


def previous_factors(suffixes: list[bytes]) -> np.ndarray:
    """The longest previous factor of each of some suffixes that are in order of position."""
    return np.array(longest_previous(*suffix_order(suffixes)), np.int64)


def later_pieces(pieces: list[bytes]) -> np.ndarray:
    """For pieces in order of position: which of them begin an earlier one, or are equal to one."""
    return previous_factors(pieces) >= np.array([len(x) for x in pieces], np.int64)


def later_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For pieces in order of position: which of the windows of each have an equal one earlier."""
    factors = previous_factors([p[k:] for p in pieces for k in range(len(p) - length + 1)])
    return np.split(factors >= length, np.cumsum([len(p) - length + 1 for p in pieces])[:-1])


def windows_of(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The starts lo[k] .. lo[k] + n[k] - 1 of all pieces, end to end."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


class Pieces:
    """The pieces of a block: the key of the anchor of each, and its first and last window."""

    def __init__(self, block: Block, length: int):
        self.block, self.length = block, length
        data = np.frombuffer(block.data, np.uint8)
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for starts, ends in self._parts():
            base = starts[0]
            k, first, last = anchors(data[base : ends[-1]], starts - base, ends - base, length)
            parts.append((k, first + base, last + base))
        self.keys, self.lo, self.hi = map(np.concatenate, zip(*parts, strict=True))
        self.names = Names(self.keys)

    def _parts(self):
        """Limits of documents together, of about PART bytes. A longer document comes in
        stretches that overlap by a window less one byte, so each window is in one of them."""
        block = self.block
        for a, b in block.parts(PART):
            starts, ends = block.starts[a:b], block.ends[a:b]
            if b - a > 1 or ends[0] - starts[0] <= 2 * PART:
                yield starts, ends
                continue
            for s in range(int(starts[0]), int(ends[0]) - self.length + 1, PART):
                yield np.array([s]), np.array([min(s + PART + self.length - 1, int(ends[0]))])

    def text(self, k: int) -> bytes:
        return self.block.data[self.lo[k] : self.hi[k] + self.length]


class Plan:
    """What a block knows of its windows after round 1: which are later copies within it, and what it sends."""

    def __init__(self, block: Block, length: int, got, one: int, two: int):
        pieces = Pieces(block, length)
        again, hot = pieces.names.read(one, got)
        self.block, self.length = block, length
        self.late = np.zeros(len(block.data) + 1, bool)
        some = np.flatnonzero(again)
        some = some[np.argsort(pieces.lo[some], kind="stable")]
        repeated = later_pieces([pieces.text(k) for k in some.tolist()])
        gone, first = some[repeated], some[~repeated]
        self.late[windows_of(pieces.lo[gone], pieces.hi[gone] - pieces.lo[gone] + 1)] = True
        crowd, first = first[hot[first]], first[~hot[first]]
        order = first[np.argsort(by_bucket(pieces.keys[first], two), kind="stable")]
        self.keys, self.lo, self.n = pieces.keys[order], pieces.lo[order], pieces.hi[order] - pieces.lo[order] + 1
        self.parts = list(slices(by_bucket(self.keys, two), two))
        begin = np.sort(windows_of(pieces.lo[crowd], pieces.hi[crowd] - pieces.lo[crowd] + 1))
        self.windows = Windows([block.data[s : s + length] for s in begin.tolist()], begin, two)
        self.late[self.windows.later] = True

    def messages(self):
        """Pieces go to even buckets, single windows to odd ones."""
        block = self.block
        for b, part in self.parts:
            lo, size = self.lo[part], self.n[part] + self.length - 1
            text = b"".join([block.data[s : s + n] for s, n in zip(lo.tolist(), size.tolist(), strict=True)])
            doc, at = np.unique(np.searchsorted(block.ends, lo, side="right"), return_inverse=True)
            yield 2 * b, squeeze(
                self.keys[part].astype("<u8"), block.ids[doc], block.tie[doc], at.astype("<u4"), lo.astype("<i8"), size.astype("<u4"), text
            )
        for b, payload in self.windows.messages(block, np.searchsorted(block.ends, self.windows.first, side="right")):
            yield 2 * b + 1, payload

    def finish(self, got):
        """The result rows of the block's documents."""
        late, block = self.late, self.block
        for b, part in self.parts:
            at = windows_of(self.lo[part], self.n[part])
            late[at[unbits(got[2 * b], len(at))]] = True
        late[self.windows.read(lambda b: got[2 * b + 1])] = True
        # A window at s covers [s, s + length), all of it inside its document.
        edge = np.zeros(len(block.data) + 1, np.int8)
        s = np.flatnonzero(late)
        alone = np.flatnonzero(np.diff(s, prepend=-2) > 1)  # where runs of later windows begin
        edge[s[alone]] += 1
        ends = s[np.append(alone[1:], len(s)) - 1] + self.length if len(s) else s
        np.add.at(edge, ends, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        data = np.frombuffer(block.data, np.uint8)
        for i, null, a, b in zip(block.ids.tolist(), block.null.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
            g = gone[a:b]
            kept = data[a:b][~g] if g.any() else data[a:b]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + bool(len(g) and g[0]))
            yield None if null else i, b - a, b - a - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()


def answer_pieces(payloads, length: int = LENGTH) -> list[bytes]:
    """Round 2, in a bucket of anchors: for each window of each sent piece, whether an equal one is earlier."""
    parts = [unsqueeze(p) for p in payloads]
    counts = [len(p[0]) // 8 for p in parts]
    keys, lo, size = (np.concatenate([np.frombuffer(p[k], kind) for p in parts]) for k, kind in ((0, "<u8"), (4, "<i8"), (5, "<u4")))
    ids, tie = (np.concatenate([np.frombuffer(p[k], kind)[np.frombuffer(p[3], "<u4")] for p in parts]) for k, kind in ((1, "<i8"), (2, "<u8")))
    text, size = b"".join(p[6] for p in parts), size.astype(np.int64)
    ends, n = np.cumsum(size), size - length + 1
    out = np.concatenate([[0], np.cumsum(n)])
    late = np.zeros(out[-1], bool)
    order = np.argsort(positions(ids, tie, np.repeat(np.arange(len(parts)), counts), lo))
    pieces = [text[a:b] for a, b in zip((ends - size)[order].tolist(), ends[order].tolist(), strict=True)]
    repeated = later_pieces(pieces)
    late[windows_of(out[:-1][order[repeated]], n[order[repeated]])] = True
    # What is left of each anchor. The windows of different anchors differ, so a batch may hold several; those of one
    # piece differ, too, as equal windows have their anchors at equal offsets.
    rest = np.flatnonzero(~repeated)
    rest = rest[np.argsort(keys[order[rest]], kind="stable")]
    edges = np.flatnonzero(np.diff(keys[order[rest]], prepend=~keys[order[rest[:1]]], append=~keys[order[rest[-1:]]]))
    group, windows = [], 0

    def close():
        for k, flags in zip(group, later_windows([pieces[k] for k in group], length), strict=True):
            at = out[order[k]]
            late[at : at + len(flags)] |= flags
        group.clear()

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        group += rest[a:b].tolist()
        windows += int(n[order[rest[a:b]]].sum())
        if windows >= SORTED:
            close()
            windows = 0
    if group:
        close()
    return [bits(late[out[a] : out[b]]) for a, b in zip(np.cumsum([0, *counts[:-1]]).tolist(), np.cumsum(counts).tolist(), strict=True)]


class ByteRepeats:
    """The two rounds, as functions of a block or of a bucket's messages."""

    def __init__(self, length: int = LENGTH):
        if length < 2 * ANCHOR:
            raise ValueError(f"strings of fewer than {2 * ANCHOR} bytes have no anchor")
        self.length = length

    def first(self, block, blob, one, two):
        pieces = Pieces(Block(block, blob), self.length)
        return pieces.names.messages(one, pieces.text)

    @staticmethod
    def answer_first(bucket, blocks, payloads):
        return answer_names(payloads)

    def second(self, block, blob, got1, one, two):
        return Plan(Block(block, blob), self.length, got1, one, two).messages()

    def answer_second(self, bucket, blocks, payloads):
        return answer_windows(payloads) if bucket & 1 else answer_pieces(payloads, self.length)

    def finish(self, block, blob, got1, got2, one, two):
        return Plan(Block(block, blob), self.length, got1, one, two).finish(got2)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row for each row of docs."""
    op, scratch = ByteRepeats(length), Scratch(docs.sparkSession, "suffix")
    blocks, total = blocks_of(docs, text, scratch)
    n = max(1, round(total / grown(total, ANCHOR_BYTES, *BUCKET_BYTES)))
    wait = scratch.release if total > WORTH_WAITING else lambda: None
    # Each round's frames are dropped before the next begins, so that Spark can remove their shuffle files.
    got1 = scratch.keep(ask(blocks, lambda b, blob: op.first(b, blob, n, n), op.answer_first, "got1"), "got1")
    wait()
    asked = blocks.join(got1, "block", "left").select("block", "blob", "got1")
    got2 = ask(asked, lambda b, blob, got: op.second(b, blob, answers(got), n, n), op.answer_second, "got2")
    got = scratch.keep(got1.join(got2, "block", "left"), "got2")
    del asked, got2
    wait()
    whole = blocks.join(got, "block", "left").select("block", "blob", "got1", "got2")
    return each(whole, lambda b, blob, g1, g2: op.finish(b, blob, answers(g1), answers(g2), n, n), COLUMNS)


# Sixteen bytes are a number of 128 bits, so windows are compared whole.
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
a AS (SELECT doc_id, unnest(h) AS x, generate_subscripts(h, 1) AS j FROM t),
b AS (SELECT doc_id, j, x, ('0x' || x)::UBIGINT AS n FROM a),
c AS (SELECT doc_id, j, x, n * 256 + lead(n) OVER o AS n FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
d AS (SELECT doc_id, j, x, n * 65536 + lead(n, 2) OVER o AS n FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
e AS (SELECT doc_id, j, x, n AS n4, n * 4294967296::UBIGINT + lead(n, 4) OVER o AS n FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
f AS (SELECT doc_id, j, x, n4, n::UHUGEINT * 18446744073709551616::UHUGEINT + lead(n, 8) OVER o AS n FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
k AS (SELECT doc_id, j, x, n, lead(n, 16) OVER o AS n1, lead(n, 32) OVER o AS n2, lead(n, 48) OVER o AS n3, lead(n, 64) OVER o AS n4_, lead(n, 80) OVER o AS n5, lead(n4, 96) OVER o AS n6 FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
r AS (SELECT doc_id, j, x, n6 IS NOT NULL AND row_number() OVER (PARTITION BY n, n1, n2, n3, n4_, n5, n6 ORDER BY doc_id, j) > 1 AS late FROM k),
g AS (SELECT doc_id, j, x, bool_or(late) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) AS n, count_if(gone) AS gone, count_if(gone AND NOT before) AS spans, string_agg(x, '' ORDER BY j) FILTER (WHERE NOT gone) AS kept
 FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS before FROM g) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""
