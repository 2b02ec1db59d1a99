"""Removal of repeated word windows by recompression.

Each text is a string of words. Spark rounds rename it. The first one names words: blocks
send the distinct words that they hold, and a bucket of the words' hashes keeps the table
of its words, gives each a number, and answers with them. Each further round names runs
and pairs in the same way: in a block, every maximal run of equal symbols becomes one,
then every pair of a left and a right symbol (by one bit of a hash of the symbol in that
round) does; the buckets keep the tables of what runs and pairs consist of, compared
whole, and name them. So names are global, two names are equal only if what they stand
for is equal word by word, and equal substrings get equal symbols inside, apart from a
few at their ends.

For each symbol the words that it depends on are tracked: its own and those that decided
that it is a whole run or a pair. A symbol that the corpus has only once gets no name,
and every window around all that it depends on is done with: it cannot be repeated. What
no window left depends on is not sent. Of the symbols that a remaining window holds with
all they depend on, the one of the highest round, then of the least hash, is its anchor,
a function of the window's words alone: shared anchors reveal the candidates.

Two last rounds verify them word by word. The first finds the anchors that several
remaining windows have. In the second, a maximal run of windows with the same anchor is a
piece; pieces that a block has twice are later copies; the others meet in the bucket of
their anchor, in the order of their positions, where a window is repeated if the same
words have come before. The windows of crowded anchors (of which a block has more than
CROWDED different pieces, or which more than WIDESPREAD blocks have) are sent one by one,
whole, and meet by their hash instead. Hashes only choose buckets and anchors; words
decide everywhere. Blocks name each word, symbol, piece and window once, so a passage
that stands in a third of all documents gathers nowhere.

Defined results: null, empty and wordless texts have no words (the hash of an empty
string); texts of fewer words than a window stay whole; rows that share a doc_id are in
order of a hash of their text, and of equal rows one is the first; null ids come last;
ids that cannot be cast to long are an error; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import GOLDEN, U64, Scratch, mix64
from .exchange import (
    WORTH_WAITING, Block, Names, Steps, Windows, answer_names, answer_windows, answers, ask, bits, blocks_of, by_bucket, each,
    grown, positions, slices, squeeze, unbits, unsqueeze,
)

WINDOW = 20
ROUNDS = 5
PART = 1 << 18
"""Bytes that are in arrays at once."""
FAR = (1 << 31) - 1
"""Stands for words beyond a document's end, on which a symbol at the end depends."""
ANCHOR_BYTES = 24
BUCKET_BYTES = (16 << 20, 64 << 20)
"""Bytes of text for each bucket, at least and at most."""
COLUMNS = [("doc_id", "long"), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]

_SPACES = b" \t\n\v\f\r"
_SOLID = bytes(b not in _SPACES for b in range(256))
_PLAIN = bytes.maketrans(_SPACES, b" " * len(_SPACES))


def spans(block: Block):
    """Where each word of a block starts and ends, and the first word of each document and of the end."""
    data = np.frombuffer(block.data.translate(_SOLID), bool)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    heads, tails = block.starts[block.starts < block.ends], block.ends[block.starts < block.ends] - 1
    for at in range(0, len(data), PART):
        end = min(at + PART, len(data))
        near = data[max(at - 1, 0) : end + 1]  # with a byte before and after
        solid, before, after = (near[k : k + end - at] for k in ((1, 0, 2) if at else (0, 0, 1)))
        opens, closes = solid.copy(), solid.copy()
        opens[0 if at else 1 :] &= ~before[: len(opens) - (0 if at else 1)]
        closes[: len(after)] &= ~after
        for edge, flags in ((heads, opens), (tails, closes)):
            here = edge[(edge >= at) & (edge < end)] - at
            flags[here] = solid[here]
        a.append(np.flatnonzero(opens) + at)
        b.append(np.flatnonzero(closes) + at + 1)
    starts, ends = np.concatenate(a), np.concatenate(b)
    return starts, ends, np.searchsorted(starts, np.append(block.starts, len(data)))


def windows_of(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo[k] .. lo[k] + n[k] - 1 of all k, end to end."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def binaries(size: np.ndarray, data: bytes) -> pa.Array:
    """Byte strings of these sizes that stand end to end, without copies."""
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def parts_of(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Sizes and bytes of an array of byte strings."""
    ends = np.frombuffer(words.buffers()[1], "<i8")[words.offset : words.offset + len(words) + 1]
    return np.diff(ends).astype("<u4"), words.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()


def vocabulary(block: Block):
    """The distinct words of a block in the order of buckets, their keys, the number of each word, and the first word of each document."""
    starts, ends, first = spans(block)
    coded = binaries(ends - starts, block.data.translate(None, _SPACES)).dictionary_encode()
    size, text = parts_of(coded.dictionary)
    at = np.cumsum(size, dtype=np.int64)
    distinct = [text[a:b] for a, b in zip((at - size).tolist(), at.tolist(), strict=True)]
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), keys[order], rank[coded.indices.to_numpy()], first


def begin(block: Block, buckets: int):
    """The first step: the state is the words as numbers, the messages are the distinct words."""
    words, keys, ids, first = vocabulary(block)
    where = by_bucket(keys, buckets)
    yield None, squeeze(ids.astype("<i4"), first.astype("<i8"), np.bincount(where, minlength=buckets).astype("<i8"))
    times = np.bincount(ids, minlength=len(words))
    for b, part in slices(where, buckets):
        yield b, squeeze(*parts_of(words.slice(part.start, part.stop - part.start)), bits(times[part] > 1))


def answer_words(payloads) -> list[bytes]:
    """In a bucket: the number of each sent word in the table of words that occur again; 0 for others."""
    words, twice = [], []
    for p in payloads:
        size, data, again = unsqueeze(p)
        words.append(binaries(np.frombuffer(size, "<u4"), data))
        twice.append(unbits(again, len(words[-1])))
    ids = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
    again = np.bincount(ids, 1 + np.concatenate(twice)) > 1
    number = np.where(again, np.cumsum(again), 0).astype("<u4")[ids]
    return [x.tobytes() for x in np.split(number, np.cumsum(list(map(len, words)))[:-1])]


def named(parts, got, r: int, n: int) -> np.ndarray:
    """Names from the answers to messages about parts of n things: the round, the bucket and the number there; 0 for none."""
    out = np.zeros(n, np.uint64)
    for b, part in parts:
        k = np.frombuffer(got[b], "<u4").astype(np.uint64)
        out[part] = np.where(k > 0, U64(r << 58 | b << 34) + k, U64(0))
    return out


class State:
    """A block between rounds: the string of symbols over all its documents, and the windows that are left.

    h: the symbols' names, 0 for none; neighbours without a name are one symbol. doc: their
    documents. [lo, hi): the words that each depends on; lo is -1 and hi FAR beyond a
    document. live: where the windows that are left start, rising; anchor: the names of
    their anchors; back: how many words into the window what that depends on begins.
    """

    fields = (("size", "<i8"), ("h", "<u8"), ("doc", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("live", "<i4"), ("anchor", "<u8"), ("back", "u1"))

    def __init__(self, window: int):
        self.window = window

    @classmethod
    def of_words(cls, state: bytes, window: int, got):
        """After the round that names words, from the state of begin()."""
        self = cls(window)
        ids, first, sizes = (np.frombuffer(x, kind) for x, kind in zip(unsqueeze(state), ("<i4", "<i8", "<i8"), strict=True))
        ends = np.cumsum(sizes)
        parts = [(b, slice(int(ends[b] - sizes[b]), int(ends[b]))) for b in np.flatnonzero(sizes).tolist()]
        n = np.diff(first)
        self.size = np.array([len(ids)])
        self.h = named(parts, got, 0, int(sizes.sum()))[ids]
        self.doc = np.repeat(np.arange(len(n)), n).astype(np.int32)
        self.lo = np.arange(len(ids), dtype=np.int32)
        self.hi = self.lo + 1
        self.live = np.flatnonzero(np.arange(len(ids)) + window <= np.repeat(first[1:], n))
        self.anchor, self.back = self.h[self.live], np.zeros(len(self.live), np.uint8)
        self._drop(self.h == 0)
        return self

    @classmethod
    def read(cls, data: bytes, window: int):
        self = cls(window)
        for (name, kind), raw in zip(cls.fields, unsqueeze(data), strict=True):
            setattr(self, name, np.frombuffer(raw, kind).copy())
        self.lo, self.live = np.cumsum(self.lo, dtype=np.int32), np.cumsum(self.live, dtype=np.int64)
        self.hi += self.lo
        if len(self.anchor) < len(self.live):
            self.anchor, self.back = self._first_words(), np.zeros(len(self.live), np.uint8)
        return self

    def bytes(self) -> bytes:
        self._shorten()
        arrays = {name: getattr(self, name).astype(kind) for name, kind in self.fields}
        arrays["hi"] -= arrays["lo"]
        for name in ("lo", "live"):
            arrays[name] = np.diff(arrays[name], prepend=np.int32(0))
        if not (self.back.any() or (self.anchor != self._first_words()).any()):
            arrays["anchor"], arrays["back"] = self.anchor[:0], self.back[:0]
        return squeeze(*arrays.values())

    def _first_words(self):
        """The names of the words that windows left begin with, if they are all still symbols; else of other symbols."""
        return self.h[np.minimum(np.searchsorted(self.lo, self.live), len(self.h) - 1)] if len(self.h) else self.h

    def _shorten(self):
        """Makes one symbol of neighbours without a name."""
        if len(self.h):
            head, _ = self._edges()
            none = self.h == 0
            a = np.flatnonzero(head | ~none | ~np.append(False, none[:-1]))
            b = np.append(a[1:], len(self.h)) - 1
            self.h, self.doc, self.lo, self.hi = self.h[a], self.doc[a], self.lo[a], self.hi[b]

    def _inside(self):
        return (self.lo >= 0) & (self.hi < FAR) & (self.hi - self.lo <= self.window)

    def _drop(self, dead):
        """Ends the windows around all that dead symbols depend on."""
        dead = dead & self._inside()
        edge = np.zeros(int(self.size[0]) + 1, np.int32)
        np.add.at(edge, np.maximum(self.hi[dead] - self.window, 0), 1)
        np.add.at(edge, self.lo[dead] + 1, -1)
        left = np.cumsum(edge)[self.live] == 0
        self.live, self.anchor, self.back = self.live[left], self.anchor[left], self.back[left]
        self._forget()

    def _forget(self):
        """Takes the name from symbols that no window left depends on."""
        fine = self._inside()
        used = np.zeros(len(self.h), bool)
        before = self._before(self.live)
        used[fine] = before[self.lo[fine] + 1] > before[np.maximum(self.hi[fine] - self.window, 0)]
        self.h[~used] = 0

    def _before(self, places):
        """For each place in the block and two beyond, how many of these places come before it."""
        return np.cumsum(np.bincount(places + 1, minlength=int(self.size[0]) + 2), dtype=np.int32)

    def _edges(self):
        """For each symbol, whether it is the first and the last of its document."""
        head = np.ones(len(self.h), bool)
        head[1:] = self.doc[1:] != self.doc[:-1]
        return head, np.append(head[1:], True)[: len(head)]

    def collapse(self, r: int):
        """Makes runs and pairs symbols, without names as yet. Sets what each consists of, and which have to be named."""
        if not len(self.h):
            self.makes, self.new = np.empty((3, 0), np.uint64), np.empty(0, bool)
            return self
        head, _ = self._edges()
        opens = head | (self.h == 0)
        opens[1:] |= self.h[1:] != self.h[:-1]
        a = np.flatnonzero(opens)
        b = np.append(a[1:], len(self.h))
        last = np.append(self.doc[a][1:] != self.doc[a][:-1], True)
        lo = np.where(head[a], -1, self.lo[np.maximum(a - 1, 0)])
        hi = np.where(last, FAR, self.hi[np.minimum(b, len(self.h) - 1)])
        self.h, self.doc, size = self.h[a], self.doc[a], (b - a).astype(np.uint64)
        head, last = self._edges()
        salt = U64((r + 1) * int(GOLDEN) % (1 << 64))
        left = (mix64((self.h ^ mix64(size * GOLDEN)) + salt) >> U64(63)).astype(bool)
        n = np.arange(len(self.h))
        before, after = np.maximum(n - 1, 0), np.minimum(n + 1, len(n) - 1)
        pair = left & ~last & ~left[after]
        keep = np.flatnonzero(~(~left & ~head & left[before]))
        pair, dead = pair[keep], self.h[keep] == 0
        dead |= pair & (self.h[after[keep]] == 0)
        second = np.where(pair, self.h[after[keep]], U64(0))
        sizes = size[keep] << U64(32) | np.where(pair, size[after[keep]], U64(0))
        # A left symbol depends on the one after it, a right one on the one before it.
        self.lo = np.where(left[keep], lo[keep], np.where(head[keep], -1, lo[before[keep]])).astype(np.int32)
        self.hi = np.where(left[keep], np.where(last[keep], FAR, hi[after[keep]]), hi[keep]).astype(np.int32)
        self.h, self.doc = self.h[keep], self.doc[keep]
        self.makes = np.stack([self.h, second, sizes])
        self.h[dead] = 0
        self._forget()
        self.new = (self.h > 0) & (pair | (size[keep] > 1))
        return self

    @staticmethod
    def _fresh(made):
        """Which columns differ from the one before."""
        fresh = np.ones(made.shape[1], bool)
        fresh[1:] = (made[0, 1:] != made[0, :-1]) | (made[1, 1:] != made[1, :-1]) | (made[2, 1:] != made[2, :-1])
        return fresh

    def _listed(self, buckets: int):
        """The distinct things to be named in the order of buckets, how often each occurs, and the number of each."""
        made = self.makes[:, self.new]
        keys = mix64(mix64(made[0] * GOLDEN + made[1]) ^ made[2] * GOLDEN)
        order = np.argsort(keys, kind="stable")
        fresh = self._fresh(made[:, order])
        if (fresh[1:] & (keys[order[1:]] == keys[order[:-1]])).any():  # different things of one key
            order = np.lexsort((*made[::-1], keys))
            fresh = self._fresh(made[:, order])
        made, keys = made[:, order], keys[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(fresh) - 1
        return made[:, fresh], slices(by_bucket(keys[fresh], buckets), buckets), np.bincount(at), at

    def messages(self, buckets: int):
        made, parts, times, _ = self._listed(buckets)
        for b, part in parts:
            yield b, squeeze(*made[:, part].astype("<u8"), bits(times[part] > 1))

    def apply(self, r: int, buckets: int, got):
        """Names the new symbols, ends the windows of those that have none, and finds anchors."""
        made, parts, _, at = self._listed(buckets)
        self.h[self.new] = named(parts, got, r, made.shape[1])[at]
        self._drop(self.new & (self.h == 0))
        fine = np.flatnonzero(self._inside() & (self.h > 0))
        s = self.live
        if not fine.size or not s.size:
            return self
        h, lo, hi = mix64(self.h[fine]), self.lo[fine], self.hi[fine]
        begin, end = self._before(lo)[s], self._before(hi)[s + self.window + 1]
        some = np.flatnonzero(end > begin)
        begin, span = begin[some], (end - begin)[some]
        best = begin.copy()
        for j in range(1, int(span.max(initial=0))):
            k = begin + np.minimum(j, span - 1)
            best = np.where(h[k] < h[best], k, best)
        self.anchor[some], self.back[some] = self.h[fine][best], lo[best] - s[some]
        return self


def answer_symbols(payloads) -> list[bytes]:
    """In a bucket: the number of each sent run or pair in the table of those that occur again; 0 for others."""
    parts = [unsqueeze(p) for p in payloads]
    made = np.stack([np.concatenate([np.frombuffer(p[k], "<u8") for p in parts]) for k in range(3)])
    counts = [len(p[0]) // 8 for p in parts]
    twice = np.concatenate([unbits(p[3], n) for p, n in zip(parts, counts, strict=True)])
    order = np.lexsort(made[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (made[:, order[1:]] != made[:, order[:-1]]).any(axis=0)
    group = np.cumsum(fresh) - 1
    again = np.bincount(group, 1 + twice[order]) > 1
    number = np.where(again, np.cumsum(again), 0)
    out = np.empty(len(order), "<u4")
    out[order] = number[group]
    return [x.tobytes() for x in np.split(out, np.cumsum(counts)[:-1])]


class Pieces:
    """Runs of the windows left that have the same anchor: their keys, first windows, numbers of windows, and words joined by one space.

    ids, tie, first: of the block's documents, what orders them and their first words.
    """

    fields = (("ids", "<i8"), ("tie", "<u8"), ("first", "<i8"), ("keys", "<u8"), ("lo", "<i4"), ("n", "<i4"), ("size", "<i4"))

    def __init__(self, window: int):
        self.window = window

    @classmethod
    def of(cls, block: Block, state: State):
        self = cls(state.window)
        starts, ends, self.first = spans(block)
        self.ids, self.tie = block.ids, block.tie
        s = state.live
        place = s + state.back
        new = np.ones(len(s), bool)
        new[1:] = (state.anchor[1:] != state.anchor[:-1]) | (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)
        a = np.flatnonzero(new)
        self.keys, self.lo, self.n = mix64(state.anchor[a]), s[a].astype(np.int64), np.diff(np.append(a, len(s)))
        data, last = block.data.translate(_PLAIN), self.lo + self.n + self.window - 2
        wide = np.cumsum(np.append(0, starts[1:] - ends[:-1] != 1))  # gaps of more than one byte before each word
        cut = zip(starts[self.lo].tolist(), ends[last].tolist(), (wide[last] > wide[self.lo]).tolist(), strict=True)
        self.texts = [b" ".join(data[x:y].split()) if odd else data[x:y] for x, y, odd in cut]
        return self

    @classmethod
    def read(cls, data: bytes, window: int):
        self = cls(window)
        *arrays, text = unsqueeze(data)
        for (name, kind), raw in zip(cls.fields, arrays, strict=True):
            setattr(self, name, np.frombuffer(raw, kind))
        self.lo, self.n = self.lo.astype(np.int64), self.n.astype(np.int64)
        ends = np.cumsum(self.size, dtype=np.int64).tolist()
        self.texts = [text[a:b] for a, b in zip([0, *ends][:-1], ends, strict=True)]
        return self

    def bytes(self) -> bytes:
        self.size = np.array(list(map(len, self.texts)), "<i4")
        return squeeze(*(getattr(self, name).astype(kind) for name, kind in self.fields), b"".join(self.texts))

    def names(self) -> Names:
        return Names(self.keys)


def windows_in(text: bytes, n: int, window: int) -> list[bytes]:
    """The n windows of words joined by one space."""
    at = list(accumulate(map(len, text.split(b" ")), initial=0))
    return [text[at[j] + j : at[j + window] + j + window - 1] for j in range(n)]


class Plan:
    """What a block knows after the round of anchors: which windows are later copies within it, and what it sends."""

    def __init__(self, pieces: Pieces, got, buckets: int):
        again, hot = pieces.names().read(buckets, got)
        self.pieces, seen, late, first = pieces, set(), [], []
        for k in np.flatnonzero(again).tolist():
            t = pieces.texts[k]
            if t in seen:
                late.append(k)
            else:
                seen.add(t)
                first.append(k)
        late, first = np.array(late, np.int64), np.array(first, np.int64)
        crowd, first = first[hot[first]], first[~hot[first]]
        self.first = first[np.argsort(by_bucket(pieces.keys[first], buckets), kind="stable")]
        self.lo, self.n = pieces.lo[self.first], pieces.n[self.first]
        self.parts = list(slices(by_bucket(pieces.keys[self.first], buckets), buckets))
        texts = []
        for k in crowd.tolist():
            texts += windows_in(pieces.texts[k], int(pieces.n[k]), pieces.window)
        self.windows = Windows(texts, windows_of(pieces.lo[crowd], pieces.n[crowd]), buckets)
        self.late = np.concatenate([windows_of(pieces.lo[late], pieces.n[late]), self.windows.later])

    def _docs(self, word):
        return np.searchsorted(self.pieces.first, word, side="right") - 1

    def messages(self):
        """Pieces go to even buckets, single windows to odd ones."""
        for b, part in self.parts:
            own = [self.pieces.texts[k] for k in self.first[part].tolist()]
            doc, at = np.unique(self._docs(self.lo[part]), return_inverse=True)
            size = np.array(list(map(len, own)), "<u4")
            yield 2 * b, squeeze(self.pieces.ids[doc], self.pieces.tie[doc], at.astype("<u4"), self.lo[part].astype("<i8"), self.n[part].astype("<u4"), size, b"".join(own), level=3)
        for b, payload in self.windows.messages(self.pieces, self._docs(self.windows.first)):
            yield 2 * b + 1, payload

    def finish(self, block: Block, got):
        """The result rows of the block's documents."""
        parts, window = [self.late], self.pieces.window
        for b, part in self.parts:
            at = windows_of(self.lo[part], self.n[part])
            parts.append(at[unbits(got[2 * b], len(at))])
        parts.append(self.windows.read(lambda b: got[2 * b + 1]))
        s = np.concatenate(parts)
        starts, ends, first = spans(block)
        edge = np.zeros(len(starts) + window + 1, np.int32)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
        gone = np.cumsum(edge) > 0
        # Runs of kept words that one byte separates are in the text as they are to be.
        kept = ~gone[: len(starts)]
        opens = kept.copy()
        opens[1:] &= ~kept[:-1] | (starts[1:] - ends[:-1] != 1)
        opens[first[:-1][first[:-1] < first[1:]]] = True
        opens &= kept
        run = np.flatnonzero(opens)
        closes = kept & np.append(opens[1:] | ~kept[1:], True)[: len(kept)]
        begins, stops = starts[run].tolist(), ends[np.flatnonzero(closes)].tolist()
        at, left = np.searchsorted(run, first).tolist(), np.cumsum(np.append(0, kept))[first].tolist()
        data = memoryview(block.data.translate(_PLAIN))
        for k in range(len(block)):
            digest = hashlib.sha256()
            for j in range(at[k], at[k + 1]):
                if j > at[k]:
                    digest.update(b" ")
                digest.update(data[begins[j] : stops[j]])
            n = int(first[k + 1] - first[k])
            yield None if block.null[k] else int(block.ids[k]), n, n - (left[k + 1] - left[k]), digest.hexdigest()


def answer_pieces(payloads, window: int = WINDOW) -> list[bytes]:
    """In a bucket of anchors: for each window of each sent piece, whether the same words have an earlier position."""
    parts = [unsqueeze(p) for p in payloads]
    counts = [len(p[3]) // 8 for p in parts]
    ids, tie = (np.concatenate([np.frombuffer(p[k], kind)[np.frombuffer(p[2], "<u4")] for p in parts]) for k, kind in ((0, "<i8"), (1, "<u8")))
    lo, n, size = (np.concatenate([np.frombuffer(p[k], kind) for p in parts]).astype(np.int64) for k, kind in ((3, "<i8"), (4, "<u4"), (5, "<u4")))
    text, ends, out = b"".join(p[6] for p in parts), np.cumsum(size), np.concatenate([[0], np.cumsum(n)])
    late = np.zeros(out[-1], bool)
    order = np.argsort(positions(ids, tie, np.repeat(np.arange(len(parts)), counts), lo))
    pieces, windows = set(), set()
    for k in order.tolist():
        t = text[ends[k] - size[k] : ends[k]]
        if t in pieces:
            late[out[k] : out[k + 1]] = True
            continue
        pieces.add(t)
        for j, w in enumerate(windows_in(t, int(n[k]), window), int(out[k])):
            if w in windows:
                late[j] = True
            else:
                windows.add(w)
    return [bits(late[out[a] : out[b]]) for a, b in zip(np.cumsum([0, *counts[:-1]]).tolist(), np.cumsum(counts).tolist(), strict=True)]


class WordRepeats:
    """The steps, as functions of a block's documents, state and answers."""

    def __init__(self, window: int = WINDOW, rounds: int = ROUNDS):
        self.window, self.rounds = window, rounds

    def begin(self, block, blob, n):
        return begin(Block(block, blob), n)

    def round(self, r, state, got, n):
        """After the answers of round r (0: of words): the string renamed, and what round r + 1 asks."""
        if r:
            now = State.read(state, self.window).collapse(r).apply(r, n, got)
        else:
            now = State.of_words(state, self.window, got)
        yield None, now.bytes()
        if r < self.rounds:
            yield from now.collapse(r + 1).messages(n)

    @staticmethod
    def answer(r):
        return lambda bucket, blocks, payloads: answer_symbols(payloads) if r else answer_words(payloads)

    def pieces(self, block, blob, state, n):
        pieces = Pieces.of(Block(block, blob), State.read(state, self.window))
        yield None, pieces.bytes()
        yield from pieces.names().messages(n, pieces.texts.__getitem__)

    def plan(self, state, got, n):
        return Plan(Pieces.read(state, self.window), got, n)

    def answer_plan(self, bucket, blocks, payloads):
        return answer_windows(payloads) if bucket & 1 else answer_pieces(payloads, self.window)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row for each row of docs."""
    op, scratch = WordRepeats(window, rounds), Scratch(docs.sparkSession, "recompress")
    blocks, total = blocks_of(docs, text, scratch)
    n = max(1, round(total / grown(total, ANCHOR_BYTES, *BUCKET_BYTES)))
    wait = scratch.release if total > WORTH_WAITING else lambda: None
    steps = Steps(scratch, blocks, lambda b, blob: op.begin(b, blob, n), wait)
    for r in range(rounds + 1):
        steps.next(op.answer(r), lambda b, state, got, r=r: op.round(r, state, got, n))
    found = Steps(scratch, steps.states().join(blocks, "block"), lambda b, state, blob: op.pieces(b, blob, state, n))
    scratch.drop(steps.table)
    del steps
    wait()
    got1 = scratch.keep(found.got(lambda b, blocks, payloads: answer_names(payloads)), "got1")
    asked = found.states().join(got1, "block", "left")
    got2 = scratch.keep(ask(asked, lambda b, state, got: op.plan(state, answers(got), n).messages(), op.answer_plan, "got2"), "got2")
    del asked
    wait()
    whole = found.states().join(got1, "block", "left").join(got2, "block", "left").join(blocks, "block")
    whole = whole.select("block", "blob", "state", "got", "got2")
    return each(whole, lambda b, blob, state, g1, g2: op.plan(state, answers(g1), n).finish(Block(b, blob), answers(g2)), COLUMNS)


ORACLE = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS j FROM t),
b AS (SELECT *, w || ' ' || lead(w) OVER o AS w2 FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
c AS (SELECT *, w2 || ' ' || lead(w2, 2) OVER o AS w4 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
d AS (SELECT *, w4 || ' ' || lead(w4, 4) OVER o AS w8 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
e AS (SELECT doc_id, j, w, w8 || ' ' || lead(w8, 8) OVER o || ' ' || lead(w4, 16) OVER o AS k FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
r AS (SELECT doc_id, j, w, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, j) > 1 AS late FROM e),
g AS (SELECT doc_id, j, w, bool_or(late) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) AS n, count_if(gone) AS gone, string_agg(w, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS text FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""
