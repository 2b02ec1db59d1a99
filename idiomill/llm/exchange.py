"""Rounds of messages between blocks of documents and buckets of keys.

Documents are gathered, as they come, into blocks of some megabytes and written to the
shared folder. In a round, each block sends a compact message to each bucket of a hashed
key space, and each bucket answers each block. A block names a key once however often it
holds it, so a key that stands in a third of all documents brings a bucket no more than
one entry from each block. Messages are binary columns: a key costs some bytes to ship
rather than a row, and the work on them is done in numpy.

The number of messages is that of blocks times that of buckets. Blocks and buckets
therefore grow with the square root of the input, within limits, so that a message keeps
hundreds of keys up to about a terabyte; beyond that messages become smaller.

Positions are ordered by (doc_id, hash of the text, block, place in the block); null ids
come last. So which of several rows with one doc_id comes first does not depend on where
they are stored, unless they are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch

BLOCK_BYTES = (2 << 20, 16 << 20)
"""Bytes of text of a block, at least and at most."""
WORTH_WAITING = 64 << 20
"""Bytes of text from which on it is worth some seconds to have shuffle files removed between rounds."""
LAST = (1 << 63) - 1
NAME_BYTES = 6
CROWDED = 16
"""An anchor is crowded if a block has more different pieces of it than that,"""
WIDESPREAD = 4096
"""or if more blocks than that have it. So at most CROWDED * WIDESPREAD pieces of an anchor that is not crowded meet."""


_press = {level: zstandard.ZstdCompressor(level=level) for level in (1, 3)}
_open = zstandard.ZstdDecompressor()


def squeeze(*parts, level: int = 1) -> bytes:
    """Byte strings and arrays, compressed together. Numbers are stored byte by byte of all of them, which are more alike."""
    raw, width = [], []
    for p in parts:
        if isinstance(p, bytes):
            raw.append(p)
            width.append(1)
        else:
            p = np.ascontiguousarray(p)
            planes = np.empty((p.itemsize, p.size), np.uint8)
            planes[:] = p.view(np.uint8).reshape(-1, p.itemsize).T  # much faster than .T.tobytes()
            raw.append(planes.data.cast("B") if p.size else b"")
            width.append(p.itemsize)
    head = np.array([len(parts), *map(len, raw), *width], "<u8").tobytes()
    return _press[level].compress(head + b"".join(raw))


def unsqueeze(data: bytes) -> list[bytes]:
    raw = _open.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw[8 : 8 * (2 * n + 1)], "<u8").astype(np.int64)
    ends = np.cumsum(np.concatenate([[8 * (2 * n + 1)], head[:n]])).tolist()
    out = []
    for a, b, width in zip(ends[:-1], ends[1:], head[n:].tolist(), strict=True):
        part = raw[a:b]
        if width == 1:
            out.append(part)
        else:
            whole = np.empty(((b - a) // width, width), np.uint8)
            for k, plane in enumerate(np.frombuffer(part, np.uint8).reshape(width, -1)):
                whole[:, k] = plane
            out.append(whole.tobytes())
    return out


class Block:
    """Documents in order of (doc_id, hash of the text): ids, those hashes, their texts end to end, and the limits of each."""

    def __init__(self, block: int, blob: bytes):
        self.block = block
        ids, tie, null, ends, self.data = unsqueeze(blob)
        self.ids, self.tie, self.null = np.frombuffer(ids, "<i8"), np.frombuffer(tie, "<u8"), np.frombuffer(null, "?")
        self.ends = np.frombuffer(ends, "<i8")
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def __len__(self):
        return len(self.ids)

    @staticmethod
    def pack(rows) -> bytes:
        rows = sorted((i is None, LAST if i is None else i, xxhash.xxh64_intdigest(t), t) for i, t in rows)
        return squeeze(
            np.array([r[1] for r in rows], "<i8"), np.array([r[2] for r in rows], "<u8"), np.array([r[0] for r in rows], "?"),
            np.cumsum([len(r[3]) for r in rows]).astype("<i8"), b"".join(r[3] for r in rows),
        )

    def parts(self, size: int):
        """Ranges [a, b) of documents of about ``size`` bytes, to bound what arrays take."""
        a = 0
        while a < len(self.ids):
            b = int(np.searchsorted(self.starts, self.starts[a] + size, side="left"))
            b = max(a + 1, b)
            yield a, b
            a = b


def _cut(size_of_block):
    def run(batches):
        base, seq, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit():
            return pa.RecordBatch.from_arrays(
                [pa.array([base + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([Block.pack(rows)], pa.binary())],
                names=["block", "bytes", "blob"],
            )

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((i, t or b""))
                size += len(rows[-1][1])
                if size >= size_of_block:
                    yield emit()
                    seq, rows, size = seq + 1, [], 0
        if rows:
            yield emit()

    return run


def grown(total: int, key_bytes: float, least: int, most: int) -> int:
    """Bytes of a block or bucket such that a message between two of that size has some hundred keys, each for key_bytes of text."""
    return int(min(max((total * key_bytes * 256) ** 0.5, least), most))


def blocks_of(docs: DataFrame, text: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(block, blob) of all documents, and their bytes. What the planner knows of the input's size sets that of the blocks, no result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("data"))
    known = min(int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), 1 << 50)
    made = rows.mapInArrow(_cut(grown(2 * known, 40, *BLOCK_BYTES)), "block long, bytes long, blob binary")
    blocks = scratch.keep(made, "blocks", **{"parquet.block.size": str(8 << 20)})
    return blocks.select("block", "blob"), blocks.agg(F.sum("bytes")).first()[0] or 0


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def batch(rows, columns):
    """rows as a record batch of (name, type) columns."""
    cols = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, columns, strict=True)], names=[n for n, _ in columns])


def schema(columns) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns)


def each(df: DataFrame, f, columns) -> DataFrame:
    """The rows (tuples of columns) that f yields for each row of df; one row is in memory at once."""

    def run(batches):
        for part in batches:
            for i in range(part.num_rows):
                yield batch(list(f(*(c[i].as_py() for c in part.columns))), columns)

    return df.mapInArrow(run, schema(columns))


SENT = [("bucket", "long"), ("block", "long"), ("payload", "binary")]
ANSWER = [("block", "long"), ("bucket", "long"), ("answer", "binary")]


def ask(df: DataFrame, send, answer, name: str) -> DataFrame:
    """(block, name): for each block the buckets' answers to what send(block, ...) yields, (bucket, payload), for a row of df."""
    return told(each(df, lambda block, *rest: ((b, block, p) for b, p in send(block, *rest)), SENT), answer, name)


def told(said: DataFrame, answer, name: str) -> DataFrame:
    """(block, name): for each block the buckets' answers to messages. answer(bucket, blocks, payloads) gives one for each payload."""

    def run(key, t):
        bucket, blocks = key[0].as_py(), t.column("block").to_pylist()
        order = sorted(range(len(blocks)), key=blocks.__getitem__)
        payloads = t.column("payload").to_pylist()
        got = answer(bucket, [blocks[k] for k in order], [payloads[k] for k in order])
        return pa.Table.from_batches([batch([(blocks[k], bucket, a) for k, a in zip(order, got, strict=True)], ANSWER)])

    out = said.groupBy("bucket").applyInArrow(run, schema(ANSWER))
    return out.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))


STEP = [("block", "long"), ("state", "binary"), ("bucket", "long"), ("payload", "binary")]


class Steps:
    """Rounds in which a block keeps a state, so that its documents need not be read again.

    In a step, f yields for a block its new state, (None, state), and its messages to
    buckets, (bucket, payload). Both are written to the shared folder.
    """

    def __init__(self, scratch: Scratch, df: DataFrame, f, wait=lambda: None):
        self.scratch, self.wait = scratch, wait
        self.table = self._made(df, f)

    def _made(self, df, f):
        rows = each(df, lambda block, *rest: ((block, p, None, None) if b is None else (block, None, b, p) for b, p in f(block, *rest)), STEP)
        return self.scratch.keep(rows, "step", **{"parquet.block.size": str(8 << 20)})

    def states(self) -> DataFrame:
        return self.table.where("state is not null").select("block", "state")

    def got(self, answer) -> DataFrame:
        """(block, got): the answers to the messages of the last step."""
        return told(self.table.where("bucket is not null").select("bucket", "block", "payload"), answer, "got")

    def next(self, answer, f) -> None:
        """The next step: f(block, state, answers)."""
        both = self.states().join(self.got(answer), "block", "left").select("block", "state", "got")
        new = self._made(both, lambda block, state, got: f(block, state, answers(got)))
        self.scratch.drop(self.table)
        self.table = new
        del both
        self.wait()


def answers(cell) -> dict[int, bytes]:
    """What ask() gave a block, by bucket."""
    return {x["bucket"]: x["answer"] for x in cell or ()}


def by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, rising with the key."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def slices(where: np.ndarray, buckets: int):
    """(bucket, slice) of the parts of a rising array of buckets."""
    cut = np.searchsorted(where, np.arange(buckets + 1))
    for b in np.unique(where).tolist():
        yield b, slice(int(cut[b]), int(cut[b + 1]))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def positions(ids, tie, own, place) -> np.ndarray:
    """The rank of each of many places in the order of positions. own: the rank of its block."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((place, own, tie, ids))] = np.arange(len(ids))
    return rank


class Names:
    """The anchors of a block's pieces. A name is 48 bits of a piece's key; keys that share one are treated alike."""

    def __init__(self, keys: np.ndarray):
        self.names, self.at, self.counts = np.unique(keys >> U64(16), return_inverse=True, return_counts=True)

    def crowded(self, text) -> np.ndarray:
        """For each name, whether more than CROWDED different pieces have it. text: gives a piece by its number."""
        out = np.zeros(len(self.names), bool)
        many = np.flatnonzero(self.counts[self.at] > CROWDED)
        found: dict[int, set[bytes]] = {}
        for k, name in zip(many.tolist(), self.at[many].tolist(), strict=True):
            if not out[name]:
                texts = found.setdefault(name, set())
                texts.add(text(k))
                out[name] = len(texts) > CROWDED
        return out

    def messages(self, buckets: int, text):
        """The distinct names, and whether each is crowded here."""
        crowded = self.crowded(text)
        for b, part in slices(by_bucket(self.names << U64(16), buckets), buckets):
            packed = self.names[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()
            yield b, np.array([part.stop - part.start], "<u4").tobytes() + packed + bits(crowded[part])

    def read(self, buckets: int, got: dict[int, bytes]):
        """(repeated, crowded) of each piece, from the answers; a name that the block has twice is repeated."""
        again, hot = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        for b, part in slices(by_bucket(self.names << U64(16), buckets), buckets):
            n = part.stop - part.start
            two = unbits(got[b], 2 * n)
            again[part], hot[part] = two[:n], two[n:]
        return (again | (self.counts > 1))[self.at], hot[self.at]


def answer_names(payloads) -> list[bytes]:
    """In a bucket: two bits for each name, repeated and crowded."""
    names, crowded = [], []
    for p in payloads:
        n = int.from_bytes(p[:4], "little")
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :NAME_BYTES] = np.frombuffer(p, np.uint8, n * NAME_BYTES, 4).reshape(n, NAME_BYTES)
        names.append(raw.reshape(-1).view("<u8"))
        crowded.append(unbits(p[4 + n * NAME_BYTES :], n))
    found, at, counts = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    hot = (np.bincount(at, np.concatenate(crowded), len(found)) > 0) | (counts > WIDESPREAD)
    out, a = [], 0
    for n in map(len, names):
        k = at[a : a + n]
        out.append(bits(np.concatenate([counts[k] > 1, hot[k]])))
        a += n
    return out


class Windows:
    """The distinct windows of a block, told apart by their bytes, each sent whole. later: where repeated ones start."""

    def __init__(self, texts: list[bytes], place: np.ndarray, buckets: int):
        """place: where each window starts, rising in the order of positions."""
        seen: dict[bytes, int] = {}
        again = []
        for t, p in zip(texts, place.tolist(), strict=True):
            if seen.setdefault(t, p) != p:
                again.append(p)
        self.later = np.array(again, np.int64)
        self.texts = list(seen)
        keys = np.array([xxhash.xxh3_64_intdigest(t) for t in self.texts], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.texts = [self.texts[k] for k in order.tolist()]
        self.first = np.array(list(seen.values()), np.int64)[order]
        self.parts = list(slices(by_bucket(keys[order], buckets), buckets))

    def messages(self, block, doc: np.ndarray):
        """block: has ids and tie of documents; doc: the number of the document of each first window."""
        for b, part in self.parts:
            texts = self.texts[part]
            own, at = np.unique(doc[part], return_inverse=True)
            yield b, squeeze(np.array([len(t) for t in texts], "<u4"), b"".join(texts), block.ids[own], block.tie[own], at.astype("<u4"))

    def read(self, got) -> np.ndarray:
        """Where first windows start that have an equal one in an earlier block. got: answers by bucket."""
        late = [self.first[part][unbits(got(b), part.stop - part.start)] for b, part in self.parts]
        return np.concatenate([np.empty(0, np.int64), *late])


def answer_windows(payloads) -> list[bytes]:
    """In a bucket: for each sent window, whether an equal one has an earlier position. Payloads are in order of their blocks."""
    texts, ids, tie, own, counts = [], [], [], [], []
    for k, p in enumerate(payloads):
        size, data, i, t, at = unsqueeze(p)
        ends = np.cumsum(np.frombuffer(size, "<u4")).tolist()
        texts += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        at = np.frombuffer(at, "<u4")
        ids.append(np.frombuffer(i, "<i8")[at])
        tie.append(np.frombuffer(t, "<u8")[at])
        own.append(np.full(len(at), k))
        counts.append(len(at))
    ids, tie, own = map(np.concatenate, (ids, tie, own))
    late, seen = np.zeros(len(texts), bool), set()
    for k in np.lexsort((own, tie, ids)).tolist():
        if texts[k] in seen:
            late[k] = True
        else:
            seen.add(texts[k])
    return [bits(x) for x in np.split(late, np.cumsum(counts)[:-1])]
