"""Best-fit packing of tokenised documents into sequences.

Every bin has residual capacities in three dimensions: tokens, pieces (documents) and
attention cost (the sum of squared piece lengths). Pieces are placed in descending
length. Of all open bins that have room in every dimension, the one that is left with
the smallest weighted residual norm (or that has the largest weighted dot product of
demand and residual) takes the piece; where there is none, a bin is opened. All bins are
looked at, as vectors, so the choice is the best one under every constraint. A bin into
which not even the shortest piece fits is closed.

By default the limits on pieces and attention are those that tokens imply (LENGTH pieces
of one token, LENGTH squared), so only tokens bind, but all three residuals take part in
the choice. A binding attention limit also bounds the length of a piece.

Only ids and lengths are shuffled, never texts. Groups of about GROUP pieces are packed
in parallel; the pieces of bins that stay underfilled are packed again together, over
fewer groups, for ROUNDS rounds.

Defined results: a null text is empty and has one token, the end id; only documents
longer than a piece may be are cut, and their first piece is the shorter one; repeated
rows are packed once each; a null doc_id keeps its row, and one that cannot be cast to
long is an error; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH = 2048
END = 0
GROUP = 20_000
ROUNDS = 3
FULL = 0.995
"""Bins filled to less than this share, in each dimension, are packed again."""
WEIGHTS = (1.0, 1.0, 1.0)
"""Of tokens, pieces and attention, each as a share of its capacity."""

_tokenizer = None


def tokenizer(path: str):
    """An encoder of text to ids, one for each worker.

    Ids are those of the ``tokenizers`` file at path. The same vocabulary stands beside
    it as ranks, which encode faster; texts that name a special token of the file go
    through the file itself, as only it treats that token apart.
    """
    global _tokenizer
    if _tokenizer is None or _tokenizer[0] != path:
        import base64
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(path)
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks_file):
            _tokenizer = (path, lambda text: whole.encode(text, add_special_tokens=False).ids)
        else:
            import public_tokenizers

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            special = [t.content for t in whole.get_added_tokens_decoder().values()]

            def encode(text):
                if any(s in text for s in special):
                    return whole.encode(text, add_special_tokens=False).ids
                return fast.encode_ordinary(text)

            _tokenizer = (path, encode)
    return _tokenizer[1]


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens; the first one takes the remainder."""
    first = n if n <= length else n % length or length
    return [(0, first), *((a, length) for a in range(first, n, length))]


def tokenise(docs: DataFrame, path: str, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32) of every piece; row tells repeated rows apart."""

    def run(batches):
        encode = tokenizer(path)
        for batch in batches:
            out = []
            for i, row, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([*encode(t or ""), END], "<u4")
                for k, (a, n) in enumerate(pieces_of(len(ids), length)):
                    out.append((i, row, k, a, n, zlib.crc32(ids[a : a + n].tobytes())))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Bins of one group. left holds the residuals of the open ones, a column for each."""

    def __init__(self, tokens=LENGTH, pieces=None, attention=None, weights=WEIGHTS, rule="norm", least=1):
        """least: the length of the shortest piece that will come."""
        if rule not in ("norm", "dot"):
            raise ValueError("a rule is norm or dot")
        self.cap = np.array([tokens, pieces or tokens, attention or tokens * tokens], float)
        self.scale = np.array(weights, float) / self.cap
        self.rule, self.least = rule, np.array([least, 1, least * least], float)
        self.left, self.number = np.empty((3, 1024)), np.empty(1024, np.int64)
        self.open = self.bins = 0
        self.fill: list[float] = []

    def _score(self, left, need):
        """The smaller the better."""
        if self.rule == "dot":
            return -((self.scale**2 * need) @ left)
        v = (left - need[:, None]) * self.scale[:, None]
        return np.einsum("ij,ij->j", v, v)

    def place(self, n: int) -> tuple[int, int]:
        """The bin and offset that a piece of n tokens gets."""
        need = np.array([n, 1, n * n], float)
        if (need > self.cap).any():
            raise ValueError("a piece exceeds an empty bin")
        left = self.left[:, : self.open]
        room = np.flatnonzero((left[0] >= need[0]) & (left[1] >= 1) & (left[2] >= need[2]))
        k = int(room[self._score(left[:, room], need).argmin()]) if room.size else self._opened()
        b, at = int(self.number[k]), int(self.cap[0] - self.left[0, k])
        self.left[:, k] -= need
        self.fill[b] = float((1 - self.left[:, k] / self.cap).max())
        if (self.left[:, k] < self.least).any():
            self.open -= 1
            self.left[:, k], self.number[k] = self.left[:, self.open], self.number[self.open]
        return b, at

    def _opened(self) -> int:
        if self.open == len(self.number):
            self.left = np.concatenate([self.left, np.empty_like(self.left)], axis=1)
            self.number = np.concatenate([self.number, np.empty_like(self.number)])
        self.left[:, self.open], self.number[self.open] = self.cap, self.bins
        self.fill.append(0.0)
        self.open, self.bins = self.open + 1, self.bins + 1
        return self.open - 1


def _packed(capacities):
    """A function of one group's pieces that adds bin, offset and the share to which the bin is filled."""

    def run(key, t):
        n = t.column("length").to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), t.column("row").to_numpy(), -n))
        packer = Packer(**capacities, least=int(n.min()))
        bins, offsets = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k in order.tolist():
            bins[k], offsets[k] = packer.place(int(n[k]))
        return pa.table(
            {
                "row": t.column("row"),
                "piece": t.column("piece"),
                "length": t.column("length"),
                "bin": pa.array(bins + (int(key[0].as_py()) << 32)),
                "offset": pa.array(offsets),
                "used": pa.array(np.array(packer.fill)[bins]),
            }
        )

    return run


def pack(listed: DataFrame, scratch: Scratch, group: int = GROUP, rounds: int = ROUNDS, **capacities) -> DataFrame:
    """(row, piece, sequence_id, offset) of listed pieces (row, piece, length)."""
    tokens = capacities.get("tokens", LENGTH)
    whole = listed.where(F.col("length") == tokens).select(
        "row", "piece", (F.monotonically_increasing_id() * rounds * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    todo, done = listed.where(F.col("length") < tokens).select("row", "piece", "length"), []
    for k in range(rounds):
        count = todo.count()
        if not count:
            break
        groups = max(1, round(count / group))
        spot = F.pmod(F.xxhash64("row", "piece", F.lit(k)), F.lit(groups))
        bins = scratch.keep(
            todo.withColumn("g", spot)
            .groupBy("g")
            .applyInArrow(_packed(capacities), "row long, piece int, length long, bin long, offset long, used double"),
            f"bins{k}",
        )
        last = k == rounds - 1 or groups == 1
        good = bins if last else bins.where(F.col("used") >= FULL)
        done.append(good.select("row", "piece", (F.col("bin") * rounds * 2 + 2 * k).alias("sequence_id"), "offset"))
        if last:
            break
        todo = bins.where(F.col("used") < FULL).select("row", "piece", "length")
    for d in done:
        whole = whole.unionByName(d)
    return whole


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, text: str = "text", **capacities) -> DataFrame:
    """Every piece of docs with its sequence and its place there."""
    scratch = Scratch(docs.sparkSession, "packing")
    longest = min(length, isqrt(capacities.get("attention") or length * length))
    listed = scratch.keep(tokenise(docs, tokenizer_path, longest, text), "pieces")
    placed = pack(listed, scratch, tokens=length, **capacities)
    return listed.join(placed, ["row", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
