"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding: NFKC and lower case, look-alike letters of other scripts and digits or signs
used as letters are replaced, accents are dropped, punctuation becomes a space. Lexicon
entries are whole words or word stems (they match at the start of a word). They are
learned as those whose document frequency among toxic training texts is far above that
among the others; the weight is the smoothed log ratio. A word pair around an entry that
clean training texts hold and toxic ones do not is an exception phrase: matches inside it
do not count.

The score is a logistic of the matched weight, in total and normalised by length. Labels
come from training rows only, at most MAX_TRAIN of them, chosen by a hash: up to half of
them toxic ones, so that rare ones are learned too, with the intercept corrected for the
shares. Of the sample every word and stem is a candidate, every one that passes MIN_DOCS
and MIN_WEIGHT an entry, and every pair that passes its test an exception, so what the
driver holds is bounded by the sample. Every text is scored whole.

Defined results: null, empty and wordless texts have the score of a text without a
match; without both labels in the training rows every score is near 0, or near 1 if all
are toxic; a doc_id that labels repeats counts once, with its largest label; of rows that
share a doc_id, the one with the least text is learned from; repeated rows are scored
once each; columns of docs that are called score or predicted are replaced by score().
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket

MAX_TRAIN = 16_000
MIN_DOCS = 5
MIN_WEIGHT = 2.5
STEMS = (4, 5, 6, 7)

# Letters of other scripts and signs that are read as Latin letters.
FOLD = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
    "ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
    "@": "a", "$": "s",
}


class _Table(dict):
    """str.translate table that answers for any code point and remembers it."""

    def __missing__(self, code):
        c = chr(code)
        out = FOLD.get(c)
        if out is None:
            if c.isalnum():
                plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
                out = FOLD.get(plain, plain)
            else:
                out = "" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else " "
        self[code] = out
        return out


_table = _Table()


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.translate(_table).split()


def patterns(word: str):
    """Lexicon candidates that a word supports, as substrings of ' word '."""
    yield f" {word} "
    for n in STEMS:
        if n < len(word):
            yield f" {word[:n]}"


def _counter(wanted=None):
    def run(batches):
        names = None if wanted is None else wanted.value
        out: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = {p for w in set(fold(text)) for p in patterns(w)}
                out.update(found if names is None else found & names)
                if len(out) > 300_000:
                    yield _counts(out)
                    out = Counter()
        yield _counts(out)

    return run


def _counts(c):
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["p", "n"])


class Lexicon:
    """Entries and exceptions, and the matcher built of them."""

    def __init__(self, weights: dict[str, float], exceptions: set[tuple[str, str]], coef=(0.0, 0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.coef = weights, exceptions, coef
        self.machine = None

    def build(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for p, w in self.weights.items():
            self.machine.add_word(p, (len(p), w))
        if self.weights:
            self.machine.make_automaton()
        return self

    def matches(self, words: list[str]):
        """(word number, weight) of the best entry at each matched word that no exception covers."""
        if not self.weights or not words:
            return {}
        joined = f" {' '.join(words)} "
        starts: dict[int, float] = {}
        for end, (n, w) in self.machine.iter(joined):
            at = end - n + 1
            if w > starts.get(at, 0.0):
                starts[at] = w
        if len(starts) < 64:
            out = {joined.count(" ", 0, at + 1) - 1: w for at, w in starts.items()}
        else:
            spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
            out = {int(np.searchsorted(spaces, at)): w for at, w in starts.items()}
        pairs = self.exceptions
        if pairs:
            for k in list(out):
                left = k > 0 and (words[k - 1], words[k]) in pairs
                if left or (k + 1 < len(words) and (words[k], words[k + 1]) in pairs):
                    del out[k]
        return out

    def features(self, text: str | None) -> list[float]:
        words = fold(text)
        hits = self.matches(words)
        total = sum(hits.values())
        return [float(bool(hits)), np.log1p(total), total / np.sqrt(len(words) + 1.0)]

    def score(self, text: str | None) -> float:
        z = self.coef[0] + float(np.dot(self.coef[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _exceptions(weights):
    def run(batches):
        lex = Lexicon(weights.value, set()).build()
        out: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text)
                seen = set()
                for k in lex.matches(words):
                    seen |= {(words[j], words[j + 1]) for j in (k - 1, k) if 0 <= j and j + 1 < len(words)}
                out.update((*p, label) for p in seen)
        rows = [(a, b, c, n) for (a, b, c), n in out.items()]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "label", "n"])

    return run


def sample_of(docs: DataFrame, labels: DataFrame, column: str, most: int, even: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """(the columns of docs, label) of at most about ``most`` labelled documents, chosen by a hash of doc_id; rows of each label.

    even: at most half of them, and all if they are fewer, have the rarer label. The labels
    are sampled first. The sample's size is bounded by ``most``, so it is broadcast and no
    text is shuffled but its own. A doc_id counts once, with its largest label and its
    least row.
    """
    named = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(column).cast("int").alias("label"))
    sizes = {r.label: r["count"] for r in named.groupBy("label").count().collect()}
    total = max(sum(sizes.values()), 1)
    share = dict.fromkeys(sizes, most / total)
    if even and len(sizes) == 2:
        rare = min(sizes, key=lambda k: (sizes[k], -k))
        share[rare] = most / 2 / sizes[rare]
        share[1 - rare] = (most - min(most / 2, sizes[rare])) / sizes[1 - rare]
    limit = F.lit(0)
    for label, x in share.items():
        limit = F.when(F.col("label") == label, F.lit(int(min(1.0, x) * (1 << 20)))).otherwise(limit)
    few = named.where(F.pmod(F.xxhash64("_id", F.lit(column)), F.lit(1 << 20)) < limit)
    rows = docs.join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("_id").agg(F.min(F.struct(*docs.columns)).alias("r"), F.first("label").alias("label"))
    return one.select("r.*", "label"), sizes


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Lexicon:
    """A lexicon of documents (doc_id, text) and their labels (doc_id, toxic)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows, known = sample_of(docs.select("doc_id", "text"), labels, "toxic", max_train, even=True)
    sample = scratch.keep(rows.select("text", "label"), "sample")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        share = float(bool(bad))
        return Lexicon({}, set(), (30.0 if share else -30.0, 0.0, 0.0, 0.0))
    toxic = sample.where("label = 1").select("text").mapInArrow(_counter(), "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    counts = dict(toxic.where(F.col("n") >= MIN_DOCS).collect())
    wanted = spark.sparkContext.broadcast(frozenset(counts))
    clean = sample.where("label = 0").select("text").mapInArrow(_counter(wanted), "p string, n long")
    clean = dict(clean.groupBy("p").agg(F.sum("n")).collect())
    found = {p: float(np.log((c + 0.5) / (bad + 1)) - np.log((clean.get(p, 0) + 0.5) / (good + 1))) for p, c in counts.items()}
    weights: dict[str, float] = {}
    for p in sorted((p for p, w in found.items() if w >= MIN_WEIGHT), key=lambda p: (len(p), p)):
        shorter = max((weights.get(p[:k], 0.0) for k in range(3, len(p))), default=0.0)
        if found[p] > shorter + 0.5:
            weights[p] = found[p]
    seen = sample.mapInArrow(_exceptions(spark.sparkContext.broadcast(weights)), "a string, b string, label int, n long")
    pairs = seen.groupBy("a", "b").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n"))
    safe = pairs.where("t = 0 and n >= 3").collect()
    lex = Lexicon(weights, {(r.a, r.b) for r in safe})
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, lex.weights, lex.exceptions))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        own = _built(*shared.value)
        return pd.Series([own.features(t) for t in texts])

    rows = sample.select("label", features("text").alias("x")).collect()
    rows.sort(key=lambda r: (r.label, r.x))
    coef = logistic(np.array([r.x for r in rows]), np.array([r.label for r in rows], float))
    coef[0] += np.log(known.get(1, bad) / known.get(0, good)) - np.log(bad / good)
    lex.coef = tuple(coef.tolist())
    return lex


_last: tuple[str, Lexicon] | None = None


def _built(name: str, *parts) -> Lexicon:
    """The lexicon of that name with its matcher; a worker keeps the last."""
    global _last
    if _last is None or _last[0] != name:
        _last = (name, Lexicon(*parts).build())
    return _last[1]


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, lexicon.weights, lexicon.exceptions, lexicon.coef))

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        own = _built(*shared.value)
        return pd.Series([own.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", rate(F.col(f"`{text}`").cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a fifth of the documents is held out of training."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    lexicon = fit(rows.where(~held), labels.where(~held), max_train)
    scored = score(rows.withColumn("held_out", held), lexicon)
    return scored.select("doc_id", "held_out", "score", "predicted")
