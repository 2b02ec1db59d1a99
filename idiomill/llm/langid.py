"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and cut into words, the runs of letters. The n-grams of 1 to 3 code
points of each word, with one space before and after it, are hashed into a table; the
space after it is not counted alone, it is that before the next word. Counts of the
training texts, smoothed, give a log-probability matrix (buckets x languages), which is
broadcast; its size is fixed by BUCKETS and the number of learned languages.

A batch of texts is one sparse matrix of counts in row form: the buckets of all its
n-grams, text after text, and where each text begins. Its product with the matrix is a
gather of rows and a sum over each text, taken in stretches of bounded memory; n-grams
that a stretch's end cuts belong to the stretch in which they begin.

The model is fitted on at most MAX_TRAIN documents of each language, chosen by a hash.
Every document is scored on its whole text.

Defined results: a null text, or one without a letter, gives ``und`` and score 0; if
nothing can be learned every text gives that. Ties go to the language that sorts first.
More than MAX_LANGUAGES languages are an error, as the matrix would have no bound. A
document with a null doc_id is not held out. Repeated rows are scored once each. Columns
of docs that are called lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_bucket, mix64

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_TRAIN = 4000
MAX_LANGUAGES = 256
UNKNOWN = "und"
EVIDENCE = 40.0
"""The posterior counts a text's mean evidence as that of so many n-grams."""

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """True for each code point that is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


TOGETHER = 1 << 20
"""Characters of texts that are folded together; a longer text comes alone."""
STRETCH = 1 << 20
"""Matrix cells that are gathered at once for each order."""


def together(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of texts of at most TOGETHER characters, or of one text, each with the number of its first."""
    a = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > a and size + n > TOGETHER:
            yield a, texts[a:k]
            a, size = k, 0
        size += n
    if a < len(texts):
        yield a, texts[a:]


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as code points, a space before each and three at the end; and where each text begins and the last ends."""
    joined = "\0" + "".join((t or "").replace("\0", " ") + "\0" for t in texts)
    points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    begin = np.concatenate([[0], np.cumsum(keep)])[np.flatnonzero(points == 0)]
    return np.concatenate([np.where(letter, points, 32)[keep], [32, 32, 32]]).astype(np.uint64), begin


def grams(points: np.ndarray, a: int, b: int) -> list[np.ndarray]:
    """The buckets of the n-grams that begin in [a, b), one array for each order; BUCKETS where a word is too short for one."""
    code, out = np.zeros(b - a, np.uint64), []
    over = np.zeros(b - a, bool)
    for n in range(1, max(ORDERS) + 1):
        code = code * U64(0x110000) + points[a + n - 1 : b + n - 1]
        if n > 1:  # past the space that ends the word
            over = over | (points[a + n - 2 : b + n - 2] == 32) & (n > 2)
        if n in ORDERS:
            out.append(np.where(over, BUCKETS, (mix64(code + U64(n)) & U64(BUCKETS - 1)).astype(np.int64)))
    return out


def _count(batches):
    total: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for batch in batches:
        by: dict[str, list] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            seen[lang] = seen.get(lang, 0) + len(texts)
            own = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for _, part in together(texts):
                points, begin = folded(part)
                for a in range(0, int(begin[-1]), STRETCH):
                    for g in grams(points, a, min(a + STRETCH, int(begin[-1]))):
                        own += np.bincount(g, minlength=BUCKETS + 1)
    for lang, v in total.items():
        at = np.flatnonzero(v[:BUCKETS])
        rows = {"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(v[at], seen[lang])}
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows), preserve_index=False)


class Model:
    """weights: log probabilities, a row for each bucket."""

    def __init__(self, langs: list[str], weights: np.ndarray, prior: np.ndarray):
        self.langs, self.prior = langs, prior
        self.weights = np.concatenate([weights, np.zeros((1, len(langs)), weights.dtype)])

    def _product(self, texts):
        """For each text, the sum of its n-grams' rows, and their number."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        step = max(1, STRETCH // max(1, len(self.langs)))
        for first, part in together(texts):
            points, begin = folded(part)
            for a in range(0, int(begin[-1]), step):
                b = min(a + step, int(begin[-1]))
                rows = np.flatnonzero((begin[1:] > a) & (begin[:-1] < b) & (begin[1:] > begin[:-1]))
                at = np.maximum(begin[rows] - a, 0)
                for g in grams(points, a, b):
                    total[first + rows] += np.add.reduceat(self.weights[g], at, axis=0, dtype=np.float64)
                    n[first + rows] += np.add.reduceat(g < BUCKETS, at, dtype=np.int64)
        return total, n

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and how likely it is, for each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, n = self._product(texts)
        best = (total + self.prior).argmax(axis=1)
        logit = total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None] + self.prior
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        share = p[np.arange(len(texts)), best] / p.sum(axis=1)
        return [self.langs[k] if m else UNKNOWN for k, m in zip(best, n, strict=True)], np.where(n > 0, share, 0.0)


def fit(train: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model of columns doc_id, text and lang (rows with a null lang are left out)."""
    train = train.where("lang is not null").select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    sizes = dict(train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect())
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the matrix to broadcast would have no bound")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_train / n))))
    # Hashed with the id, so that a text with very many copies is sampled like any other.
    part = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    counted = part.select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    at = {k: i for i, k in enumerate(langs)}
    weights = np.full((BUCKETS, len(langs)), 0.1)
    for row in counted.where("bucket >= 0").toLocalIterator(prefetchPartitions=True):
        weights[row.bucket, at[row.lang]] += row.n
    weights = np.log(weights / weights.sum(axis=0)).astype(np.float32)
    n = np.array([sizes[k] for k in langs], float)
    return Model(langs, weights, np.log(n / n.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, score = shared.value.score(texts.tolist())
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": score})

    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)))
    told = plain.withColumn("guess", guess(F.col(f"_{docs.columns.index(text)}").cast("string")))
    own = (F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("lang_pred", "score"))
    return told.select(*own, "guess.lang_pred", "guess.score")


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; a third of the documents is held out of training."""
    rows = docs.select(
        F.col("doc_id"), "text", "lang", F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    )
    model = fit(rows.where("not held_out"), max_train)
    return predict(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has letters and a language that is at least ``least`` likely."""
    trained = docs.where(~F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)))
    model = fit(trained.select("doc_id", "text", "lang"), MAX_TRAIN)
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)), F.col("text"))
    scored = predict(plain, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return scored.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
