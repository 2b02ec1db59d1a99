"""Quality by co-training of two views.

The content view sees the text: character classes, word shape, repetition and hashed
letter trigrams. The metadata view sees source, language and length of the page. Each
view has a ridge logistic classifier. Over ROUNDS rounds, each classifier labels all
unlabelled texts it is CONFIDENT of, and those join the training set of the *other*
view. Both are then calibrated on labelled rows that took no part in training, and a
logistic of the two calibrated logits scores all documents.

Training uses at most MAX_LABELLED labelled documents, chosen by a hash, and all
unlabelled ones: their features stay in Spark, and each Newton step is one pass that sums
over them. Which pseudo-label a document has follows from the views of the rounds so far,
so no state is kept. Every document is scored on its whole text.

Defined results: null texts count as empty, null source or language is a value of its
own; without both labels every score is the share of good rows (0.5 without labels);
repeated rows are scored once each; of rows that share a doc_id the least one is learned
from if it is labelled, and each of them that differs if it is not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, crc_bucket, mix64
from .toxicity import logistic, sample_of

MAX_LABELLED = 8000
ROUNDS = 4
CONFIDENT = 0.9
STEPS = 25
TRIGRAMS = 64
META = 64


def content(text: str | None) -> np.ndarray:
    """The content view of a text."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = max(len(points), 1)
    words = text.split()
    w = max(len(words), 1)
    lines = text.split("\n")
    kinds = np.array(
        [
            np.count_nonzero((points >= 65) & (points <= 90)) / n,
            np.count_nonzero((points >= 97) & (points <= 122)) / n,
            np.count_nonzero((points >= 48) & (points <= 57)) / n,
            np.count_nonzero(points == 33) / w,
            np.count_nonzero(np.isin(points, [35, 36, 37, 38, 42, 124, 64, 94, 126])) / w,
            np.count_nonzero((points == 44) | (points == 46)) / w,
            np.count_nonzero(points > 127) / n,
            np.log1p(len(words)),
            np.log1p(n / w),
            len(set(words)) / w,
            len(set(lines)) / len(lines),
            np.log1p(len(lines)),
            np.count_nonzero(points == 123) / w + np.count_nonzero(points == 60) / w,
            sum(map(str.isupper, words)) / w,
            float(not words),
        ]
    )
    grams = np.zeros(TRIGRAMS)
    if len(points) >= 3:
        low = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
        code = (low[:-2] * U64(0x110000) + low[1:-1]) * U64(0x110000) + low[2:]
        grams = np.bincount((mix64(code) & U64(TRIGRAMS - 1)).astype(np.int64), minlength=TRIGRAMS) / len(code)
    return np.concatenate([kinds, np.sqrt(grams)])


def metadata(source: str | None, lang: str | None, n_chars) -> np.ndarray:
    """The metadata view of a page: hashed source and language, and its length."""
    import xxhash

    out = np.zeros(META + 3)
    for name, value in (("source", source), ("lang", lang)):
        out[xxhash.xxh64_intdigest(f"{name}={value}", 1) % META] += 1
    n = float(n_chars) if n_chars is not None and n_chars == n_chars else 0.0
    out[META:] = [np.log1p(max(n, 0.0)), np.log1p(max(n, 0.0)) ** 2 / 10, float(n < 200)]
    return out


class View:
    """A standardised logistic classifier with a calibration of its logit."""

    def fit(self, x, y):
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = logistic((x - self.mean) / self.dev, y, ridge=1.0)
        self.slope = (0.0, 1.0)
        return self

    def raw(self, x):
        return self.w[0] + ((x - self.mean) / self.dev) @ self.w[1:]

    def logit(self, x):
        return np.clip(self.slope[0] + self.slope[1] * self.raw(x), -20, 20)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _taken(history, xs):
    """For each view, which rows it is given and with which labels, by the views of all rounds so far."""
    free = np.ones(len(xs[0]), bool)
    given = [(np.zeros(len(free), bool), np.zeros(len(free))) for _ in xs]
    for views in history:
        for k in (0, 1):
            p = _sigmoid(views[k].raw(xs[k]))
            pick = free & (np.maximum(p, 1 - p) >= CONFIDENT)
            free &= ~pick
            mask, label = given[1 - k]
            mask |= pick
            label[pick] = p[pick] >= 0.5
    return [(x[mask], label[mask]) for x, (mask, label) in zip(xs, given, strict=True)]


def _moments(x, y):
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def _newton(x, y, view):
    """Log loss, gradient and Hessian at the view's weights."""
    x = np.column_stack([np.ones(len(x)), (x - view.mean) / view.dev])
    z = np.clip(x @ view.w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    return np.concatenate([[np.sum(np.logaddexp(0, z) - y * z)], x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def _summed(over, history, train, f):
    """f of each view's labelled rows (on the driver) and pseudo-labelled ones (in the pool), summed."""
    own = [f(k, *t) for k, t in enumerate(train)]
    pool = over(lambda xs: np.concatenate([f(k, *t) for k, t in enumerate(_taken(history, xs))]))
    at = np.cumsum([0, *map(len, own)])
    return [v + pool[a:b] for v, a, b in zip(own, at[:-1], at[1:], strict=True)] if pool is not None else own


def _refitted(over, history, train):
    """Views on labelled and pseudo-labelled rows, by Newton steps that are halved where the loss rises."""
    views, ridge = [], 1.0
    for old, m in zip(history[-1], _summed(over, history, train, lambda k, x, y: _moments(x, y)), strict=True):
        v, d = View(), (len(m) - 1) // 2
        v.mean = m[1 : d + 1] / m[0]
        v.dev = np.sqrt(np.maximum(m[d + 1 :] / m[0] - v.mean**2, 0)) + 1e-6
        v.w = np.concatenate([[old.raw(v.mean)], old.w[1:] / old.dev * v.dev])
        v.slope = (0.0, 1.0)
        views.append(v)
    best: list = [None, None]
    for _ in range(STEPS):
        moved = 0.0
        for k, total in enumerate(_summed(over, history, train, lambda k, x, y: _newton(x, y, views[k]))):
            v, d = views[k], len(views[k].w)
            penalty = np.full(d, ridge)
            penalty[0] = 1e-6
            loss = total[0] + (penalty * v.w * v.w).sum() / 2
            if best[k] is not None and loss > best[k][0] * (1 + 1e-9) + 1e-9:
                new = (v.w + best[k][1]) / 2
            else:
                best[k] = (loss, v.w)
                new = v.w + np.linalg.solve(total[d + 1 :].reshape(d, d) + np.diag(penalty + 1e-9), total[1 : d + 1] - penalty * v.w)
            moved = max(moved, np.abs(new - v.w).max())
            v.w = new
        if moved < 1e-4:
            break
    return views


class CoTrained:
    def __init__(self):
        self.views: list[View] = []
        self.mix = np.zeros(3)
        self.share = 0.5

    def fit(self, xs, y, pools, rounds=ROUNDS):
        """xs, pools: the two views of labelled and of unlabelled rows; pools may be a function that sums over them."""
        self.share = float(y.mean()) if len(y) else 0.5
        if len(set(y.tolist())) < 2:
            return self
        over = pools if callable(pools) else lambda f: f(pools)
        order = np.arange(len(y))
        fold = order % 4 == 3
        if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
            fold = np.zeros(len(y), bool)
        train = [[x[~fold], y[~fold]] for x in xs]
        views, history = [View().fit(*t) for t in train], []
        for _ in range(rounds):
            history.append(views)
            views = _refitted(over, history, train)
        check = fold if fold.any() else np.ones(len(y), bool)
        for v, x in zip(views, xs, strict=True):
            v.slope = tuple(logistic(v.raw(x[check])[:, None], y[check]).tolist())
        self.views = views
        self.mix = logistic(np.column_stack([v.logit(x[check]) for v, x in zip(views, xs, strict=True)]), y[check])
        return self

    def predict(self, xs):
        """(score, content score, metadata score) of rows."""
        if not self.views:
            return np.full((len(xs[0]), 3), self.share)
        z = [v.logit(x) for v, x in zip(self.views, xs, strict=True)]
        return np.column_stack([_sigmoid(self.mix[0] + self.mix[1] * z[0] + self.mix[2] * z[1]), *map(_sigmoid, z)])


def _features(df: DataFrame, keep: str = "label") -> DataFrame:
    @F.pandas_udf("content binary, metadata binary")
    def views(text: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "content": [content(t).astype("f4").tobytes() for t in text],
                "metadata": [metadata(s, g, k).astype("f4").tobytes() for s, g, k in zip(source, lang, n, strict=True)],
            }
        )

    return df.select("*", views("text", "source", "lang", "n_chars").alias("v")).select(keep, "v.content", "v.metadata")


def _matrix(rows, name):
    return np.array([np.frombuffer(r[name], "f4") for r in rows], float)


def _pool(docs: DataFrame, named: DataFrame):
    """A function that sums over the two views of all unlabelled documents."""
    scratch = Scratch(docs.sparkSession, "cotrain")
    rows = _features(docs, "doc_id").join(named, F.col("doc_id") == F.col("_id"), "left_anti")
    rows = scratch.keep(rows.dropDuplicates(["doc_id", "content", "metadata"]).select("content", "metadata"), "pool")

    def over(f):
        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    xs = [np.frombuffer(b"".join(c.to_pylist()), "f4").reshape(batch.num_rows, -1).astype(float) for c in batch.columns]
                    part = f(xs)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = [np.frombuffer(r.total) for r in rows.mapInArrow(run, "total binary").collect()]
        return sum(parts) if parts else None

    return over


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    base = docs.select("doc_id", "text", "source", "lang", "n_chars")
    known = sample_of(base, labels, "quality", max_labelled)[0].withColumn("label", F.col("label").cast("double"))
    known = _features(known.select("text", "source", "lang", "n_chars", "label")).collect()
    known.sort(key=lambda r: (r.content, r.metadata))
    if len({r.label for r in known}) < 2:
        return CoTrained().fit([np.zeros((len(known), 1))] * 2, np.array([r.label for r in known], float), [])
    xs = [_matrix(known, v) for v in ("content", "metadata")]
    order = np.random.default_rng(7).permutation(len(known))
    y = np.array([r.label for r in known], float)[order]
    named = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"))
    return CoTrained().fit([x[order] for x in xs], y, _pool(base, named))


def quality(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """(doc_id, held_out, score, content_score, metadata_score, predicted); a fifth of the documents is held out of training."""
    rows = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
    )
    model = fit(rows.where("not held_out"), labels.where(F.coalesce(crc_bucket("doc_id", 5) != 0, F.lit(True))), **limits)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, content_score double, metadata_score double")
    def rate(text: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({"score": [], "content_score": [], "metadata_score": []}, dtype=float)
        xs = [
            np.array([content(t) for t in text]),
            np.array([metadata(*x) for x in zip(source, lang, n, strict=True)]),
        ]
        return pd.DataFrame(shared.value.predict(xs), columns=["score", "content_score", "metadata_score"])

    scored = rows.select("doc_id", "held_out", rate("text", "source", "lang", "n_chars").alias("s")).select("doc_id", "held_out", "s.*")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
