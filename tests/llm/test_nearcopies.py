"""Near copies of the pipeline against all pairs of shingle sets."""

import random

import corpus_pipeline
from idiomill.llm import nearcopies


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_groups(texts):
    """Smallest id reachable over pairs with a Jaccard similarity of 0.8 or more."""
    sets = {i: slow_set(t) for i, t in texts.items()}
    own = {i: i for i in texts}

    def find(a):
        while own[a] != a:
            a = own[a]
        return a

    for a in texts:
        for b in texts:
            if a < b and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    own[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def edited():
    """Originals with copies of 1 to 3 replaced words, a long chain of edits, and texts that share half their words."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for n, edits in ((100, 1), (100, 2), (200, 2), (500, 5), (1000, 10)) * 4:
        words = [word() for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(3):
            new = list(words)
            for k in rng.sample(range(n), edits):
                new[k] = word()
            texts.append(" ".join(new))
    words = [word() for _ in range(200)]
    for _ in range(80):
        words = list(words)
        words[rng.randrange(200)] = word()
        texts.append(" ".join(words))
    half = [word() for _ in range(150)]
    texts += [" ".join(half + [word() for _ in range(100)]) for _ in range(60)]
    return {i: t for i, t in enumerate(texts + ["", None, "One two", "one TWO", "x " * 50])}


def test_edited_copies(spark, sf_dir):
    texts = edited()
    want = slow_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert kept == {i for i, g in want.items() if g == i}
    assert not kept & {i for i in range(80) if i % 4}


def test_simhash_alone(spark, sf_dir, monkeypatch):
    """SimHash blocks find nearly all links of the stage, and none that are wrong; the bands are only for the rest."""
    stated = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(nearcopies, "bands", lambda s: nearcopies.np.zeros(0, int))
    for docs in (spark.createDataFrame(list(edited().items()), "doc_id long, text string"), stated):
        want = slow_groups({r.doc_id: r.text for r in docs.collect()})
        got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, rest=False).collect()}
        assert got.keys() == want.keys()
        assert all(want[g] == want[i] for i, g in got.items())
        copies = [i for i, g in want.items() if g != i]
        assert sum(got[i] == want[i] for i in copies) >= 0.97 * len(copies)
        kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
        assert sum(i in kept for i in copies) <= 0.03 * len(copies)


def test_simhash_distance():
    """The share of bits in which fingerprints differ follows the similarity; equal sets have equal ones."""
    import numpy as np

    rng = np.random.default_rng(4)
    s = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    other = np.concatenate([s[100:], rng.integers(0, 1 << 63, 100).astype(np.uint64)])  # 800 of 1000 in common
    differ = lambda x, y: np.bitwise_count(x ^ y).sum() / (64 * len(x))
    f = nearcopies.wide(s, 64)
    assert (nearcopies.wide(s[::-1], 64) == f).all() and not nearcopies.wide(s[:0], 64).any()
    assert abs(differ(f, nearcopies.wide(other, 64)) - np.arccos(8 / 9) / np.pi) < 0.03
    assert abs(differ(f, nearcopies.wide(rng.integers(0, 1 << 63, 900).astype(np.uint64), 64)) - 0.5) < 0.04


def test_wordy_edits(spark):
    """A group whose members are near the threshold on both sides."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(300), 5 + i % 6):
            words[k] = f"v{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == slow_groups(texts)


def test_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = slow_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == want


def test_rows_that_share_an_id(spark):
    """Of equal rows one stays; null ids come last; columns keep their names."""
    rows = [("a b c d e f", 2, "x"), ("a b c d e f", 2, "x"), ("a b c d e f", 2, "w"), ("A B C D E F", None, "y"), ("q r s", 2, "z"), ("q r s", 9, None), ("u v", None, "n")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, `t.node` string")
    kept = nearcopies.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    got = sorted(((r.text, r.doc_id) for r in kept.collect()), key=str)
    assert got == [("a b c d e f", 2), ("q r s", 2), ("u v", None)]
    assert nearcopies.one_of_each(docs.where("false")).count() == 0


def test_bitmaps_bound_the_difference():
    """The bits in which two bitmaps differ are never more than the hashes in which the sets do, at any lengths."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 20, 100, 700, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 5 + 1).astype(np.uint64)]))
        x, y = nearcopies.bitmap(np.unique(a)).view(np.uint64), nearcopies.bitmap(b).view(np.uint64)
        while len(x) != len(y):
            x, y = (x, y) if len(x) > len(y) else (y, x)
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        assert sum(int(v).bit_count() for v in (x ^ y).tolist()) <= len(np.setxor1d(a, b))
