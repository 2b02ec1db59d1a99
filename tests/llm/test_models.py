"""Scores, lines, leaks and packing."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from idiomill.llm import cotrain, decontam, langid, linededup, packing, queries, toxicity


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def auc(labels, scores):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    labels = np.array(labels)
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


MEDIUM = "/root/testdata/sf0.01"


def test_language_on_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op7_language_id(spark, MEDIUM).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(truth)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", None, 1), (2, "der Hund und die Katze", "de", None, 1), (3, None, "en", None, 0), (4, "123 !!", None, None, 0), (6, "", None, None, 0), (None, "und die", None, None, 0)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows * 2)).collect()}
    assert {got[i].lang_pred for i in (3, 4, 6)} == {"und"} and len(got) == 6
    kept = langid.keep_identified(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and all(r.doc_id not in (3, 4, 6) for r in kept.collect())
    assert langid.identify(frame(spark, [])).count() == 0
    bare = langid.identify(frame(spark, [(1, "abc", None, None, 1)])).first()
    assert (bare.lang_pred, bare.score) == ("und", 0.0)


def plain_grams(text):
    """The hashed n-grams of a text, by a loop over its words."""
    def bucket(gram):
        x = 0
        for c in gram:
            x = x * 0x110000 + ord(c)
        x = (x + len(gram)) & (1 << 64) - 1
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = ((x ^ x >> shift) * factor) & (1 << 64) - 1
        return x & langid.BUCKETS - 1

    out, words = [], "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for w in words:
        padded = f" {w} "
        out += [bucket(padded[a : a + n]) for n in (1, 2, 3) for a in range(len(padded) - n + 1) if (n, a) != (1, len(w) + 1)]
    return out


def test_language_against_plain_bayes(spark, sf_dir):
    """Fit and scores of the query against counts in dictionaries and a loop over languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, sizes = {}, {}
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            sizes[r.lang] = sizes.get(r.lang, 0) + 1
            own = counts.setdefault(r.lang, {})
            for g in plain_grams(r.text):
                own[g] = own.get(g, 0) + 1
    langs = sorted(sizes)
    whole = {k: sum(counts[k].values()) + 0.1 * langid.BUCKETS for k in langs}
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf_dir).collect()}
    for r in docs:
        grams = plain_grams(r.text)
        if not grams:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        prior = {k: np.log(sizes[k] / sum(sizes.values())) for k in langs}
        total = {k: sum(np.log((counts[k].get(g, 0) + 0.1) / whole[k]) for g in grams) for k in langs}
        assert got[r.doc_id].lang_pred == max(langs, key=lambda k: total[k] + prior[k])
        logit = {k: total[k] * min(1, langid.EVIDENCE / len(grams)) + prior[k] for k in langs}
        best = got[r.doc_id].lang_pred
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp(logit[k] - logit[best]) for k in langs), abs=1e-4)


def test_language_in_stretches(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé \n.,\0ß") for _ in range(rng.randint(0, 900))) for _ in range(30)] + [None, "", "...", "x" * 2000, "a b c"]
    model = langid.Model(["a", "b"], np.random.default_rng(1).random((langid.BUCKETS, 2)).astype("f4"), np.zeros(2))
    want = model._product(texts)
    for k, t in enumerate(texts):
        g = plain_grams((t or "").replace("\0", " "))
        assert want[1][k] == len(g) and np.allclose(want[0][k], model.weights[g].sum(axis=0, dtype=float))
    monkeypatch.setattr(langid, "STRETCH", 50)
    monkeypatch.setattr(langid, "TOGETHER", 70)
    got = model._product(texts)
    assert np.array_equal(got[1], want[1]) and np.allclose(got[0], want[0])


def test_language_columns(spark):
    docs = spark.createDataFrame([("the cat", 1, "en", 0.5, "x", "y")], "text string, doc_id long, lang string, score double, lang_pred string, `a.b` string")
    out = langid.predict(docs, langid.fit(docs.select("doc_id", "text", "lang")))
    assert out.columns == ["text", "doc_id", "lang", "a.b", "lang_pred", "score"] and out.first().lang_pred == "en"
    assert langid.keep_identified(docs).columns == docs.columns


def plain_toxicity(lexicon, text):
    """The score of a text by looking for every entry at every word."""
    words = toxicity.fold(text)
    hits = {}
    for k, w in enumerate(words):
        found = [v for p, v in lexicon.weights.items() if (p.strip() == w if p.endswith(" ") else w.startswith(p[1:]))]
        around = {tuple(words[j : j + 2]) for j in (k - 1, k) if 0 <= j < len(words) - 1}
        if found and not around & lexicon.exceptions:
            hits[k] = max(found)
    total = sum(hits.values())
    x = (float(bool(hits)), np.log1p(total), total / np.sqrt(len(words) + 1))
    return 1 / (1 + np.exp(-np.clip(lexicon.coef[0] + np.dot(lexicon.coef[1:], x), -30, 30)))


def test_toxicity_against_plain_search(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.weights and lexicon.coef[0] < 0
    small = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for r in toxicity.score(small, lexicon).collect():
        assert r.score == pytest.approx(plain_toxicity(lexicon, r.text), abs=1e-9)


def test_rare_toxic_labels(spark):
    """Where one label in 500 is toxic, a small sample still holds toxic texts, and the scores keep the shares."""
    rows = [(i, f"you filthy {'snark' if i % 500 == 0 else 'window'} number {i}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 500 == 0)) for i, _ in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, max_train=400)
    assert any("snar" in p for p in lexicon.weights)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[i] == (i % 500 == 0) for i in got)


def test_toxicity_on_held_out(spark):
    large = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    got = queries.op6_toxicity(spark, large).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert auc([labels[r.doc_id] for r in held], [r.score for r in held]) > 0.93
    assert np.mean([labels[r.doc_id] == r.predicted for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_folding():
    assert toxicity.fold("1d10T! Іdıоt, ídïót") == ["idiot", "idiot", "idiot"]
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("!? ") == []


def test_exceptions_and_stems():
    lex = toxicity.Lexicon({" kill": 3.0, " scum ": 4.0}, {("pond", "scum")}).build()
    assert lex.matches("a killer scum".split()) == {1: 3.0, 2: 4.0}
    assert lex.matches("pond scum".split()) == {}
    assert lex.matches(["overkill"]) == {}
    many = "scum x " * 100
    assert sorted(lex.matches(many.split())) == list(range(0, 200, 2))


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, None, None, None, 0), (2, "", None, None, 0), (2, "", None, None, 0)])
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert toxicity.toxicity(docs, none).count() == 3
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.where("false"), none).count() == 0


def test_quality_on_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    held = [r for r in queries.op3_cotraining(spark, MEDIUM).collect() if r.held_out and r.doc_id in labels]
    assert auc([labels[r.doc_id] for r in held], [r.score for r in held]) > 0.9


def test_quality_edges(spark):
    docs = frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in cotrain.quality(docs, none).collect()] == [0.5] * 3
    assert cotrain.quality(docs.where("false"), none).count() == 0


def test_pseudo_labels_reach_the_other_view():
    """A word that only unlabelled texts show is learned through the metadata view."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 80).astype(float)
    meta = np.column_stack([y + rng.normal(0, 0.05, 80), rng.normal(size=80)])
    text = np.column_stack([rng.normal(size=80), np.zeros(80)])
    hidden = rng.integers(0, 2, 400).astype(float)
    pools = [np.column_stack([rng.normal(size=400), hidden]), np.column_stack([hidden + rng.normal(0, 0.05, 400), rng.normal(size=400)])]
    model = cotrain.CoTrained().fit([text, meta], y, pools)
    assert np.argmax(np.abs(model.views[0].w[1:] / model.views[0].dev)) == 1


def test_all_confident_rows_are_exchanged():
    """A word of a few pool rows, each less sure than thousands of others, is learned all the same."""
    rng = np.random.default_rng(4)
    y = np.arange(200) % 2.0
    meta, text = (y + rng.normal(0, 0.1, 200))[:, None], np.column_stack([rng.normal(size=200), np.zeros(200)])
    hidden, rare = np.arange(6000) % 2.0, np.arange(6000) % 100 == 1
    pools = [np.column_stack([rng.normal(size=6000), rare]), np.where(rare, 0.9, hidden * 1.4 - 0.2)[:, None]]
    view = cotrain.CoTrained().fit([text, meta], y, pools).views[0]
    assert view.w[2] / view.dev[1] > 1


def plain_cotraining(xs, y, pools, rounds):
    """Scores by a loop that puts labelled and pseudo-labelled rows together and fits each view anew."""
    fold = np.arange(len(y)) % 4 == 3
    train = [(x[~fold], y[~fold]) for x in xs]
    given = [([], []) for _ in xs]
    free = np.ones(len(pools[0]), bool)
    views = [cotrain.View().fit(*t) for t in train]
    for _ in range(rounds):
        taken = []
        for k in (0, 1):
            p = 1 / (1 + np.exp(-views[k].raw(pools[k])))
            for i in np.flatnonzero(free):
                if max(p[i], 1 - p[i]) >= cotrain.CONFIDENT and i not in taken:
                    taken.append(i)
                    given[1 - k][0].append(pools[1 - k][i])
                    given[1 - k][1].append(float(p[i] >= 0.5))
        free[taken] = False
        views = []
        for (x, t), (more, labels) in zip(train, given, strict=True):
            views.append(cotrain.View().fit(np.concatenate([x, np.array(more).reshape(-1, x.shape[1])]), np.concatenate([t, labels])))
    for v, x in zip(views, xs, strict=True):
        v.slope = tuple(toxicity.logistic(v.raw(x[fold])[:, None], y[fold]))
    mix = toxicity.logistic(np.column_stack([v.logit(x[fold]) for v, x in zip(views, xs, strict=True)]), y[fold])
    z = [v.logit(x) for v, x in zip(views, pools, strict=True)]
    return 1 / (1 + np.exp(-(mix[0] + mix[1] * z[0] + mix[2] * z[1])))


def test_cotraining_against_a_plain_loop():
    rng = np.random.default_rng(11)
    truth = rng.integers(0, 2, 900).astype(float)
    xs = [np.column_stack([truth + rng.normal(0, s, 900), rng.normal(size=900), truth * 0.5 + rng.normal(size=900)]) for s in (0.5, 0.7)]
    y, known = truth[:200], [x[:200] for x in xs]
    pools = [x[200:] for x in xs]
    for rounds in (1, 4):
        model = cotrain.CoTrained().fit(known, y, pools, rounds)
        assert np.allclose(model.predict(pools)[:, 0], plain_cotraining(known, y, pools, rounds), atol=2e-3)


def test_pool_sums_in_spark(spark):
    docs = frame(spark, [(i, f"text {i} " * (i % 7), "en", "s", i) for i in range(40)])
    count = lambda xs: np.array([len(xs[0]), xs[0].sum(), xs[1].sum()])
    named = spark.createDataFrame([(i,) for i in range(0, 40, 4)], "_id long")
    total = cotrain._pool(docs.union(docs), named)(count)
    rows = [(f"text {i} " * (i % 7), i) for i in range(40) if i % 4]
    want = [30, sum(cotrain.content(t).sum() for t, _ in rows), sum(cotrain.metadata("s", "en", n).sum() for _, n in rows)]
    assert np.allclose(total, want, rtol=1e-4)


def test_lines(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(map(tuple, con.sql(f"SELECT doc_id, n_lines, n_removed, text FROM ({linededup.ORACLE})").fetchall()))
    assert sorted(tuple(r) for r in queries.op5_line_dedup(spark, sf_dir).collect()) == want


def test_line_edges(spark):
    rows = [(1, "a\n\n b \nc\nd"), (2, "x\na\nb\n\nc\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "q\nq\nq\nq\nq"), (None, "a\nb\nc"), (7, "x\na\nb\nc")]
    docs = spark.createDataFrame([(t, i, "z") for i, t in rows] * 2, "text string, doc_id long, id string")
    out = linededup.dedup_lines(docs)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert out.columns[:3] == ["text", "doc_id", "id"]
    assert got[::2] == got[1::2]  # equal rows get the same text
    assert set(got) == {
        (1, "a\n\n b \nc\nd", 4, 0), (2, "x\n\ny", 5, 3), (3, None, 0, 0), (4, "", 0, 0), (5, "a\nb", 2, 0), (6, "q", 5, 4),
        (None, "", 3, 3), (7, "", 4, 4),
    }
    assert linededup.dedup_lines(docs.where("false")).count() == 0
    odd = docs.selectExpr("text", "doc_id", "id as __id", "id as __t", "id as __gone", "id as __lines", "id as gone", "id as lines", "id as `a.b`", "id as _0")
    assert linededup.dedup_lines(odd).columns == [*odd.columns, "n_lines", "n_removed"]
    assert sorted(map(str, linededup.without_repeats(odd).select("doc_id", "text").collect())) == sorted(map(str, out.select("doc_id", "text").collect()))


def test_hot_lines(spark, monkeypatch):
    """A window in most of the documents gives the same on either way."""
    rows = [(i, f"a\nb\nc\nd{i % 7}\ne") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(linededup.dedup_lines(docs).collect())
    plain = linededup._later
    monkeypatch.setattr(linededup, "_later", lambda spread, first, place: plain(spread, first.withColumn("n", first["n"] * 10_000), place))
    assert sorted(linededup.dedup_lines(docs).collect()) == want
    assert [r.n_removed for r in want[:8]] == [0] + [3] * 6 + [5]


ITEM = " ".join(f"word{k}" for k in range(40))


def test_leaks(spark):
    words = ITEM.split()
    swapped = " ".join("zzz" if k % 6 == 5 else w for k, w in enumerate(words))
    docs = [(1, f"pre {ITEM.upper()}, post"), (2, f"x y {swapped} q"), (3, " ".join(words[:12])), (4, " ".join(reversed(words))), (5, None), (6, ""), (7, "the cat"), (8, " ".join(words[5:30]))]
    bench = [(10, ITEM), (11, None), (12, ""), (13, "tiny item"), (14, "the cat")]
    d = spark.createDataFrame([(t, i, "k") for i, t in docs], "text string, doc_id long, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (500_000, 30):
        got = {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b, block).collect()}
        assert got == {(1, 10), (2, 10), (8, 10), (7, 14)}
        kept = decontam.without_overlaps(d, b, block)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == d.columns
    assert decontam.overlaps(d.where("false"), b).count() == 0
    assert decontam.overlaps(d, b.where("false")).count() == 0


def plain_overlaps(docs, items):
    """Every item laid over every document at every diagonal; the best place of each that counts."""
    out = set()
    for i, text in docs:
        words = decontam.words_of(text)
        at = {}
        for p, w in enumerate(words):
            at.setdefault(w, []).append(p)
        for k, item in items:
            own, best = decontam.words_of(item), None
            w = min(len(own), decontam.WINDOW)
            for d in sorted({p - j for j, x in enumerate(own) for p in at.get(x, ())}):
                a, b = max(0, d), min(len(words), d + len(own))
                same = [words[p] == own[p - d] for p in range(a, b)]
                top = max((sum(same[p : p + w]) for p in range(len(same) - w + 1)), default=0)
                if w and 5 * top >= 4 * w:
                    row = (sum(same), -d, a, b - a, top / w)
                    best = max(best, row) if best else row
            if best:
                out.add((i, k, best[2], best[0], best[3], best[4]))
    return out


def test_overlaps_against_all_diagonals(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {tuple(r) for r in queries.op10_decontamination(spark, sf_dir).collect()}
    assert got == plain_overlaps([tuple(r) for r in docs], [(r.item_id, r.text) for r in items])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert set(con.sql(decontam.ORACLE).fetchall()) == got


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_no_overlap_is_lost(chunk, monkeypatch):
    """Items of 1 to 30 words with replaced words, texts that repeat themselves, and seeds that many items share."""
    monkeypatch.setattr(decontam, "CHUNK", chunk)
    rng = random.Random(2)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 31)]
    items += [(40, "a " * 20), (41, "a b " * 15), (42, "common words at the start of it " + "own " * 8), (43, "common words at the start of it " + "other words " * 5)]
    docs = []
    for i in range(200):
        words = [f"o{rng.randrange(10**6)}" for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(1, 3)):
            words += [w if rng.random() > 0.12 else "sub" for w in rng.choice(items)[1].split()]
        docs.append((i, " ".join(words)))
    docs += [(300, "a " * 60), (301, "b a " * 30), (302, "a b " * 8 + "a " * 30), (303, "common words at the start of it " * 4)]
    index = decontam.Index(items)
    got = {(i, *row) for i, t in docs for row in index.find(t)}
    assert got == plain_overlaps(docs, items)


def test_a_text_that_repeats_itself():
    import time

    index = decontam.Index([(1, "word " * 500), (2, "one two three " * 200)])
    began = time.time()
    assert [r[0] for r in index.find("word " * 20_000)] == [1] and [r[0] for r in index.find("one two three " * 6000)] == [2]
    assert time.time() - began < 5


def test_pieces():
    assert packing.pieces_of(1) == [(0, 1)]
    assert packing.pieces_of(2048) == [(0, 2048)]
    assert packing.pieces_of(2049) == [(0, 1), (1, 2048)]
    assert packing.pieces_of(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    p = packing.Packer(tokens=100, pieces=4, attention=4000, rule=rule) if max(lengths) ** 2 <= 4000 else packing.Packer(tokens=100, pieces=4, rule=rule)
    bins = {}
    for n in lengths:
        b, at = p.place(n)
        assert at == sum(bins.get(b, []))
        bins.setdefault(b, []).append(n)
    for sizes in bins.values():
        assert sum(sizes) <= 100 and len(sizes) <= 4 and sum(n * n for n in sizes) <= p.cap[2]
    with pytest.raises(ValueError, match="exceeds"):
        packing.Packer(tokens=10, attention=50).place(9)


def plain_best_fit(lengths, cap, rule):
    """Bins of a plain loop over all bins; residuals as a share of each capacity."""
    bins = []
    for n in sorted(lengths, reverse=True):
        need, best = (n, 1, n * n), None
        for b in bins:
            if all(x >= y for x, y in zip(b, need, strict=True)):
                if rule == "dot":
                    v = -sum(x * y / c / c for x, y, c in zip(b, need, cap, strict=True))
                else:
                    v = sum(((x - y) / c) ** 2 for x, y, c in zip(b, need, cap, strict=True))
                if best is None or v < best[0]:
                    best = (v, b)
        if best is None:
            bins.append([c - y for c, y in zip(cap, need, strict=True)])
        else:
            best[1][:] = [x - y for x, y in zip(best[1], need, strict=True)]
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{"attention": 1_200_000}, {"pieces": 6, "attention": 1_000_000}, {"pieces": 3}, {}])
def test_binding_capacities(limits, rule):
    rng = random.Random(8)
    lengths = [rng.randint(1, 1000) for _ in range(1500)]
    cap = (2048, limits.get("pieces", 2048), limits.get("attention", 2048**2))
    p = packing.Packer(**limits, rule=rule, least=min(lengths))
    bins = {}
    for n in sorted(lengths, reverse=True):
        bins.setdefault(p.place(n)[0], []).append(n)
    for own in bins.values():
        assert sum(own) <= cap[0] and len(own) <= cap[1] and sum(n * n for n in own) <= cap[2]
    want = plain_best_fit(lengths, cap, rule)
    assert abs(len(bins) - want) <= 0.005 * want  # equal scores may be told apart in another order
    assert len(bins) <= 1.1 * max(sum(lengths) / cap[0], len(lengths) / cap[1], sum(n * n for n in lengths) / cap[2]) + 1


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    seqs = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    return len(seqs), -(-sum(map(len, ids.values())) // 2048)


def test_packing(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used, least = check_packing(queries.op1_best_fit_packing(spark, sf_dir).collect(), texts)
    assert used <= least + 2


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|> said", 4: "word " * 9000, 5: "é\x00"}
    docs = frame(spark, [(i, t, None, None, 0) for i, t in texts.items()])
    rows = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    used, least = check_packing(rows, texts)
    assert used == least and len({r.doc_id for r in rows}) == 5
    assert packing.pack_documents(docs.where("false"), queries.tokenizer_path()).count() == 0
    twice = packing.pack_documents(docs.unionByName(docs), queries.tokenizer_path()).collect()
    assert len(twice) == 2 * len(rows)
    short = packing.pack_documents(docs, queries.tokenizer_path(), pieces=2, attention=1_000_000).collect()
    seqs = {}
    for r in short:
        seqs.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(x) <= 2 and sum(n * n for n in x) <= 1_000_000 for x in seqs.values())


def test_groups_are_packed_again(spark):
    from idiomill.llm.common import Scratch

    rng = random.Random(4)
    rows = [(k, 0, rng.choice([40, 700, 1100, 1300])) for k in range(4000)]
    pieces = spark.createDataFrame(rows, "row long, piece int, length long")
    got = packing.pack(pieces, Scratch(spark, "test"), group=500).collect()
    assert len(got) == 4000
    size = {k: n for k, _, n in rows}
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, size[r.row]))
    assert all(sum(n for _, n in s) <= 2048 for s in seqs.values())
