"""Repeated strings and word windows against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idiomill.llm import exchange, recompress, suffix
from idiomill.llm.exchange import Block


def brute_bytes(docs, length=100):
    seen, out = set(), []
    for i, t in sorted(docs):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(docs, window=20):
    seen, out = set(), []
    for i, t in sorted(docs):
        words = t.split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def routed(messages, f):
    """The answers to messages (bucket, block, payload), by block and bucket."""
    by, got = {}, {}
    for b, k, p in messages:
        by.setdefault(b, []).append((k, p))
    for b, rows in by.items():
        rows.sort(key=lambda r: r[0])
        for (k, _), x in zip(rows, f(b, [k for k, _ in rows], [p for _, p in rows]), strict=True):
            got.setdefault(k, {})[b] = x
    return got


def blobs(docs, blocks):
    parts = [docs[k::blocks] for k in range(blocks)]
    return [(k, Block.pack(p)) for k, p in enumerate(parts) if p]


def simulated(op, docs, blocks, one=2, two=3):
    """The rounds without Spark."""
    made = blobs(docs, blocks)
    first = routed([(b, k, p) for k, blob in made for b, p in op.first(k, blob, one, two)], op.answer_first)
    second = routed([(b, k, p) for k, blob in made for b, p in op.second(k, blob, first.get(k, {}), one, two)], op.answer_second)
    return sorted(r for k, blob in made for r in op.finish(k, blob, first.get(k, {}), second.get(k, {}), one, two))


def recompressed(docs, blocks, n=3, window=20):
    """The steps of recompression without Spark."""
    op, made = recompress.WordRepeats(window), dict(blobs(docs, blocks))

    def step(rows, answer):
        rows = {k: list(r) for k, r in rows.items()}
        got = routed([(b, k, p) for k, r in rows.items() for b, p in r if b is not None], answer)
        return {k: (next(p for b, p in r if b is None), got.get(k, {})) for k, r in rows.items()}

    now = step({k: op.begin(k, blob, n) for k, blob in made.items()}, op.answer(0))
    for r in range(op.rounds + 1):
        now = step({k: op.round(r, *x, n) for k, x in now.items()}, op.answer(r + 1))
    now = step({k: op.pieces(k, made[k], x[0], n) for k, x in now.items()}, lambda b, blocks, p: exchange.answer_names(p))
    plans = {k: op.plan(*x, n) for k, x in now.items()}
    got = routed([(b, k, p) for k in plans for b, p in plans[k].messages()], op.answer_plan)
    return sorted(r for k in plans for r in plans[k].finish(Block(k, made[k]), got.get(k, {})))


def byte_docs(rng, alphabet):
    pieces = [bytes(rng.choice(alphabet) for _ in range(rng.randint(30, 300))) for _ in range(8)]
    docs = []
    for i in range(30):
        parts = [rng.choice(pieces) if rng.random() < 0.5 else bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 5))]
        docs.append((i, b"".join(parts)))
    return [*docs, (30, b"a" * 400), (31, b"a" * 250), (32, b"ab" * 200), (33, docs[3][1]), (34, b"")]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("crowded", "widespread"), [(0, 4096), (16, 4096), (16, 1), (2, 2)])
def test_bytes(seed, crowded, widespread, monkeypatch):
    monkeypatch.setattr(exchange, "CROWDED", crowded)
    monkeypatch.setattr(exchange, "WIDESPREAD", widespread)
    monkeypatch.setattr(suffix, "SORTED", 50)
    rng = random.Random(seed)
    docs = byte_docs(rng, b"ab" if seed % 2 else b"abcdefgh \n\xc3\xa9")
    want = brute_bytes(docs)
    rng.shuffle(docs)
    assert simulated(suffix.ByteRepeats(), docs, rng.choice([1, 3, 7])) == want


def word_docs(rng, size):
    words = [b"w%d" % k for k in range(size)]
    pieces = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(8)]
    docs = []
    for i in range(40):
        t = []
        for _ in range(rng.randint(0, 5)):
            t += rng.choice(pieces) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 30))]
        docs.append((i, b"".join(w + rng.choice([b" ", b"\n", b"  ", b"\t"]) for w in t)))
    return [*docs, (40, b"a " * 50), (41, b"a " * 30), (42, b"b a " * 40), (43, docs[3][1]), (44, b""), (45, b" \n"), (46, b"y " + b"x " * 26 + b"z")]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize(("crowded", "widespread"), [(16, 4096), (0, 4096), (16, 1)])
def test_words(seed, crowded, widespread, monkeypatch):
    monkeypatch.setattr(exchange, "CROWDED", crowded)
    monkeypatch.setattr(exchange, "WIDESPREAD", widespread)
    rng = random.Random(seed)
    docs = word_docs(rng, [2, 3, 50, 1000][seed % 4])
    want = brute_words(docs)
    rng.shuffle(docs)
    assert recompressed(docs, rng.choice([1, 3, 7])) == want


def test_a_round_reads_its_state_once(monkeypatch):
    """A round does not unpack again the state that it has just packed; odd gaps between words leave no trace."""
    reads, read = [], recompress.State.read.__func__
    monkeypatch.setattr(recompress.State, "read", classmethod(lambda cls, *x: reads.append(1) or read(cls, *x)))
    docs = [(i, t.replace(b" ", gap) + end) for (i, t), gap, end in zip(word_docs(random.Random(8), 60), [b" ", b"\t", b" \n", b"\r\n\v", b"\f"] * 99, [b"", b"\n", b"\xc2\xa0"] * 99, strict=False)]
    assert recompressed(docs, 3) == brute_words(docs)
    assert len(reads) == len(blobs(docs, 3)) * (recompress.ROUNDS + 1)


@pytest.mark.parametrize("seed", range(3))
def test_long_documents(seed, monkeypatch):
    """Documents that are taken in stretches give the same as whole ones."""
    monkeypatch.setattr(suffix, "PART", 150)
    monkeypatch.setattr(recompress, "PART", 60)
    rng = random.Random(seed)
    docs = byte_docs(rng, b"abcd \n")
    docs += [(40, b"".join(t for _, t in docs[:12])), (41, b" ".join(t for _, t in docs[5:9])), (42, b"q" * 700)]
    assert simulated(suffix.ByteRepeats(), docs, 2) == brute_bytes(docs)
    docs = word_docs(rng, [3, 60, 500][seed])
    docs += [(50, b" ".join(t for _, t in docs[:12])), (51, b"  ".join(t for _, t in docs[5:30])), (52, b"x" * 500 + b" y" * 300)]
    assert recompressed(docs, 2) == brute_words(docs)


@given(st.lists(st.text("ab ", max_size=120), min_size=1, max_size=6), st.integers(1, 3))
@settings(max_examples=40, deadline=None)
def test_small_words(texts, blocks):
    docs = [(i, t.encode()) for i, t in enumerate(texts)]
    assert recompressed(docs, blocks) == brute_words(docs)


@pytest.mark.parametrize("seed", range(2))
def test_equal_hashes_decide_nothing(seed, monkeypatch):
    """Where all hashes of windows, words and anchors are equal, the results are the same."""
    import types

    fixed = types.SimpleNamespace(xxh3_64_intdigest=lambda data: 7, xxh64_intdigest=lambda data: 7)
    monkeypatch.setattr(exchange, "xxhash", fixed)
    monkeypatch.setattr(recompress, "xxhash", fixed)
    monkeypatch.setattr(recompress, "mix64", lambda x: x * np.uint64(0) + (x & np.uint64(1)) * np.uint64(1 << 63))
    rng = random.Random(seed)
    docs = word_docs(rng, [3, 200][seed])
    assert recompressed(docs, 3) == brute_words(docs)
    monkeypatch.setattr(exchange, "CROWDED", 0)
    assert recompressed(docs, 3) == brute_words(docs)
    docs = byte_docs(rng, b"abcd \n")
    assert simulated(suffix.ByteRepeats(), docs, 3) == brute_bytes(docs)


@given(st.text("ab", min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_longest_previous_factor(text):
    order = sorted(range(len(text)), key=lambda k: text[k:])

    def lcp(a, b):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return n

    common = [0] + [lcp(a, b) for a, b in zip(order, order[1:], strict=False)]
    want = [max((lcp(i, j) for j in range(i)), default=0) for i in range(len(text))]
    assert suffix.longest_previous(order, common) == want


SHARED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, fp long, doc_id long, block string")


@pytest.mark.parametrize(("run", "brute"), [(suffix.remove_repeats, brute_bytes), (recompress.remove_repeats, brute_words)])
def test_in_spark(spark, run, brute):
    texts = {1: SHARED * 2, 2: "x " + SHARED, 3: None, 4: "", 5: SHARED, 6: "short", 7: "é " * 3000 + SHARED}
    docs = frame(spark, [(t, 0, i, "b") for i, t in texts.items()]).repartition(3)
    got = sorted(tuple(r) for r in run(docs).collect())
    assert got == brute([(i, (t or "").encode()) for i, t in texts.items()])


@pytest.mark.parametrize(("sql", "brute"), [(suffix.ORACLE, brute_bytes), (recompress.ORACLE, brute_words)])
def test_sql(sf_dir, sql, brute):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    docs = con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert sorted(con.sql(sql).fetchall()) == brute([(i, t.encode()) for i, t in docs])


@pytest.mark.parametrize(("run", "brute"), [(suffix.remove_repeats, brute_bytes), (recompress.remove_repeats, brute_words)])
def test_driver_table(spark, sf_dir, run, brute):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[2] for r in want) > 0
    assert sorted(tuple(r) for r in run(docs).collect()) == want


@pytest.mark.parametrize("run", [suffix.remove_repeats, recompress.remove_repeats])
def test_edges(spark, run):
    assert run(frame(spark, [])).collect() == []
    got = run(frame(spark, [(SHARED, 0, 1, None), (SHARED, 0, 1, None), (SHARED, 0, None, None), (None, None, None, None)])).collect()
    assert [r.doc_id for r in got].count(1) == 2 and [r.doc_id for r in got].count(None) == 2
    removed = sorted((r.doc_id or 9, r.n_removed > 0) for r in got)
    # The first of the equal rows stays; null ids come last, so that row's copy goes.
    assert removed == [(1, False), (1, True), (9, False), (9, True)]
