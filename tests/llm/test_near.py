"""SimHash groups, fingerprints and components."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from idiomill.llm import cws, simhash
from idiomill.llm.common import Scratch
from idiomill.llm.graph import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def slow_groups(prints):
    """Smallest id reachable over pairs within two bits."""
    ids = sorted(prints)
    own = {i: i for i in ids}

    def find(a):
        while own[a] != a:
            a = own[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                own[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "A b c d É\x0bf\x00g h", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = slow_groups(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints


@pytest.mark.parametrize("paired", [0, 4, 1000])
def test_links_are_complete(spark, paired):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fp long")
    scratch = Scratch(spark, "test")
    edges = simhash.links(df, scratch, paired=paired)
    assert all((r.u ^ r.v).bit_count() <= 2 or ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    got = {r.u: r.root for r in components(edges, scratch).collect()}
    want = slow_groups({x: x & (1 << 64) - 1 for (x,) in signed})
    assert {x: got.get(x, x) for (x,) in signed} == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(1, 2), (2, 1), (5, 4), (9, 4)]])
def test_components(spark, edges):
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    own = {}
    for a, b in edges:
        if a != b:
            own.setdefault(a, a), own.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and own[a] != own[b]:
                own[a] = own[b] = min(own[a], own[b])
                changed = True
    assert got == own


def odd_rows(spark):
    rows = [("a b c d e", 3, 7), ("a b c d e", 2, 7), ("a b c d e", 2, 7), (None, 5, 1), ("", 4, 1), ("A B C D E", None, 1)]
    return spark.createDataFrame(rows, "text string, doc_id long, fp long")


def test_simhash_edges(spark):
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(odd_rows(spark)).collect())
    assert got == [(-1, 2), (2, 2), (2, 2), (3, 2), (4, 4), (5, 4)]
    assert simhash.near_duplicates(odd_rows(spark).where("false")).count() == 0


def test_edited_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in cws.fingerprint_edits(docs, target_bytes=50_000).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, following = (cws.sampler().sign(*cws.terms_of(x.encode())) for x in (t, edited, after))
        assert r.fingerprint == cws.text_of(own) and r.edited_fingerprint == cws.text_of(changed)
        assert r.near_edited == cws.likeness(own, changed) and r.near_next == cws.likeness(own, following)


def plain_samples(text, sampler):
    """The samples of a text by loops over samples and terms; only the tables of quantiles are the operator's."""
    mask = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = ((x ^ x >> shift) * factor) & mask
        return x

    golden, one = 0x9E3779B97F4A7C15, np.float32(1)
    hashes = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    pairs = hashes if len(hashes) == 1 else [(a * golden + (b ^ b >> 29)) & mask for a, b in zip(hashes, hashes[1:], strict=False)]
    bag = {}
    for p in pairs:
        bag[mix(p)] = bag.get(mix(p), 0) + 1
    out = []
    for j in range(sampler.samples):
        best = None
        for term, weight in sorted(bag.items()):
            z = mix(term ^ mix((j + 1) * golden & mask))
            r, b, ln_c = sampler.r[z & 0xFFFF], (np.float32(z >> 16 & 0xFFFF) + np.float32(0.5)) * np.float32(1 / 65536), sampler.ln_c[z >> 44]
            if weight == 1:
                t, value = 0, ln_c - (one - b) * r
            else:
                t = np.floor(np.float32(np.log(weight)) / r + b)
                value = ln_c - r * (t - b) - r
            if best is None or value < best[0]:
                best = (value, term, int(t))
        out.append(mix(best[1] ^ (best[2] * golden & mask)) >> 48)
    return "".join(f"{x:04x}" for x in out) if bag else "0" * 4 * sampler.samples


def test_fingerprints_against_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = cws.fingerprint_edits(docs).collect()
    some = [r for r in got if r.doc_id % 7 == 0]
    assert len(some) > 5
    for r in some:
        assert r.fingerprint == plain_samples(texts[r.doc_id], cws.sampler())
    near = []
    bags = {i: dict(zip(*(x.tolist() for x in cws.terms_of(t.encode())), strict=True)) for i, t in texts.items()}
    order = sorted(texts, reverse=True)
    by_id = {r.doc_id: r for r in got}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        keys = bags[a].keys() | bags[b].keys()
        low, high = (sum(f(bags[a].get(k, 0), bags[b].get(k, 0)) for k in keys) for f in (min, max))
        if high:
            near.append(by_id[a].near_next - low / high)
    assert abs(np.mean(near)) < 0.02 and np.std(near) < 0.08


def test_collision_rate():
    """Over many samples the share of collisions is the generalised Jaccard similarity."""
    s = cws.Sampler(4096)
    a = {1: 3, 2: 1, 3: 5, 4: 1}
    b = {1: 1, 2: 1, 3: 6, 5: 2}
    sign = lambda x: s.sign(np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([x[k] for k in sorted(x)]))
    order = lambda x: dict(x)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs(cws.likeness(sign(order(a)), sign(order(b))) - want) < 0.03


def test_cws_edges(spark):
    got = cws.fingerprint_edits(odd_rows(spark), target_bytes=4).collect()
    assert len(got) == 6
    empty = [r for r in got if r.n_chars == 0]
    assert len(empty) == 2 and {r.fingerprint for r in empty} == {"0" * 256} and all(r.near_edited == 1.0 for r in empty)
    assert cws.fingerprint_edits(odd_rows(spark).where("false")).count() == 0
    alone = cws.fingerprint_edits(spark.createDataFrame([("a b c d", 1)], "text string, doc_id long")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() and alone.near_next == 1.0
    long = spark.createDataFrame([("w%d " * 1, 1)], "text string, doc_id long").select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text"), "doc_id")
    assert cws.fingerprint_edits(long).first().near_next == 1.0
