"""Near-duplicates and repeated passages against brute force."""

import hashlib
import sys
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import near_dedup, substring_dedup
from cadenza.llm.components import components


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(rows, size):
    """doc_id -> smallest id reachable over links of 80 percent."""
    s = {i: shingles(t, size) for i, t, _ in rows if i is not None}
    ids = sorted(s)
    links = defaultdict(set)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in ids:
        if i not in out:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in out:
                    out[j] = i
                    todo += links[j]
    return out, {i: len(x) for i, x in s.items()}


def test_near_duplicates(make_docs, corpus):
    rows = corpus + [(60, corpus[10][1], "a")]  # a repeated row
    got = near_dedup.near_duplicates(make_docs(rows), size=4).collect()
    want, sizes = classes(rows, 4)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], r.doc_id == want[r.doc_id]), r
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    assert near_dedup.near_duplicates(make_docs([(1, None, "a"), (2, "", "a")])).count() == 2


def test_groups_that_share_a_passage(make_docs):
    """Documents near the threshold to each other: the open buckets and their home blocks decide."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(passage + [f"w{x}" for x in rng.integers(0, 60, int(rng.integers(5, 40)))]), "a") for i in range(60)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(make_docs(rows), size=2).collect()}
    assert got == classes(rows, 2)[0]


def test_estimate_follows_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
            cut = int(len(pool) * (1 - share) / 2)
            a, b = np.sort(pool[cut:]), np.sort(pool[: len(pool) - cut])
            true = len(np.intersect1d(a, b)) / len(pool)
            errors.append(near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b), len(a), len(b))[0] - true)
            assert true < 0.8 or near_dedup.hopeful(near_dedup.registers(a), near_dedup.registers(b), len(a), len(b), 80)
        assert abs(np.mean(errors)) < 0.03


def test_pairs_at_the_threshold_are_never_given_up():
    """Sets of every size from one to hundreds whose similarity is 0.8 or just above."""
    rng = np.random.default_rng(12)
    for n in [1, 2, 4, 5, 8, 9, 10, 20, 45, 90, 150, 300, 900]:
        for _ in range(60):
            pool = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            k = n // 10  # n - 2k shared of n: at least 0.8
            a, b = np.sort(rng.permutation(pool)[k:]), None
            left = np.setdiff1d(pool, a)
            drop = rng.permutation(a)[:k]
            b = np.union1d(np.setdiff1d(a, drop), left)
            assert 10 * len(np.intersect1d(a, b)) >= 8 * n
            ra, rb = near_dedup.registers(a), near_dedup.registers(b)
            assert near_dedup.hopeful(ra, rb, len(a), len(b), 80) and (near_dedup.band_keys(ra) == near_dedup.band_keys(rb)).any(), n


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 ids in order, and a star."""
    module, rounds = sys.modules["cadenza.llm.components"], []
    staged = module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: (rounds.append(name), staged(df, name))[1])
    chain = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(chain)
    assert got.count() == 10_001 and got.where("component <> 0").count() == 0
    assert sum(n.endswith("-parents") for n in rounds) <= 14
    rounds.clear()
    star = spark.range(5_000).select(F.lit(9_999).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).where("component = 0").count() == 5_001
    assert sum(n.endswith("-parents") for n in rounds) <= 4


def brute_substrings(rows, window):
    words = [(i, (t or "").encode().split()) for i, t, _ in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {k + x for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for x in range(window)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_substrings(make_docs, corpus):
    rows = corpus + [(63, corpus[-9][1], "b"), (90, " ".join(f"t{i % 50}" for i in range(400)), "a")]
    for window in (35, 10, 3):
        got = substring_dedup.dedup_substrings(make_docs(rows), window=window).collect()
        assert Counter(tuple(r) for r in got) == brute_substrings(rows, window)
    assert substring_dedup.dedup_substrings(make_docs([])).count() == 0


def test_rows_that_share_a_hash_stay_apart(make_docs, corpus, monkeypatch):
    """Even if all rows had one 64-bit hash, their own words would be cut."""
    monkeypatch.setattr(substring_dedup, "_row_hash", lambda: F.lit(7).cast("long"))
    rows = corpus[:45] + corpus[53:60]
    assert Counter(tuple(r) for r in substring_dedup.dedup_substrings(make_docs(rows), window=10).collect()) == brute_substrings(rows, 10)


def test_cut_text_keeps_lines(make_docs):
    passage = " ".join(f"q{i}" for i in range(40))
    rows = [(1, f"own line\n{passage} tail\nend", "a"), (2, passage, "a"), (3, "a  b", "a")]
    got = {r.doc_id: r.kept_text for r in substring_dedup.dedup_substrings(make_docs(rows), with_text=True).collect()}
    assert got == {1: "own line\ntail\nend", 2: "", 3: "a  b"}
