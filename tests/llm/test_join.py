"""The n-gram join against brute force: pigeonhole bounds, skipped buckets, neighbourhoods, blocks."""

import numpy as np
import pytest

from cadenza.llm import ngram_join as join
from tests.llm.test_copies import classes


def held(make_docs, rows, **how):
    got = join.ngram_join(make_docs(rows), **how).collect()
    assert len(got) == len(rows)
    want, sizes = classes(rows, how.get("size", 5))
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (sizes[r.doc_id], want[r.doc_id]), r
    return want


def test_corpus(make_docs, corpus):
    held(make_docs, corpus + [(60, corpus[10][1], "a")])  # with a repeated row
    assert join.ngram_join(make_docs([])).count() == 0
    assert join.ngram_join(make_docs([(1, None, "a"), (2, "", "a")])).count() == 2


def near_copies(seed):
    """Families of near copies around the threshold; families share a passage, so buckets hold several components."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(8):
        own = [f"f{family}w{i}" for i in range(40)]
        for _ in range(9):
            words = passage + own
            for _ in range(int(rng.integers(0, 9))):
                at = int(rng.integers(0, len(words)))
                words = words[:at] + words[at + int(rng.integers(0, 3)) :]
            rows.append((len(rows), " ".join(words), "a"))
    return rows + [(len(rows) + i, " ".join(f"{x}" for x in rng.integers(0, 4, int(rng.integers(4, 14)))), "b") for i in range(60)]


@pytest.mark.parametrize(("size", "bucket_pairs"), [(2, 4096), (1, 40), (2, 0)])
def test_costly_buckets_are_skipped_and_made_up_for(make_docs, size, bucket_pairs):
    """With nearly every bucket too costly, neighbourhoods and blocks find all links."""
    assert len(set(held(make_docs, near_copies(size), size=size, bucket_pairs=bucket_pairs, part_entries=200).values())) > 8


def test_a_pair_at_the_threshold_agrees_on_a_relied_on_segment():
    """Random pairs of every size: some exact key in common, or, with segments skipped, a neighbourhood."""
    rng = np.random.default_rng(3)
    for n in [4, 5, 6, 9, 10, 12, 20, 45, 90, 150, 400]:
        for _ in range(40):
            pool = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            k = int(rng.integers(0, n // 10 + 1))
            a, b = np.sort(rng.permutation(pool)[k:]), np.sort(rng.permutation(pool)[k:])
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            bands = [{int(x[0]) for at, x in join.bands_of(np.array([len(s)]), 80)} for s in (a, b)]
            band = np.array([max(bands[0] & bands[1] & {int(np.searchsorted(join.LOWS, min(len(a), len(b)), side="right") - 1)})])
            m, _ = join.shape(band, 80)
            assert m[0] > int(join.apart(len(a), len(b), 80))
            keys = [join.segments([s], band, 80)[1] for s in (a, b)]
            common = np.intersect1d(*keys)
            exact = [join.allowance(np.array([len(s)]), band, np.array([len(x)]), 80)[0][0] for s, x in zip((a, b), keys)]
            if max(exact) >= 0:
                assert len(common) > max(exact)


def test_starred_keeps_the_first_of_a_key():
    key = np.array([5, 3, 5, 5, 3, 9], np.uint64)
    node = np.array([[1, 1], [2, 2], [1, 1], [3, 3], [4, 4], [5, 5]])
    start, hits = join.starred(key, node)
    assert sorted(start.tolist()) == [0, 1, 5] and sorted(map(tuple, hits.tolist())) == [(0, 3), (1, 4)]


def test_work_on_a_hot_passage_is_linear(make_docs):
    """Star pairs of documents that share a passage grow with their number, not with its square."""
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(40))
    made = []
    for n in (400, 800):
        rows = [(i, passage + " " + " ".join(map(str, rng.integers(0, 10**6, 40))), "a") for i in range(n)]
        docs = make_docs(rows).selectExpr("doc_id", "cast(text AS binary) AS text")
        packed = join._entries(docs, 5, 80, 4).repartition(4, "part")
        made.append(join._stars(packed).count())
    assert made[1] < 3 * made[0]
