"""A large group of near copies of the n-gram join: its pairs are not read one by one, and no link is lost."""

import numpy as np

from cadenza.llm import near_dedup
from cadenza.llm import ngram_join as join
from tests.llm.test_copies import classes


def near_group(n, seed=5):
    """Copies of one text with words changed here and there: of many pairs just one side or none reaches the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in range(80)]
        for at in rng.integers(0, 80, int(rng.integers(1, 6))):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words), "a"))
    return rows


def test_pairs_of_a_group_are_not_read_one_by_one(make_docs, monkeypatch):
    rows = near_group(150)
    made = {}
    real = join.stage

    def staged(df, name, *how):
        out = real(df, name, *how)
        made[name] = out.count()
        return out

    monkeypatch.setattr(join, "stage", staged)
    got = join.ngram_join(make_docs(rows), bucket_pairs=100).collect()
    want, sizes = classes(rows, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], want[i]) for i, *_ in rows}
    assert 1 < len(set(want.values())) < 150
    assert made["rest"] > 0 and made["rest-links"] < made["rest"] * 2
    assert made["between"] < len(rows)


def test_forest_connects_what_all_links_connect():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 60, 200), rng.integers(60, 90, 200)
    kept = near_dedup._forest(i, j)

    def parts(i, j):
        of = list(range(90))
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = of[x], of[y]
            of = [a if k == b else k for k in of]
        return {frozenset(k for k in range(90) if of[k] == c) for c in of}

    assert parts(i[kept], j[kept]) == parts(i, j) and len(kept) == 90 - len(parts(i, j))
