"""Phrases, and the automaton's states, against plain counting."""

import re
from collections import Counter

import numpy as np

from cadenza.llm import collocations


def brute(rows, least, first):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    held = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    for (lang, p), a in held.items():
        if any(o == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), c in held.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, x in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(x)[:first], 1))


def rows_of(seed, docs=60):
    rng = np.random.default_rng(seed)
    words = ["A", "bé", "c", "d", "e.f", "g", "hh", "\x00i", "　j"]
    rows = [(None, None), ("en", ""), ("en", " \t . ,, \n"), (None, "One one ONE one one one"), ("en", "x " * 400)]
    for i in range(docs):
        picked = rng.choice(words, int(rng.integers(1, 120)), p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append((["en", "fr", None][i % 3], "".join(w + str(rng.choice([" ", "\t", ". ", "  ", "\n", "; ", "!"], p=[0.6, 0.1, 0.08, 0.1, 0.06, 0.03, 0.03])) for w in picked)))
    return rows + rows[6:10]


def test_collocations(spark):
    for seed, least, first, shard in ((1, 5, 1000, 4_000_000), (2, 3, 1000, 200), (3, 20, 7, 1000)):
        rows = rows_of(seed)
        docs = spark.createDataFrame([(i, lang, text, 1, "x", 2, "y") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string, rank int, word string").repartition(3)
        got = collocations.collocations(docs, least, first, shard, part_entries=50).collect()
        assert sorted(map(tuple, got)) == brute(rows, least, first)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("text IS NULL")).count() == 0


def test_large_products_stay_exact(spark):
    """1000 * a * n passes 64 bits where counts are large: the same expression on large numbers."""
    a, n, l, r = 10**12 + 7, 10**13 + 3, 10**12 + 9, 10**12 + 11
    wide = lambda x: f"cast({x}L AS decimal(38, 0))"
    got = spark.sql(f"SELECT (1000 * {wide(a)} * {wide(n)}) div ({wide(l)} * {wide(r)}) AS s").first().s
    assert got == 1000 * a * n // (l * r)


def test_states_of_the_automaton():
    rng = np.random.default_rng(5)
    for _ in range(30):
        g = rng.integers(0, 4, 200)
        want = Counter()
        for i in range(200):
            for k in range(1, 6):
                if i + k <= 200 and (g[i : i + k] > 0).all():
                    want[tuple(g[i : i + k].tolist())] += 1
        got = {}
        for end, low, high, count in zip(*(x.tolist() for x in collocations.states(g))):
            for k in range(low, high + 1):
                p = tuple(g[end - k + 1 : end + 1].tolist())
                assert p not in got
                got[p] = count
        assert got == want
