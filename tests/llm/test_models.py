"""Toxicity and quality models: held-out accuracy, gradients, and what is and is not an input."""

import numpy as np
import pytest

from cadenza.llm import quality_classifier, toxicity
from cadenza.llm.common import id_crc_mod


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = [str(w) for w in rng.choice(words, int(rng.integers(20, 120)))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(["zzvile", "zzvilest", "qqnasty"])))
        good = i % 5 != 0
        docs.append((i, " ".join(text if good else [w + "%%%" for w in text]) + ".", "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (None, "no id", "en", "s", 1), (1002, "x" * 50_000, "en", "s", 1), (1003, "word " * 20_000, "en", "s", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score long"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(toy):
    docs, labels = toy
    got = toxicity.score_toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() and len(held) > 50
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (id_crc_mod(r.doc_id, 5) == 0) for r in got if r.doc_id is not None)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(toy, spark):
    docs, labels = toy
    got = toxicity.score_toxicity(docs, labels.where("toxic = 7")).collect()
    assert {r.score for r in got} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_every_window_is_read():
    assert toxicity.spans(5) == [0] and toxicity.spans(toxicity.WINDOW) == [0]
    for n in (41, 72, 100, 1000):
        s = toxicity.spans(n)
        assert s[0] == 0 and s[-1] == n - toxicity.WINDOW and all(0 < b - a <= toxicity.STRIDE < toxicity.WINDOW for a, b in zip(s, s[1:]))


def test_passages_are_whole_in_a_window():
    """Half a window of words, wherever it stands in a text, is read in one piece."""
    for n in (41, 72, 100, 333):
        s = toxicity.spans(n)
        for k in range(n - toxicity.WINDOW // 2):
            assert any(a <= k and k + toxicity.WINDOW // 2 < a + toxicity.WINDOW for a in s)


def test_gradients():
    net = toxicity.Network({b"bad": 0}, np.array([1.0, 0.0]), np.random.default_rng(0).normal(size=toxicity.GRAMS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    looked = net.lookups([b"bad", b"good", b"word"])
    index = np.random.default_rng(1).integers(0, 3, (toxicity.WINDOW, 4))
    live = (np.arange(toxicity.WINDOW)[:, None] < np.array([40, 7, 1, 20])).astype(np.float64)
    y = np.array([1, 0, 1, 0], np.float32)
    g = net.gradients(looked, index, live, y)

    def loss():
        gf, gb = net.gates(net.inputs(looked).astype(np.float64))
        z, _ = net.forward(gf[index], gb[index], live)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    rng = np.random.default_rng(2)
    for name in ("wf", "ub", "wa", "va", "wo", "bo", "cf"):
        flat = net.p[name].reshape(-1)
        k = int(rng.integers(0, flat.size))
        old, h = flat[k], 1e-3
        flat[k] = old + h
        up = loss()
        flat[k] = old - h
        down = loss()
        flat[k] = old
        assert g[name].reshape(-1)[k] == pytest.approx((up - down) / (2 * h), abs=2e-4), name


def test_quality(toy):
    docs, labels = toy
    got = quality_classifier.classify(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (id_crc_mod(r.doc_id, 4) == 2) for r in got if r.doc_id is not None)
    assert {r.score for r in quality_classifier.classify(docs, labels.where("quality = 7")).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_discriminant_is_the_log_density():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(2, 0.5, (300, 3))])
    y = np.repeat([0.0, 1.0], 300)
    m = quality_classifier.fit(x, y, shrink=0.0)
    density = [-0.5 * np.einsum("ij,jk,ik->i", x - mu, r.T @ r, x - mu) - 0.5 * ld for mu, r, ld in zip(m.means, m.roots, m.logdets)]
    assert np.allclose(m.difference(x), density[1] - density[0])
    assert ((m.score(x) > 0.5) == y).mean() > 0.97


def brute_score(net, text):
    """One window after the other, one word after the other, from the parameters alone."""
    words, p, h = toxicity.text_words(text), net.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    starts = range(0, len(words), toxicity.STRIDE) if len(words) > toxicity.WINDOW else [0]
    parts = [words[a : a + toxicity.WINDOW] for a in starts if a + toxicity.WINDOW < len(words)] + [words[-toxicity.WINDOW :]]
    best = -np.inf
    for part in parts:
        x = []
        for w in part:
            n = net.vocabulary.get(w, len(net.vocabulary))
            g = toxicity.grams([w])[0]
            x.append(np.concatenate([p["words"][n], [net.word_odds[n]], p["grams"][g].mean(0), [net.gram_odds[g].max()], [net.gram_odds[g].mean()]]))
        sides = []
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            s, states = np.zeros(h), [None] * len(x)
            for k in order:
                g, u = x[k] @ p[f"w{side}"] + p[f"c{side}"], s @ p[f"u{side}"]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                s = states[k] = z * s + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            sides.append(states)
        both = [np.concatenate(v) for v in zip(*sides)]
        e = np.array([np.tanh(v @ p["wa"] + p["ba"]) @ p["va"] for v in both])
        e = np.exp(e - e.max())
        best = max(best, sum(a * v for a, v in zip(e / e.sum(), both)) @ p["wo"] + p["bo"][0])
    return sig(net.scale * best + net.size * np.log(len(parts)) + net.shift)


def test_scores_against_brute_force():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdé"), 4)) for _ in range(90)]
    texts, y = [], []
    for i in range(80):
        t = [str(w) for w in rng.choice(words, int(rng.integers(5, 150)))]
        if i % 3 == 0:
            t.insert(len(t) // 2, "zzvile!!")
        texts.append(" ".join(t).encode())
        y.append(float(i % 3 == 0))
    net = toxicity.fit(texts, np.array(y), epochs=3)
    some = [*texts[:30], "*** $$$ @@@ ,, (a) --".encode(), ("ja " * 81).encode(), "É x y .".encode()]
    got = toxicity.Scorer(net).many(some)
    assert np.allclose(got, [brute_score(net, t) for t in some], atol=1e-5)
    assert toxicity.text_words(b'*** Say "it", it it!! (A) ok') == [b"***", b"say", b'"', b"it", b'",', b"it", b"it", b"!!", b"(", b"a", b")", b"ok"]


def test_training_log_odds_come_from_other_texts():
    """A word that one training text alone holds says nothing about that text; equal inputs give equal networks."""
    texts = [b"same words here and there"] * 40
    y = np.arange(40) % 2 * 1.0
    net = toxicity.fit([t + b" only%d" % i for i, t in enumerate(texts)], y)
    again = toxicity.fit([t + b" only%d" % i for i, t in enumerate(texts)], y)
    assert all((net.p[k] == again.p[k]).all() for k in net.p) and net.scale == again.scale
    assert abs(toxicity.Scorer(net).many([b"same words here and there"])[0] - 0.5) < 0.2


def test_quality_scores_against_brute_force(toy, spark):
    """Gaussian log-densities from the labelled texts' statistics by the textbook formulas; repeated rows change nothing from run to run."""
    docs, labels = toy
    docs = docs.unionByName(docs.where("doc_id IN (3, 8)")).unionByName(spark.createDataFrame([(5, "another text under the id", "en", "s", 1)], docs.schema))
    got = {(r.doc_id, r.score) for r in quality_classifier.classify(docs, labels).collect()}
    assert got == {(r.doc_id, r.score) for r in quality_classifier.classify(docs.repartition(5), labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").collect()}
    rows = [(r.doc_id, np.array(quality_classifier.statistics((r.text or "").encode()))) for r in docs.collect()]
    train = [(x, truth[i]) for i, x in rows if i in truth and id_crc_mod(i, 4) != 2]
    x, y = np.array([a for a, _ in train]), np.array([b for _, b in train])
    model = quality_classifier.train(docs, labels)
    shrink, ridge, d = quality_classifier.SHRINK, quality_classifier.RIDGE, x.shape[1]
    centred = [x[y == k] - x[y == k].mean(0) for k in (0, 1)]
    pooled = sum(c.T @ c for c in centred) / len(x)
    for i, v in rows[:60]:
        density = []
        for k, c in enumerate(centred):
            own = shrink + (1 - shrink) * d / (d + len(c))
            cov = (1 - own) * c.T @ c / len(c) + own * (pooled + np.diag(np.diag(pooled))) / 2 + ridge * np.eye(d)
            e = v - x[y == k].mean(0)
            density.append(-0.5 * e @ np.linalg.solve(cov, e) - 0.5 * np.linalg.slogdet(cov)[1])
        assert model.difference(v[None])[0] == pytest.approx(density[1] - density[0], rel=1e-6, abs=1e-6)
