"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is the sequence of all its words, lower-cased (A-Z), with the symbols at their ends as words of their own.  A
word's input is a learned word vector (words seen in training), the mean
of learned vectors of its character n-grams, and the class log-odds of the word and of its n-grams in the
training sample; while the network is trained, a text's log-odds come from the other FOLDS - 1 parts of the sample.
Two gated recurrent layers read windows of WINDOW = 40 words, one each STRIDE = 20 words and
one that ends with the text, so a passage of up to 21 words is whole in some window wherever it stands; attention
pools their states, and a text's score is the calibrated logit of its highest window.  Training is by
multiple instances: in each epoch a text is represented by its windows that score highest so far (at first, by log-odds).  Every fourth text of
a class is kept from the training for the calibration, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import crc_mod, scramble, small_batches

WINDOW, STRIDE = 40, 20
HIDDEN, ATTENTION, WORD_DIM, GRAM_DIM, GRAMS = 8, 8, 4, 4, 1 << 14
DIM = WORD_DIM + 1 + GRAM_DIM + 2
#: The fit takes at most so many labelled texts of each class, whole, in the order of a hash of their ids.
TRAIN_ROWS = 1_500
FOLDS = 8
#: Passes over the sample; in the first WARM of them windows are ranked by log-odds, afterwards by the network so far.  A pass has
#: PASS_STEPS steps or more, of at most BATCH windows each.
EPOCHS, WARM, PASS_STEPS, BATCH, RATE = 14, 5, 16, 256, 0.02
#: Words whose inputs a worker remembers.
CACHE = 300_000
_EDGE = b".,;:!?\"'()[]{}<>#*$%&|-_=+~@/\\"
_CLIP, _RARE = 4.0, 4


def text_words(text: bytes | None) -> list[bytes]:
    """All lower-cased (A-Z) words in order; symbols at a word's ends are words before and after it."""
    out = []
    for w in (text or b"").lower().split():
        core = w.strip(_EDGE)
        if not core or len(core) == len(w):
            out.append(w)
            continue
        at = w.index(core)
        if at:
            out.append(w[:at])
        out.append(core)
        if at + len(core) < len(w):
            out.append(w[at + len(core) :])
    return out


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character 3-, 4- and 5-grams, ends marked, word after word; their number by word."""
    text = np.frombuffer(("<" + b"> <".join(words).decode("utf-8", "replace") + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = text == 32
    word, gap = np.cumsum(space), np.concatenate([[0], np.cumsum(space)])
    found, owner = [], []
    for k in (3, 4, 5):
        n = len(text) - k + 1
        if n > 0:
            inside = np.flatnonzero(gap[k:] == gap[:n])
            h = np.full(len(inside), k, np.uint64)
            for i in range(k):
                h = scramble(h + text[inside + i])
            found.append((h % np.uint64(GRAMS)).astype(np.int64))
            owner.append(word[inside])
    bucket, who = np.concatenate(found), np.concatenate(owner)
    return bucket[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Shrunk towards 0 where a feature is rare."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    n = pos + neg
    return np.clip(odds * np.where(n < _RARE, 0, n / (n + 8)), -_CLIP, _CLIP)


class Network:
    """The parameters ``p`` (name -> array) and what is computed with them."""

    def __init__(self, vocabulary: dict[bytes, int], word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, a, d = HIDDEN, ATTENTION, DIM
        r = lambda *s, k=1.0: (rng.standard_normal(s) * k / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary, self.word_odds, self.gram_odds = vocabulary, word_odds.astype(np.float32), gram_odds.astype(np.float32)
        self.p = {"words": r(len(vocabulary) + 1, WORD_DIM) * 0, "grams": (rng.standard_normal((GRAMS, GRAM_DIM)) * 0.05).astype(np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": r(d, 3 * h), f"u{side}": r(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"wa": r(2 * h, a), "ba": np.zeros(a, np.float32), "va": r(a), "wo": r(2 * h), "bo": np.full(1, -1.0, np.float32)}
        self.scale, self.size, self.shift, self.constant = 1.0, 0.0, 0.0, None

    # -- inputs -------------------------------------------------------------------------------------

    def lookups(self, words: list[bytes]) -> tuple:
        """For distinct words: vocabulary rows (the last row: unseen), n-gram buckets end to end, their starts."""
        ids = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words], np.int64)
        buckets, counts = grams(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
        return ids, buckets, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts

    def inputs(self, looked: tuple, word_odds: np.ndarray | None = None, gram_odds: np.ndarray | None = None) -> np.ndarray:
        """Inputs of the words; ``word_odds`` and ``gram_odds``, by word and by n-gram, stand in for those of the whole sample."""
        ids, g, starts, counts = looked
        if not len(ids):
            return np.empty((0, DIM), np.float32)
        mean = np.add.reduceat(self.p["grams"][g], starts) / counts[:, None]
        odds = self.gram_odds[g] if gram_odds is None else gram_odds
        own = self.word_odds[ids] if word_odds is None else word_odds
        return np.concatenate([self.p["words"][ids], own[:, None], mean, np.maximum.reduceat(odds, starts)[:, None], (np.add.reduceat(odds, starts) / counts)[:, None]], 1, dtype=np.float32)

    # -- forward ------------------------------------------------------------------------------------

    def _side(self, gates: np.ndarray, live: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (T, N, H) from input gates (T, N, 3H); ``live`` (T, N) is 0 past a window's end."""
        n, h = gates.shape[1], HIDDEN
        u, state, tape = self.p[f"u{side}"], np.zeros((n, h), np.float32), []
        states = np.empty((len(gates), n, h), np.float32)
        for t in range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1):
            x = state @ u
            zr = _sigmoid(gates[t, :, : 2 * h] + x[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * x[:, 2 * h :])
            nxt = state + (1 - z) * (new - state) * live[t][:, None]
            if keep:
                tape.append((t, state, z, r, new, x[:, 2 * h :]))
            states[t] = state = nxt
        return states, tape

    def forward(self, gf: np.ndarray, gb: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple:
        """Logits of windows from their input gates (T, N, 3H) for both directions."""
        sf, tf = self._side(gf, live, "f", keep)
        sb, tb = self._side(gb, live, "b", keep)
        s = np.concatenate([sf, sb], 2)
        a = np.tanh(s @ self.p["wa"] + self.p["ba"])
        e = a @ self.p["va"] + (live - 1) * 1e9
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, s)
        return pooled @ self.p["wo"] + self.p["bo"][0], (s, a, w, pooled, tf, tb)

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]

    # -- backward -----------------------------------------------------------------------------------

    def _back(self, side: str, d: np.ndarray, tape: list, live: np.ndarray, grad: dict) -> np.ndarray:
        h, u = HIDDEN, self.p[f"u{side}"]
        dg = np.zeros((len(d), d.shape[1], 3 * h), np.float32)
        du, ds = np.zeros_like(u), np.zeros_like(d[0])
        for t, state, z, r, new, xn in reversed(tape):
            ds = ds + d[t]
            on = ds * live[t][:, None]
            dz = on * (state - new) * z * (1 - z)
            dn = on * (1 - z) * (1 - new * new)
            dr = dn * xn * r * (1 - r)
            dg[t] = np.concatenate([dz, dr, dn], 1)
            dx = np.concatenate([dz, dr, dn * r], 1)
            du += state.T @ dx
            ds = ds - on * (1 - z) + dx @ u.T
        grad[f"u{side}"] = du
        return dg

    def gradients(self, looked: tuple, index: np.ndarray, live: np.ndarray, y: np.ndarray, *odds: np.ndarray) -> dict:
        """Of the mean logistic loss of windows: ``index`` (T, N) picks their words."""
        x = self.inputs(looked, *odds)
        gf, gb = self.gates(x)
        logit, (s, a, w, pooled, tf, tb) = self.forward(gf[index], gb[index], live, True)
        dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        p, g = self.p, {"wo": pooled.T @ dl, "bo": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["wo"]
        dw = np.einsum("nh,tnh->tn", dp, s)
        de = w * (dw - (w * dw).sum(0))
        g["va"] = np.einsum("tn,tna->a", de, a)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", s, da), da.sum((0, 1))
        ds = w[:, :, None] * dp + da @ p["wa"].T
        dx = np.zeros_like(x)
        for side, d, tape in (("f", ds[:, :, :HIDDEN], tf), ("b", ds[:, :, HIDDEN:], tb)):
            dg = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(dg, index.ravel(), self._back(side, d, tape, live, g).reshape(-1, 3 * HIDDEN))
            g[f"w{side}"], g[f"c{side}"] = x.T @ dg, dg.sum(0)
            dx += dg @ p[f"w{side}"].T
        ids, buckets, _, counts = looked
        g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(g["words"], ids, dx[:, :WORD_DIM])
        g["words"][-1] = 0
        np.add.at(g["grams"], buckets, np.repeat(dx[:, WORD_DIM + 1 : WORD_DIM + 1 + GRAM_DIM] / counts[:, None], counts, 0))
        return g

    # -- scores -------------------------------------------------------------------------------------

    def probability(self, logit: np.ndarray, windows: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        return _sigmoid(np.clip(self.scale * logit + self.size * np.log(windows) + self.shift, -30, 30).astype(np.float64))


def spans(n: int) -> list[int]:
    """Starts of the windows of a text of n words: every STRIDE words, and one that ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def window_starts(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: start, size and text of all windows."""
    base, starts, sizes, owner = 0, [], [], []
    for k, n in enumerate(lengths):
        own = spans(n)
        starts += [base + s for s in own]
        sizes += [min(n, WINDOW)] * len(own)
        owner += [k] * len(own)
        base += n
    return np.array(starts, np.int64), np.array(sizes, np.int32), np.array(owner, np.int32)


def window_index(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: word positions (T, N) of all windows, live mask, text of each window."""
    starts, sizes, owner = window_starts(lengths)
    t = np.arange(WINDOW)[:, None]
    live = t < sizes
    return np.where(live, starts + t, 0), live.astype(np.float32), owner


def fit(texts: list[bytes], y: np.ndarray, totals: tuple[int, int] | None = None, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """``totals``: labelled rows of each class, of which ``texts`` are a sample, for the calibration.  With fewer than two texts of a class, every score is the share of label 1 (0 without texts)."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        net = Network({}, np.zeros(1), np.zeros(GRAMS))
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    weight = np.where(y == 1, (totals or (0, n_pos))[1] / n_pos, (totals or (n_neg, 0))[0] / n_neg)
    nth = _nth(y)
    own = nth % 4 == 1  # of two texts of a class one
    net = _fit([t for t, o in zip(texts, own) if not o], y[~own], epochs, seed)
    scorer = Scorer(net)
    parts = [scorer.highest([texts[i] for i in part]) for part in np.array_split(np.flatnonzero(own), max(1, own.sum() // 64))]
    _calibrate(net, np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]), y[own], weight[own] / weight[own].mean())
    return net


def _nth(y: np.ndarray) -> np.ndarray:
    """The place of each text among those of its class."""
    nth = np.zeros(len(y), np.int64)
    for c in (0, 1):
        nth[y == c] = np.arange((y == c).sum())
    return nth


def _fit(texts: list[bytes], y: np.ndarray, epochs: int, seed: int) -> Network:
    """The trained network.  What is held of a text are its words' numbers and its windows' starts."""
    one: dict[bytes, int] = {}
    rows = [np.array([one.setdefault(w, len(one)) for w in text_words(t)], np.int32) for t in texts]
    types = list(one)
    del one
    n_pos, n_neg, fold = int((y == 1).sum()), int((y == 0).sum()), _nth(y) % FOLDS
    # texts of each part and class that hold a word or an n-gram
    looked = _buckets(types)
    seen, held = np.zeros((FOLDS, 2, len(types))), np.zeros((FOLDS, 2, GRAMS))
    for ws, k, f in zip(rows, y.astype(int), fold):
        own = np.unique(ws)
        seen[f, k, own] += 1
        held[f, k, np.unique(np.concatenate([looked[0][looked[1][w] : looked[1][w] + looked[2][w]] for w in own]))] += 1 if len(own) else 0
    total = seen.sum((0, 1))
    known = np.flatnonzero(total >= 3)
    vocabulary = {types[i]: n for n, i in enumerate(known.tolist())}
    numbers = np.full(len(types), len(known), np.int64)
    numbers[known] = np.arange(len(known))
    texts_of = np.array([[((y == c) & (fold == f)).sum() for c in (0, 1)] for f in range(FOLDS)])

    def odds(counts: np.ndarray, without: int | None) -> np.ndarray:
        n, of = (counts.sum(0), texts_of.sum(0)) if without is None else (counts.sum(0) - counts[without], texts_of.sum(0) - texts_of[without])
        return _log_odds(n[1], n[0], of[1], of[0])

    net = Network(vocabulary, np.concatenate([odds(seen, None)[known], [0.0]]), odds(held, None), seed)
    # a word has a row for each part that its texts are in: row = part * words + word
    n_types = len(types)
    word_odds = np.stack([np.where(total >= 3, odds(seen, f), 0) for f in range(FOLDS)]).astype(np.float32)
    gram_odds = np.stack([odds(held, f) for f in range(FOLDS)]).astype(np.float32)
    buckets, begins, counts = looked
    del seen, held, types

    flat = np.concatenate([ws + np.int32(f * n_types) for ws, f in zip(rows, fold)] + [np.zeros(1, np.int32)])
    lengths = [len(ws) for ws in rows]
    del rows
    starts, sizes, owner = window_starts(lengths)
    label = y[owner]
    t = np.arange(WINDOW)[:, None]

    def windows(some: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Some windows' distinct words (looked up), which word stands where, live mask, and the words' log-odds."""
        live = t < sizes[some]
        used, inv = np.unique(flat[np.where(live, starts[some] + t, 0)], return_inverse=True)
        part, word = np.divmod(used, n_types)
        n = counts[word]
        own = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        grams_ = buckets[np.repeat(begins[word] - own, n) + np.arange(n.sum())]
        return (numbers[word], grams_, own, n), inv.reshape(WINDOW, len(some)), live.astype(np.float32), word_odds[part, word], gram_odds[np.repeat(part, n), grams_]

    def ranks(work) -> np.ndarray:
        found = []
        for b in range(0, len(starts), 1024):
            looked, index, live, *own = windows(np.arange(b, min(b + 1024, len(starts))))
            found.append(work(net.inputs(looked, *own), index, live))
        return np.concatenate(found)

    def by_odds(x: np.ndarray, index: np.ndarray, live: np.ndarray) -> np.ndarray:
        return ((np.maximum(x[:, WORD_DIM], 0) + np.maximum(x[:, -2], 0) ** 2 / _CLIP)[index] * live).sum(0)

    def by_network(x: np.ndarray, index: np.ndarray, live: np.ndarray) -> np.ndarray:
        gf, gb = net.gates(x)
        return net.forward(gf[index], gb[index], live)[0]

    rank = ranks(by_odds)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step = 0
    balance = min(3.0, max(1.0, n_neg / n_pos))
    for epoch in range(epochs):
        order = np.lexsort((-rank, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        # a toxic text shows in its best window; a clean text in none: its best three and one by chance
        picked = order[np.where(label[order] == 1, place < 1, place < 3)]
        others = np.flatnonzero(label == 0)
        picked = np.concatenate([picked, rng.choice(others, min(len(others), n_neg), replace=False)])
        picked = np.concatenate([picked, np.repeat(picked[label[picked] == 1], int(balance) - 1)])
        rng.shuffle(picked)
        for some in np.array_split(picked, max(PASS_STEPS, -(-len(picked) // BATCH))):
            if not len(some):
                continue
            looked, index, live, *own = windows(some)
            g = net.gradients(looked, index, live, label[some].astype(np.float32), *own)
            step += 1
            rate = RATE * (0.5 if epoch > epochs * 0.6 else 1) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in net.p:
                gk = np.clip(g[k], -1, 1) + 1e-5 * net.p[k]
                m[k] += 0.1 * (gk - m[k])
                v[k] += 0.001 * (gk * gk - v[k])
                net.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        if WARM - 2 < epoch < epochs - 1:
            rank = ranks(by_network)
    return net


def _buckets(types: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram buckets of the words end to end, where each word's begin, and their numbers."""
    found = [grams(types[b : b + 8192]) for b in range(0, len(types), 8192)] or [(np.empty(0, np.int64), np.empty(0, np.int64))]
    buckets, counts = (np.concatenate(x) for x in zip(*found))
    return buckets.astype(np.int32), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts


def _calibrate(net: Network, top: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """A logistic of the highest logit and the log of the number of windows, by Newton steps with a small penalty."""
    x = np.stack([top, np.log(windows), np.ones(len(y))], 1)
    b = base = np.array([1.0, 0.0, 0.0])
    loss = lambda b: float((weight * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + 0.05 * ((b - base) ** 2).sum())
    now = loss(b)
    for _ in range(60):
        p = _sigmoid(np.clip(x @ b, -30, 30))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.1
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.1 * (b - base))
        while (new := loss(b - step)) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        if new >= now:
            break
        b, now = b - step, new
    net.scale, net.size, net.shift = max(float(b[0]), 1e-3), float(b[1]), float(b[2])


class Scorer:
    """Scores whole texts, remembering the input gates of words."""

    def __init__(self, net: Network) -> None:
        self.net, self.at, self.n = net, {}, 0
        self.gf = np.empty((1024, 3 * HIDDEN), np.float32)
        self.gb = np.empty((1024, 3 * HIDDEN), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        while self.n + len(new) > len(self.gf):
            self.gf, self.gb = (np.concatenate([g, np.empty_like(g)]) for g in (self.gf, self.gb))
        for b in range(0, len(new), 4096):
            part = new[b : b + 4096]
            f, k = self.net.gates(self.net.inputs(self.net.lookups(part)))
            self.gf[self.n : self.n + len(part)], self.gb[self.n : self.n + len(part)] = f, k
            self.at.update(zip(part, range(self.n, self.n + len(part))))
            self.n += len(part)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.at.get, words))
        if None in found:
            if self.n > CACHE:
                self.at, self.n = {}, 0
                found = [None] * len(words)
            new = list(dict.fromkeys(w for w, i in zip(words, found) if i is None))
            self._learn(new)
            found = list(map(self.at.__getitem__, words))
        return np.array(found, np.int64)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        return self.net.probability(*self.highest(texts))

    def highest(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The highest window's logit of each text, and its number of windows."""
        words = [text_words(t) for t in texts]
        lengths = [len(w) for w in words]
        top = np.full(len(texts), -np.inf)
        if not any(lengths):
            flat = np.zeros(1, np.int64)
            self._ids([b"."]) if not self.n else None
        else:
            flat = self._ids([w for ws in words for w in ws])
        index, live, owner = window_index(lengths)
        for b in range(0, index.shape[1], 1024):
            i = flat[np.minimum(index[:, b : b + 1024], len(flat) - 1)]
            logit, _ = self.net.forward(self.gf[i], self.gb[i], live[:, b : b + 1024])
            np.maximum.at(top, owner[b : b + 1024], logit)
        return top, np.bincount(owner, minlength=len(texts)).astype(float)


    def many(self, texts: list[bytes | None]) -> np.ndarray:
        return np.concatenate([self.scores(texts[b : b + 64]) for b in range(0, len(texts), 64)]) if texts else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Network:
    """Learns from at most ``rows`` labelled texts of each class outside the held-out remainder, of any length, in a fixed order."""
    some = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col(label_col).cast("int").alias("y")).where("lid IS NOT NULL AND y IN (0, 1)").where(crc_mod("lid", mod) != held)
    counts = dict(some.groupBy("y").count().collect())
    some = some.distinct()
    some = some.where("y = 0").orderBy(F.xxhash64("lid"), "lid").limit(rows).unionByName(some.where("y = 1").orderBy(F.xxhash64("lid"), "lid").limit(rows))
    texts = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).cast("binary").alias("text"))
    got = texts.join(F.broadcast(some), "lid")  # at most 2 * rows pairs of numbers
    # ids may repeat: as many as asked for
    parts = [got.where(F.col("y") == k).orderBy(F.xxhash64("lid"), "lid", "text").limit(rows) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1]).select("y", "text").collect()
    return fit([bytes(r.text or b"") for r in sample], np.array([r.y for r in sample], float), (counts.get(0, 0), counts.get(1, 0)))


_scorers: dict[int, tuple[object, Scorer]] = {}


def _scorer(net: Network) -> Scorer:
    """This worker's scorer; one network at a time is remembered."""
    if _scorers.get(0, (None,))[0] is not net:
        _scorers[0] = (net, Scorer(net))
    return _scorers[0][1]


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, network: Network | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; nothing is shuffled."""
    net = docs.sparkSession.sparkContext.broadcast(network or train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(net.value)
        for batch in small_batches(batches):
            yield batch.filter(pa.array(scorer.many(batch.column(at).cast(pa.binary()).to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, held: int = 0, threshold: float = 0.5, network: Network | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted (score >= ``threshold``).

    The whole text is scored, in windows of WINDOW words each STRIDE words.  Null, empty and word-less texts are one window of nothing.  A
    null id is not held out.  Without labels of both classes the score is the share of label 1.  Only the text
    enters a score; other columns are not read.
    """
    net = docs.sparkSession.sparkContext.broadcast(network or train(docs, labels, id_col, text_col, label_col, mod, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(net.value)
        for batch in small_batches(batches):
            s = scorer.many(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.select("doc_id", F.coalesce(crc_mod("doc_id", mod) == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
