"""Token counts, packing, mixing and quality rules against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadenza.llm import html_extract, mixing, packing, quality_rules, token_counts


def test_token_counts(make_docs, corpus):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(make_docs(corpus), limit=1000, entries=50).collect()
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 1000) for i, t, _ in corpus)
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(make_docs([])).count() == 0


@pytest.mark.parametrize("text", [" ", "  ", "a ", " a", "a  b", "a \n b", "▁▁ a", "x\r\n y", "日本 語", "　"])
def test_pretokens_add_up(text):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sum(token_counts.pretoken_length(model, k) for k in token_counts.pretokens(text)) == len(model.encode(text))


def test_packing(make_docs, corpus):
    rows = [r for r in corpus if r[0] is not None]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, _ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(make_docs(rows)).collect():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length > 0 and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for at, total in [(sorted(p), len(ids[i])) for i, p in pieces.items()] + [(sorted(s), None) for s in sequences.values()]:
        end = 0
        for start, length in at:
            assert start == end
            end += length
        assert end == total if total else end <= 2048 and (end == 2048 or end & (end - 1) == 0)
    assert pieces.keys() == ids.keys()
    assert packing.pack(make_docs([])).count() == 0
    assert packing.pack(make_docs(corpus)).where("doc_id IS NULL").count() == 2


def test_sum_of_squares_choice():
    p = packing.Packer(0, capacity=10)
    for n in (6, 6, 4):
        p.place((1, 0, b"\0" * 4 * n, n))
    # two windows at level 6: the 4 fills one of them
    assert p.count[6] == 1 and len(p.out) == 2
    p.close()
    assert sum(r[2] for r in p.out) == 16


def test_the_rule_closes_the_windows():
    """All tokens but those of the last window are put by the sum-of-squares rule; open windows stay few at any number of pieces."""
    rng = np.random.default_rng(1)
    for n in (1, 40, 1_250, 30_000):
        packer, sizes = packing.Packer(0), rng.integers(1, 900, n)
        for i, k in enumerate(sizes.tolist()):
            packer.add(i, np.arange(k, dtype="<u4").tobytes())
        assert packer.count.sum() < 900
        packer.close()
        lengths = Counter()
        for doc, start, length, crc, total, sequence, at in packer.out:
            assert zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes()) == crc and at == lengths[sequence]
            lengths[sequence] += length
        assert sum(lengths.values()) == sizes.sum() == packer.placed and packer.last < 2048
        other = [v for v in lengths.values() if v != 2048]
        assert sum(other) == packer.last and all(v & (v - 1) == 0 for v in other) and len(set(other)) == len(other)
        assert packer.placed - packer.last >= 0.9 * packer.placed or n < 40


def test_frequent_pretokens_reach_the_driver(make_docs):
    """The table holds the most frequent pre-tokens of the whole corpus."""
    docs = make_docs([(i, "often often often rare%d" % i, "a") for i in range(300)] + [(None, None, None), (1, "", "a")])
    table = token_counts.frequent_lengths(docs, entries=5)
    assert len(table) == 5 and "often" in table


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    t, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > cap * sizes[s]}
        if not over:
            return t | {s: share * w[s] for s in open_}
        for s in over:
            t[s] = cap * sizes[s]
            left -= t[s]
        open_ -= over
    return t


def test_mixing(make_docs, corpus):
    size = lambda t: len((t or "").encode().split())
    sources = defaultdict(int)
    for _, t, s in corpus:
        sources[s] += size(t)
    want = targets(sources)
    got = mixing.mixed_documents(make_docs(corpus)).collect()
    assert len(got) == len(corpus)
    again = mixing.mixed_documents(make_docs(corpus)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    texts = {i: (t, s) for i, t, s in corpus if i is not None}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            t, s = texts[r.doc_id]
            assert (r["size"], r.source_size) == (size(t), sources[s]) and r.target == pytest.approx(want[s])
            taken[s] += r.taken
    for s in sources:
        assert want[s] - taken[s] < 6 + 1  # the rows without an id hold five words
    assert mixing.mixed_documents(make_docs([])).count() == 0
    order = [r.finish for p in mixing.mix(make_docs(corpus)).where("taken > 0").rdd.glom().collect() for r in p]
    assert order == sorted(order)
    # the mix is the head of the queue: what lies before the budget, to the word
    budget = sum(math.floor(t) for t in want.values())
    entries = sorted(mixing.mix(make_docs(corpus), sort=False).collect(), key=lambda r: r.position)
    assert [r.finish for r in entries] == sorted(r.finish for r in entries)
    assert sum(r.taken for r in entries) == budget and all((r.taken > 0) <= (r.position <= budget) for r in entries)
    # rows without id are dealt by their size; a source without words; the last word of a target
    rows = [(None, "w " * k, "a") for k in range(1, 60)] + [(None, None, "empty")] * 3 + [(i, "x y z", None) for i in range(7)]
    got = mixing.mixed_documents(make_docs(rows)).collect()
    want = targets({"a": sum(range(60)), "empty": 0, None: 21})
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(math.floor(t + 1e-9) for t in want.values()) and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mixed_documents(make_docs([(1, None, None), (2, "", "a")])).where("taken <> 0 OR size <> 0").count() == 0


def brute_rules(text):
    words = (text or "").encode().split()
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(three)
    hit = {i + k for i, g in enumerate(three) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(make_docs, corpus):
    odd = [(80, "A line.\nA line.\n| a | b |", "a"), (81, "x " * 60, "a"), (82, "Home | About | Contact | More\n" * 30, "a"), (83, "\n".join(f"word{i} and other{i} things were said." for i in range(20)), "a")]
    rows = corpus + odd
    texts = {i: t for i, t, _ in rows}
    got = quality_rules.quality_rules(make_docs(rows), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            n, chars, symbols, dup, repeat = brute_rules(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert by[83].kept and not by[82].kept and not by[81].kept and by[80].clean_text == "A line."
    assert quality_rules.quality_rules(make_docs([])).count() == 0


def test_sha_is_stable():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_one_word_of_a_class_drops_nothing_inside_an_article():
    page = "<body><article><h1>T</h1><div class='post tags'><p>first part stays</p></div><div class='highlight promo'><p>second part stays</p></div><p>E = <math><mi>m</mi></math> done</p><div class='ad banner'>buy</div></article><div class='box promo'>gone</div></body>"
    assert html_extract.extract(page) == "T first part stays second part stays E = m done"


def test_hidden_among_a_class_s_words_is_not_shown_inside_an_article_either():
    page = "<body><article><h1>T</h1><div class='note hidden'><p>not shown</p></div><div class='post tags overflow-hidden'><p>stays</p></div></article></body>"
    assert html_extract.extract(page) == "T stays"
