"""The Merkle manifest against a tree built in plain Python, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from cadenza.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, source = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    fields = [doc_id, source, "en", None, text]
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def steps(levels, at):
    for level in levels[:-1]:
        low = at // 16 * 16
        yield "".join(level[low:at]), "".join(level[at + 1 : low + 16])
        at //= 16


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[2], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels_of([leaf(r) for r in by_source[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            proof = [*steps(trees[s], i), *steps(top, k)]
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in proof:
                h = digest(left + h + right)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), h, h == top[-1][0]))
    return out


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 700])
def test_manifest(make_docs, n):
    sources = ["a", "b", None, "ß", "Z", "", "hot", "hot", "hot"]
    rows = [(i * 7, f"Text {i} É\n" if i % 5 else (None if i % 2 else ""), sources[i % len(sources)]) for i in range(n)]
    if n > 20:
        rows += [(7, "same ID", "a"), (7, "same ID", "a"), (None, "No id", "b"), (None, "No id", "b"), (9_000_000, "alone", "only")]
        rows += [(10**9 + i, "x", f"s{i:03}") for i in range(300)]
    got = merkle.document_manifest(make_docs(rows)).drop("proof").collect()
    assert key(tuple(r) for r in got) == key(brute(rows))


def test_proof_leads_to_root(make_docs):
    docs = make_docs([(i, f"t{i}", "ab"[i % 2]) for i in range(40)])
    for r in merkle.document_manifest(docs).collect():
        h = r.leaf
        for step in r.proof:
            h = digest(step.left.hex() + h + step.right.hex())
        assert h == r.root


def test_sql(spark, make_docs):
    rows = [(i, f"Doc {i}" if i % 3 else None, ["a", None, "c"][i % 3]) for i in range(120)]
    docs = make_docs(rows)
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(merkle.ORACLE_SQL.replace("FROM documents", "FROM (SELECT doc_id::BIGINT AS doc_id, source, lang, NULL::BIGINT AS n_chars, text FROM documents)")).fetchall()
    assert key(want) == key(tuple(r) for r in merkle.document_manifest(docs).drop("proof").collect())
