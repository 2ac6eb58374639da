"""Substring dedup by compaction of a de Bruijn graph of word windows.

A window of WINDOW words is an edge.  Each window has a minimizer, the leftmost of its SEED-word k-mers with
the smallest hash; consecutive windows of a document that share one occurrence of it form a path piece.  A
minimizer whose pieces are all the same piece is not a branching node: if it occurs twice, the whole piece
repeats, and joins mark it at once at all its source coordinates.  Only where pieces differ, at the ends of
shared passages, are they opened into single edges, read again at the source coordinates of one piece of
each kind, and counted.  Pieces and edges are told by digests of their words as they stand at their source coordinates,
64 and 128 bits, besides the 64 bits of the minimizer.  Counts are summed before they are shuffled; a common passage is
never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import drop_stage, hash_words, scramble, small_batches, stage

WINDOW, SEED = 35, 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _joined(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return scramble(a * _A + scramble(b + np.uint64(k)) * _B)


def span_hashes(h: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all runs of the given lengths, by doubling: a run is told by two shorter runs that cover it."""
    known = {1: h}

    def get(k: int) -> np.ndarray:
        if k not in known:
            half = 1 << ((k - 1).bit_length() - 1)  # the largest power of two below k
            s = get(half)
            n = max(0, len(h) - k + 1)
            known[k] = _joined(s[:n], s[k - half : k - half + n], k)
        return known[k]

    return {k: get(k) for k in sizes}


def pieces(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """minimizer, digest of the words, start, windows of the path pieces of one document."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    seed = min(SEED, window)
    k = span_hashes(hash_words(words), (seed,))[seed]
    at = np.lib.stride_tricks.sliding_window_view(k, window - seed + 1).argmin(1) + np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([start, [n]]))
    text, ends = _laid_out(words)
    digests = [xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(ends[start].tolist(), (ends[start + count + window - 1] - 1).tolist())]
    return k[at[start]], np.array(digests, np.uint64), start, count


def _laid_out(words: list[bytes]) -> tuple[memoryview, np.ndarray]:
    """The words one space apart, and where each begins (the last entry: after the last word and a space)."""
    return memoryview(b" ".join(words)), np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])


def _rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[tuple] = []
            for rid, rest, text in zip(*(c.to_pylist() for c in batch.columns)):
                m, p, s, c = pieces((text or b"").split(), window)
                out.append((m.view(np.int64), p.view(np.int64), np.full(len(m), rid, np.int64), np.full(len(m), rest, np.int64), s, c))
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols[:3]] + [pa.array(x.astype(np.int32)) for x in cols[3:]], ["mini", "piece", "rid", "rest", "start", "n"])

    return docs.select("rid", "rest", "text").mapInArrow(run, "mini long, piece long, rid long, rest int, start int, n int")


def _opened(asked: DataFrame, window: int) -> DataFrame:
    """Edges of the asked pieces, read at their source: mini, piece, cnt, at (in the piece), and 128 bits of the digest of the edge's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[tuple] = []
            for text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                laid, ends = _laid_out(text.split())
                for a in asks:
                    s, n = a["start"], a["n"]
                    edges = b"".join([xxhash.xxh3_128_digest(laid[i:j]) for i, j in zip(ends[s : s + n].tolist(), (ends[s + window : s + window + n] - 1).tolist())])
                    high, low = np.frombuffer(edges, np.int64).reshape(n, 2).T
                    out.append((np.full(n, a["mini"], np.int64), np.full(n, a["piece"], np.int64), np.full(n, a["cnt"], np.int64), np.arange(n), high, low))
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["mini", "piece", "cnt", "at", "high", "low"])

    return asked.select("text", "asks").mapInArrow(run, "mini long, piece long, cnt long, at long, high long, low long")


def keep_mask(n: int, spans: list[tuple[int, int, int]], window: int) -> np.ndarray:
    """Words that stay of n: (start, windows, bits) name the repeated windows of a piece; bits -1 means all."""
    edge = np.zeros(n + 1, np.int64)
    for start, count, bits in spans:
        if bits == -1:
            edge[start] += 1
            edge[start + count - 1 + window] -= 1
        else:
            for k in range(count):
                if bits >> k & 1:
                    edge[start + k] += 1
                    edge[start + k + window] -= 1
    return np.cumsum(edge[:n]) == 0


def by_line(text: bytes, stay: np.ndarray) -> bytes:
    """The kept words, line by line; lines that lose all their words go."""
    at, out = 0, []
    for line in text.split(b"\n"):
        words = line.split()
        left = [w for w, s in zip(words, stay[at : at + len(words)].tolist()) if s]
        at += len(words)
        if left or not words:
            out.append(b" ".join(left))
    return b"\n".join(out)


def _row_hash():
    return F.xxhash64("doc_id", "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents with rid and rest, repeated spans): rid, rest, start, n, bits for every path piece with a repeated window.

    ``docs``: doc_id, text (binary).  Rows are told by 96 bits: rid hashes id and text, rest the text by another function.
    Rows with the same id and text share them; at 10^10 rows two others do with a probability below 10^-8.
    """
    docs = docs.withColumns({"rid": _row_hash(), "rest": F.hash("text")})
    rows = stage(_rows(docs, window), "pieces")
    # what is joined below is written first: then both sides of a join are plain shuffles, and a minimizer or a piece
    # that a common passage repeats is split between tasks
    nodes = stage(rows.groupBy("mini").agg(F.count(F.lit(1)).alias("c"), F.min("piece").alias("lo"), F.max("piece").alias("hi")).where("c > 1"), "nodes")
    found = stage(rows.join(nodes.select("mini", (F.col("lo") != F.col("hi")).alias("branches")), "mini"), "repeated")
    drop_stage(rows, nodes)
    whole = found.where("NOT branches").select("rid", "rest", "start", "n", F.lit(-1).cast("long").alias("bits"))
    open_ = found.where("branches")
    # one source coordinate for each kind of piece, summed up in every task before it is shuffled
    kinds = open_.groupBy("mini", "piece").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("rid", "rest", "start", "n")).alias("at"))
    asks = kinds.groupBy("at.rid", "at.rest").agg(F.collect_list(F.struct("mini", "piece", "cnt", "at.start", "at.n")).alias("asks"))  # no more than the document has pieces
    # equal rows hold one text: the first is enough
    edges = stage(_opened(docs.select("rid", "rest", "text").join(asks, ["rid", "rest"]).dropDuplicates(["rid", "rest"]), window), "edges")
    twice = stage(edges.groupBy("mini", "high", "low").agg(F.sum("cnt").alias("total")).where("total > 1").select("mini", "high", "low"), "repeated-edges")
    bits = stage(edges.join(twice, ["mini", "high", "low"]).groupBy("mini", "piece").agg(F.expr("bit_or(shiftleft(1L, cast(at AS int)))").alias("bits")), "bits")
    drop_stage(edges, twice)
    part = open_.join(bits, ["mini", "piece"]).select("rid", "rest", "start", "n", "bits")
    return docs, whole.unionByName(part)


def _applied(docs: DataFrame, window: int, with_text: bool, carry: tuple[str, ...]) -> DataFrame:
    keyed, spans = repeated_spans(docs, window)
    marks = spans.groupBy("rid", "rest").agg(F.collect_set(F.struct("start", "n", "bits")).alias("marks"))  # no more than the document has pieces
    extra = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "") + (f", {extra}" if carry else "")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []), *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n_words, n_removed, sha, kept = [], [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()
                left = words
                if own:
                    stay = keep_mask(len(words), [(m["start"], m["n"], m["bits"]) for m in own], window)
                    left = [w for w, s in zip(words, stay.tolist()) if s]
                if with_text:
                    kept.append(text if len(left) == len(words) else by_line(text, stay))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            cols += [pa.array(kept, pa.binary()).cast(pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[3:]], names)

    return keyed.select("rid", "rest", "doc_id", "text", *carry).join(marks, ["rid", "rest"], "left").select("doc_id", "text", "marks", *carry).mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space apart).

    Every word covered by a window of ``window`` words that also starts anywhere else, in any document or the
    same one, is removed.  A null text has no words; a text of fewer words than a window loses none.  Ids may be
    null or repeat: two equal rows repeat each other.  With ``with_text`` the cut text comes too (kept_text): lines
    stay lines, and a text that loses nothing, or is null, stays as it is.  Columns named in ``carry`` come along; others
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carry)
    return _applied(rows, window, with_text, carry)


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
x AS (SELECT r, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM g),
t AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + k AS i FROM x JOIN t USING (h), (SELECT unnest(range({WINDOW})) AS k)),
p AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.r, count(*) FILTER (c.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept
  FROM p LEFT JOIN c ON p.r = c.r AND p.i = c.i GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
