"""Exact top-k by inner product with a pivot table.

Vectors become integers floor(scale * x).  Distances to the pivots fix where a vector lies in the pivots' span and how
long the rest of it is, so the table holds those coordinates: the inner product of two vectors is at most that of
their coordinates plus the product of their rests, which no bound from the same distances undercuts (the triangle's
included).  Pivots are the same for all blocks, taken far from each other out of a bounded sample of the vectors, and at
most three quarters of the dimension.  A task packs candidates that are nearest to the same pivot into the same strips,
and strips whose ball a query's score cannot reach are passed over whole.  The k-th score that a query reaches on the
sample travels with it, and rises with the candidates that its task has seen: only candidates whose bound
reaches it are evaluated.  Queries are dealt in blocks too; a task sees pairs of blocks, those of a block of candidates in a row.

Bounds take a product of matrices for every strip that is not passed over, so work still grows with queries times
candidates, as the square of a table whose queries are a fixed share of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE, PIVOTS, STRIP = 256, 128, 128
#: Vectors that pivots and first thresholds are taken from; any choice gives the same result.
SAMPLE = 2048
#: Blocks of candidates that a task holds to put near ones together.
HELD = 8
#: Rows of a block of queries and of candidates: small, as a task joins many pairs of blocks.
QUERY_BLOCK, BLOCK = 1024, 1024
#: Share of a vector's length by which bounds are raised, far above the rounding error of its rest.
SLACK = 1e-5
NONE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array<long>); vectors that are null or hold a null or non-finite component are left out."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def far_first(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of ``sample``, each the farthest from those before it."""
    at, near = [0], None
    while len(at) < min(pivots, len(sample)):
        d = ((sample - sample[at[-1]]) ** 2).sum(1)
        near = d if near is None else np.minimum(near, d)
        at.append(int(near.argmax()))
    return sample[at]


def _blocks(rows: DataFrame, size: int, held_rows: int, arrange) -> DataFrame:
    """Rows packed by the task that reads them: dim, ids, matrix and extra (of each row) as bytes, one row for each block and dimension.

    ``arrange(dim, ids, matrix)`` gives the order of up to ``held_rows`` rows, and what is kept beside each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def put(dim: int) -> Iterator[pa.RecordBatch]:
            ids, vs = (np.array(x, np.int64) for x in held.pop(dim))
            vs = vs.reshape(len(ids), dim)
            order, extra = arrange(dim, ids, vs)
            for b in range(0, len(ids), size):
                some = order[b : b + size]
                cols = [pa.array([x[some].tobytes()], pa.binary()) for x in (ids, vs, extra)]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *cols], ["dim", "ids", "m", "extra"])

        for batch in batches:
            v = batch.column(1)
            flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for i, key in enumerate(batch.column(0).to_pylist()):
                x = flat[ends[i] : ends[i + 1]]
                ids, vs = held.setdefault(len(x), ([], []))
                ids.append(key)
                vs.append(x)
                if len(ids) == held_rows:
                    yield from put(len(x))
        for dim in list(held):
            yield from put(dim)

    return rows.mapInArrow(run, "dim int, ids binary, m binary, extra binary")


def span(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal columns for the first pivots, three quarters of the dimension at most: with all of it a bound would cost what a score costs."""
    return np.linalg.qr(pivots[: max(1, pivots.shape[1] * 3 // 4)].T.astype(np.float64))[0]


class Table:
    """Vectors of a block with their lengths, their coordinates in the pivots' span and, last of these, the length of the rest."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, basis: np.ndarray):
        self.ids, self.v, self.f = ids, v, v.astype(np.float64)
        self.most, self.length = np.abs(self.f).max(initial=0), np.sqrt((self.f * self.f).sum(1))
        u = self.f @ basis
        rest = np.sqrt(np.maximum(0, self.length**2 - (u * u).sum(1))) + SLACK * self.length
        self.row = np.column_stack([u, rest])
        starts = range(0, len(ids), STRIP)
        self.centre = np.array([self.f[b : b + STRIP].mean(0) for b in starts])
        self.radius = np.array([np.sqrt(((self.f[b : b + STRIP] - m) ** 2).sum(1).max()) + SLACK * self.length[b : b + STRIP].max() for b, m in zip(starts, self.centre)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of a with those of b, by doubles where these are exact."""
    if np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _first(i: np.ndarray, s: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k highest scores s of each i are, in order, and their ranks from 0."""
    at = np.lexsort((tie, -s, i))
    rank = np.arange(len(at)) - np.searchsorted(i[at], i[at])
    return at[rank < k], rank[rank < k]


def search(q: Table, c: Table, k: int, floor: np.ndarray, best: np.ndarray, evaluated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, of candidates, and scores: each query's k best in the block, those below its floor left out.

    ``best`` has the k highest scores that each query has met in earlier blocks; it, the floors and the numbers of
    evaluated candidates are brought up to date.
    """
    exact = q.most * c.most * q.v.shape[1] < 2**53
    qv, cv = (q.f, c.f) if exact else (q.v, c.v)
    chunk = (1 << 20) // q.v.shape[1] + 1
    near = q.f @ c.centre.T + q.length[:, None] * c.radius[None]
    found = [np.empty((3, 0), np.int64)]
    for n, b in enumerate(range(0, len(c.ids), STRIP)):
        rows = np.flatnonzero(near[:, n] >= floor)
        i, j = np.nonzero(q.row[rows] @ c.row[b : b + STRIP].T >= floor[rows, None])
        i, j = rows[i], j + b
        evaluated += np.bincount(i, minlength=len(evaluated))
        s = np.concatenate([np.empty(0, np.int64)] + [np.einsum("ij,ij->i", qv[i[x : x + chunk]], cv[j[x : x + chunk]]).astype(np.int64) for x in range(0, len(i), chunk)])
        keep = (s >= floor[i]) & (c.ids[j] != q.ids[i])
        i, j, s = i[keep], j[keep], s[keep]
        if len(i):
            found.append(np.array([i, j, s]))
            at, rank = _first(i, s, c.ids[j], k)
            more = np.full_like(best, NONE)
            more[i[at], rank] = s[at]
            some = np.unique(i)
            best[some] = np.sort(np.concatenate([best[some], more[some]], 1), 1)[:, -k:]
            floor[some] = np.maximum(floor[some], best[some, 0])
    i, j, s = np.concatenate(found, 1)
    keep = s >= floor[i]
    i, j, s = i[keep], j[keep], s[keep]
    at, _ = _first(i, s, c.ids[j], k)
    return i[at], j[at], s[at]


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, pivots: np.ndarray | None = None, least: np.ndarray | None = None, evaluated: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best candidates in one block, those below its ``least`` score left out.

    Ties go to the smaller id.  Bounds are in doubles with a slack far above their rounding error, so that a candidate is
    never passed over; scores are integers.  ``evaluated`` takes the number of candidates that each query evaluates.
    """
    basis = span(far_first(c.astype(np.float64), max(1, c.shape[1] * 3 // 4)) if pivots is None else pivots)
    seen, floor = np.zeros(len(qid), np.int64), np.full(len(qid), NONE) if least is None else least.copy()
    i, j, s = search(Table(qid, q, basis), Table(cid, c, basis), k, floor, np.full((len(qid), k), NONE), seen)
    if evaluated is not None:
        evaluated += seen.tolist()
    return list(zip(qid[i].tolist(), cid[j].tolist(), s.tolist()))


def least_scores(qid: np.ndarray, q: np.ndarray, sid: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query on the sample's other rows, which its k-th of all rows cannot be below; without k of them the least number."""
    out = np.full(len(qid), NONE)
    for i, scores in enumerate(products(q, sample)):
        s = scores[sid != qid[i]]
        if len(s) >= k:
            out[i] = np.partition(s, -k)[-k]
    return out


def grid(partitions: int, every: int) -> tuple[int, int]:
    """Rows and columns of cells for tasks: candidates go to one column and every row, the fewer queries to one row and every column."""
    rows = max(1, round(math.sqrt(partitions / every)))
    return rows, math.ceil(partitions / rows)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every`` its k best others.

    Candidates are all other rows with the query's dimension; fewer rows if there are fewer.  Ids are taken as
    unique: rows that repeat a query's id are not its candidates; a candidate id that repeats gives a row each
    time.  Null ids, null vectors and vectors with null or non-finite components take no part.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    drawn: dict[int, tuple[list[int], list]] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect():
        got = drawn.setdefault(len(r.v), ([], []))
        got[0].append(r.id)
        got[1].append(r.v)
    known = {}
    for dim, (ids, v) in drawn.items():
        # an id that repeats counts once: its rows are not more candidates than one for the threshold
        at = np.unique(np.array(ids, np.int64), return_index=True)[1]
        m = np.array(v, np.int64).reshape(len(ids), dim)[at]
        known[dim] = np.array(ids, np.int64)[at], m, far_first(m.astype(np.float64), min(pivots, max(1, dim * 3 // 4)))
    told = vectors.sparkSession.sparkContext.broadcast(known)  # at most SAMPLE vectors

    def near_together(dim: int, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = told.value[dim][2] if dim in told.value else m[:1].astype(np.float64)
        x = m.astype(np.float64)
        nearest = ((p * p).sum(1)[None] - 2 * (x @ p.T)).argmin(1) if dim else np.zeros(len(ids), int)
        return np.argsort(nearest, kind="stable"), np.zeros(len(ids), np.int8)

    def with_thresholds(dim: int, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = least_scores(ids, m, *told.value[dim][:2], k) if dim in told.value and dim else np.full(len(ids), NONE)
        return np.arange(len(ids)), least

    queries = _blocks(rows.where(F.col("id") % every == 0), QUERY_BLOCK, QUERY_BLOCK, with_thresholds)
    number = F.monotonically_increasing_id()
    q = queries.select("dim", F.col("ids").alias("qids"), F.col("m").alias("qm"), F.col("extra").alias("least"), number.alias("qblock"))
    c = _blocks(rows, BLOCK, HELD * BLOCK, near_together).drop("extra").withColumn("block", number)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = {}
        now, c = None, None  # the block of candidates that the last pair had
        reached: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # floors and k highest scores of each block of queries
        for batch in batches:
            found = [np.empty((3, 0), np.int64)]
            for n in range(batch.num_rows):
                dim, qb, cb = (batch.column(x)[n].as_py() for x in ("dim", "qblock", "block"))
                a, b, least = (np.frombuffer(batch.column(x)[n].as_buffer(), np.int64) for x in ("qids", "ids", "least"))
                if dim == 0:
                    found += [np.array([[x] * len(y), y, [0] * len(y)]) for x in a for y in [np.sort(b[b != x])[:k]]]
                    continue
                if now != cb:
                    vectors_ = np.frombuffer(batch.column("m")[n].as_buffer(), np.int64).reshape(-1, dim)
                    if dim not in bases:
                        bases[dim] = span(told.value[dim][2] if dim in told.value else vectors_[:pivots])
                    now, c = cb, Table(b, vectors_, bases[dim])
                if qb not in reached:
                    reached[qb] = least.copy(), np.full((len(a), k), NONE)
                i, j, s = search(Table(a, np.frombuffer(batch.column("qm")[n].as_buffer(), np.int64).reshape(-1, dim), bases[dim]), c, k, *reached[qb], np.zeros(len(a), np.int64))
                found.append(np.array([a[i], b[j], s]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(found, 1)], ["query_id", "vec_id", "score"])

    rows_, columns = grid(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), every)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("at_column", deal("ids", columns)).withColumn("at_row", each(rows_))
    q = q.withColumn("at_row", deal("qids", rows_)).withColumn("at_column", each(columns))
    best = c.join(q, ["dim", "at_row", "at_column"]).select("dim", "qids", "qm", "least", "qblock", "ids", "block", "m").mapInArrow(pair, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
