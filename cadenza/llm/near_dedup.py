"""Near-duplicates by HyperMinHash.

A document's shingle hashes fall into REGISTERS buckets; a bucket keeps of its smallest hash the count of
leading zeros and MANTISSA further bits, in 16 bits.  Empty buckets take the next full bucket's register.
BANDS bands of ROWS registers propose candidates, the registers' collision-corrected estimate of the
Jaccard similarity rejects the hopeless, and the rest are confirmed on full shingle sets.

Equal sets are one class from the start.  In a band's bucket all members are first held against its
smallest id only.  What that joins is contracted; a bucket whose other members are then in one component is
done, and only between members of different components of the remaining buckets further pairs are held
against each other, inside blocks of bounded size: on full sets in each document's largest bucket, by
estimate elsewhere.  So no link between components is lost.  A group of copies never makes its square of pairs; of a
group that shares a passage but not a component every two blocks meet, so its work still grows with its square, by
registers of 400 bytes and by products of matrices inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import hash_words, scramble, small_batches, stage, window_hashes
from cadenza.llm.components import components

REGISTERS, ROWS, MANTISSA = 200, 5, 10
BANDS = REGISTERS // ROWS
#: Members of one part of a remaining bucket, where registers and where full sets are compared.
BLOCK, HOME_BLOCK = 256, 512
_BOUNDS = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], np.uint64)
_NEXT = np.array([(i << 64) // REGISTERS - 1 for i in range(1, REGISTERS + 1)], np.uint64)
FEATURES = "doc_id long, n long, k1 long, k2 long, regs binary, bands array<long>"


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; with fewer words, of the whole sequence."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    if len(words) < size:
        return window_hashes(h, len(words), seed=100 + len(words))
    return np.unique(window_hashes(h, size))


def registers(h: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers (uint16) of a non-empty sorted set of hashes."""
    first = np.searchsorted(h, _BOUNDS)
    full = first < len(h)
    low = h[np.minimum(first, len(h) - 1)]
    full &= low <= _NEXT
    share = (low - _BOUNDS).astype(np.float64) * (REGISTERS / 2.0**64)
    m, e = np.frexp(np.maximum(share, 2.0**-60))
    reg = ((np.clip(-e, 0, 60) + 1) << MANTISSA) | ((m - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64)
    at = np.flatnonzero(full)
    take = at[np.searchsorted(at, np.arange(REGISTERS)) % len(at)]
    return reg[take].astype(np.uint16)


def band_keys(reg: np.ndarray) -> np.ndarray:
    rows = reg.reshape(BANDS, ROWS).astype(np.uint64)
    key = scramble(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(ROWS):
        key = scramble(key + rows[:, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity from registers (rows of a and b), and the number of buckets it rests on.

    Only buckets that are full in either set count; a bucket that took its neighbour's register reads like the
    neighbour.  The share of equal registers is corrected for those that agree by chance: minima of sets of
    sizes na and nb that are not the same hash share a register with probability about
    0.72 * na * nb / (na + nb)^2 / 2^MANTISSA, the width of a register's cell at their common height.
    """
    return _estimate(a == b, a != np.roll(a, -1, -1), b != np.roll(b, -1, -1), na, nb)


def _estimate(equal: np.ndarray, fa: np.ndarray, fb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = np.maximum((fa | fb).sum(-1), 1)
    same = (equal & fa & fb).sum(-1) / full
    chance = 0.72 * na * nb / (na + nb) ** 2.0 / (1 << MANTISSA)
    return np.where(equal.all(-1), 1.0, (same - chance) / (1 - chance)), full


def hopeful(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair may reach ``percent``: sizes allow it, and the estimate is within five deviations and one register.

    Full buckets are a sample, without replacement, of the union's hashes, so small sets are known almost whole.
    """
    return _hopeful(*estimate(a, b, na, nb), na, nb, percent)


def _hopeful(est: np.ndarray, full: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    t = percent / 100
    union = np.maximum((na + nb) / (1 + t), full + 1.0)
    spread = np.sqrt(t * (1 - t) / full * (union - full) / (union - 1))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (est >= t - 5 * spread - 1.5 / full)


def _regs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (128 bits of the set), regs, bands; the last two null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n, k1, k2, regs, bands = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text, size)
                n.append(len(h))
                key = xxhash.xxh3_128_intdigest(h.tobytes())
                k1.append((key >> 64) - (1 << 63))
                k2.append((key & ((1 << 64) - 1)) - (1 << 63))
                if len(h):
                    r = registers(h)
                    regs.append(r.tobytes())
                    bands.append(band_keys(r))
                else:
                    regs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], [f.split()[0] for f in FEATURES.split(", ")])

    return docs.mapInArrow(run, FEATURES)


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, na, nb, ra, rb) those pairs that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                ok = hopeful(_regs(batch.column(4)), _regs(batch.column(5)), na, nb, percent)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (a, b) those whose full shingle sets reach the threshold.

    Texts are moved once, and by merge joins at every size: a plan that broadcasts small id lists and shuffles
    larger ones costs several times more from one size to the next.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    of_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    both = of_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)
        for batch in small_batches(batches):
            a, b = [], []
            for x, y, tx, ty in zip(*(c.to_pylist() for c in batch.columns)):
                if tx != last:  # rows of one a follow each other
                    last, own = tx, shingle_set(tx, size)
                other = shingle_set(ty, size)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both) > 0:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _grouped(rows: DataFrame, keys: list[str], work) -> DataFrame:
    """``work`` on the rows of each (band, block), which lie in one task one after the other; (a, b) pairs come out.

    The rows are tuples in the order of the columns; a block's size is bounded, so a group is too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = list(work(group)) if len(group) > 1 else []
            a, b = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in small_batches(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:2] != group[0][:2]:
                    yield flush()
                    group = []
                group.append(row)
        yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("band", "block", "own", "doc_id", "component", *keys).repartition(n, "band", "block").sortWithinPartitions("band", "block")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """A bucket's members dealt to parts of about ``size``, and a row for each pair of parts: ``block`` and ``own`` part."""
    r = rows.withColumn("parts", F.ceil(F.col("members") / F.lit(size)).cast("int"))
    r = r.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return r.withColumn("block", F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other"))


def _of_pairs(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and components of a block's members, and which pairs count: different components, and different parts if there are two."""
    ids, comp, part = (np.array([g[i] for g in group], np.int64) for i in (3, 4, 2))
    open_ = comp[:, None] != comp[None]
    if part.min() != part.max():
        open_ &= part[:, None] != part[None]
    return ids, comp, np.triu(open_, 1)


def exact_links(sets: list[np.ndarray], wanted: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the wanted pairs of sets those that reach ``percent``: intersections counted by matrix products over shared hashes."""
    n = np.array([len(x) for x in sets], np.int64)
    wanted = wanted & (100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None]))
    if not wanted.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(sets)), n)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    rows, at = rows[shared], at[shared]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, (low, low + width))
        m = np.zeros((len(sets), width), np.float32)
        m[rows[lo:hi], at[lo:hi] - low] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    return np.nonzero(wanted & (100 * both >= percent * (n[:, None] + n[None] - both)))


def _forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of those links (i, j) that join what the links before them have not: as connected as all of them."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    kept = []
    for at, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = root(x), root(y)
        if x != y:
            top[x] = y
            kept.append(at)
    return np.array(kept, np.int64)


def _home_links(rows: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """Links (a < b) between components inside home buckets, on full sets.  ``rows``: ..., hashes (binary).

    With ``forest`` a block gives no more of them than connect what they connect, so fewer than it has members.
    """

    def work(group: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, comp, wanted = _of_pairs(group)
        if wanted.any():
            i, j = exact_links([np.frombuffer(g[5], np.uint64) for g in group], wanted, percent)
            if forest:
                i, j = (x[_forest(i, j)] for x in (i, j))
            yield ids[i], ids[j]

    return _grouped(rows, ["hashes"], work)


def _between(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of different components and homes that may reach the threshold, each in its first common band."""

    def work(group: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, comp, wanted = _of_pairs(group)
        n, home = np.array([g[5] for g in group], np.int64), np.array([g[7] for g in group], np.int64)
        wanted &= home[:, None] != home[None]
        if not wanted.any():
            return
        regs = np.frombuffer(b"".join(g[6] for g in group), np.uint16).reshape(-1, REGISTERS)
        full = regs != np.roll(regs, -1, -1)
        here = int(np.argmax(band_keys(regs[0]) == group[0][0]))
        wanted &= 100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None])
        for i in np.flatnonzero(wanted.any(1)):
            j = np.flatnonzero(wanted[i])
            equal = regs[j] == regs[i]
            first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == here
            j, equal = j[first], equal[first]
            if len(j):
                j = j[_hopeful(*_estimate(equal, full[i], full[j], n[i], n[j]), n[i], n[j], percent)]
                yield np.full(len(j), ids[i]), ids[j]

    return _grouped(rows, ["n", "regs", "home"], work)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "hashes"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of ``size``-word
    shingles (words lower-cased A-Z).  Null texts, and texts without words, have empty sets and no links.  Rows
    that share an id are one document; a row with a null id has a null component and is kept.  Other columns
    are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    every = stage(features(docs, size), "features")
    keys = ["k1", "k2", "n"]
    reps = every.where("n > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    reps = stage(reps, "classes")
    own = every.join(reps, [*keys]).where("doc_id = rep").select("doc_id", "n", "regs", "bands")
    own = stage(own, "representatives")
    banded = own.select("doc_id", F.explode("bands").alias("band"))
    # written, so that the join below shuffles both sides and a hot bucket can be split between tasks
    buckets = stage(banded.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("members")).where("pivot < last").select("band", "pivot", "members"), "buckets")
    members = stage(banded.join(buckets, "band").where("doc_id <> pivot"), "members")
    # first: every member of a bucket against the bucket's smallest id
    stars = members.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    left, right = (own.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab")
    tried = stage(_estimated(stars.join(right.hint("merge"), "b").join(left.hint("merge"), "a"), percent), "tried")
    links = stage(_confirmed(tried, docs, size, percent), "links")
    joined = components(links, "first")
    # then: buckets of three and more whose members are still in different components
    open_ = members.where("members > 2").join(joined, members.doc_id == joined.id, "left").select("band", "doc_id", "members", F.coalesce("component", "doc_id").alias("component"))
    rest = open_.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    open_ = stage(open_.join(rest, "band"), "open")
    # each open document is held in full against the others of its largest open bucket, its home; there groups of
    # documents that share a passage meet, and what they are not is found without a pair leaving its block
    homes = stage(open_.groupBy("doc_id").agg(F.max(F.struct("members", "band")).alias("h"), F.first("component").alias("component")).select("doc_id", "component", F.col("h.members").alias("members"), F.col("h.band").alias("band")), "homes")
    hashes = _sets(docs.join(homes.select("doc_id").hint("merge"), "doc_id", "left_semi"), size)
    found = stage(_home_links(_blocked(homes.join(hashes, "doc_id"), HOME_BLOCK), percent), "home-links")
    # pairs whose homes differ are estimated in the other buckets that they share, then confirmed like the stars
    rows = open_.join(own.select("doc_id", "n", "regs"), "doc_id").join(homes.select("doc_id", F.col("band").alias("home")), "doc_id")
    more = stage(_between(_blocked(rows, BLOCK), percent).join(tried, ["a", "b"], "left_anti"), "between")
    added = found if more.isEmpty() else found.union(stage(_confirmed(more, docs, size, percent), "more-links"))
    if not added.isEmpty():
        joined = components(joined.select(F.col("component").alias("a"), F.col("id").alias("b")).union(added), "second")
    named = every.select("doc_id", *keys).join(reps, keys, "left").join(joined, F.col("rep") == F.col("id"), "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(s) AS s FROM g),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n_shingles + nb.n_shingles - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
