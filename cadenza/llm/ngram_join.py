"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

Sets of shingles are told apart by size bands.  A band hashes the universe into segments, SLACK more than the
largest symmetric difference of a pair of the band leaves unequal, so a pair at the threshold agrees on some segment's
subset whole.  A set sends the keys of its subsets, packed by batches, to the reducers of the key space; equal keys
are a bucket.

Which segments a set relies on is decided by cost.  Each member of a bucket is held against one pivot first; what that
joins is contracted, and a bucket in one component is done.  Of the rest a bucket costs as many pairs as it has
between different components: up to BUCKET_PAIRS they are verified, beyond that the bucket is skipped (-1), as empty
segments are from the start.  A set whose skipped segments are no more than its slack still has a relied-on segment
(0) with each partner, also if it leaves out its costliest ones up to that slack.  Only pairs that agree on more
segments than the slack, skipped ones included, are read.  The other sets index one-deletion neighbourhoods (1) of all
their remaining segments, where a pair agrees if its subsets differ by at most one shingle: that makes up for as many
skipped segments as there are others.  Sets that are skipped nearly everywhere, and neighbourhoods that cost too much,
are held against each other in blocks of bounded size, and nowhere else; a block gives the links that connect it.
Every link is verified on full sets, so the result is exact but for equal 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import drop_stage, scramble, small_batches, stage
from cadenza.llm.components import components
from cadenza.llm.near_dedup import HOME_BLOCK, _blocked, _confirmed, _home_links, _sets, shingle_set

SIZE, PERCENT, SLACK, RATIO = 5, 80, 0.1, 1.5
#: Pairs of different components that a bucket may cost; entries of a reducer's part, about; shingles of a packed batch.
BUCKET_PAIRS, PART_ENTRIES, BATCH_SHINGLES = 4096, 1_500_000, 2_000_000
_LOW_BITS = np.uint64(63)  # of a key: the band
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _lows() -> list[int]:
    lows = [1]
    while len(lows) < 64:
        lows.append(max(lows[-1] + 1, int(lows[-1] * RATIO)))
    return lows


#: Smallest sizes of the bands.
LOWS = np.array(_lows(), np.int64)


def apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Elements in only one of two sets of sizes a and b, at most, at the threshold."""
    return (100 - percent) * (a + b) // (100 + percent)


def shape(band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of bands (0: only equal sets reach the threshold) and the largest size of their smaller partners."""
    top = LOWS[band + 1] - 1
    most = apart(top, top * 100 // percent, percent)
    return np.where(most > 0, most + 1 + np.ceil(SLACK * most).astype(np.int64) + 1, 0), top


def bands_of(n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions in n, bands): every set's own band, then lower ones in which it may be the larger partner."""
    own = np.searchsorted(LOWS, n, side="right") - 1
    out, back = [(np.flatnonzero(n > 0), own[n > 0])], 1
    while True:
        at = np.flatnonzero((own >= back) & (n > 0))
        at = at[n[at] <= (LOWS[own[at] - back + 1] - 1) * 100 // percent]
        if not len(at):
            return out
        out.append((at, own[at] - back))
        back += 1


def segments(sets: list[np.ndarray], band: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(set, key, token, segment of each token, sums): the non-empty segments of sorted hash sets in their bands.

    A key is of the band, the segment and the sum of its tokens' hashes; its low bits name the band.
    """
    m, _ = shape(band, percent)
    n = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), n)
    seg = ((h >> np.uint64(32)) * m[of].astype(np.uint64)) >> np.uint64(32)
    slot = np.repeat(np.concatenate([[0], np.cumsum(m)])[:-1], n) + seg.astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(h) else np.empty(0, np.int64)
    token = scramble(h + _SALT)
    sums = np.add.reduceat(token, start) if len(start) else token
    where = (seg[start] << np.uint64(6)) | band[of[start]].astype(np.uint64)
    inner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
    return of[start], keyed(sums, where), token, inner, sums, where


def keyed(sums: np.ndarray, where: np.ndarray) -> np.ndarray:
    return (scramble(sums + scramble(where + _SALT)) & ~_LOW_BITS) | (where & _LOW_BITS)


def allowance(n: np.ndarray, band: np.ndarray, filled: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many non-empty segments of sets may be skipped while exact keys suffice, and while neighbourhoods do."""
    m, top = shape(band, percent)
    partner = np.where(n > top, top, np.minimum(n, top) * 100 // percent)
    most = apart(n, partner, percent)
    empty = m - filled
    return m - most - 1 - empty, (2 * m - most - 1) // 2 - empty


def _digest(h: np.ndarray) -> tuple[int, int]:
    key = xxhash.xxh3_128_intdigest(h.tobytes())
    return (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63)


def features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, k1, k2 (128 bits of the set), and for each of its bands the allowances: band, exact, near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            k = [_digest(s) for s in sets]
            room: list[list[dict]] = [[] for _ in sets]
            for at, band in bands_of(n, percent):
                m, _ = shape(band, percent)
                at, band = at[m > 0], band[m > 0]
                if len(at):
                    filled = np.bincount(segments([sets[i] for i in at], band, percent)[0], minlength=len(at))
                    exact, near = allowance(n[at], band, filled, percent)
                    for i, b, x, y in zip(at.tolist(), band.tolist(), exact.tolist(), near.tolist()):
                        room[i].append({"band": b, "exact": x, "near": y})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array(room, pa.list_(pa.struct([("band", pa.int32()), ("exact", pa.int32()), ("near", pa.int32())])))], ["doc_id", "n", "k1", "k2", "room"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, room array<struct<band:int,exact:int,near:int>>")


def _entries(docs: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """part, nodes, keys, ords: keys of a batch's sets for one part of the key space; an ord is a place among the nodes (16 bytes each)."""

    def packed(sets: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch | None:
        nodes = np.array(list(sets), np.int64).reshape(-1, 2)
        own = list(sets.values())
        n = np.array([len(s) for s in own], np.int64)
        keys, ords = [], []
        for at, band in bands_of(n, percent):
            live = shape(band, percent)[0] > 0
            at, band = at[live], band[live]
            if len(at):
                of, key, *_ = segments([own[i] for i in at], band, percent)
                keys.append(key)
                ords.append(at[of])
        if not keys:
            return None
        key, ord_ = np.concatenate(keys), np.concatenate(ords)
        part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, ord_, part = key[order], ord_[order], part[order]
        used, start = np.unique(part, return_index=True)
        rows = []
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(part)]):
            held, place = np.unique(ord_[i:j], return_inverse=True)
            rows.append((nodes[held].tobytes(), key[i:j].tobytes(), place.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(3)]], ["part", "nodes", "keys", "ords"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, size)
                if len(s):
                    sets[_digest(s)] = s  # copies are one node
                    held += len(s)
                if held >= BATCH_SHINGLES:
                    if (out := packed(sets)) is not None:
                        yield out
                    sets, held = {}, 0
        if (out := packed(sets)) is not None:
            yield out

    return docs.select("text").mapInArrow(run, "part long, nodes binary, keys binary, ords binary")


def starred(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(firsts, hits): positions of the first entry of each key, and (first, other) positions of other nodes with its key.

    Of equal keys the first entry stays first.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    start = order[np.flatnonzero(first)]
    pivot = start[np.cumsum(first) - 1] if len(k) else order
    other = (node[order] != node[pivot]).any(1)
    return start, np.stack([pivot[other], order[other]], 1)


def _stars(packed: DataFrame, chunk: int = 2 * PART_ENTRIES) -> DataFrame:
    """p1, p2, d1, d2, keys: nodes that share keys with the key's pivot, and which.

    A task reads its entries in chunks and keeps one entry for each key, so a key that a third of all sets share is
    streamed past its pivot.
    """

    def grouped(key: np.ndarray, node: np.ndarray, hits: np.ndarray) -> Iterator[pa.RecordBatch]:
        row = np.concatenate([node[hits[:, 0]], node[hits[:, 1]], key[hits[:, 0]].view(np.int64)[:, None]], 1)
        row = row[np.lexsort((row[:, 4], row[:, 2], row[:, 3], row[:, 0], row[:, 1]))]
        if not len(row):
            return
        row = row[np.concatenate([[True], (row[1:] != row[:-1]).any(1)])]
        start = np.flatnonzero(np.concatenate([[True], (row[1:, :4] != row[:-1, :4]).any(1)]))
        ends = np.append(start[1:], len(row))
        for at in range(0, len(start), 10_000):
            s, e = start[at : at + 10_000], ends[at : at + 10_000]
            blobs = [row[i:j, 4].tobytes() for i, j in zip(s.tolist(), e.tolist())]
            yield pa.RecordBatch.from_arrays([*[pa.array(row[s, c]) for c in range(4)], pa.array(blobs, pa.binary())], ["p1", "p2", "d1", "d2", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, nodes, held
            if keys:
                key, node = np.concatenate(keys), np.concatenate(nodes)
                start, hits = starred(key, node)
                yield from grouped(key, node, hits)
                keys, nodes, held = [key[start]], [node[start]], 0

        for batch in small_batches(batches):
            for own, k, ords in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append(np.frombuffer(k, np.uint64))
                nodes.append(np.frombuffer(own, np.int64).reshape(-1, 2)[np.frombuffer(ords, np.uint32)])
                held += len(keys[-1])
                if held >= chunk:
                    yield from flush()
        yield from flush()

    return packed.select("nodes", "keys", "ords").mapInArrow(run, "p1 long, p2 long, d1 long, d2 long, keys binary")


def _keys_of(stars: DataFrame) -> DataFrame:
    """key, pivot, doc_id: a row for each key of (a pivot, doc_id, lists of keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys = [np.frombuffer(b"".join(lists), np.int64) for lists in batch.column(2).to_pylist()]
            n = [len(k) for k in keys]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[pa.array(np.repeat(batch.column(i).to_numpy(), n)) for i in (0, 1)]], ["key", "pivot", "doc_id"])

    return stars.select("pivot", "doc_id", "keys").mapInArrow(run, "key long, pivot long, doc_id long")


def _neighbourhoods(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key, doc_id, whole: keys of the segments that (doc_id, text, band, skipped keys) relies on, and of these less one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for doc_id, text, band, skipped in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingle_set(text, size)
                _, key, token, inner, sums, where = segments([s], np.array([band]), percent)
                relied = ~np.isin(key.view(np.int64), np.array(skipped or [], np.int64))
                several = np.bincount(inner, minlength=len(key)) > 1
                of = relied[inner] & several[inner]
                less = keyed(sums[inner[of]] - token[of], where[inner[of]])
                every = np.concatenate([key[relied], less]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.full(len(every), doc_id, np.int64)), pa.array(np.arange(len(every)) < int(relied.sum()))], ["key", "doc_id", "whole"])

    return docs.select("doc_id", "text", "band", "skipped").mapInArrow(run, "key long, doc_id long, whole boolean")


def _possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose sizes may reach the threshold."""
    of = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, bucket_pairs: int = BUCKET_PAIRS, part_entries: int = PART_ENTRIES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link where 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles (words
    lower-cased A-Z; with fewer words, the whole sequence).  Null texts, and texts without words, have empty sets and
    no links.  Rows that share an id are one document; a row with a null id has a null component.  Equal sets link
    whatever their number.  Other columns are not read; an empty table has no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    every = stage(features(docs, size, percent), "features")
    same = ["k1", "k2", "n"]
    reps = stage(every.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("room").alias("room")), "classes")
    sizes = reps.select(F.col("rep").alias("doc_id"), "n", "room")
    shingles = reps.agg(F.sum("n")).first()[0] or 0
    # about half an entry for a shingle; each part tells a pair anew whose keys it shares with others, so there are no
    # more of them, whatever the session's shuffles are dealt to
    parts = max(1, -(-shingles // (2 * part_entries)))
    packed = _entries(docs.where("doc_id IS NOT NULL"), size, percent, parts).repartition(parts, "part")
    # tasks that saw the same two nodes are brought together; keys of a pair are no more than a set has segments
    pair = ["p1", "p2", "d1", "d2"]
    hits = stage(_stars(packed, 2 * part_entries).groupBy(*pair).agg(F.collect_list("keys").alias("keys")), "hits")
    named = lambda a, b, to: reps.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("rep").alias(to))
    stars = stage(hits.join(named("p1", "p2", "pivot"), ["p1", "p2"]).join(named("d1", "d2", "doc_id"), ["d1", "d2"]).where("pivot <> doc_id").select("pivot", "doc_id", "keys"), "stars")
    # near copies share most of their segments with a pivot: such pairs are held in full first; what they leave apart is
    # found by the buckets below
    own = sizes.select("doc_id", F.coalesce(F.get("room", F.lit(0))["exact"] + 1, F.lit(1)).alias("need"))
    close = stars.groupBy("pivot", "doc_id").agg((F.sum(F.aggregate("keys", F.lit(0), lambda n, b: n + F.octet_length(b))) / 8).alias("common")).join(own, "doc_id").join(own.select(F.col("doc_id").alias("pivot"), F.col("need").alias("other")), "pivot")
    close = close.where(F.col("common") >= F.least("need", "other"))
    tried = stage(_possible(close.select(*_ordered("pivot", "doc_id")).distinct(), sizes, percent), "tried")
    links = stage(_confirmed(tried, docs, size, percent), "links")
    joined = stage(components(links, "first"), "joined")
    drop_stage(hits)

    part_of = lambda x, name: joined.select(F.col("id").alias(x), F.col("component").alias(name))
    both = stars.join(part_of("pivot", "cp"), "pivot", "left").join(part_of("doc_id", "cd"), "doc_id", "left").withColumns({"cp": F.coalesce("cp", "pivot"), "cd": F.coalesce("cd", "doc_id")})
    # buckets of pivots that are not in one component with all that they met
    pivots = both.where("cp <> cd").select("pivot").distinct()
    met = _keys_of(both.join(pivots, "pivot", "left_semi"))
    comp = lambda rows: rows.join(part_of("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    members = stage(comp(met.select("key", "doc_id").union(met.select("key", "pivot")).distinct()), "members")
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
    costs = stage(per.withColumn("cost", (F.col("m") * F.col("m") - F.col("own")) / 2).where("cost > 0").select("key", "cost"), "costs")
    band_of = F.col("key").bitwiseAND(63).cast("int")
    costed = members.join(costs, "key").withColumn("band", band_of)
    # no more than the set has segments
    keys = costed.groupBy("doc_id", "band").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("cost") > bucket_pairs, F.col("key"))).alias("skipped"))
    room = sizes.select("doc_id", F.explode("room").alias("r")).select("doc_id", "r.band", "r.exact", "r.near")
    none = F.array().cast("array<bigint>")
    room = room.join(keys, ["doc_id", "band"], "left").withColumns({"keys": F.coalesce("keys", none), "skipped": F.coalesce("skipped", none)})
    room = stage(room.withColumn("gone", F.size("skipped")), "room")
    short = room.where("gone > exact")
    short = stage(short.select("doc_id", "band", "skipped", (F.col("gone") > F.col("near")).alias("rest")), "short")
    added, blocked = [], None
    if not short.isEmpty():
        texts = docs.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
        # blocks of a band hold all pairs of its short sets, and neighbourhoods find none but these
        unblocked = short.where("NOT rest").join(short.where("rest").select("band").distinct(), "band", "left_anti")
        around = stage(comp(_neighbourhoods(texts.join(unblocked, "doc_id"), size, percent)), "neighbourhoods")
        whole, less = around.where("whole"), around.where("NOT whole")
        n = whole.groupBy("key").agg(F.count(F.lit(1)).alias("w")).join(less.groupBy("key").agg(F.count(F.lit(1)).alias("l")), "key").withColumn("cost", F.col("w") * F.col("l"))
        n = stage(n.select("key", "cost"), "neighbour-costs")
        # the rest: sets skipped nearly everywhere, and those of costly neighbourhoods, in blocks of their band
        costly = around.join(n.where(F.col("cost") > bucket_pairs), "key").select("doc_id", band_of.alias("band"))
        rest = short.where("rest").select("doc_id", "band").union(costly).distinct()
        bands = rest.select("band").distinct()
        rows = comp(short.select("doc_id", "band").join(bands, "band", "left_semi"))
        rows = rows.join(rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")), "band")
        rows = stage(rows.select(F.col("band").cast("long").alias("band"), "doc_id", "component", "members"), "rest")
        if not rows.isEmpty():
            sets = _sets(docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), size)
            added.append(stage(_home_links(_blocked(rows.join(sets, "doc_id"), HOME_BLOCK), percent, forest=True), "rest-links"))
            blocked = rows.select("doc_id", F.col("band").cast("int").alias("band"), F.lit(True).alias("held"))
    # of two sets that agree on more keys than either's slack one agrees on a key that is not among the costliest ones, as
    # many as its slack, of either; a set with more skipped keys meets by all that are left.  Pairs that the blocks hold
    # are not met again
    held = room.select("doc_id", "band", "exact", "gone", F.lit(False).alias("held"))
    if blocked is not None:
        held = held.drop("held").join(blocked, ["doc_id", "band"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("doc_id", "band").orderBy(F.desc("cost"), "key"))
    cheap = costed.where(F.col("cost") <= bucket_pairs).withColumn("place", place).join(held, ["doc_id", "band"])
    cheap = stage(cheap.where("gone > exact OR gone + place > exact").select("key", "doc_id", "component", "held"), "cheap")
    x, y = (cheap.select("key", F.col("doc_id").alias(d), F.col("component").alias(f"c{d}"), F.col("held").alias(f"h{d}")) for d in "ab")
    common = x.join(y, "key").where("a < b AND ca <> cb AND NOT (ha AND hb)").groupBy("a", "b", band_of.alias("band")).agg(F.count(F.lit(1)).alias("common"))
    common = stage(common, "common")
    of = lambda d: room.select(F.col("doc_id").alias(d), "band", F.col("exact").alias(f"n{d}"), F.col("keys").alias(f"k{d}"))
    agreed = F.size(F.array_intersect("ka", "kb"))
    more = common.join(of("a"), ["a", "band"]).join(of("b"), ["b", "band"]).where(agreed > F.greatest("na", "nb")).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    added.append(stage(_confirmed(stage(_possible(more, sizes, percent), "between"), docs, size, percent), "more-links"))
    if not short.isEmpty():
        near = whole.join(n.where(F.col("cost") <= bucket_pairs), "key").select("key", F.col("doc_id").alias("x"), F.col("component").alias("cx")).join(less.select("key", F.col("doc_id").alias("y"), F.col("component").alias("cy")), "key")
        # a pair at the threshold differs by at most one shingle on more relied-on segments than the mean of what both sets
        # have left of their allowance
        near = near.where("cx <> cy").groupBy(*_ordered("x", "y"), band_of.alias("band")).agg(F.count(F.lit(1)).alias("close"))
        near = near.join(common, ["a", "b", "band"], "left").withColumn("close", F.col("close") + F.coalesce("common", F.lit(0)))
        left = lambda d: room.select(F.col("doc_id").alias(d), "band", (F.col("near") - F.col("gone")).alias(f"r{d}"))
        near = near.join(left("a"), ["a", "band"]).join(left("b"), ["b", "band"]).where("2 * close > ra + rb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        added.append(stage(_confirmed(stage(_possible(near, sizes, percent), "near"), docs, size, percent), "near-links"))
    more = added[0]
    for links in added[1:]:
        more = more.union(links)
    if not more.isEmpty():
        joined = stage(components(joined.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more), "second"), "all-joined")
    drop_stage(members, cheap, costs)
    out = every.select("doc_id", *same).join(reps.select(*same, "rep"), same, "left").join(joined, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(s) AS s FROM g),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n_shingles + nb.n_shingles - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n_shingles, component_id FROM n JOIN c USING (doc_id)
"""
