"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose documents are served in a shuffled order (by the MD5 of the id).  A
document's virtual start and finish times are the words its source has served before and after it,
divided by the source's target.  All copies are sorted by finish time over the whole cluster, and the queue is
truncated where its running total of words reaches the total budget, the sum of the targets.  A copy that
its source's target ends in lies in the queue as two entries, the words that the target still covers and the
rest, so the truncation gives every source its target to the word.

Running sums never put a source in one task: a source is dealt into equal slices of its
hash range (SLICE documents each on average), slices are summed, sums of BLOCK slices again, and those are
offsets.  The queue's running total is summed in each range of the sort; the ranges' sums are offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents in one slice of a source, on average.
SLICE = 1024
#: Slices whose sums are summed in one group.
BLOCK = 1024
QUEUE = ("source", "row", "copy", "part", "doc_id", "size", "source_size", "target", "start", "finish", "words", "budget", "key")


def word_count(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009..U+000D."""
    t = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    # a word starts at every non-space that follows a space or the beginning
    return F.regexp_count(t, F.lit("[^ ]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """source, n, source_size, target from (source, n, source_size): one row a source.

    Weights are dealt by the order of the sources' code points, null last.  Targets share the budget (by
    default the sum of sizes) by weight but stop at ``max_repeats`` times their source; the excess is shared
    again by weight.  That ends where every uncapped target is one level times its weight: sources are capped
    in the order of size / weight, so one running sum over the sources finds the level.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.lit(budget).cast("long") if budget is not None else F.sum("source_size").over(every)
    t = t.withColumns({
        "rest": (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double"),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("own_level", F.col("rest") / F.col("left"))
    # the level of the first source (in this order) that stays under its cap holds for all after it
    fits = F.col("own_level") * F.col("weight") <= F.col("cap")
    t = t.withColumn("level", F.first(F.when(fits, F.col("own_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return t.select("source", "n", "source_size", target.alias("target"))


def _running(df: DataFrame) -> DataFrame:
    """``df`` (sorted in ranges) with the number of its range and the words up to and including each row in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, here = 0, TaskContext.get().partitionId()
        for batch in batches:
            reach = total + np.cumsum(batch.column(batch.schema.get_field_index("words")).to_numpy())
            total = int(reach[-1]) if len(reach) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(reach), here), pa.int64()), pa.array(reach, pa.int64())], [*batch.schema.names, "range", "reach"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", `range` long, reach long")


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, budget: int | None = None, key_col: str | None = None) -> DataFrame:
    """Every copy with its virtual times, and the budget; the copy that a target ends in is two entries (part 0 and 1).  ``key_col`` is carried along as ``key``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("key"))
    sizes = targets(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, max_repeats, budget)
    sizes = sizes.withColumn("budget", F.sum(F.floor("target")).over(Window.partitionBy()))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    none = F.md5(F.lit("").cast("binary"))
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    keyed = rows.withColumn("digest", digest).join(sizes, rows.source.eqNullSafe(sizes.source)).drop(sizes.source)
    keyed = keyed.withColumn("slice", F.floor(place * F.ceil(F.col("n") / F.lit(SLICE))))
    # rows without id share one digest: they are dealt by size, between the digests below and above
    keyed = keyed.withColumn("sub", F.when(F.col("digest") < none, -1).when(F.col("digest") > none, F.lit(1 << 60)).otherwise(F.col("size")))
    in_slice = Window.partitionBy("source", "slice", "sub").orderBy("digest", "doc_id", "size")
    sums = keyed.groupBy("source", "slice", "sub").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).withColumn("block", F.floor(F.col("slice") / F.lit(BLOCK)))
    in_block = Window.partitionBy("source", "block").orderBy("slice", "sub").rowsBetween(Window.unboundedPreceding, -1)
    of_blocks = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = sums.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.sum("words").alias("words"), F.sum("docs").alias("docs"))
    blocks = blocks.select("s", "b", before("words", of_blocks).alias("block_words"), before("docs", of_blocks).alias("block_docs"))
    offsets = sums.withColumns({"own_words": before("words", in_block), "own_docs": before("docs", in_block)}).join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    offsets = offsets.select(F.col("source").alias("s"), F.col("slice").alias("c"), F.col("sub").alias("u"), (F.col("block_words") + F.col("own_words")).alias("words_before"), (F.col("block_docs") + F.col("own_docs")).alias("docs_before"))
    served = keyed.withColumns({"own": F.sum("size").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(in_slice)})
    served = served.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")) & (F.col("sub") == F.col("u")))
    served = served.withColumns({"end": F.col("words_before") + F.col("own"), "row": F.col("docs_before") + F.col("nth")})
    copies = served.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") - 1))))
    whole = F.floor(F.col("target")).cast("long")
    copies = copies.withColumn("stop", F.col("copy") * F.col("source_size") + F.col("end")).withColumn("begin", F.col("stop") - F.col("size"))
    cut = (F.col("begin") < whole) & (whole < F.col("stop"))
    parts = copies.withColumn("to", F.when(cut, F.array(whole, F.col("stop"))).otherwise(F.array("stop"))).select("*", F.posexplode("to").alias("part", "until"))
    since = F.when(F.col("part") == 1, whole).otherwise(F.col("begin"))
    time = lambda words: F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(1.0))
    return parts.withColumns({"start": time(since), "finish": time(F.col("until")), "words": F.col("until") - since}).select(*QUEUE)


def mix(docs: DataFrame, sort: bool = True, **options) -> DataFrame:
    """The mix: a row for each entry of the queue that it takes, in the queue's order unless ``sort`` is off.

    Options are those of ``queue``.  Columns: doc_id, source, size, source_size, target, row (the document's place in its
    source, 1 first), copy (0 first), part (1: the rest of a copy that its source's target ends in), start, finish (virtual
    times), taken (words that the mix takes), position (words of the queue up to the entry's end), key.  Every document has a copy 0 even if nothing of it is taken.  Null text: size 0.
    A null source is a source, the last one.  Rows with equal ids are served one after the other; null ids are served
    like any id.  No rows: an empty mix.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["finish", "source", "row", "copy", "part"]
    ranged = stage(_running(queue(docs, **options).repartitionByRange(n, *order).sortWithinPartitions(*order)), "queue")
    # a row for each range of the sort, of which there are as many as shuffle partitions
    ranges = ranged.groupBy("range").agg(F.sum("words").alias("range_words"))
    ranges = ranges.select("range", F.coalesce(F.sum("range_words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - (F.col("before") + F.col("reach") - F.col("words"))))
    cut = ranged.join(F.broadcast(ranges), "range").withColumn("position", F.col("before") + F.col("reach")).withColumn("taken", taken).where((F.col("taken") > 0) | ((F.col("copy") == 0) & (F.col("part") == 0)))
    cut = cut.select("doc_id", "source", "size", "source_size", "target", "row", "copy", "part", "start", "finish", "taken", "position", "key")
    return cut.repartitionByRange(n, *order).sortWithinPartitions(*order) if sort else cut


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (its copies' words together)."""
    return mix(docs, sort=False, **options).groupBy("source", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


_CASE = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(WEIGHTS))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * {MAX_REPEATS} AS cap, (CASE nth % {len(WEIGHTS)} {_CASE} END)::DOUBLE AS weight FROM s),
o AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER q, 0))::DOUBLE AS rest,
      (sum(weight) OVER ()) - coalesce(sum(weight) OVER q, 0) AS lft, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
      FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest / lft, nth) FILTER (rest / lft * weight <= cap) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM o, l),
c AS (SELECT doc_id, d.source, size, source_size, target,
      (sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ({" + ".join(f"greatest(0, least(size, floor(target)::BIGINT - ({k} * source_size + start)))" for k in range(MAX_REPEATS))})::BIGINT AS taken FROM c
"""
