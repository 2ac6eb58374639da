"""Moving windows over rides: by rows, by distance, and onto regular grids.

Every operator works on all rides at once: it partitions by ``by`` and orders by ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def ordered(by: Keys, seq: str = "seq"):
    return Window.partitionBy(*by).orderBy(seq)


def rolling_peak(df: DataFrame, value: str, windows: Sequence[int], by: Keys = ("ride",), seq: str = "seq", missing: str = "none") -> DataFrame:
    """by, window, peak: the best mean over full windows of so many samples; nulls count as 0.

    Running sums make every window a difference of two rows, so one sort serves all windows.  A window longer
    than the ride gives null (``missing="none"``) or no row (``"omit"``); windows of 0 or less give no row.
    """
    w = ordered(by, seq)
    windows = [x for x in windows if x > 0]
    d = df.select(*by, seq, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_v"))
    d = d.withColumns({"_s": F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    d = d.withColumns({f"_m{x}": F.when(F.col("_n") >= x, (F.col("_s") - F.coalesce(F.lag("_s", x).over(w), F.lit(0.0))) / F.lit(float(x))) for x in windows})
    best = d.groupBy(*by).agg(*[F.max(f"_m{x}").alias(f"_m{x}") for x in windows])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("window"), F.col(f"_m{x}").alias("peak")) for x in windows]))
    out = best.select(*by, rows.alias("_r")).select(*by, "_r.window", "_r.peak")
    return out.where("peak IS NOT NULL") if missing == "omit" else out


def median_filter(df: DataFrame, value: str, size: int, out: str, by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """Centred median, frames cut at the ends; rides shorter than ``size`` stay as they are."""
    w, h = ordered(by, seq), size // 2
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    v = F.col(value).cast("double")
    if size < 2:
        return df.withColumn(out, v)
    if size <= 9:  # few neighbours: offsets and a sort of a small array, without an aggregate for every frame
        near = df.withColumns({f"_m{k}": F.lag(v, k).over(w) if k > 0 else F.lead(v, -k).over(w) for k in range(-h, h + 1) if k} | {"_m0": v, "_n": n})
        near = near.withColumn("_a", F.sort_array(F.array_compact(F.array(*[F.col(f"_m{k}") for k in range(-h, h + 1)]))))
        at = lambda k: F.get("_a", k.cast("int"))
        middle = (at(F.floor((F.size("_a") - 1) / 2)) + at(F.floor(F.size("_a") / 2))) / 2
        return near.withColumn(out, F.when(F.col("_n") < size, v).otherwise(middle)).drop("_a", "_n", *[f"_m{k}" for k in range(-h, h + 1)])
    return df.withColumn(out, F.when(n < size, v).otherwise(F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-h, h))))


def smooth(df: DataFrame, value: str, size: int, out: str, by: Keys = ("ride",), seq: str = "seq", mode: str = "zero", shrink: bool = False) -> DataFrame:
    """Moving mean of ``size`` samples.

    ``zero``: ends are padded with zeros, so they sink; ``truncated``: the mean of what is there; ``edge``: ends
    are padded with the first and last value.  Rides shorter than ``size`` stay as they are in mode zero, unless
    ``shrink``, which takes the ride's length as the size.
    """
    w, v = ordered(by, seq), F.col(value).cast("double")
    part = Window.partitionBy(*by)
    lo, hi = -(size // 2), size - 1 - size // 2
    if mode == "truncated":
        return df.withColumn(out, F.avg(v).over(w.rowsBetween(-(size // 2), size // 2)))
    frame = w.rowsBetween(lo, hi)
    total = F.sum(v).over(frame)
    if mode == "edge":
        n, i = F.count(F.lit(1)).over(part), F.row_number().over(w)
        left, right = F.greatest(F.lit(0), F.lit(-lo + 1) - i), F.greatest(F.lit(0), i + F.lit(hi) - n)
        full = w.rowsBetween(*WHOLE)
        return df.withColumn(out, (total + left * F.first(v).over(full) + right * F.last(v).over(full)) / F.lit(float(size)))
    n = F.count(F.lit(1)).over(part)
    short = F.sum(v).over(part) / n if shrink else v
    return df.withColumn(out, F.when(n < size, short).otherwise(total / F.lit(float(size))))


def interpolate_gaps(df: DataFrame, value: str, out: str, by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """Nulls and NaN on the line between their neighbours by row; ends hold the nearest value, nothing at all is 0."""
    w, v = ordered(by, seq), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    i = F.row_number().over(w)
    d = df.withColumns({"_i": i, "_v": v})
    point = F.when(F.col("_v").isNotNull(), F.struct("_i", "_v"))
    up_to = (Window.unboundedPreceding, 0)
    # what follows is read in descending order: a frame that reaches to the partition's end costs its square
    before, after = F.last(point, ignorenulls=True).over(w.rowsBetween(*up_to)), F.last(point, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(seq)).rowsBetween(*up_to))
    d = d.withColumns({"_a": before, "_b": after})
    share = (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    line = F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * share
    return d.withColumn(out, F.coalesce("_v", line, "_a._v", "_b._v", F.lit(0.0))).drop("_i", "_v", "_a", "_b")


def onto_grid(df: DataFrame, x: str, values: Sequence[str], step: float, by: Keys = ("ride",), start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """by, k, x, values: linear interpolation at start + k * step below stop (by default the first and last x).

    Samples with equal x count as their last one.  Before the first and after the last sample values are held.
    """
    ends = df.groupBy(*by).agg((F.min(x) if start is None else start).cast("double").alias("_lo"), (F.max(x) if stop is None else stop).cast("double").alias("_hi"))
    grid = ends.where("_hi > _lo").select(*by, F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(float(step))).cast("int") - 1), lambda k: F.col("_lo") + k * F.lit(float(step)))).alias("k", "_x"))
    grid = grid.withColumns({v: F.lit(None).cast("double") for v in values})
    seqs = F.lit(None).cast("int").alias("k")
    samples = df.select(*by, seqs, F.col(x).cast("double").alias("_x"), *[F.col(v).cast("double").alias(v) for v in values])
    w = Window.partitionBy(*by).orderBy("_x", F.col("k").asc_nulls_first())
    back = Window.partitionBy(*by).orderBy(F.desc("_x"), F.col("k").desc_nulls_last())
    every = samples.unionByName(grid.select(*by, "k", "_x", *values))
    point = F.when(F.col("k").isNull(), F.struct("_x", *values))
    every = every.withColumns({"_a": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    share = (F.col("_x") - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    at = {v: F.when(F.col("_a").isNull(), F.col(f"_b.{v}")).when(F.col("_b").isNull(), F.col(f"_a.{v}")).otherwise(F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * share) for v in values}
    return every.where("k IS NOT NULL").select(*by, "k", F.col("_x").alias("x"), *[c.alias(v) for v, c in at.items()])


def values_at(df: DataFrame, places: DataFrame, x: str, values: Sequence[str], by: Keys = ("ride",)) -> DataFrame:
    """``places`` (by, ``x``, ...) with the values of ``df`` there: on the line between the samples around, held beyond the ends.

    One sorted pass for all places.  Samples with equal x count as their last one by value; without samples, null.
    """
    rows = places.withColumns({"_x": F.col(x).cast("double"), "_p": F.lit(True)}).unionByName(df.select(*by, F.col(x).cast("double").alias("_x"), F.lit(False).alias("_p"), *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]), allowMissingColumns=True)
    own = [f"_v{i}" for i in range(len(values))]
    point = F.when(~F.col("_p"), F.struct("_x", *own))
    up = Window.partitionBy(*by).orderBy("_x", "_p", *own).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc("_x"), F.col("_p"), *[F.desc(v) for v in own]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_a": F.last(point, ignorenulls=True).over(up), "_b": F.last(point, ignorenulls=True).over(down)}).where("_p")
    share = (F.col("_x") - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    at = lambda v: F.when(F.col("_a").isNull(), F.col(f"_b.{v}")).when(F.col("_b").isNull() | (F.col("_b._x") == F.col("_a._x")), F.col(f"_a.{v}")).otherwise(F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * share)
    return rows.select(*places.columns, *[at(f"_v{i}").alias(v) for i, v in enumerate(values)])


def span_grade(df: DataFrame, d: str, e: str, window_m: float, out: str, by: Keys = ("ride",), least_m: float = 5.0) -> DataFrame:
    """Percent between the nearest samples that lie ``window_m`` or more behind and ahead; 0 below ``least_m``.

    The forward side runs on the negated distance: frames that end at the partition's start are linear, frames
    that reach to its end are not.  Samples without one far enough take the ride's first or last.
    """
    part = ", ".join(by)
    m = f"{window_m}D"
    back = F.expr(f"max_by(struct({d} AS d, {e} AS e), seq) OVER (PARTITION BY {part} ORDER BY {d} RANGE BETWEEN UNBOUNDED PRECEDING AND {m} PRECEDING)")
    ahead = F.expr(f"min_by(struct({d} AS d, {e} AS e), seq) OVER (PARTITION BY {part} ORDER BY -{d} RANGE BETWEEN UNBOUNDED PRECEDING AND {m} PRECEDING)")
    first = F.expr(f"first(struct({d} AS d, {e} AS e)) OVER (PARTITION BY {part} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    last = F.expr(f"last(struct({d} AS d, {e} AS e)) OVER (PARTITION BY {part} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    g = df.withColumns({"_a": F.coalesce(back, first), "_b": F.coalesce(ahead, last)})
    run = F.col("_b.d") - F.col("_a.d")
    return g.withColumn(out, F.when(run < least_m, 0.0).otherwise(100.0 * (F.col("_b.e") - F.col("_a.e")) / run)).drop("_a", "_b")


def mean_max_grade(df: DataFrame, d: str, e: str, windows_m: Sequence[float], by: Keys = ("ride",)) -> DataFrame:
    """by, window_m, grade: the steepest mean over a stretch of at least so many metres; null if the ride is shorter."""
    part = ", ".join(by)
    cols = {}
    for i, m in enumerate(windows_m):
        cols[f"_p{i}"] = F.expr(f"min_by(struct({d} AS d, {e} AS e), seq) OVER (PARTITION BY {part} ORDER BY -{d} RANGE BETWEEN UNBOUNDED PRECEDING AND {float(m)}D PRECEDING)")
    g = df.withColumns(cols)
    best = g.groupBy(*by).agg(*[F.max(F.when(F.col(f"_p{i}.d") > F.col(d), 100.0 * (F.col(f"_p{i}.e") - F.col(e)) / (F.col(f"_p{i}.d") - F.col(d)))).alias(f"_p{i}") for i in range(len(windows_m))])
    rows = F.explode(F.array(*[F.struct(F.lit(float(m)).alias("window_m"), F.col(f"_p{i}").alias("grade")) for i, m in enumerate(windows_m)]))
    return best.select(*by, rows.alias("_r")).select(*by, "_r.window_m", "_r.grade")


def row_grade(df: DataFrame, d: str, e: str, half: int, out: str, by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """Percent between the samples ``half`` rows behind and ahead, held at the ends; 0 without distance."""
    f = ordered(by, seq).rowsBetween(-half, half)
    run = F.last(d).over(f) - F.first(d).over(f)
    return df.withColumn(out, F.when(run > 0, (F.last(e).over(f) - F.first(e).over(f)) / run * 100).otherwise(F.lit(0.0)))


def track_distance(df: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "cum_m", by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """Running sum of the distances between consecutive points."""
    from cadenza.functions.geo import haversine_m

    w = ordered(by, seq)
    step = F.coalesce(haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon)), F.lit(0.0))
    return df.withColumn("_step", step).withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def drop_repeats(df: DataFrame, columns: Sequence[str], by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """Rows that differ from the row before them in any of the columns."""
    w = ordered(by, seq)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_same", same & (F.row_number().over(w) > 1)).where("NOT _same").drop("_same")


def subsample(df: DataFrame, most: int, by: Keys = ("ride",), seq: str = "seq") -> DataFrame:
    """At most ``most`` evenly spaced rows of each ride, first and last among them."""
    w = ordered(by, seq)
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(float(max(1, most - 1))), 0).cast("int"))
    return d.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")
