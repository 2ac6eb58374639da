"""Waypoints of a route: class, label, decision to show, with the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.joins import nearest_on_route
from cadenza.operators.windows import Keys

DEDUPE_M, FUEL_PUB_KM = 80.0, 5.0


def classify(name: Column, sym: Column, km: Column) -> Column:
    """struct(cat, disp) or null for places not worth a mark.  Rules hold in order; parts of words count on purpose."""
    label, up, low = F.trim(F.coalesce(name, F.lit(""))), F.upper(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.coalesce(sym, F.lit("")))
    has = lambda *words: _any([up.contains(w) for w in words])
    kind = lambda cat, disp: F.struct(F.lit(cat).alias("cat"), disp.alias("disp"))
    named = lambda cat: kind(cat, F.when(label == "", F.lit(cat)).otherwise(label))
    # fixed values: the words that tell a class
    return (
        F.when(has("TO BE CHECKED") | up.startswith("CHECK ") | label.contains("?"), F.lit(None))
        .when((km < 0.5) & has("TOWN", "START", "HOME"), named("Start"))
        .when(has("PUB") | (low == "restaurant") | has("BAR", "CAFE"), named("Pub"))
        .when(has("WATER", "WATHER") | low.contains("shopping"), kind("Water", F.lit("Water")))
        .when(has("FUEL", "EAT", "FOOD"), kind("Fuel", F.lit("Fuel")))
        .when((low == "summit") | has("CASTLE", "PEAK", "VIEW"), named("POI"))
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def dedupe(items: DataFrame, by: Keys = ("ride",), within_m: float = DEDUPE_M) -> DataFrame:
    """Adds ``dup_of``: within a category, in order of idx, an item near the last kept one goes, unless its label is
    shorter, which drops the kept one instead.  A fold in order over a route's few waypoints of one category.
    """
    w = items.where("cat IS NOT NULL").groupBy(*by, "cat").agg(F.sort_array(F.collect_list(F.struct("idx", "km", "disp"))).alias("_i"))
    none = F.lit(None).cast("struct<idx:int,km:double,disp:string>")
    start = F.struct(none.alias("last"), F.array().cast("array<struct<idx:int,dup_of:int>>").alias("out"))

    def step(s, x):
        last, out = s["last"], s["out"]
        near = last.isNotNull() & (F.abs(x["km"] - last["km"]) * 1000 < within_m)
        shorter = near & (F.length(x["disp"]) < F.length(last["disp"]))
        drop = F.when(shorter, F.array(F.struct(last["idx"].alias("idx"), x["idx"].alias("dup_of")))).when(near, F.array(F.struct(x["idx"].alias("idx"), last["idx"].alias("dup_of")))).otherwise(F.array().cast("array<struct<idx:int,dup_of:int>>"))
        new = F.struct(x["idx"].cast("int").alias("idx"), x["km"].alias("km"), x["disp"].alias("disp"))
        return F.struct(F.when(near & ~shorter, last).otherwise(new).alias("last"), F.concat(out, drop).alias("out"))

    dropped = w.select(*by, F.explode(F.aggregate("_i", start, step)["out"]).alias("r")).select(*by, "r.idx", "r.dup_of")
    return items.join(dropped, [*by, "idx"], "left")


def enumerate_waypoints(places: DataFrame, points: DataFrame, by: Keys = ("ride",), within_m: float = DEDUPE_M, pub_km: float = FUEL_PUB_KM) -> DataFrame:
    """by, idx, km, off_m, cat, disp, decision, reason for every place (idx, lat, lon, name, sym) of a route."""
    at = places.join(nearest_on_route(places, points, by), [*by, "idx"]).withColumn("_k", classify(F.col("name"), F.col("sym"), F.col("km")))
    items = at.select(*by, "idx", "name", "sym", "km", "off_m", F.col("_k.cat").alias("cat"), F.col("_k.disp").alias("disp"))
    items = dedupe(items, by, within_m)
    other = items.select(*by, F.col("idx").alias("dup_of"), F.col("disp").alias("_od"))
    items = items.join(other, [*by, "dup_of"], "left")
    pubs = items.where("cat = 'Pub' AND dup_of IS NULL").select(*by, F.col("idx").alias("_p"), F.col("km").alias("_pk"))
    near = items.where("cat = 'Fuel' AND dup_of IS NULL").join(pubs, list(by)).where(F.abs(F.col("km") - F.col("_pk")) <= pub_km).groupBy(*by, "idx").agg(F.min("_p").alias("pub"))
    items = items.join(near, [*by, "idx"], "left")
    reason = F.when(F.col("cat").isNull(), "unrecognised / route-flag").when(F.col("dup_of").isNotNull(), F.format_string("duplicate of #%d (%s)", "dup_of", "_od")).when(F.col("pub").isNotNull(), F.format_string(f"within {pub_km:.0f} km of Pub #%d", "pub"))
    return items.select(*by, "idx", "name", "km", "off_m", F.coalesce("cat", F.lit("?")).alias("cat"), F.coalesce("disp", "name", F.lit("?")).alias("disp"), F.when(reason.isNull(), "KEEP").otherwise("DROP").alias("decision"), F.coalesce(reason, F.lit("")).alias("reason"))


def override(items: DataFrame, include: Sequence[int] = (), exclude: Sequence[int] = ()) -> DataFrame:
    """Forces places by idx; exclusion wins."""
    i, x = F.col("idx").isin(list(include)) if include else F.lit(False), F.col("idx").isin(list(exclude)) if exclude else F.lit(False)
    note = F.concat(F.col("reason"), F.when(i, " [overridden: --include]").otherwise(""), F.when(x, " [overridden: --exclude]").otherwise(""))
    return items.withColumns({"decision": F.when(x, "DROP").when(i, "KEEP").otherwise(F.col("decision")), "reason": F.trim(note)})


def kept(items: DataFrame) -> DataFrame:
    return items.where("decision = 'KEEP'").select(*[c for c in items.columns if c not in ("decision", "reason")])


def index_list(text: Column) -> Column:
    """'1, 4,7' -> [1, 4, 7]."""
    return F.transform(F.filter(F.split(text, ","), lambda s: F.trim(s) != ""), lambda s: F.trim(s).cast("int"))


def stagger(labels: DataFrame, by: Keys = ("ride",), gap_km: float = 4.5) -> DataFrame:
    """Adds ``level``: in order of km, a label closer than ``gap_km`` to the one before stands a level above it."""
    w = Window.partitionBy(*by).orderBy("km", "idx")
    before = F.lag("km").over(w)
    far = labels.withColumn("_far", F.coalesce(F.col("km") - before >= gap_km, F.lit(True)).cast("int"))
    far = far.withColumn("_g", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return far.withColumn("level", F.row_number().over(Window.partitionBy(*by, "_g").orderBy("km", "idx")) - 1).drop("_far", "_g")
