"""Services outside of the engine, as callables: elevations for points that no tile covers, and tracks snapped to roads.

``elevations`` and ``matched_tracks`` ask once and keep nothing; ``metered_elevations`` and ``remembered_tracks`` count their
requests and remember what they were told.  Answers are tables in a folder that the driver and all executors share: what a table
holds is never asked again, in this run or a later one.  Elevations are keyed by the place, rounded to a
hundred-thousandth of a degree; tracks by a digest of their points, whatever ride they belong to.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import track_key
from cadenza.operators.windows import Keys, subsample

Elevations = Callable[[list[tuple[float, float]]], list[float]]
Match = Callable[[list[tuple[float, float]]], list[tuple[float, float]]]
#: Points in one request for elevations, seconds between requests, requests a day; points in one request for a track.
POINTS_A_REQUEST, SECONDS_BETWEEN, REQUESTS_A_DAY, TRACK_POINTS = 512, 1.0, 100, 10
PLACES_A_DEGREE = 100_000


def elevations(points: DataFrame, service: Elevations, by: Keys = ("ride",), batch: int = POINTS_A_REQUEST, pause_s: float = SECONDS_BETWEEN) -> DataFrame:
    """by, seq, z of the points (by, seq, lat, lon) by a service, asked by one task alone, as it counts requests.

    Only what no tile covers should be asked.  An answer of another length than the question is refused: it would put
    elevations at the wrong points.
    """
    names = [*by, "seq", "z"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*by, "seq").schema.fields) + ", z double"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = float("-inf")
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                time.sleep(max(0.0, pause_s - (time.monotonic() - last)))
                got = service(list(zip(part["lat"].tolist(), part["lon"].tolist())))
                last = time.monotonic()
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} elevations for {len(part)} points")
                yield part.assign(z=[float(x) for x in got])[names]

    return points.select(*by, "seq", "lat", "lon").repartition(1).mapInPandas(ask, schema)


def filled_elevations(samples: DataFrame, service: Elevations | None, by: Keys = ("ride",), **options) -> DataFrame:
    """``samples`` (by, seq, lat, lon, z) with the service's z where there is none; without a service as they are."""
    if service is None:
        return samples
    asked = elevations(samples.where("z IS NULL"), service, by, **options).withColumnRenamed("z", "_z")
    return samples.join(asked, [*by, "seq"], "left").withColumn("z", F.coalesce("z", "_z")).drop("_z")


def thinned(track: list[tuple[float, float]], most: int = TRACK_POINTS) -> list[tuple[float, float]]:
    """At most ``most`` points, evenly by place, the first and last among them."""
    if len(track) <= most:
        return track
    return [track[round(k * (len(track) - 1) / (most - 1))] for k in range(most)]


def matched_tracks(points: DataFrame, match: Match | None, key: str = "climb", cache: DataFrame | None = None) -> DataFrame:
    """key, seq, lat, lon of each track snapped to roads by a service that takes TRACK_POINTS points; a free upgrade, never a loss.

    A track of one point, a service that fails or answers nothing, or none at all: the track as it is.  Points that repeat
    the one before them go.  Tracks that ``cache`` (key, seq, lat, lon) holds are taken from there and not asked for again.
    """
    own = points.select(key, "seq", "lat", "lon")
    if match is None:
        return own
    known = cache.select(key).distinct() if cache is not None else None
    open_ = own.join(known, key, "left_anti") if known is not None else own

    def snap(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("seq")
        had = list(zip(track["lat"].tolist(), track["lon"].tolist()))
        try:
            got = [tuple(map(float, p)) for p in match(thinned(had))] if len(had) > 1 else had
        except Exception:  # noqa: BLE001 - whatever a service does, the track stays usable
            got = had
        got = [p for k, p in enumerate(got) if not k or p != got[k - 1]] if got and got is not had else had
        return pd.DataFrame({key: [track[key].iloc[0]] * len(got), "seq": range(len(got)), "lat": [p[0] for p in got], "lon": [p[1] for p in got]})

    schema = f"`{key}` {own.schema[key].dataType.simpleString()}, seq long, lat double, lon double"
    snapped = open_.groupBy(key).applyInPandas(snap, schema)
    return snapped.unionByName(cache.select(key, F.col("seq").cast("long").alias("seq"), "lat", "lon").join(own.select(key).distinct(), key, "left_semi")) if cache is not None else snapped


@dataclass(frozen=True)
class Answers:
    """A table of a service's answers, kept as Parquet in a shared folder and only ever added to."""

    path: str
    schema: str

    def read(self, spark: SparkSession) -> DataFrame:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.schema(self.schema).parquet(self.path) if there else spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def elevation_answers(path: str) -> Answers:
    """y, x (place), z (null: the service knows none), day and number of the request."""
    return Answers(path, "y long, x long, z double, day date, request long")


def track_answers(path: str) -> Answers:
    """track (digest of the points asked for), seq, lat, lon."""
    return Answers(path, "track string, seq long, lat double, lon double")


def _place(degrees: str) -> Column:
    return F.round(F.col(degrees) * PLACES_A_DEGREE).cast("long")


def _asked(places: DataFrame, service: Elevations, batch: int, pause_s: float, day: str, used: int) -> DataFrame:
    """The service's answers for (y, x), asked by one task, as the service counts requests.

    A request that fails, or that is answered with another number of elevations, ends the asking: what was answered
    before it stays, and no elevation is put at a wrong place.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = float("-inf"), used
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                time.sleep(max(0.0, pause_s - (time.monotonic() - last)))
                try:
                    got = service([(y / PLACES_A_DEGREE, x / PLACES_A_DEGREE) for y, x in zip(part["y"].tolist(), part["x"].tolist())])
                except Exception:  # noqa: BLE001 - whatever a service does, routes keep their own elevations
                    return
                last, n = time.monotonic(), n + 1
                if len(got) != len(part):
                    return
                yield part.assign(z=[None if v is None else float(v) for v in got], day=pd.Timestamp(day).date(), request=n)

    return places.repartition(1).sortWithinPartitions("y", "x").mapInPandas(ask, "y long, x long, z double, day date, request long")


def metered_elevations(samples: DataFrame, service: Elevations | None, answers: Answers, day: str, by: Keys = ("ride",), batch: int = POINTS_A_REQUEST, requests: int = REQUESTS_A_DAY, pause_s: float = SECONDS_BETWEEN) -> DataFrame:
    """``samples`` (by, seq, lat, lon, z) with ``asked``: null z are taken from ``answers``, after asking for places not there.

    Asked are the southernmost places first, no more than ``day``'s requests allow; the rest stays null until another
    day.  Places are asked once however many rides share them, and answers are written before they are read, so a
    lost executor costs no second request for what was written.  Without a service only what is remembered is used.
    """
    spark = samples.sparkSession
    placed = samples.withColumns({"_y": _place("lat"), "_x": _place("lon")})
    if service is not None:
        known = answers.read(spark)
        used = known.where(F.col("day") == F.lit(day).cast("date")).agg(F.coalesce(F.max("request"), F.lit(0))).first()[0]
        open_ = placed.where("z IS NULL AND lat IS NOT NULL AND lon IS NOT NULL").select(F.col("_y").alias("y"), F.col("_x").alias("x")).distinct().join(known.select("y", "x"), ["y", "x"], "left_anti")
        left = max(0, requests - used)
        if left:
            answers.add(_asked(open_.orderBy("y", "x").limit(left * batch), service, batch, pause_s, day, used))
    known = answers.read(spark).groupBy(F.col("y").alias("_y"), F.col("x").alias("_x")).agg(F.min("z").alias("_z"))
    return placed.join(known, ["_y", "_x"], "left").withColumns({"asked": F.col("z").isNull() & F.col("_z").isNotNull(), "z": F.coalesce("z", "_z")}).drop("_y", "_x", "_z")


def _keyed_tracks(points: DataFrame, by: Keys) -> DataFrame:
    """by, track: the digest of the points of each track."""
    p = F.sort_array(F.collect_list(F.struct("seq", "lat", "lon")))
    return points.groupBy(*by).agg(track_key(p).alias("track"), F.count(F.lit(1)).alias("n"))


def remembered_tracks(points: DataFrame, match: Match | None, answers: Answers, by: Keys = ("ride",), pause_s: float = 0.0) -> DataFrame:
    """by, seq, lat, lon of each track snapped to roads by a service that takes TRACK_POINTS points; a free upgrade, never a loss.

    A track of one point, a service that fails or answers nothing, or none at all: the track as it is.  Points that repeat
    the one before them go.  Equal tracks are asked once, and tracks that ``answers`` holds are not asked again; failures
    are not remembered.  One task asks, thinned tracks one by one.
    """
    spark = points.sparkSession
    own = points.select(*by, F.col("seq").cast("long").alias("seq"), "lat", "lon")
    keyed = _keyed_tracks(own, by)
    if match is not None:
        known = answers.read(spark).select("track").distinct()
        first = keyed.where("n > 1").groupBy("track").agg(F.min(F.struct(*by)).alias("_k")).join(known, "track", "left_anti").select("track", "_k.*")
        few = subsample(own.join(first, list(by)), TRACK_POINTS, ["track"])

        def snap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            track: list[tuple] = []

            def flush() -> Iterator[pd.DataFrame]:
                try:
                    got = [tuple(map(float, p)) for p in match([r[2:] for r in track])]
                except Exception:  # noqa: BLE001 - the track stays usable as it is
                    got = []
                time.sleep(pause_s)
                got = [p for k, p in enumerate(got) if not k or p != got[k - 1]]
                if got:
                    yield pd.DataFrame({"track": track[0][0], "seq": range(len(got)), "lat": [p[0] for p in got], "lon": [p[1] for p in got]})

            for frame in frames:
                for row in frame.itertuples(index=False):
                    if track and row[0] != track[0][0]:
                        yield from flush()
                        track = []
                    track.append(tuple(row))
            if track:
                yield from flush()

        asked = few.select("track", "seq", "lat", "lon").repartition(1).sortWithinPartitions("track", "seq")
        answers.add(asked.mapInPandas(snap, answers.schema))
    known = answers.read(spark).dropDuplicates(["track", "seq"])
    snapped = keyed.select(*by, "track").join(known, "track").select(*by, "seq", "lat", "lon")
    rest = own.join(snapped.select(*by).distinct(), list(by), "left_anti")
    return snapped.unionByName(rest)


@dataclass(frozen=True)
class Services:
    """What verification may ask: a track matcher and an elevation service, each with its table of answers; both may be absent."""

    match: Match | None = None
    tracks: Answers | None = None
    service: Elevations | None = None
    elevations: Answers | None = None
    day: str = "1970-01-01"
    requests: int = REQUESTS_A_DAY
    pause_s: float = SECONDS_BETWEEN

    def snapped(self, points: DataFrame, by: Keys) -> DataFrame:
        return remembered_tracks(points, self.match, self.tracks, by) if self.tracks else points.select(*by, "seq", "lat", "lon")

    def filled(self, samples: DataFrame, by: Keys) -> DataFrame:
        """``samples`` with ``asked``, whether an elevation came from the service."""
        if not self.elevations:
            return samples.withColumn("asked", F.lit(False))
        return metered_elevations(samples, self.service, self.elevations, self.day, by, requests=self.requests, pause_s=self.pause_s)

