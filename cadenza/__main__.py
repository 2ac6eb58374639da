"""python -m cadenza ride|climbs|gpx|pair|route|validate|waypoints|compare|load|tyres|profile|physics ...: reports on the terminal as markdown or JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    from cadenza.functions.text import route_slug
    from cadenza.plans import reports
    from cadenza.sinks.reports import as_json
    from cadenza.sinks.shapes import waypoint_lines
    from cadenza.sources import profiles
    from cadenza.sources.archives import write_documents

    parser = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    parser.add_argument("--json", action="store_true")
    sub = parser.add_subparsers(dest="what", required=True)
    ride = sub.add_parser("ride")
    ride.add_argument("files")
    route = sub.add_parser("route")
    route.add_argument("files")
    route.add_argument("--dem")
    route.add_argument("--save", help="a shared folder for the routes' Fidelity Reports")
    physics = sub.add_parser("physics")
    profile = sub.add_parser("profile")
    for p in (route, physics, profile):
        p.add_argument("--profile", default=".", help="folders to look for a profile in, comma-separated")
    for p in (route, physics):
        p.add_argument("--bike")
        p.add_argument("--surface")
    climbs = sub.add_parser("climbs")
    climbs.add_argument("files")
    gpx = sub.add_parser("gpx")
    gpx.add_argument("files")
    gpx.add_argument("out")
    validate = sub.add_parser("validate")
    for name in ("fit", "gpx", "dem"):
        validate.add_argument(name)
    listing = sub.add_parser("waypoints")
    listing.add_argument("files")
    for p in (route, listing):
        p.add_argument("--include", default="", help="waypoints to keep, e.g. 1,4,7")
        p.add_argument("--exclude", default="", help="waypoints to drop")
    pair = sub.add_parser("pair")
    pair.add_argument("a")
    pair.add_argument("b")
    compare = sub.add_parser("compare")
    compare.add_argument("a")
    compare.add_argument("b")
    load = sub.add_parser("load")
    load.add_argument("--ctl", type=float, required=True)
    load.add_argument("--atl", type=float, required=True)
    load.add_argument("--plan", required=True, help="daily stress, comma-separated")
    tyres = sub.add_parser("tyres")
    tyres.add_argument("--kg", type=float, default=87.0)
    tyres.add_argument("--front", type=float, default=48.0)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    numbers = lambda text: tuple(int(x) for x in text.split(",") if x.strip())
    if a.what == "waypoints":
        found = reports.route_frames(spark, a.files, include=numbers(a.include), exclude=numbers(a.exclude))["waypoints"]
        for r in waypoint_lines(found).orderBy("idx").toLocalIterator():
            print(r.line)
        return
    if a.what in ("profile", "physics", "route"):
        own, origin = profiles.load_profile(spark, a.profile.split(","))
    if a.what == "climbs":
        for r in reports.climb_reports(spark, a.files).toLocalIterator():
            print(f"# {r.ride}\n\n{r.report}")
        return
    if a.what == "gpx":
        named = reports.ride_tracks(spark, a.files).withColumn("name", F.concat(route_slug(F.col("ride").cast("string")), F.lit(".gpx")))
        for r in write_documents(named, a.out, "name", "gpx").toLocalIterator():
            print(r.name)
        return
    body = profiles.body_of(own, a.bike, a.surface) if a.what in ("physics", "route") else None
    frames = {
        "profile": lambda: {"profile": spark.createDataFrame([(k, str(own[k.split(".")[0]].get(k.split(".")[1]) if "." in k else own[k]), v) for k, v in sorted(origin.items())], "key string, value string, origin string")},
        "physics": lambda: {"physics": spark.createDataFrame([tuple(body.values())], ", ".join(f"{k} double" for k in body))},
        "validate": lambda: {"validated": reports.validated(spark, a.fit, a.gpx, a.dem)},
        "ride": lambda: reports.ride_frames(spark, a.files),
        "route": lambda: reports.route_frames(spark, a.files, a.dem, include=numbers(a.include), exclude=numbers(a.exclude), body=body),
        "pair": lambda: reports.pair_frames(spark, a.a, a.b),
        "compare": lambda: reports.compare_frames(spark, a.a, a.b),
        "load": lambda: {"load": reports.load_frame(spark, a.ctl, a.atl, [float(x) for x in a.plan.split(",")])},
        "tyres": lambda: {"tyres": reports.tyre_frame(spark, a.kg, a.front)},
    }[a.what]()
    report = frames.pop("report", None)
    if report is not None and a.save:
        named = report.withColumn("name", F.concat(route_slug(F.col("ride")), F.lit("-fidelity.md")))
        for r in write_documents(named, a.save, "name", "report").toLocalIterator():
            print(r.name)
    if a.json:
        for df in frames.values():
            for r in as_json(df).toLocalIterator():
                print(r.value)
    else:
        print(reports.as_markdown(frames))


if __name__ == "__main__":
    main()
