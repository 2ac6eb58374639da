"""Reports: small results as markdown, JSON lines and GPX.

Frames are written by executors (``write_json``, the documents of ``gpx_documents``); markdown is for a person to read, so ``markdown_table``
refuses frames that are not small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the largest table a report prints.
MOST_ROWS = 1_000


def markdown_table(df: DataFrame, title: str = "", absent: str = "—") -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report table holds at most {MOST_ROWS} rows")
    show = lambda v: absent if v is None else f"{v:.2f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def upsert_section(text: str, name: str, body: str) -> str:
    """A marked section of a markdown text, put in place of the old one or at the end; doing it twice changes nothing."""
    start, end = f"<!-- {name}:START -->", f"<!-- {name}:END -->"
    block = f"{start}\n{body.strip()}\n{end}"
    before, found, rest = text.partition(start)
    if found:
        return before + block + rest.partition(end)[2]
    return text.rstrip("\n") + "\n\n" + block + "\n"


#: Fixed value: per cent of a route that rasters must cover for its elevation to rest on them.
BASELINE_COVERAGE = 80.0


def restated(text: str, label: str, new: float, unit: str, note: str, least: float, whole: bool = True) -> str:
    """The bullet ``label`` with a new figure and the old one beside it, where it moved by ``least`` or 5 %.

    A bullet that was restated before keeps the figure of the GPX file, so doing it twice changes nothing.
    """
    figure = r"~?(\d+(?:\.\d+)?)"
    bullet = re.compile(rf"^(- \*\*{re.escape(label)}\*\*[^:\n]*): (~?){figure}( {unit})?(?: \([^\n]*GPX: {figure}[^\n]*\))?$" if unit else rf"^(- \*\*{re.escape(label)}\*\*[^:\n]*): (~?){figure}()(?: \([^\n]*GPX: {figure}[^\n]*\))?$", re.M)

    def put(m: re.Match) -> str:
        old = m[5] or m[3]
        part = 0.05 * float(old)
        if abs(new - float(old)) < max(least, int(part) if whole else part):
            return m[0]
        shown = f"{new:.0f}" if whole else f"{new:g}"
        return f"{m[1]}: {m[2]}{shown}{m[4] or ''} ({note}; GPX: {m[2]}{old}{m[4] or ''})"

    return bullet.sub(put, text, count=1)


def wall_line(density: float | None, multiplier: float, if_lo: float, if_hi: float, tss_lo: float, tss_hi: float) -> str:
    if density is None:
        return "- **Wall density**: not measured, as no climb is verified; the stress is a lower bound on hilly roads."
    if multiplier <= 1.001:
        return f"- **Wall density**: {density:.1f} m/km at 8 % and more; no adjustment."
    return f"- **Wall density**: {density:.1f} m/km at 8 % and more: intensity and time x{multiplier:.2f}; expected IF {if_lo:.2f}-{if_hi:.2f}, TSS ~{tss_lo:.0f}-{tss_hi:.0f}."


def embed_prediction(text: str, report: str, load: dict | None = None, ascent_m: float | None = None, coverage_pct: float | None = None) -> str:
    """A route's markdown with the report of its verification, and its headline figures restated from the stitched profile.

    ``load``: a row of ``operators.climbs.stitched_load``.  Below BASELINE_COVERAGE a warning stands before the report.
    Doing it twice changes nothing.
    """
    warn = coverage_pct is not None and coverage_pct < BASELINE_COVERAGE
    note = f"> **Rasters cover {coverage_pct:.1f} % of the route, below {BASELINE_COVERAGE:.0f} %.** Elevation falls back to the GPX file's: ascent and stress may be too low.\n\n" if warn else ""
    text = upsert_section(text, "VERIFIED", note + report)
    if ascent_m is not None:
        text = restated(text, "Ascent", ascent_m, "m", "from rasters", 20)
    if load:
        how = "from rasters, adjusted to the terrain" if load["multiplier"] > 1.001 else "from rasters"
        text = restated(text, "Total moving time", load["hours_adj"], "h", how, 0.15, whole=False)
        for key in ("0.65", "0.70", "0.75"):
            text = restated(text, f"TSS at IF {key}", load[f"tss_adj_{key.replace('.', '')}"], "", how, 5)
        line = wall_line(*(load[k] for k in ("density", "multiplier", "if_lo", "if_hi", "tss_adj_lo", "tss_adj_hi")))
        text, n = re.subn(r"^- \*\*Wall density\*\*:[^\n]*$", lambda _: line, text, count=1, flags=re.M)
        last = None if n else max((m.end() for m in re.finditer(r"^- \*\*TSS at IF [^\n]*$", text, re.M)), default=None)
        if last is not None:
            text = text[:last] + "\n" + line + text[last:]
    return text


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.text(path)


def gpx_documents(points: DataFrame, key: str = "ride", name: str = "track") -> DataFrame:
    """key, gpx: one track a ride, of points with position and elevation, seven decimals of a degree."""
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL AND e IS NOT NULL")
    line = F.format_string('<trkpt lat="%.7f" lon="%.7f"><ele>%.2f</ele></trkpt>', "lat", "lon", "e")
    body = p.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("x")))), lambda s: s["x"]), "").alias("_b"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>{name}</name><trkseg>'
    return body.select(key, F.concat(F.lit(head), "_b", F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def grade_chunks(df: DataFrame, chunk_m: float = 100.0, by: tuple[str, ...] = ("ride",)) -> DataFrame:
    """by, chunk, start_m, grade, colour: a chart's bars."""
    from cadenza.functions.scoring import grade_colour

    c = df.withColumn("chunk", F.floor(F.col("d") / F.lit(chunk_m)).cast("long"))
    g = c.groupBy(*by, "chunk").agg(F.min("d").alias("start_m"), F.max("d").alias("_e"), F.min_by("e", "seq").alias("_a"), F.max_by("e", "seq").alias("_b"))
    grade = F.when(F.col("_e") > F.col("start_m"), (F.col("_b") - F.col("_a")) / (F.col("_e") - F.col("start_m")) * 100).otherwise(F.lit(0.0))
    return g.select(*by, "chunk", "start_m", grade.alias("grade")).withColumn("colour", grade_colour("grade"))
