"""Rider profiles: where they are looked for, what they are laid over, and where each value came from."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from cadenza.functions.physics import RIDER, Rider
from cadenza.sources.bikes import FRONT_PCT, load_bike, surface_of
from cadenza.sources.files import front_matter

_LOG = logging.getLogger(__name__)
#: Names of a rider's own profile and of the example that stands in for it.
OWN, EXAMPLE = "USER_PROFILE.md", "USER_PROFILE.example.md"


def default_profile(rider: Rider = RIDER) -> dict:
    return {
        "athlete": {"ftp_w": rider.ftp_w, "map_w": rider.map_w, "ac_w": rider.ac_w, "nm_w": rider.nm_w, "lthr_bpm": rider.lthr_bpm, "max_hr_bpm": rider.max_hr_bpm, "rest_hr_bpm": rider.rest_hr_bpm, "weight_kg": rider.weight_kg},
        "physics": {"system_weight_kg": rider.system_weight_kg, "cda": rider.cda, "crr": rider.crr, "drivetrain_efficiency": rider.efficiency, "wheel_circ_m": rider.wheel_circ_m, "fr_split_front_pct": FRONT_PCT},
    }


def laid_over(base: dict, own: dict, name: str, origin: dict[str, str], depth: int = 1) -> dict:
    """``base`` with ``own`` over it: mappings merge key by key down to ``depth``, deeper ones and other values are taken whole.

    ``origin`` notes for each dotted key that ``own`` gave who gave it, and forgets the keys under a value that was replaced.
    """
    out = dict(base)
    for key, value in own.items():
        if isinstance(value, dict) and depth:
            inner: dict[str, str] = {k.partition(".")[2]: v for k, v in origin.items() if k.startswith(f"{key}.")}
            kept = out.get(key)
            if not isinstance(kept, dict):
                kept, inner = {}, {}
            out[key] = laid_over(kept, value, name, inner, depth - 1)
        else:
            out[key], inner = value, {}
        for k in [k for k in origin if k == key or k.startswith(f"{key}.")]:
            del origin[k]
        origin.update({f"{key}.{k}": v for k, v in inner.items()} if isinstance(value, dict) and depth else {key: name})
    return out


def discovered(spark: SparkSession, folders: Sequence[str]) -> tuple[str | None, dict]:
    """(path, front matter) of the first profile: a rider's own in any folder, else an example in any; (None, {}) without one.

    A profile that holds no mapping is reported and counts as one without values.
    """
    for name in (OWN, EXAMPLE):
        for folder in folders:
            path = f"{folder.rstrip('/')}/{name}"
            try:
                texts = spark.read.text(path, wholetext=True).head(1)
            except AnalysisException:  # no such file
                continue
            found = front_matter(texts[0].value) if texts else {}
            if not found:
                _LOG.warning("%s holds no values", path)
            if name == EXAMPLE:
                _LOG.warning("no %s; %s stands in for it", OWN, path)
            return path, found
    return None, {}


def load_profile(spark: SparkSession, folders: Sequence[str], rider: Rider = RIDER) -> tuple[dict, dict[str, str]]:
    """(profile, origins): what was found over the defaults, and for each value whether it is a default or of which file."""
    base = default_profile(rider)
    origin = {f"{s}.{k}": "default" for s, values in base.items() for k in values}
    path, own = discovered(spark, folders)
    return (laid_over(base, own, path, origin) if path else base), origin


def body_of(profile: dict, bike: str | None = None, surface: str | None = None, rider: Rider = RIDER) -> dict[str, float]:
    """The parameters of ``functions.physics`` for a bike of a profile on a surface: mass, cda, crr, eta.

    Without a bike asked for and without a default one, those of the profile's physics.
    """
    physics = profile.get("physics") or {}
    base = {"mass": physics.get("system_weight_kg", rider.system_weight_kg), "cda": physics.get("cda", rider.cda), "crr": physics.get("crr", rider.crr), "eta": physics.get("drivetrain_efficiency", rider.efficiency)}
    if bike is None and not profile.get("default_bike"):
        return {k: float(v) for k, v in base.items()}
    b = load_bike(profile, bike)
    chosen = surface_of(b, surface)
    crr = (b.get("crr_by_surface") or {}).get(chosen) if chosen else None
    over = {"mass": b.get("system_weight_kg_default"), "cda": b.get("cda"), "crr": crr, "eta": b.get("drivetrain_efficiency")}
    return {k: float(base[k] if over[k] is None else over[k]) for k in base}
