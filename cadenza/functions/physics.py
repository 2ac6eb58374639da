"""Speed and power of a rider as Column expressions, so Catalyst keeps them in whole-stage code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


@dataclass(frozen=True)
class Rider:
    """The defaults of a rider without a profile."""

    ftp_w: int = 200
    map_w: int = 250
    ac_w: int = 350
    nm_w: int = 600
    lthr_bpm: int = 165
    max_hr_bpm: int = 190
    rest_hr_bpm: int = 55
    weight_kg: float = 75.0
    system_weight_kg: float = 87.0
    cda: float = 0.30
    crr: float = 0.0055
    efficiency: float = 0.97
    air_density: float = 1.225
    gravity: float = 9.81
    wheel_circ_m: float = 2.155


RIDER = Rider()
#: Rolling resistance of latex at its best pressure, of a middle pressure, of too high a pressure.
CRR_PRESETS = {"optimal": 0.0050, "mid": 0.0055, "overpressure": 0.0058}


def col(x: Value | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _resistance(grade_pct: Column, mass: Value, crr: Value, g: float) -> Column:
    """Newtons of rolling and climbing: (crr + sin(atan(grade))) * m * g."""
    return (col(crr) + F.sin(F.atan(grade_pct / 100.0))) * col(mass) * F.lit(g)


def predict_speed(power_w: Value, grade_pct: Value, mass: Value = RIDER.system_weight_kg, cda: Value = RIDER.cda, crr: Value = RIDER.crr, eta: Value = RIDER.efficiency, rho: float = RIDER.air_density, g: float = RIDER.gravity, cap_kmh: Value | None = None) -> Column:
    """km/h at which the power is balanced: the smallest positive root of a v^3 + b v = P * eta; 0 without one,
    null for null inputs.

    The cubic has no square term, so Cardano's formula solves it: one real root by cube roots, or three
    by cosines, of which the first is the only positive one.
    """
    p, s = col(power_w) * col(eta), col(grade_pct)
    a = F.lit(0.5 * rho) * col(cda)
    b = _resistance(s, mass, crr, g) / a
    q = p / a
    disc = q * q / 4.0 + b * b * b / 27.0
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    one = F.cbrt(q / 2.0 + root) + F.cbrt(q / 2.0 - root)
    r = F.sqrt(F.greatest(-b / 3.0, F.lit(0.0)))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), q / (2.0 * r * r * r))))
    three = 2.0 * r * F.cos(angle / 3.0)
    v = F.when(disc >= 0, one).otherwise(three)
    # without power, a rider coasts where the slope pulls and stands still otherwise
    v = F.when((q == 0) & (b < 0), F.sqrt(F.greatest(-b, F.lit(0.0)))).when((q == 0) & (b >= 0), F.lit(0.0)).otherwise(v)
    kmh = F.when(q.isNotNull() & b.isNotNull(), F.greatest(v, F.lit(0.0)) * 3.6)
    return kmh if cap_kmh is None else F.least(kmh, col(cap_kmh))


def predict_power(speed_kmh: Value, grade_pct: Value, mass: Value = RIDER.system_weight_kg, cda: Value = RIDER.cda, crr: Value = RIDER.crr, eta: Value = RIDER.efficiency, rho: float = RIDER.air_density, g: float = RIDER.gravity) -> Column:
    """Watts at the crank for a speed."""
    v = col(speed_kmh) / 3.6
    return (F.lit(0.5 * rho) * col(cda) * v * v + _resistance(col(grade_pct), mass, crr, g)) * v / col(eta)


def speed_at_cadence(rpm: Value, ratio: Value, wheel_circ_m: Value = RIDER.wheel_circ_m) -> Column:
    return col(rpm) * col(ratio) * col(wheel_circ_m) * 60.0 / 1000.0


def cadence(speed_kmh: Value, ring_t: Value, cog_t: Value, wheel_circ_m: Value = RIDER.wheel_circ_m) -> Column:
    """Crank turns a minute in a gear; 0 where any input is 0 or less."""
    s, r, c, w = col(speed_kmh), col(ring_t), col(cog_t), col(wheel_circ_m)
    return F.when((s > 0) & (r > 0) & (c > 0) & (w > 0), (s * 1000.0 / 60.0) / (w * r / c)).otherwise(F.lit(0.0))


def speed_uncertainty(grade_pct: Value) -> Column:
    g = col(grade_pct)
    return F.when(g >= 5, 1.5).when(g >= 1, 1.7).otherwise(2.0)


def vam(power_w: Value, grade_pct: Value, **body: Value) -> Column:
    """Metres climbed in an hour."""
    return predict_speed(power_w, grade_pct, **body) * 1000.0 * col(grade_pct) / 100.0


def survival_power(grade_pct: Value, lowest_ratio: Value = 30 / 32, **body: Value) -> Column:
    """Watts to turn 60 rpm in the lowest gear."""
    return predict_power(speed_at_cadence(60, lowest_ratio), grade_pct, **body)


def assisted_speed(power_w: Value, grade_pct: Value, share: Value, rated_w: Value, cutoff_kmh: Value, **body: Value) -> Column:
    """Extension: speed with a motor that adds a share of the rider's power up to its rating, below its cut-off."""
    motor = F.least(col(share) * col(power_w), col(rated_w))
    helped = predict_speed(col(power_w) + motor, grade_pct, **body)
    return F.when(helped > col(cutoff_kmh), predict_speed(power_w, grade_pct, **body)).otherwise(helped)
