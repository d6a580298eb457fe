"""Closed formulas as column expressions or numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of argon (kg, J/K, m, K) for reduced units.
ARGON_MASS, BOLTZMANN, ARGON_SIGMA, ARGON_EPS_K = 6.6335209e-26, 1.380649e-23, 3.405e-10, 119.8


def kinetic_energy(kind: str, mass: float = 1.0) -> Column:
    """Of momenta px, py, pz: classical, relativistic (total minus rest energy) or massless."""
    p2 = F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")
    if kind == "classical":
        return p2 / (2 * mass)
    if kind == "relativistic":
        return F.sqrt(p2 + mass * mass) - mass
    if kind == "massless":
        return F.sqrt(p2)
    raise ValueError(f"unknown kinematics {kind!r}")


def velocity(axis: str, kind: str, mass: float = 1.0) -> Column:
    p = F.col(f"p{axis}")
    if kind == "classical":
        return p / mass
    energy = kinetic_energy(kind, mass) + (mass if kind == "relativistic" else 0.0)
    return F.when(energy > 1e-12, p / energy).otherwise(0.0)


def reduced_density(rho: Column) -> Column:
    """kg/m^3 of a reduced density."""
    return rho * (ARGON_MASS / ARGON_SIGMA**3)


def reduced_temperature(t: Column) -> Column:
    return t * ARGON_EPS_K


def reduced_pressure_mpa(p: Column) -> Column:
    return p * (BOLTZMANN * ARGON_EPS_K / ARGON_SIGMA**3 * 1e-6)


def reduced_kappa_per_gpa(kappa: Column) -> Column:
    return kappa * (ARGON_SIGMA**3 / (BOLTZMANN * ARGON_EPS_K) * 1e9)


def lennard_jones(r2: Column, eps: float = 1.0, sigma: float = 1.0, cutoff: float = 2.5, most: float = 1e4) -> tuple[Column, Column, Column]:
    """(force over distance, virial, energy) of a pair; nothing beyond cutoff * sigma or nearer than 1e-3.

    The force's size is capped, and the virial follows the capped force; the energy isn't.
    """
    s6 = F.pow(F.lit(sigma * sigma) / r2, F.lit(3.0))
    raw = 24 * eps * (2 * s6 * s6 - s6) / r2
    r = F.sqrt(r2)
    size = F.least(F.greatest(raw * r, F.lit(-most)), F.lit(most))
    near = (r2 > 1e-6) & (r2 < (cutoff * sigma) ** 2)
    zero = F.lit(0.0)
    return F.when(near, size / r).otherwise(zero), F.when(near, size * r).otherwise(zero), F.when(near, 4 * eps * (s6 * s6 - s6)).otherwise(zero)


def pressure_tail(rho: float, sigma: float = 1.0, eps: float = 1.0, cutoff: float = 2.5) -> float:
    c3 = 1 / cutoff**3
    return 16 / 3 * math.pi * rho * rho * eps * sigma**3 * (2 / 3 * c3**3 - c3)


def energy_tail(rho: float, sigma: float = 1.0, eps: float = 1.0, cutoff: float = 2.5) -> float:
    c3 = 1 / cutoff**3
    return 8 / 3 * math.pi * rho * eps * sigma**3 * (c3**3 / 3 - c3)


def cross_section(diameter: Column | float) -> Column | float:
    return math.pi * diameter * diameter


def packing_fraction(rho: Column, diameter: float) -> Column:
    return rho * (math.pi / 6 * diameter**3)


def contact_value(eta: Column, order: int | str = "carnahan_starling") -> Column:
    """Pair correlation at contact: Carnahan-Starling, excluded volume, or its series to an order of 0, 1 or 2."""
    if order == "carnahan_starling":
        return (1 - eta / 2) / F.pow(1 - eta, F.lit(3.0))
    if order == "excluded_volume":
        return 1 / (1 - 4 * eta)
    series = [1.0, 2.5, 4.59]
    out = F.lit(series[0])
    for k in range(1, int(order) + 1):
        out = out + series[k] * F.pow(eta, F.lit(float(k)))
    return out


def van_der_waals(rho: Column, t: Column | float, a: float, b: float) -> Column:
    return rho * t / (1 - b * rho) - a * rho * rho


def carnahan_starling_z(eta: Column) -> Column:
    return (1 + eta + eta * eta - F.pow(eta, F.lit(3.0))) / F.pow(1 - eta, F.lit(3.0))


def mean_field_z(eta: Column, rho: Column, t: float, a: float) -> Column:
    return carnahan_starling_z(eta) - a * rho / t


def second_virial_of(t: Column, step: float = 0.003, points: int = 4000) -> Column:
    """Second virial coefficient of the reduced pair potential at temperature t, by trapezoids on a grid (0 at r = 0)."""

    def term(i: Column) -> Column:
        r = i * F.lit(step)
        u = F.greatest(F.least(4 * (F.pow(r, F.lit(-12.0)) - F.pow(r, F.lit(-6.0))) / t, F.lit(700.0)), F.lit(-700.0))
        return (1 - F.exp(-u)) * r * r * F.when(i == points, 0.5).otherwise(1.0)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(points)), F.lit(0.0), lambda s, i: s + term(i))
    return 2 * math.pi * step * total


def second_virial(t: float, steps: int = 4000, reach: float = 12.0) -> float:
    """B2 of the Lennard-Jones potential by the trapezoid rule."""
    h = reach / steps

    def f(r: float) -> float:
        if r == 0:
            return 0.0
        u = 4 * (r**-12 - r**-6) / t
        return (1 - (math.exp(-u) if u < 700 else 0.0)) * r * r

    total = sum(f(i * h) for i in range(1, steps)) + f(reach) / 2
    return 2 * math.pi * h * total


def maxwell_speed(v: Column, t: float, mass: float = 1.0) -> Column:
    return 4 * math.pi * (mass / (2 * math.pi * t)) ** 1.5 * v * v * F.exp(-mass * v * v / (2 * t))


def juttner_shape(p: Column, t: float, mass: float) -> Column:
    """Unnormalised momentum density p^2 exp(-E / T)."""
    return p * p * F.exp(-F.sqrt(p * p + mass * mass) / t)


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and keys only, not on partitions or retries."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def hash_normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number of the same kind, by Box and Muller."""
    u = F.greatest(hash_uniform(seed, F.lit(1), *keys), F.lit(1e-300))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * hash_uniform(seed, F.lit(2), *keys))
