"""Iterated particle simulation: each step is a transform of the particle table.

A step reads and returns flat columns (id, x, y, z, px, py, pz, e, ix, iy, iz,
alive ...).  Random numbers are hashes of (seed, id, step), so a step gives the
same result whichever task runs it.  ``evolve`` cuts the plan every few steps by
a reliable checkpoint where the session has a folder for it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import hash_normal, hash_uniform, kinetic_energy, lennard_jones, velocity
from ..operators.elementwise import cell_id, scale_momenta
from ..operators.neighbours import pairs_within


def wrap(c: str, box: float) -> dict[str, Column]:
    """Position brought back into (-box/2, box/2], crossings counted in the image number."""
    turns = F.ceil((F.col(c) - box / 2) / box)
    return {c: F.col(c) - turns * box, f"i{c}": (F.col(f"i{c}") + turns).cast("int")}


def reflect(c: str, box: float) -> dict[str, Column]:
    """Position and momentum after bouncing between walls at +-box/2, and the momentum given to them."""
    s = F.pmod(F.col(c) + box / 2, F.lit(2 * box))
    bounces = F.abs(F.floor((F.col(c) + box / 2) / box))
    return {
        c: F.when(s <= box, s).otherwise(2 * box - s) - box / 2, f"p{c}": F.when(bounces % 2 == 0, F.col(f"p{c}")).otherwise(-F.col(f"p{c}")),
        "wall": F.coalesce(F.col("wall"), F.lit(0.0)) + 2 * bounces * F.abs(F.col(f"p{c}")),
    }


def kick(particles: DataFrame, dt: float) -> DataFrame:
    """Momenta by forces fx, fy, fz over dt."""
    return particles.withColumns({f"p{c}": F.col(f"p{c}") + F.col(f"f{c}") * dt for c in "xyz"})


def drift(particles: DataFrame, dt: float, box: float, kinematics: str = "classical", mass: float = 1.0, boundary: str = "periodic") -> DataFrame:
    """Positions by velocities over dt, then the boundary."""
    out = particles.withColumns({c: F.col(c) + velocity(c, kinematics, mass) * dt for c in "xyz"})
    if boundary == "periodic":
        return out.withColumns({k: v for c in "xyz" for k, v in wrap(c, box).items()})
    out = out if "wall" in out.columns else out.withColumn("wall", F.lit(0.0))
    for c in "xyz":  # walls of all axes add to one number
        out = out.withColumns(reflect(c, box))
    return out


def pair_forces(particles: DataFrame, box: float, cutoff: float = 2.5, periodic: bool = True, **potential: float) -> DataFrame:
    """particles with forces fx, fy, fz and each one's half share of virial and potential energy.

    Pairs come from the cell join; a pair's force is added to both its ends.
    """
    p = pairs_within(particles.where("alive") if "alive" in particles.columns else particles, cutoff, box, periodic)
    force, virial, energy = lennard_jones(F.col("r2"), cutoff=cutoff, **potential)
    p = p.select("a", "b", *((force * F.col(f"d{c}")).alias(f"f{c}") for c in "xyz"), (virial / 2).alias("virial"), (energy / 2).alias("pe"))
    ends = p.select(F.col("a").alias("id"), "fx", "fy", "fz", "virial", "pe").unionAll(p.select("b", -F.col("fx"), -F.col("fy"), -F.col("fz"), "virial", "pe"))
    total = ends.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "fz", "virial", "pe")))
    base = particles.drop("fx", "fy", "fz", "virial", "pe")
    return base.join(total, "id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("fx", "fy", "fz", "virial", "pe")})


def andersen(particles: DataFrame, t: float, rate: float, dt: float, seed: int, step: int, mass: float = 1.0) -> DataFrame:
    """With probability rate * dt a particle's momentum is drawn anew."""
    hit = hash_uniform(seed, "id", F.lit(step)) < rate * dt
    return particles.withColumns({f"p{c}": F.when(hit, hash_normal(seed, "id", F.lit(step), F.lit(c)) * math.sqrt(mass * t)).otherwise(F.col(f"p{c}")) for c in "xyz"})


def langevin(particles: DataFrame, t: float, rate: float, dt: float, seed: int, step: int, mass: float = 1.0) -> DataFrame:
    """Drag and noise."""
    noise = math.sqrt(2 * rate * mass * t * dt)
    return particles.withColumns({f"p{c}": F.col(f"p{c}") * (1 - rate * dt) + noise * hash_normal(seed, "id", F.lit(step), F.lit(c)) for c in "xyz"})


def rescale_relativistic(particles: DataFrame, target: float, mass: float) -> DataFrame:
    """Momenta by (T*/T)^(1 - m / (2 <E>)), T = sum(p^2/E) / (3 N)."""
    live = particles.where("alive")
    p2 = F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")
    r = live.agg(F.avg(p2 / F.col("e")).alias("t"), F.avg("e").alias("e")).first()
    if not r.t:
        return particles
    return scale_momenta(particles, (target / (r.t / 3)) ** (1 - mass / (2 * r.e)), mass)


@dataclass
class NoseHooverChain:
    """Three thermostats in a chain; ``half_step`` gives the factor of momenta."""

    target: float
    degrees: int
    tau: float = 0.5
    zeta: list[float] = field(default_factory=lambda: [0.0] * 3)
    speed: list[float] = field(default_factory=lambda: [0.0] * 3)

    def __post_init__(self):
        q = self.target * self.tau**2
        self.mass = [self.degrees * q, q, q]

    def half_step(self, kinetic: float, dt: float) -> float:
        """Advances the chain by dt / 2 for a kinetic energy and returns the scale of momenta."""
        v, q, t, h = self.speed, self.mass, self.target, dt / 2
        pull = lambda k: (2 * kinetic - self.degrees * t) / q[0] if k == 0 else (q[k - 1] * v[k - 1] ** 2 - t) / q[k]
        v[2] += pull(2) * h / 2
        for k in (1, 0):
            damp = math.exp(-v[k + 1] * h / 4)
            v[k] = (v[k] * damp + pull(k) * h / 2) * damp
        scale = math.exp(-v[0] * h)
        kinetic *= scale * scale
        for k in range(3):
            self.zeta[k] += v[k] * h
        for k in (0, 1):
            damp = math.exp(-v[k + 1] * h / 4)
            v[k] = (v[k] * damp + ((2 * kinetic - self.degrees * t) / q[0] if k == 0 else pull(k)) * h / 2) * damp
        v[2] += pull(2) * h / 2
        return scale


def _boost(p: np.ndarray, e: float, b: np.ndarray) -> tuple[np.ndarray, float]:
    b2 = float(b @ b)
    if b2 < 1e-24:
        return p, e
    g = 1 / math.sqrt(max(1e-15, 1 - b2))
    along = float(b @ p)
    return p + ((g - 1) * along / b2 - g * e) * b, g * (e - along)


def _direction(rng: np.random.Generator) -> np.ndarray:
    z, phi = 2 * rng.random() - 1, 2 * math.pi * rng.random()
    s = math.sqrt(1 - z * z)
    return np.array([s * math.cos(phi), s * math.sin(phi), z])


def scatter_classical(p1: np.ndarray, p2: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Isotropic elastic scattering of equal masses: total momentum and kinetic energy stay."""
    half, rel = (p1 + p2) / 2, np.linalg.norm(p1 - p2) / 2
    d = _direction(rng) * rel
    return half + d, half - d


def scatter_relativistic(p1: np.ndarray, e1: float, p2: np.ndarray, e2: float, rng: np.random.Generator):
    """Isotropic elastic scattering in the pair's own frame."""
    b = (p1 + p2) / (e1 + e2)
    q, qe = _boost(p1, e1, b)
    out = _direction(rng) * np.linalg.norm(q)
    _, other = _boost(p2, e2, b)
    (a, ae), (c, ce) = _boost(out, qe, -b), _boost(-out, other, -b)
    return a, ae, c, ce


def collide(
    particles: DataFrame, box: float, cells: int, dt: float, diameter: float, kind: str = "classical", mass: float = 1.0, chi: float = 1.0, seed: int = 17, step: int = 0,
    split: float = 0.0, merge: float = 0.0,
) -> DataFrame:
    """Random pair collisions within cells; particles may collide more than once a step, so a cell is one group.

    M = max(1, n/2) random pairs stand for n(n-1)/2, each weighted by n(n-1)/(2M)
    and accepted with probability weight * chi * sigma * v_rel * dt / V.  With
    ``split``, accepted relativistic pairs also make a third particle with that
    probability; with ``merge``, a pair loses one of its members.  Energy and
    momentum are shared so that both are conserved by elastic collisions.
    """
    volume, sigma = (box / cells) ** 3, math.pi * diameter**2
    columns = particles.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = len(frame)
        frame = frame.sort_values("id").reset_index(drop=True)
        if n < 2:
            return frame[columns]
        rng = np.random.default_rng([seed, step, int(frame["cell"].iloc[0])])
        p, e = frame[["px", "py", "pz"]].to_numpy(float).copy(), frame["e"].to_numpy(float).copy()
        alive, m, born = np.ones(n, bool), max(1, n // 2), []
        weight = n * (n - 1) / (2 * m)
        for _ in range(m):
            i, j = rng.choice(n, 2, replace=False)
            if not (alive[i] and alive[j]):
                continue
            vi, vj = (p[i] / mass, p[j] / mass) if kind == "classical" else (p[i] / e[i], p[j] / e[j])
            if rng.random() >= weight * chi * sigma * float(np.linalg.norm(vi - vj)) * dt / volume:
                continue
            if kind == "classical":
                p[i], p[j] = scatter_classical(p[i], p[j], rng)
                e[i], e[j] = p[i] @ p[i] / (2 * mass), p[j] @ p[j] / (2 * mass)
                continue
            p[i], e[i], p[j], e[j] = scatter_relativistic(p[i], e[i], p[j], e[j], rng)
            draw = rng.random()
            if draw < split:  # a massless third takes half of one's momentum
                born.append((p[j] / 2, e[j] / 2))
                p[j], e[j] = p[j] / 2, e[j] / 2
            elif draw < split + merge:
                p[i], e[i], alive[j] = p[i] + p[j], e[i] + e[j], False
        frame[["px", "py", "pz"]], frame["e"] = p, e
        out = frame[alive][columns]
        if born:
            new = frame.iloc[[0] * len(born)][columns].copy()
            new["id"] = [-(abs(hash((seed, step, int(frame["id"].iloc[0]), k))) % (1 << 62)) - 1 for k in range(len(born))]
            new[["px", "py", "pz"]], new["e"] = np.array([b[0] for b in born]), [b[1] for b in born]
            out = pd.concat([out, new])
        return out

    return particles.withColumn("cell", cell_id(box, cells)).groupBy("cell").applyInPandas(run, particles.schema)


def cell_field_force(particles: DataFrame, fields: DataFrame, a: float, c2: float, most: float = 1000.0) -> DataFrame:
    """Non-local force 2 a grad n - c2 grad lap n of the particle's cell, its size capped; fields: (cell, gx.., glx..)."""
    joined = particles.join(fields, "cell")
    f = {c: 2 * a * F.col(f"g{c}") - c2 * F.col(f"gl{c}") for c in "xyz"}
    size = F.sqrt(f["x"] * f["x"] + f["y"] * f["y"] + f["z"] * f["z"])
    cap = F.when(size > most, most / size).otherwise(1.0)
    return joined.select(*particles.columns, *((f[c] * cap).alias(f"f{c}") for c in "xyz"))


def polarization(particles: DataFrame, fields: DataFrame, cw: float, cs: float, cg: float, mass: float = 1.0) -> DataFrame:
    """Cw omega + Cs S v + Cg v x g of the particle's cell."""
    joined = particles.join(fields, "cell")
    v = {c: F.col(f"p{c}") / F.col("e") for c in "xyz"}
    shear = {"x": ("sxx", "sxy", "sxz"), "y": ("sxy", "syy", "syz"), "z": ("sxz", "syz", "szz")}
    cross = {"x": v["y"] * F.col("gz") - v["z"] * F.col("gy"), "y": v["z"] * F.col("gx") - v["x"] * F.col("gz"), "z": v["x"] * F.col("gy") - v["y"] * F.col("gx")}
    spin = {c: cw * F.col(f"w{c}") + cs * sum((F.col(s) * v[d] for s, d in zip(shear[c], "xyz")), F.lit(0.0)) + cg * cross[c] for c in "xyz"}
    return joined.select(*particles.columns, *(spin[c].alias(f"pol_{c}") for c in "xyz"))


@dataclass
class Policy:
    """What a simulation is made of; each part is chosen by name or given as a function."""

    kinematics: str = "classical"
    boundary: str = "periodic"
    potential: str | None = "lennard_jones"
    thermostat: Callable[[DataFrame, int], DataFrame] | None = None
    collisions: Callable[[DataFrame, int], DataFrame] | None = None


def step(particles: DataFrame, box: float, dt: float, policy: Policy, number: int, mass: float = 1.0, cutoff: float = 2.5) -> DataFrame:
    """Half kick, drift, collisions, forces, half kick, thermostat."""
    forces = policy.potential is not None
    if forces:
        particles = kick(particles if "fx" in particles.columns else pair_forces(particles, box, cutoff, policy.boundary == "periodic"), dt / 2)
    particles = drift(particles, dt, box, policy.kinematics, mass, policy.boundary)
    if policy.collisions:
        particles = policy.collisions(particles, number)
    if forces:
        particles = kick(pair_forces(particles, box, cutoff, policy.boundary == "periodic"), dt / 2)
    if policy.thermostat:
        particles = policy.thermostat(particles, number)
    return particles.withColumn("e", kinetic_energy(policy.kinematics, mass) + (mass if policy.kinematics == "relativistic" else 0.0))


def evolve(particles: DataFrame, steps: int, box: float, dt: float, policy: Policy, cut: int = 5, **kw) -> DataFrame:
    reliable = particles.sparkSession.conf.get("spark.checkpoint.dir", None) or particles.sparkSession.sparkContext.getCheckpointDir()
    for n in range(steps):
        particles = step(particles, box, dt, policy, n, **kw)
        if (n + 1) % cut == 0 and n + 1 < steps:
            particles = particles.checkpoint() if reliable else particles.persist()
    return particles


def observables(particles: DataFrame, box: float, kinematics: str = "classical", mass: float = 1.0) -> DataFrame:
    """n, ke, pe, t, pressure and total momentum of a state."""
    n, ke = F.count("*"), F.sum(kinetic_energy(kinematics, mass))
    pe, virial = (F.sum(c) if c in particles.columns else F.lit(0.0) for c in ("pe", "virial"))
    return particles.agg(
        n.alias("n"), ke.alias("ke"), pe.alias("pe"), (2 * ke / (3 * n)).alias("t"), ((2 * ke + virial) / (3 * box**3)).alias("pressure"),
        *(F.sum(f"p{c}").alias(f"p{c}") for c in "xyz"),
    )


def sweep(values: dict[str, Iterable], run: Callable[..., DataFrame]) -> DataFrame:
    """All combinations of parameter values, each one's result with its parameters as columns."""
    out = None
    for combo in itertools.product(*values.values()):
        row = run(**dict(zip(values, combo))).withColumns({k: F.lit(v) for k, v in zip(values, combo)})
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no values")
    return out
