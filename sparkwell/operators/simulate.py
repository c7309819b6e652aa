"""Simulated plate pairs and repertoire rows, each made from its own seed, so that any number is made in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.wells import dims

#: Fixed values: (least, greatest, weight) of the share of clones that bind.
HIT_RATES = ((0.00, 0.00, 0.14), (0.01, 0.04, 0.26), (0.05, 0.15, 0.34), (0.15, 0.35, 0.20), (0.35, 0.60, 0.06))
#: How often each scenario turns up.
SCENARIO_WEIGHTS = {"nominal": 0.40, "tmb_overdeveloped": 0.12, "tmb_underdeveloped": 0.07, "poor_wash_control": 0.10, "poor_wash_both": 0.06, "weak_coating": 0.08, "edge_evaporation": 0.07, "reader_gradient": 0.05, "sloppy_pipetting": 0.05}
#: Shares of samples on a plate and their weights.
FILLS = ((1.0, 0.5), (0.75, 0.15), (0.5, 0.15), (0.25, 0.1), (0.12, 0.1))
#: How the plates of a scenario differ from nominal ones.
SCENARIOS = {
    "nominal": {},
    "tmb_overdeveloped": {"target": {"minutes": 45.0}, "control": {"minutes": 45.0, "blank": 0.18}},
    "tmb_underdeveloped": {"target": {"minutes": 5.0}, "control": {"minutes": 5.0}},
    "poor_wash_control": {"control": {"wash": 0.45, "blank": 0.22}},
    "poor_wash_both": {"target": {"wash": 0.5, "blank": 0.2}, "control": {"wash": 0.45, "blank": 0.22}},
    "weak_coating": {"target": {"coating": 0.25}},
    "edge_evaporation": {"target": {"edge": 0.45}, "control": {"edge": 0.45}},
    "reader_gradient": {"target": {"row_drift": 0.05, "col_drift": 0.02}, "control": {"row_drift": 0.05, "col_drift": 0.02}},
    "sloppy_pipetting": {"target": {"cv": 0.28}, "control": {"cv": 0.28}},
}
NO_EXPRESSION, CONTROL_BINDERS, TAG_BINDERS, WELL_FAILURES = 0.05, 0.02, 0.012, 0.02
DEVELOPMENT, CROSS_REACTIVITY, READ_NOISE = 0.055, 0.85, 0.012


@dataclass(frozen=True)
class Conditions:
    """How one plate was treated."""

    minutes: float = 15.0
    coating: float = 1.0
    wash: float = 1.0
    blank: float = 0.05
    ceiling: float = 4.0
    cv: float = 0.07
    edge: float = 0.0
    row_drift: float = 0.0
    col_drift: float = 0.0


def conditions_for(scenario: str, kind: str, rng: np.random.Generator) -> Conditions:
    """The plate of a scenario, with the jitter that no two plates are without."""
    if scenario not in SCENARIO_WEIGHTS:
        raise KeyError(f"unknown scenario {scenario!r}; known: {sorted(SCENARIO_WEIGHTS)}")
    changes = SCENARIOS[scenario].get(kind, {})
    c = replace(Conditions(), **changes)
    jitter = np.exp(rng.normal(0, (0.08, 0.12, 0.15, 0.10)))
    return replace(c, minutes=c.minutes * jitter[0], coating=c.coating * jitter[1], blank=c.blank * jitter[2], cv=c.cv * jitter[3])


def draw_clones(n: int, rng: np.random.Generator, hit_rate: float | None = None) -> pd.DataFrame:
    """What each clone is: expressed, its affinities for target and control, its stickiness. A tag binder binds both."""
    if hit_rate is None:
        weights = np.array([w for *_, w in HIT_RATES])
        low, high, _ = HIT_RATES[rng.choice(len(HIT_RATES), p=weights / weights.sum())]
        hit_rate = rng.uniform(low, high)
    u = rng.random((4, n))
    expressed = u[0] > NO_EXPRESSION
    affinity = np.where(expressed & (u[1] < hit_rate), np.exp(rng.normal(0.2, 1.1, n)), 0.0)
    control = np.where(expressed & (u[2] < CONTROL_BINDERS), np.exp(rng.normal(-0.3, 1.0, n)), 0.0)
    tag = np.where(expressed & (u[3] < TAG_BINDERS), np.exp(rng.normal(0.0, 0.9, n)), 0.0)
    return pd.DataFrame({"expressed": expressed, "affinity": affinity + tag, "control_affinity": control + tag, "stickiness": np.exp(rng.normal(-3.2, 0.95, n))})


def read_plate(clones: pd.DataFrame, place: np.ndarray, plate_format: int, kind: str, c: Conditions, rng: np.random.Generator) -> np.ndarray:
    """Readings of all wells of a plate; clone i is in the well ``place[i]``, counted down the columns, the others are empty."""
    rows, cols = dims(plate_format)
    n = rows * cols
    row, col = np.arange(n) % rows, np.arange(n) // rows
    edge = np.isin(row, (0, rows - 1)) | np.isin(col, (0, cols - 1))
    empty = c.blank * np.exp(rng.normal(0, 0.12, n)) + 0.4 * c.edge * edge * rng.uniform(0.5, 1, n) + rng.normal(0, 0.008, n)
    specific = clones.affinity if kind == "target" else clones.control_affinity
    sticky = clones.stickiness * (1.0 if kind == "target" else CROSS_REACTIVITY) / max(c.wash, 0.05)
    bound = np.zeros(n)
    bound[place] = np.where(clones.expressed, c.coating * (specific + sticky), 0.0)
    developed = 1 - np.exp(-DEVELOPMENT * bound * np.exp(rng.normal(0, c.cv, n)) * c.minutes)
    value = c.blank + (c.ceiling - c.blank) * developed + c.row_drift * row + c.col_drift * col + c.edge * edge * rng.uniform(0.5, 1, n) + rng.normal(0, READ_NOISE, n)
    used = np.zeros(n, bool)
    used[place] = rng.random(len(place)) >= WELL_FAILURES
    return np.round(np.clip(np.where(used, np.clip(value, 0, c.ceiling), empty), 0, None), 4)


_PAIR = "pair_id string, scenario string, well string, role string, clone_id string, od450_target double, od450_control double, is_binder boolean, is_control_binder boolean"


def simulate_pairs(spark: SparkSession, n_pairs: int, seed: int = 42, scenario: str | None = None, vary_fill: bool = True, plate_format: int = 96, hit_rate: float | None = None) -> DataFrame:
    """One row for each well of each pair, readings of both plates and the latent truth. A pair depends on the seed and its number only."""
    rows, cols = dims(plate_format)

    def one(number: int) -> pd.DataFrame:
        rng = np.random.default_rng([seed, number])
        names = list(SCENARIO_WEIGHTS)
        told = scenario or names[rng.choice(len(names), p=np.array(list(SCENARIO_WEIGHTS.values())))]
        fill = FILLS[rng.choice(len(FILLS), p=np.array([w for _, w in FILLS]))][0] if vary_fill else 1.0
        n, used = rows * cols, max(1, round(rows * cols * fill))
        clones, place = draw_clones(used, rng, hit_rate), np.arange(used)
        out = pd.DataFrame({"pair_id": f"pair-{number}", "scenario": told, "well": [f"{chr(65 + i % rows)}{i // rows + 1:02d}" for i in range(n)], "role": np.where(np.arange(n) < used, "sample", "empty")})
        out["clone_id"] = [f"CLN-{number}-{i}" if i < used else None for i in range(n)]
        for kind in ("target", "control"):
            out[f"od450_{kind}"] = read_plate(clones, place, plate_format, kind, conditions_for(told, kind, rng), rng)
        for name, column in (("is_binder", "affinity"), ("is_control_binder", "control_affinity")):
            out[name] = np.r_[(clones.expressed & (clones[column] > 0)).to_numpy(), np.zeros(n - used, bool)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                yield one(int(number))

    return spark.range(n_pairs).mapInPandas(run, _PAIR)


_UNIT = "v_call string, j_call string, sequence_alignment_aa string, cdr3_aa string, productive string, Redundancy string, ANARCI_status string"


def simulate_unit(spark: SparkSession, n: int, genes: dict[str, str], seed: int = 42, clonality: float = 0.3, shm_rate: float = 0.04, liability_rate: float = 0.03, ambiguous_rate: float = 0.02) -> DataFrame:
    """Repertoire rows from frameworks by gene: clonal CDR3 families, point mutations, unresolved residues, liabilities.

    Row i depends on the seed and i; members of a clone share the CDR3 of their founder.
    """
    letters, names = np.array(list("ACDEFGHIKLMNPQRSTVWY")), list(genes)

    def loop(number: int) -> str:
        rng = np.random.default_rng([seed, 1, number])
        return "C" + "".join(rng.choice(letters, max(4, int(rng.normal(13, 3))))) + "W"

    def row(number: int) -> tuple:
        rng = np.random.default_rng([seed, number])
        gene = names[rng.integers(len(names))]
        founder = number - number % 10 if rng.random() < clonality else number
        body = np.array(list(genes[gene]))
        hit = rng.random(len(body)) < shm_rate
        body[hit] = rng.choice(letters, hit.sum())
        if rng.random() < ambiguous_rate:
            body[: rng.integers(1, 6)] = "X"
        cdr3 = loop(founder)
        status = "Missing Conserved Cysteine: 104" if rng.random() < liability_rate else "fw1 is shorter than IMGT defined"
        return f"{gene}*01", "IGHJ4*02", "".join(body) + cdr3, cdr3, "T", str(1 + rng.poisson(1)), status

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row(int(i)) for i in batch["id"]], columns=[f.split()[0] for f in _UNIT.split(", ")])

    return spark.range(n).mapInPandas(run, _UNIT)
