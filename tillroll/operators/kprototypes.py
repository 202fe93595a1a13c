"""k-prototypes for rows with one category and several numbers.

The distance of a row from a prototype is the squared Euclidean distance of
the numbers plus ``gamma`` if the categories differ.  Several fits (numbers
of clusters, items, random starts) advance together: each pass over the rows
serves all fits not yet settled, and only the prototypes, a handful of rows,
come back to the driver.  They go out again as a small lookup table rather
than as literals, so all passes run the same generated code.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.scaling import NUMERIC

GAMMA_SHARE = 0.5  # of the mean deviation of the numbers, the usual default
SETTLED = 1e-9


@dataclass
class Fit:
    """One clustering of one item's rows; a prototype is (category, numbers)."""

    item: str
    k: int
    run: int
    gamma: float
    prototypes: list[tuple[str, list[float]]]
    cost: float = float("inf")
    passes: int = 0
    settled: bool = False
    converged: bool = False  # settled before the passes ran out
    costs: list[float] = field(default_factory=list)


def frequent_values(rows: DataFrame, most: int) -> DataFrame:
    """The most frequent values of each item with their rows' mean numbers."""
    counts = rows.groupBy("item", "value").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in NUMERIC]
    )
    rank = Window.partitionBy("item").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


def starting_fits(
    rows: DataFrame,
    ks: Iterable[int],
    gamma: float | None = None,
    seed: int | None = None,
    n_init: int = 1,
) -> list[Fit]:
    """Fits that start from the densest categories.

    With a single category column, choosing dense values far from those
    already chosen means taking the most frequent ones.  The numbers start
    at the mean of the category's rows, or with ``seed`` at random, drawn
    around the overall mean.  With fewer categories than clusters they repeat;
    a cluster that stays empty for that is then refilled like any other.
    """
    ks = list(ks)
    tops: dict[str, list] = {}
    for row in frequent_values(rows, max(ks)).orderBy("item", "rank").collect():
        tops.setdefault(row["item"], []).append(row)
    spreads = rows.groupBy("item").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in NUMERIC],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in NUMERIC],
    )
    spread = {row["item"]: row for row in spreads.collect()}

    fits = []
    for item, top in tops.items():
        mean = np.array([spread[item][f"mean_{c}"] for c in NUMERIC])
        std = np.array([spread[item][f"std_{c}"] for c in NUMERIC])
        weight = GAMMA_SHARE * float(std.mean()) if gamma is None else gamma
        for k in ks:
            chosen = [top[i % len(top)] for i in range(k)]
            for run in range(n_init if seed is not None else 1):
                numbers = [[r[c] for c in NUMERIC] for r in chosen]
                if seed is not None:
                    draw = np.random.default_rng([seed, run, k]).standard_normal((k, len(mean)))
                    numbers = (mean + draw * std).tolist()
                named = [(r["value"], n) for r, n in zip(chosen, numbers)]
                fits.append(Fit(item, k, run, weight, named))
    return fits


def assign(rows: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Each row once per fit of its item, with nearest cluster and distance.

    Clusters count from 0; a tie goes to the lower number.
    """
    width = max(fit.k for fit in fits)
    table = {
        "item": [fit.item for fit in fits],
        "k": pa.array([fit.k for fit in fits], pa.int32()),
        "run": pa.array([fit.run for fit in fits], pa.int32()),
        "gamma": [fit.gamma for fit in fits],
        "modes": [[mode for mode, _ in fit.prototypes] for fit in fits],
    }
    for i, c in enumerate(NUMERIC):
        table[f"_{c}"] = [[at[i] for _, at in fit.prototypes] for fit in fits]
    lookup = rows.sparkSession.createDataFrame(pa.table(table))  # one short row per fit

    # A fit with fewer clusters has no further places; least() skips those.
    distances = []
    for j in range(width):
        gaps = [f"({c} - get(_{c}, {j}))" for c in NUMERIC]
        squares = " + ".join(f"{gap} * {gap}" for gap in gaps)
        distances.append(f"{squares} + if(value = get(modes, {j}), 0D, gamma) as _d{j}")
    places = [f"_d{j}" for j in range(width)]
    best = f"least({', '.join(places)})" if width > 1 else "_d0"
    which = " ".join(f"when _d{j} = distance then {j}" for j in range(width))
    fixed = [*rows.columns, "k", "run"]
    return (
        rows.join(F.broadcast(lookup), "item")
        .selectExpr(*fixed, *distances)
        .selectExpr(*fixed, f"{best} as distance", *places)
        .selectExpr(*fixed, f"case {which} end as cluster", "distance")
    )


def prototypes_of(assigned: DataFrame) -> DataFrame:
    """Mean numbers, most frequent category, size and cost of each cluster.

    Counted per category first, so that what follows is small.
    """
    keys = ["item", "k", "run", "cluster"]
    counted = assigned.groupBy(*keys, "value").agg(
        F.count("*").alias("n"),
        F.sum("distance").alias("cost"),
        *[F.sum(c).alias(c) for c in NUMERIC],
    )
    return counted.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("cost").alias("cost"),
        F.max_by("value", F.struct("n", "value")).alias("mode"),
        *[(F.sum(c) / F.sum("n")).alias(c) for c in NUMERIC],
    )


def _refill(rows: DataFrame, fit: Fit, found: dict[int, object]) -> list[tuple[str, list[float]]]:
    """New prototypes for emptied clusters: the worst rows of the largest."""
    largest = max(found, key=lambda c: (found[c]["n"], -c))
    mine = assign(rows.where(F.col("item") == fit.item), [fit])
    far = mine.where((F.col("cluster") == largest) & (F.col("distance") > 0))
    worst = far.orderBy(F.desc("distance"), "value", *NUMERIC).limit(fit.k - len(found)).collect()
    return [(r["value"], [r[c] for c in NUMERIC]) for r in worst]


def _advance(
    rows: DataFrame, fit: Fit, found: dict[int, object], max_iter: int, tol: float
) -> None:
    cost = sum(r["cost"] for r in found.values())
    refills = _refill(rows, fit, found) if len(found) < fit.k else []
    moved, new = bool(refills), []
    for cluster, old in enumerate(fit.prototypes):
        if cluster in found:
            row = found[cluster]
            place = (row["mode"], [row[c] for c in NUMERIC])
        else:
            place = refills.pop() if refills else old
        moved |= place[0] != old[0] or not np.allclose(place[1], old[1], rtol=0, atol=SETTLED)
        new.append(place)
    fit.passes += 1
    fit.costs.append(cost)
    # The cost belongs to the prototypes before this update.
    still = not refills and (not moved or cost >= fit.cost * (1 - tol))
    fit.converged = still
    fit.settled = still or fit.passes >= max_iter
    fit.cost = min(cost, fit.cost)
    if not fit.settled:
        fit.prototypes = new


def run_fits(
    rows: DataFrame, fits: list[Fit], max_iter: int = 100, tol: float = 0.0
) -> list[Fit]:
    """Advance all fits until each settles; ``rows`` should be a table.

    A fit settles when its prototypes stay or its cost falls by no more than
    the share ``tol``; a small one saves many passes over a large table.
    """
    while running := [fit for fit in fits if not fit.settled]:
        found: dict[tuple, dict[int, object]] = {}
        for row in prototypes_of(assign(rows, running)).collect():
            found.setdefault((row["item"], row["k"], row["run"]), {})[row["cluster"]] = row
        for fit in running:
            _advance(rows, fit, found[fit.item, fit.k, fit.run], max_iter, tol)
    return fits


def best_runs(fits: Sequence[Fit]) -> list[Fit]:
    """The cheapest run for each item and number of clusters."""
    best: dict[tuple, Fit] = {}
    for fit in sorted(fits, key=lambda f: (f.item, f.k, f.cost, f.run)):
        best.setdefault((fit.item, fit.k), fit)
    return list(best.values())
