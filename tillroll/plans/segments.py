"""Clustering the matched purchases, for one to six clusters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tillroll.operators import kprototypes as kp
from tillroll.operators.lookback import history_events
from tillroll.operators.scaling import clustering_rows, zscore
from tillroll.session import stage
from tillroll.sources.schemas import ITEMS

CLUSTER_COUNTS = range(1, 7)


def scaled_matches(
    transactions: DataFrame, spine: DataFrame, items: tuple[str, ...] = ITEMS
) -> DataFrame:
    """The z-scored rows as a table, to be read once per pass."""
    rows = stage(clustering_rows(history_events(transactions, spine), items), "matches")
    return stage(zscore(rows), "scaled")


def cluster(
    scaled: DataFrame,
    ks: Iterable[int] = CLUSTER_COUNTS,
    gamma: float | None = None,
    max_iter: int = 100,
    seed: int | None = None,
    n_init: int | None = None,
    tol: float = 0.0,
) -> list[kp.Fit]:
    """The best fit per item and number of clusters.

    Without ``seed`` the start is fixed and there is one run; with it there are
    ``n_init`` random starts, two unless given.
    """
    if seed is None and n_init not in (None, 1):
        raise ValueError("several starts need a seed")
    fits = kp.starting_fits(scaled, ks, gamma, seed, 2 if n_init is None else n_init)
    return kp.best_runs(kp.run_fits(scaled, fits, max_iter, tol))


def elbow(scaled: DataFrame, **options) -> DataFrame:
    """Cost by item and number of clusters, with the passes taken and whether they were enough."""
    costs = [(f.item, f.k, f.cost, f.passes, f.converged) for f in cluster(scaled, **options)]
    schema = "item string, k int, cost double, passes int, converged boolean"
    return scaled.sparkSession.createDataFrame(costs, schema)


def labelled(scaled: DataFrame, fits: list[kp.Fit]) -> DataFrame:
    """The rows, with their shoppers, and their cluster under each of the fits."""
    return kp.assign(scaled, fits).drop("run")
