import random

import numpy as np
import pytest
from tables import rows_of

from tillroll.operators import kprototypes as kp
from tillroll.operators.scaling import NUMERIC, zscore
from tillroll.plans.segments import cluster, elbow, labelled
from tillroll.session import stage

SCHEMA = "item string, value string, " + ", ".join(f"{c} double" for c in NUMERIC)


def sample(seed, items=("brand", "category"), rows=150, values=7):
    pick = random.Random(seed)
    out = []
    for item in items:
        for _ in range(rows):
            centre = pick.choice((0, 8, 20))
            numbers = [centre + pick.gauss(0, 1.5) for _ in NUMERIC]
            out.append((item, f"v{min(pick.randrange(values), pick.randrange(values))}", *numbers))
    return out


@pytest.fixture(scope="module")
def scaled(spark):
    return stage(zscore(spark.createDataFrame(sample(1), SCHEMA)), "scaled-test")


def test_zscore(spark):
    rows = [("a", "x", 1.0, 5.0, 0.0), ("a", "y", 3.0, 5.0, 4.0), ("b", "x", 9.0, 9.0, 9.0)]
    result = zscore(spark.createDataFrame(rows, SCHEMA))
    found = {(r["item"], r["value"]): [r[c] for c in NUMERIC] for r in result.collect()}
    # population deviation; a column without spread is only centred
    assert found == {("a", "x"): [-1, 0, -1], ("a", "y"): [1, 0, 1], ("b", "x"): [0, 0, 0]}


def by_hand(rows, k, gamma=0.5, passes=100):
    """The same clustering over a list: cost and labels."""
    counts = {}
    for value, *_ in rows:
        counts[value] = counts.get(value, 0) + 1
    top = sorted(counts, key=lambda v: (-counts[v], v))[:k]
    numbers = np.array([r[1:] for r in rows])
    values = np.array([r[0] for r in rows])
    modes, centres = list(top), [numbers[values == v].mean(axis=0) for v in top]
    best = np.inf
    for _ in range(passes):
        distance = np.array(
            [((numbers - c) ** 2).sum(axis=1) + gamma * (values != m)
             for m, c in zip(modes, centres)]
        )
        labels, cost = distance.argmin(axis=0), distance.min(axis=0).sum()
        assert len(set(labels)) == k, "this check does not refill clusters"
        if cost >= best - 1e-12:
            break
        best = cost
        centres = [numbers[labels == j].mean(axis=0) for j in range(k)]
        modes = []
        for j in range(k):
            inside = list(values[labels == j])
            modes.append(max(set(inside), key=lambda v: (inside.count(v), v)))
    return best, labels


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_fit_against_a_plain_loop(scaled, k):
    fits = {fit.item: fit for fit in cluster(scaled, [k])}
    for item, fit in fits.items():
        table = scaled.where(f"item = '{item}'").select("value", *NUMERIC).collect()
        cost, _ = by_hand([tuple(r) for r in table], k)
        assert fit.cost == pytest.approx(cost)


def test_fits_advance_together_as_alone(scaled):
    together = {(f.item, f.k): f.cost for f in cluster(scaled, range(1, 5))}
    for k in range(1, 5):
        for fit in cluster(scaled, [k]):
            assert together[fit.item, k] == pytest.approx(fit.cost)


def test_cost_falls_over_the_passes(scaled):
    for fit in cluster(scaled, [2, 3, 4]):
        assert all(b <= a + 1e-9 for a, b in zip(fit.costs, fit.costs[1:]))
        assert fit.settled and fit.passes < 100


def test_a_tolerance_saves_passes(scaled):
    exact, rough = cluster(scaled, [4]), cluster(scaled, [4], tol=0.01)
    for e, r in zip(exact, rough):
        assert r.passes <= e.passes
        assert e.cost <= r.cost <= e.cost * 1.2


def test_every_row_has_a_label(scaled):
    fits = cluster(scaled, [3])
    rows = labelled(scaled, fits)
    assert rows.count() == scaled.count()
    assert {r["cluster"] for r in rows.select("cluster").distinct().collect()} == {0, 1, 2}
    cost = {r[0]: r[1] for r in rows.groupBy("item").sum("distance").collect()}
    assert all(cost[f.item] == pytest.approx(f.cost) for f in fits)


def test_one_cluster_has_a_closed_form(scaled):
    rows = {r["item"]: r["cost"] for r in elbow(scaled, ks=[1]).collect()}
    for item in ("brand", "category"):
        counts = [r["count"] for r in scaled.where(f"item = '{item}'").groupBy("value").count()
                  .collect()]
        n = sum(counts)
        assert rows[item] == pytest.approx(3 * n + 0.5 * (n - max(counts)))


def test_more_clusters_than_categories(spark):
    rows = [("brand", "only", float(i), float(i % 3), float(i * i)) for i in range(30)]
    scaled = stage(zscore(spark.createDataFrame(rows, SCHEMA)), "few")
    fit = cluster(scaled, [3])[0]
    sizes = labelled(scaled, [fit]).groupBy("cluster").count().count()
    assert sizes == 3
    assert fit.cost < cluster(scaled, [1])[0].cost


def test_random_starts_repeat_with_the_seed(scaled):
    columns = ("cost", "item", "k")
    once = rows_of(elbow(scaled, ks=[2, 3], seed=5, n_init=3).select(*columns))
    again = rows_of(elbow(scaled, ks=[2, 3], seed=5, n_init=3).select(*columns))
    assert [r[1:] for r in once] == [r[1:] for r in again]
    assert [r[0] for r in once] == pytest.approx([r[0] for r in again])


def test_several_starts_need_a_seed(scaled):
    with pytest.raises(ValueError, match="seed"):
        cluster(scaled, [2], n_init=5)


def test_the_elbow_says_whether_the_passes_were_enough(scaled):
    assert all(r["converged"] for r in elbow(scaled, ks=[1, 3]).collect())
    stopped = [r for r in elbow(scaled, ks=[3], max_iter=2).collect() if not r["converged"]]
    assert stopped and all(r["passes"] == 2 for r in stopped)


def test_labels_belong_to_shoppers(spark):
    rows = [(i, "brand", f"v{i % 3}", float(i), float(i % 5), 0.0) for i in range(40)]
    scaled = stage(zscore(spark.createDataFrame(rows, "id long, " + SCHEMA)), "with-ids")
    found = labelled(scaled, cluster(scaled, [2])).collect()
    assert sorted((r["id"], r["value"]) for r in found) == [(i, f"v{i % 3}") for i in range(40)]


def test_other_gamma(scaled):
    plain = {f.item: f.cost for f in cluster(scaled, [1])}
    heavy = {f.item: f.cost for f in cluster(scaled, [1], gamma=2.0)}
    assert all(heavy[i] > plain[i] for i in plain)


def test_ties_go_to_the_lower_cluster(spark):
    rows = spark.createDataFrame([("a", "x", 0.0, 0.0, 0.0)], SCHEMA)
    at = [("x", [1.0, 0.0, 0.0]), ("x", [-1.0, 0.0, 0.0])]
    row = kp.assign(rows, [kp.Fit("a", 2, 0, 0.5, at)]).first()
    assert (row["cluster"], row["distance"]) == (0, 1.0)
