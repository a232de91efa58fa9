"""Linear classifiers by their optimality conditions, the neighbour forest by brute force, the validation loop by hand."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strandloom.operators import cells, evaluate, forest, linear, vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.4 * rng.normal(size=400) + 0.3 > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(400)], "id long, v array<double>, label double")
    return x, 2 * y - 1, df.select("id", "label", array_to_vector("v").alias("features")).repartition(5)


def test_ridge_equals_numpy(data):
    x, y, df = data
    got = linear.Ridge(2.0).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(6), xc.T @ yc)
    assert np.abs(got.w - w).max() < 1e-9 and abs(got.b - (y.mean() - x.mean(0) @ w)) < 1e-9
    out = {r.id: r.prediction for r in got.transform(df).collect()}
    assert [out[i] for i in range(400)] == ((x @ w + got.b) > 0).astype(float).tolist()


@pytest.mark.parametrize("loss,l1", [("squared_hinge", 1.0), ("hinge", 1.0), ("hinge", 0.15), ("hinge", 0.0)])
def test_proximal_fits_are_optimal(data, loss, l1):
    x, y, df = data
    strength = 0.05
    got = linear.ProximalLinear(loss, strength, l1, max_iter=400, tol=1e-6).fit(df)
    slope = linear.LOSSES[loss][0](y * (x @ got.w + got.b))[1] * y
    g, gb = x.T @ slope / 400 + strength * (1 - l1) * got.w, slope.mean()
    assert abs(gb) < 1e-4
    zero = got.w == 0
    assert (np.abs(g[zero]) <= strength * l1 + 1e-4).all()
    assert np.abs(g[~zero] + strength * l1 * np.sign(got.w[~zero])).max() < 1e-4
    assert zero.any() or l1 < 1  # columns of noise go with a whole L1 term


def test_l1_models_differ_and_selection_feeds_the_second_fit(data):
    _, _, df = data
    a, b = (evaluate.classifier(n).fit(df) for n in ("svm_l1", "sgd_l1"))
    assert np.abs(a.w - b.w).max() > 1e-3
    first = linear.ProximalLinear("squared_hinge", 0.05, 1.0)
    both = linear.SelectThenFit(first, linear.ProximalLinear("squared_hinge", 0.01, 0.0)).fit(df)
    assert set(np.flatnonzero(both.w)) == set(np.flatnonzero(first.fit(df).w)) and len(both.w) == 6
    again = linear.SelectThenFit(linear.ProximalLinear(strength=99.0), linear.ProximalLinear(l1=0.0)).fit(df)
    assert set(np.flatnonzero(again.w)) <= {0}


def test_class_report(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (2, 3)]
    got = {r.label: (r.support, r.precision, r.recall, r.f1) for r in evaluate.class_report(spark.createDataFrame(rows, "label int, predicted int")).collect()}
    assert got[0] == (3, 1.0, pytest.approx(2 / 3), pytest.approx(0.8)) and got[1] == (1, pytest.approx(1 / 3), 1.0, 0.5)
    assert got[2] == (2, 0.0, 0.0, 0.0) and got[3] == (0, 0.0, 0.0, 0.0)


def test_forest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12)) + 2 * rng.normal(size=(30, 12))[rng.integers(30, size=1500)]
    x[200:700] = x[200]  # a third of the index are copies
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "id long, v array<double>")
    asked = rows.where("id % 20 = 0")
    built = forest.build(rows, trees=20, leaf=16)
    assert built.vectors.count() == 1001 and len(built.cuts) == 6
    sizes = built.leaves.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] <= 40 and sizes[1] == 20 * 1001
    found = forest.search(built, asked, 10)
    exact = vectors.nearest(rows, asked, 10)
    n, recall = forest.recall(found, exact).first()
    assert n == 750 and recall >= 0.9
    copies = [r.neighbour for r in found.where("query = 400").orderBy("rank").collect()]
    assert copies == list(range(200, 210))
    assert found.where("query = 0 and rank = 1").first().neighbour == 0
    assert forest.search(built, asked, 3, include_self=False).where("query = neighbour").isEmpty()


def test_forest_recall_without_structure(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE", 1000)  # cuts of a sample, all rows in leaves
    monkeypatch.setattr(cells, "PART", 16)  # leaves of several cells
    x = np.random.default_rng(6).normal(size=(3000, 64))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    built, asked = forest.build(rows, levels=4), rows.where("id % 60 = 0")
    assert len(built.cuts) == 4 and built.leaves.count() == 30 * 3000
    assert forest.recall(forest.search(built, asked, 10), vectors.nearest(rows, asked, 10)).first().recall >= 0.9


def test_forest_of_few_rows(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "id long, v array<double>")
    got = forest.search(forest.build(few), few.where("v is not null"), 5)
    assert sorted((r.query, r.neighbour, r.rank) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert forest.search(forest.build(few.limit(0)), few.where("id = 1"), 5).isEmpty()


@pytest.mark.parametrize("levels", [2, 3])
def test_forest_asked_for_all_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(cells, "PART", 64)  # several parts of either side; at three levels a cell is a leaf of one tree
    monkeypatch.setattr(cells, "QUERIES", 7)
    monkeypatch.setattr(cells, "ROWS", 16)
    x = np.random.default_rng(8).normal(size=(400, 6))
    x[100:220] = x[100]  # more copies than a cell holds
    x[300], x[301] = 0, 2 * x[302]
    rows = spark.createDataFrame([(i, x[i].tolist() if i != 9 else None) for i in range(400)], "id long, v array<double>").repartition(3)
    built = forest.build(rows, trees=4, levels=levels)
    found, others = (forest.search(built, rows, 5, include_self=own).collect() for own in (True, False))
    leaf = np.full((400, 4), -1)
    for r in built.leaves.join(built.members, "key").collect():
        leaf[r.id, r.tree] = r.node
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    s = np.round(u @ u.T, 6)
    s[300], s[:, 300] = 2, 2  # NaN first
    meets = (leaf[:, None] == leaf[None]).any(axis=2)
    meets[9], meets[:, 9] = False, False
    assert 0.2 < meets.mean() < 0.9
    for rows_of, left_out in ((found, False), (others, True)):
        got = {(r.query, r.rank): r.neighbour for r in rows_of}
        want = {}
        for q in range(400):
            near = [n for n in np.lexsort((np.arange(400), -s[q])) if meets[q, n] and not (left_out and n == q)]
            want |= {(q, r + 1): n for r, n in enumerate(near[:5])}
        assert got == want and len(rows_of) == len(want)


def test_nearest_in_cells_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART", 64)  # several cells of either side
    monkeypatch.setattr(cells, "ROWS", 32)
    monkeypatch.setattr(cells, "QUERIES", 7)
    x = np.random.default_rng(3).normal(size=(400, 6))
    x[100:180] = x[100]  # more copies than a cell holds
    x[7], x[40] = 0, -x[41]
    rows = spark.createDataFrame([(i, x[i].tolist() if i != 9 else None) for i in range(400)], "id long, v array<float>")
    found = vectors.nearest(rows, rows.where("id % 20 = 0"), 5)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    u = x.astype(np.float32).astype(float)
    u = u / np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
    s = np.round(u @ u.T, 6)
    s[:, 7], s[:, 9] = 2, -2  # NaN first, null last, as in SQL
    got = {(r.query, r.rank): r.neighbour for r in found.collect()}
    assert got == {(q, r + 1): n for q in range(0, 400, 20) for r, n in enumerate(np.lexsort((np.arange(400), -s[q]))[:5])}
    assert vectors.nearest(rows, rows.where("id = 120"), 100, include_self=False).where("neighbour = 120").isEmpty()


def test_lsh_meets_rows_in_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART", 50)  # buckets of more than one cell
    x = np.random.default_rng(4).normal(size=(300, 8))
    x[50:150] = x[50]
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id long, v array<double>")
    found = vectors.lsh_neighbours(rows, rows.where("id % 20 = 0"), 5)
    assert found._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = np.round(np.linalg.norm(u[:, None] - u[None], axis=2), 6)
    want = {(q, int(n)) for q in range(0, 300, 20) for n in np.lexsort((np.arange(300), d[q]))[:5]}
    got = {(r.query, r.neighbour): r.distance for r in found.collect()}
    assert len(set(got) & want) >= 0.9 * len(want)
    assert all(abs(d[pair] - distance) <= 1.1e-6 for pair, distance in got.items())
    assert [n for q, n in sorted(got) if q == 100] == list(range(50, 55))


def test_neighbour_labels(spark):
    sentences = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "sent long, token string")
    near = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0)], "query string, neighbour string, score double")
    counts = spark.createDataFrame([("a", "x", 3), ("b", "x", 1), ("b", "y", 2)], "token string, label string, n long")
    got = {(r.sent, r.label): r.n for r in evaluate.neighbour_labels(sentences, near, counts).collect()}
    assert got == {(1, "x"): 9, (1, "y"): 6, (2, "x"): 1, (2, "y"): 2}
    got = {(r.sent, r.label): r.n for r in evaluate.neighbour_labels(sentences, near, counts, weighted=True).collect()}
    assert got == {(1, "x"): 8.0, (1, "y"): 4.0, (2, "x"): 1.0, (2, "y"): 2.0}


def test_principal_components_equal_numpy(spark):
    x = np.random.default_rng(8).normal(size=(80, 5)) @ np.diag([5.0, 3.0, 2.0, 1.0, 0.5]) + 4
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(80)], "id long, v array<double>")
    got = np.zeros((80, 3))
    for r in vectors.principal_components(rows, "id", "v", 3).collect():
        got[r.id, r.dim] = r.value
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = (u * s)[:, :3]
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8


def test_bernoulli_bayes_equals_numpy(data):
    x, y, df = data
    out = {r.id: r.prediction for r in evaluate.classifier("bernoulli_nb").fit(df).transform(df).collect()}
    bits, scores = x > 0, []
    for c in (-1, 1):
        p = (bits[y == c].sum(0) + 0.01) / ((y == c).sum() + 0.02)
        scores.append(np.log((y == c).mean()) + bits @ np.log(p) + ~bits @ np.log(1 - p))
    assert [out[i] for i in range(400)] == (scores[1] > scores[0]).astype(float).tolist()


@pytest.mark.parametrize("name", ["forest", "svm", "svm_l1", "sgd_l2", "sgd_l1", "sgd_elastic", "ridge", "l1_pipeline"])
def test_classifiers_tell_classes_apart(data, name):
    x, y, df = data
    fitted = evaluate.classifier(name).fit(df.where("id < 300"))
    held = fitted.transform(df.where("id >= 300"))
    rule = int((np.sign(x[300:, 0] - 0.5 * x[300:, 1] + 0.3) == y[300:]).sum())  # what the labels, which are noisy, leave to learn
    assert rule < 100 and held.where("prediction = label").count() >= rule - 6
