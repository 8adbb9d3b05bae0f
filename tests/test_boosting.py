import numpy as np
import pytest
from pyspark.sql import functions as F

from txlens.operators import boosting as B
from txlens.operators import metrics as M


@pytest.fixture(scope="module")
def rows(spark):
    """A label that hangs on a threshold, on a set of codes, and on a value being missing."""
    rng = np.random.default_rng(3)
    n = 6000
    a, noise, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 12, n)
    gone = rng.random(n) < 0.3
    logit = 2.0 * (a > 0.5) + 1.5 * np.isin(c, (1, 4, 9)) + 2.0 * gone - 3.0
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    v = 3 * a + np.where(c % 2 == 0, 5.0, -5.0) + rng.normal(size=n)
    split = np.where(np.arange(n) < 3600, "train", np.where(np.arange(n) < 4800, "val", "test"))
    data = [(int(i), float(x), float(z), float(k), None if m else 1.0, int(t), float(q), str(s)) for i, x, z, k, m, t, q, s in zip(range(n), a, noise, c, gone, y, v, split)]
    return spark.createDataFrame(data, "id long, a double, noise double, c double, known double, y int, v double, split string").repartition(8).cache()


FEATURES, KINDS = ["a", "noise", "c", "known"], {"c": "categorical"}


def ap(model, rows, part="test"):
    return M.classifier_summary(B.score(model, rows.where(F.col("split") == part), "p"), "y", "p").first()


def test_best_split_sends_missing_to_either_side():
    for side in (1, -1):
        sums = np.zeros((3, 256), np.int64)
        sums[:, 3] = [int(40 * B.UNIT), int(50 * B.UNIT), 50]
        sums[:, 7] = [int(-40 * B.UNIT), int(50 * B.UNIT), 50]
        sums[:, 255] = [int(side * 30 * B.UNIT), int(40 * B.UNIT), 40]
        gain, left, one, other = B.best_split(sums, False, 20)
        assert left[3] and not left[7] and left[255] == (side > 0)
        assert gain == pytest.approx(one[0] ** 2 / (one[1] + 1) + other[0] ** 2 / (other[1] + 1) - (side * 30) ** 2 / 141)
    assert B.best_split(sums, False, 60)[0] == 0


def test_best_split_of_categories_is_the_best_prefix_of_their_order():
    rng = np.random.default_rng(1)
    sums = np.zeros((3, 256), np.int64)
    sums[0, :9], sums[1, :9], sums[2, :9] = rng.normal(size=9) * 50 * B.UNIT, 60 * B.UNIT, 60
    gain, left, *_ = B.best_split(sums, True, 20)
    total = sums.sum(axis=1) / B.UNIT
    penalty = B.L2 + B.CATEGORY_SMOOTH
    best = 0
    for mask in range(1, 2**9 - 1):
        g, h, _ = sums[:, [i for i in range(9) if mask >> i & 1]].sum(axis=1) / B.UNIT
        best = max(best, g**2 / (h + penalty) + (total[0] - g) ** 2 / (total[1] - h + penalty) - total[0] ** 2 / (total[1] + penalty))
    assert gain == pytest.approx(best)


def test_classifier_learns_threshold_set_and_missing(spark, rows, tmp_path):
    m = B.fit(rows, FEATURES, "y", kinds=KINDS)
    got = ap(m, rows)
    assert got.roc_auc > 0.78 and got.pr_auc > 1.6 * got.base_rate
    assert B.ROUNDS > len(m.trees) >= B.PATIENCE and len(m.trees) - m.n_trees >= B.PATIENCE
    order = [f for f, _ in B.importance(m)]
    assert order[-1] == "noise" and sum(g for _, g in B.importance(m)) == pytest.approx(1)
    B.save(m, spark, str(tmp_path / "m"))
    again = B.load(spark, str(tmp_path / "m"), FEATURES)
    a = B.score(m, rows, "p").select("id", "p")
    assert a.join(B.score(again, rows, "q").select("id", "q"), "id").where("p != q").count() == 0
    with pytest.raises(ValueError):
        B.load(spark, str(tmp_path / "m"), FEATURES[::-1])


def test_an_interrupted_fit_goes_on_to_the_same_model(rows, tmp_path):
    short, whole = B.Settings(rounds=50), B.Settings(rounds=100)
    B.fit(rows, FEATURES, "y", kinds=KINDS, settings=short, folder=str(tmp_path / "a"))
    resumed = B.fit(rows, FEATURES, "y", kinds=KINDS, settings=whole, folder=str(tmp_path / "a"))
    direct = B.fit(rows.repartition(3), FEATURES, "y", kinds=KINDS, settings=whole, folder=str(tmp_path / "b"))
    assert len(resumed.trees) == 100 and resumed.to_json() == direct.to_json()


def test_regressor(rows):
    m = B.fit(rows, FEATURES, "v", task="regressor", kinds=KINDS, settings=B.Settings(rounds=300))
    s = B.score(m, rows.where("split = 'test'"), "p").agg(F.corr("p", "v").alias("r")).first()
    assert s.r > 0.95


def test_weights_count_like_repeated_rows(rows):
    few = rows.where("id % 3 = 0")
    s = B.Settings(rounds=50)
    repeated = few.where("y = 0").unionByName(few.where("y = 1")).unionByName(few.where("y = 1"))
    weighted = few.withColumn("w", F.when(F.col("y") == 1, 2.0))
    a, b = (B.fit(x, FEATURES, "y", weight=w, kinds=KINDS, settings=s) for x, w in ((repeated, None), (weighted, "w")))
    assert a.base == pytest.approx(b.base)
    assert ap(b, rows).roc_auc == pytest.approx(ap(a, rows).roc_auc, abs=0.03)


def test_nothing_to_learn(rows):
    m = B.fit(rows.where("split = 'none'"), FEATURES, "y", kinds=KINDS)
    assert all((t.feature < 0).all() for t in m.trees)
    assert B.score(m, rows.limit(5), "p").select("p").distinct().count() == 1
    one = B.fit(rows.withColumn("y", F.lit(1)), FEATURES, "y", kinds=KINDS)
    assert B.score(one, rows.limit(5), "p").agg(F.min("p")).first()[0] > 0.999
