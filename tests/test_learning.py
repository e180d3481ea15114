import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.trees import Forest
from plumbline.operators import learning
from plumbline.operators.dispatch import Hypothesis, TestRegistry, default_registry
from plumbline.plans import learning as plans

RNG = np.random.default_rng(42)


@pytest.fixture(scope="module")
def frame(spark):
    n = 400
    f1, f2 = RNG.normal(0, 1, n), RNG.normal(0, 1, n)
    kinds = RNG.choice(["a", "b"], n)
    y = 3 * f1 + (kinds == "a") * 2 + RNG.normal(0, 0.3, n)
    rows = [(float(a), float(b), str(k), float(v), "hi" if v > 1 else "lo") for a, b, k, v in zip(f1, f2, kinds, y, strict=True)]
    rows += [(None, 0.5, "a", 1.0, "lo"), (0.1, 0.1, "b", None, None)]
    return spark.createDataFrame(rows, "f1 double, f2 double, kind string, target double, label string")


@pytest.fixture(scope="module")
def fitted(frame):
    data = learning.prepare(frame, "target", drop=["label"])
    return data, learning.fit(data, max_iter=15, max_depth=3)


def test_rows_without_target_are_dropped(fitted):
    data, _ = fitted
    assert data.count == 401 and data.features == ["f1", "f2", "kind"]


def test_fit_finds_the_signal(fitted):
    data, model = fitted
    assert learning.train_score(data, model) > 0.9
    shares = [r.feature for r in learning.tree_importance(data, model).orderBy("rank").collect()]
    assert shares[0] == "f1"


def test_permutation_importance_orders_features(fitted):
    data, model = fitted
    found = {r.feature: r for r in learning.permutation_importance(data, model, repeats=2).collect()}
    assert found["f1"].importance > found["kind"].importance > abs(found["f2"].importance)
    assert all(r.repeats == 2 for r in found.values())


def test_values_change_places_over_all_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.createDataFrame([(float(i), None if i % 7 == 0 else f"k{i}", i / 500) for i in range(500)], "f double, k string, _u double").repartition(9)
    for seed in (1, 2):
        found = learning._with_other(rows, ["f", "k"], seed).select("f", F.col("_other.f").alias("g"), F.col("_other.k").alias("k")).collect()
        assert sorted(r.g for r in found) == sorted(r.f for r in found) == [float(i) for i in range(500)]
        assert all(r.k == (None if r.g % 7 == 0 else f"k{int(r.g)}") for r in found)
        assert sum(r.f == r.g for r in found) < 5
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def models(spark):
    """Numbers with gaps, more than 32 leaves, categories; two and three classes; a model without a split."""
    own = np.random.default_rng(3)
    rows = []
    for i in range(1_500):
        x, z, k, v = own.normal(), own.integers(0, 40), own.choice(list("abcdef")), own.normal()
        y = 2 * x + (z % 7) + (k in "ace") * 3 + own.normal(0, 0.5)
        rows.append((None if i % 9 == 0 else float(x), float(z), str(k), None if i % 13 == 0 else float(v), float(y), "hi" if y > 4 else "lo", "abc"[int(y > 3) + int(y > 6)], 1.0))
    frame = spark.createDataFrame(rows, "x double, z double, k string, v double, y double, two string, three string, same double")
    targets = {"y": ("regression", 7), "two": ("classification", 4), "three": ("classification", 3), "same": ("regression", 3)}
    found = []
    for target, (task, depth) in targets.items():
        data = learning.prepare(frame, target, task, [t for t in targets if t != target])
        found.append((data, learning.fit(data, max_iter=4, max_depth=depth)))
    return found


def test_trees_on_codes_predict_as_spark(models):
    for data, model in models:
        forest = learning._forest(data, model.stages[-1])
        rows = model.transform(data.rows).select(*learning._slots(data), "prediction").toPandas().to_numpy(float)
        packed = forest.pack(forest.codes(list(rows[:, :-1].T)))
        assert packed.shape == (1_500, forest.width) and forest.width <= 6
        assert forest.predict(forest.unpack(packed)) == pytest.approx(rows[:, -1], rel=1e-12)
        forest.room = forest.room and 2**62  # as for more features: equal rows are found by a sort
        assert forest.predict(forest.unpack(packed)) == pytest.approx(rows[:, -1], rel=1e-12)


def test_many_features_share_several_words():
    own = np.random.default_rng(5)
    tests = [f"  Tree {i} (weight 0.5):\n If (feature {s} <= {c / 7})\n Predict: {i}\n Else (feature {s} > {c / 7})\n Predict: -1.5E-3" for i, (s, c) in enumerate((s, c) for s in range(40) for c in range(9))]
    forest = Forest(["\n".join(tests)], 40, True)
    values = list(own.uniform(-0.1, 1.3, (40, 300)))
    assert len(forest.words) > 1 and forest.room == 0
    whole = sum(0.5 * np.where(values[s] <= c / 7, i, -1.5e-3) for i, (s, c) in enumerate((s, c) for s in range(40) for c in range(9)))
    assert forest.predict(forest.unpack(forest.pack(forest.codes(values)))) == pytest.approx(whole, rel=1e-12)


def test_codes_change_places_as_whole_rows_do(spark, models, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK_ROWS", 70)
    monkeypatch.setattr(learning, "SENT_ROWS", 1)
    for data, model in models:
        found = {r.feature: r for r in learning.permutation_importance(data, model, repeats=2).collect()}
        label = model.stages[-1].getOrDefault("labelCol")

        def score(rows, model=model, label=label, data=data):
            y, yhat = model.transform(rows).select(label, "prediction").toPandas().to_numpy(float).T
            return 1 - ((y - yhat) ** 2).sum() / ((y - y.mean()) ** 2).sum() if data.task == "regression" else (y == yhat).mean()

        if data.target == "same":  # nothing to explain, no share of it
            assert [(r.importance, r.importance_std, r.repeats) for r in found.values()] == [(None, None, 2)] * 4
            continue
        swapped = [learning._with_other(data.rows, data.features, 42, repeat).cache() for repeat in range(2)]
        for feature in data.features:
            drops = [score(data.rows) - score(rows.withColumn(feature, F.col(f"_other.{feature}"))) for rows in swapped]
            assert (found[feature].importance, found[feature].importance_std) == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)


def test_blocks_end_among_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK_ROWS", 100)
    monkeypatch.setattr(learning, "SENT_ROWS", 1)
    data = learning.prepare(spark.range(2_000).selectExpr("if(id < 1900, 0D, double(id)) as x", "if(id < 1900, 1D, double(id)) as y"), "y")
    model = learning.fit(data, max_iter=1, max_depth=2)
    prepared, learner = learning.PipelineModel(model.stages[:-1]), model.stages[-1]
    _, sizes = learning._blocks(data, prepared, "y", learning._forest(data, learner), 42)
    assert sum(sizes.values()) == 2_000 and len(sizes) >= 15 and max(sizes.values()) < 400


def test_permutations_need_little_disk(spark):
    n = 20_000
    rows = spark.range(n).selectExpr(*[f"rand({i}) as x{i}" for i in range(4)]).selectExpr("*", "x0 + x1 * x2 as y")
    data = learning.prepare(rows, "y")
    model = learning.fit(data, max_iter=2, max_depth=3)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()))

    before = held()
    assert len(learning.permutation_importance(data, model).collect()) == 4
    assert held() - before < 150 * n  # whole rows, joined and grouped in every repeat, took 1,030 bytes a row here


def test_cross_validation(frame):
    row = learning.cv_score(learning.prepare(frame, "label", "classification", drop=["target"]), max_iter=3, max_depth=3).first()
    assert (row.metric, row.folds) == ("accuracy", 5) and row.cv_mean > 0.8 and row.cv_std >= 0


def test_many_classes_are_boosted(frame):
    rows = frame.withColumn("grade", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("target"))).drop("label")
    data = learning.prepare(rows, "grade", "classification", drop=["target"])
    model = learning.fit(data, max_iter=5, max_depth=4)
    assert [type(m).__name__ for m in model.stages[-1].models] == ["GBTClassificationModel"] * 3
    assert learning.train_score(data, model) > 0.7
    shares = learning.tree_importance(data, model).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1.0) and {r.feature for r in shares} == set(data.features)


def test_missing_values_are_told_apart(spark):
    rows = [(None if i % 3 == 0 else float(i % 10), float("nan") if i % 5 == 0 else 1.0, 5.0 if i % 3 == 0 else float(i % 10) / 10) for i in range(600)]
    data = learning.prepare(spark.createDataFrame(rows, "x double, z double, y double"), "y")
    assert data.gaps == ["x", "z"]
    model = learning.fit(data, max_iter=5, max_depth=3)
    assert learning.train_score(data, model) > 0.95  # a median alone would mix both kinds of rows
    shares = {r.feature: r.importance for r in learning.tree_importance(data, model).collect()}
    assert shares["x"] > 0.95 and sum(shares.values()) == pytest.approx(1.0)
    found = {r.feature: r.importance for r in learning.permutation_importance(data, model, repeats=1).collect()}
    assert found["x"] > 0.5 > abs(found["z"])


def test_equal_rows_are_learned_as_one(spark):
    own = np.random.default_rng(7)
    xs, ks = own.choice(5, 700, p=[0.1, 0.2, 0.3, 0.15, 0.25]), own.choice(2, 700, p=[0.3, 0.7])
    ys = 10 + 1.7 * xs**2 + 2.3 * ks + own.integers(0, 7, 700) / 10  # no two splits are equally good
    rows = [(float(x), "ab"[k], float(y), "hi" if y > 20 or i % 11 == 0 else "lo") for i, (x, k, y) in enumerate(zip(xs, ks, ys, strict=True))]
    frame = spark.createDataFrame(rows, "x double, k string, y double, label string")
    for target, task, drop in (("y", "regression", "label"), ("label", "classification", "y")):
        data = learning.prepare(frame, target, task, [drop])
        cells = learning._cells(data.rows, data)
        assert cells.count() <= 20 and cells.agg(F.sum("_weight")).first()[0] == 700
        on_cells = learning.fit(data, max_iter=4, max_depth=3)
        score = learning.train_score(data, on_cells)
        predicted = on_cells.transform(data.rows).select(on_cells.stages[-1].getOrDefault("labelCol"), "prediction").toPandas().to_numpy(float)
        y, yhat = predicted.T
        plain = 1 - ((y - yhat) ** 2).mean() / y.var() if task == "regression" else (y == yhat).mean()
        assert score == pytest.approx(plain, rel=1e-9)
        stages, _ = learning._stages(data, 4, 3)
        on_rows = learning.Pipeline(stages=stages).fit(data.rows)
        whole = [r.prediction for m in (on_rows, on_cells) for r in m.transform(data.rows).orderBy("_u").select("prediction").collect()]
        assert whole[:700] == pytest.approx(whole[700:], rel=1e-9)


def test_rows_are_not_gathered_in_as_many_tasks_as_cores(spark):
    many = spark.range(0, 3_000, 1, 40).selectExpr("double(id % 50) as x", "double(id) as y")
    assert len(learning.prepare(many, "y").rows.inputFiles()) == 40


def test_queries_fit_all_rounds(spark, tmp_path, monkeypatch):
    rows = [(float(i % 7), i % 3 / 100, i % 4 / 100, i % 5, "NR"[i % 2], "FO"[i % 2], float(i)) for i in range(60)]
    names = "l_quantity double, l_discount double, l_tax double, l_linenumber int, l_returnflag string, l_linestatus string, l_extendedprice double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    monkeypatch.setattr(learning, "_stages", lambda data, *trees, whole=learning._stages: asked.append(trees) or whole(data, 1, 1))
    plans._trained(plans._prices, spark, tmp_path, "l_extendedprice", "regression")
    plans.cv_score(spark, tmp_path)
    assert asked == [(100, 5), (100, 5)]  # here recorded, then cut short


def test_training_errors(spark, frame):
    with pytest.raises(learning.TrainingError, match="no column"):
        learning.prepare(frame, "absent")
    with pytest.raises(learning.TrainingError, match="fewer than"):
        learning.prepare(frame.limit(10), "target")
    wide = spark.range(1000).selectExpr("cast(id as string) as name", "cast(id as double) as y")
    data = learning.prepare(wide, "y")
    assert data.rows.select("name").distinct().count() <= learning.MAX_CATEGORIES and data.count == 1000
    assert learning.fit(data, max_iter=2).transform(data.rows).count() == 1000


def test_leakage(spark, frame):
    screened = {r.feature: r.leaks for r in learning.leakage_screen(frame.withColumn("copy", F.col("target") * 2), "target").collect()}
    assert screened == {"f1": False, "f2": False, "copy": True}
    importance = spark.createDataFrame([("y", 0.1), ("x", 0.97), ("z", 0.2)], "feature string, importance double")
    found = {r.feature: r.reason for r in learning.leaking_features(importance, "y").collect()}
    assert found == {"y": "target among features", "x": "dominant importance"}


def test_dispatch_never_stops(spark):
    x = np.arange(60.0)
    rows = [(float(a), float(2 * a + RNG.normal()), float(RNG.normal()), float(i % 5)) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    questions = [
        Hypothesis("h1", "association", "x", "y"), Hypothesis("h2", "association", "x", "z"),
        Hypothesis("h3", "controlled_association", "x", "y", ("z",)), Hypothesis("h4", "controlled_association", "x", "y", ("z", "w")),
        Hypothesis("h5", "before_after", "x", "y"), Hypothesis("h6", "oracle", "x", "y"), Hypothesis("h7", "association", "x", "nope"),
        Hypothesis("h8", "broken", "x", "y"), Hypothesis("h9", "timeseries", "x"),
    ]
    registry = default_registry()

    def broken(df, hypotheses):
        raise ValueError("boom")

    registry.register("broken", broken)
    found = {r.hypothesis_id: r for r in registry.run(df, questions).collect()}
    assert {k: r.status for k, r in found.items()} == {
        "h1": "ok", "h2": "ok", "h3": "ok", "h4": "ok", "h5": "ok", "h6": "error", "h7": "error", "h8": "error", "h9": "error",
    }
    assert found["h1"].result["pearson_r"] > 0.9 and found["h1"].result["spearman_r"] > 0.9
    assert found["h6"].error == "no test named oracle" and found["h8"].error == "boom"
    nothing = df.withColumn("x", F.lit(None).cast("double"))
    assert [(r.status, r.error) for r in registry.run(nothing, questions[:1]).collect()] == [("error", "No usable rows")]
    assert found["h5"].result["mean_b"] > found["h5"].result["mean_a"]
    assert TestRegistry().run(df, questions[:1]).first().status == "error"
