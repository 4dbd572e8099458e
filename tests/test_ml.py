"""Learned operators: planted outliers, recovered seasonality, classifier quality."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from stratus.ml import isolation
from stratus.ml.additive import fit_additive
from stratus.ml.features import calendar_features, forecast_calendar
from stratus.ml.runs import metric_evolution, run_rows
from stratus.operators.sampling import concat_frames


def test_forecast_calendar_span(spark):
    cal = forecast_calendar(spark)
    assert cal.count() == 11323
    f = calendar_features(cal.limit(1), "date").first()
    assert (f.year, f.month, f.day_of_year, f.day_of_week) == (2003, 1, 1, 4)


def test_isolation_forest_flags_planted_outliers(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(3000)]
    rows += [(10_000 + i, 12.0 + i, -12.0, 15.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    nodes = isolation.grow_forest(df, ["a", "b", "c"], n_trees=100, seed=0).checkpoint()
    scored = isolation.isolation_forest(df, ["a", "b", "c"], nodes=nodes)
    out = {r.k: r for r in scored.collect()}
    assert len(out) == 3005
    assert all(out[10_000 + i].anomaly_score == -1 for i in range(5))
    normal = sum(1 for k, r in out.items() if k < 10_000 and r.anomaly_score == 1)
    assert normal > 2000
    # planted points score above 99.5 % of the ordinary ones
    base = sorted(r.score for k, r in out.items() if k < 10_000)
    assert min(out[10_000 + i].score for i in range(5)) > base[int(0.995 * len(base))]
    counts = {r.anomaly_score: r["count"] for r in isolation.anomaly_counts(df, ["a", "b", "c"], nodes).collect()}
    assert counts == {k: sum(r.anomaly_score == k for r in out.values()) for k in (1, -1)}


@pytest.mark.parametrize("seed", range(3))
def test_tree_samples_stay_bounded_when_a_third_of_the_rows_are_equal(spark, seed):
    df = spark.range(60_000).select(F.when(F.col("id") < 20_000, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("a"))
    sizes = [r["count"] for r in isolation.tree_sample(df, 60_000, 100, 256, seed).groupBy("tree_id").count().collect()]
    assert len(sizes) == 100 and max(sizes) < 2 * 256 and 25_600 * 0.9 < sum(sizes) < 25_600 * 1.1
    small = df.filter("a > 1").limit(150)
    again = [r["count"] for r in isolation.tree_sample(small, 150, 100, 150, seed).groupBy("tree_id").count().collect()]
    assert again == [150] * 100


def test_isolation_null_features_not_dropped(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 1.5)], "k long, a double")
    out = {r.k: r.anomaly_score for r in isolation.isolation_forest(df, ["a"], n_trees=10).collect()}
    assert len(out) == 4 and out[2] is None
    nodes = isolation.grow_forest(df, ["a"], n_trees=10).checkpoint()
    counts = {r.anomaly_score: r["count"] for r in isolation.anomaly_counts(df, ["a"], nodes).collect()}
    assert counts[None] == 1 and sum(counts.values()) == 4
    none = isolation.isolation_forest(df.filter("a is null"), ["a"]).collect()
    assert [tuple(r) for r in none] == [(2, None, None, None)]
    clash = df.withColumns({"x": F.lit(7), "n": F.lit("n"), "row": F.lit("r"), "of": F.lit(1)})
    assert [r[2:6] for r in isolation.isolation_forest(clash, ["a"], nodes=nodes).collect()] == [(7, "n", "r", 1)] * 4


def test_additive_recovers_trend_and_season(spark):
    import random

    rnd = random.Random(7)
    start = dt.date(2000, 1, 1)
    rows = []
    for i in range(1500):
        d = start + dt.timedelta(days=i)
        rain = 1.0 if i % 5 == 0 else 0.0
        y = 10 + 0.01 * i + 5 * math.sin(2 * math.pi * (d - dt.date(1970, 1, 1)).days / 365.25) + 3 * rain
        y += rnd.gauss(0, 1)
        rows.append((d, y, rain))
    df = spark.createDataFrame(rows, "ds date, y double, Rain double")
    train = df.filter(F.col("ds") < F.lit("2003-06-01").cast("date"))
    test = df.filter(F.col("ds") >= F.lit("2003-06-01").cast("date"))
    score, info = fit_additive(train, "ds", "y", ["Rain"])
    pred = score(test)
    err = pred.select(F.avg(F.abs(F.col("yhat") - F.col("y")))).first()[0]
    assert err < 1.2 and 0.8 < info["sigma"] < 1.2
    inside = pred.filter((F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper"))).count()
    assert inside / pred.count() > 0.6


def _series(spark, seed, days, slope, change=None):
    import random

    rnd = random.Random(seed)
    rows = []
    for i in range(days):
        d = dt.date(2000, 1, 1) + dt.timedelta(days=i)
        bend = 0.03 * max(0, i - change) if change else 0.0
        rows.append((d, 10 + slope * i + bend + 5 * math.sin(2 * math.pi * (d - dt.date(1970, 1, 1)).days / 365.25) + rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "ds date, y double")


def test_additive_interval_covers_and_widens(spark):
    inside = total = 0
    for seed in (1, 2, 3):
        df = _series(spark, seed, 2600, 0.004)
        score, info = fit_additive(df.filter("ds < '2006-06-01'"), "ds", "y", [])
        out = score(df.filter("ds >= '2006-06-01'")).collect()
        inside += sum(r.yhat_lower <= r.y <= r.yhat_upper for r in out)
        total += len(out)
    assert 0.75 <= inside / total <= 0.85
    df = _series(spark, 4, 2343, 0.004, change=900)  # its trend has changed, so it may change again
    score, info = fit_additive(df, "ds", "y", [])
    future = score(forecast_calendar(spark, "2004-01-01", "2016-01-01").select(F.col("date").alias("ds"))).orderBy("ds").collect()
    width = [r.yhat_upper - r.yhat_lower for r in future]
    past = [w for r, w in zip(future, width) if r.ds < dt.date(2006, 6, 1)]
    assert max(past) - min(past) < 1e-9 and abs(past[0] / info["sigma"] / 2 - 1.2816) < 1e-3
    ahead = width[len(past) :]
    assert all(b >= a - 1e-9 for a, b in zip(ahead[::365], ahead[365::365])) and ahead[-1] > 2 * past[0]
    assert [tuple(r) for r in score(df.limit(0)).collect()] == []


def test_additive_trend_is_sparse(spark):
    """A straight series has no slope change, one bend few of them beside its place."""
    straight = fit_additive(_series(spark, 4, 1800, 0.01), "ds", "y", [])[1]["changes"]
    bent = fit_additive(_series(spark, 4, 1800, 0.01, change=700), "ds", "y", [])[1]["changes"]
    assert sum(abs(c) > 0 for c in straight) <= 5
    assert sum(abs(c) > 0 for c in bent) <= 12
    place = [0.8 * j / 26 for j in range(1, 26)]
    assert abs(sum(p * c for p, c in zip(place, bent)) / sum(bent) - 700 / 1799) < 0.06


def test_rain_classifier_separable(spark):
    from stratus.ml import models as MD

    rows = []
    for i in range(1200):
        d = dt.date(2000, 1, 1) + dt.timedelta(days=i)
        wet = d.month in (11, 12, 1, 2)
        rows.append((str(i % 7), d, 10.0, 5.0, 4.0 if wet else 0.0))
    obs = spark.createDataFrame(rows, "ClimateID string, Datetime date, MaxTempC double, MinTempC double, TotalPrecipmm double")
    fitted = MD.fit_rain_classifier(MD.training_frame(obs))
    assert fitted.metrics["AUC"] > 0.9


def test_runs_pivot_and_index(spark):
    runs = concat_frames(
        [
            run_rows(spark, "MaxTempC", {"numTrees": 10}, {"RMSE": 1.0, "R2": 0.5, "MAE": 0.8}, run_id="r1"),
            run_rows(spark, "MaxTempC", {}, {"RMSE": 2.0, "MAE": 1.0}, run_id="r2"),
            run_rows(spark, "MinTempC", {}, {"RMSE": 3.0, "R2": 0.1, "MAE": 2.0}, run_id="r3"),
        ]
    )
    ev = {r.run_id: r for r in metric_evolution(runs).collect()}
    assert set(ev) == {"r1", "r3"}  # r2 has no R2
    assert ev["r1"]["index"] == 1 and ev["r3"]["index"] == 1
    assert ev["r1"].RMSE == pytest.approx(1.0)


def test_save_best_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from stratus.ml import models as MD
    from stratus.ml.runs import save_model

    rows = [(str(i % 3), dt.date(2000, 1, 1) + dt.timedelta(days=i), 10.0, 5.0, float(i % 2)) for i in range(300)]
    obs = spark.createDataFrame(rows, "ClimateID string, Datetime date, MaxTempC double, MinTempC double, TotalPrecipmm double")
    fitted = MD.fit_rain_classifier(MD.training_frame(obs))
    path = save_model(fitted.model, str(tmp_path / "rain"))
    again = PipelineModel.load(path)
    assert again.transform(MD.training_frame(obs)).count() > 0


def test_vectorised_paths_equal_per_row_walk():
    """The all-trees-at-once traversal equals walking each tree for each row."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    rows = []
    for t in range(7):
        sub = x[rng.choice(300, 64, replace=False)]
        for node in isolation._grow(sub, np.random.default_rng(t), 6):
            rows.append((t, *node))
    nodes = pd.DataFrame(rows, columns=["tree_id", "node", "feature", "threshold", "left", "right", "size"])
    forest = isolation._pack(nodes)
    got = isolation.mean_path_length(x[:50], forest)

    def walk(row, t):
        tree = nodes[nodes.tree_id == t].set_index("node")
        n, depth = 0, 0
        while tree.loc[n, "feature"] >= 0:
            f, thr = tree.loc[n, "feature"], tree.loc[n, "threshold"]
            n = tree.loc[n, "left"] if row[f] < thr else tree.loc[n, "right"]
            depth += 1
        return depth + isolation.c_factor(tree.loc[n, "size"])

    want = [np.mean([walk(r, t) for t in range(7)]) for r in x[:50]]
    assert np.allclose(got, want)


def _observations(spark):
    import random

    rnd = random.Random(6)
    rows = []
    for i in range(1500):
        day = dt.date(2001, 1, 1) + dt.timedelta(days=rnd.randrange(500))
        rows.append((str(rnd.randrange(9)), day, 10 + 8 * math.sin(day.timetuple().tm_yday / 58) + rnd.gauss(0, 1), rnd.choice((0.0, 0.0, 1.5, 4.0)), rnd.uniform(-5, 5)))
    return spark.createDataFrame(rows + [rows[0]] * 30 + [("1", None, 3.0, 1.0, 1.0), ("2", rows[1][1], None, 1.0, 1.0)], "ClimateID string, Datetime date, MaxTempC double, TotalPrecipmm double, MinTempC double")


def test_folded_errors_equal_errors_of_the_rows(spark):
    from stratus.ml import models as MD

    frame = MD._folds(MD.training_frame(_observations(spark)))
    guess = F.round(F.col("day_of_year") / 20) + F.col("month")
    cells = MD.fold_rows(frame, "MaxTempC", ["fold", *MD.BASE_FEATURES]).withColumn("prediction", guess)
    got = MD.folded_errors(cells)
    want = MD.quality(frame.withColumn("prediction", guess.cast("double")), "MaxTempC")
    assert got["n"] == want["n"] and math.isclose(got["RMSE"], want["RMSE"], rel_tol=1e-9) and math.isclose(got["R2"], want["R2"], rel_tol=1e-9)
    assert MD.FoldedRmse().evaluate(cells) == got["RMSE"] and not MD.FoldedRmse().isLargerBetter()
    assert cells.count() < frame.count() and MD.folded_errors(cells.limit(0))["n"] == 0


def test_precipitation_is_fitted_on_cells_that_do_not_grow_with_the_rows(spark, monkeypatch):
    from stratus.ml import models as MD

    seen = []
    fit = MD._cv_regressor
    monkeypatch.setattr(MD, "_cv_regressor", lambda train, *a, **k: seen.append((train.count(), train.agg(F.sum("weight")).first()[0])) or fit(train, *a, **k))
    monkeypatch.setattr(MD, "NUM_TREES", [3])
    monkeypatch.setattr(MD, "MAX_DEPTH", [3])
    monkeypatch.setattr(MD, "BINS", 4)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 360, 3)]
    one = spark.createDataFrame([(d,) for d in days], "Datetime date").crossJoin(spark.range(40).withColumnRenamed("id", "k"))
    temp = F.pmod(F.hash("Datetime", "k"), F.lit(1000)) / 25.0  # hardly two rows share both temperatures
    obs = one.select(F.col("k").cast("string").alias("ClimateID"), "Datetime", temp.alias("MaxTempC"), (temp - F.pmod(F.hash("k", "Datetime", F.lit(1)), F.lit(97)) / 9.0).alias("MinTempC"), F.when(temp > 20, 8.0).otherwise(2.0).alias("TotalPrecipmm"))
    odd = spark.createDataFrame([("n", days[0], None, 1.0, 5.0), ("m", days[1], 1.0, float("nan"), 5.0), ("r", days[2], 1.0, 1.0, None)], "ClimateID string, Datetime date, MaxTempC double, MinTempC double, TotalPrecipmm double")
    frame = MD.training_frame(obs.unionByName(odd))
    rain = MD.fit_rain_classifier(MD.training_frame(obs.unionByName(obs.limit(500).withColumn("TotalPrecipmm", F.lit(0.0))))).model
    fitted = MD.fit_precipitation(frame, rain)
    (cells, rows), = seen
    assert cells <= 3 * 4**4 and 0.7 * 4800 < rows < 0.9 * 4800  # every whole training row, in folded cells
    scored = MD.score_as(fitted.model, frame, "p").collect()
    assert len(scored) == 4803 and {r.ClimateID for r in scored if r.p is None} == {"n", "m"}
    known = [r for r in scored if r.p is not None and r.ClimateID != "r"]
    low, high = [r.p for r in known if r.MaxTempC < 19], [r.p for r in known if r.MaxTempC > 21]
    assert max(low) < 5 < min(high) and set(scored[0].asDict()) == {*frame.columns, "p"}
    assert fitted.params["maxDepth"] == 3 and fitted.metrics["n"] is not None


def test_bins_are_values_or_shares(spark):
    from stratus.ml import models as MD

    df = spark.range(10_000).select((F.col("id") % 5).alias("few"), F.col("id").cast("double").alias("many"), F.lit(7).alias("one"), F.lit(None).cast("double").alias("none"))
    few, many, one, none = MD.bin_edges(df, df.columns)
    assert few == [1.0, 2.0, 3.0, 4.0] and one == none == [] and len(many) == MD.BINS - 1
    sizes = MD.binned([few, many, one, none], df.columns).transform(df)
    assert {r["count"] for r in sizes.groupBy("bin_few").count().collect()} == {2000}
    assert all(250 < r["count"] < 380 for r in sizes.groupBy("bin_many").count().collect())


def test_stored_models_are_scored_without_fitting(spark, tmp_path):
    from stratus.ml import models as MD
    from stratus.ml.runs import fitted_once, load_fitted

    frame = MD.training_frame(_observations(spark))
    path = str(tmp_path / "models" / "MaxTempC")
    first = fitted_once(spark, path, lambda: MD.fit_temperature(frame, "MaxTempC"))
    assert set(first.metrics) == {"RMSE", "R2", "MAE", "n"} and first.metrics["R2"] > 0.8 and set(first.params) == {"numTrees", "maxDepth"}

    def refuse():
        raise AssertionError("fitted again")

    again = fitted_once(spark.newSession(), path, refuse)
    assert again.metrics == first.metrics and again.params == first.params
    got = [r[0] for r in MD.score_as(again.model, frame, "p").orderBy("ClimateID", "date", "MinTempC").select("p").collect()]
    assert got == [r[0] for r in MD.score_as(first.model, frame, "p").orderBy("ClimateID", "date", "MinTempC").select("p").collect()]
    # a failed maker leaves nothing under the name
    with pytest.raises(ZeroDivisionError):
        fitted_once(spark, path + "-x", lambda: 1 / 0)
    assert not (tmp_path / "models" / "MaxTempC-x").exists()
    rain = fitted_once(spark, str(tmp_path / "rain"), lambda: MD.fit_rain_classifier(frame))
    held = load_fitted(spark, str(tmp_path / "rain")).held_out
    assert held.filter("prediction is null").count() == 0 and held.count() > 100 and 0 <= rain.metrics["AUC"] <= 1


def test_additive_fit_equals_least_squares(spark):
    """Without regularisation the Spark fit equals numpy least squares on the same design."""
    import numpy as np
    from pyspark.sql import functions as F

    from stratus.ml.additive import design, fit_additive

    rows = [(dt.date(2001, 1, 1) + dt.timedelta(days=i), float((i * 37) % 23) + 0.1 * i) for i in range(400)]
    df = spark.createDataFrame(rows, "ds date, y double")
    score, info = fit_additive(df, "ds", "y", [], reg_param=0.0)
    pred = np.array([r.yhat for r in score(df).orderBy("ds").collect()])
    x, names = design(df, "ds", F.lit(info["t0"]), F.lit(info["t1"]), [])
    pdf = x.orderBy("ds").select(*names, "y").toPandas()
    assert score(spark.createDataFrame([(None,)], "ds date")).first()["yhat_upper"] is None
    a = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy()])
    coef, *_ = np.linalg.lstsq(a, pdf["y"].to_numpy(), rcond=None)
    assert np.allclose(pred, a @ coef, atol=1e-4)


def test_stored_rows_carry_the_split_of_all_models(spark, tmp_path):
    from stratus.ml import models as MD

    frame = MD.training_frame(_observations(spark))
    MD.split_rows(frame).write.parquet(str(tmp_path / "rows"))
    stored = MD.stored_frame(spark.read.parquet(str(tmp_path / "rows")))
    assert MD._split(stored) is stored  # hashed once, by the writer
    assert "md5" not in MD._split(stored).filter("split = 'test'")._jdf.queryExecution().optimizedPlan().toString()
    want = MD._split(frame)
    assert sorted(map(str, stored.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_fits_of_all_folds_run_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from stratus.ml import models as MD

    cells = MD.fold_rows(MD._split(MD.training_frame(_observations(spark))), "MaxTempC", ["fold", *MD.BASE_FEATURES]).checkpoint()
    monkeypatch.setattr(MD, "NUM_TREES", [2])
    monkeypatch.setattr(MD, "MAX_DEPTH", [1, 4])
    rf = RandomForestRegressor(labelCol="label", featuresCol="features", seed=MD.SEED, weightCol="weight", numTrees=2)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, [1, 4]).build()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=MD.FoldedRmse(), numFolds=MD.FOLDS, foldCol="fold")
    data = MD._assembler(MD.BASE_FEATURES).transform(cells)
    want = cv.fit(data).bestModel
    all_at_once = threading.Barrier(2 * MD.FOLDS, timeout=120)

    class Meeting(MD.FoldedRmse):
        def _evaluate(self, dataset):
            all_at_once.wait()
            return super()._evaluate(dataset)

    monkeypatch.setattr(MD, "FoldedRmse", Meeting)
    model, params = MD._cv_regressor(cells, "label", MD.BASE_FEATURES, weight="weight")
    assert params == {"numTrees": 2, "maxDepth": want.getOrDefault("maxDepth")}
    assert [r.prediction for r in model.transform(cells).orderBy("fold", *MD.BASE_FEATURES).collect()] == [r.prediction for r in want.transform(data).orderBy("fold", *MD.BASE_FEATURES).collect()]
    with pytest.raises(ValueError, match="fold"):
        MD._cv_regressor(cells.filter("fold > 0"), "label", MD.BASE_FEATURES, weight="weight")
