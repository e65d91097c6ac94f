"""Tail probabilities, joint boosting, attribution and samples."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import tails
from panelforge.operators import attribution, boosting, forecast, metrics, profile, ranking, sampling


def integrated(f, between, within):
    """P(F >= f) by Simpson's rule over the angle whose squared sine is the beta variable."""
    a, b = within / 2, between / 2
    if f == 0:
        return 1.0
    top = math.atan(math.sqrt(within / (between * f)))
    u = np.linspace(max(1e-12, top - 60 / math.sqrt(2 * a)), top, 100_001)
    y = np.exp((2 * a - 1) * np.log(np.sin(u)) + (2 * b - 1) * np.log(np.maximum(np.cos(u), 1e-300)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + math.log(2))
    w = np.ones(len(u))
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((y * w).sum() * (u[1] - u[0]) / 3)


def test_tails(spark):
    rows = [(f, a, b) for f in (0.0, 0.3, 1.0, 3.0, 10.0) for a in (1, 2, 5, 30) for b in (1, 4, 20, 600, 59_000)]
    df = spark.createDataFrame(rows, "f double, a int, b int").repartition(4)
    for r in df.select("*", tails.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p"), tails.t_tail(-F.sqrt("f"), F.col("b")).alias("t")).collect():
        assert r["p"] == pytest.approx(integrated(r["f"], r["a"], r["b"]), rel=1e-6, abs=1e-9)
        assert r["t"] == pytest.approx(integrated(r["f"], 1, r["b"]), rel=1e-6, abs=1e-9)
    large = spark.range(1).select(tails.t_tail(F.lit(1.959963984540054), F.lit(1e9)).alias("p"), tails.log_gamma(F.lit(0.5)).alias("g"), tails.log_gamma(F.lit(1e6)).alias("h")).first()
    assert large["p"] == pytest.approx(0.05, abs=1e-7) and large["g"] == pytest.approx(math.lgamma(0.5)) and large["h"] == pytest.approx(math.lgamma(1e6))
    none = spark.range(1).select(tails.f_tail(F.lit(None).cast("double"), F.lit(1), F.lit(2)).alias("a"), tails.t_tail(F.lit(1.0), F.lit(0)).alias("b")).first()
    assert tuple(none) == (None, None)


def test_p_values_in_scores(spark):
    rng = random.Random(4)
    rows = [(i % 3, float(i % 3) + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, x double, noise double")
    p = {r["feature"]: r for r in ranking.anova_f(df, "y", ["x", "noise"]).collect()}
    assert p["x"]["p_value"] < 1e-6 < 0.01 < p["noise"]["p_value"] and p["x"]["p_value"] == pytest.approx(integrated(p["x"]["anova_f"], 2, 297), rel=1e-5, abs=1e-12)
    few = spark.createDataFrame([(1.0, 0.0), (2.0, 0.5), (2.5, 1.9)], "a double, b double")
    r = metrics.paired_t(few, "a", "b").first()
    assert r["t"] > 1.96 and r["p_value"] > 0.05  # three pairs say less than the normal limit would have it


def test_macro_and_coverage(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "y int, p int")
    classes = metrics.class_metrics(df, "y", "p")
    rows = {r["class"]: r for r in metrics.with_macro(classes).collect()}
    assert rows[None]["f1"] == pytest.approx(sum(rows[k]["f1"] for k in (0, 1, 2)) / 3) and rows[None]["support"] == 4 and len(rows) == 4
    seen = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "e int, observed int")
    assert tuple(profile.coverage_summary(seen).first()) == (3, 2, 1, 66.6667) and tuple(profile.coverage_summary(seen.where("e > 9")).first()) == (0, 0, 0, 0.0)
    out = forecast.with_ratios(spark.createDataFrame([(1, 2.0), (2, 3.0), (8, 4.0)], "horizon int, rmse double")).collect()
    assert [(r["rmse_ratio"], r["within_limit"]) for r in sorted(out)] == [(1.0, 1), (1.5, 1), (2.0, 0)]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(9)
    rows = [(i, x := rng.random() * 3, rng.random(), int(x) if rng.random() < 0.8 else rng.randrange(3), x * x + rng.gauss(0, 0.3), i % 4 == 0) for i in range(800)]
    return spark.createDataFrame(rows, "i int, x double, z double, k int, y double, held boolean").cache()


def test_boosted_counts(noisy):
    fitted = boosting.boost(noisy, "y", ["x", "z"], F.col("held"), rounds=12, patience=3, depth=3, step=0.3)
    train = [c[1] for c in fitted.curve]
    assert train == sorted(train, reverse=True) and len(fitted.trees) == min(range(len(fitted.curve)), key=lambda i: fitted.curve[i][2]) + 1
    scored = fitted.predict(noisy)
    r = metrics.regression_metrics(scored.where("held"), "y", "prediction").first()
    best = min(c[2] for c in fitted.curve)
    assert r["rmse"] == pytest.approx(best, rel=0.05) and r["r2"] > 0.9 and scored.where("prediction < 0").count() == 0
    curve = forecast.training_curve(fitted, noisy.sparkSession)
    assert curve.columns == ["round", "train_rmse", "val_rmse", "kept"] and curve.where("kept").count() == len(fitted.trees)


def test_boosting_stops_by_patience(noisy):
    """Columns that tell nothing: the validation loss soon stops falling, and so do the rounds."""
    fitted = boosting.boost(noisy, "y", ["z"], F.col("held"), rounds=30, patience=2, depth=5, step=0.5)
    losses = [c[2] for c in fitted.curve]
    assert len(losses) < 30 and losses.index(min(losses)) == len(losses) - 3 and len(fitted.trees) == len(losses) - 2
    assert len(boosting.boost(noisy, "y", ["z"], None, rounds=3, depth=2).trees) == 3


def test_softmax_classes(noisy):
    fitted = boosting.boost(noisy, "k", ["x", "z"], F.col("held"), classes=True, rounds=8, depth=3, step=0.3)
    out = fitted.probabilities(noisy, 5)
    rows = out.collect()
    assert all(abs(sum(r[f"p_{k}"] for k in range(5)) - 1) < 1e-12 and r["p_4"] == 0 and r[f"p_{r['predicted']}"] == max(r[f"p_{k}"] for k in range(5)) for r in rows)
    assert sum(r["predicted"] == r["k"] for r in rows) / len(rows) > 0.75 and len({len(t) for t in fitted.trees}) == 1
    losses = [c[1] for c in fitted.curve]
    assert losses == sorted(losses, reverse=True) and losses[0] < math.log(3)
    empty = boosting.boost(noisy.where("false"), "y", ["x"], rounds=1)
    assert empty.start == [0.0]


def test_attribution_adds_up(noisy):
    fitted = forecast.fit_counts(noisy, "y", ["x", "z"], maxIter=4, maxDepth=3)
    few = noisy.where("i < 25")
    out = attribution.shapley_values(fitted.predict, few, ["x", "z"], ["i"], noisy, permutations=2, references=5).collect()
    assert len(out) == 50
    for i in range(25):
        own = [r for r in out if r["i"] == i]
        assert sum(r["attribution"] for r in own) == pytest.approx(own[0]["prediction"] - own[0]["base"], abs=1e-9)
    rank = {r["feature"]: r for r in attribution.attribution_ranking(noisy.sparkSession.createDataFrame(out), ["z"]).collect()}
    assert rank["x"]["rank"] == 1 and rank["x"]["family_rank"] is None and rank["z"]["family_rank"] == 1 and rank["z"]["in_family"]
    report = attribution.attribution_report(noisy.sparkSession.createDataFrame(list(rank.values()))).first()
    assert (report["top_of_family"], report["family_in_top"], report["n_family_in_top"]) == (["z"], ["z"], 1)
    assert attribution.shapley_values(fitted.predict, few.where("false"), ["x", "z"], ["i"], noisy).count() == 0


def test_attribution_is_exact_for_sums(noisy):
    """Where columns don't interact each walk gives the same answer: the column's own term less its mean over references."""
    score = lambda df: df.withColumn("prediction", F.col("x") * F.col("x") + 3 * F.col("z"))
    out = attribution.shapley_values(score, noisy.where("i < 9"), ["x", "z"], ["i"], noisy, permutations=1, references=800).collect()
    mean = noisy.agg(F.avg(F.col("x") * F.col("x")).alias("x"), F.avg(3 * F.col("z")).alias("z")).first()
    for r in out:
        own = r["value"] ** 2 if r["feature"] == "x" else 3 * r["value"]
        assert r["attribution"] == pytest.approx(own - mean[r["feature"]], abs=1e-9)


def test_attribution_shares_walks(spark):
    """The walks' own answer where columns interact, from few scored rows: each set of columns meets a reference once."""
    import random

    names, scored = ["x", "y", "z"], []
    f = lambda x, y, z: x * y + z * z * x - 2 * y * z

    def score(df):
        scored.append(df.count())
        return df.withColumn("prediction", f(*map(F.col, names)))

    background = [(0.5, 1.0, 2.0), (3.0, -1.0, 0.0), (1.0, 1.0, -4.0)]
    rows = {(i, "k"): (i * 1.5, 2.0 - i, i * i * 0.25) for i in range(6)} | {(None, "k"): (1.0, 2.0, 3.0)}
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "i int, j string, x double, y double, z double")
    got = attribution.shapley_values(score, df, names, ["i", "j"], spark.createDataFrame(background, "x double, y double, z double"), permutations=1, references=3).collect()
    assert sum(scored) <= len(rows) * (3 * 4 + 1) + 3  # all steps of all walks would be 7 * 3 * 2 * 4
    rng, order = random.Random(42), [0, 1, 2]
    rng.shuffle(order)
    want = {}
    for k, row in rows.items():
        for ref in background:
            for walk in (order, order[::-1]):
                at = list(ref)
                for c in walk:
                    before, at[c] = f(*at), row[c]
                    want[k, names[c]] = want.get((k, names[c]), 0) + (f(*at) - before) / 6
    assert len(got) == len(want) == 21
    base = sum(f(*b) for b in background) / 3
    for r in got:
        own = rows[r["i"], r["j"]]
        assert r["attribution"] == pytest.approx(want[(r["i"], r["j"]), r["feature"]]) and r["value"] == own[names.index(r["feature"])]
        assert r["prediction"] == pytest.approx(f(*own)) and r["base"] == pytest.approx(base)
    assert attribution.shapley_values(score, df, names, ["i", "j"], df.where("false")).count() == 0


def test_small_samples_in_one_pass(spark):
    df = spark.range(3000).select(F.col("id").cast("int").alias("i"))
    for n in (0, 7, 100, 101):
        assert sorted(r["i"] for r in sampling.hash_sample(df, ["i"], n).collect()) == (by_sorting(df, [], n) if n else [])
    assert "TakeOrdered" in sampling.hash_sample(df, ["i"], 7)._jdf.queryExecution().executedPlan().toString()


def test_the_cut_of_all_rows_is_a_filter(spark, monkeypatch):
    """Without strata no row waits for a join with the cut: it is pushed below an aggregation by key."""
    plans, cut = [], sampling.cut_lineage
    monkeypatch.setattr(sampling, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    df = spark.range(30_000).selectExpr("id % 9000 as i", "id as v").groupBy("i").agg(F.sum("v").alias("v"))
    got = sampling.smallest(df, [], ["i"], 500, 42, 20)
    assert sorted(r["i"] for r in got.collect()) == by_sorting(df, [], 500)
    assert len(plans) >= 2 and not any("Join" in p for p in plans)
    assert plans[-1].index("Aggregate") < plans[-1].index("Filter")


def test_tasks_of_fits_go_by_rows(spark, monkeypatch):
    """However many parts the sample comes in, a pass over it takes a task for each so many rows."""
    from panelforge.operators import cluster

    seen = []

    class Counted(cluster.KMeans):
        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            return super().fit(data)

    monkeypatch.setattr(cluster, "KMeans", Counted)
    monkeypatch.setattr(cluster, "TASK_ROWS", 100)
    sample = spark.range(0, 150, 1, 12).selectExpr("id", "cast(id % 2 * 9 + id % 5 * 0.1 as double) as x")
    fitted = cluster.fit(sample, ["x"], 2, 3)
    assert seen == [2, 2] and len(fitted.sweep) == 2 and sorted(round(c[0]) for c in cluster.fit(sample, ["x"], 2, 2).model.clusterCenters()) == [-1, 1]


def test_the_sweep_fits_on_all_orders(spark, tmp_path):
    """Beyond 60,000 orders too: with two clusters only the discount, of deviation 1, is left to the inertia."""
    from panelforge import queries

    n = 70_000
    spark.range(n).selectExpr("id as l_orderkey", "id % 2 * 40.0D + 10 as l_quantity", "id % 2 * 4000.0D + 1000 as l_extendedprice", "id % 7 * 0.01D as l_discount").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["k"]: r for r in queries.QUERIES["kmeans_sweep"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6] and got[2]["inertia"] == pytest.approx(n)
    assert all(got[k]["inertia"] > got[k + 1]["inertia"] for k in range(2, 6))


def test_the_sweep_equals_brute_force(spark, monkeypatch):
    """Silhouette by its definition over pairs, inertia by the nearest center, however the rows are dealt."""
    from panelforge.operators import cluster, kmeans

    draw = random.Random(5)
    rows = [(draw.gauss(g * 6, 1), None if i % 9 == 0 else draw.gauss(g % 2 * 5, 1), 7.0) for g in range(3) for i in range(25)] + [(400.0, 0.0, 7.0)]
    seen, real = [], kmeans.sweep
    monkeypatch.setattr(kmeans, "sweep", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = cluster.sweep(df, ["a", "b", "c"]).collect()
    monkeypatch.setattr(kmeans, "TASK_ROWS", 10)
    again = cluster.sweep(df.repartition(9), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in again] == [pytest.approx(tuple(r)) for r in got]
    x = np.array([[v or 0.0 for v in r] for r in rows])
    x = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    between = ((x[:, None] - x) ** 2).sum(2)
    for k, silhouette, inertia, centers in seen[0]:
        apart = ((x[:, None] - centers) ** 2).sum(2)
        at = apart.argmin(1)
        assert len(set(at)) == k and inertia == pytest.approx(apart.min(1).sum())
        scores = []
        for i, own in enumerate(at):
            mates = (at == own).sum() - 1
            a, b = between[i, at == own].sum() / max(1, mates), min(between[i, at == j].mean() for j in set(at) - {own})
            scores.append((b - a) / max(a, b) if mates else 0.0)
        assert silhouette == pytest.approx(np.mean(scores))
    assert [r["k"] for r in got] == [2, 3, 4, 5, 6]


def test_the_sweep_of_few_rows(spark):
    """No more centers than different rows; k is capped by the rows; a far row doesn't hide how near ones differ."""
    from panelforge.operators import cluster

    swept = lambda values: [tuple(r) for r in cluster.sweep(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], 2, 4).collect()]
    assert swept([]) == [] and swept([3.0]) == swept([3.0] * 3) == [(2, -1.0, 0.0)]
    assert swept([1.0, 1.0, 2.0, 2.0, 2.0]) == [(k, pytest.approx(1.0), pytest.approx(0.0, abs=1e-12)) for k in (2, 3, 4)]
    far = [0.0, 1.0, 10.0, 11.0, 1e9]
    mean, deviation = sum(far) / 5, (sum((v - sum(far) / 5) ** 2 for v in far) / 5) ** 0.5
    assert mean > 0 and swept(far)[1] == (3, pytest.approx(0.8 * 0.99, abs=0.01), pytest.approx(1.0 / deviation**2, rel=1e-6))


def by_sorting(df, strata, most, seed=42):
    order = sampling.hash_order(["i"], seed)
    rows = df.withColumn("h", order).collect()
    out = []
    for s in {tuple(r[c] for c in strata) for r in rows}:
        out += sorted((r["h"], r["i"]) for r in rows if tuple(r[c] for c in strata) == s)[:most]
    return sorted(i for _, i in out)


@pytest.mark.parametrize("cut_rows", [1, 10_000])
def test_samples_by_histogram(spark, cut_rows):
    df = spark.range(5000).select(F.col("id").cast("int").alias("i"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "small").alias("s"))
    for strata, most in ((["s"], 700), (["s"], 1), ([], 1234), ([], 9000), ([], 0)):
        got = sampling.smallest(df, [F.col(c) for c in strata], ["i"], most, 42, cut_rows)
        assert sorted(r["i"] for r in got.collect()) == (by_sorting(df, strata, most) if most else [])
    assert sampling.hash_sample(df, ["i"], 5, seed=1).collect() != sampling.hash_sample(df, ["i"], 5, seed=2).collect()


def test_samples_sort_rows_of_the_cut_only(spark, capsys):
    df = spark.range(20_000).select(F.col("id").cast("int").alias("i"), (F.col("id") % 2).alias("s"))
    got = sampling.stratified_cap(df, ["s"], ["i"], 6000)
    assert got.count() == 12_000
    got.explain()
    plan = capsys.readouterr().out
    assert "TakeOrdered" not in plan and not re.search(r"Sort .*range|Exchange rangepartitioning", plan) and plan.count("Window") <= 1
