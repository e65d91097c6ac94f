"""Panel operators against the small hand-checked cases, and invariants."""

import pytest
from pyspark.sql import functions as F

from panelforge.operators import cluster, forecast, labels, metrics, panel, profile, query, ranking, ranks, resolve, sampling, spatial, windows
from panelforge.plans import panel as plans
from panelforge.sources import ingest, publish


@pytest.fixture(scope="module")
def small(spark):
    observed = [("A", f"20240{w}", float(n)) for w, n in ((1, 5), (3, 0), (4, 10), (5, 20), (6, 40))] + [("B", "202403", 4.0), ("A", "202402", None)]
    df = spark.createDataFrame(observed, "e string, w string, n double").where("n is not null")
    extra = spark.createDataFrame([("C", "202402", 1.0)], "e string, w string, n double")
    return panel.densify(df.unionByName(extra), ["e"], ["w"], ["n"]).where("e <> 'C'").cache()


def series(df, column, entity="A"):
    return [r[column] for r in df.where(F.col("e") == entity).orderBy("w").collect()]


def test_dense(small):
    assert series(small, "n") == [5, 0, 0, 10, 20, 40]
    assert series(small, "n", "B") == [0, 0, 4, 0, 0, 0]


def test_windows(small):
    out = windows.trailing(small, "n", ["e"], ["w"], (3,), (8,))
    assert [round(x, 6) for x in series(out, "n_mean_3")] == [0, 2.5, 1.666667, 1.666667, 3.333333, 10]
    assert series(windows.lags(small, "n", ["e"], ["w"], (1,)), "n_lag_1") == [0, 5, 0, 0, 10, 20]
    assert series(windows.lags(small, "n", ["e"], ["w"], (1,), "null"), "n_lag_1")[0] is None
    out = windows.changes(small, "n", ["e"], ["w"])
    assert series(out, "n_pct_1") == [0, -1, 0, 0, 1, 1]
    assert series(out, "n_diff_1") == [0, -5, 0, 10, 10, 20]
    assert series(windows.changes(small, "n", ["e"], ["w"], fill="null"), "n_pct_1")[3] is None
    assert series(windows.leads(small, "n", ["e"], ["w"], 2), "target") == [0, 10, 20, 40]
    with pytest.raises(ValueError):
        windows.lags(small, "n", ["e"], ["w"], fill="mean")


def test_one_shuffle_for_window_levels(spark):
    base = spark.range(20).select(F.col("id").cast("string").alias("w"), F.lit("A").alias("e"), F.col("id").cast("double").alias("n"))
    out = windows.ratios(windows.changes(windows.trailing(windows.lags(base, "n", ["e"], ["w"]), "n", ["e"], ["w"]), "n", ["e"], ["w"]), "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert "CartesianProduct" not in plan


def test_weighted_merge(spark):
    df = spark.createDataFrame([("k", 10, 0.2), ("k", 30, None), ("k", 10, 0.4), (None, 7, 1.0)], "k string, w long, f double")
    r = panel.merge_weighted(df, "k", "w", ["f"]).collect()
    assert len(r) == 1 and r[0]["w"] == 50 and abs(r[0]["f"] - 0.3) < 1e-12
    assert tuple(panel.merge_losses(df, F.col("k"), "w").first()) == (1, 7)


def test_accounting(spark):
    df = spark.createDataFrame([(2020, i % 5, i) for i in range(50)], "source_year int, a int, b int")
    df = df.unionByName(df.where("b < 3"))
    marked = panel.mark_duplicates(df, ["source_year", "a", "b"], ["b"])
    out = panel.classified(marked, [("duplicate", F.col("is_duplicate")), ("week", F.col("a") == 1), ("place", F.col("b") > 40)])
    lost = sum(r["records"] for r in panel.discard_counts(out).collect())
    assert lost + out.where("discard_reason is null").count() == df.count()
    assert panel.discard_examples(out, ["b"], most=2).count() == 2
    assert ingest.drop_exact_duplicates(df).count() == 50


def test_resolution(spark):
    t = spark.createDataFrame([("3550308", "355030", "X", "SP", "SE"), ("5300108", "530010", "Y", "DF", "CO")], "code string, code6 string, name string, uf string, region string")
    rec = spark.createDataFrame([(1, "3550308", "", ""), (2, "355030", "", ""), (3, "3550308.0", "", ""), (4, "5399", "", " df "), (5, "35.0", None, ""), (6, None, "3550308", "")], "i int, a string, b string, st string")
    out = {r["i"]: (r["place_code"], r["place_rule"], r["place_field"]) for r in resolve.resolve_place(rec, t, [("a", "a"), ("b", "b")], ["st"]).collect()}
    assert out[1] == ("3550308", "direct_7d", "a") and out[2] == ("3550308", "prefix_6d_to_7d", "a") and out[3][1] == "direct_7d"
    assert out[4] == ("5300108", "df_prefix_fallback", "a") and out[5] == (None, None, None) and out[6] == ("3550308", "direct_7d", "b")


def test_resolution_both_ways(spark):
    names = "code string, code6 string, name string, uf string, region string"
    some = [(f"{1100000 + 7 * i}", f"{1100000 + 7 * i}"[:6], f"N{i}", "RO", "N") for i in range(5000)]
    t = spark.createDataFrame([*some, ("1100007", "110000", "A", "RO", "N"), (None, "999999", "Z", "RO", "N"), ("9999999", None, None, "RO", "N")], names)
    rec = spark.createDataFrame([(i, f"{1100000 + i}", f"{1099000 + i}"[:6], "AC", "old") for i in range(3000)] + [(-1, "999999", "5300000", "DF", "old")], "i int, a string, b string, uf string, place_name string")
    few, many = (resolve.resolve_place(rec, t, [("a", "a"), ("b", "b")], ["uf"], broadcast_rows=n) for n in (50_000, 10))
    assert few.columns == ["i", "a", "b", "uf", "place_code", "place_name", "place_uf", "region", "place_rule", "place_field"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "InSet" not in plan and "SortMergeJoin" not in plan
    rows = few.orderBy("i").collect()
    assert rows == many.orderBy("i").collect() and len(rows) == 3001
    codes = {}
    for code, code6, *_ in some:
        codes[code] = code
        codes[code6] = max(code, codes.get(code6, ""))
    for r in rows[1:]:
        want = codes.get(r["a"]) or codes.get(r["a"][:6]) or codes.get(r["b"])
        assert r["place_code"] == want, r
    assert {r["place_name"] for r in rows if r["place_code"] == "1100007"} == {"A"}
    assert tuple(rows[0])[4:] == ("5300108", None, None, None, "df_prefix_fallback", "b")


def test_duplicates_by_order(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 3, "z"), (None, 2, "n"), (None, 1, "m"), (2, None, "s")], "k int, o int, v string")
    out = {r["v"]: r["is_duplicate"] for r in panel.mark_duplicates(df, ["k"], ["o"]).collect()}
    assert out["x"] and out["y"] + out["z"] == 1 and out["n"] and not out["m"] and not out["s"]
    whole = panel.mark_duplicates(df.unionByName(df), ["k", "o", "v"], ["o", "k"])
    assert whole.where("is_duplicate").count() == 6 and whole.count() == 12


def test_quantiles_of_many_keys(spark, monkeypatch):
    df = spark.range(3000).select(F.when(F.col("id") % 40 > 0, F.col("id") % 40).alias("k"), ((F.col("id") * 37) % 501).cast("double").alias("v"))
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", [0.1, 0.5, 0.9]).alias("q")).collect()}
    for bound in (ranks.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(ranks, "MAX_BROADCAST_ROWS", bound)
        got = {r["k"]: r["q"] for r in ranks.key_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
        stats = df.groupBy("k").agg(F.count("v").alias("n")).unionByName(spark.createDataFrame([(999, 0)], "k long, n long"))
        out = {r["k"]: r["median"] for r in ranks.with_medians(stats, df, ["k"], "v").collect()}
        assert out == {999: None} | {k: q[1] for k, q in want.items()}


def test_spatial(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 60.0, 100.0), (4, 0.0, 1.0)], "place int, latitude double, longitude double")
    sites = spark.createDataFrame([(10, 0.0, 0.2), (11, 0.0, -0.2), (12, 0.0, 179.95), (13, 0.0, 1.8)], "site int, latitude double, longitude double")
    out = {r["place"]: r for r in spatial.nearest_site(places, sites).collect()}
    assert 2 not in out and out[1]["site"] == 10 and out[1]["n_within_50km"] == 2 and out[3]["uncovered"]
    p = places.dropna().select("place", "latitude", "longitude").unionByName(spark.createDataFrame([(5, 0.0, -179.95), (6, 89.9, 10.0)], "place int, latitude double, longitude double"))
    s = sites.unionByName(spark.createDataFrame([(14, 89.9, -170.0)], "site int, latitude double, longitude double"))
    grid = spatial.grid_pairs(p, spatial._sites(s), 100)
    from panelforge.functions.rows import haversine_km

    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon"))
    near = {(r["place"], r["site"]) for r in grid.where(km <= 100).collect()}
    assert near == {(r["place"], r["site"]) for r in spatial.pairs(p, s, 100).collect()}
    assert (5, 12) in near and (6, 14) in near
    readings = spark.createDataFrame([(10, "w", 1.0), (11, "w", 3.0)], "site int, w string, v double")
    assert abs(spatial.inverse_distance(places, sites, readings, ["w"], ["v"]).first()["v"] - 2.0) < 1e-9


def test_nearest_site_on_the_grid(spark):
    import math
    import random

    rng = random.Random(3)
    spot = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(-3, 3), 89.9, 91.0]), rng.choice([rng.uniform(-180, 180), rng.uniform(-3, 3), 179.9]))
    places = [(i, *spot()) for i in range(80)] + [(80, None, 1.0), (81, 5.0, 5.0), (82, 5.0, 5.0)]
    sites = [(i, *spot()) for i in range(60)] + [(60, 5.1, 5.0), (61, 5.1, 5.0), (62, 1.0, None)]

    def km(a, b):
        x, y = math.radians(a[1]), math.radians(b[1])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 12742 * math.asin(min(math.sqrt(h), 1))

    p, s = spark.createDataFrame(places, "place int, latitude double, longitude double"), spark.createDataFrame(sites, "site int, latitude double, longitude double")
    for known in ([x for x in sites if x[2] is not None], sites[60:62]):
        some = s.where(F.col("site").isin([x[0] for x in known]))
        out = {r["place"]: r for r in spatial.nearest_site(p, some).collect()}
        assert sorted(out) == [x[0] for x in places if x[1] is not None]
        for i, r in out.items():
            d = sorted((km(places[i], x), x[0]) for x in known)
            assert r["site"] in {x for k, x in d if k < d[0][0] + 1e-9} and abs(r["distance_km"] - d[0][0]) < 0.006
            assert (r["n_within_50km"], r["n_within_100km"], r["uncovered"]) == (sum(k <= 50 for k, _ in d), sum(k <= 100 for k, _ in d), round(d[0][0], 2) > 100)
    assert spatial.nearest_site(p, s.where("false")).count() == 0
    # Places and sites meet by cell only: no product, whatever the number of sites.
    for df in (spatial.nearest_site(p, s), spatial.pairs(p, s, 100)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_inverse_distance_joins_positions(spark, monkeypatch):
    """Many places and sites of few positions meet once a pair of positions; the means are those of all pairs."""
    met, grid_pairs = [], spatial.grid_pairs

    def counted(*args):
        out = grid_pairs(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "grid_pairs", counted)
    places = spark.range(300).selectExpr("id as place", "-10 + id % 3 * 0.1D as latitude", "-50D as longitude").unionByName(spark.createDataFrame([(7, 0.0, 0.0), (8, None, 1.0)], "place long, latitude double, longitude double"))
    sites = spark.range(40).selectExpr("id as site", "-10 + id % 2 * 0.3D as latitude", "-50.1D as longitude")
    readings = sites.selectExpr("site", "explode(array('a', 'b', null)) as w").selectExpr("site", "w", "case when site % 5 > 1 or w = 'b' then site * 1.5D end as v", "cast(null as int) as u")
    got = spatial.inverse_distance(places, sites, readings, ["w"], ["v", "u"], within_km=40).collect()
    assert met == [6]
    monkeypatch.undo()
    pairs = spatial.pairs(places, sites, 40).collect()
    by_site = {}
    for r in readings.collect():
        by_site.setdefault(r["site"], []).append(r)
    sums = {}
    for q in pairs:
        for r in by_site[q["site"]]:
            a = sums.setdefault((q["place"], r["w"]), [0.0, 0.0])
            if r["v"] is not None:
                a[0] += r["v"] / max(q["km"], 0.001) ** 2
                a[1] += 1 / max(q["km"], 0.001) ** 2
    assert {(r["place"], r["w"]) for r in got} == set(sums) and len(got) == len(sums) == 900
    assert all(r["u"] is None and r["v"] == pytest.approx(sums[r["place"], r["w"]][0] / sums[r["place"], r["w"]][1]) for r in got)


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (4.0, 2.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert abs(r["rmse"] - (5 / 3) ** 0.5) < 1e-12 and abs(r["mae"] - 1) < 1e-12 and abs(r["r2"] - 0.375) < 1e-12 and abs(r["mape"] - 25) < 1e-9


def test_labels(small):
    out = labels.quantile_alerts(small, "n", ["e"], {"q": 0.75})
    assert series(out, "q") == [0, 0, 0, 0, 1, 1]
    assert series(labels.risk_class(windows.leads(small, "n", ["e"], ["w"], 1), "target", "n", ["e"]), "risk")[-1] == 3
    whole = plans.labelled_panel(small.select("e", "w", "n", F.lit(0.0).alias("s")), ["e"], "w", "n", "s")
    assert whole.count() == small.count() and "critical" in whole.columns


def test_keys_and_publish(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert {tuple(r) for r in publish.insert_if_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in publish.replace_by_key(old, new.where("v <> 'e'"), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert profile.repeated_keys(new, ["k"]).count() == 1
    with pytest.raises(ValueError):
        profile.require_unique(new, ["k"])


def test_partitioned_write_replaces_years(spark, tmp_path):
    path = str(tmp_path / "panel")
    first = spark.createDataFrame([(1, 2020), (2, 2021)], "v int, y int")
    publish.write_panel(first, path, year_of="y")
    publish.write_panel(spark.createDataFrame([(9, 2021)], "v int, y int"), path, year_of="y")
    out = ingest.read_panel(spark, path)
    assert sorted(r["v"] for r in out.collect()) == [1, 9] and "year" not in out.columns


def test_readers(spark, tmp_path):
    (tmp_path / "cases2020.json").write_text('[{"A": "1", "B": null}, {"A": "2", "C": "x"}]')
    out = ingest.read_cases_json(spark, str(tmp_path / "cases2020.json"), ["A", "B"]).collect()
    assert [(r["A"], r["B"], r["source_year"]) for r in out] == [("1", None, 2020), ("2", None, 2020)]
    (tmp_path / "cases2021.csv").write_text("A,B\n1,2\n")
    assert ingest.read_cases_csv(spark, str(tmp_path / "cases2021.csv"), ["A"]).first()["source_year"] == 2021
    head = ["REGIAO:;CO", "UF:;DF", "ESTAÇÃO:;BRASÍLIA", "CODIGO (WMO):;A001", "LATITUDE:;-15,78", "LONGITUDE:;-47,92", "ALTITUDE:;1160,9", "DATA DE FUNDACAO:;07/05/00"]
    body = ["Data;Hora" + ";" * 16, "2024/01/01;0000 UTC;1,5;-9999;" + ";" * 13, "total;x;1;2;3", "2024/01/02;1", "2024/01/03;0000 UTC;1" + ";" * 17]
    (tmp_path / "s.CSV").write_bytes("\r\n".join(head + body).encode("latin-1"))
    hourly, stations = ingest.read_station_files(spark, str(tmp_path / "s.CSV"))
    h, s = hourly.collect(), stations.first()
    assert len(h) == 1 and h[0]["precipitacao_mm"] == 1.5 and h[0]["pressao_mbar"] is None and str(h[0]["data"]) == "2024-01-01"
    assert s["codigo_wmo"] == "A001" and s["latitude"] == -15.78 and s["estacao"] == "BRASÍLIA" and s["data_fundacao"] == "07/05/00"
    (tmp_path / "t.json").write_text('[{"id": 1100015, "nome": "N", "microrregiao": {"mesorregiao": {"UF": {"sigla": "RO", "regiao": {"sigla": "N"}}}}}, {"id": 2, "nome": "M", "regiao-imediata": {"regiao-intermediaria": {"UF": {"sigla": "SP", "regiao": {"sigla": "SE"}}}}}]')
    assert {(r["code"], r["uf"], r["region"]) for r in ingest.read_territory(spark, str(tmp_path / "t.json")).collect()} == {("1100015", "RO", "N"), ("2", "SP", "SE")}
    raw = spark.createDataFrame([("11000150", "a", 1.0, 2.0), ("1100015", "b", 3.0, 4.0), ("7", "c", None, 1.0)], "c string, n string, la double, lo double")
    assert [tuple(r) for r in ingest.coordinates(raw, "c", "n", "la", "lo").collect()] == [("1100015", "a", 1.0, 2.0)]


def test_sampling_and_queries(spark, small):
    assert sampling.hash_sample(small, ["e", "w"], 3).collect() == sampling.hash_sample(small.repartition(3), ["e", "w"], 3).collect()
    assert sampling.stratified_cap(small, ["e"], ["w"], 2).count() == 4
    assert query.series(small, "e", "A", "w", "202402", "202404").count() == 3
    with pytest.raises(LookupError):
        query.series(small, "e", "Z", "w", check=True)
    with pytest.raises(ValueError):
        query.top_weeks(small, "w", "n", 101)
    assert query.top_weeks(small, "w", "n", 1).first()["w"] == "202406"


def test_folds_and_draws():
    assert [f["test_year"] for f in forecast.folds(list(range(2000, 2013)))] == [2005, 2008, 2011, 2012]
    assert forecast.draws(3) == forecast.draws(3)


def test_cluster_labels_follow_the_median(spark):
    df = spark.createDataFrame([(float(i % 3 * 100 + i % 7), float(i % 3)) for i in range(90)], "v double, u double")
    fitted = cluster.fit(df, ["v", "u"], 2, 4)
    assert len(fitted.sweep) == 3
    out = cluster.ordered_labels(fitted.assign(df), "v", ["low", "mid", "high"])
    medians = {r["cluster_label"]: r["m"] for r in out.groupBy("cluster_label").agg(F.median("v").alias("m")).collect()}
    assert medians["low"] < medians["mid"] < medians["high"]


def test_exact_quantiles_by_ranges(spark):
    import random

    import numpy as np

    rng = random.Random(1)
    rows = [("a", rng.choice([rng.gauss(0, 5), 1.0, 2.0])) for _ in range(3001)] + [("b", float(i)) for i in range(10)] + [("c", None), ("d", 7.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r["q"] for r in ranks.key_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    assert set(got) == {"a", "b", "d", None}
    for k, q in got.items():
        want = np.quantile([v for x, v in rows if x == k], [0.0, 0.1, 0.5, 0.77, 1.0])
        assert np.allclose(q, want)
    counts = df.where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in ranks.running_counts(counts, ["k"], "v").where("k = 'b'").collect():
        assert r["before"] == r["v"]


def test_auc_by_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(3), round(rng.random(), 1), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double, t double")
    got = {r["class"]: r["auc"] for r in metrics.macro_auc(df, "y", {0: "s", 2: "t"}).collect()}
    want = {}
    for k, at in ((0, 1), (2, 2)):
        pos, neg = [r[at] for r in rows if r[0] == k], [r[at] for r in rows if r[0] != k]
        want[k] = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    want[None] = sum(want.values()) / 2
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(got) == 3


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(i, 2000 + i % 9, float(i % 4), float(i * 7 % 13), float(i % 4) * 2 + (i * 7 % 13) / 50) for i in range(540)]
    df = spark.createDataFrame(rows, "i int, ano int, x double, noise double, target double")
    return df.withColumn("risk", F.col("x").cast("int")).withColumn("split", forecast.split_by_year(F.col("ano"), 2005, 2006)).cache()


def test_risk_classes_of_boosted_trees(learnable):
    few = {"maxIter": 5, "maxDepth": 3}
    out = forecast.classify_risk(learnable.where("split <> 'test'"), learnable.where("split = 'test'"), "risk", ["x", "noise"], F.col("split") == "validation", **few).collect()
    assert out and all(r["predicted"] == r["risk"] and abs(sum(r[f"p_{k}"] for k in range(4)) - 1) < 1e-9 for r in out)
    two = forecast.classify_risk(learnable.where("risk < 2"), learnable, "risk", ["x"], **few)
    assert two.where("p_2 > 0 or p_3 > 0 or predicted > 1").count() == 0
    one = forecast.classify_risk(learnable.where("risk = 2"), learnable, "risk", ["x"], **few)
    assert {tuple(r) for r in one.select("predicted", "p_2", "p_0").distinct().collect()} == {(2, 1.0, 0.0)}


def test_folds_search_and_stability(learnable):
    few = {"maxIter": 3, "maxDepth": 2}
    found = forecast.walk_forward(learnable, "target", ["x", "noise"], "ano", **few)
    assert sorted(r["test_year"] for r in found.collect()) == [2005, 2008]
    s = forecast.stability(found).first()
    assert s["stable"] == int(s["cv_pct"] < 30) and abs(s["cv_pct"] - 100 * s["std"] / s["mean"]) < 1e-9
    space = {"maxDepth": (1, 3, "int"), "maxIter": (1, 3, "int")}
    out = forecast.search(learnable.where("split = 'train'"), learnable.where("split = 'validation'"), "target", ["x", "noise"], 3, space, base=few).collect()
    assert [r["rmse"] for r in out] == sorted(r["rmse"] for r in out) and len({r["baseline_rmse"] for r in out}) == 1
    assert all(abs(r["improvement_pct"] - 100 * (1 - r["rmse"] / r["baseline_rmse"])) < 1e-9 for r in out)
    rows = learnable.select("i", "ano", "x", "noise", "target", F.lit("e").alias("e"))
    ahead = forecast.multi_horizon(rows, "target", ["e"], ["i"], ["x", "noise"], "ano", (1, 4), 2006, **few).collect()
    assert sorted(r["horizon"] for r in ahead) == [1, 4] and next(r for r in ahead if r["horizon"] == 1)["rmse_ratio"] == 1
    gone = forecast.ablation(learnable, "target", ["x", "noise"], "x", **few).first()
    assert gone["improvement"] == 1 and gone["rmse_full"] < gone["rmse_without"]


def test_labelings_and_lookups(spark, small):
    weeks_ = small.select("e", "w", "n")
    both = cluster.labelings_attached(weeks_, ["e", "w"], {"first": weeks_.where("n > 0").select("e", "w", F.lit("hot").alias("cluster_label")), "second": weeks_.select("e", "w", F.lit("all").alias("cluster_label"))})
    assert {(r["first"], r["second"], r["n_rows"]) for r in cluster.cross_summary(both, "first", "second", "n").collect()} == {("hot", "all", 5), (None, "all", 7)}
    assert cluster.feature_columns(spark.createDataFrame([(1, 2, 3, "x", 4)], "notificacoes int, qt_a int, label_b int, t string, k int"), ("k",), profile=True) == ["qt_a"]
    scores = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0)], "feature string, s double")
    assert [r["feature"] for r in query.top_features(scores, "s", 2).collect()] == ["b", "c"]
    docs = profile.feature_catalog(spark.createDataFrame([(1, 2.0)], "k int, prop_raca_x double"), ("k",))
    assert query.catalog_entry(docs, "prop_raca_x").first()["description"] == profile.GROUP_NOTES["proporcao_demografica"]
    assert ranking.composite_ranking(scores, ["s"], top=1).where("selected = 1").count() == 2


def test_missingness_in_one_pass(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, "b"), (None, "b")], "x int, y string")
    exact, near = profile.missingness(df), profile.missingness(df, approximate=True)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, near.select(*exact.columns).collect()))


def test_permutation_importance(learnable):
    fitted = forecast.fit_counts(learnable, "target", ["x", "noise"], maxIter=5, maxDepth=3)
    out = {r["feature"]: r for r in forecast.permutation_importance(fitted, learnable, "target", ["i"], family="no", parts=4).collect()}
    assert out["x"]["rank"] == 1 and out["x"]["importance"] > 1 > out["noise"]["importance"] and out["noise"]["in_family"] and not out["x"]["in_family"]
