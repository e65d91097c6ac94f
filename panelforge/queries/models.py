"""Queries that fit models; rows only where a fit has no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, boosting, cluster, forecast, labels, metrics, ranking, sampling, windows
from ..sources.shared import cut_lineage
from .base import DENSE_CTE, query, table, tail_sql
from .panels import dense, weekly

_CLIMATE = ["climate_rain", "climate_temp"]
_FEATURES = ["cases", "cases_lag_1", "cases_lag_2", "cases_mean_4", "season_sin", *_CLIMATE]


def _embedded(spark, sf_dir):
    """The label and every dimension of the vectors."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)]), [f"e{i}" for i in range(n)]


def _orders(spark, sf_dir):
    """One row an order: lines, quantity, price and mean discount."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))


def _model_rows(spark, sf_dir):
    """Windows of the panel, its season, and the climate of the same week of the year from the nation's stations."""
    d = dense(spark, sf_dir)
    d = windows.lags(d, "cases", ["nation"], ["week"], (1, 2), "null")
    d = windows.trailing(d, "cases", ["nation"], ["week"], (4,), ())
    week = F.substring("week", 5, 2)
    climate = weekly(spark, sf_dir).groupBy((F.col("station") % 25).alias("nation"), week.alias("ww")).agg(F.avg("rain_sum").alias("climate_rain"), F.avg("temp_mean").alias("climate_temp"))
    d = d.withColumns({"season_sin": F.sin(week.cast("double") * 2 * F.pi() / 52), "ww": week, "ano": F.substring("week", 1, 4).cast("int")}).join(climate, ["nation", "ww"], "left").drop("ww")
    return cut_lineage(d.withColumn("split", forecast.split_by_year(F.col("ano"), 1998, 1999)))


def _with_target(spark, sf_dir):
    return cut_lineage(windows.leads(_model_rows(spark, sf_dir), "cases", ["nation"], ["week"], 4))


@query()
def kmeans_sweep(spark, sf_dir):
    """Fits on all orders."""
    return cluster.sweep(_orders(spark, sf_dir), ["lines", "quantity", "price", "discount"])


@query()
def cluster_labels(spark, sf_dir):
    """Fit two profiles on a sample, score every row, rank clusters by their median, attach both labelings and cross them."""
    orders, keys = cut_lineage(_orders(spark, sf_dir)), ["l_orderkey"]
    sample = sampling.hash_sample(orders, keys, 60_000)
    labelings = {}
    for name, columns, names in (("intensity", ["quantity", "price"], ["low", "middle", "high"]), ("profile", ["discount", "lines"], ["a", "b", "c", "d"])):
        fitted = cluster.fit(sample, columns)
        labelings[name] = cluster.ordered_labels(fitted.assign(orders), "price", names).select(*keys, "cluster_label")
    return cluster.cross_summary(cluster.labelings_attached(orders, keys, labelings), "intensity", "profile", "price")


@query()
def forest_importance(spark, sf_dir):
    e, columns = _embedded(spark, sf_dir)
    return ranking.forest_importance(e, "label", columns, balanced=True)


@query()
def forecast_counts(spark, sf_dir):
    rows = _with_target(spark, sf_dir)
    fitted = boosting.boost(rows.where("split <> 'test'"), "target", _FEATURES, F.col("split") == "validation")
    return fitted.predict(rows.where("split = 'test'")).select("nation", "week", "target", "prediction")


@query()
def training_curve(spark, sf_dir):
    rows = _with_target(spark, sf_dir)
    fitted = boosting.boost(rows.where("split <> 'test'"), "target", _FEATURES, F.col("split") == "validation")
    return forecast.training_curve(fitted, spark)


@query()
def risk_classifier(spark, sf_dir):
    rows = labels.risk_class(_with_target(spark, sf_dir), "target", "cases", ["nation"], F.col("split") == "train")
    out = forecast.classify_risk(rows.where("split <> 'test'"), rows.where("split = 'test'"), "risk", _FEATURES, F.col("split") == "validation")
    return out.select("nation", "week", "risk", "predicted", "p_0", "p_1", "p_2", "p_3")


@query()
def ablation(spark, sf_dir):
    return forecast.ablation(_with_target(spark, sf_dir), "target", _FEATURES, "climate")


@query()
def multi_horizon(spark, sf_dir):
    return forecast.multi_horizon(_model_rows(spark, sf_dir), "cases", ["nation"], ["week"], _FEATURES, "ano", train_until=1998)


def _folds(spark, sf_dir):
    return forecast.walk_forward(_with_target(spark, sf_dir), "target", _FEATURES, "ano", first_after=4)


@query()
def walk_forward(spark, sf_dir):
    return _folds(spark, sf_dir)


@query()
def walk_forward_stability(spark, sf_dir):
    return forecast.stability(_folds(spark, sf_dir))


@query()
def parameter_search(spark, sf_dir):
    rows = _with_target(spark, sf_dir)
    return forecast.search(rows.where("split = 'train'"), rows.where("split = 'validation'"), "target", _FEATURES)


def _attributed(spark, sf_dir):
    """Shapley values of a linear score of order columns, which SQL can tell: each column's weight times its distance from
    the references' mean."""
    rows = _orders(spark, sf_dir)
    line = lambda df: df.withColumn("prediction", F.col("quantity") * 0.5 - F.col("price") * 0.001 + F.col("discount") * 100.0)
    return attribution.shapley_values(line, rows, ["quantity", "price", "discount"], ["l_orderkey"], permutations=1, references=4)


_LINEAR = """with o as (select l_orderkey, sum(l_quantity)::double as quantity, sum(l_extendedprice)::double as price, avg(l_discount)::double as discount from lineitem group by l_orderkey)"""


@query("n:bigint off:r6", "select 3 * count(distinct l_orderkey) as n, 0.0 as off from lineitem")
def attribution_adds_up(spark, sf_dir):
    """Attributions of all orders add up to prediction less base: the largest gap is 0."""
    by = _attributed(spark, sf_dir).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum("attribution") - F.max("prediction") + F.max("base")).alias("gap"))
    return by.agg(F.sum("n").alias("n"), F.round(F.max("gap"), 5).alias("off"))


@query("feature:string spread:r6", f"""{_LINEAR} select 'quantity' as feature, 0.5 * stddev_pop(quantity) as spread from o union all select 'price', 0.001 * stddev_pop(price) from o union all select 'discount', 100 * stddev_pop(discount) from o""")
def linear_attribution(spark, sf_dir):
    """Of a linear score, a column's attributions spread as its weighted values do."""
    return _attributed(spark, sf_dir).groupBy("feature").agg(F.stddev_pop("attribution").alias("spread"))


@query()
def attribution_ranks(spark, sf_dir):
    """Shapley values of boosted trees on a sample of test rows, ranked, with the climate columns as the family."""
    rows = _with_target(spark, sf_dir)
    fitted = forecast.fit_counts(rows.where("split = 'train'"), "target", _FEATURES)
    sample = sampling.hash_sample(rows.where("split = 'test'"), ["nation", "week"], 200)
    values = attribution.shapley_values(fitted.predict, sample, _FEATURES, ["nation", "week"], rows.where("split = 'train'"))
    return attribution.attribution_ranking(values, ["climate"])


@query()
def permutation_importance(spark, sf_dir):
    rows = _with_target(spark, sf_dir)
    fitted = forecast.fit_counts(rows.where("split = 'train'"), "target", _FEATURES)
    return forecast.permutation_importance(fitted, rows.where("split = 'test'"), "target", ["nation", "week"], family="season")


# The same work with a forecast that SQL can tell: the nation's mean of the training rows.

_MEANS = f"{DENSE_CTE}, f as (select *, lead(cases, 4) over (partition by nation order by week) as target from dense), y as (select *, substr(week, 1, 4)::int as ano from f where target is not null), yr as (select ano, count(*) as n from y group by ano)"
_SCORES = "sqrt(avg((target - p) * (target - p))) as rmse, avg(abs(target - p)) as mae, 1 - sum((target - p) * (target - p)) / (var_pop(target) * count(target)) as r2, 100 * avg(abs(target - p) / target) filter (target > 0) as mape"
_FOLDED = f"""with {_MEANS}, z as (select min(ano) as a, max(ano) as b from yr), fo as (select ano as test_year from yr, z where ano >= a + 4 and ((ano - a - 4) % 3 = 0 or ano = b)),
    m as (select test_year, nation, avg(target) as p from fo join y on y.ano <= test_year - 1 group by all),
    s as (select test_year, {_SCORES} from (select y.ano as test_year, target, p from y join fo on fo.test_year = y.ano left join m on m.test_year = y.ano and m.nation = y.nation) t group by test_year)"""


def _dense_target(spark, sf_dir):
    d = windows.leads(dense(spark, sf_dir), "cases", ["nation"], ["week"], 4)
    return d.withColumn("ano", F.substring("week", 1, 4).cast("int"))


def _folded_means(spark, sf_dir):
    return forecast.walk_forward(_dense_target(spark, sf_dir), "target", [], "ano", first_after=4, fit=lambda rows, validation: forecast.fit_means(rows, "target", ["nation"]))


@query("test_year:int rmse:r6 mae:r6 r2:r6 mape:r6", f"{_FOLDED} select * from s")
def walk_forward_means(spark, sf_dir):
    return _folded_means(spark, sf_dir)


@query("mean:r6 std:r6 cv_pct:r6 stable:int", f"{_FOLDED} select avg(rmse) as mean, stddev_pop(rmse) as std, 100 * stddev_pop(rmse) / avg(rmse) as cv_pct, (100 * stddev_pop(rmse) / avg(rmse) < 30)::int as stable from s")
def walk_forward_means_stability(spark, sf_dir):
    return forecast.stability(_folded_means(spark, sf_dir))


def _horizon_sql(h: int) -> str:
    rows = f"(select nation, substr(week, 1, 4)::int as ano, lead(cases, {h}) over (partition by nation order by week) as target from dense)"
    return f"select {h} as horizon, {_SCORES} from (select target, p from {rows} v left join (select nation, avg(target) as p from {rows} t where target is not null and ano <= 1998 group by nation) m using (nation) where target is not null and ano > 1998) w"


@query("horizon:int rmse:r6 mae:r6 r2:r6 mape:r6 rmse_ratio:r6 within_limit:int", f"with {DENSE_CTE}, h as ({' union all '.join(map(_horizon_sql, (1, 2, 4, 8)))}) select *, rmse / (select rmse from h where horizon = 1) as rmse_ratio, (rmse / (select rmse from h where horizon = 1) < 2)::int as within_limit from h")
def multi_horizon_means(spark, sf_dir):
    rows = dense(spark, sf_dir).withColumn("ano", F.substring("week", 1, 4).cast("int"))
    return forecast.multi_horizon(rows, "cases", ["nation"], ["week"], [], "ano", train_until=1998, fit=lambda train: forecast.fit_means(train, "target", ["nation"]))


@query("rmse_without:r6 rmse_full:r6 mean_difference:r6 t:r6 n:bigint p_value:r6 delta_pct:r6 improvement:int", f"""with {_MEANS}, m as (select nation, avg(target) as p from y where ano <= 1998 group by nation), w as (select avg(target) as q from y where ano <= 1998),
    e as (select (target - q) * (target - q) as e0, (target - p) * (target - p) as e1 from y join m using (nation) cross join w where ano > 1998),
    a as (select sqrt(avg(e0)) as rmse_without, sqrt(avg(e1)) as rmse_full, avg(e0 - e1) as mean_difference, avg(e0 - e1) / (stddev_samp(e0 - e1) / sqrt(count(*))) as t, count(*) as n from e),
    b as (select *, {tail_sql('(n - 1) / 2.0', '0.5', 't * t / (n - 1)')} as p_value from a)
    select *, 100 * (rmse_full - rmse_without) / rmse_without as delta_pct, (t > 0 and p_value < 0.05)::int as improvement from b""")
def means_compared(spark, sf_dir):
    """The mean of all training rows against the mean of the nation's."""
    rows = _dense_target(spark, sf_dir).withColumn("every", F.lit(1))
    train, test = rows.where("ano <= 1998"), rows.where("ano > 1998")
    out = forecast.fit_means(train, "target", ["every"]).predict(test, "without")
    return forecast.compared(forecast.fit_means(train, "target", ["nation"]).predict(out, "full"), "target", "without", "full")


@query("label:int precision:r6 recall:r6 f1:r6 support:bigint", f"""with {_MEANS}, q as (select nation, quantile_cont(cases, 0.5) as p50, quantile_cont(cases, 0.75) as p75, quantile_cont(cases, 0.9) as p90 from y where ano <= 1998 group by nation),
    k as (select case when target > p90 then 3 when target > p75 then 2 when target > p50 then 1 else 0 end as truth, case when cases > p90 then 3 when cases > p75 then 2 when cases > p50 then 1 else 0 end as guess from y left join q using (nation) where ano > 1999),
    a as (select truth as label, count(*) as support, count(*) filter (truth = guess) as hit from k group by truth), b as (select guess as label, count(*) as said from k group by guess),
    m as (select coalesce(a.label, b.label) as label, coalesce(hit, 0) / nullif(said, 0) as precision, coalesce(hit, 0) / nullif(support, 0) as recall, coalesce(support, 0) as support from a full join b on a.label = b.label),
    n as (select label, coalesce(precision, 0) as precision, coalesce(recall, 0) as recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, support from m)
    select * from n union all select null, avg(precision), avg(recall), avg(f1), sum(support) from n""")
def risk_of_last_value(spark, sf_dir):
    """Risk classes forecast by today's own class, scored on the test years."""
    rows = _dense_target(spark, sf_dir)
    known = labels.risk_class(rows, "target", "cases", ["nation"], F.col("ano") <= 1998, "truth")
    known = labels.risk_class(known, "cases", "cases", ["nation"], F.col("ano") <= 1998, "guess").where("ano > 1999")
    return metrics.with_macro(metrics.class_metrics(known, "truth", "guess")).withColumnRenamed("class", "label")


@query("cluster_id:int n_rows:bigint quantity:r6", f"""{_LINEAR}, z as (select quantity, (quantity - (select avg(quantity) from o)) / (select stddev_pop(quantity) from o) as zq, (coalesce(discount, 0) - (select avg(discount) from o)) / (select stddev_pop(discount) from o) as zd from o),
    d as (select quantity, [(zq + 1) * (zq + 1) + zd * zd, (zq - 0.5) * (zq - 0.5) + (zd - 1) * (zd - 1), (zq - 0.5) * (zq - 0.5) + (zd + 1) * (zd + 1)] as ds from z)
    select list_position(ds, list_min(ds)) - 1 as cluster_id, count(*) as n_rows, sum(quantity) as quantity from d group by 1""")
def nearest_centers(spark, sf_dir):
    """Orders by the nearest of three given centers."""
    orders, columns = _orders(spark, sf_dir), ["quantity", "discount"]
    row = orders.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    found = cluster.nearest_center(orders, columns, {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}, [[-1.0, 0.0], [0.5, 1.0], [0.5, -1.0]])
    return found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").alias("quantity"))
