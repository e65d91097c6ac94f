"""Queries on whole tables: summaries, coverage, missing values, ranking scores, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, forecast, metrics, panel, profile, query as panel_query, ranking, sampling
from .base import CASES_SQL, DENSE_CTE, OBSERVED_CTE, cases, duck_week, query, table, tail_sql
from .panels import dense, flagged, observed

_YEAR = "substr(week, 1, 4)::int"


def _f_sql(c: str) -> str:
    return f"""select feature, anova_f, {tail_sql('within / 2', 'between / 2', 'anova_f * between / within')} as p_value from (select '{c}' as feature, count(*) - 1.0::double as between, sum(n) - count(*) as within, (sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) as anova_f
      from (select l_returnflag, count({c})::double as n, avg({c}) as m, var_pop({c}) as v from lineitem group by all) g) f"""


def _yearly(spark, sf_dir):
    return dense(spark, sf_dir).withColumn("ano", F.substring("week", 1, 4).cast("int"))


@query("ano:int total:double mean:r6 median:r6 most:double active_entities:bigint", f"with {DENSE_CTE} select {_YEAR} as ano, sum(cases) as total, avg(cases) as mean, median(cases) as median, max(cases) as most, count(distinct case when cases > 0 then nation end) as active_entities from dense group by 1")
def yearly_summary(spark, sf_dir):
    return profile.yearly_summary(_yearly(spark, sf_dir), "ano", "cases", "nation")


@query("ano:int n_rows:bigint entities:bigint total:double first_week:string last_week:string", f"with {OBSERVED_CTE} select {_YEAR} as ano, count(*) as n_rows, count(distinct nation) as entities, sum(cases) as total, min(week) as first_week, max(week) as last_week from obs group by 1")
def temporal_coverage(spark, sf_dir):
    o = observed(spark, sf_dir).withColumn("ano", F.substring("week", 1, 4).cast("int"))
    return profile.temporal_coverage(o, "ano", "nation", "week", "cases")


@query("custkey:bigint n_rows:bigint first_week:string last_week:string total:bigint observed:int", f"""with c as (select custkey, {duck_week('d')} as week from ({CASES_SQL}) z), p as (select custkey, week, count(*) as cases from c group by all),
    s as (select custkey, count(*) as n_rows, min(week) as first_week, max(week) as last_week, sum(cases) as total from p group by custkey)
    select r.c_custkey as custkey, coalesce(n_rows, 0) as n_rows, first_week, last_week, coalesce(total, 0) as total, (n_rows is not null)::int as observed from customer r left join s on s.custkey = r.c_custkey""")
def entity_coverage(spark, sf_dir):
    return entity_coverage_rows(spark, sf_dir)


def entity_coverage_rows(spark, sf_dir):
    p = panel.case_panel(flagged(spark, sf_dir), ["custkey", "week"], [], [])
    return profile.entity_coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), p, "custkey", "week", "cases")


@query("entities:bigint observed:bigint unobserved:bigint coverage_pct:r6", f"""with s as (select distinct custkey from ({CASES_SQL}) z)
    select count(*) as entities, count(custkey) as observed, count(*) - count(custkey) as unobserved, round(100.0 * count(custkey) / count(*), 4) as coverage_pct from customer left join s on c_custkey = custkey""")
def coverage_summary(spark, sf_dir):
    return profile.coverage_summary(entity_coverage_rows(spark, sf_dir))


_STATS = "count(x) as n, avg(x) as mean, stddev_samp(x) as std, min(x) as min, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.75) as p75, max(x) as max, 100.0 * count(*) filter (x is null) / count(*) as missing_pct"


@query("feature:string n:bigint mean:r6 std:r6 min:r6 p25:r6 p50:r6 p75:r6 max:r6 missing_pct:r6", " union all ".join(f"select '{c}' as feature, {_STATS} from (select {e} as x from lineitem) t" for c, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "case when l_orderkey % 5 <> 0 then l_tax end"))))
def describe_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")))
    return profile.describe(li, ["l_quantity", "l_discount", "l_tax"])


@query("feature:string pearson:r6", " union all ".join(f"select '{c}' as feature, corr(l_extendedprice, {c}) as pearson from lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def correlation_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("flat", F.lit(1.0))
    return profile.correlations(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "flat"])


@query("feature:string pearson:r6", "select * from (" + " union all ".join(f"select '{c}' as feature, corr(l_extendedprice, {c}) as pearson from lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ") t order by abs(pearson) desc, feature limit 2")
def correlation_top(spark, sf_dir):
    return profile.correlations(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 2)


_MISSING = ("case_id", "notified_on", "week_text", "flag_a", "place_a", "sex")


@query("column:string missing_count:bigint missing_pct:r6 unique_values:bigint".replace("column", "name"), f"with c as ({CASES_SQL}) " + " union all ".join(f"select '{c}' as name, count(*) filter ({c} is null) as missing_count, round(100.0 * count(*) filter ({c} is null) / count(*), 4) as missing_pct, count(distinct {c}) as unique_values from c" for c in _MISSING))
def missingness_profile(spark, sf_dir):
    return profile.missingness(cases(spark, sf_dir).select(*_MISSING)).withColumnRenamed("column", "name")


@query("n_rows:bigint entities:bigint years:bigint total:double first_week:string last_week:string regions:string null_nation:bigint null_week:bigint repeated_keys:bigint", f"""with {OBSERVED_CTE}, o as (select obs.*, r_name as region, {_YEAR} as ano from obs join nation on n_nationkey = nation join region on r_regionkey = n_regionkey)
    select count(*) as n_rows, count(distinct nation) as entities, count(distinct ano) as years, sum(cases) as total, min(week) as first_week, max(week) as last_week, (select string_agg(region, ',' order by region) from (select distinct region from o) u) as regions,
    count(*) filter (nation is null) as null_nation, count(*) filter (week is null) as null_week, 0 as repeated_keys from o""")
def quality_summary(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region"))
    o = observed(spark, sf_dir).join(F.broadcast(names), "nation").withColumn("ano", F.substring("week", 1, 4).cast("int"))
    return profile.quality_summary(o, "nation", "ano", "week", "cases", "region", ["nation", "week"])


@query("value:string n:bigint", f"select upper(trim(coalesce(place_a, ''))) as value, count(*) as n from ({CASES_SQL}) c group by 1 order by n desc, value limit 20")
def code_frequency(spark, sf_dir):
    from ..functions.codes import canonical

    return profile.frequencies(cases(spark, sf_dir), canonical(F.col("place_a")))


@query("total:double mean:r6 median:r6 std:r6 cv:r6 q75:r6 q90:r6 peak:string", f"with {DENSE_CTE}, w as (select week, sum(cases) as cases from dense group by week) select sum(cases) as total, avg(cases) as mean, median(cases) as median, stddev_samp(cases) as std, stddev_samp(cases) / avg(cases) as cv, quantile_cont(cases, 0.75) as q75, quantile_cont(cases, 0.9) as q90, (select week from w order by cases desc, week limit 1) as peak from w")
def dataset_summary(spark, sf_dir):
    w = profile.period_totals(dense(spark, sf_dir), ["week"], "cases").withColumnRenamed("total", "cases")
    return profile.dataset_summary(w, "cases", "week")


@query("l_returnflag:string l_linestatus:string n_rows:bigint mean:r6 median:r6 most:double", "select l_returnflag, l_linestatus, count(*) as n_rows, avg(l_quantity) as mean, median(l_quantity) as median, max(l_quantity) as most from lineitem group by all")
def group_summary(spark, sf_dir):
    return profile.group_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("split:string o_orderstatus:string n:bigint share:r6", """select *, n / sum(n) over (partition by split) as share from (select case when year(cast(o_orderdate as date)) <= 1998 then 'train' when year(cast(o_orderdate as date)) <= 1999 then 'validation' else 'test' end as split, o_orderstatus, count(*) as n from orders group by all) t""")
def class_shares_by_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("split", forecast.split_by_year(F.year("o_orderdate"), 1998, 1999))
    return profile.class_shares(o, "o_orderstatus", "split")


_CATALOG = "select row_number() over () - 1 as position, column_name as name, (null_percentage > 0)::int as nullable, (column_name in ('o_orderkey'))::int as in_key from (summarize orders)"


@query("position:int name:string nullable:int in_key:int", _CATALOG)
def schema_document(spark, sf_dir):
    return profile.schema_document(table(spark, sf_dir, "orders"), ["o_orderkey"], "order")


@query("position:int name:string nullable:int in_key:int", """select * from (values (0, 'nation', 0, 1), (1, 'week', 0, 1), (2, 'cases', 0, 0), (3, 'severe', 1, 0), (4, 'price', 0, 0)) t(position, name, nullable, in_key)""")
def panel_schema_document(spark, sf_dir):
    return profile.schema_document(observed(spark, sf_dir), ["nation", "week"], "entity x week")


@query("feature:string group:string description:string missing_pct:r6".replace("group", "kind"), f"""with {OBSERVED_CTE} select feature, kind, case kind when 'identificacao' then 'keys and names of the row''s entity and period' when 'volume' then 'counts of records' when 'proporcao_clinica' then 'shares of records with a clinical sign' else 'means of several shares' end as description, case feature when 'prop_severe' then (select 100.0 * count(*) filter (severe is null) / count(*) from obs) else 0 end as missing_pct
    from (values ('nation', 'identificacao'), ('week', 'identificacao'), ('notificacoes', 'volume'), ('prop_severe', 'proporcao_clinica'), ('indice_price', 'indice_composto')) t(feature, kind)""")
def feature_catalog(spark, sf_dir):
    o = observed(spark, sf_dir).withColumnsRenamed({"cases": "notificacoes", "severe": "prop_severe", "price": "indice_price"})
    return profile.feature_catalog(o, ("nation", "week")).withColumnRenamed("group", "kind")


@query("feature:string description:string", f"""with {OBSERVED_CTE} select 'prop_severe' as feature, 'shares of records with a clinical sign' as description""")
def catalog_lookup(spark, sf_dir):
    o = observed(spark, sf_dir).withColumnsRenamed({"cases": "notificacoes", "severe": "prop_severe", "price": "indice_price"})
    return panel_query.catalog_entry(profile.feature_catalog(o, ("nation", "week")), "prop_severe")


@query("mode:string feature:string rows_known:bigint", """select mode, feature, (select count(*) from lineitem) as rows_known from (values ('intensity', 'notificacoes'), ('intensity', 'notificacoes_lag_1'), ('intensity', 'qt_lines'), ('intensity', 'indice_tax'),
    ('profile', 'qt_lines'), ('profile', 'indice_tax')) t(mode, feature)""")
def clustering_columns(spark, sf_dir):
    """Columns that either clustering takes of a table with keys, texts and labels, and their known rows."""
    names = {"l_orderkey": "entity", "l_linestatus": "uf", "l_quantity": "notificacoes", "l_extendedprice": "notificacoes_lag_1", "l_linenumber": "qt_lines", "l_tax": "indice_tax", "l_discount": "label_alert", "l_partkey": "cluster_id"}
    li = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(n) for c, n in names.items()])
    chosen = [(mode, c) for mode in ("intensity", "profile") for c in cluster.feature_columns(li, ("entity",), profile=mode == "profile")]
    known = li.agg(*[F.count(c).alias(c) for c in dict.fromkeys(c for _, c in chosen)]).unpivot([], list(dict.fromkeys(c for _, c in chosen)), "feature", "rows_known")
    return spark.createDataFrame(chosen, "mode string, feature string").join(F.broadcast(known), "feature")


_LABELINGS = """x as (select o_orderkey, o_totalprice, case when o_totalprice > 150000 then 'high' when o_totalprice > 50000 then 'low' end as intensity, case when o_custkey % 3 = 0 then 'b' else 'a' end as profile from orders)"""


@query("intensity:string profile:string n_rows:bigint mean:r6", f"with {_LABELINGS} select intensity, profile, count(*) as n_rows, avg(o_totalprice) as mean from x group by all")
def labelings_crossed(spark, sf_dir):
    """Two labelings, one of them partial, attached by key and crossed."""
    o = table(spark, sf_dir, "orders")
    first = o.where("o_totalprice > 50000").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, "high").otherwise("low").alias("cluster_label"))
    second = o.select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "b").otherwise("a").alias("cluster_label"))
    return cluster.cross_summary(cluster.labelings_attached(o, ["o_orderkey"], {"intensity": first, "profile": second}), "intensity", "profile", "o_totalprice")


@query("o_orderkey:bigint o_totalprice:double label:string", f"""with {_LABELINGS} select s.o_orderkey, s.o_totalprice, profile as label from (select * from orders order by md5(o_orderkey::varchar || '|42'), o_orderkey limit 1000) s
    join x on x.o_orderkey = s.o_orderkey""")
def sample_assigned(spark, sf_dir):
    """A hash sample with the labels of its rows."""
    o, keys = table(spark, sf_dir, "orders"), ["o_orderkey"]
    labels = o.select(*keys, F.when(F.col("o_custkey") % 3 == 0, "b").otherwise("a").alias("label"))
    return cluster.sample_assigned(sampling.hash_sample(o.select(*keys, "o_totalprice"), keys, 1000), labels, keys)


@query("cluster_label:string n_rows:bigint mean:r6", """with r as (select k, row_number() over (order by m, k) as r from (select o_custkey % 5 as k, median(o_totalprice) as m from orders group by 1) t)
    select case least(r, 3) when 1 then 'low' when 2 then 'middle' else 'high' end as cluster_label, count(*) as n_rows, avg(o_totalprice) as mean from orders join r on k = o_custkey % 5 group by 1""")
def cluster_order(spark, sf_dir):
    """Names of given clusters by the rank of their median; the last name serves all further ones."""
    o = table(spark, sf_dir, "orders").withColumn("cluster_id", F.col("o_custkey") % 5)
    named = cluster.ordered_labels(o, "o_totalprice", ["low", "middle", "high"])
    return named.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("o_totalprice").alias("mean"))


@query("cluster_id:bigint n_rows:bigint inertia:r6", """select k as cluster_id, count(*) as n_rows, sum((q - mq) * (q - mq) + (x - mx) * (x - mx)) as inertia from (select *, avg(q) over (partition by k) as mq, avg(x) over (partition by k) as mx
    from (select l_suppkey % 4 as k, l_quantity as q, l_tax * 100 as x from lineitem) t) u group by k""")
def cluster_inertia(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("cluster_id"), "l_quantity", (F.col("l_tax") * 100).alias("tax"))
    return cluster.inertia(li, ["l_quantity", "tax"])


@query("test_year:int validation_year:int train_until:int n_train:bigint n_validation:bigint n_test:bigint", f"""with {DENSE_CTE}, y as (select {_YEAR} as y, count(*) as n from dense group by 1), f as (select y as test_year from y, (select min(y) as a, max(y) as b from y) z where y >= a + 4 and ((y - a - 4) % 3 = 0 or y = b))
    select test_year, test_year - 1 as validation_year, test_year - 2 as train_until, coalesce(sum(n) filter (y <= test_year - 2), 0) as n_train, coalesce(sum(n) filter (y = test_year - 1), 0) as n_validation, sum(n) filter (y = test_year) as n_test from f join y on y <= test_year group by test_year""")
def walk_forward_folds(spark, sf_dir):
    return forecast.fold_rows(_yearly(spark, sf_dir), "ano", first_after=4)


@query("feature:string anova_f:r6 p_value:r6", "select * from (" + " union all ".join(_f_sql(c) for c in ("l_quantity", "l_discount", "l_tax")) + ") t order by anova_f desc, feature limit 2")
def top_features(spark, sf_dir):
    return panel_query.top_features(ranking.anova_f(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount", "l_tax"]), "anova_f", 2)


@query("l_orderkey:bigint l_partkey:bigint n:bigint", "select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return profile.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("o_orderkey:bigint price:r6 odd:r6", "select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_totalprice end, (select median(o_totalprice) from orders where o_orderkey % 3 <> 0)) as price, coalesce(case when o_orderkey % 5 <> 0 then o_totalprice end, 0) as odd from orders")
def impute_median_or_zero(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("odd"))
    return profile.fill_median(o, ["price"]).fillna({"odd": 0.0})


@query("l_returnflag:string n:bigint total:r6", "select l_returnflag, count(*) as n, sum(l_quantity) as total from lineitem group by l_returnflag")
def column_filters(spark, sf_dir):
    """Constant, mostly missing and barely covered columns go; what stays is summed."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.lit(1.0).alias("constant"), F.lit(None).cast("double").alias("empty"), F.when(F.col("l_orderkey") == 1, 1.0).alias("rare"), F.col("l_tax").alias("x_con_fhd"))
    keep = profile.informative_columns(li, ["l_quantity", "constant", "empty", "rare", "x_con_fhd"])
    keep = profile.covered_columns(li, profile.known_columns(li, keep, banned="con_fhd"))
    return li.select("l_returnflag", *keep).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(keep[0]).alias("total"))


_VALUES = ("l_quantity", "l_discount", "l_tax")


@query("feature:string anova_f:r6", " union all ".join(map(_f_sql, _VALUES)))
def anova_f(spark, sf_dir):
    return ranking.anova_f(table(spark, sf_dir, "lineitem"), "l_returnflag", list(_VALUES))


def _mi_sql(c: str) -> str:
    code = " + ".join(f"({c} > q[{i}])::int" for i in range(1, 5))
    return f"""select '{c}' as feature, sum(n / t * ln(n * t / (nx * ny))) as mutual_information from (
      select *, sum(n) over () as t, sum(n) over (partition by b) as nx, sum(n) over (partition by l_returnflag) as ny from (
        select l_returnflag, {code} as b, count(*)::double as n from lineitem, (select quantile_cont({c}, [0.2, 0.4, 0.6, 0.8]) as q from lineitem) z group by all) u) w"""


@query("feature:string mutual_information:r6", " union all ".join(map(_mi_sql, _VALUES)))
def binned_mutual_information(spark, sf_dir):
    return ranking.mutual_information(table(spark, sf_dir, "lineitem"), "l_returnflag", list(_VALUES), bins=5)


_SCORES = "with s as (select a.feature, anova_f, mutual_information from (" + " union all ".join(map(_f_sql, _VALUES)) + ") a join (" + " union all ".join(map(_mi_sql, _VALUES)) + ") b on a.feature = b.feature)"


@query("feature:string anova_f_norm:r6 mutual_information_norm:r6 composite_score:r6 rank:int selected:int", _SCORES + """, n as (select *, (anova_f - min(anova_f) over ()) / (max(anova_f) over () - min(anova_f) over ()) as anova_f_norm, (mutual_information - min(mutual_information) over ()) / (max(mutual_information) over () - min(mutual_information) over ()) as mutual_information_norm from s),
    c as (select *, (anova_f_norm + mutual_information_norm) / 2 as composite_score from n), r as (select *, row_number() over (order by composite_score desc, feature) as rank from c)
    select *, (rank <= 1 or composite_score >= (select quantile_cont(composite_score, 0.75) from c))::int as selected from r""")
def composite_ranking(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    scores = ranking.anova_f(li, "l_returnflag", list(_VALUES)).join(ranking.mutual_information(li, "l_returnflag", list(_VALUES), bins=5), "feature")
    return ranking.composite_ranking(scores, ["anova_f", "mutual_information"], top=1)


@query("l_orderkey:bigint l_linenumber:int l_quantity:r6 l_tax:r6", "select l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as l_quantity, (l_tax - avg(l_tax) over ()) / stddev_pop(l_tax) over () as l_tax from lineitem")
def zscore(spark, sf_dir):
    return cluster.zscores(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


_PRED = "p as (select l_returnflag, l_quantity as y, l_extendedprice / 40.0 * (1 + l_tax) as p from lineitem)"


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 40.0 * (1 + F.col("l_tax"))).alias("p"))


@query("l_returnflag:string rmse:r6 mae:r6 r2:r6 mape:r6", f"with {_PRED} select l_returnflag, sqrt(avg((y - p) * (y - p))) as rmse, avg(abs(y - p)) as mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) as r2, 100 * avg(abs(y - p) / y) filter (y > 0) as mape from p group by l_returnflag")
def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(_predictions(spark, sf_dir), "y", "p", ["l_returnflag"])


_CLASSES = "k as (select case when l_quantity > 40 then 3 when l_quantity > 25 then 2 when l_quantity > 10 then 1 else 0 end as truth, case when l_extendedprice > 45000 then 3 when l_extendedprice > 28000 then 2 when l_extendedprice > 9000 then 1 else 0 end as guess, l_extendedprice as s, round(l_discount, 2) as s2 from lineitem)"


def _classified(spark, sf_dir):
    li, q, e = table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice")
    return li.select(F.when(q > 40, 3).when(q > 25, 2).when(q > 10, 1).otherwise(0).alias("truth"), F.when(e > 45000, 3).when(e > 28000, 2).when(e > 9000, 1).otherwise(0).alias("guess"), e.alias("s"), F.round("l_discount", 2).alias("s2"))


@query("truth:int guess:int n:bigint", f"with {_CLASSES} select truth, guess, count(*) as n from k group by all")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_classified(spark, sf_dir), "truth", "guess")


@query("class:int precision:r6 recall:r6 f1:r6 support:bigint".replace("class", "label"), f"""with {_CLASSES}, a as (select truth as label, count(*) as support, count(*) filter (truth = guess) as hit from k group by truth), b as (select guess as label, count(*) as said from k group by guess)
    , m as (select label, hit / said as precision, hit / support as recall, 2 * (hit / said) * (hit / support) / ((hit / said) + (hit / support)) as f1, support from a join b using (label))
    select * from m union all select null, avg(precision), avg(recall), avg(f1), sum(support) from m""")
def class_metrics(spark, sf_dir):
    return metrics.with_macro(metrics.class_metrics(_classified(spark, sf_dir), "truth", "guess")).withColumnRenamed("class", "label")


def _auc_sql(label: int, s: str) -> str:
    return f"""select {label} as label, (sum(r) filter (y) - p * (p + 1) / 2.0) / (p::double * (n - p)) as auc from (select *, count(*) filter (y) over () as p, count(*) over () as n from (
      select truth = {label} as y, rank() over (order by {s}) + (count(*) over (partition by {s}) - 1) / 2.0 as r from k) t) u group by p, n"""


@query("label:int auc:r6", f"with {_CLASSES}, a as ({_auc_sql(0, 's2')} union all {_auc_sql(3, 's')}) select * from a union all select null, avg(auc) from a")
def macro_auc(spark, sf_dir):
    return metrics.macro_auc(_classified(spark, sf_dir), "truth", {0: "s2", 3: "s"}).withColumnRenamed("class", "label")


def _t_sql(d: str) -> str:
    return f"""select *, {tail_sql('(n - 1) / 2.0', '0.5', 't * t / (n - 1)')} as p_value from (
      select avg(d) as mean_difference, avg(d) / (stddev_samp(d) / sqrt(count(d))) as t, count(d) as n from (select {d} as d from lineitem) x) y"""


@query("mean_difference:r6 t:r6 n:bigint p_value:r6", _t_sql("l_discount - l_tax"))
def paired_t(spark, sf_dir):
    return metrics.paired_t(_predictions(spark, sf_dir), "l_discount", "l_tax")


@query("mean_difference:r6 t:r6 n:bigint p_value:r6", _t_sql("l_discount - (0.05 + (l_orderkey % 7 - 3) / 100.0)"))
def paired_t_close(spark, sf_dir):
    """Two columns whose means are near one another, so that p is neither 0 nor 1."""
    rows = table(spark, sf_dir, "lineitem").select("l_discount", (F.lit(0.05) + (F.col("l_orderkey") % 7 - 3) / 100.0).alias("other"))
    return metrics.paired_t(rows, "l_discount", "other")
