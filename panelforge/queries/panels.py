"""Queries on the panel: aggregation, densify, windows, labels, climate and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, weeks
from ..operators import labels, panel, profile, query as panel_query, sampling, spatial, windows
from ..plans import panel as plans
from .base import CASES_SQL, DENSE_CTE, OBSERVED_CTE, PLACES, READINGS, STATIONS, cases, duck_week, proxy, query, twin


def flagged(spark, sf_dir):
    """Cases with their week and known flags."""
    c = cases(spark, sf_dir)
    return c.withColumns({"week": weeks.week_of(F.col("d")), "fa": codes.yes_no(F.col("flag_a")), "fb": codes.yes_no(F.col("flag_b"))})


def observed(spark, sf_dir):
    out = panel.case_panel(flagged(spark, sf_dir), ["nation", "week"], ["fa", "price"], [])
    return out.select("nation", "week", F.col("cases").cast("double").alias("cases"), F.col("fa").alias("severe"), "price")


def dense(spark, sf_dir):
    return panel.densify(observed(spark, sf_dir), ["nation"], ["week"], ["cases", "severe"]).select("nation", "week", "cases", "severe")


@query(
    "nation:int week:string cases:bigint fa:r6 fb:r6 n_fa:bigint n_fb:bigint status:string priority:string",
    f"""with {OBSERVED_CTE} select nation, week, count(*) as cases, avg(fa) as fa, avg(fb) as fb, coalesce(round(sum(fa)), 0) as n_fa, coalesce(round(sum(fb)), 0) as n_fb,
    min(struct_pack(s := status, p := priority)).s as status, min(struct_pack(s := status, p := priority)).p as priority from c group by nation, week""",
)
def entity_week_counts(spark, sf_dir):
    return panel.case_panel(flagged(spark, sf_dir), ["nation", "week"], ["fa", "fb"], ["fa", "fb"], ["status", "priority"])


@query("week:string cases:bigint fa:r6 price:r6", f"with {OBSERVED_CTE} select week, count(*) as cases, avg(fa) as fa, avg(price) as price from c group by week")
def national_week(spark, sf_dir):
    return panel.case_panel(flagged(spark, sf_dir), ["week"], ["fa", "price"], [])


@query(
    "week:string weight:bigint fa:r6 price:r6",
    f"""with {OBSERVED_CTE}, r as (select week, substr(week, 1, 4) || substr(week, 5) as k, count(*) as weight, avg(fa) as fa, avg(price) as price from c group by week, nation)
    select k as week, sum(weight) as weight, sum(fa * weight) / sum(case when fa is not null then weight end) as fa, sum(price * weight) / sum(weight) as price from r where substr(k, 1, 4)::int >= 2000 group by k""",
)
def weighted_merge(spark, sf_dir):
    rows = panel.case_panel(flagged(spark, sf_dir), ["nation", "week"], ["fa", "price"], [], count="weight")
    return panel.merge_weighted(rows, "week", "weight", ["fa", "price"], weeks.parse_week_short(F.col("week")))


@query("dropped_rows:bigint dropped_volume:bigint", f"with {OBSERVED_CTE} select count(*) as dropped_rows, sum(cases) as dropped_volume from obs where substr(week, 1, 4)::int < 2000")
def weighted_merge_losses(spark, sf_dir):
    rows = panel.case_panel(flagged(spark, sf_dir), ["nation", "week"], [], [], count="weight")
    return panel.merge_losses(rows, weeks.parse_week_short(F.col("week")), "weight")


@query("nation:int week:string cases:double severe:r6 origin:string", f"with {DENSE_CTE} select d.*, case when o.week is null then 'calendar_fill' else 'observed' end as origin from dense d left join obs o on o.nation = d.nation and o.week = d.week")
def dense_panel(spark, sf_dir):
    o = observed(spark, sf_dir).withColumn("origin", F.lit("observed"))
    return panel.densify(o, ["nation"], ["week"], ["cases", "severe"], {"origin": "calendar_fill"})


_W = "over (partition by nation order by week)"


def _frame(n: int) -> str:
    return f"over (partition by nation order by week rows between {n - 1} preceding and current row)"


_LAGS = ", ".join(f"lag(cases, {k}) {_W} as cases_lag_{k}" for k in windows.LAGS)


@query("nation:int week:string " + " ".join(f"cases_lag_{k}:double" for k in windows.LAGS), f"with {DENSE_CTE} select nation, week, " + ", ".join(f"coalesce(lag(cases, {k}) {_W}, 0) as cases_lag_{k}" for k in windows.LAGS) + " from dense")
def lags_zero(spark, sf_dir):
    return windows.lags(dense(spark, sf_dir), "cases", ["nation"], ["week"])


@query("nation:int week:string " + " ".join(f"cases_lag_{k}:double" for k in windows.LAGS), f"with {DENSE_CTE} select nation, week, {_LAGS} from dense")
def lags_null(spark, sf_dir):
    return windows.lags(dense(spark, sf_dir), "cases", ["nation"], ["week"], fill="null")


_TRAIL_SPEC = " ".join(f"cases_{a}_{n}:r6" for n in windows.SPANS for a in ("mean", "min", "max"))
_TRAIL = ", ".join(f"{f}(b) {_frame(n)} as cases_{a}_{n}" for n in windows.SPANS for a, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
_SHIFT0 = f"{DENSE_CTE}, s as (select *, coalesce(lag(cases) {_W}, 0) as b from dense)"
_SHIFTN = f"{DENSE_CTE}, s as (select *, lag(cases) {_W} as b from dense)"


@query(f"nation:int week:string {_TRAIL_SPEC} cases_std_8:r6", f"with {_SHIFT0} select nation, week, {_TRAIL}, coalesce(stddev_samp(b) {_frame(8)}, 0) as cases_std_8 from s")
def rolling_shifted(spark, sf_dir):
    return windows.trailing(dense(spark, sf_dir), "cases", ["nation"], ["week"])


@query(f"nation:int week:string {_TRAIL_SPEC} cases_std_3:r6 cases_std_12:r6", f"with {_SHIFTN} select nation, week, {_TRAIL}, stddev_samp(b) {_frame(3)} as cases_std_3, stddev_samp(b) {_frame(12)} as cases_std_12 from s")
def rolling_null_kept(spark, sf_dir):
    return windows.trailing(dense(spark, sf_dir), "cases", ["nation"], ["week"], std_spans=(3, 12), fill="null")


def _change(k: int) -> str:
    return f"(cases - lag(cases, {k}) {_W}) / nullif(lag(cases, {k}) {_W}, 0)"


@query("nation:int week:string cases_diff_1:double cases_diff_4:double cases_pct_1:r6 cases_pct_4:r6 cases_accel:double", f"""with {DENSE_CTE}, g as (select *, coalesce(cases - lag(cases) {_W}, 0) as cases_diff_1, coalesce(cases - lag(cases, 4) {_W}, 0) as cases_diff_4,
    coalesce({_change(1)}, 0) as cases_pct_1, coalesce({_change(4)}, 0) as cases_pct_4 from dense) select *, coalesce(cases_diff_1 - lag(cases_diff_1) {_W}, 0) as cases_accel from g""")
def changes_zero(spark, sf_dir):
    return windows.changes(dense(spark, sf_dir), "cases", ["nation"], ["week"])


@query("nation:int week:string cases_diff_1:double cases_pct_1:r6 cases_accel:double", f"with {DENSE_CTE}, g as (select *, cases - lag(cases) {_W} as cases_diff_1, {_change(1)} as cases_pct_1 from dense) select *, cases_diff_1 - lag(cases_diff_1) {_W} as cases_accel from g")
def changes_null_kept(spark, sf_dir):
    return windows.changes(dense(spark, sf_dir), "cases", ["nation"], ["week"], (1,), "null")


@query("nation:int week:string cases_ratio_4:r6 cases_ratio_8:r6 is_zero:int", f"with {_SHIFT0} select nation, week, coalesce(cases / nullif(avg(b) {_frame(4)}, 0), 0) as cases_ratio_4, coalesce(cases / nullif(avg(b) {_frame(8)}, 0), 0) as cases_ratio_8, (cases = 0)::int as is_zero from s")
def ratio_to_mean(spark, sf_dir):
    out = windows.trailing(dense(spark, sf_dir), "cases", ["nation"], ["week"], (4, 8))
    return windows.ratios(out, "cases").withColumn("is_zero", windows.is_zero(F.col("cases")))


@query("nation:int week:string alert_q75:int alert_q90:int plain_q90:int", f"""with {DENSE_CTE}, q as (select nation, quantile_cont(cases, 0.75) as a, quantile_cont(cases, 0.9) as b from dense group by nation)
    select d.nation, week, (cases >= a and cases > 0)::int as alert_q75, (cases >= b and cases > 0)::int as alert_q90, (cases >= b)::int as plain_q90 from dense d join q on q.nation = d.nation""")
def quantile_alerts(spark, sf_dir):
    out = labels.quantile_alerts(dense(spark, sf_dir), "cases", ["nation"], {"alert_q75": 0.75, "alert_q90": 0.9})
    return labels.quantile_alerts(out, "cases", ["nation"], {"plain_q90": 0.9}, positive=False)


_LABELS = f"""with {_SHIFT0}, t as (select *, avg(b) {_frame(8)} as m8, coalesce(stddev_samp(b) {_frame(8)}, 0) as s8, coalesce({_change(1)}, 0) as pct from s),
    q as (select nation, quantile_cont(cases, 0.9) as q90, quantile_cont(pct, 0.75) as p75 from t group by nation),
    l as (select t.*, (pct >= p75 and cases > 0)::int as fast_growth, (cases >= q90 and cases > 0)::int as alert_q90, (round(cases, 9) >= round(m8 + 2 * s8, 9) and cases > 0)::int as outbreak from t join q on q.nation = t.nation)"""


@query("nation:int week:string cases:double outbreak:int", _LABELS + " select * from l")
def local_outbreak(spark, sf_dir):
    out = windows.trailing(dense(spark, sf_dir), "cases", ["nation"], ["week"], (8,))
    return out.withColumn("outbreak", labels.outbreak(F.col("cases"), F.col("cases_mean_8"), F.col("cases_std_8")))


@query("nation:int week:string cases:double fast_growth:int alert_q90:int outbreak:int critical:int", _LABELS + " select *, (cases > 0 and (alert_q90 = 1 or outbreak = 1 or severe >= 0.05))::int as critical from l")
def labelled_panel(spark, sf_dir):
    """The whole panel build: all window features and labels in one plan."""
    return plans.labelled_panel(observed(spark, sf_dir).drop("price"), ["nation"], "week", "cases", "severe")


@query("nation:int p50:r6 p75:r6 p90:r6", f"with {DENSE_CTE} select nation, quantile_cont(cases, 0.5) as p50, quantile_cont(cases, 0.75) as p75, quantile_cont(cases, 0.9) as p90 from dense group by nation")
def entity_percentiles(spark, sf_dir):
    return labels.thresholds(dense(spark, sf_dir), "cases", ["nation"], [0.5, 0.75, 0.9])


_TARGET = f"{DENSE_CTE}, f as (select *, lead(cases, 4) {_W} as target from dense)"


@query("nation:int week:string target:double", f"with {_TARGET} select * from f where target is not null")
def lead_target(spark, sf_dir):
    return windows.leads(dense(spark, sf_dir), "cases", ["nation"], ["week"], 4)


def _risk(train: str) -> str:
    return f"""with {_TARGET}, q as (select nation, quantile_cont(cases, 0.5) as p50, quantile_cont(cases, 0.75) as p75, quantile_cont(cases, 0.9) as p90 from f where target is not null and {train} group by nation)
    select f.nation, week, case when target > p90 then 3 when target > p75 then 2 when target > p50 then 1 else 0 end as risk from f left join q on q.nation = f.nation where target is not null"""


@query("nation:int week:string risk:int", _risk("true"))
def risk_class(spark, sf_dir):
    return labels.risk_class(windows.leads(dense(spark, sf_dir), "cases", ["nation"], ["week"], 4), "target", "cases", ["nation"])


@query("nation:int week:string risk:int", _risk("substr(week, 1, 4) <= '1999'"))
def risk_class_train_thresholds(spark, sf_dir):
    return labels.risk_class(windows.leads(dense(spark, sf_dir), "cases", ["nation"], ["week"], 4), "target", "cases", ["nation"], train=F.substring("week", 1, 4) <= "1999")


_WEEKLY = f"""r as (select *, {duck_week('day')} as week from ({twin(READINGS)}) z),
    dy as (select station, week, day, sum(rain) as dr from r group by all),
    dd as (select station, week, count(*) filter (dr > 0) as rain_days, count(*) filter (dr >= 10) as rain_heavy_days from dy group by all),
    k as (select station, week, coalesce(sum(rain), 0) as rain_sum, avg(rain) as rain_mean, avg(temp) as temp_mean, min(temp_lo) as temp_min, max(temp_hi) as temp_max, avg(humidity) as humidity_mean,
      count(temp) as n_valid_hours, max(temp_hi) - min(temp_lo) as temp_range, (count(temp) < 84)::int as low_coverage from r group by station, week),
    sw as (select k.*, dd.rain_days, dd.rain_heavy_days from k join dd on dd.station = k.station and dd.week = k.week)"""
_WEEKLY_SPEC = "station:int week:string rain_sum:r6 rain_mean:r6 temp_mean:r6 temp_min:r6 temp_max:r6 humidity_mean:r6 n_valid_hours:bigint rain_days:bigint rain_heavy_days:bigint temp_range:r6 low_coverage:int"


def weekly(spark, sf_dir):
    r = proxy(spark, sf_dir, READINGS).withColumn("week", weeks.week_of(F.col("day")))
    return panel.station_weeks(r, ["station", "week"], "day", "rain", "temp", "temp_lo", "temp_hi", {"humidity": "humidity"})


@query(_WEEKLY_SPEC, f"with {_WEEKLY} select * from sw")
def station_week(spark, sf_dir):
    return weekly(spark, sf_dir)


@query("ano:int stations:bigint station_weeks:bigint low_coverage_pct:r6", f"with {_WEEKLY} select substr(week, 1, 4)::int as ano, count(distinct station) as stations, count(*) as station_weeks, round(100.0 * sum(low_coverage) / count(*), 2) as low_coverage_pct from sw group by 1")
def station_coverage_by_year(spark, sf_dir):
    return profile.low_coverage_by_year(weekly(spark, sf_dir).withColumn("ano", F.substring("week", 1, 4).cast("int")), "ano", "station")


_SW = "over (partition by station order by week)"
_SF = "over (partition by station order by week rows between 3 preceding and current row)"


@query("station:int week:string rain_sum_lag_1:r6 rain_sum_lag_8:r6 temp_mean_lag_2:r6 rain_heavy_days_lag_4:bigint temp_range_lag_2:r6 rain_sum_roll_4:r6 temp_mean_roll_4:r6", f"""with {_WEEKLY} select station, week, lag(rain_sum) {_SW} as rain_sum_lag_1, lag(rain_sum, 8) {_SW} as rain_sum_lag_8, lag(temp_mean, 2) {_SW} as temp_mean_lag_2, lag(rain_heavy_days, 4) {_SW} as rain_heavy_days_lag_4,
    lag(temp_range, 2) {_SW} as temp_range_lag_2, case when count(rain_sum) {_SF} >= 2 then avg(rain_sum) {_SF} end as rain_sum_roll_4, case when count(temp_mean) {_SF} >= 2 then avg(temp_mean) {_SF} end as temp_mean_roll_4 from sw""")
def climate_lags(spark, sf_dir):
    return plans.climate_features(weekly(spark, sf_dir), ["station"], ["week"])


_GAPS = f"""with {_WEEKLY}, g as (select *, datediff('day', date '1970-01-04', make_date(substr(week, 1, 4)::int, 1, 4) - dayofweek(make_date(substr(week, 1, 4)::int, 1, 4))::int) // 7 + substr(week, 5, 2)::int as num from sw
    where (station + substr(week, 5, 2)::int) % 3 <> 0)"""


def _apart(c: str, k: int) -> str:
    return f"(select any_value(b.{c}) from g b where b.station = g.station and b.num = g.num - {k}) as {c}_lag_{k}"


def _roll(c: str) -> str:
    return f"(select case when count(b.{c}) >= 2 then avg(b.{c}) end from g b where b.station = g.station and b.num between g.num - 3 and g.num) as {c}_roll_4"


@query("station:int week:string rain_sum_lag_1:r6 rain_sum_lag_8:r6 temp_mean_lag_2:r6 rain_heavy_days_lag_4:bigint temp_range_lag_2:r6 rain_sum_roll_4:r6 temp_mean_roll_4:r6", f"""{_GAPS} select station, week, {_apart('rain_sum', 1)}, {_apart('rain_sum', 8)}, {_apart('temp_mean', 2)}, {_apart('rain_heavy_days', 4)}, {_apart('temp_range', 2)}, {_roll('rain_sum')}, {_roll('temp_mean')} from g""")
def climate_lags_by_week(spark, sf_dir):
    """A third of each station's weeks is missing; lags and means go by the weeks' distance."""
    some = weekly(spark, sf_dir).where((F.col("station") + F.substring("week", 5, 2).cast("int")) % 3 != 0)
    return plans.climate_features(some, ["station"], ["week"], by_week=True)


def _km(a: str, b: str) -> str:
    return f"12742.0 * asin(least(sqrt(sin(radians({b}.latitude - {a}.latitude) / 2) * sin(radians({b}.latitude - {a}.latitude) / 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * sin(radians({b}.longitude - {a}.longitude) / 2) * sin(radians({b}.longitude - {a}.longitude) / 2)), 1.0))"


_PAIRS = f"x as (select p.place, s.site, {_km('p', 's')} as km from ({twin(PLACES)}) p cross join ({twin(STATIONS)}) s)"


def _mapping(spark, sf_dir):
    return spatial.nearest_site(proxy(spark, sf_dir, PLACES), proxy(spark, sf_dir, STATIONS))


@query("place:int site:int distance_km:double n_within_50km:bigint n_within_100km:bigint uncovered:int", f"""with {_PAIRS} select place, arg_min(site, struct_pack(k := km, s := site)) as site, round(min(km), 2) as distance_km, count(*) filter (km <= 50) as n_within_50km, count(*) filter (km <= 100) as n_within_100km,
    (round(min(km), 2) > 100)::int as uncovered from x group by place""")
def nearest_station(spark, sf_dir):
    return _mapping(spark, sf_dir)


@query("place:int week:string rain_sum:r6", f"""with {_PAIRS}, {_WEEKLY}, n as (select place, arg_min(site, struct_pack(k := km, s := site)) as site from x group by place)
    select n.place, sw.week, sw.rain_sum from n join ({twin(STATIONS)}) s on s.site = n.site join sw on sw.station = s.station""")
def nearest_station_weeks(spark, sf_dir):
    readings = weekly(spark, sf_dir).join(proxy(spark, sf_dir, STATIONS).select("site", "station"), "station")
    return spatial.nearest_values(_mapping(spark, sf_dir), readings)


@query("place:int week:string rain_sum:r6 temp_mean:r6", f"""with {_PAIRS}, {_WEEKLY}, w as (select place, site, 1.0 / pow(greatest(km, 0.001), 2) as w from x where km <= 150)
    select w.place, sw.week, sum(sw.rain_sum * w) / sum(case when sw.rain_sum is not null then w end) as rain_sum, sum(sw.temp_mean * w) / sum(case when sw.temp_mean is not null then w end) as temp_mean
    from w join ({twin(STATIONS)}) s on s.site = w.site join sw on sw.station = s.station group by w.place, sw.week""")
def inverse_distance_weeks(spark, sf_dir):
    stations = proxy(spark, sf_dir, STATIONS)
    readings = weekly(spark, sf_dir).join(stations.select("site", "station"), "station")
    return spatial.inverse_distance(proxy(spark, sf_dir, PLACES), stations, readings, ["week"], ["rain_sum", "temp_mean"], within_km=150)


_CLIMATE = f"""c as (select *, {duck_week('d')} as week from ({CASES_SQL}) z), p as (select custkey % 150 as station, week, count(*) as cases from c group by all), {_WEEKLY},
    cl as (select station, '1995' || substr(week, 5) as week, rain_sum from sw where station % 3 <> 0 union all select station, '1995' || substr(week, 5) as week, rain_sum + 1 from sw where station % 6 = 1),
    one as (select station, week, min(rain_sum) as rain_sum from cl group by all), i as (select p.station, p.week, p.cases, one.rain_sum from p left join one on one.station = p.station and one.week = p.week)"""


def _integrated(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("week", weeks.week_of(F.col("d"))).withColumn("station", (F.col("custkey") % 150).cast("int"))
    p = panel.case_panel(c, ["station", "week"], [], [])
    w = weekly(spark, sf_dir).withColumn("week", F.concat(F.lit("1995"), F.substring("week", 5, 2)))
    climate = w.where("station % 3 <> 0").unionByName(w.where("station % 6 = 1").withColumn("rain_sum", F.col("rain_sum") + 1))
    return plans.with_climate(p, climate, ["station", "week"], ["rain_sum"])


@query("station:int week:string cases:bigint rain_sum:r6", f"with {_CLIMATE} select * from i")
def climate_left_join(spark, sf_dir):
    return _integrated(spark, sf_dir)


@query("ano:int n_rows:bigint n_joined:bigint joined_pct:r6", f"with {_CLIMATE} select substr(week, 1, 4)::int as ano, count(*) as n_rows, count(rain_sum) as n_joined, round(100.0 * count(rain_sum) / count(*), 2) as joined_pct from i group by 1")
def join_coverage(spark, sf_dir):
    return profile.join_coverage(_integrated(spark, sf_dir).withColumn("ano", F.substring("week", 1, 4).cast("int")), "ano", "rain_sum")


@query("nation:int week:string cases:double", f"with {DENSE_CTE} select * from dense where nation = 7 and week between '199640' and '199812' order by week")
def series_query(spark, sf_dir):
    return panel_query.series(dense(spark, sf_dir), "nation", 7, "week", "199640", "199812")


@query("week:string total:double", f"with {DENSE_CTE} select week, sum(cases) as total from dense where substr(week, 1, 4) = '1998' group by week order by total desc, week limit 10")
def top_weeks(spark, sf_dir):
    return panel_query.top_weeks(dense(spark, sf_dir).withColumn("year", F.substring("week", 1, 4).cast("int")), "week", "cases", 10, 1998)


@query("week:string total:double", f"with {DENSE_CTE} select week, sum(cases) as total from dense group by week order by total desc, week limit 30")
def peak_weeks(spark, sf_dir):
    return profile.peaks(dense(spark, sf_dir), ["week"], "cases", 30)


@query("nation:int week:string cases:double", f"with {DENSE_CTE} select * from dense order by md5(nation::varchar || '|' || week || '|42'), nation, week limit 500")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(dense(spark, sf_dir), ["nation", "week"], 500)


@query("nation:int week:string", f"with {DENSE_CTE} select * from (select *, row_number() over (partition by substr(week, 1, 4) order by md5(nation::varchar || '|' || week || '|42'), nation, week) as n from dense) t where n <= 40")
def stratified_cap(spark, sf_dir):
    return sampling.stratified_cap(dense(spark, sf_dir), [F.substring("week", 1, 4)], ["nation", "week"], 40)


@query("nation:int week:string cases:double", f"""with {DENSE_CTE} select * from (select *, row_number() over (partition by cast('0x' || substr(md5(nation::varchar), 1, 8) as bigint) % 8 order by md5(nation::varchar || '|' || week || '|42'), nation, week) as n from dense where cases > 0) t where n <= 200""")
def active_sample(spark, sf_dir):
    return sampling.active_sample(dense(spark, sf_dir), "cases", "nation", ["nation", "week"], 8, 200)
