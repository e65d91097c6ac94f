"""Queries on single records: normalisers, weeks, places, duplicates, accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, rows, weeks
from ..operators import panel, profile, resolve
from ..sources import ingest, publish
from .base import CASES_SQL, READINGS, TERRITORY, cases, duck_week, proxy, query, table, twin

_CASES = f"with cases as ({CASES_SQL}) "


@query("case_id:bigint code:string digits:string", _CASES + "select case_id, upper(trim(coalesce(sex, ''))) as code, regexp_replace(coalesce(place_a, ''), '[^0-9]', '', 'g') as digits from cases")
def canonical_codes(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", codes.canonical(F.col("sex")).alias("code"), codes.only_digits(F.col("place_a")).alias("digits"))


@query("case_id:bigint a:double b:double", _CASES + "select case_id, case trim(flag_a) when '1' then 1.0 when '0' then 0.0 when '2' then 0.0 end as a, case trim(flag_b) when '1' then 1.0 when '0' then 0.0 when '2' then 0.0 end as b from cases")
def yes_no_flags(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", codes.yes_no(F.col("flag_a")).alias("a"), codes.yes_no(F.col("flag_b")).alias("b"))


@query("case_id:bigint male:double", _CASES + "select case_id, case when upper(trim(sex)) in ('', 'NAN', 'NONE') then null when upper(trim(sex)) = 'M' then 1.0 else 0.0 end as male from cases")
def category_indicator(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", codes.indicator(F.col("sex"), "m").alias("male"))


@query(
    "case_id:bigint years:r6",
    _CASES
    + """select case_id, case when age_code = '' then null when length(age_code) <= 3 and cast(age_code as int) <= 130 then cast(age_code as double)
    else case substr(lpad(age_code, greatest(4, length(age_code)::int), '0'), 1, 1) when '4' then cast(substr(age_code, 2) as double) when '3' then cast(substr(age_code, 2) as double) / 12
    when '2' then cast(substr(age_code, 2) as double) / 365 when '1' then cast(substr(age_code, 2) as double) / 8760 end end as years from cases""",
)
def age_code_years(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", codes.age_years(F.col("age_code")).alias("years"))


@query(
    "case_id:bigint notified:string onset:string delay:int",
    _CASES
    + """select *, date_diff('day', onset, notified) as delay from (select case_id,
    case when regexp_full_match(notified_on, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(notified_on as date) end as notified,
    case when regexp_full_match(onset_on, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(onset_on as date) end as onset from cases) t""",
)
def strict_dates_and_delay(spark, sf_dir):
    d = cases(spark, sf_dir).select("case_id", codes.strict_date(F.col("notified_on")).alias("notified"), codes.strict_date(F.col("onset_on")).alias("onset"))
    return d.withColumn("delay", codes.delay_days(F.col("notified"), F.col("onset")))


@query("case_id:bigint day:string", _CASES + "select case_id, try_cast(notified_on as date) as day from cases")
def lenient_dates(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", codes.lenient_date(F.col("notified_on")).alias("day"))


#: Readings of a week text as year and week columns, each null unless valid.
_READ = """r as (select *, length(g) as n,
    case when length(g) = 6 then substr(g, 1, 4)::int when length(g) = 5 then substr(g, 1, 4)::int end as y1,
    case when length(g) = 6 then substr(g, 5, 2)::int when length(g) = 5 then substr(g, 5, 1)::int end as w1,
    case when length(g) = 6 then substr(g, 3, 4)::int when length(g) = 5 then substr(g, 2, 4)::int end as y2,
    case when length(g) = 6 then substr(g, 1, 2)::int when length(g) = 5 then substr(g, 1, 1)::int end as w2
  from (select *, regexp_replace(split_part(trim(coalesce(week_text, '')), '.', 1), '[^0-9]', '', 'g') as g from cases) t),
v as (select *, y1 between 1900 and 2100 and w1 between 1 and 53 as ok1, y2 between 1900 and 2100 and w2 between 1 and 53 as ok2 from r)"""


def _ladder(year: str) -> str:
    """The reading chosen for a preferred year: 1 or 2, or null."""
    return f"""case when not coalesce(ok1, false) and not coalesce(ok2, false) then null
      when ok1 and y1 = {year} then 1 when ok2 and y2 = {year} then 2
      when ok1 and abs(y1 - {year}) <= 1 and ok2 and abs(y2 - {year}) <= 1 then case when w2 < w1 then 2 else 1 end
      when ok1 and abs(y1 - {year}) <= 1 then 1 when ok2 and abs(y2 - {year}) <= 1 then 2
      when ok1 and not coalesce(ok2, false) then 1 when ok2 and not coalesce(ok1, false) then 2 when n = 6 then 2 else 1 end"""


@query("case_id:bigint week:string", f"with cases as ({CASES_SQL}), {_READ} select case_id, case {_ladder('source_year')} when 1 then printf('%04d%02d', y1, w1) when 2 then printf('%04d%02d', y2, w2) end as week from v")
def week_text_normalise(spark, sf_dir):
    return weeks.parse_week(cases(spark, sf_dir), "week_text", "week", F.col("source_year"))


_NOTIFIED = "case when regexp_full_match(notified_on, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(notified_on as date) end"
_ONSET = "case when regexp_full_match(onset_on, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(onset_on as date) end"


@query(
    "case_id:bigint week:string origin:string",
    f"""with cases as (select *, {_NOTIFIED} as dn, {_ONSET} as ds from ({CASES_SQL}) z), {_READ},
    p as (select *, case {_ladder('coalesce(year(dn), source_year)')} when 1 then printf('%04d%02d', y1, w1) when 2 then printf('%04d%02d', y2, w2) end as wt,
      case when dn is not null then {duck_week('dn')} end as wn, case when ds is not null then {duck_week('ds')} end as wo from v),
    k as (select *, abs(substr(wt, 1, 4)::int - source_year) <= 1 as kt, abs(substr(wn, 1, 4)::int - source_year) <= 1 as kn, abs(substr(wo, 1, 4)::int - source_year) <= 1 as ko from p)
    select case_id, case when kt then wt when kn then wn when ko then wo end as week, case when kt then 'text' when kn then 'notified_week' when ko then 'onset_week' end as origin from k""",
)
def week_precedence(spark, sf_dir):
    c = cases(spark, sf_dir).withColumns({"dn": codes.strict_date(F.col("notified_on")), "ds": codes.strict_date(F.col("onset_on"))})
    return weeks.derive_week(c, [("text", "week_text", "dn")], [("notified", "dn"), ("onset", "ds")], "source_year", names=("week", "origin"))


@query(
    "case_id:bigint six:string short:string strict:string",
    f"""with cases as (select * replace (split_part(week_text, '.', 1) as week_text) from ({CASES_SQL}) z), {_READ}
    select case_id, case when n = 6 and ok1 then printf('%04d%02d', y1, w1) when n = 6 and ok2 then printf('%04d%02d', y2, w2) end as six,
      case when n = 6 and ok1 and y1 between 2000 and 2026 then printf('%04d%02d', y1, w1) when n = 6 and ok2 and y2 between 2000 and 2026 then printf('%04d%02d', y2, w2)
        when n = 5 and ok2 and y2 between 2000 and 2026 then printf('%04d%02d', y2, w2) when n = 5 and ok1 and y1 between 2000 and 2026 then printf('%04d%02d', y1, w1) end as short,
      case when n = 6 then week_text end as strict from v""",
)
def week_short_forms(spark, sf_dir):
    text = F.substring_index("week_text", ".", 1)
    return cases(spark, sf_dir).select("case_id", weeks.parse_week_six(text).alias("six"), weeks.parse_week_short(text).alias("short"), weeks.six_digits(text).alias("strict"))


@query(
    "d:string jan4:string iso:string doy:string jan4_start:string iso_start:string season_sin:r6 season_cos:r6",
    f"""with t as (select distinct cast(o_orderdate as date) as d from orders)
    select d, {duck_week('d')} as jan4, printf('%04d%02d', isoyear(d), weekofyear(d)) as iso,
      printf('%04d%02d', year(d - dayofweek(d)::int), least((dayofyear(d - dayofweek(d)::int) - 1) // 7 + 1, 53)) as doy,
      d - dayofweek(d)::int as jan4_start, d - (isodow(d)::int - 1) as iso_start,
      sin(2 * pi() * substr({duck_week('d')}, 5)::double / 52) as season_sin, cos(2 * pi() * substr({duck_week('d')}, 5)::double / 52) as season_cos from t""",
)
def week_calendars(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    w = {k: weeks.week_of(F.col("d"), k) for k in weeks.CALENDARS}
    s, c = weeks.season(F.substring("jan4", 5, 2).cast("int"))
    d = d.select("d", w["jan4"].alias("jan4"), w["iso"].alias("iso"), w["day_of_year"].alias("doy"))
    return d.withColumns({"jan4_start": weeks.week_start(F.col("jan4")), "iso_start": weeks.week_start(F.col("iso"), "iso"), "season_sin": s, "season_cos": c})


@query("event_id:bigint k:double v:double", "select event_id, case when event_id % 3 = 0 then null else value end as k, case when event_id % 5 <> 0 then value end as v from events where event_id % 4 <> 1")
def sentinel_and_shape(spark, sf_dir):
    """Sentinels become unknown, and rows whose first field is no date are left out."""
    e = table(spark, sf_dir, "events")
    e = e.withColumns({"raw": F.when(F.col("event_id") % 3 == 0, -9999.0).otherwise(F.col("value")), "day": F.when(F.col("event_id") % 4 == 1, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")), "w": F.when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))})
    return e.where(codes.looks_dated(F.col("day"))).select("event_id", codes.without_sentinel(F.col("raw")).alias("k"), codes.finite(F.col("w")).alias("v"))


@query("event_id:bigint kind:string k:int amount:r6", """select event_id, event_type as kind, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, round(value, 3) as amount from events""")
def positional_fields(spark, sf_dir):
    """Fields of a separated line named by position, with a decimal comma."""
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(";", F.col("event_type"), F.get_json_object("props", "$.k"), F.replace(F.round("value", 3).cast("decimal(20,3)").cast("string"), F.lit("."), F.lit(",")))
    f = F.split(line, ";")
    return e.select("event_id", F.get(f, F.lit(0)).alias("kind"), F.get(f, F.lit(1)).cast("int").alias("k"), codes.decimal_comma(F.get(f, F.lit(2))).alias("amount"))


@query(
    "case_id:bigint by_prefix:int by_state:int capital:int",
    _CASES
    + r"""select case_id, cast(starts_with(regexp_replace(coalesce(place_a, ''), '[^0-9]', '', 'g'), '1108') or starts_with(regexp_replace(coalesce(place_b, ''), '[^0-9]', '', 'g'), '1108') as int) as by_prefix,
    cast(upper(trim(state)) in ('SP', '35') as int) as by_state, cast(upper(trim(state)) in ('DF', '53') as int) as capital from cases""",
)
def scope_filter(spark, sf_dir):
    places, states, name = [F.col("place_a"), F.col("place_b")], [F.col("state")], F.col("sex")
    as_int = lambda c: c.cast("int")
    return cases(spark, sf_dir).select(
        "case_id",
        as_int(resolve.in_scope(places, states, name, code_prefix="1108")).alias("by_prefix"),
        as_int(resolve.in_scope(places, states, name, state="SP", state_code="35")).alias("by_state"),
        as_int(resolve.in_scope(places, states, name, state="DF", state_code="53", target_name="brasilia")).alias("capital"),
    )


_DIGITS = "regexp_replace(coalesce({}, ''), '[^0-9]', '', 'g')"
_PLACES_SQL = f"""with cases as (select *, {_DIGITS.format('place_a')} as da, {_DIGITS.format('place_b')} as db, upper(trim(state)) in ('DF', '53') as is_df from ({CASES_SQL}) z),
    t as ({twin(TERRITORY)}), t6 as (select code6, max(code) as code from t group by code6),
    j as (select c.*, a7.code as a7, a6.code as a6, b7.code as b7, b6.code as b6 from cases c
      left join t a7 on substr(da, 1, 7) = a7.code left join t6 a6 on substr(da, 1, 6) = a6.code6
      left join t b7 on substr(db, 1, 7) = b7.code left join t6 b6 on substr(db, 1, 6) = b6.code6),
    p as (select *, case when a7 is not null then 'direct_7d' when a6 is not null then 'prefix_6d_to_7d' when starts_with(da, '53') and is_df then 'df_prefix_fallback' end as ra,
      case when b7 is not null then 'direct_7d' when b6 is not null then 'prefix_6d_to_7d' when starts_with(db, '53') and is_df then 'df_prefix_fallback' end as rb from j),
    q as (select *, coalesce(ra, rb) as place_rule, case when ra is not null then 'a' when rb is not null then 'b' end as place_field,
      case when ra is not null then case ra when 'direct_7d' then a7 when 'prefix_6d_to_7d' then a6 else '5300108' end
           when rb is not null then case rb when 'direct_7d' then b7 when 'prefix_6d_to_7d' then b6 else '5300108' end end as place_code from p)"""


def _resolved(spark, sf_dir):
    return resolve.resolve_place(cases(spark, sf_dir), proxy(spark, sf_dir, TERRITORY), [("a", "place_a"), ("b", "place_b")], ["state"])


@query("case_id:bigint place_code:string place_rule:string place_field:string place_name:string uf:string", _PLACES_SQL + " select case_id, place_code, place_rule, place_field, t.name as place_name, t.uf from q left join t on t.code = q.place_code")
def code_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("place_rule:string place_field:string n:bigint", _PLACES_SQL + " select place_rule, place_field, count(*) as n from q group by all")
def provenance_counts(spark, sf_dir):
    return profile.counts_by(_resolved(spark, sf_dir), "place_rule", "place_field")


_COPIES = "select l_orderkey, l_linenumber, l_quantity, year(cast(l_shipdate as date)) as source_year from lineitem union all select l_orderkey, l_linenumber, l_quantity, year(cast(l_shipdate as date)) from lineitem where l_orderkey % 5 = 0 union all select l_orderkey, l_linenumber, l_quantity, 1900 from lineitem where l_orderkey % 7 = 0"


def _copies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.year("l_shipdate").alias("source_year"))
    return ingest.union_all([li, li.where("l_orderkey % 5 = 0"), li.where("l_orderkey % 7 = 0").drop("source_year").withColumn("source_year", F.lit(1900))])


@query("source_year:int n:bigint quantity:r6", f"select source_year, count(*) as n, sum(l_quantity) as quantity from (select distinct * from ({_COPIES}) t) u group by source_year")
def exact_record_dedup(spark, sf_dir):
    return ingest.drop_exact_duplicates(_copies(spark, sf_dir)).groupBy("source_year").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("l_orderkey:bigint l_linenumber:int l_quantity:double l_tax:double n:bigint", "select l_orderkey, l_linenumber, l_quantity, l_tax, count(*) as n from (select l_orderkey, l_linenumber, l_quantity, null::double as l_tax from lineitem union all select l_orderkey, l_linenumber, null::double, l_tax from lineitem) t group by all")
def union_of_differing_frames(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    both = ingest.union_all([li.select("l_orderkey", "l_linenumber", "l_quantity"), li.select("l_orderkey", "l_linenumber", "l_tax")])
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("n"))


_REASONS = f"""with d as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_quantity, source_year order by l_orderkey) > 1 as dup from ({_COPIES}) t),
    k as (select *, case when dup then 'duplicate' when l_quantity >= 45 then 'invalid_week' when l_orderkey % 11 = 0 then 'invalid_place' end as discard_reason from d)"""


def _judged(spark, sf_dir):
    rows_ = panel.mark_duplicates(_copies(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_quantity", "source_year"], ["l_orderkey"])
    return panel.classified(rows_, [("duplicate", F.col("is_duplicate")), ("invalid_week", F.col("l_quantity") >= 45), ("invalid_place", F.col("l_orderkey") % 11 == 0)])


@query("source_year:int discard_reason:string records:bigint", _REASONS + " select source_year, discard_reason, count(*) as records from k where discard_reason is not null group by all")
def discard_accounting(spark, sf_dir):
    return panel.discard_counts(_judged(spark, sf_dir))


@query("source_year:int l_orderkey:bigint l_linenumber:int discard_reason:string", _REASONS + " select * from (select *, row_number() over (partition by source_year order by l_orderkey, l_linenumber, discard_reason) as n from k where discard_reason is not null) t where n <= 20")
def discard_examples(spark, sf_dir):
    return panel.discard_examples(_judged(spark, sf_dir), ["l_orderkey", "l_linenumber", "discard_reason"], most=20)


@query("source_year:int status:string records:bigint duplicates:bigint invalid:bigint valid:bigint", _REASONS + """, e as (select unnest(range(1990, 2005))::int as source_year),
    a as (select source_year, count(*) as records, count(*) filter (discard_reason = 'duplicate') as duplicates, count(*) filter (discard_reason <> 'duplicate') as invalid, count(*) filter (discard_reason is null) as valid from k group by source_year)
    select e.source_year, case when a.records is null then 'missing' else 'ok' end as status, coalesce(records, 0) as records, coalesce(duplicates, 0) as duplicates, coalesce(invalid, 0) as invalid, coalesce(valid, 0) as valid from e left join a on a.source_year = e.source_year""")
def record_inventory(spark, sf_dir):
    judged = _judged(spark, sf_dir).withColumnRenamed("discard_reason", "reason")
    files = judged.groupBy("source_year").agg(F.count(F.lit(1)).alias("length")).withColumns({"file": F.col("source_year").cast("string"), "sha256": F.sha2(F.col("source_year").cast("string").cast("binary"), 256)})
    return ingest.file_inventory(files, judged, spark.range(1990, 2005).select(F.col("id").cast("int").alias("source_year")))


@query("entity:bigint name:string", "select distinct c_nationkey as entity, n_name as name from customer join nation on c_nationkey = n_nationkey")
def distinct_dimension(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_nationkey").alias("entity"), F.col("n_name").alias("name")).distinct()


@query("c_custkey:bigint index:r6 gap:r6 total:r6", """select c_custkey, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0) as index, a - b as gap, coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0)) as total
    from (select c_custkey, case when c_custkey % 3 <> 0 then c_acctbal end as a, case when c_custkey % 4 <> 0 then c_acctbal / 2 end as b from customer) t""")
def composite_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") / 2).alias("b"))
    return rows.composite_indices(c, {"index": ["a", "b", "absent"]}, "total").withColumn("gap", rows.difference(F.col("a"), F.col("b")))


@query("station:int years:string", f"select station, string_agg(y::varchar, ',' order by y) as years from (select distinct station, year(day) as y from ({twin(READINGS)}) r) t group by station")
def station_year_list(spark, sf_dir):
    r = proxy(spark, sf_dir, READINGS).select(F.col("station").alias("codigo_wmo"), F.col("day").alias("data"))
    return ingest.station_years(r).select(F.col("codigo_wmo").alias("station"), F.col("anos").alias("years"))


@query("p_partkey:bigint p_name:string p_size:int", "select p_partkey, p_name, p_size from part where p_partkey % 3 <> 0 union all select p_partkey, p_name, p_size + 1 from part where p_partkey % 3 = 0")
def insert_if_absent(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return publish.insert_if_absent(p.where("p_partkey % 3 <> 0"), p.withColumn("p_size", F.col("p_size") + 1), ["p_partkey"])


@query("p_partkey:bigint p_name:string p_size:int", "select p_partkey, p_name, p_size from part where p_partkey % 3 <> 0 union all select p_partkey, p_name, p_size + 1 from part where p_partkey % 3 = 0")
def replace_by_key(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return publish.replace_by_key(p, p.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 1), ["p_partkey"])
