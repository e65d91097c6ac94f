"""Registration of queries, and the proxies for case records that they run on.

The driver's tables hold no case records, so orders and customers stand in for them. A proxy is one SQL text that both
engines read. A query's columns are cast and rounded by the same expressions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Case records: one an order.
CASES = """
select case_id, nation, custkey, price, d, source_year, wk, status, priority,
  case when case_id % 13 = 0 then null when case_id % 17 = 0 then '2024-02-31' else cast(d as string) end as notified_on,
  case when case_id % 11 = 0 then '29/02/2024' else cast(cast(d - cast(case_id % 9 as int) * interval '1' day as date) as string) end as onset_on,
  case case_id % 8 when 0 then yyyy || ww when 1 then ww || yyyy when 2 then yyyy || w when 3 then yyyy || ww || '.0'
    when 4 then w || yyyy when 5 then '209999' when 6 then null else '2010' || '15' end as week_text,
  case status when 'F' then '1' when 'O' then case when case_id % 4 = 0 then '0' else '2' end else case when case_id % 3 = 0 then '9' else null end end as flag_a,
  case when substr(priority, 1, 1) in ('1', '2') then ' 1' when substr(priority, 1, 1) = '3' then '2' else '' end as flag_b,
  case case_id % 5 when 0 then ' m ' when 1 then 'F' when 2 then 'None' when 3 then '' else 'i' end as sex,
  case case_id % 7 when 0 then cast(4000 + case_id % 99 as string) when 1 then cast(3000 + case_id % 12 as string) when 2 then cast(2000 + case_id % 31 as string)
    when 3 then cast(1000 + case_id % 24 as string) when 4 then cast(case_id % 150 as string) when 5 then '' else '9012' end as age_code,
  case case_id % 6 when 0 then cast(code7 as string) when 1 then substr(cast(code7 as string), 1, 6) when 2 then cast(code7 as string) || '.0'
    when 3 then '35.0' when 4 then null else '5399' end as place_a,
  case when case_id % 9 = 0 then cast(code7 as string) else '' end as place_b,
  case when nation % 2 = 0 then ' df' else 'SP' end as state
from (
  select *, cast(source_year as string) as yyyy, cast(wk as string) as w, lpad(cast(wk as string), 2, '0') as ww,
    (110000 + nation * 101) * 10 + nation % 10 as code7
  from (
    select o_orderkey as case_id, c_nationkey as nation, o_custkey as custkey, o_totalprice as price, cast(o_orderdate as date) as d,
      year(cast(o_orderdate as date)) as source_year, cast(floor((dayofyear(cast(o_orderdate as date)) - 1) / 7) as int) + 1 as wk,
      o_orderstatus as status, o_orderpriority as priority
    from {orders} join {customer} on o_custkey = c_custkey
  ) a
) b
"""

#: Territorial reference: one row a nation.
TERRITORY = """
select cast((110000 + n_nationkey * 101) * 10 + n_nationkey % 10 as string) as code, cast(110000 + n_nationkey * 101 as string) as code6,
  n_name as name, r_name as uf, substr(r_name, 1, 2) as region
from {nation} join {region} on n_regionkey = r_regionkey
union all select '5300108', '530010', 'CAPITAL', 'DF', 'CO'
"""

#: Hourly readings: one an event; some are unknown.
READINGS = """
select event_id, cast(user_id as int) as station, cast(ts as date) as day,
  case when event_id % 10 = 0 then null else value * 1.013713917 end as rain,
  case when event_id % 7 = 0 then null else value * 0.237139171 + cast(user_id % 20 as double) end as temp,
  value * 0.237139171 - 3.0 as temp_lo, value * 0.237139171 + 5.0 as temp_hi, cast(event_id % 101 as double) as humidity
from {events}
"""

#: Places and stations with coordinates by formula.
PLACES = "select cast(c_custkey as int) as place, -30.0 + (c_custkey * 37 % 400) / 10.0 as latitude, -60.0 + (c_custkey * 53 % 300) / 10.0 as longitude from {customer}"
STATIONS = "select cast(s_suppkey as int) as site, -30.0 + (s_suppkey * 91 % 400) / 10.0 as latitude, -60.0 + (s_suppkey * 71 % 300) / 10.0 as longitude, cast(s_suppkey % 30 as int) as station from {supplier}"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
_NAMES = {t: t for t in TABLES}


def twin(sql: str) -> str:
    """The SQL text of a proxy on the oracle's side."""
    return sql.format(**_NAMES)


def proxy(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy(spark, sf_dir, CASES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(spec: str) -> list[str]:
    """``name:type`` items as SQL expressions of either engine; r6 is a double rounded to six digits."""
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        out.append(f"round(cast({name} as double), 6) + cast(0 as double) as {name}" if kind == "r6" else f"cast({name} as {kind}) as {name}")
    return out


def query(spec: str | None = None, sql: str | None = None) -> Callable:
    """Register a function under its name; spec: its columns and types; sql: its twin, from which the same are taken."""

    def add(f: Callable) -> Callable:
        name = f.__name__
        QUERIES[name] = (lambda spark, sf_dir: f(spark, sf_dir).selectExpr(*shaped(spec))) if spec else f
        if sql is not None:
            ORACLES[name] = f"select {', '.join(shaped(spec))} from ({sql}) q"
        return f

    return add


def duck_week(d: str) -> str:
    """Week YYYYWW of a date by the 4 January rule."""
    start = f"({d} - dayofweek({d})::int)"
    year = f"year({start} + 3)"
    jan4 = f"make_date({year}, 1, 4)"
    return f"printf('%04d%02d', {year}, ({start} - ({jan4} - dayofweek({jan4})::int)) // 7 + 1)"


def tail_sql(a: str, b: str, odds: str) -> str:
    """The regularised incomplete beta function of x = 1 / (1 + odds) by numerical integration (Simpson's rule over the
    angle whose squared sine is x, from where the integrand is next to nothing)."""
    return f"""(select sum(case when i = 0 or i = 20000 then 1 when i % 2 = 1 then 4 else 2 end * exp((2 * a - 1) * ln(greatest(sin(lo + i * h), 1e-300)) + (2 * b - 1) * ln(greatest(cos(lo + i * h), 1e-300))
      + lgamma(a + b) - lgamma(a) - lgamma(b) + ln(2.0))) * any_value(h) / 3 from (select a, b, lo, (top - lo) / 20000 as h from (select a, b, top, greatest(0.0, top - 60 / sqrt(2 * a)) as lo
      from (select {a} as a, {b} as b, atan(1 / sqrt({odds})) as top) z0) z1) z2, (select unnest(range(20001)) as i) z3)"""


CASES_SQL = twin(CASES)
#: Common table expressions: cases with week and flags; the observed panel; the dense panel.
OBSERVED_CTE = f"""
cases as ({CASES_SQL}),
c as (select *, {duck_week('d')} as week, case trim(flag_a) when '1' then 1.0 when '0' then 0.0 when '2' then 0.0 end as fa,
  case trim(flag_b) when '1' then 1.0 when '2' then 0.0 end as fb from cases),
obs as (select nation, week, count(*)::double as cases, avg(fa) as severe, avg(price) as price from c group by all)
"""
DENSE_CTE = f"""{OBSERVED_CTE},
dense as (select e.nation, k.week, coalesce(o.cases, 0) as cases, coalesce(o.severe, 0) as severe
  from (select distinct nation from obs) e cross join (select distinct week from obs) k left join obs o on o.nation = e.nation and o.week = k.week)
"""
