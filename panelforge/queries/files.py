"""Queries that write driver tables in the sources' formats to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.refresh import YearlyPanel
from ..sources import ingest, publish
from ..sources.keyed import KeyedTable
from ..sources.shared import cut_lineage, new_folder, remove_folder, rename_parts
from .base import CASES_SQL, DENSE_CTE, PLACES, READINGS, TERRITORY, cases, proxy, query, table, twin
from .panels import dense, observed

_RECORDS = ("case_id", "flag_a", "week_text", "sex")


def _read_back(spark: SparkSession, name: str, work) -> DataFrame:
    """What work(folder) returns, kept as rows of its own so that the folder can go."""
    folder = new_folder(spark, name)
    try:
        return cut_lineage(work(folder))
    finally:
        remove_folder(spark, folder)


def _year_files(df: DataFrame, folder: str, kind: str) -> None:
    """One file a source year with the year at the end of its name, as the records come."""
    writer = df.repartition("source_year").write.partitionBy("source_year")
    writer.option("header", True).csv(folder) if kind == "csv" else writer.json(folder)
    rename_parts(df.sparkSession, folder, "RECORDS{}." + kind)


_RECORDS_SQL = f"select source_year, count(*) as n, count(flag_a) as flags, count(week_text) as weeks, sum(case_id) as ids, count(distinct sex) as sexes from ({CASES_SQL}) c group by source_year"
_RECORDS_SPEC = "source_year:int n:bigint flags:bigint weeks:bigint ids:bigint sexes:bigint"


def _record_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_year").agg(F.count(F.lit(1)).alias("n"), F.count("flag_a").alias("flags"), F.count("week_text").alias("weeks"), F.sum(F.col("case_id").cast("long")).alias("ids"), F.countDistinct("sex").alias("sexes"))


@query(_RECORDS_SPEC, _RECORDS_SQL)
def read_json_records(spark, sf_dir):
    def work(folder):
        _year_files(cases(spark, sf_dir).select("source_year", *[F.col(c).cast("string").alias(c) for c in _RECORDS]), folder, "json")
        return _record_counts(ingest.read_cases_json(spark, folder, [*_RECORDS, "absent"], lines=True))

    return _read_back(spark, "json", work)


@query(_RECORDS_SPEC, _RECORDS_SQL)
def read_json_arrays(spark, sf_dir):
    """One array a file, as the records are published; such a file is one task's work, whatever its size."""

    def work(folder):
        rows = cases(spark, sf_dir).select("source_year", F.struct(*[F.col(c).cast("string").alias(c) for c in _RECORDS]).alias("r"))
        rows.groupBy("source_year").agg(F.to_json(F.collect_list("r")).alias("value")).repartition("source_year").write.partitionBy("source_year").text(folder)
        rename_parts(spark, folder, "RECORDS{}.json")
        return _record_counts(ingest.read_cases_json(spark, folder, [*_RECORDS, "absent"]))

    return _read_back(spark, "arrays", work)


@query(_RECORDS_SPEC, _RECORDS_SQL.replace("count(distinct sex)", "count(distinct nullif(trim(sex), ''))"))
def read_csv_records(spark, sf_dir):
    """Blanks around values and empty texts don't survive the format: they read as trimmed and null."""

    def work(folder):
        _year_files(cases(spark, sf_dir).select("source_year", *[F.col(c).cast("string").alias(c) for c in _RECORDS]), folder, "csv")
        return _record_counts(ingest.read_cases_csv(spark, folder, [*_RECORDS]))

    return _read_back(spark, "csv", work)


@query(
    "station:string latitude:r6 founded:string n:bigint days:bigint rain:r6 rain_known:bigint humidity:r6",
    f"""select station::varchar as station, -station / 4.0 as latitude, '2001-01-0' || (station % 9 + 1) as founded, count(*) as n, count(distinct day) as days, sum(round(rain, 2)) as rain, count(rain) as rain_known, sum(humidity) as humidity
    from ({twin(READINGS)}) r group by station""",
)
def read_station_data(spark, sf_dir):
    """Readings as station files, one a station, with header, over-long and undated lines, and back."""

    def work(folder):
        r = proxy(spark, sf_dir, READINGS)
        comma = lambda c: F.coalesce(F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(",")), F.lit("-9999"))
        line = F.concat_ws(";", F.date_format("day", "yyyy/MM/dd"), F.lit("0000 UTC"), comma(F.col("rain")), *[F.lit("")] * 9, comma(F.col("humidity")), *[F.lit("")] * 5)
        body = r.select("station", F.lit(10).alias("pos"), line.alias("line"))
        keys = ["REGIAO:;CO", "UF:;DF", "ESTACAO:;S", F.concat(F.lit("CODIGO (WMO):;"), F.col("station")), F.concat(F.lit("LATITUDE:;"), comma(-F.col("station") / 4.0)), "LONGITUDE:;-47,92", "ALTITUDE:;1160,9", F.concat(F.lit("DATA DE FUNDACAO:;2001-01-0"), F.col("station") % 9 + 1), "Data" + ";x" * 17]
        wrong = ["2024/01/01;0000 UTC;5" + ";" * 20, "total;x;1;2;3", "2024/01/01;1"]
        texts = [k if not isinstance(k, str) else F.lit(k) for k in [*keys, *wrong]]
        head = r.select("station").distinct().select("station", F.posexplode(F.array(*texts)).alias("pos", "line"))
        rows = head.unionByName(body).withColumn("file", F.concat("station", F.lit(".csv")))
        publish.write_text_files(rows, f"{folder}/files", "file", ["pos"], "line", "latin-1")
        hourly, stations = ingest.read_station_files(spark, f"{folder}/files")
        by = hourly.groupBy(F.col("codigo_wmo").alias("station")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("data").alias("days"), F.sum("precipitacao_mm").alias("rain"), F.count("precipitacao_mm").alias("rain_known"), F.sum("umidade_inst_pct").alias("humidity"))
        return by.join(stations.select(F.col("codigo_wmo").alias("station"), "latitude", F.col("data_fundacao").alias("founded")), "station")

    return _read_back(spark, "stations", work)


@query("code:string code6:string name:string uf:string region:string", twin(TERRITORY))
def read_territory(spark, sf_dir):
    """The territorial reference as one JSON array with either path to the state, and back."""

    def work(folder):
        uf = F.struct(F.struct(F.col("uf").alias("sigla"), F.struct(F.col("region").alias("sigla")).alias("regiao")).alias("UF"))
        even = F.col("code").cast("long") % 2 == 0
        one = F.struct(F.col("code").cast("long").alias("id"), F.col("name").alias("nome"), F.when(even, F.struct(uf.alias("mesorregiao"))).alias("microrregiao"), F.when(~even, F.struct(uf.alias("regiao-intermediaria"))).alias("regiao-imediata"))
        whole = proxy(spark, sf_dir, TERRITORY).agg(F.to_json(F.collect_list(one)))  # a few thousand rows in all
        whole.coalesce(1).write.text(folder)
        return ingest.read_territory(spark, folder)

    return _read_back(spark, "territory", work)


@query("code:string latitude:r6 longitude:r6", f"select place::varchar as code, latitude, longitude from ({twin(PLACES)}) p where place % 50 <> 0")
def read_coordinates(spark, sf_dir):
    """Places as CSV, some without a latitude and each twice, and back: one row a code."""

    def work(folder):
        p = proxy(spark, sf_dir, PLACES)
        p = p.select(F.col("place").alias("codigo_ibge"), F.lit("a").alias("nome"), F.when(F.col("place") % 50 != 0, F.col("latitude")).alias("latitude"), "longitude")
        p.unionByName(p.withColumns({"nome": F.lit("b"), "latitude": F.lit(0.0)})).write.option("header", True).csv(folder)
        return ingest.read_coordinates(spark, folder)

    return _read_back(spark, "coordinates", work)


@query("nation:int week:string cases:double severe:r6", f"with {DENSE_CTE} select nation, week, case when substr(week, 1, 4) = '1996' then cases + 1 else cases end as cases, severe from dense")
def partitioned_panel(spark, sf_dir):
    """The panel written by year, one year of it again with other counts, and read without the partition's column."""

    def work(folder):
        d = dense(spark, sf_dir).withColumn("ano", F.substring("week", 1, 4).cast("int"))
        publish.write_panel(d, folder, year_of="ano")
        publish.write_panel(d.where("ano = 1996").withColumn("cases", F.col("cases") + 1), folder, year_of="ano")
        return ingest.read_panel(spark, folder).drop("ano")

    return _read_back(spark, "panel", work)


@query("place:bigint n_name:string n_regionkey:int", "select row_number() over (order by n_regionkey, n_name) - 1 as place, n_name, n_regionkey from nation")
def ordered_report(spark, sf_dir):
    """A small table written as CSV in a fixed order; place: where each line stands in the file."""

    def work(folder):
        publish.write_report(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), folder, ["n_regionkey", "n_name"])
        return spark.read.option("header", True).csv(folder).select(F.monotonically_increasing_id().alias("place"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))

    return _read_back(spark, "report", work)


@query("p_partkey:bigint p_size:int", "select p_partkey, p_size + 1 as p_size from part where p_partkey % 2 = 0")
def refreshed_table(spark, sf_dir):
    """A table replaced as a whole: nothing of what it held stays."""

    def work(folder):
        p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
        publish.full_refresh(p, folder)
        publish.full_refresh(p.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 1), folder)
        return spark.read.parquet(folder)

    return _read_back(spark, "refresh", work)


_ODD = "p_partkey % 3 <> 0"


@query("p_partkey:bigint p_name:string p_size:int", "select p_partkey, p_name, p_size from part where p_partkey % 3 <> 0 union all select p_partkey, p_name, p_size + 1 from part where p_partkey % 3 = 0 union all select null, 'none', 1")
def published_insert(spark, sf_dir):
    """A table published, published again with rows of new and known keys, and read: known keys keep their rows."""

    def work(folder):
        p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
        t = KeyedTable.create(spark, folder, p.schema, ["p_partkey"])
        none = p.limit(1).select(F.lit(None).cast("bigint").cast(p.schema["p_partkey"].dataType).alias("p_partkey"), F.lit("none").alias("p_name"), F.lit(1).cast(p.schema["p_size"].dataType).alias("p_size"))
        t.insert(p.where(_ODD).unionByName(none))
        again = p.withColumn("p_size", F.col("p_size") + 1)
        t.insert(again.unionByName(again.withColumn("p_size", F.col("p_size") + 1)).unionByName(none))
        return t.read()

    return _read_back(spark, "published", work)


@query("p_partkey:bigint p_name:string p_size:int", "select p_partkey, p_name, p_size from part where p_partkey % 3 <> 0 union all select p_partkey, p_name, p_size + 1 from part where p_partkey % 3 = 0")
def published_replace(spark, sf_dir):
    """A table published, some of its keys published again with other values, and read."""

    def work(folder):
        p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
        t = KeyedTable.create(spark, folder, p.schema, ["p_partkey"])
        t.insert(p)
        changed = p.where(f"not ({_ODD})").withColumn("p_size", F.col("p_size") + 1)
        t.replace(changed.unionByName(changed.withColumn("p_size", F.col("p_size") + 5)))
        return t.read()

    return _read_back(spark, "published", work)


_LINES = f"select source_year, case_id % 2 as half, string_agg(case_id::varchar || chr(10), '' order by case_id) as body, count(*) as n from ({CASES_SQL}) c group by all"


@query(
    "source_year:int files:bigint file_size_bytes:bigint sha256:string records:bigint status:string",
    f"""with f as ({_LINES}), d as (select source_year, half, case half when 0 then 'A' else 'B' end || source_year || '.txt' as name, length(body) as size, sha256(body) as digest, n from f where half = 0 or source_year % 2 = 0)
    select source_year, count(*) as files, sum(size) as file_size_bytes, case when count(*) = 1 then any_value(digest) else sha256(string_agg(digest || '  ' || name || chr(10), '' order by name)) end as sha256, sum(n) as records, 'ok' as status from d group by source_year""",
)
def file_inventory(spark, sf_dir):
    """Size and digest of real files, one or two a source year, beside the counts of their records."""

    def work(folder):
        rows = cases(spark, sf_dir).select("source_year", "case_id").where("case_id % 2 = 0 or source_year % 2 = 0")
        for half, name in ((0, "A"), (1, "B")):
            own = rows.where(F.col("case_id") % 2 == half).repartition("source_year").sortWithinPartitions("source_year", "case_id")
            own.select("source_year", F.col("case_id").cast("string").alias("line")).write.partitionBy("source_year").text(f"{folder}/{name}")
            rename_parts(spark, f"{folder}/{name}", name + "{}.txt")
        files = ingest.read_files(spark, folder)
        line = spark.read.text([f"{folder}/A", f"{folder}/B"])
        records = line.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})\D*$", 1).cast("int").alias("source_year"), F.lit(None).cast("string").alias("reason"))
        return ingest.file_inventory(files, records, rows.select("source_year").distinct())

    return _read_back(spark, "inventory", work)


_REFRESHED = f"""{DENSE_CTE},
    lim as (select nation, quantile_cont(cases, 0.75) as q75 from dense group by nation),
    ch as (select nation, week, case when substr(week, 1, 4) = '1996' then cases * 2 + (cases > 0)::int else cases end as cases from dense),
    ft as (select *, coalesce(lag(cases, 12) over w, 0) as lag12, coalesce(lag(cases, 1) over w, 0) as b from ch window w as (partition by nation order by week)),
    mm as (select *, avg(b) over (partition by nation order by week rows between 11 preceding and current row) as mean12 from ft)"""


@query("nation:int week:string cases:double cases_lag_12:double cases_mean_12:r6 alert_q75:int", f"with {_REFRESHED} select mm.nation, week, cases, lag12 as cases_lag_12, mean12 as cases_mean_12, (cases >= q75 and cases > 0)::int as alert_q75 from mm join lim using (nation)")
def refreshed_year(spark, sf_dir):
    """A panel by year built as a whole, and one year of it made anew from changed records; the others keep their files."""

    def work(folder):
        o = observed(spark, sf_dir).select("nation", "week", "cases", "severe")
        yearly = YearlyPanel(spark, folder, ["nation"], "week", "cases", "severe")
        yearly.build(o, o.select("nation"), o.select("week"))
        changed = o.withColumn("cases", F.when(F.substring("week", 1, 4) == "1996", F.col("cases") * 2 + (F.col("cases") > 0).cast("int")).otherwise(F.col("cases")))
        yearly.refresh(changed, 1996)
        return yearly.read()

    return _read_back(spark, "yearly", work)
