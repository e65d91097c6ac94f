"""Readers: case records (JSON, CSV), station files, territorial reference, coordinates, partitioned Parquet, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import decimal_comma, looks_dated, without_sentinel
from .digests import file_digests

#: The station files' columns by position.
STATION_COLUMNS = [
    "data", "hora_utc", "precipitacao_mm", "pressao_mbar", "pressao_max_mbar", "pressao_min_mbar", "radiacao_kj_m2", "temp_inst_c", "temp_max_c",
    "temp_min_c", "temp_orvalho_c", "temp_orvalho_inst_c", "umidade_inst_pct", "umidade_max_pct", "umidade_min_pct", "vento_dir_graus", "vento_rajada_ms", "vento_vel_ms",
]
HEADER_LINES = 8
LEAST_FIELDS = 5
_YEAR = r"(\d{4})\D*$"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _with_source_year(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, F.regexp_extract("_metadata.file_name", _YEAR, 1).try_cast("int").alias("source_year"))


def read_cases_json(spark: SparkSession, path: str, columns: list[str], lines: bool = False) -> DataFrame:
    """Case records as text. Fields that a file lacks are null; source_year is the last four digits of the file name.

    lines: one record a line, which Spark can split; else each file holds one array.
    """
    reader = spark.read.schema(text_schema(columns)).option("multiLine", not lines)
    return _with_source_year(reader.json(path), columns)


def read_cases_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Case records from CSV files with a header; columns are taken by name."""
    return _with_source_year(spark.read.option("header", True).csv(path).select(*columns), columns)


def read_station_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hourly readings and station metadata from latin-1 files: eight KEY:;VALUE lines, a header, 18 fields a line.

    Lines with fewer than five fields, with more fields than the header, or with a first field that is no date are left
    out; numbers have a decimal comma, -9999 is unknown. Metadata: one row a file. A file is one row, so it must be
    below 2 GB.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.split(F.decode("content", "ISO-8859-1"), "\r?\n").alias("lines"))
    pair = lambda x: F.split(x, ";", 2)
    key = lambda x: F.upper(F.trim(F.regexp_replace(F.get(pair(x), F.lit(0)), ":", "")))
    head = F.slice("lines", 1, HEADER_LINES)

    def value(*names: str) -> Column:
        return F.get(F.transform(F.filter(head, lambda x: key(x).isin(*names) & (F.size(pair(x)) > 1)), lambda x: F.trim(F.get(pair(x), F.lit(1)))), F.lit(0))

    meta = {
        "regiao": value("REGIAO", "REGIÃO"), "uf": value("UF"), "estacao": value("ESTACAO", "ESTAÇÃO"), "codigo_wmo": value("CODIGO (WMO)"), "latitude": decimal_comma(value("LATITUDE")),
        "longitude": decimal_comma(value("LONGITUDE")), "altitude": decimal_comma(value("ALTITUDE")), "data_fundacao": value("DATA DE FUNDACAO", "DATA DE FUNDAÇÃO"),
    }
    stations = files.select("file", *[c.alias(k) for k, c in meta.items()])
    # The file's place is read from its own lines, in the pass that explodes them.
    width = F.size(F.split(F.get("lines", F.lit(HEADER_LINES)), ";"))
    rows = files.select(*[meta[k].alias(k) for k in ("codigo_wmo", "uf", "regiao")], width.alias("width"), F.explode(F.slice("lines", HEADER_LINES + 2, F.greatest(F.size("lines"), F.lit(1)))).alias("line"))
    rows = rows.withColumn("f", F.split("line", ";")).where((F.size("f") >= LEAST_FIELDS) & (F.size("f") <= F.col("width")))
    named = rows.select("codigo_wmo", "uf", "regiao", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(STATION_COLUMNS)]).where(looks_dated(F.col("data")))
    numbers = [without_sentinel(decimal_comma(F.col(c))).alias(c) for c in STATION_COLUMNS[2:]]
    day = F.try_to_date(F.replace(F.substring("data", 1, 10), F.lit("/"), F.lit("-")), "yyyy-MM-dd").alias("data")
    return named.select(day, "hora_utc", *numbers, "codigo_wmo", "uf", "regiao"), stations


def station_years(hourly: DataFrame) -> DataFrame:
    """Per station: the years it has readings for, ascending, as text joined with commas."""
    return hourly.groupBy("codigo_wmo").agg(F.array_join(F.array_sort(F.collect_set(F.year("data"))), ",").alias("anos"))


_REGION = "struct<sigla:string>"
_UF = f"struct<UF:struct<sigla:string,regiao:{_REGION}>>"
TERRITORY_SCHEMA = f"id long, nome string, microrregiao struct<mesorregiao:{_UF}>, `regiao-imediata` struct<`regiao-intermediaria`:{_UF}>"


def territory(raw: DataFrame) -> DataFrame:
    """code, code6, name, uf, region of the nested reference; a row with neither path to the state is an error."""
    uf = F.coalesce(F.col("microrregiao.mesorregiao.UF.sigla"), F.col("`regiao-imediata`.`regiao-intermediaria`.UF.sigla"))
    region = F.coalesce(F.col("microrregiao.mesorregiao.UF.regiao.sigla"), F.col("`regiao-imediata`.`regiao-intermediaria`.UF.regiao.sigla"))
    code = F.col("id").cast("string")
    checked = F.when(uf.isNull(), F.raise_error(F.concat(F.lit("no state for territory "), code)).cast("string")).otherwise(uf)
    return raw.select(code.alias("code"), F.substring(code, 1, 6).alias("code6"), F.col("nome").alias("name"), checked.alias("uf"), region.alias("region"))


def read_territory(spark: SparkSession, path: str) -> DataFrame:
    return territory(spark.read.schema(TERRITORY_SCHEMA).option("multiLine", True).json(path))


def coordinates(raw: DataFrame, code: str, name: str, latitude: str, longitude: str) -> DataFrame:
    """Code (first seven characters), name, latitude, longitude: one row a code, the first by name; none without a place."""
    rows = raw.select(F.substring(F.col(code).cast("string"), 1, 7).alias("code"), F.col(name).alias("name"), F.col(latitude).cast("double").alias("latitude"), F.col(longitude).cast("double").alias("longitude"))
    order = Window.partitionBy("code").orderBy("name", "latitude", "longitude")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n").dropna(subset=["latitude", "longitude"])


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return coordinates(raw, "codigo_ibge", "nome", "latitude", "longitude")


def read_panel(spark: SparkSession, path: str, partition: str = "year", keep_partition: bool = False) -> DataFrame:
    """A partitioned Parquet table; the directory column is dropped unless asked for, so that it can't become a feature."""
    df = spark.read.parquet(path)
    return df if keep_partition else df.drop(partition)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def drop_exact_duplicates(rows: DataFrame) -> DataFrame:
    """One of each set of rows that agree in every column, the source year among them."""
    return rows.dropDuplicates()


def file_inventory(files: DataFrame, records: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected source year: files, their size, sha256, record counts and status (ok, missing, error).

    files: source_year, file, length, sha256. A year of one file has that file's digest; of several, the digest of the
    lines ``digest  file`` in the order of the names. records: source_year, reason (null: valid) with ``duplicate`` for
    duplicates.
    """
    line = F.concat("sha256", F.lit("  "), "file", F.lit("\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", line.alias("line")))), lambda x: x["line"]), "")  # a year's files
    seen = files.groupBy("source_year").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("file_size_bytes"), F.when(F.count(F.lit(1)) == 1, F.max("sha256")).otherwise(F.sha2(lines.cast("binary"), 256)).alias("sha256"))
    counts = records.groupBy("source_year").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("reason").eqNullSafe("duplicate")).alias("duplicates"),
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "duplicate")).alias("invalid"),
        F.count_if(F.col("reason").isNull()).alias("valid"),
    )
    out = expected.join(seen, "source_year", "left").join(counts, "source_year", "left")
    status = F.when(F.col("file_size_bytes").isNull(), "missing").when(F.col("records").isNull(), "error").otherwise("ok")
    zero = {c: 0 for c in ("files", "records", "duplicates", "invalid", "valid")}
    return out.withColumn("status", status).fillna(zero)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """source_year (from the name), file, length and sha256 of each file, of any size."""
    return file_digests(spark, path).select(F.regexp_extract("file", _YEAR, 1).try_cast("int").alias("source_year"), "file", "length", "sha256")
