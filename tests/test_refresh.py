"""One year made anew, and digests of files."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import weeks
from panelforge.plans.refresh import REACH, YearlyPanel
from panelforge.sources import ingest
from panelforge.sources.digests import file_digests


def parts(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def calendar(spark):
    days = spark.range(4 * 366).select(F.date_add(F.lit("2013-01-06").cast("date"), F.col("id").cast("int")).alias("d"))
    return days.select(weeks.week_of(F.col("d")).alias("week")).distinct().where("week between '201301' and '201652'").cache()


def test_refresh_equals_full_build(spark, tmp_path, calendar):
    rng = random.Random(1)
    every = sorted(r[0] for r in calendar.collect())
    assert "201453" in every  # a year of 53 weeks
    seen = [(e, w, float(rng.randrange(1, 9)), rng.random() / 5) for e in "abc" for w in every if rng.random() < 0.7]
    schema = "e string, week string, n double, s double"
    old = spark.createDataFrame(seen, schema)
    new = spark.createDataFrame([(e, w, n * 3 if w[:4] == "2014" else n, s) for e, w, n, s in seen if not (w[:4] == "2014" and e == "b" and w > "201440")], schema)
    entities = spark.createDataFrame([("a",), ("b",), ("c",), ("unseen",)], "e string")
    kept = YearlyPanel(spark, str(tmp_path / "kept"), ["e"], "week", "n", "s")
    kept.build(old, entities, calendar)
    before = parts(f"{kept.path}/panel")
    assert kept.refresh(new, 2014) == [2014, 2015]
    after = parts(f"{kept.path}/panel")
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.split("year=")[1][:4] for p in same} == {"2013", "2016"} and not {p for p in after if "year=2014" in p} & set(before)
    whole = YearlyPanel(spark, str(tmp_path / "whole"), ["e"], "week", "n", "s")
    whole.build(new, entities, calendar, kept.limits())
    key = lambda r: (r["e"], r["week"])
    columns = whole.read().columns
    got, want = (sorted(t.read().select(*columns).collect(), key=key) for t in (kept, whole))
    assert len(got) == len(want) == 4 * len(every)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True)), (a, b)
    assert REACH == 12 and kept.refresh(new, 2016) == [2016]
    with pytest.raises(ValueError, match="no week"):
        kept.refresh(new, 1999)


def test_labels_as_in_the_whole_plan(spark, tmp_path, calendar):
    """A full build has the alerts of the plan that takes quantiles from windows."""
    from panelforge.plans import panel as plans

    rng = random.Random(2)
    every = sorted(r[0] for r in calendar.collect())
    rows = spark.createDataFrame([(e, w, float(rng.randrange(0, 9)), rng.random() / 5) for e in "ab" for w in every], "e string, week string, n double, s double")
    kept = YearlyPanel(spark, str(tmp_path), ["e"], "week", "n", "s")
    kept.build(rows, rows.select("e"), calendar)
    columns = ["e", "week", "alert_q75", "alert_q90", "fast_growth", "outbreak", "critical", "n_mean_12", "n_accel"]
    want = plans.labelled_panel(rows, ["e"], "week", "n", "s").select(*columns)
    assert sorted(map(tuple, kept.read().select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_weeks_apart(spark):
    """Lags over a missing week and over the end of a year of 53 weeks."""
    known = [("a", w, float(i)) for i, w in enumerate(["201451", "201452", "201453", "201501", "201503", "201504"])]
    df = spark.createDataFrame(known, "e string, week string, v double").withColumn("k", weeks.week_number(F.col("week")).cast("int"))
    assert [r["k"] for r in df.orderBy("week").collect()] == [r["k"] for r in df.orderBy("k").collect()]
    from panelforge.operators import windows

    out = windows.rolling_apart(windows.lags_apart(df, "v", ["e"], "k", (1, 2)), ["v"], ["e"], "k", span=2, least=1).orderBy("week").collect()
    assert [r["v_lag_1"] for r in out] == [None, 0, 1, 2, None, 4] and [r["v_lag_2"] for r in out] == [None, None, 0, 1, 3, None]
    assert [r["v_roll_2"] for r in out] == [0, 0.5, 1.5, 2.5, 4, 4.5]


def test_digests(spark, tmp_path):
    texts = {"A2001.txt": b"one", "B2001.txt": b"two" * 5_000_000, "A2002.txt": b"", "x/C2003.bin": bytes(range(256)) * 999}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_hidden1999").write_bytes(b"x")
    got = {r["file"]: (r["length"], r["sha256"]) for r in file_digests(spark, str(tmp_path)).collect()}
    assert got == {n.split("/")[-1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in texts.items()}
    records = spark.createDataFrame([(2001, None), (2001, "duplicate"), (2003, "bad")], "source_year int, reason string")
    out = {r["source_year"]: r for r in ingest.file_inventory(ingest.read_files(spark, str(tmp_path)), records, spark.range(2000, 2004).selectExpr("int(id) as source_year")).collect()}
    both = "".join(f"{hashlib.sha256(texts[n]).hexdigest()}  {n}\n" for n in ("A2001.txt", "B2001.txt"))
    assert out[2001]["sha256"] == hashlib.sha256(both.encode()).hexdigest() and out[2001]["files"] == 2 and out[2001]["status"] == "ok"
    assert out[2003]["sha256"] == got["C2003.bin"][1] and out[2002]["status"] == "error" and out[2000]["status"] == "missing"
    empty = tmp_path / "empty"
    empty.mkdir()
    assert file_digests(spark, str(empty)).count() == 0


def test_digest_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "BIG2004.dat", "wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    want = hashlib.sha256()
    with open(tmp_path / "BIG2004.dat", "rb") as f:
        while block := f.read(1 << 24):
            want.update(block)
    row = file_digests(spark, str(tmp_path)).first()
    os.truncate(tmp_path / "BIG2004.dat", 0)
    assert (row["length"], row["sha256"]) == (size, want.hexdigest())
