"""Publishing by key: versions, interrupted runs, null keys and untouched buckets."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from panelforge.sources import keyed, publish
from panelforge.sources.shared import list_folder

ROWS = "k int, v string"


@pytest.fixture
def published(spark, tmp_path):
    old = spark.createDataFrame([(i, f"v{i}") for i in range(200)] + [(None, "none")], ROWS)
    t = keyed.KeyedTable.create(spark, str(tmp_path / "t"), old.schema, ["k"], buckets=16)
    assert t.read().count() == 0 and t.insert(old) == 16
    return t


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_insert_keeps_known_keys(spark, published):
    before = published.manifest()["folders"]
    new = spark.createDataFrame([(3, "x"), (None, "y"), (500, "b"), (500, "a"), (500, "c")], ROWS)
    assert published.insert(new) == 1
    after = published.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1  # only the bucket of the new key was written
    want = [(i, f"v{i}") for i in range(200)] + [(500, "a"), (None, "none")]
    assert rows(published.read()) == want and rows(published.read(version=1)) == want[:200] + want[201:]
    assert published.insert(new) == 0 and published.versions() == [0, 1, 2]


def test_replace(spark, published):
    new = spark.createDataFrame([(3, "x"), (None, "y"), (None, "z"), (500, "b"), (500, "a")], ROWS)
    assert published.replace(new) <= 3
    got = dict(rows(published.read()))
    assert (got[3], got[None], got[500], got[4], len(got)) == ("x", "y", "a", "v4", 202)
    published.clear()
    assert published.read().count() == 0


def test_interrupted_run(spark, published, monkeypatch):
    want = rows(published.read())
    with monkeypatch.context() as m:
        m.setattr(keyed, "write_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            published.replace(spark.createDataFrame([(3, "x")], ROWS))
    assert rows(published.read()) == want and len(list_folder(spark, f"{published.path}/data")) == 2
    assert published.replace(spark.createDataFrame([(3, "y")], ROWS)) == 1
    assert dict(rows(published.read()))[3] == "y"
    published.vacuum(keep=1)
    assert len(list_folder(spark, f"{published.path}/data")) == 2 and dict(rows(published.read()))[3] == "y" and published.versions() == [2]


def test_two_runs_at_once(spark, published):
    """The second of two runs that began from the same version fails, and nothing of it shows."""
    m = published.manifest()
    published.replace(spark.createDataFrame([(3, "first")], ROWS))
    with pytest.raises(Exception, match="exists"):
        published._publish(spark.createDataFrame([(3, "second")], ROWS), [0], m)
    assert dict(rows(published.read()))[3] == "first"
    with pytest.raises(Exception, match="exists"):
        keyed.KeyedTable.create(spark, published.path, published.read().schema, ["k"])


def test_frames_with_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], ROWS)
    new = spark.createDataFrame([(None, "c"), (2, "e"), (2, "d")], ROWS)
    assert rows(publish.insert_if_absent(old, new, ["k"])) == [(1, "a"), (2, "d"), (None, "b")]
    assert rows(publish.replace_by_key(old, new, ["k"])) == [(1, "a"), (2, "d"), (None, "c")]
    assert rows(publish.insert_if_absent(old.select("k"), new.select("k"), ["k"])) == [(1,), (2,), (None,)]


def test_many_text_files(spark, tmp_path):
    """A file a name, its lines in order, written by several tasks however few bytes there are, without drafts left."""
    rows = spark.createDataFrame([(f"f{i}.csv", j, f"{i};é{j}" if j else None) for i in range(40) for j in (2, 0, 1)], "name string, pos int, line string")
    folder = tmp_path / "many" / "files"
    assert publish.write_text_files(rows, str(folder), "name", ["pos"], "line", "latin-1") == 40
    assert sorted(p.name for p in folder.iterdir()) == sorted(f"f{i}.csv" for i in range(40))
    assert all((folder / f"f{i}.csv").read_bytes() == f"\n{i};é1\n{i};é2\n".encode("latin-1") for i in range(40))
    # A second run replaces the files.
    assert publish.write_text_files(rows.where("name = 'f7.csv' and pos = 1"), str(folder), "name", ["pos"], "line") == 1
    assert (folder / "f7.csv").read_text("utf-8") == "7;é1\n" and len(list(folder.iterdir())) == 40
    assert publish.write_text_files(rows.limit(0), str(tmp_path / "none"), "name", ["pos"], "line") == 0
    with pytest.raises(Exception, match="lines without a file"):
        publish.write_text_files(rows.withColumn("name", F.lit(None).cast("string")), str(folder), "name", ["pos"], "line")


def test_station_files_have_no_folders(spark, monkeypatch):
    """Station files lie beside each other: a directory each, made and moved one by one, took most of the time."""
    from panelforge.queries import QUERIES, files

    seen, remove = [], files.remove_folder

    def looked_at(session, folder):
        at = pathlib.Path(folder.removeprefix("file:")) / "files"
        seen.extend(p.is_file() for p in at.iterdir() if not p.name.startswith((".", "_")))
        remove(session, folder)

    monkeypatch.setattr(files, "remove_folder", looked_at)
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("driver tables are absent")
    n = QUERIES["read_station_data"](spark, data).count()
    assert n == len(seen) and all(seen)
