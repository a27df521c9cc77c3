"""The tap data source: batches, ranges, filters, and a stream that goes on from its offset."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import taps

SCHEMA = {"type": "SCHEMA", "stream": "users", "key_properties": ["id"], "schema": {"properties": {"id": {"type": "integer"}, "name": {"type": ["null", "string"]}, "score": {"type": "number"}, "ok": {"type": "boolean"}, "day": {"type": "string", "format": "date"}, "at": {"type": ["string", "null"], "format": "date-time"}, "tags": {"type": "array"}}}}


def record(**fields):
    return {"type": "RECORD", "stream": "users", "record": fields}


def write(folder, name, *lines):
    (folder / name).write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


@pytest.fixture
def folder(tmp_path):
    write(
        tmp_path, "001.jsonl", SCHEMA, record(id=1, name="a", score=1, ok=True, day="2024-02-03", at="2024-02-03T04:05:06+00:00", tags=["x", "é"]), "no message", '{"type": 3}', "[]",
        {"type": "RECORD", "stream": "other", "record": {"id": 9}}, record(id=2, score="high", at="nonsense", day=5), {"type": "STATE", "value": {"at": 1}},
    )
    write(tmp_path, "002.jsonl", SCHEMA, record(id=1, name="b", more=1), record(id=3, name=None, score=2.5), {"type": "STATE", "value": {"at": 2}})
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path


def test_records(spark, folder):
    d = taps.records(spark, str(folder), "users")
    assert d.dtypes[:7] == [("id", "bigint"), ("name", "string"), ("score", "double"), ("ok", "boolean"), ("day", "date"), ("at", "timestamp"), ("tags", "string")]
    got = {(r.id, r.name): r for r in d.collect()}
    assert set(got) == {(1, "a"), (2, None), (1, "b"), (3, None)}
    one = got[1, "a"]
    assert (one.score, one.ok, one.day, one.tags) == (1.0, True, datetime.date(2024, 2, 3), '["x", "é"]')
    assert got[2, None].score is None and got[2, None].at is None and got[2, None].day is None
    assert d.select(F.unix_timestamp("at")).where("id = 1 AND name = 'a'").first()[0] == 1706933106
    assert {(r.id, r.name) for r in taps.current(d, ["id"]).collect()} == {(1, "b"), (2, None), (3, None)}
    assert json.loads(taps.bookmark(spark, str(folder))) == {"at": 2} and taps.states(spark, str(folder)).count() == 2


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_read_each_line_once(spark, folder, size):
    whole = [line for name, _ in taps.files_of(str(folder)) for line in taps.lines_of(str(folder), name)]
    parts = [line for r in taps.ranges(taps.files_of(str(folder)), size) for line in taps.lines_of(str(folder), r.name, r.low, r.high)]
    assert parts == whole
    if size > 1:
        assert taps.records(spark, str(folder), "users", rangeBytes=str(size)).count() == 4


@pytest.mark.parametrize("condition", ["id = 1", "id > 1", "id <= 2 AND name IS NULL", "name IS NOT NULL", "name IN ('a', 'z')", "NOT (name = 'a')", "name LIKE 'b%'", "day = DATE '2024-02-03'", "score <=> null", "at < TIMESTAMP '2025-01-01'", "length(name) = 1", "ok"])
def test_filters_are_applied_by_the_reader(spark, folder, condition):
    d = taps.records(spark, str(folder), "users")
    want = {tuple(r) for r in spark.createDataFrame(d.collect(), d.schema).where(condition).collect()}
    assert {tuple(r) for r in taps.records(spark, str(folder), "users", condition).collect()} == want
    found = taps.records(spark, str(folder), "users", condition)
    assert found.where("id = 3").count() + found.where("id <> 3").count() == found.where("id IS NOT NULL").count() == len(want) == found.count()


def test_filter_leaves_the_plan(spark, folder):
    plan = taps.records(spark, str(folder), "users", "id = 1 AND length(name) = 1")._jdf.queryExecution().executedPlan().toString()
    assert "length(name" in plan.split("BatchScan")[0] and "(id" not in plan.split("BatchScan")[0].split("Filter", 1)[-1]


def test_stream_goes_on_from_its_offset(spark, folder, tmp_path_factory):
    out, checkpoint = (str(tmp_path_factory.mktemp(x) / "x") for x in ("out", "check"))

    def run():
        d = taps.records(spark, str(folder), "users", streaming=True)
        q = d.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.id, r.name or "") for r in spark.read.parquet(out).collect())

    first = run()
    assert first == sorted((r.id, r.name or "") for r in taps.records(spark, str(folder), "users").collect())
    assert run() == first
    write(folder, "003.jsonl", record(id=4, name="late"))
    assert run() == sorted([*first, (4, "late")])


def test_round_trip_and_registry(spark, tmp_path):
    d = spark.range(50).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("name"), (F.col("id") / 4).alias("x"), F.expr("date_add(DATE '2024-01-01', int(id))").alias("day"), F.expr("timestamp_seconds(id)").alias("at"))
    taps.messages(d.repartition(3), "numbers", ["id"], str(tmp_path / "n"))
    back = taps.records(spark, str(tmp_path / "n"), "numbers").drop(taps.FILE, taps.LINE)
    assert back.dtypes == d.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()), key=lambda r: r[0])
    assert taps.schema_of(str(tmp_path / "n"), "numbers")[1] == ["id"]
    known = spark.createDataFrame([("p/a", "a", "{}", "{}"), ("q/a", "a", "{}", "{}")], "inlet_key string, tap_name string, config string, stream_maps string")
    got = taps.registered(known, [{"tap_name": "a", "config": {"u": 1}}, {"tap_name": ""}, {"tap_name": "b"}], "p")
    assert sorted(map(tuple, got.collect())) == [("p/a", "a", '{"u": 1}', "{}"), ("p/b", "b", "{}", "{}"), ("q/a", "a", "{}", "{}")]


def test_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="no SCHEMA message"):
        taps.records(spark, str(tmp_path), "users").count()
    spark.dataSource.register(taps.TapSource)
    assert spark.read.format("tap").schema("id long").options(path=str(tmp_path / "none"), stream="users").load().count() == 0
