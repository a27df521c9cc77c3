"""Tap messages (SCHEMA, RECORD, STATE lines) as a Spark data source, in batches and as a stream; and the registry of taps.

A tap writes files of JSON lines into a folder, whose names ascend as they are
written.  ``spark.read.format("tap")`` gives the records of one stream, typed by its
SCHEMA message: a file is read in ranges of bytes by different tasks, and a line
that is no message, or one of another stream, gives no row.  A condition given to
``records`` is applied before rows leave the reader.  ``spark.readStream.format("tap")`` goes from file to
file: an offset names the last file that was read, so a restart goes on behind it.

A field that a record does not have, or whose value does not fit its type, is null.
Besides the fields each row has ``_tap_file`` and ``_tap_line`` (the byte at which its line begins):
``current`` keeps the last record of each key by them.  An empty folder gives no rows
where a schema is given, and an error where none is.
"""

from __future__ import annotations

import datetime
import json
import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith

RANGE = 32 << 20  # bytes of a file that one task reads
FILE, LINE = "_tap_file", "_tap_line"
_TYPES = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
_FORMATS = {"date-time": T.TimestampType(), "date": T.DateType()}
_ROWS = 4096


def _open(path: str):
    """(file system, path there): any store that pyarrow knows by its address, such as file:, hdfs:, s3: or gs:."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")


def files_of(path: str) -> list[tuple[str, int]]:
    """(name, size) of the folder's files, in order; names that begin with . or _ are no data."""
    from pyarrow import fs

    system, at = _open(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def lines_of(path: str, name: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines of a file that begin in low <= byte < high."""
    system, at = _open(path)
    with system.open_input_file(posixpath.join(at, name)) as file:
        size = file.size()
        high = size if high is None else min(high, size)
        place, rest = low, b""
        if low:  # the line that is under way belongs to the range before
            file.seek(low - 1)
            place -= 1
            skip = True
        else:
            skip = False
        while True:
            data = file.read(1 << 20)
            parts = (rest + data).split(b"\n")
            rest = parts.pop() if data else b""
            for line in parts:
                if skip:
                    skip = False
                elif place >= high:
                    return
                else:
                    yield place, line
                place += len(line) + 1
            if not data:
                return


def message(line: bytes) -> dict | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) and isinstance(found.get("type"), str) else None


def type_of(declared: dict) -> T.DataType:
    """The column type of a JSON schema's property; objects, arrays and unions stay JSON text."""
    kinds = declared.get("type") or []
    kinds = [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k != "null"]
    if kinds == ["string"]:
        return _FORMATS.get(declared.get("format"), T.StringType())
    return _TYPES.get(kinds[0], T.StringType()) if len(kinds) == 1 else T.StringType()


def schema_of(path: str, stream: str) -> tuple[T.StructType, list[str]] | None:
    """(columns, key) by the stream's first SCHEMA message."""
    for name, _ in files_of(path):
        for _, line in lines_of(path, name):
            m = message(line) if b"SCHEMA" in line else None
            if m and m["type"] == "SCHEMA" and m.get("stream") == stream:
                fields = [T.StructField(c, type_of(p if isinstance(p, dict) else {})) for c, p in (m.get("schema") or {}).get("properties", {}).items()]
                return T.StructType([*fields, T.StructField(FILE, T.StringType()), T.StructField(LINE, T.LongType())]), list(m.get("key_properties") or [])
    return None


def value_of(x, kind: T.DataType):
    """x as the column's type, null where it does not fit."""
    try:
        if x is None:
            return None
        if isinstance(kind, T.StringType):
            return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)
        if isinstance(kind, T.BooleanType):
            return x if isinstance(x, bool) else None
        if isinstance(kind, T.LongType):
            return x if type(x) is int and -(1 << 63) <= x < 1 << 63 else int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 62 else None
        if isinstance(kind, T.DoubleType):
            return float(x) if type(x) in (int, float) else None
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(x[:10])
        if isinstance(kind, T.TimestampType):
            at = datetime.datetime.fromisoformat(x)
            return at if at.tzinfo else at.replace(tzinfo=datetime.UTC)
    except (TypeError, ValueError, OverflowError):
        pass
    return None


class Range(InputPartition):
    def __init__(self, name: str, low: int, high: int):
        self.name, self.low, self.high = name, low, high


def ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    return [Range(name, low, min(low + size, n)) for name, n in files for low in range(0, n, size)]


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b)}


def test_of(filter: Filter):
    """(column, test of its value) for a filter that the reader can apply; None for others."""
    if isinstance(filter, Not):
        inner = test_of(filter.child)
        return inner and isinstance(filter.child, (EqualTo, In)) and (inner[0], lambda x: x is not None and not inner[1](x)) or None
    if len(getattr(filter, "attribute", ())) != 1:
        return None
    column = filter.attribute[0]
    if isinstance(filter, IsNull):
        return column, lambda x: x is None
    if isinstance(filter, IsNotNull):
        return column, lambda x: x is not None
    if isinstance(filter, EqualNullSafe):
        return column, lambda x: x == filter.value
    compare = _COMPARE.get(type(filter))
    return (column, lambda x: x is not None and compare(x, filter.value)) if compare else None


class _Records:
    """Rows of ranges; what the reader for batches and the one for streams have in common."""

    def __init__(self, schema: T.StructType, options: dict):
        self.columns, self.path, self.stream = schema, options["path"], options["stream"]
        self.size, self.tests = int(options.get("rangebytes", RANGE)), []

    def read(self, part: Range | None):
        if part is None:  # there are no files
            return
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.columns)
        kinds = [(f.name, f.dataType) for f in self.columns]
        names = [n for n, _ in kinds]
        tests = [(names.index(c), test) for c, test in self.tests]
        rows = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
        for at, line in lines_of(self.path, part.name, part.low, part.high):
            m = message(line)
            if not m or m["type"] != "RECORD" or m.get("stream") != self.stream or not isinstance(m.get("record"), dict):
                continue
            record = m["record"] | {FILE: part.name, LINE: at}
            row = [value_of(record.get(n), k) for n, k in kinds]
            if all(test(row[i]) for i, test in tests):
                rows.append(row)
                if len(rows) == _ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class TapReader(_Records, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges(files_of(self.path), self.size)


class FilteringTapReader(TapReader):
    """With filters pushed. Spark 4.1 keeps what was pushed last for plans of the same DataFrame that push nothing, so each plan has to push something."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - Spark's name
        for f in filters:
            test = test_of(f)
            if test and not isinstance(self.columns[test[0]].dataType, T.TimestampType):
                self.tests.append(test)
            else:
                yield f


class TapStreamReader(_Records, DataSourceStreamReader):
    """An offset is {"file": name of the last file read}; files of a lower name are not looked at again."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = files_of(self.path)
        return {"file": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([f for f in files_of(self.path) if start["file"] < f[0] <= end["file"]], self.size)

    def commit(self, end: dict) -> None:
        """Files stay where they are: other readers may have other offsets."""


class TapSource(DataSource):
    """Options: path, stream, rangeBytes; pushFilters as ``records`` sets it."""

    @classmethod
    def name(cls) -> str:
        return "tap"

    def _options(self) -> dict:
        found = {k.lower(): v for k, v in self.options.items()}
        for needed in ("path", "stream"):
            if not found.get(needed):
                raise ValueError(f"the tap source needs the option {needed}")
        return found

    def schema(self) -> T.StructType:
        options = self._options()
        found = schema_of(options["path"], options["stream"])
        if not found:
            raise ValueError(f"no SCHEMA message of stream {options['stream']}: give a schema")
        return found[0]

    def reader(self, schema: T.StructType) -> TapReader:
        options = self._options()
        return (FilteringTapReader if options.get("pushfilters") == "true" else TapReader)(schema, options)

    def streamReader(self, schema: T.StructType) -> TapStreamReader:  # noqa: N802
        return TapStreamReader(schema, self._options())


def records(spark: SparkSession, path: str, stream: str, where: Column | str | None = None, streaming: bool = False, **options: str) -> DataFrame:
    """The records of a stream, in a batch or as they arrive; in a batch, what a reader can test of ``where`` is tested there."""
    spark.dataSource.register(TapSource)
    if where is None or streaming:
        out = (spark.readStream if streaming else spark.read).format("tap").options(path=path, stream=stream, **options).load()
        return out if where is None else out.where(where)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tap").options(path=path, stream=stream, pushFilters="true", **options).load().where(F.col(FILE).isNotNull()).where(where)


def current(records: DataFrame, key: list[str]) -> DataFrame:
    """The last record of each key, without the columns that say where it was; a tap repeats records."""
    newest = Window.partitionBy(*key).orderBy(F.desc(FILE), F.desc(LINE))
    return records.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", FILE, LINE)


def states(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value (JSON text) of the STATE messages: the bookmark to go on from is the last one's."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value", F.monotonically_increasing_id().alias("line"))
    kind = F.get_json_object("value", "$.type")
    return lines.where(kind == "STATE").select("file", "line", F.get_json_object("value", "$.value").alias("value"))


def bookmark(spark: SparkSession, path: str) -> str | None:
    last = states(spark, path).agg(F.max_by("value", F.struct("file", "line"))).first()
    return last[0]


def messages(rows: DataFrame, stream: str, key: list[str], path: str) -> None:
    """Write rows as a tap would: every file begins with the SCHEMA and ends with a STATE that names its number of records."""
    json_types = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "number", "float": "number", "boolean": "boolean"}
    declared = {f.name: {"type": ["null", json_types.get(f.dataType.simpleString(), "string")]} | ({"format": "date"} if isinstance(f.dataType, T.DateType) else {"format": "date-time"} if isinstance(f.dataType, T.TimestampType) else {}) for f in rows.schema}
    head = json.dumps({"type": "SCHEMA", "stream": stream, "schema": {"properties": declared}, "key_properties": key})
    names, record = rows.columns, F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})

    def bracket(batches):
        import pyarrow as pa

        n, first = 0, True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
                first = False
            n += batch.num_rows
            yield batch
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"type": "STATE", "value": {"bookmarks": {stream: {"records": n}}}})])], names=["value"])

    assert names
    lines = rows.select(F.concat(F.lit(f'{{"type":"RECORD","stream":{json.dumps(stream)},"record":'), record, F.lit("}")).alias("value"))
    lines.mapInArrow(bracket, "value string").write.mode("append").text(path)


def registered(known: DataFrame, taps: list[dict], profile: str) -> DataFrame:
    """inlet_key, tap_name, config, stream_maps: ``known`` with a profile's taps, which replace rows of their key; a tap without a name is left out."""
    rows = {f"{profile}/{t['tap_name']}": (str(t["tap_name"]), json.dumps(t.get("config", {})), json.dumps(t.get("stream_maps", {}))) for t in taps if t.get("tap_name")}
    new = known.sparkSession.createDataFrame([(k, *v) for k, v in rows.items()], "inlet_key string, tap_name string, config string, stream_maps string")
    return known.select(*new.columns).join(F.broadcast(new.select("inlet_key")), "inlet_key", "left_anti").unionByName(new)  # a profile's taps: one row each
