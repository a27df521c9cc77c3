"""Files in and out: discovery, Markdown and HTML texts, example banks, caches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.terms import html_text

MIME = {"md": "text/markdown", "markdown": "text/markdown", "html": "text/html", "htm": "text/html", "txt": "text/plain", "json": "application/json"}


def discover(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.md", "*.markdown")) -> DataFrame:
    """iri, path, content, content_hash, mime_type, modified of matching files under root, each once."""
    glob = "{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    suffix = F.lower(F.substring_index("path", ".", -1))
    return files.select(F.col("path").alias("iri"), F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", F.md5("content").alias("content_hash"), F.coalesce(F.try_element_at(kinds, suffix), F.lit("application/octet-stream")).alias("mime_type"), F.col("modificationTime").alias("modified"))


def fetch(sources: DataFrame) -> DataFrame:
    return sources.select("iri", "content")


def single(spark: SparkSession, path: str) -> DataFrame:
    return discover(spark, path, ("*",))


def parse(sources: DataFrame) -> DataFrame:
    """source_iri, text, content_hash: bytes read as UTF-8 (bad ones replaced); HTML without its tags."""
    text = F.decode("content", "UTF-8")
    return sources.select(F.col("iri").alias("source_iri"), F.when(F.col("mime_type") == "text/html", html_text(text)).otherwise(text).alias("text"), "content_hash")


def watch(spark: SparkSession, root: str, pattern: str = "*.md", per_trigger: int = 100) -> DataFrame:
    """The same as a stream of new files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(root)
    return files.select(F.col("path").alias("iri"), "content", F.md5("content").alias("content_hash"))


def read_bank(spark: SparkSession, path: str, schema: str = "subject string, predicate string, object_value string, confidence double, excerpt string, reviewer_note string") -> DataFrame:
    """JSON lines; those that cannot be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_bank(bank: DataFrame, path: str) -> None:
    bank.write.mode("overwrite").json(path)


def read_yaml_triples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, subject, predicate, object_value, confidence from YAML files with a list ``triples`` (or ``ground_truth`` of such).

    Each file is parsed where it is read; files that are no YAML are skipped.  Numbers become texts.
    """


    def run(batches):
        import pandas as pd
        import yaml

        names = ("subject", "predicate", "object_value")
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    data = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                data = data if isinstance(data, dict) else {}
                groups = data.get("ground_truth") or [{"source": path, "triples": data.get("triples")}]
                triples = [(g.get("source"), t) for g in groups for t in g.get("triples") or [] if isinstance(t, dict)]
                rows = [(source, *[None if t.get(k) is None else str(t[k]) for k in names], float(t.get("confidence", 1.0))) for source, t in triples]
                yield pd.DataFrame(rows, columns=["source", *names, "confidence"])

    schema = "source string, subject string, predicate string, object_value string, confidence double"
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(run, schema)


def valid_cache(cache: DataFrame, now, days: int = 30) -> DataFrame:
    return cache.withColumn("valid", F.col("fetched_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def cache_stats(cache: DataFrame, now, days: int = 30) -> DataFrame:
    return valid_cache(cache, now, days).agg(F.count("*").alias("total"), F.sum((~F.col("valid")).cast("int")).alias("stale"), F.sum(F.octet_length("body")).alias("bytes"))


def pruned_cache(cache: DataFrame, now, days: int = 30) -> DataFrame:
    """The entries that are still valid."""
    return valid_cache(cache, now, days).where("valid").drop("valid")


def updated_cache(cache: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The cache with newer entries in place of older ones of their keys; ``fetched_at`` tells which is newer."""
    rows = cache.unionByName(entries)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "fetched_at").alias("x")).select("x.*")


def through_cache(texts: DataFrame, cache: DataFrame, make, strategy: str, size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(texts with ``result`` and ``hit``, the entries to add): results by content, strategy and size are made once.

    ``make`` is a column function of the text; equal texts share an entry.
    """
    key = F.concat_ws("_", F.md5("text"), F.lit(strategy), F.lit(size))
    known = cache.select("key", F.col("body").alias("_body"))
    both = texts.withColumn("key", key).join(known, "key", "left")
    out = both.withColumns({"hit": F.col("_body").isNotNull(), "result": F.coalesce("_body", make("text"))}).drop("_body")
    fresh = out.where("NOT hit").groupBy("key").agg(F.first("result").alias("body")).withColumn("fetched_at", F.current_timestamp())
    return out, fresh


def embedding_rows(quads: DataFrame, embed) -> DataFrame:
    """entity_iri, text, vector: one row a subject, of its labels (its name where it has none); ``embed`` is a column function."""
    label = F.max(F.when(F.col("p") == "rdfs:label", F.col("o")))
    rows = quads.groupBy(F.col("s").alias("entity_iri")).agg(F.coalesce(label, F.regexp_replace(F.first("s"), "^.*[/#:]", "")).alias("text"))
    return rows.withColumn("vector", embed("text"))


def write_pages(pages: DataFrame, path: str) -> None:
    """One file row a page, as text, in a folder for each first letter of its subject's hash: many pages make few files."""
    pages.select(F.substring(F.md5("s"), 1, 1).alias("shard"), F.concat(F.col("page"), F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """pid, predicate, label from YAML: a list of {pid, label, predicates}."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    rows = [(x["pid"], p, x.get("label")) for x in yaml.safe_load(text) or [] for p in x.get("predicates", [])]
    return spark.createDataFrame(rows, "pid string, predicate string, label string")


def alignment_text(alignment: DataFrame) -> str:
    """The same back as YAML; the table is a vocabulary of some dozens of properties."""
    import yaml

    rows = alignment.groupBy("pid").agg(F.max("label").alias("label"), F.array_sort(F.collect_set("predicate")).alias("predicates")).orderBy("pid").collect()
    return yaml.safe_dump([{"pid": r.pid, "label": r.label, "predicates": list(r.predicates)} for r in rows], sort_keys=False)


def write(df: DataFrame, path: str, form: str) -> None:
    """Results as json, csv or parquet."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "csv": writer.option("header", True).csv, "parquet": writer.parquet}[form](path)


def sections(pages: DataFrame) -> DataFrame:
    """page_id, idx, depth, heading of HTML pages, in document order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("idx", "tag"))
    return rows.select("page_id", "idx", F.regexp_extract("tag", r"(?i)<h([1-6])", 1).cast("int").alias("depth"), html_text("tag").alias("heading"))
