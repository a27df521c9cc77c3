"""Graph-shaped inputs derived from the star schema and the documents table.

``star`` maps rows to quads by a declared mapping; the rest follow from it or from
the documents by hashes, so that every run and every engine sees the same rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions.terms import hash_share
from .plans.lineage import cut

#: table -> (class, name, key column, [(predicate, column, kind, target name)])
STAR = {
    "region": ("Region", "region", "r_regionkey", [("rdfs:label", "r_name", "literal", None)]),
    "nation": ("Nation", "nation", "n_nationkey", [("rdfs:label", "n_name", "literal", None), ("kc:partOf", "n_regionkey", "iri", "region")]),
    "customer": ("Customer", "customer", "c_custkey", [("rdfs:label", "c_name", "literal", None), ("kc:inNation", "c_nationkey", "iri", "nation"), ("kc:segment", "c_mktsegment", "literal", None), ("kc:balance", "cast(round(c_acctbal) as bigint)", "literal", None)]),
    "supplier": ("Supplier", "supplier", "s_suppkey", [("rdfs:label", "s_name", "literal", None), ("kc:inNation", "s_nationkey", "iri", "nation"), ("kc:balance", "cast(round(s_acctbal) as bigint)", "literal", None)]),
    "part": ("Part", "part", "p_partkey", [("rdfs:label", "p_name", "literal", None), ("kc:brand", "p_brand", "literal", None), ("kc:size", "p_size", "literal", None)]),
    "orders": ("Order", "order", "o_orderkey", [("kc:placedBy", "o_custkey", "iri", "customer"), ("kc:status", "o_orderstatus", "literal", None)]),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph, s, p, o, o_kind, confidence; each table is scanned once."""
    parts = []
    for name, (kind, path, key, columns) in STAR.items():
        cells = [F.struct(F.lit("rdf:type").alias("p"), F.lit("kc:" + kind).alias("o"), F.lit("iri").alias("o_kind"))]
        for p, c, o_kind, target in columns:
            o = F.expr(c).cast("string")
            cells.append(F.struct(F.lit(p).alias("p"), (F.concat(F.lit(f"kc:{target}/"), o) if target else o).alias("o"), F.lit(o_kind).alias("o_kind")))
        parts.append(read(spark, sf_dir, name).select(F.concat(F.lit(f"kc:{path}/"), F.col(key)).alias("s"), F.explode(F.array(*cells)).alias("c")).select("s", "c.*"))
    quads = reduce(DataFrame.unionByName, parts)
    return quads.select(F.lit("trusted").alias("graph"), "s", "p", "o", "o_kind", F.round(0.35 + 0.65 * hash_share("s", "p", "o"), 6).alias("confidence"))


def claims(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(token, kc:usedBy, source) with a confidence below 0.75 from each document that has the token."""
    token = F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("s")  # a plain explode would match twice, for a filter on the size
    docs = (read(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "source", token).where("s IS NOT NULL")
    confidence = F.round(0.7499 * hash_share(F.col("doc_id").cast("string"), F.lit("|"), "s"), 6)
    return docs.select("s", F.lit("kc:usedBy").alias("p"), F.col("source").alias("o"), confidence.alias("confidence"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_iri"))


def claims_by_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The claims in two parts: of documents whose id other rows have too, and of the others, which state no key twice (tokens of a row differ)."""
    docs = read(spark, sf_dir, "documents")
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return claims(spark, sf_dir, docs.limit(0)), claims(spark, sf_dir, docs)
    same = docs["doc_id"].eqNullSafe(again["doc_id"])
    return tuple(claims(spark, sf_dir, docs.join(again, same, how)) for how in ("left_semi", "left_anti"))


LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def first_places(text: str) -> dict[str, int]:
    """Each token of eight letters or more, in lower case, with the place where it is first found, which can be inside a longer one."""
    low = text.lower() if text.isascii() else text.translate(LETTERS)
    first: dict[str, int] = {}
    for m in re.finditer("[a-z]{8,}", low):
        first.setdefault(m[0], m.start())
    lengths = sorted({len(x) for x in first})
    for token in list(first):
        at = first[token]
        for k in lengths:
            if k >= len(token):
                break
            for i in range(len(token) - k + 1):
                if first.get(token[i : i + k], -1) > at + i:
                    first[token[i : i + k]] = at + i
    return first


def _placed(batches):
    import pyarrow as pa

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(ids), 256):  # so many texts at once
            found = [(d, o, at, x[at : at + 30]) for d, x in zip(ids[i : i + 256], texts[i : i + 256], strict=True) for o, at in first_places(x).items()]
            cells = zip(*found, strict=True) if found else [()] * 4
            kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["doc_id", "o", "start", "excerpt"])


def mentions(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    """(document, kc:mentions, token of eight letters or more); with ``places``, its first place as evidence.

    Places are found within the row, so nothing is shuffled.
    """
    docs = read(spark, sf_dir, "documents")
    if places:
        kind = docs.schema["doc_id"].dataType.simpleString()
        m = docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(_placed, f"doc_id {kind}, o string, start int, excerpt string")
    else:
        m = docs.select("doc_id", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), 0))).alias("o")).where("o IS NOT NULL")
    iri = F.concat(F.lit("doc:"), F.col("doc_id"))
    confidence = F.round(hash_share(F.col("doc_id").cast("string"), F.lit("|m|"), "o"), 6)
    claim = m.select(iri.alias("s"), F.lit("kc:mentions").alias("p"), "o", confidence.alias("confidence"), iri.alias("source_iri"), F.lit("root").alias("fragment_key"), *[F.col(x) for x in ("start", "excerpt") if places])
    return claim.select("*", F.col("start").alias("char_start"), (F.col("start") + F.length("o")).cast("int").alias("char_end")).drop("start") if places else claim


def customers_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("kc:customer/"), F.col("c_custkey")).alias("s"), "c_custkey", "c_nationkey", "c_mktsegment")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers; a tenth have a second one. source_iri: where each was read."""
    base = customers_nation(spark, sf_dir)
    one = base.select("s", F.col("c_nationkey").alias("n"), F.lit("doc:a").alias("source_iri"))
    two = base.where(hash_share("s") < 0.1).select("s", ((F.col("c_nationkey") + 1) % 25).alias("n"), F.lit("doc:b").alias("source_iri"))
    q = one.unionByName(two).select("s", F.lit("kc:inNation").alias("p"), F.concat(F.lit("kc:nation/"), F.col("n")).alias("o"), "source_iri")
    return q.withColumn("confidence", F.round(0.5 + 0.5 * hash_share("s", "o"), 6))


def old_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier content hashes of documents: a fifth have changed since, a tenth are new."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("fragment_key"), F.md5("text").alias("h"))
    return d.where(hash_share(F.lit("new|"), "fragment_key") >= 0.1).select("fragment_key", F.when(hash_share("fragment_key") < 0.2, F.md5(F.concat("h", F.lit("old")))).otherwise(F.col("h")).alias("content_hash"))


def sameas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment with keys that follow one another there."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    d = customers_nation(spark, sf_dir).withColumn("b", F.lead("s").over(w))
    return d.where("b IS NOT NULL").where(hash_share("s", "b") < 0.5).select(F.col("s").alias("a"), "b")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' (s, p, o) of the star's literals; each model gets some wrong."""
    d = star(spark, sf_dir).where("p IN ('kc:segment', 'kc:brand')").select("s", "p", "o", F.explode(F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))).alias("model"))
    return d.select("model", "s", "p", F.when(hash_share("model", "s", "p") < 0.2, F.concat("o", F.lit("?"))).otherwise(F.col("o")).alias("o"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, s, o: statements of a ground truth, with its own property names."""
    d = star(spark, sf_dir).where("p IN ('kc:segment', 'kc:brand', 'kc:inNation', 'kc:size')").where(hash_share(F.lit("t|"), "s", "p") < 0.8)
    return d.join(F.broadcast(alignment(spark)), d.p == F.col("predicate")).select("pid", "s", "o")


def alignment(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("P1", "kc:segment"), ("P2", "kc:brand"), ("P3", "kc:inNation"), ("P4", "kc:size")], "pid string, predicate string")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, p, o, confidence, domain: what a compiler found; 15 percent of the objects are wrong."""
    d = star(spark, sf_dir).where("p IN ('kc:segment', 'kc:brand', 'kc:inNation', 'kc:size')").where(hash_share(F.lit("e|"), "s", "p") < 0.7)
    o = F.when(hash_share(F.lit("x|"), "s", "p") < 0.15, F.concat("o", F.lit("!"))).otherwise(F.col("o"))
    return d.select("s", "p", o.alias("o"), "confidence", F.regexp_extract("s", "^kc:([a-z]+)/", 1).alias("domain"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler runs from events: one source, fragment and profile each."""
    e = read(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return e.select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("doc:"), F.col("user_id")).alias("source_iri"), F.concat(F.lit("f"), F.col("event_id") % 7).alias("fragment_key"), F.concat(F.lit("profile-"), F.col("event_id") % 3).alias("profile"),
        F.col("ts").alias("started_at"), outcome.alias("outcome"), F.floor("value").cast("long").alias("tokens"), F.col("event_type").alias("event_type"),
    )
