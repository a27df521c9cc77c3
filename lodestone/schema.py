"""Tables of the compiler, and names that all of it shares."""

from __future__ import annotations

from pyspark.sql import types as T

QUADS = T.StructType().add("graph", "string").add("s", "string").add("p", "string").add("o", "string").add("o_kind", "string").add("confidence", "double")
EVIDENCE = "source_iri string, fragment_key string, char_start int, char_end int, excerpt string"
FRAGMENTS = "source_iri string, fragment_key string, heading_path array<string>, heading_depth int, char_start int, char_end int, text string, content_hash string"
RUNS = "run_id long, source_iri string, fragment_key string, profile string, started_at timestamp, outcome string, prompt_tokens long, completion_tokens long, cost_usd decimal(12,6), diagnostics string"
LOG = "ts timestamp, operation string, subject string, payload string"

GRAPHS = ("trusted", "tentative", "draft", "vocab", "thesaurus", "inferred", "coverage", "rendered", "human-review")

# Prefixes of compact names.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "sh": "http://www.w3.org/ns/shacl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "prov": "http://www.w3.org/ns/prov#",
    "schema": "https://schema.org/",
    "dcterms": "http://purl.org/dc/terms/",
    "kc": "http://kc.example/ns/",
    "ex": "http://kc.example/entity/",
}
UNKNOWN_PREFIX = "http://kc.example/"
PROTECTED = ("rdf", "rdfs", "owl", "skos", "sh")
# What a statement can be.
STATUSES = ("observed", "extracted", "inferred", "verified", "disputed", "speculative", "normative", "predicted", "deprecated")
