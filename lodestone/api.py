"""One object for the whole compiler: a method for each command on data."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.terms import local_name
from .operators import consolidate, coreference, evaluate, gate, graph, knowledge, passes, text, vocab
from .operators.review import decisions, statements
from .plans import registry, rules
from .plans.lineage import cut
from .plans.sparql import Engine
from .sources import files
from .sources.store import Store


@dataclass
class Profile:
    """How a corpus is compiled; unknown keys of a file are dropped."""

    name: str = "default"
    version: int = 1
    fragmenter: str = "heading"
    extractor: str = "rules"
    coreference: str = "disabled"
    languages: tuple[str, ...] = ()
    min_length: int = 50
    max_length: int = 8000
    allowed_predicates: list[str] = field(default_factory=list)
    noise_sections: list[str] = field(default_factory=list)
    trusted: float = gate.TRUSTED
    tentative: float = gate.TENTATIVE
    max_triples: int = 50
    competency_questions: list[dict] = field(default_factory=list)
    construct_rules: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Profile:
        import yaml

        with open(path) as f:
            data = yaml.safe_load(f) or {}
        known = {x.name for x in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})


class Compiler:
    def __init__(self, spark: SparkSession, store: str, profile: Profile | None = None):
        self.spark, self.store, self.profile = spark, Store(spark, store), profile or Profile()

    # documents to triples

    def fragments(self, documents: DataFrame) -> DataFrame:
        """Fragments of (source_iri, text [, lang]) that pass the gate, noise sections left out.

        With coreference by rules, fragments and what is found in them are those of the resolved texts.
        """
        p = self.profile
        documents = coreference.resolve(documents, p.coreference)
        rows = registry.get("fragmenters", p.fragmenter)(documents).where(gate.gate_reason("text", lang=None, least=p.min_length, most=p.max_length, languages=()).isNull())
        if p.languages and "lang" in documents.columns:
            rows = rows.join(documents.where(F.col("lang").isin(*p.languages)).select("source_iri"), "source_iri", "left_semi")
        return rows.where(~gate.noise_section("fragment_key", p.noise_sections)) if p.noise_sections else rows

    def triples(self, documents: DataFrame) -> DataFrame:
        """Extracted, valid, allowed, deduplicated and routed triples with their evidence."""
        p = self.profile
        found = registry.get("extractors", p.extractor)(self.fragments(documents)).where(gate.evidence_valid())
        kept, _ = gate.ontology_filter(found, p.allowed_predicates)
        capped = gate.top_per_fragment(kept, p.max_triples).drop("n_capped")
        return consolidate.dedup_by_confidence(capped).withColumn("graph", gate.route("confidence", p.trusted, p.tentative)).where("graph <> 'discard'")

    def ingest(self, documents: DataFrame) -> None:
        self.store.load(self.triples(documents).select("graph", "s", "p", "o", F.lit("literal").alias("o_kind"), "confidence"))

    def ingest_path(self, root: str) -> None:
        self.ingest(files.parse(files.discover(self.spark, root)))

    # questions

    def query(self, sparql: str, include_tentative: bool = False) -> DataFrame:
        quads = self.store.read()
        return Engine(quads if include_tentative else quads.where("graph <> 'tentative'")).query(sparql)

    def update(self, sparql: str) -> None:
        """The store after an update, in one swap."""
        self.store.rewrite(lambda quads: Engine(quads).query(sparql))

    def competency(self) -> DataFrame:
        return rules.competency(self.store.read(), [(q["id"], q["sparql"]) for q in self.profile.competency_questions])

    def render(self) -> DataFrame:
        return knowledge.pages(self.store.read("trusted"))

    def context(self, most_words: int = 200) -> DataFrame:
        return text.context_block(self.store.read("trusted"), most_words)

    # passes

    def promote_tentative(self, claims: DataFrame) -> DataFrame:
        return consolidate.promotion_candidates(claims, self.profile.tentative, self.profile.trusted)

    def detect_contradictions(self, functional: list[str] | None = None) -> DataFrame:
        return consolidate.contradictions(self.store.read(), functional)

    def validate_shapes(self, shapes: list[tuple[str, str, str, str, str]]) -> DataFrame:
        return knowledge.violations(self.store.read(), shapes)

    def run_construct_rules(self, rounds: int = 1) -> DataFrame:
        return rules.construct(self.store.read(), self.profile.construct_rules, rounds=rounds)

    def run_owl(self) -> DataFrame:
        quads = self.store.read()
        return graph.new_facts(graph.owl_closure(quads), quads)

    def normalize(self, mapping: DataFrame | None = None) -> DataFrame:
        return vocab.normalise(self.store.read(), mapping)

    def benchmark(self, truth: DataFrame) -> DataFrame:
        return evaluate.exact_prf(self.store.read(), truth)

    def recompile(self, documents: DataFrame) -> DataFrame:
        """What a new compilation would add and remove."""
        return knowledge.semantic_diff(self.store.read(), self.triples(documents))

    def settle_contradictions(self, functional: list[str], at=None) -> DataFrame:
        """Penalise and demote in the store; the events, as they were found before it."""
        _, events = consolidate.settle_contradictions(self.store.read(), functional, threshold=self.profile.trusted, at=at)
        events = cut(events)
        self.store.rewrite(lambda quads: consolidate.settle_contradictions(quads, functional, threshold=self.profile.trusted, at=at)[0])
        return events

    def gc_tentative(self, tentative: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
        """(kept, archived) of tentative triples with first_seen; the archived ones leave the store."""
        kept, gone = consolidate.collect_garbage(tentative, F.lit(cutoff).cast("timestamp"))
        key, gone = ["graph", "s", "p", "o"], cut(gone)
        old = gone.select(F.lit("tentative").alias("graph"), "s", "p", "o").distinct()
        self.store.rewrite(lambda quads: quads.join(old, key, "left_anti").select(*quads.columns))
        return kept, gone

    def verify_triples(self, judged: DataFrame) -> DataFrame:
        """Triples with supported and score, and what is to become of each."""
        return consolidate.verify(judged)

    def deduplicate_entities(self, vectors: DataFrame | None = None, least: float = 0.92) -> DataFrame:
        """Writes owl:sameAs between names that are alike; the links."""
        quads = self.store.read()
        vectors = vectors if vectors is not None else passes.encoded(passes.labels_of(quads, "trusted"))
        _, links = passes.deduplicate_entities(quads, vectors, least)
        return self._linked(links)

    def normalize_predicates(self, vectors: DataFrame | None = None, least: float = 0.88) -> DataFrame:
        """Writes owl:equivalentProperty between predicates that are alike; the links."""
        quads = self.store.read()
        names = quads.select(F.col("p").alias("iri")).distinct().withColumn("label", local_name("iri"))
        _, links = passes.normalise_predicates(quads, vectors if vectors is not None else passes.encoded(names), least)
        return self._linked(links)

    def _linked(self, links: DataFrame) -> DataFrame:
        links = cut(links)
        self.store.load(links)
        return links

    def review(self, labelled: DataFrame) -> DataFrame:
        """Writes what annotated tasks accept or correct to the review graph; the decisions."""
        decided = cut(decisions(labelled))
        self.store.load(statements(decided).withColumn("o_kind", F.lit("literal")))
        return decided

    def tune(self, found: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """Prompt patches for the matches of an evaluation."""
        return evaluate.prompt_patches(evaluate.patterns(evaluate.by_property(found)), labels)

    def recall_gap(self, found: DataFrame, truth: DataFrame, below: float = 0.5) -> DataFrame:
        return evaluate.recall_gaps(evaluate.recall_by_property(found, truth), below)

    def clear_graph(self, name: str) -> None:
        self.store.clear(name)
