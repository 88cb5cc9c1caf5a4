"""The calls of an application over a corpus, with the limits that each accepts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import shortened
from folioscope.operators import audit, citations, graph, quality, search
from folioscope.operators.lineage import materialize
from folioscope.operators.statistics import table_counts
from folioscope.operators.tables import page


def clamped(value: float, low: float, high: float) -> float:
    """``value`` within [low, high]."""
    return max(low, min(high, value))


@dataclass(frozen=True)
class Corpus:
    """The tables of a corpus; concepts, edges and links may be missing."""

    sources: DataFrame
    chunks: DataFrame
    references: DataFrame
    concepts: DataFrame | None = None
    edges: DataFrame | None = None
    links: DataFrame | None = None
    domains: DataFrame | None = None

    def search(self, text: str, embedding: list[float] | None = None, limit: int = 10, context: str = "balanced", source_type: str | None = None, domain_id: str | None = None, use_graph: bool = False, use_citations: bool = False, citation_weight: float = 0.15, graph_weight: float = 0.2, scoring: str = "weighted") -> DataFrame:
        """Search by text, and by vector, graph and citations as far as they are given; limits 1-50."""
        t, v = search.CONTEXT_WEIGHTS[context]
        weights = {"text": t, "vector": v, "graph": graph_weight if use_graph else 0.0, "citation": clamped(citation_weight, 0, 1) if use_citations else 0.0}
        query = search.SearchQuery(text, embedding, int(clamped(limit, 1, 50)), weights, domain_id, source_type, scoring)
        if embedding is None:
            found = search.search_text(self.chunks, query)
        elif use_graph or use_citations:
            found = search.search_fused(self.chunks, self.sources, query, self._graph_scores(text) if use_graph else None)
        else:
            found = search.search_hybrid(self.chunks, self.sources, query)
        about = self.chunks.select("id", "source_id", "location", "content").join(self.sources.select(F.col("id").alias("source_id"), "title"), "source_id", "left")
        return found.join(about, "id").orderBy("rank")

    def _graph_scores(self, text: str) -> DataFrame | None:
        if self.concepts is None or self.edges is None or self.links is None:
            return None
        query = self.sources.sparkSession.createDataFrame([(text,)], "query string")
        return graph.graph_scores(self.edges, search.query_concepts(self.concepts, query), self.links)

    def fast_search(self, embedding: list[float], limit: int = 5) -> DataFrame:
        """Search by vector alone; limits 1-20."""
        return search.search_vector(self.chunks, search.SearchQuery(embedding=embedding, limit=int(clamped(limit, 1, 20))))

    def list_sources(self, limit: int = 100, offset: int = 0, source_type: str | None = None, domain_id: str | None = None) -> DataFrame:
        """Sources, the newest first."""
        rows = self.sources
        for column, value in (("source_type", source_type), ("domain_id", domain_id)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return page(rows, [F.desc("created_at"), F.col("id")], limit, offset)

    def source(self, source_id: str) -> DataFrame:
        """One source, no row if unknown."""
        return self.sources.where(F.col("id") == source_id)

    def source_by_key(self, key: str, value: str) -> DataFrame:
        """Sources whose metadata have a value under a key, such as doi."""
        return self.sources.where(F.get_json_object("metadata", f"$.{key}") == value)

    def sources_without_chunks(self) -> DataFrame:
        return self.sources.join(self.chunks.select(F.col("source_id").alias("id")), "id", "left_anti")

    def chunk_concepts(self, chunk_ids: DataFrame) -> DataFrame:
        """id and concepts of the given chunks (id); those without have an empty list."""
        met = chunk_ids.join(self.links.select(F.col("chunk_id").alias("id"), "concept_id"), "id")
        lists = met.groupBy("id").agg(F.sort_array(F.collect_set("concept_id")).alias("concepts"))
        kind = dict(lists.dtypes)["concepts"]
        return chunk_ids.join(lists, "id", "left").select("id", F.coalesce("concepts", F.array().cast(kind)).alias("concepts"))

    def cited_by(self, work: str, limit: int = 100) -> DataFrame:
        return citations.citing(self.references, work, limit)

    def cites(self, source_id: str) -> DataFrame:
        return self.references.where((F.col("citing") == source_id) & F.col("cited").isNotNull()).select("cited").distinct()

    def graph_neighbourhood(self, name: str, hops: int = 2, limit: int = 50) -> DataFrame:
        """Nodes near the concept of a name; hops 1-3, limits 1-100."""
        met = graph.resolve(self.concepts, name).select("id").first()
        return graph.neighbourhood(self.edges, str(met["id"]) if met else "", int(clamped(hops, 1, 3)), limit=int(clamped(limit, 1, 100)))

    def graph_path(self, a: str, b: str, hops: int = 5) -> DataFrame:
        """A shortest path between the concepts of two names."""
        ends = [graph.resolve(self.concepts, x).select("id").first() for x in (a, b)]
        return graph.shortest_path(self.edges, *[str(e["id"]) if e else "" for e in ends], hops)

    def list_concepts(self, concept_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """Concepts by name, of a type if given; limits 1-1000."""
        rows = self.concepts if concept_type is None else self.concepts.where(F.col("concept_type") == concept_type)
        return page(rows, [F.col("canonical_name"), F.col("id")], int(clamped(limit, 1, 1000)), offset)

    def concept(self, name: str, limit: int = 50) -> DataFrame:
        """The concept of a name or id with its edges, the strongest first: id, name, other, type, strength, outgoing; one row without edges."""
        met = graph.resolve(self.concepts, name).select("id", "name")
        ends = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", "strength", F.lit(True).alias("outgoing"))
        ends = ends.unionByName(self.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", "strength", F.lit(False).alias("outgoing")))
        return met.join(ends, "id", "left").orderBy(F.desc("strength"), "other", "type").limit(limit)

    def chunks_of_concept(self, name: str, limit: int = 20) -> DataFrame:
        """chunk_id, mention_type and relevance of the chunks that name a concept: definitions first, then the most relevant."""
        met = graph.resolve(self.concepts, name).select(F.col("id").alias("concept_id"))
        rank = F.when(F.col("mention_type") == "defines", 0).otherwise(1)
        rows = self.links.join(met, "concept_id").select("chunk_id", "mention_type", F.coalesce("relevance_score", F.lit(0.0)).alias("relevance"))
        return rows.orderBy(rank, F.desc("relevance"), "chunk_id", "mention_type").limit(limit)

    def cross_domain_concepts(self, name: str, links: DataFrame, least: float = 0.0) -> DataFrame:
        """other, link_type and confidence of the links (a, b, link_type, confidence) between domains at a concept, from either side."""
        met = graph.resolve(self.concepts, name).select("id")
        both = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "link_type", "confidence").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"), "link_type", "confidence"))
        return both.join(met, "id").where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "other").select("other", "link_type", "confidence")

    def explain_connection(self, a: str, b: str, hops: int = 5, most: int = 2) -> DataFrame:
        """step, name, type and the evidence (chunk_id, text, at most 300 characters) of a path between two concepts; steps without evidence have nulls."""
        path = materialize(self.graph_path(a, b, hops), "path")
        edges = self.edges if "evidence_chunk_ids" in self.edges.columns else self.edges.withColumn("evidence_chunk_ids", F.array().cast("array<string>"))
        proof = graph.path_evidence(path, edges, self.links, most)
        named = path.join(self.concepts.select(F.col("id").cast("string").alias("node"), "name"), "node", "left")
        texts = self.chunks.select(F.col("id").cast("string").alias("chunk_id"), shortened("content", 300).alias("text"))
        return named.join(proof.select("step", "chunk_id", "rank"), "step", "left").join(texts, "chunk_id", "left").select("step", "name", "type", "rank", "chunk_id", "text").orderBy("step", "rank")

    def citation_network(self, source_id: str, limit: int = 100) -> DataFrame:
        """direction (cites, cited_by), other and n of the works that a source cites and the sources that cite it."""
        out = self.references.where((F.col("citing") == source_id) & F.col("cited").isNotNull()).groupBy(F.col("cited").alias("other")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("cites"))
        into = citations.citing(self.references, source_id, limit).select(F.col("citing").alias("other"), "n", F.lit("cited_by").alias("direction"))
        return out.orderBy(F.desc("n"), "other").limit(limit).unionByName(into).select("direction", "other", "n")

    def coupled_sources(self, source_id: str, limit: int = 10, least: float = 0.1) -> DataFrame:
        """other, shared and strength of the sources that cite the same works."""
        return citations.similar_sources(citations.coupling(self.references, least), source_id, limit)

    def list_domains(self) -> DataFrame:
        """Domains with the counts of their sources and chunks."""
        counts = [t.groupBy(F.col("domain_id").alias("id")).agg(F.count_distinct("id").alias(n)) for n, t in (("sources", self.sources), ("chunks", self.chunks))]
        return self.domains.select("id", "name").join(counts[0], "id", "left").join(counts[1], "id", "left").fillna(0, ["sources", "chunks"]).orderBy("id")

    def assumptions(self, name: str) -> DataFrame:
        """Assumptions that the graph gives for the method of a name."""
        met = graph.resolve(self.concepts, name).select(F.col("id").alias("method"))
        return audit.assumptions_in_graph(self.edges, self.concepts).join(met, "method").orderBy("importance", F.desc("strength"), "assumption")

    def unlinked(self, samples: int = 5) -> DataFrame:
        """concept_type, n and the least ``samples`` names of the concepts without edges."""
        lost = quality.orphans(self.concepts, self.edges)
        counts = lost.groupBy("concept_type").agg(F.count("*").alias("n"))
        by = Window.partitionBy("concept_type").orderBy("name", "id")
        first = lost.withColumn("k", F.row_number().over(by)).where(F.col("k") <= samples).groupBy("concept_type").agg(F.array_sort(F.collect_list("name")).alias("names"))
        return counts.join(first, "concept_type", "left")

    def stats(self) -> DataFrame:
        tables = {"sources": self.sources, "chunks": self.chunks, "references": self.references, "concepts": self.concepts, "edges": self.edges, "links": self.links}
        return table_counts({k: t for k, t in tables.items() if t is not None})

    def health(self) -> bool:
        """Whether the tables can be read."""
        return all(t.limit(1).count() >= 0 for t in (self.sources, self.chunks))
