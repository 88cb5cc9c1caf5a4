"""Keeping a corpus in order: duplicates, merges of concepts, orphans, pruning and links between domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import canonical_name
from folioscope.operators.lineage import materialize
from folioscope.operators.search import batch_vector_search
from folioscope.operators.tables import repointed

#: Names that are no concepts.
CODE_NAME = r"[a-z]_[a-z]|^\w+\.\w+"
NUMBERED = "theorem lemma proposition corollary definition example equation figure table section chapter exercise problem remark property result step case claim condition rule algorithm assumption axiom conjecture fact formula hypothesis inequality observation postulate principle proof"
NUMERIC_NAME = rf"^({'|'.join(NUMBERED.split())}) \d+(\.\d+)*$|^\d+(\.\d+)+$"


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """old and new: chunks of one source and content hash, and the one that is kept (least page, unknown pages last, then created first, then least id)."""
    by = Window.partitionBy("source_id", F.lower("content_hash")).orderBy(F.asc_nulls_last("page_start"), "created_at", "id")
    rows = chunks.where("content_hash IS NOT NULL").select("id", F.first("id").over(by).alias("new"))
    return rows.where("id <> new").select(F.col("id").alias("old"), "new").distinct()


def duplicate_groups(chunks: DataFrame, limit: int = 15) -> DataFrame:
    """The largest groups of equal source and hash: source_id, hash, n."""
    groups = chunks.where("content_hash IS NOT NULL").groupBy("source_id", F.lower("content_hash").alias("hash")).agg(F.count_distinct("id").alias("n")).where("n > 1")
    return groups.orderBy(F.desc("n"), "source_id", "hash").limit(limit)


def without_duplicates(chunks: DataFrame, links: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without the duplicates, and links (chunk_id, ...) moved to the chunks that stay, repeats dropped."""
    gone = mapping.select(F.col("old").alias("id"))
    return chunks.join(gone, "id", "left_anti"), repointed(links, "chunk_id", mapping).dropDuplicates()


def repointed_evidence(edges: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Edges whose arrays of chunk ids name the chunks that stay (mapping: old, new), each once; null arrays stay null."""
    rows = edges.withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "evidence")
    each = rows.select("__row", F.explode(column).alias("old")).join(mapping, "old", "left")
    lists = each.groupBy("__row").agg(F.sort_array(F.collect_set(F.coalesce("new", "old"))).alias("__ids"))
    fixed = F.when(F.col(column).isNotNull(), F.coalesce("__ids", F.col(column))).alias(column)
    return rows.join(lists, "__row", "left").select(*[fixed if c == column else F.col(c) for c in edges.columns])


def new_or_known(extracted: DataFrame, known: DataFrame) -> DataFrame:
    """position, canonical, is_new and match of extracted names (position, name): the first of a canonical name is new unless it is known; later ones match it."""
    rows = extracted.withColumn("canonical", canonical_name("name"))
    first = F.min("position").over(Window.partitionBy("canonical"))
    rows = rows.withColumn("first", first).join(known.select(F.col("canonical_name").alias("canonical"), F.lit(True).alias("known")), "canonical", "left")
    return rows.select("position", "canonical", (F.col("known").isNull() & (F.col("position") == F.col("first"))).alias("is_new"), F.when(F.col("known").isNull(), F.col("first")).alias("match"))


def plural_pairs(concepts: DataFrame) -> DataFrame:
    """keep and gone: names that are one word's singular and plural: -s, -es, -ses for -sis, -ices for -ix; the first rule that fits counts."""
    name = F.col("canonical_name")
    rules = [F.when(name.rlike("s$"), F.regexp_replace(name, "s$", "")), F.when(name.rlike("es$"), F.regexp_replace(name, "es$", "")), F.when(name.rlike("ses$"), F.regexp_replace(name, "ses$", "sis")), F.when(name.rlike("ices$"), F.regexp_replace(name, "ices$", "ix"))]
    tried = concepts.where("length(canonical_name) > 1").select(F.col("id").alias("gone"), F.posexplode(F.array(*rules)).alias("rule", "single")).where("single IS NOT NULL AND single <> ''")
    met = tried.join(concepts.select(F.col("id").alias("keep"), F.col("canonical_name").alias("single")), "single").where("keep <> gone")
    return met.groupBy("gone").agg(F.min(F.struct("rule", "keep")).alias("b")).select("gone", F.col("b.keep").alias("keep"))


def form_pairs(concepts: DataFrame, form: Column) -> DataFrame:
    """keep and gone: concepts whose name becomes another's under ``form``, such as one without hyphens or article."""
    rows = concepts.select(F.col("id").alias("gone"), "canonical_name", form.alias("plain")).where("plain <> canonical_name")
    return rows.join(concepts.select(F.col("id").alias("keep"), F.col("canonical_name").alias("plain")), "plain").groupBy("gone").agg(F.min("keep").alias("keep"))


def resolved_chains(pairs: DataFrame) -> DataFrame:
    """old and new with every chain (a to b, b to c) followed to its end; the steps double each round. A circle ends at its least id."""
    mapping = materialize(pairs.where("gone <> keep").groupBy(F.col("gone").alias("old")).agg(F.min("keep").alias("new")), "mapping")
    written = mapping
    while True:
        far = mapping.select(F.col("old").alias("new"), F.col("new").alias("far"))
        step = materialize(mapping.join(far, "new", "left").select("old", F.when(F.col("far") == F.col("old"), F.least("old", "new")).otherwise(F.coalesce("far", "new")).alias("new"), F.col("new").alias("was")), "mapping", written)
        written = step
        mapping = step.select("old", "new")
        if not step.where("new <> was").limit(1).count():
            return mapping.where("old <> new")


def merged_concepts(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Concepts that stay, with the names and aliases of those merged into them."""
    lost = mapping.join(concepts.select(F.col("id").alias("old"), "name", "aliases"), "old").select(F.col("new").alias("id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    more = lost.groupBy("id").agg(F.collect_set("alias").alias("more"))
    rows = concepts.join(mapping.select(F.col("old").alias("id")), "id", "left_anti").join(more, "id", "left")
    empty = F.array().cast("array<string>")
    return rows.withColumn("aliases", F.sort_array(F.array_distinct(F.concat(F.coalesce("aliases", empty), F.coalesce("more", empty))))).select(*concepts.columns)


def merged_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges moved to the concepts that stay; loops vanish, of parallel edges of a type the strongest stays."""
    moved = repointed(repointed(edges, "src", mapping), "dst", mapping).where("src <> dst")
    return moved.groupBy("src", "dst", "type").agg(F.max("strength").alias("strength"))


def orphans(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts at neither end of any edge."""
    return concepts.join(edges.select(F.col("src").alias("id")), "id", "left_anti").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def prunable(concepts: DataFrame, links: DataFrame, protected: list[DataFrame], pattern: str | None = None, longer_than: int | None = None, most_links: int = 5) -> DataFrame:
    """id of concepts with a name that fits ``pattern`` or is longer than ``longer_than``, with at most ``most_links`` chunk links, and in no protected table (concept_id)."""
    odd = F.lit(False)
    if pattern is not None:
        odd = odd | F.col("canonical_name").rlike(pattern)
    if longer_than is not None:
        odd = odd | (F.length("canonical_name") > longer_than)
    rows = concepts.where(odd).select("id")
    many = links.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > most_links)
    rows = rows.join(many, "id", "left_anti")
    for table in protected:
        rows = rows.join(table.select(F.col("concept_id").alias("id")), "id", "left_anti")
    return rows


def nearest_between(left: DataFrame, right: DataFrame, threshold: float, per_row: int) -> DataFrame:
    """a, b, cosine and rank: for each row of ``left`` its nearest of ``right`` with a cosine of at least ``threshold``.

    Both need id and embedding. Meant for a stated set on the left, such as a
    domain's most linked concepts or the orphans, against all rows of the right, block by block.
    """
    near = batch_vector_search(right.select("id", "embedding"), left.select("id", "embedding"), per_row, least=threshold)
    return near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "cosine", "rank")


def domain_links(found: DataFrame, least: float = 0.9, same: float = 0.95) -> DataFrame:
    """Links worth keeping, EQUIVALENT from ``same`` on, else ANALOGOUS."""
    return found.where(F.col("cosine") >= least).select("a", "b", F.when(F.col("cosine") >= same, "EQUIVALENT").otherwise("ANALOGOUS").alias("link_type"), F.col("cosine").alias("confidence"))


def inherited_domain(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their source's domain, and the ids of those where it differed, nulls compared as values."""
    about = sources.select(F.col("id").alias("source_id"), F.col("domain_id").alias("__d"))
    rows = chunks.join(about, "source_id", "left")
    fixed = rows.withColumn("domain_id", F.coalesce("__d", "domain_id")).drop("__d").select(*chunks.columns)
    return fixed, rows.where(F.col("__d").isNotNull() & ~F.col("domain_id").eqNullSafe(F.col("__d"))).select("id").distinct()
