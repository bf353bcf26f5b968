"""Property graphs as node and edge tables: build, quality, schema aggregation."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators.numbering import ranked
from docmill.session import scratch_path


# --- build ----------------------------------------------------------------------------------

def source_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts to extract from: a document's non-blank chunks, else the whole document."""
    texts = chunks.select("document_id", F.col("chunk_id").alias("source_chunk_id"),
                          tx.strip(F.coalesce("text", F.lit(""))).alias("chunk_text"))
    joined = docs.join(texts.filter("chunk_text <> ''"), "document_id", "left")
    return joined.select(
        F.concat_ws(":", "document_id", "source_chunk_id").alias("id"), "document_id",
        "document_name", "company_code", "source_path", "source_chunk_id",
        F.coalesce("chunk_text", "text").alias("text"))


def extraction_properties(properties: Column, lineage: dict[str, Column], allowed: Sequence[str],
                          evidence: Column, confidence: Column | None = None) -> Column:
    """Allowed properties plus lineage; NULLs and ids drop out, evidence is cut at 1000."""
    extra = {**lineage, "evidence_text": F.substring(tx.strip(evidence), 1, 1000)}
    if confidence is not None:
        extra["confidence"] = F.coalesce(F.try_element_at(properties, F.lit("confidence")),
                                         confidence.cast("string"))
    added = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))])
    names = F.array(*[F.lit(a) for a in allowed if a != "id"])
    kept = F.map_filter(properties, lambda k, v: ~F.array_contains(F.array(
        *[F.lit(k) for k in extra]), k))
    return F.map_filter(F.map_concat(kept, added),
                        lambda k, v: F.array_contains(names, k) & v.isNotNull())


def build_graph(graph_docs: DataFrame, node_types: DataFrame, edge_types: DataFrame
                ) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from documents with ``ord``, ``nodes`` and ``relationships`` arrays.

    Only types of the label tables stay, and only edges whose ends are kept nodes of the
    same document.  The last write wins per node and pair; max_by combines map-side.
    """
    def allowed(rows: DataFrame, kind: str, types: DataFrame) -> DataFrame:
        return rows.join(types.select(F.col("label").alias(kind)).distinct(), kind, "left_semi")

    own = allowed(graph_docs.select("ord", F.posexplode("nodes").alias("i", "n"))
                  .withColumn("kind", F.col("n.type")), "kind", node_types)
    places = own.select("ord", F.col("n.id").alias("id")).distinct()
    links = allowed(graph_docs.select("ord", F.posexplode("relationships").alias("i", "r"))
                    .withColumn("kind", F.col("r.type")), "kind", edge_types)
    for end in ("source", "target"):
        links = links.withColumn("id", F.col(f"r.{end}")).join(places, ["ord", "id"], "left_semi")
    nodes = own.groupBy(F.col("n.id").alias("id")).agg(
        F.max_by(F.struct("n.type", "n.properties"), F.struct("ord", "i")).alias("v"))
    edges = links.groupBy(F.col("r.source").alias("src"), F.col("r.target").alias("dst")).agg(
        F.max_by(F.struct("r.type", "r.properties"), F.struct("ord", "i")).alias("v"))
    return (nodes.select("id", F.col("v.type").alias("entity_type"),
                         F.col("v.properties").alias("props")),
            edges.select("src", "dst", F.col("v.type").alias("relationship_type"),
                         F.col("v.properties").alias("props")))


def match_chunks_to_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each file with the chunk of the same path, else of its name where that is unique."""
    meta = ["document_id", "document_name", "company_code"]
    by_path = chunks.groupBy(F.col("source_path").alias("path")).agg(
        F.min_by(F.struct(*meta), "chunk_id").alias("p"))
    name = F.element_at(F.split("source_path", "/"), -1)
    by_name = chunks.groupBy(name.alias("name")).agg(
        F.count("*").alias("n"), F.first(F.struct(*meta)).alias("b")).filter("n = 1")
    rows = files.withColumn("name", F.element_at(F.split("path", "/"), -1)) \
        .join(by_path, "path", "left").join(by_name.select("name", "b"), "name", "left")
    hit = F.coalesce("p", "b")
    stem = tx.file_stem(F.col("path"))
    return rows.select("path", F.coalesce(hit["document_id"], stem).alias("document_id"),
                       F.coalesce(hit["document_name"], stem).alias("document_name"),
                       F.coalesce(hit["company_code"], F.lit("UNKNOWN")).alias("company_code"))


# --- quality ----------------------------------------------------------------------------------

def _prop(name: str) -> Column:
    return F.nullif(F.try_element_at("props", F.lit(name)), F.lit(""))


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends counted per node; hubs are pre-aggregated before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def quality_issues(nodes: DataFrame, edges: DataFrame, documents: DataFrame,
                   edge_types: DataFrame, chunk_documents: DataFrame | None = None,
                   min_confidence: float = 0.75) -> DataFrame:
    """(issue, subject): orphans, missing lineage, dangling chunks, weak or unknown edges."""
    chunk_documents = chunk_documents if chunk_documents is not None else documents
    edge_id = F.concat(F.col("src"), F.lit("->"), F.col("dst"))
    document = F.coalesce(_prop("source_document_id"), _prop("document_id"))
    chunk = F.coalesce(_prop("source_chunk_id"), _prop("chunk_id"))
    flat = edges.select(edge_id.alias("edge"), "relationship_type", document.alias("document_id"),
                        chunk.alias("chunk_id"), _prop("source_path").alias("source_path"),
                        F.coalesce(_prop("confidence").cast("double"), F.lit(0.0))
                        .alias("confidence"))

    def issue(name: str, df: DataFrame, subject: str) -> DataFrame:
        return df.select(F.lit(name).alias("issue"), F.col(subject).alias("subject"))
    orphans = nodes.filter(~F.col("id").startswith("document:")).select("id") \
        .join(degrees(edges), "id", "left_anti")
    unknown = flat.join(edge_types.select(
        F.col("label").alias("relationship_type")), "relationship_type", "left_anti")
    known = documents.select("document_id").distinct()
    chunk_known = chunk_documents.select("document_id").distinct()
    node_docs = nodes.withColumn("document_id", _prop("document_id")).filter(
        F.col("document_id").isNotNull() & (F.col("entity_type").isin("Chunk", "SourceChunk")
                                            | F.col("id").startswith("source_chunk:")))
    dangling = issue("dangling_chunk_reference",
                     flat.filter(F.col("chunk_id").isNotNull())
                     .join(chunk_known, "document_id", "left_anti"), "chunk_id") \
        .unionByName(issue("dangling_chunk_reference",
                           node_docs.join(known, "document_id", "left_anti"), "id"))
    return functools.reduce(DataFrame.unionByName, [
        issue("orphan_node", orphans, "id"),
        issue("missing_document_lineage", flat.filter(
            F.col("document_id").isNull() | F.col("source_path").isNull()), "edge"),
        dangling.distinct(),
        issue("low_confidence_edge", flat.filter(F.col("confidence") < min_confidence), "edge"),
        issue("invalid_relationship", unknown, "relationship_type").distinct()])


def quality_report(nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: counts per issue, graph size and overall validity."""
    kinds = ("orphan_node", "missing_document_lineage", "dangling_chunk_reference",
             "low_confidence_edge", "invalid_relationship")
    counts = issues.agg(*[F.count_if(F.col("issue") == k).alias(k) for k in kinds],
                        (F.count("*") == 0).alias("is_valid"))
    return counts.select("*", nodes.select(F.count("*")).scalar().alias("node_count"),
                         edges.select(F.count("*")).scalar().alias("edge_count"))


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes reachable within ``hops`` directed steps, with their distance.

    Each hop's frontier is written to the shared checkpoint folder, so that the next hop
    reads it instead of planning all hops before it again.
    """
    def kept(df: DataFrame) -> DataFrame:
        path = scratch_path(df.sparkSession, "hop")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    frontier = kept(start.select("id").distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    for depth in range(1, hops + 1):
        step = edges.select("src", F.col("dst").alias("id")).join(
            frontier.select(F.col("id").alias("src")), "src", "left_semi").select("id").distinct()
        frontier = kept(step.join(reached.select("id"), "id", "left_anti")
                        .withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(frontier)
    return reached


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per node and per link, ready for a line-oriented file."""
    node = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "entity_type",
                                           "props")).alias("value"))
    link = edges.select(F.to_json(F.struct(
        F.lit("link").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"),
        "relationship_type", "props")).alias("value"))
    return node.unionByName(link)


def read_node_link(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = lines.select(F.from_json("value", "kind STRING, id STRING, entity_type STRING, "
                                      "source STRING, target STRING, relationship_type STRING, "
                                      "props MAP<STRING,STRING>").alias("j")).select("j.*")
    return (parsed.filter("kind = 'node'").select("id", "entity_type", "props"),
            parsed.filter("kind = 'link'").select(
                F.col("source").alias("src"), F.col("target").alias("dst"),
                "relationship_type", "props"))


# --- schema discovery ----------------------------------------------------------------------------

def aggregate_labels(proposals: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Per canonical label: occurrences, files, mean confidence.

    ``proposals``: ord, file_path, label, aliases, evidence_text, confidence.
    Lists of files, aliases and examples come from label_details.
    """
    rows = canonical_labels(proposals, canonical)
    per = rows.groupBy("label", "file_path").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"))
    return per.groupBy("label").agg(
        F.sum("n").alias("occurrence_count"), F.count("*").alias("source_file_count"),
        F.round(F.sum("c") / F.sum("n"), 4).alias("average_confidence"))


def canonical_labels(proposals: DataFrame, canonical: DataFrame | None) -> DataFrame:
    if canonical is None:
        return proposals
    small = canonical.select("label", "canonical_label")
    return proposals.join(small, "label", "left").withColumn(
        "label", F.coalesce("canonical_label", "label")).drop("canonical_label")


def label_details(proposals: DataFrame, kind: str, canonical: DataFrame | None = None,
                  first: int | None = None) -> DataFrame:
    """(label, value, position) of distinct files, aliases or examples in first-seen order.

    Distinct values keep their earliest position, found by a combining minimum;
    ``first`` keeps the leading ones (examples keep five).
    """
    from pyspark.sql import Window

    column = {"files": F.array("file_path"), "aliases": F.col("aliases"),
              "examples": F.array("evidence_text")}[kind]
    rows = canonical_labels(proposals, canonical).select(
        "label", "ord", F.posexplode(column).alias("i", "value"))
    seen = rows.groupBy("label", "value").agg(F.min(F.struct("ord", "i")).alias("at"))
    order = Window.partitionBy("label").orderBy("at")
    out = seen.withColumn("position", F.row_number().over(order)).drop("at")
    return out.filter(F.col("position") <= first) if first else out


def merge_labels(items: DataFrame, canonical: DataFrame, kind: str = "node") -> DataFrame:
    """Merge aggregated labels: summed counts, united files, weighted confidence.

    ``items``: label, occurrence_count, source_files, average_confidence.
    """
    normal = tx.node_label if kind == "node" else tx.relationship_label
    rows = canonical_labels(items, canonical).withColumn("label", normal(F.col("label")))
    files = rows.select("label", F.explode("source_files").alias("f")).distinct() \
        .groupBy("label").agg(F.count("*").alias("source_file_count"))
    merged = rows.groupBy("label").agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        F.round(F.sum(F.col("average_confidence") * F.col("occurrence_count"))
                / F.sum("occurrence_count"), 4).alias("average_confidence"))
    return merged.join(files, "label", "left")


def keep_stable_labels(items: DataFrame, min_occurrences: int = 5, min_files: int = 3,
                       protected: Sequence[str] = ()) -> DataFrame:
    return items.filter((F.col("occurrence_count") >= min_occurrences)
                        | (F.col("source_file_count") >= min_files)
                        | F.col("label").isin(list(protected)))


def select_labels(items: DataFrame, allowed: DataFrame, limit: int) -> DataFrame:
    """Allowed labels that occur; over the limit the most frequent ones, allowed order on ties.

    ``allowed``: label, position.
    """
    if limit <= 0:
        raise ValueError("limit must be positive.")
    rows = items.join(allowed, "label")
    return rows.orderBy(F.desc("occurrence_count"), F.desc("source_file_count"),
                        "position").limit(limit)


def per_file_labels(proposals: DataFrame, kept: DataFrame) -> DataFrame:
    """(file_path, label) pairs of kept labels."""
    return proposals.select("file_path", "label").distinct() \
        .join(kept.select("label"), "label", "left_semi")


def canonicalization_report(labels: DataFrame, kind: str = "node") -> DataFrame:
    """Raw and canonical label counts and how many labels the normaliser changes."""
    normal = tx.node_label if kind == "node" else tx.relationship_label
    rows = labels.select("label").distinct().withColumn("canonical", normal(F.col("label")))
    return rows.agg(F.count("*").alias("raw_labels"),
                    F.countDistinct("canonical").alias("canonical_labels"),
                    F.count_if(F.col("label") != F.col("canonical")).alias("changed_labels"))


def batches(items: DataFrame, size: int, kind: str = "node") -> DataFrame:
    """Labels ordered by family, then label, numbered into batches."""
    keyed = items.withColumn("family", tx.label_family(
        F.col("label"), F.coalesce("aliases", F.array().cast("array<string>")), kind))
    return ranked(keyed, [], ["family", "label"], "_n").withColumn(
        "batch", F.floor(F.col("_n") / size)).drop("_n")


def compact_properties(contract: DataFrame) -> DataFrame:
    """Unique property names across labels in first-seen order, ids left out.

    ``contract``: position, label, properties.
    """
    rows = contract.select("position", F.posexplode("properties").alias("i", "name"))
    return rows.filter("name <> 'id'").groupBy("name").agg(
        F.min(F.struct("position", "i")).alias("at")).orderBy("at").select("name")


def property_definitions(contract: DataFrame) -> DataFrame:
    """(label, name, description): each label's properties, the first of a name wins.

    ``contract``: position, label, properties array<struct<name, description>>.
    """
    rows = contract.select("label", "position", F.posexplode("properties").alias("i", "p"))
    return rows.groupBy("label", F.col("p.name").alias("name")).agg(
        F.min_by("p.description", F.struct("position", "i")).alias("description"))


def contract_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The non-blank trimmed values of one named column of a contract CSV."""
    value = tx.strip(F.col(column))
    return spark.read.option("header", True).csv(path).select(value.alias(column)) \
        .filter(F.col(column) != "")


def pending_chunks(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks without a successful latest record in the append-only log."""
    from docmill.operators.evaluation import latest_per_key

    done = latest_per_key(log, ["chunk_id"], ["offset"]).filter("status = 'success'")
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Node and edge tables, one row per key as a uniqueness constraint would ask."""
    nodes.dropDuplicates(["entity_type", "id"]).write.mode("overwrite").parquet(f"{root}/nodes")
    edges.dropDuplicates(["src", "dst", "relationship_type"]).write.mode("overwrite").parquet(f"{root}/edges")
