"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import jaccard, packing, quality, simhash, substring, toxicity
from tilewright.llm.common import free_name, numbered, saved, table
from tilewright.llm.graph import components


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. It is fitted on the labelled rows of sf_dir."""
    chain = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).filter(~F.col("is_toxic")).select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is more likely the lowest than not go. The model is fitted on the labelled rows of sf_dir."""
    model = quality.fit(table(spark, sf_dir, "documents"), quality.grades(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).filter("keep").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, the first one of those that repeat it. Linked are rows by op3's
    fingerprints, and rows whose five-word shingles have a Jaccard similarity of 0.8 at least. Rows with a null id can be no
    group's smallest and stay. Rows that share an id but not a text are rows of their own."""
    # Rows are picked by number, so that each text goes through one join; the numbers are written with the rows.
    row = free_name("_row", docs.columns)
    rows = numbered(docs, row, "rows")
    nodes, alike = jaccard.links(rows, id_col=row)
    nodes = nodes.withColumnRenamed(row, "_row")
    close = simhash.near_duplicates(rows, id_col=row).withColumnRenamed(row, "_row").filter(F.col("_row") != F.col("component_id")).select("_row", "component_id")
    close = close.join(nodes.withColumnRenamed("node", "a").hint("merge"), "_row").select("a", F.col("component_id").alias("_row"))
    close = close.join(nodes.withColumnRenamed("node", "b").hint("merge"), "_row").select("a", "b")
    of = components(alike.unionByName(close.filter("a != b").distinct()))
    named = nodes.join(of.hint("merge"), "node", "left").select("_row", F.coalesce("component", "node").alias("component"))
    ids = rows.select(F.col(row).alias("_row"), "doc_id")
    named = named.join(ids.hint("merge"), "_row").filter("doc_id is not null")
    heads = named.groupBy("component").agg(F.min(F.struct("doc_id", "_row")).alias("_least")).select(F.col("_least._row").alias(row))
    picked = heads.unionByName(ids.filter("doc_id is null").select(F.col("_row").alias(row)))
    return rows.join(picked.hint("merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; what stays is joined by single spaces. A document stays if all its words went, with an empty text; a null text becomes an empty one."""
    # Other columns travel under names of their own, whatever they are called.
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    out = substring.deduplicated(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in own.items()]), carry=tuple(own.values()))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[(made[c] if c in made else F.col(own[c])).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("SimHash near-dedup", drop_near_copies), ("substring dedup", drop_repeats), ("best-fit packing", pack)]

#: The stages' models and tokens are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
