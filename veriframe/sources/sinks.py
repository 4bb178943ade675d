"""Sinks: run artifacts by configuration hash, summaries, row CSV, triples and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.sources.profiles import Profile


def config_hash(config: Column) -> Column:
    return F.substring(F.sha2(config, 256), 1, 12)


def save_run(df: DataFrame, root: str, config_json: str) -> None:
    df.withColumn("config_hash", config_hash(F.lit(config_json))).write.mode("overwrite").partitionBy("config_hash").parquet(root)


def save_summary(summary: DataFrame, path: str) -> None:
    """A small summary as one JSON object per row."""
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def save_rows(df: DataFrame, path: str, arrays: tuple[str, ...] = ()) -> None:
    for c in arrays:
        df = df.withColumn(c, F.array_join(c, "|"))
    df.write.mode("overwrite").option("header", True).csv(path)


def identifier(kind: str, value: Column) -> Column:
    """Percent-encoded identifier; blanks are written as %20."""
    return F.concat(F.lit(f"urn:{kind}:"), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")))


def evidence_triples(evidence: DataFrame) -> DataFrame:
    """Subject, predicate, object rows of evidence packages, each once.

    A subject is one (package, block): named beside it, they let evidence that is already dealt by them stay where it is.
    """
    s = identifier("fact", F.concat_ws("/", F.col("package_id").cast("string"), F.col("block")))
    fixed = F.array(
        F.struct(F.lit("packageId").alias("p"), F.col("package_id").cast("string").alias("o")), F.struct(F.lit("blockName").alias("p"), F.col("block").alias("o")),
        F.struct(F.lit("declaredStatus").alias("p"), F.col("status").alias("o")), F.struct(F.lit("source").alias("p"), F.col("source").alias("o")),
        F.struct(F.lit("rule").alias("p"), F.col("rule").alias("o")), F.struct(F.lit("rationale").alias("p"), F.col("rationale").alias("o")))
    obs = F.transform(F.map_entries("observations"), lambda e: F.struct(F.concat(F.lit("observation/"), F.replace(F.url_encode(e["key"]), F.lit("+"), F.lit("%20"))).alias("p"), e["value"].alias("o")))
    key = ["package_id", "block"]
    rows = evidence.select(*key, s.alias("subject"), F.explode(F.concat(fixed, obs)).alias("t")).select(*key, "subject", F.col("t.p").alias("predicate"), F.col("t.o").alias("object"))
    return rows.filter(F.col("object").isNotNull()).distinct().drop(*key)


def ntriples(triples: DataFrame) -> DataFrame:
    lit = F.to_json(F.array("object"))
    body = F.expr("substring(j, 2, length(j) - 2)")
    return triples.withColumn("j", lit).select(F.concat(F.lit("<"), F.col("subject"), F.lit("> <urn:p:"), F.col("predicate"), F.lit("> "), body, F.lit(" .")).alias("value"))


def knowledge_graph(profile: Profile, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of profile claims, blocks and case decisions."""
    spark = decisions.sparkSession
    rel = profile.relations_df(spark)
    nodes = (
        rel.select(F.concat(F.lit("claim:"), "claim").alias("id"), F.lit("claim").alias("kind"))
        .unionByName(rel.select(F.concat(F.lit("block:"), "block").alias("id"), F.lit("evidence_block").alias("kind")))
        .unionByName(decisions.select(F.concat(F.lit("case:"), F.col("package_id").cast("string")).alias("id"), F.lit("case").alias("kind"))).distinct())
    edges = (
        rel.select(F.concat(F.lit("claim:"), "claim").alias("src"), F.lit("requires").alias("label"), F.concat(F.lit("block:"), "block").alias("dst"))
        .unionByName(decisions.select(F.concat(F.lit("case:"), F.col("package_id").cast("string")).alias("src"), F.col("decision").alias("label"), F.concat(F.lit("claim:"), "claim").alias("dst"))).distinct())
    return nodes, edges
