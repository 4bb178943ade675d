"""File sources and sinks as round trips: a given table is written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.operators.gates import clip01
from veriframe.plans.registry import query
from veriframe.session import scratch_folder
from veriframe.sources import files, sinks, specs


def _place(t, name: str) -> str:
    """A fresh folder in the shared one; never a machine-local path on a cluster."""
    return scratch_folder(t.spark, name)


@query("s01_json_lines", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def s01(t):
    """Rows written as JSON lines, read with an explicit schema."""
    path = _place(t, "jsonl")
    t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.json(path)
    got = files.read_jsonl(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double")
    return got.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("s02_json_artifacts", "SELECT conv_id, count(*) AS turns, max(length(text))::BIGINT AS longest FROM conversations GROUP BY conv_id")
def s02(t):
    """Nested artifacts, one JSON document per conversation; fields are read by path expressions."""
    path = _place(t, "artifacts")
    turn = F.struct("turn", "role", "text")
    whole = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole.select(F.to_json(F.struct("conv_id", "turns")).alias("value")).write.text(path)
    payload = F.from_json("value", "conv_id bigint, turns array<struct<turn:int,role:string,text:string>>")
    got = t.spark.read.text(path).select(payload.alias("p"))
    longest = F.array_max(F.transform("p.turns", lambda x: F.length(x["text"])))
    return got.select("p.conv_id", F.size("p.turns").cast("bigint").alias("turns"), longest.cast("bigint").alias("longest"))


@query("s03_csv_with_header", "SELECT s_suppkey, s_nationkey FROM supplier")
def s03(t):
    path = _place(t, "csv")
    sinks.save_rows(t.supplier, path)
    return files.read_csv(t.spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", ["s_suppkey", "s_nationkey"])


@query("s04_headerless_csv", "SELECT l_linenumber::INT AS session, (l_suppkey % 7)::INT AS scan_idx, l_orderkey AS unit_id, l_partkey AS pt_root_id FROM lineitem")
def s04(t):
    path = _place(t, "plain")
    rows = t.lineitem.select(F.col("l_linenumber").cast("int"), (F.col("l_suppkey") % 7).cast("int").alias("scan"), "l_orderkey", "l_partkey")
    rows.write.csv(path)
    return files.read_headerless_csv(t.spark, path)


@query("s12_manuscript_files", "SELECT lang, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def s12(t):
    """Texts written by language and found by a glob; the first pattern has no match, so the second is read."""
    path = _place(t, "manuscripts")
    t.documents.select("lang", F.to_json(F.struct("text")).alias("value")).write.partitionBy("lang").text(path)
    found = [p for p in (f"{path}/missing=*", f"{path}/lang=*") if files._exists(t.spark, p)]
    got = t.spark.read.option("basePath", path).text(found).select("lang", F.from_json("value", "text string")["text"].alias("text"))
    return got.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("s15_run_artifact_sink", """SELECT substr(sha256('{"run":"daily"}'),1,12) AS config_hash, o_orderstatus, count(*) AS n FROM orders GROUP BY 2""")
def s15_sink(t):
    """A run's rows land under the hash of its configuration."""
    path = _place(t, "runs")
    sinks.save_run(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), path, '{"run":"daily"}')
    return t.spark.read.parquet(path).select(F.col("config_hash").cast("string").alias("config_hash"), "o_orderstatus", "n")


@query("s16_summary_sink", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def s16_sink(t):
    path = _place(t, "summary")
    sinks.save_summary(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return files.read_jsonl(t.spark, path, "o_orderpriority string, n bigint")


@query("s17_row_csv_sink", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def s17_sink(t):
    """Rows with an array column as CSV, the array joined by a bar."""
    path = _place(t, "rows")
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    sinks.save_rows(rows.withColumn("orders", F.col("orders").cast("array<string>")), path, ("orders",))
    return files.read_csv(t.spark, path, "o_custkey bigint, orders string")


@query("h11_clip_unit_interval", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_quantity/40 - 0.1)), 9) AS clipped FROM lineitem")
def h11(t):
    x = F.col("l_quantity") / 40 - 0.1
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(clip01(x), 9).alias("clipped"))


@query("s11_claim_specs", """SELECT 'c' || p_partkey AS claim_id, p_type AS claim_type, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS evidence_family,
 CASE WHEN p_size % 4 = 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN p_size % 5 = 0 THEN 'interval' ELSE 'deterministic' END AS uncertainty_policy,
 CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS blocked, 0::BIGINT AS patterns, 1::BIGINT AS artifacts, CASE WHEN p_size % 2 = 0 THEN round(p_retailprice, 2) END AS min FROM part""")
def s11(t):
    """A specification per part, stored with fields left out, and read back with their defaults."""
    path, size = _place(t, "specs"), F.col("p_size")
    test = F.struct(F.lit("price").alias("key"), F.when(size % 2 == 0, F.round("p_retailprice", 2)).cast("double").alias("min"))
    fields = F.struct(
        F.concat(F.lit("c"), F.col("p_partkey")).alias("claim_id"), F.col("p_type").alias("claim_type"), F.col("p_name").alias("scope"), F.col("p_name").alias("permitted_wording"),
        F.when(size % 3 == 0, F.col("p_brand")).alias("evidence_family"), F.when(size % 4 == 0, F.lit("high")).alias("severity"),
        F.when(size % 5 == 0, F.lit("interval")).alias("uncertainty_policy"), F.when(size % 2 == 0, F.array(F.col("p_name"), F.col("p_type"))).alias("blocked_wording"),
        F.array(F.struct(F.concat(F.lit("part/"), F.col("p_partkey")).alias("path"), F.array(test).alias("expectations"))).alias("required_artifacts"))
    t.part.select(F.to_json(fields).alias("value")).write.text(path)
    got = specs.read_claim_specs(t.spark, path)
    least = specs.expectations(got).select("claim_id", "min")
    count = lambda c: F.size(c).cast("bigint")
    flat = got.select(
        "claim_id", "claim_type", "evidence_family", "severity", "uncertainty_policy", count("blocked_wording").alias("blocked"),
        count("blocked_patterns").alias("patterns"), count("required_artifacts").alias("artifacts"))
    return flat.join(least, "claim_id")
