"""Event views over the star-schema tables, in Spark and as a DuckDB common table expression.

The tables hold no tool calls, so the ``events`` stream is read as sessions by
user: clicks become calls, purchases results, signups checkpoints, errors
compaction boundaries and views messages; the number in ``props`` gives the
correlators, branches, hashes and links their (often broken) values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KIND = {"click": "tool_call", "purchase": "tool_result", "signup": "checkpoint", "error": "compaction_boundary"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass and one exchange, by session."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    eid = F.col("event_id").cast("string")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])[F.col("event_type")], F.lit("message"))
    base = raw.select(
        "user_id",
        "ts",
        "event_id",
        kind.alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000").alias("ms"),
    )
    ordered = base.select(
        "*", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.lag(eid).over(w).alias("before"), F.lead(eid, 3).over(w).alias("ahead")
    )
    k, tool = F.col("k"), F.col("kind").isin("tool_call", "tool_result")
    check = F.col("kind") == "checkpoint"
    return ordered.select(
        F.col("user_id").cast("string").alias("session"),
        "idx",
        eid.alias("id"),
        F.concat(F.lit("d"), (k % 13).cast("string"), F.when(k % 2 == 0, F.lit("")).otherwise(eid)).alias("dup_id"),
        F.when(F.col("idx") == 0, None).when(k % 11 == 0, F.concat(F.lit("-"), eid)).otherwise(F.col("before")).alias("parent_id"),
        F.when(F.col("idx") == 0, None).when(k % 17 == 0, F.col("ahead")).when(k % 11 == 0, F.concat(F.lit("-"), eid)).otherwise(F.col("before")).alias("loop_parent"),
        (F.col("ms") - F.when(k % 7 == 0, k * 100_000).otherwise(0)).alias("ts_ms"),
        "kind",
        F.element_at(F.array(*map(F.lit, ("user", "assistant", "tool", "system"))), (k % 4 + 1).cast("int")).alias("actor"),
        F.when(tool & (k % 19 != 0), F.concat(F.lit("c"), (k % 20).cast("string"))).alias("corr"),
        F.when(k % 5 != 0, F.concat(F.lit("b"), (k % 3).cast("string"))).alias("branch_id"),
        F.lit(None).cast("string").alias("interaction_id"),
        F.lit(None).cast("string").alias("agent_id"),
        F.concat(F.lit("p"), (k % 2).cast("string")).alias("payload_hash"),
        F.when(k % 6 != 0, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("writer"),
        F.when(k % 10 == 0, F.concat(F.lit("v"), F.floor(k / 40).cast("string"))).alias("version"),
        F.when(check, k % 10).alias("ckpt_seq"),
        F.when(check & (k % 9 != 0), F.concat(F.lit("h"), (k % 4).cast("string"))).alias("state_hash"),
        (k % 8).alias("contribution"),
        F.when(k % 12 == 0, k).alias("cumulative"),
        F.when((F.col("kind") == "compaction_boundary") & (k % 3 != 0), F.when(k % 4 == 0, F.concat(F.lit("-"), eid)).otherwise(F.col("before"))).alias("leaf_id"),
        (F.col("idx") + F.when(k % 23 == 0, 1).otherwise(0)).alias("ordinal"),
        (k % 29 == 0).alias("claim"),
        (k * k * 30).alias("size"),
        (F.col("idx") + 2).alias("line"),
        "k",
    )


#: The same view for DuckDB.
EV = """ev0 AS (
  SELECT user_id, event_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(event_id AS VARCHAR) AS id,
         row_number() OVER w - 1 AS idx, lag(CAST(event_id AS VARCHAR)) OVER w AS before, lead(CAST(event_id AS VARCHAR), 3) OVER w AS ahead,
         CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'tool_result' WHEN 'signup' THEN 'checkpoint'
              WHEN 'error' THEN 'compaction_boundary' ELSE 'message' END AS kind
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session, idx, id,
         'd' || CAST(k % 13 AS VARCHAR) || CASE WHEN k % 2 = 0 THEN '' ELSE id END AS dup_id,
         CASE WHEN idx = 0 THEN NULL WHEN k % 11 = 0 THEN '-' || id ELSE before END AS parent_id,
         CASE WHEN idx = 0 THEN NULL WHEN k % 17 = 0 THEN ahead WHEN k % 11 = 0 THEN '-' || id ELSE before END AS loop_parent,
         epoch_us(ts) // 1000 - CASE WHEN k % 7 = 0 THEN k * 100000 ELSE 0 END AS ts_ms, kind,
         CASE k % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' ELSE 'system' END AS actor,
         CASE WHEN kind IN ('tool_call', 'tool_result') AND k % 19 <> 0 THEN 'c' || CAST(k % 20 AS VARCHAR) END AS corr,
         CASE WHEN k % 5 <> 0 THEN 'b' || CAST(k % 3 AS VARCHAR) END AS branch_id,
         'p' || CAST(k % 2 AS VARCHAR) AS payload_hash,
         CASE WHEN k % 6 <> 0 THEN 'w' || CAST(k % 3 AS VARCHAR) END AS writer,
         CASE WHEN k % 10 = 0 THEN 'v' || CAST(k // 40 AS VARCHAR) END AS version,
         CASE WHEN kind = 'checkpoint' THEN k % 10 END AS ckpt_seq,
         CASE WHEN kind = 'checkpoint' AND k % 9 <> 0 THEN 'h' || CAST(k % 4 AS VARCHAR) END AS state_hash,
         k % 8 AS contribution, CASE WHEN k % 12 = 0 THEN k END AS cumulative,
         CASE WHEN kind = 'compaction_boundary' AND k % 3 <> 0 THEN CASE WHEN k % 4 = 0 THEN '-' || id ELSE before END END AS leaf_id,
         idx + CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS ordinal, k % 29 = 0 AS claim, k * k * 30 AS size, idx + 2 AS line, k
  FROM ev0)
"""
