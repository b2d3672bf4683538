"""Corpus rollups over events and findings: statistics, verdicts, top lists, baselines, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..schema import CAPS, SEVERITIES, severity_rank


def histograms(events: DataFrame) -> DataFrame:
    """A1: counts by kind and by actor in one pass."""
    got = events.groupingSets([["kind"], ["actor"]], "kind", "actor").agg(F.count(F.lit(1)).alias("n"), F.grouping("kind").alias("by_actor"))
    return got.select(F.when(F.col("by_actor") == 1, "actor").otherwise("kind").alias("dimension"), F.coalesce("kind", "actor").alias("value"), "n")


def nearest_rank(values: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """A2: sorted[min(int(q * n), n - 1)] for each quantile, with maximum, total and count, in one row.

    Equal values are counted first and dealt by range; running sums are taken
    inside the ranges, and over the ranges from one small row each.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranged = cut(counted.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    parts = ranged.groupBy("p").agg(F.sum("c").alias("held"))  # a row for each partition
    before = parts.select("p", (F.sum("held").over(W.orderBy("p")) - F.col("held")).alias("before"), F.sum("held").over(W.partitionBy()).alias("n"))
    within = F.sum("c").over(W.partitionBy("p").orderBy("v"))
    placed = ranged.withColumn("within", within).join(F.broadcast(before), "p").withColumn("upto", F.col("within") + F.col("before"))
    rank = lambda q: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
    picks = [F.min(F.when(F.col("upto") > rank(q), F.col("v"))).alias(name) for name, q in quantiles.items()]
    return placed.agg(*picks, F.max("v").alias("max"), F.sum(F.col("v") * F.col("c")).alias("total"), F.max("n").alias("n"))


def top_values(events: DataFrame, column: Column, k: int = 100) -> DataFrame:
    """A3: the ``k`` most frequent values, by count and then name."""
    return events.where(column.isNotNull()).groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def verdicts(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """File verdicts: unreadable for syntax damage, unsupported for SL301, invalid for errors, else healthy; links don't count."""
    own = findings.where(~F.col("code").isin("SL401", "SL402"))
    error = F.col("severity").isin("fatal", "error")
    per = own.groupBy("session").agg(
        F.max(F.col("code") == "SL301").alias("v"), F.max(F.col("code").isin("SL001", "SL002")).alias("u"), F.sum(error.cast("long")).alias("errors"), F.sum((F.col("severity") == "warning").cast("long")).alias("warnings")
    )
    j = sessions.select("session").distinct().join(per, "session", "left")
    verdict = F.when(F.col("v"), "unsupported").when(F.col("u"), "unreadable").when(F.coalesce("errors", F.lit(0)) > 0, "invalid").otherwise("healthy")
    return j.select("session", verdict.alias("verdict"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def watch_verdicts(per_session: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdicts as a watch tells them: a healthy file with findings of any kind is ``warnings``."""
    some = findings.select("session").distinct().withColumn("some", F.lit(True))
    told = F.when((F.col("verdict") == "healthy") & F.coalesce("some", F.lit(False)), "warnings").otherwise(F.col("verdict"))
    return per_session.join(some, "session", "left").select("session", told.alias("verdict"))


def assurance(per_session: DataFrame) -> Column:
    """A0 to A3 from the verdict row; A4 needs the reference comparison on top."""
    return F.when(F.col("verdict").isin("unreadable", "unsupported"), "A0").when(F.col("errors") > 0, "A1").when(F.col("warnings") > 0, "A2").otherwise("A3")


def totals(per_session: DataFrame) -> DataFrame:
    """A4: sessions by verdict."""
    return per_session.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def by_code(findings: DataFrame) -> DataFrame:
    """A5: count, sessions and worst severity of each code, worst first."""
    got = findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("sessions"), F.min(severity_rank(F.col("severity"))).alias("severity_rank"))
    return got.orderBy("severity_rank", F.desc("n"), "code")


def worst_sessions(per_session: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` sessions with most errors, then warnings, then by name."""
    return per_session.where("errors > 0 or warnings > 0").select("session", "errors", "warnings").orderBy(F.desc("errors"), F.desc("warnings"), "session").limit(n)


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity for each session."""
    return findings.groupBy("session").pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1))).fillna(0)


def total_order(findings: DataFrame) -> DataFrame:
    """The reporting order: session, position, code and then everything that tells findings apart."""
    return findings.orderBy("session", F.coalesce("idx", F.lit(-1)), "code", severity_rank(F.col("severity")), F.coalesce("record_id", F.lit("")), "evidence")


def fingerprint(findings: DataFrame) -> DataFrame:
    """The first 16 hex digits of a hash over the identifying fields."""
    parts = F.to_json(F.array("session", "code", "severity", F.coalesce(F.col("idx").cast("string"), F.lit("")), F.coalesce("record_id", F.lit("")), "evidence"))
    key = F.to_json(F.array("code", F.coalesce("record_id", F.lit("")), "session"))
    return findings.withColumn("fingerprint", F.substring(F.sha2(parts, 256), 1, 16)).withColumn("key", F.substring(F.sha2(key, 256), 1, 16))


def baseline_filter(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drop findings whose fingerprint is known, or whose key is known and belongs to one fingerprint only (fingerprint, key on both sides)."""
    known = baseline.select("fingerprint").distinct()
    fresh = findings.join(known, "fingerprint", "left_anti")
    spread = findings.select("key", "fingerprint").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    certain = baseline.select("key").distinct().join(spread.select("key"), "key")
    return fresh.join(certain, "key", "left_anti")


def capped(findings: DataFrame, cap: int | None = None) -> DataFrame:
    """A10: at most ``cap`` findings of a code in a session (the registry's caps if none is given), and a row that tells how many more there were."""
    w = W.partitionBy("session", "code").orderBy("idx", "record_id", "evidence")
    limit = F.lit(cap) if cap is not None else F.coalesce(F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])[F.col("code")], F.lit(1 << 30))
    ranked = findings.withColumn("r", F.row_number().over(w)).withColumn("limit", limit)
    kept = ranked.where("r <= limit").drop("r", "limit")
    over = ranked.where("r > limit").groupBy("session", "code").agg(F.first("severity").alias("severity"), F.first("repairability").alias("repairability"), F.count(F.lit(1)).alias("n"))
    rows = over.select(
        "session", "code", "severity", "repairability", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("record_id"), F.array().cast("array<string>").alias("related_ids"), F.to_json(F.struct(F.col("n").alias("overflow"))).alias("evidence")
    )
    return kept.unionByName(rows, allowMissingColumns=True)


def folder_summary(files: DataFrame) -> DataFrame:
    """Files, bytes and the newest change by extension (path, length, modificationTime)."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def skipped_reasons(results: DataFrame) -> DataFrame:
    """Skipped files by reason."""
    return results.where("verdict = 'skipped'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reusable(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results that hold, files to analyse anew) by path, analysis key and content hash."""
    on = ["path", "analysis", "sha256"]
    return files.join(cache, on), files.join(cache.select(*on), on, "left_anti")


def kind_counts(events: DataFrame) -> DataFrame:
    """Record counts by session and kind."""
    return events.groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n"))
