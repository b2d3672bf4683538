"""Call and result pairing: SL101 to SL108.

Calls and results meet on (session, corr). What lies between a pair is read off
prefix counts at its two ends, so no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CALL, RESULT, TRANSPARENT


def _sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return events.where(F.col("kind").isin(*CALL)), events.where(F.col("kind").isin(*RESULT))


def orphan_results(events: DataFrame, null_corr: bool = True) -> DataFrame:
    """SL101: results without a call; results without a correlator too, unless the format leaves them out."""
    calls, results = _sides(events)
    have = calls.where("corr is not null").select("session", "corr")
    out = results.where("corr is not null").select("session", "corr", "id", "idx").join(have, ["session", "corr"], "left_anti")
    return out.unionByName(results.where("corr is null").select("session", "corr", "id", "idx")) if null_corr else out


def dangling_calls(events: DataFrame) -> DataFrame:
    """SL102: calls without a result, and calls without a correlator."""
    calls, results = _sides(events)
    have = results.where("corr is not null").select("session", "corr")
    out = calls.where("corr is not null").select("session", "corr", "id", "idx").join(have, ["session", "corr"], "left_anti")
    return out.unionByName(calls.where("corr is null").select("session", "corr", "id", "idx"))


def _indexes(keep: int = 16):
    """The first positions of a group, as text; the group is a correlator's rows, combined as a set first."""
    return F.array_join(F.slice(F.sort_array(F.collect_list("idx")), 1, keep), ",")


def reused_calls(events: DataFrame) -> DataFrame:
    """SL103: a correlator that several calls use."""
    calls, _ = _sides(events)
    return calls.where("corr is not null").groupBy("session", "corr").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_index"), _indexes().alias("indexes")).where("n > 1")


def multiple_results(events: DataFrame) -> DataFrame:
    """SL104: a correlator with several results; deterministic where one call has only equal results."""
    both = events.where(F.col("kind").isin(*CALL, *RESULT) & F.col("corr").isNotNull())
    is_result = F.col("kind").isin(*RESULT)
    h = F.when(is_result, F.coalesce("payload_hash", F.lit("")))
    got = both.groupBy("session", "corr").agg(
        F.sum(is_result.cast("long")).alias("n"), F.sum((~is_result).cast("long")).alias("calls"), (F.min(h) == F.max(h)).alias("equal"), F.min(F.when(is_result, F.col("idx"))).alias("first_index")
    )
    return got.where("n > 1").select("session", "corr", "n", "first_index", F.when((F.col("calls") == 1) & F.col("equal"), "deterministic").otherwise("manual").alias("repairability"))


def with_prefix_counts(events: DataFrame) -> DataFrame:
    """Running counts, up to and with each row, of records that part a pair and of boundaries, and the next boundary."""
    w = W.partitionBy("session").orderBy("idx")
    part = (~F.col("kind").isin(*TRANSPARENT)).cast("long")
    bound = (F.col("kind") == "compaction_boundary").cast("long")
    after = w.rowsBetween(1, W.unboundedFollowing)
    return events.select(
        "session", "idx", "id", "kind", "corr", "branch_id", "interaction_id", "agent_id",
        F.sum(part).over(w).alias("parts"), F.sum(bound).over(w).alias("bounds"), F.min(F.when(bound == 1, F.col("idx"))).over(after).alias("next_bound"),
    )


def clean_pairs(counted: DataFrame) -> DataFrame:
    """Correlators with one call and one result, both sides in one row."""
    both = counted.where(F.col("kind").isin(*CALL, *RESULT) & F.col("corr").isNotNull())
    is_result = F.col("kind").isin(*RESULT)
    side = F.struct("idx", "id", "branch_id", "interaction_id", "agent_id", "parts", "bounds", "next_bound")
    got = both.groupBy("session", "corr").agg(
        F.sum(is_result.cast("int")).alias("r"), F.sum((~is_result).cast("int")).alias("c"), F.max(F.when(is_result, side)).alias("res"), F.max(F.when(~is_result, side)).alias("call")
    )
    return got.where("r = 1 and c = 1").select("session", "corr", "call", "res")


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    """SL105: the result stands before its call."""
    return pairs.where("res.idx < call.idx").select("session", "corr", F.col("call.idx").alias("use_index"), F.col("res.idx").alias("result_index"))


def cross_branch(pairs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """SL106: scopes differ (null against a value differs too); without any scope the parent components decide."""
    names = ("agent_id", "branch_id", "interaction_id")
    differ = [~F.col(f"call.{c}").eqNullSafe(F.col(f"res.{c}")) for c in names]
    scoped = F.coalesce(*[F.col(f"{s}.{c}") for s in ("call", "res") for c in names]).isNotNull()
    fields = F.array_join(F.array_compact(F.array(*[F.when(d, F.lit(c)) for d, c in zip(differ, names, strict=True)])), ",")
    cols = ["session", "corr", F.col("call.idx").alias("use_index"), F.col("res.idx").alias("result_index")]
    out = pairs.where(scoped & (differ[0] | differ[1] | differ[2])).select(*cols, fields.alias("fields"))
    if components is None:
        return out
    bare = pairs.where(~scoped).select(*cols, F.col("call.id").alias("a"), F.col("res.id").alias("b"))
    left = components.select("session", F.col("id").alias("a"), F.col("component").alias("ca"))
    right = components.select("session", F.col("id").alias("b"), F.col("component").alias("cb"))
    apart = bare.join(left, ["session", "a"]).join(right, ["session", "b"]).where("ca <> cb")
    return out.unionByName(apart.select("session", "corr", "use_index", "result_index", F.lit("component").alias("fields")))


def adjacency_gaps(pairs: DataFrame) -> DataFrame:
    """SL107: records that part a pair stand between its two ends."""
    low, high = F.least("call.idx", "res.idx"), F.greatest("call.idx", "res.idx")
    between = F.abs(F.col("res.parts") - F.col("call.parts"))  # both ends are transparent themselves
    return pairs.where(between > 0).select("session", "corr", low.alias("low"), high.alias("high"), between.alias("n"))


def compaction_splits(pairs: DataFrame) -> DataFrame:
    """SL108: a boundary strictly between the ends; with exactly one the repair is deterministic."""
    n = F.abs(F.col("res.bounds") - F.col("call.bounds"))
    first = F.when(F.col("call.idx") < F.col("res.idx"), F.col("call.next_bound")).otherwise(F.col("res.next_bound"))
    return pairs.where(n > 0).select(
        "session", "corr", F.col("call.idx").alias("use_index"), F.col("res.idx").alias("result_index"), first.alias("boundary_index"), n.alias("n"),
        F.when(n == 1, "deterministic").otherwise("lossy-explicit").alias("repairability"),
    )
