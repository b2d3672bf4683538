"""Checkpoints, usage accounting and durability: SL201 to SL208."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CALL, RESULT

TOOL = (*CALL, *RESULT)
START = ("run_start", "continuation")


def checkpoint_gaps(events: DataFrame, sensitivity: str = "normal") -> DataFrame:
    """SL201: a start before any checkpoint, a jump of the sequence, a checkpoint without a state hash, and, under high sensitivity, without a number."""
    w = W.partitionBy("session").orderBy("idx")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = events.where(F.col("kind").isin("checkpoint", *START)).select(
        "session", "idx", "kind", "ckpt_seq", "state_hash", F.last("ckpt_seq", ignorenulls=True).over(before).alias("prev"), F.max(F.col("kind") == "checkpoint").over(before).alias("seen")
    )
    is_check = F.col("kind") == "checkpoint"
    reasons = F.array_compact(
        F.array(
            F.when(F.col("kind").isin(*START) & ~F.coalesce("seen", F.lit(False)), F.lit("start")),
            F.when(is_check & (F.col("ckpt_seq") - F.col("prev") > 1), F.lit("jump")),
            F.when(is_check & F.col("state_hash").isNull(), F.lit("no_hash")),
            F.when(F.lit(sensitivity == "high") & is_check & F.col("ckpt_seq").isNull(), F.lit("no_seq")),
        )
    )
    out = rows.select("session", "idx", "prev", "ckpt_seq", F.explode(reasons).alias("reason"))
    return out.select("session", "idx", "reason", F.when(F.col("reason") == "jump", F.col("prev") + 1).alias("expected_seq"), F.col("ckpt_seq").alias("found_seq"))


def checkpoint_divergence(events: DataFrame) -> DataFrame:
    """SL202: a checkpoint number with another hash than where it was first seen."""
    rows = events.where("kind = 'checkpoint' and ckpt_seq is not null and state_hash is not null").select("session", "idx", "ckpt_seq", "state_hash")
    first = rows.groupBy("session", "ckpt_seq").agg(F.min(F.struct("idx", "state_hash")).alias("f")).select("session", "ckpt_seq", F.col("f.state_hash").alias("hash_a"))
    return rows.join(first, ["session", "ckpt_seq"]).where("state_hash <> hash_a").select("session", "idx", "ckpt_seq", "hash_a", F.col("state_hash").alias("hash_b"))


def unsafe_continuations(events: DataFrame, gaps: DataFrame, divergence: DataFrame, compaction_triggers: bool | Column = True) -> DataFrame:
    """SL203: one row a session: the least trigger with a tool event after it, what caused it, and that event.

    A boundary triggers when the next tool event comes before the next checkpoint,
    in the records for which ``compaction_triggers`` holds: a format that writes
    no checkpoints after a compaction can't be asked for one.
    """
    after = W.partitionBy("session").orderBy("idx").rowsBetween(1, W.unboundedFollowing)
    next_tool = F.min(F.when(F.col("kind").isin(*TOOL), F.col("idx"))).over(after)
    next_check = F.min(F.when(F.col("kind") == "checkpoint", F.col("idx"))).over(after)
    asked = compaction_triggers if isinstance(compaction_triggers, Column) else F.lit(compaction_triggers)
    walked = events.select("session", "idx", "kind", next_tool.alias("tool"), next_check.alias("check"), asked.alias("asked"))
    triggers = gaps.select("session", "idx", F.lit("SL201").alias("cause")).unionByName(divergence.select("session", "idx", F.lit("SL202").alias("cause"))).distinct()
    found = walked.join(triggers, ["session", "idx"]).select("session", "idx", "cause", "tool")
    bare = walked.where("asked and kind = 'compaction_boundary' and tool is not null and (check is null or tool < check)")
    found = found.unionByName(bare.select("session", "idx", F.lit("compaction").alias("cause"), "tool"))
    least = found.where("tool is not null").groupBy("session").agg(F.min(F.struct("idx", "tool")).alias("m"), F.array_join(F.sort_array(F.collect_set("cause")), ",").alias("caused_by"))
    return least.select("session", F.col("m.idx").alias("trigger_index"), F.col("m.tool").alias("first_unsafe_index"), "caused_by")


def usage_arithmetic(events: DataFrame) -> DataFrame:
    """SL204: markers whose cumulative usage isn't the previous one plus what was added since, key by key.

    A boundary starts an epoch; its first marker is unchecked, but for the
    stream's own start, where everything counts from zero.
    """
    w = W.partitionBy("session").orderBy("idx")
    marker = F.col("cumulative").isNotNull().cast("long")
    placed = events.where("usage is not null or cumulative is not null or kind = 'compaction_boundary'").select(
        "session", "idx", "usage", "cumulative",
        F.sum((F.col("kind") == "compaction_boundary").cast("long")).over(w).alias("epoch"),
        (F.sum(marker).over(w) - marker).alias("window"),
    )
    added = placed.where("usage is not null").select("session", "epoch", "window", F.explode("usage").alias("key", "v")).groupBy("session", "epoch", "window", "key").agg(F.sum("v").alias("added"))
    seen = placed.where("cumulative is not null").select("session", "idx", "epoch", "window", F.explode("cumulative").alias("key", "observed"))
    first = W.partitionBy("session", "epoch")
    numbered = seen.withColumn("opening", F.min("window").over(first))
    previous = seen.select("session", "epoch", (F.col("window") + 1).alias("window"), "key", F.col("observed").alias("base"))
    full = numbered.join(added, ["session", "epoch", "window", "key"], "left").join(previous, ["session", "epoch", "window", "key"], "left")
    checked = full.where("epoch = 0 or window > opening").withColumn("expected", F.coalesce("base", F.lit(0)) + F.coalesce("added", F.lit(0)))
    return (
        checked.where("expected <> observed")
        .groupBy("session", "idx")
        .agg(F.count(F.lit(1)).alias("mismatched_key_count"), F.sum("expected").alias("expected_total"), F.sum("observed").alias("observed_total"))
    )


def coverage_gaps(events: DataFrame, settled: DataFrame) -> DataFrame:
    """SL205: a boundary whose leaf is missing, stands not before it, or hangs on a chain that is unresolved or passes the boundary; ambiguous leaves and cycles are silent."""
    claims = events.where("kind = 'compaction_boundary' and leaf_id is not null").select("session", "idx", F.col("id").alias("boundary_id"), "leaf_id")
    counts = events.where("id is not null").groupBy("session", F.col("id").alias("leaf_id")).agg(F.count(F.lit(1)).alias("n"))
    ends = settled.select("session", F.col("id").alias("terminal"), F.col("parent_id").alias("above"), F.col("on_cycle").alias("cyclic"))
    walk = settled.select("session", F.col("id").alias("leaf_id"), F.col("idx").alias("leaf_index"), "terminal", "peak")
    full = claims.join(counts, ["session", "leaf_id"], "left").join(walk, ["session", "leaf_id"], "left").join(ends, ["session", "terminal"], "left")
    missing = F.col("n").isNull()
    apart = (F.col("n") == 1) & ~F.col("cyclic") & ((F.col("leaf_index") >= F.col("idx")) | F.col("above").isNotNull() | (F.col("peak") > F.col("idx")))
    return full.where(missing | apart).select("session", "idx", "boundary_id", "leaf_id", F.when(missing, "missing").otherwise("non_contiguous").alias("divergence"))


def durable_prefix(records: DataFrame) -> DataFrame:
    """SL206: claims beyond the last durable ordinal, and holes of the durable range that no record holds.

    ``records`` has session, ordinal, durable and claimed (an ordinal or null).
    """
    ranges = records.groupBy("session").agg(F.min(F.when(F.col("durable"), F.col("ordinal"))).alias("lo"), F.max(F.when(F.col("durable"), F.col("ordinal"))).alias("hi"), F.max("claimed").alias("claim"))
    beyond = ranges.where("claim > hi").select("session", F.lit("claim_beyond_durable").alias("divergence"), F.col("claim").alias("ordinal"), F.lit(1).cast("long").alias("n"))
    held = records.where("ordinal is not null").select("session", "ordinal").distinct()
    ahead = held.select("session", "ordinal", F.lead("ordinal").over(W.partitionBy("session").orderBy("ordinal")).alias("next"))
    holes = ahead.join(ranges, "session").where("next - ordinal > 1 and ordinal >= lo and ordinal < hi")
    size = F.least("next", "hi") - F.col("ordinal") - 1
    gaps = holes.where(size > 0).groupBy("session").agg(F.min(F.col("ordinal") + 1).alias("ordinal"), F.sum(size).alias("n"))
    return beyond.unionByName(gaps.select("session", F.lit("hole").alias("divergence"), "ordinal", "n"))


def missing_fields(items: DataFrame) -> DataFrame:
    """SL206: reasoning items without the field that others of the session carry (session, ordinal, present)."""
    per = items.where("present is not null").groupBy("session").agg(F.sum((~F.col("present")).cast("long")).alias("n"), F.max("present").alias("some"), F.min(F.when(~F.col("present"), F.col("ordinal"))).alias("ordinal"))
    return per.where("some and n > 0").select("session", F.lit("missing_required_field").alias("divergence"), "ordinal", "n")


def context_pressure(marks: DataFrame) -> DataFrame:
    """SL207: the last declared occupancy leaves less than 15 % of the window (session, idx, occupancy, window_limit)."""
    last = marks.where("occupancy is not null and window_limit is not null").groupBy("session").agg(F.max(F.struct("idx", "occupancy", "window_limit")).alias("m"))
    flat = last.select("session", "m.*")
    return flat.where((F.col("window_limit") - F.col("occupancy")) * 20 < F.col("window_limit") * 3).select("session", "idx", "occupancy", "window_limit", (F.col("window_limit") - F.col("occupancy")).alias("headroom"))


def snapshot_divergence(items: DataFrame, events: DataFrame) -> DataFrame:
    """SL208: boundary items against the first occurrence of their id: another type, another correlator, or a later position.

    ``items`` has session, boundary_index, item_id, item_type, item_corr. One row for each session and kind of divergence.
    """
    first = events.where("id is not null").groupBy("session", F.col("id").alias("item_id")).agg(F.min(F.struct("idx", "kind", "corr")).alias("f"))
    j = items.join(first, ["session", "item_id"])
    kinds = F.array_compact(
        F.array(
            F.when(F.col("item_type") != F.col("f.kind"), F.lit("type-mismatch")),
            F.when((F.col("item_type") == F.col("f.kind")) & ~F.col("item_corr").eqNullSafe(F.col("f.corr")), F.lit("correlation-mismatch")),
            F.when(F.col("f.idx") > F.col("boundary_index"), F.lit("future-item")),
        )
    )
    rows = j.select("session", "boundary_index", "item_id", F.explode(kinds).alias("divergence"))
    got = rows.groupBy("session", "divergence").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("boundary_index", "item_id")).alias("m"))
    return got.select("session", "divergence", "occurrences", F.col("m.boundary_index").alias("boundary_index"), F.col("m.item_id").alias("item_id"))
