"""Parent graphs: cycles, components, depth, ancestors and descendants.

Each id has one outgoing edge, to its parent, so every walk ends in a root or
a cycle and pointer doubling settles a chain of n records in log2(n) rounds.
Sessions of at most ``GROUP_ROWS`` records are dealt into buckets and settled
by array operations inside one task each; longer ones by rounds of joins, each
cut by a checkpoint. Both give the same rows.
"""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import first_occurrences

#: Records of a session that one task may hold, and records aimed at for a bucket of short sessions.
GROUP_ROWS, BUCKET_ROWS = 2_000_000, 200_000

SETTLED = "session string, id string, idx long, parent_id string, has_parent boolean, terminal string, on_cycle boolean, depth long, marked boolean, peak long"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder; a folder of our own only where none is named and everything runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "tracequarry-checkpoints"))
    return df.checkpoint(eager=True)


def settle_arrays(parent: np.ndarray, marked: np.ndarray, name: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, ...]:
    """terminal, on_cycle, depth, reach for a forest with cycles; ``parent`` is -1 at roots, ``name`` ranks the ids.

    ``terminal`` is the root, or the least member of the cycle; ``depth`` the
    steps to it; ``reach`` tells whether a proper ancestor is marked; ``peak`` is
    the largest position on the walk, the start included.
    """
    n = len(parent)
    rounds = max(1, math.ceil(math.log2(n + 1)) + 1)
    at = np.arange(n)
    here = np.where(parent >= 0, parent, at)
    jump = here.copy()
    for _ in range(rounds):
        jump = jump[jump]
    ends = np.zeros(n, bool)
    ends[jump] = True
    on_cycle = ends & (parent >= 0)
    # On a cycle the least name, by doubling minima; elsewhere the terminal is the cycle's or the root.
    least, hop = at.copy(), here.copy()
    for _ in range(rounds):
        least = np.where(name[least[hop]] < name[least], least[hop], least)
        hop = hop[hop]
    label = np.where(on_cycle, least, at)
    terminal = label[jump]
    # Steps to the terminal, with the edge out of the terminal cut.
    cut_ = np.where(terminal == at, at, here)
    steps, hop = (cut_ != at).astype(np.int64), cut_.copy()
    reach, hop2 = marked[here] & (here != at), here.copy()
    peak = idx.copy()
    for _ in range(rounds):
        steps = steps + steps[hop]
        hop = hop[hop]
        reach = reach | reach[hop2]
        peak = np.maximum(peak, peak[hop2])
        hop2 = hop2[hop2]
    return terminal, on_cycle, steps, reach, peak


def _bucket(table: pa.Table) -> pa.Table:
    df = table.select(["session", "id", "idx", "parent_id", "marked"]).to_pandas()
    session = pd.factorize(df.session)[0].astype(np.int64)
    names = pd.Index(df.id)
    width = max(1, names.nunique())
    code, uniques = pd.factorize(df.id, sort=True)
    key = session * width + code
    parent_code = uniques.get_indexer(df.parent_id) if len(uniques) else np.full(len(df), -1)
    position = pd.Series(np.arange(len(df)), index=key)
    wanted = np.where(parent_code >= 0, session * width + parent_code, -1)
    parent = position.reindex(wanted).fillna(-1).to_numpy().astype(np.int64)
    parent[wanted < 0] = -1
    terminal, on_cycle, depth, reach, peak = settle_arrays(parent, df.marked.fillna(False).to_numpy(bool), code, df.idx.to_numpy(np.int64))
    ids = df.id.to_numpy()
    return pa.table(
        {
            "session": table["session"], "id": table["id"], "idx": table["idx"], "parent_id": table["parent_id"],
            "has_parent": parent >= 0, "terminal": pa.array(ids[terminal], pa.string()), "on_cycle": on_cycle, "depth": depth, "marked": reach, "peak": peak,
        }
    )


def _by_joins(edges: DataFrame) -> DataFrame:
    """The rounds of joins for sessions that exceed a task."""
    ids = edges.select("session", F.col("id").alias("parent_id"), F.lit(True).alias("has_parent"))
    e = edges.join(ids, ["session", "parent_id"], "left").select("session", "id", "idx", "parent_id", F.coalesce("has_parent", F.lit(False)).alias("has_parent"), "marked")
    n = e.groupBy("session").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, math.ceil(math.log2(n + 1)) + 1)
    to = F.when(F.col("has_parent"), F.col("parent_id")).otherwise(F.col("id"))
    own = e.select("session", "id", to.alias("hop"), "idx")
    m = e.select("session", F.col("id").alias("hop"), F.col("marked").alias("pm"))
    state = cut(own.join(m, ["session", "hop"]).select("session", "id", "hop", F.col("id").alias("least"), (F.col("pm") & (F.col("hop") != F.col("id"))).alias("reach"), F.col("idx").alias("peak")))
    for _ in range(rounds):
        far = state.select("session", F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col("least").alias("least2"), F.col("reach").alias("reach2"), F.col("peak").alias("peak2"))
        state = cut(state.join(far, ["session", "hop"]).select("session", "id", F.col("hop2").alias("hop"), F.least("least", "least2").alias("least"), (F.col("reach") | F.col("reach2")).alias("reach"), F.greatest("peak", "peak2").alias("peak")))
    ends = state.select("session", F.col("hop").alias("id")).distinct().withColumn("end", F.lit(True))
    labelled = state.join(ends, ["session", "id"], "left").join(e.select("session", "id", "has_parent"), ["session", "id"])
    on = F.coalesce("end", F.lit(False)) & F.col("has_parent")
    label = cut(labelled.select("session", "id", "hop", "reach", "peak", on.alias("on_cycle"), F.when(on, F.col("least")).otherwise(F.col("id")).alias("label")))
    named = label.join(label.select("session", F.col("id").alias("hop"), F.col("label").alias("terminal")), ["session", "hop"])
    full = e.drop("marked").join(named.select("session", "id", "terminal", "on_cycle", "reach", "peak"), ["session", "id"])
    steps = cut(full.select("session", "id", F.when(F.col("terminal") == F.col("id"), F.col("id")).otherwise(to).alias("hop"), (F.col("terminal") != F.col("id")).cast("long").alias("depth")))
    for _ in range(rounds):
        far = steps.select("session", F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col("depth").alias("d2"))
        steps = cut(steps.join(far, ["session", "hop"]).select("session", "id", F.col("hop2").alias("hop"), (F.col("depth") + F.col("d2")).alias("depth")))
    return full.join(steps.select("session", "id", "depth"), ["session", "id"]).select("session", "id", "idx", "parent_id", "has_parent", "terminal", "on_cycle", "depth", F.col("reach").alias("marked"), "peak")


def settle(events: DataFrame, parent_col: str = "parent_id", marks: DataFrame | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each first occurrence: its terminal, whether it lies on a cycle, its depth, and whether an ancestor is in ``marks`` (session, id)."""
    edges = first_occurrences(events, parent_col)
    if marks is None:
        edges = edges.withColumn("marked", F.lit(False))
    else:
        edges = edges.join(marks.select("session", "id").distinct().withColumn("marked", F.lit(True)), ["session", "id"], "left").fillna(False, ["marked"])
    sizes = edges.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    total, long = sizes.agg(F.sum("n"), F.sum((F.col("n") > group_rows).cast("int"))).first()
    buckets = max(1, -(-(total or 0) // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("session"), F.lit(buckets))
    if not long:
        return edges.groupBy(bucket.alias("bucket")).applyInArrow(_bucket, SETTLED)
    giants = sizes.where(F.col("n") > group_rows).select("session")
    short = edges.join(giants, "session", "left_anti").groupBy(bucket.alias("bucket")).applyInArrow(_bucket, SETTLED)
    return short.unionByName(_by_joins(cut(edges.join(giants, "session", "left_semi"))))


def cycles(settled: DataFrame) -> DataFrame:
    """SL005: each cycle once, rotated to its least id, closed. Members reach the least one after ``depth`` steps."""
    members = settled.where("on_cycle").groupBy("session", F.col("terminal").alias("entry"))
    path = F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("depth") == 0, 0).otherwise(-F.col("depth") + (1 << 40)).alias("o"), "id"))), lambda x: x["id"])
    return members.agg(F.count(F.lit(1)).alias("length"), path.alias("p")).select("session", "entry", "length", F.array_join(F.concat("p", F.array("entry")), ">").alias("cycle_path"))


def components(settled: DataFrame) -> DataFrame:
    """session, id, component: the weakly connected component by its root, or by the least member of its cycle."""
    return settled.select("session", "id", F.col("terminal").alias("component"))


def disconnected(settled: DataFrame) -> DataFrame:
    """SL006: every component but the largest (ties by root): its root and size.

    A component without a root is named by its least member.
    """
    from pyspark.sql import Window as W

    sized = settled.groupBy("session", "terminal").agg(F.count(F.lit(1)).alias("size"), F.max("on_cycle").alias("cyclic"), F.min("id").alias("least"))
    named = sized.select("session", "size", F.when(F.col("cyclic"), F.col("least")).otherwise(F.col("terminal")).alias("root_id"))
    w = W.partitionBy("session").orderBy(F.desc("size"), "root_id")
    return named.withColumn("r", F.row_number().over(w)).where("r > 1").select("session", "root_id", "size")


def impact(events: DataFrame, seeds: DataFrame, parent_col: str = "parent_id") -> DataFrame:
    """The events of findings and all that descend from them, by session."""
    settled = settle(events, parent_col, seeds)
    own = seeds.select("session", "id").distinct().withColumn("seed", F.lit(True))
    got = settled.join(own, ["session", "id"], "left").withColumn("hit", F.coalesce("seed", F.lit(False)) | F.col("marked"))
    return got.groupBy("session").agg(F.sum(F.col("hit").cast("long")).alias("affected"), F.sum((~F.col("hit")).cast("long")).alias("outside"), F.min(F.when(F.col("hit"), F.col("idx"))).alias("first_index"))
