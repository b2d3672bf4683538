"""The functions a user calls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, compatibility, graph, outcome
from .operators.graph import cut
from .plans import corpus, repairs, runner
from .plans.runner import NEUTRAL, Profile
from .sources import files, sinks
from .sources.formats import detect


def load(spark: SparkSession, path: str, fmt: str | None = None, **walk) -> dict[str, DataFrame]:
    """Parsed tables of a file or a tree; parsed once, held in the checkpoint folder."""
    return files.split(cut(files.read_sessions(files.walk(spark, path, **walk), fmt)))


def check(spark: SparkSession, path: str, profile: Profile = NEUTRAL, fmt: str | None = None, baseline: DataFrame | None = None, **walk) -> dict[str, DataFrame]:
    """findings, verdicts, coverage of every file below ``path``; findings that ``baseline`` knows are left out."""
    got = runner.run(load(spark, path, fmt, **walk), profile)
    if baseline is not None:
        got["findings"] = corpus.baseline_filter(corpus.fingerprint(got["findings"]), baseline)
    return got


def scan(spark: SparkSession, path: str, profile: Profile = NEUTRAL, **walk) -> dict[str, DataFrame]:
    """``check`` with the corpus rollups: totals, by_code, worst, skipped."""
    got = check(spark, path, profile, **walk)
    v = got["verdicts"]
    return got | {"totals": corpus.totals(v), "by_code": corpus.by_code(got["findings"]), "worst": corpus.worst_sessions(v), "skipped": corpus.skipped_reasons(v)}


def precheck(spark: SparkSession, path: str, **more) -> bool:
    """Whether every file is healthy."""
    return check(spark, path, **more)["verdicts"].where("verdict <> 'healthy'").isEmpty()


def stats(spark: SparkSession, path: str, **walk) -> dict[str, DataFrame]:
    e = load(spark, path, **walk)["events"]
    name = F.when(F.col("kind") == "tool_call", F.substring(F.sha2(F.coalesce(F.get_json_object("payload", "$.name"), F.lit("")), 256), 1, 12))
    sizes = e.groupBy("session").agg(F.count(F.lit(1)).alias("size"))
    return {"histograms": corpus.histograms(e), "sizes": corpus.nearest_rank(sizes, "size", {"p50": 0.5, "p95": 0.95}), "tools": corpus.top_values(e, name), "formats": e.groupBy("format").count()}


def diff(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Deltas from file ``a`` to file ``b``."""
    left, right = (load(spark, p)["events"].withColumn("session", F.lit("")) for p in (a, b))
    return changes.diff(left, right)


def triage(spark: SparkSession, path: str, **more) -> dict[str, DataFrame]:
    """Findings, and how many events hang on them."""
    parts = load(spark, path, **more)
    got = runner.run(parts)
    e = parts["events"]
    seeds = got["findings"].where("record_id is not null").select("session", F.col("record_id").alias("id"))
    return got | {"impact": graph.impact(e, seeds)}


def register_recipe(recipe: repairs.Recipe) -> None:
    repairs.RECIPES.append(recipe)


def _planned(parts: dict[str, DataFrame], profile: Profile, mode: str, acknowledged: bool) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    got = runner.run(parts, profile)
    return got, *repairs.plan(parts["events"], got["findings"], mode, acknowledged)


def plan(spark: SparkSession, path: str, profile: Profile = NEUTRAL, mode: str = "conservative", acknowledged: bool = False, **walk) -> DataFrame:
    """Steps: every finding with its recipe, and ``apply`` or why not. Modes: conservative, salvage (recipes that lose records too)."""
    return _planned(load(spark, path, **walk), profile, mode, acknowledged)[1]


def repair(spark: SparkSession, path: str, profile: Profile = NEUTRAL, mode: str = "conservative", acknowledged: bool = False, **walk) -> dict[str, DataFrame]:
    """events (repaired; ``idx`` is the place in the source, ``seq`` the new one), steps, edits, manifest. Only rows that an applied finding names change."""
    parts = load(spark, path, **walk)
    got, steps, edits = _planned(parts, profile, mode, acknowledged)
    events = cut(repairs.apply(parts["events"], edits))
    return {"events": events, "steps": steps, "edits": edits, "manifest": repairs.manifest(parts["events"], events, edits, got["verdicts"])}


def verify(spark: SparkSession, path: str, output: DataFrame, manifest: DataFrame, profile: Profile = NEUTRAL, mode: str = "conservative", acknowledged: bool = False, **walk) -> dict[str, bool]:
    """Whether ``output`` is what a repair of ``path`` gives, by seven independent checks: planned, replayed and checked anew."""
    parts = load(spark, path, **walk)
    got, steps, edits = _planned(parts, profile, mode, acknowledged)
    # Lines that were left out are no damage of the output.
    omitted = steps.where("status = 'apply' and code in ('SL001', 'SL002')").select("session", "code", "idx")
    left = parts["findings"].join(omitted, ["session", "code", "idx"], "left_anti").select(*parts["findings"].columns)
    again = parts | {"events": cut(output.withColumn("idx", F.col("seq"))), "findings": left}
    after, steps_after, _ = _planned(again, profile, mode, acknowledged)
    return repairs.verify(manifest, parts["events"], output, edits, got["verdicts"], after["verdicts"], steps_after)


def verify_outcome(spark: SparkSession, contract: dict | str, source: str, target: str, as_of: str | None = None) -> dict[str, DataFrame]:
    """Evaluates a contract (a dict or a JSON file on the driver) over two snapshot files; ``as_of`` defaults to the target's observation."""
    if isinstance(contract, str):
        with open(contract, encoding="utf-8") as f:
            contract = json.load(f)
    s, _ = files.read_snapshot(spark, source)
    t, facts = files.read_snapshot(spark, target)
    observed = contract.get("observed_at") or facts.get("observed_at")
    full = {**contract, "as_of": as_of or contract.get("as_of") or observed, "observed_at": observed or as_of}
    if "completeness" in facts:
        full["target_complete"] = facts["completeness"] == "complete"
    return outcome.evaluate(full, s, t)


def doctor(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """File counts by extension, and verdicts."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return {"files": corpus.folder_summary(listing), "totals": corpus.totals(check(spark, path)["verdicts"])}


def check_bytes(spark: SparkSession, name: str, data: bytes, profile: Profile = NEUTRAL) -> dict[str, DataFrame]:
    """``check`` of one log that is at hand as bytes."""
    one = spark.createDataFrame([(name, len(data), bytearray(data))], "path string, length long, content binary")
    return runner.run(files.split(cut(files.read_sessions(one))), profile)


def reconcile(spark: SparkSession, path: str, index: str, state: str | None = None) -> DataFrame:
    """SL402: the sessions below ``path`` against a session index, and the spawn edges of a state database.

    Entries without a file are only reported where the index was read whole; a
    truncated or malformed index is a divergence of its own.
    """
    parts = load(spark, path)
    keys, condition = files.read_index(spark, index)
    have = parts["files"].select(F.col("facts")["session_id"].alias("key")).where("key is not null")
    edges = None
    if state:
        tables = files.read_state(spark, state)
        edges = tables["thread_spawn_edges"].select(F.col("parent_thread_id").alias("parent"), F.col("child_thread_id").alias("child"))
        keys = keys.unionByName(tables["threads"].select(F.col("id").alias("key"))).distinct()
    out = compatibility.index_divergence(keys, have, condition == "complete", edges)
    if state:
        out = out.unionByName(tables["rollout_migration_skipped_rollouts"].select(F.lit("migration-skip-recorded").alias("divergence"), F.col("rollout_path").alias("key")))
    return out if condition == "complete" else out.unionByName(spark.createDataFrame([(condition, index)], "divergence string, key string"))


ambiguous = repairs.ambiguous


def preview(spark: SparkSession, path: str, **more) -> DataFrame:
    """What a repair would change, as deltas; nothing is written."""
    fixed = repair(spark, path, **more)["events"].withColumn("idx", F.col("seq"))
    return changes.diff(load(spark, path)["events"], fixed)


def session_roots(spark: SparkSession, path: str) -> DataFrame:
    """Folders below ``path`` that hold logs, with their number and newest file."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    logs = listing.where(F.col("path").rlike(r"\.jsonl?$"))
    return logs.groupBy(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("root")).agg(F.count(F.lit(1)).alias("files"), F.max(F.struct("modificationTime", "path")).alias("m")).select("root", "files", F.col("m.path").alias("newest"))


export = sinks.export_events
detect_format = detect
check_file = check
check_dir = scan
diff_sessions = diff
