"""Repairs as edit scripts: what each finding's recipe would do, whether it may, and the proof afterwards.

A recipe turns findings into edits of single rows (session, idx): ``drop``,
``parent`` (a new parent id) or ``behind`` (the row moves to just after another
one). All edits of a plan are applied by one join, so nothing but the rows that
a finding names is touched. A finding whose edits can't be shown to be safe is
blocked as a whole, with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph, pairing
from ..operators.graph import cut
from ..schema import CALL, CONTENT, RESULT
from . import corpus

EDIT = ["fingerprint", "session", "idx", "action", "value"]
#: Records that an amputated component may have.
MOST = 10_000


def _edits(df: DataFrame, action: str, value=None) -> DataFrame:
    return df.select("fingerprint", "session", F.col("idx").cast("long").alias("idx"), F.lit(action).alias("action"), (value if value is not None else F.lit(None)).cast("string").alias("value"))


def _duplicates(e: DataFrame, f: DataFrame) -> DataFrame:
    """Of identical rows of an id all but the first go; checkpoints and boundaries are no duplicates to drop."""
    rows = e.join(f.select("fingerprint", "session", F.col("record_id").alias("id")), ["session", "id"])
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("session", "id").orderBy("idx")))
    return _edits(ranked.where("r > 1 and kind not in ('checkpoint', 'compaction_boundary')"), "drop")


def _extra_results(e: DataFrame, f: DataFrame) -> DataFrame:
    """Equal further results of one call go."""
    keys = f.select("fingerprint", "session", F.get_json_object("evidence", "$.corr").alias("corr"))
    rows = e.where(F.col("kind").isin(*RESULT)).join(keys, ["session", "corr"])
    return _edits(rows.withColumn("r", F.row_number().over(W.partitionBy("session", "corr").orderBy("idx"))).where("r > 1"), "drop")


def _parents(e: DataFrame, f: DataFrame) -> DataFrame:
    """A missing parent becomes the one earlier record whose id is the same but for white space, in the same branch, with no boundary between."""
    w = W.partitionBy("session").orderBy("idx")
    placed = e.select("session", "idx", "id", "parent_id", "branch_id", F.sum((F.col("kind") == "compaction_boundary").cast("long")).over(w).alias("part"))
    lost = placed.join(f.select("fingerprint", "session", "idx"), ["session", "idx"]).select("fingerprint", "session", "idx", F.trim("parent_id").alias("name"), "branch_id", "part")
    near = placed.where("id is not null").select("session", F.trim("id").alias("name"), F.col("id").alias("candidate"), F.col("idx").alias("at"), F.col("branch_id").alias("b"), F.col("part").alias("p"))
    found = lost.join(near, ["session", "name"]).where((F.col("at") < F.col("idx")) & (F.col("part") == F.col("p")) & F.col("branch_id").eqNullSafe(F.col("b")) & (F.col("name") != ""))
    one = found.groupBy("fingerprint", "session", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("candidate")).where("n = 1")
    return _edits(one, "parent", F.col("candidate"))


def _reunions(e: DataFrame, f: DataFrame) -> DataFrame:
    """The one boundary between a call and its result moves to just behind them."""
    splits = pairing.compaction_splits(pairing.clean_pairs(pairing.with_prefix_counts(e))).where("n = 1")
    key = f.select("fingerprint", "session", F.get_json_object("evidence", "$.corr").alias("corr"))
    got = splits.join(key, ["session", "corr"]).select("fingerprint", "session", F.col("boundary_index").alias("idx"), F.greatest("use_index", "result_index").alias("last"))
    # One boundary between several pairs moves behind the last of them, on behalf of each.
    return _edits(got, "behind", F.max("last").over(W.partitionBy("session", "idx")))


def _torn(e: DataFrame, f: DataFrame) -> DataFrame:
    """The damaged line became no record, so no row changes; writing the records leaves it out."""
    return _edits(f.select("fingerprint", "session", F.lit(-1).alias("idx")), "omit")


def _excise(e: DataFrame, f: DataFrame) -> DataFrame:
    """As ``_torn``, unless a record of the session lacks its parent: that may be what the damaged line was."""
    known = e.select("session", F.col("id").alias("parent_id")).where("parent_id is not null")
    lacking = e.where("parent_id is not null").join(known, ["session", "parent_id"], "left_anti").select("session").distinct()
    return _torn(e, f.join(lacking, "session", "left_anti"))


def _orphans(e: DataFrame, f: DataFrame) -> DataFrame:
    """A result without a call goes, unless another record hangs on it."""
    held = e.select("session", F.col("parent_id").alias("id")).where("id is not null").distinct()
    rows = e.join(f.select("fingerprint", "session", "idx"), ["session", "idx"])
    return _edits(rows.join(held, ["session", "id"], "left_anti"), "drop")


def _suffix(e: DataFrame, f: DataFrame) -> DataFrame:
    """Everything from the finding's position on goes, unless that is the whole session or a checkpoint stands there."""
    cuts = f.where("idx > 0").select("fingerprint", "session", F.col("idx").alias("cut"))
    rows = e.join(cuts, "session").where("idx >= cut")
    bad = rows.where("kind = 'checkpoint'").select("fingerprint").distinct()
    return _edits(rows.join(bad, "fingerprint", "left_anti"), "drop")


def _components(e: DataFrame, f: DataFrame) -> DataFrame:
    """The component that a finding names goes: at most MOST records, none a checkpoint, and not the whole session."""
    own = graph.components(graph.settle(e))
    named = own.join(f.select("fingerprint", "session", F.col("record_id").alias("id")), ["session", "id"]).select("fingerprint", "session", "component")
    rows = e.select("session", "idx", "id", "kind").join(own, ["session", "id"]).join(named, ["session", "component"])
    sizes = rows.groupBy("fingerprint", "session").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") == "checkpoint").alias("check"))
    whole = e.groupBy("session").agg(F.count(F.lit(1)).alias("total"))
    fit = sizes.join(whole, "session").where((F.col("n") <= MOST) & ~F.col("check") & (F.col("n") < F.col("total"))).select("fingerprint")
    return _edits(rows.join(fit, "fingerprint", "left_semi"), "drop")


def _projection(e: DataFrame, f: DataFrame) -> DataFrame:
    """A boundary that parts calls from their results goes with the halves on its lesser side; where both are alike, with those behind it."""
    marks = f.select("fingerprint", "session", F.col("idx").alias("at"))
    kind = F.when(F.col("kind").isin(*CALL), "call").when(F.col("kind").isin(*RESULT), "result")
    tool = e.where("corr is not null").withColumn("side", kind).where("side is not null").select("session", "idx", "corr", "side")
    rows = tool.join(marks, "session").withColumn("before", F.col("idx") < F.col("at"))
    has = lambda side, before: F.max((F.col("side") == side) & (F.col("before") == before)).alias(f"{side}_{before}")
    per = rows.groupBy("fingerprint", "session", "corr").agg(has("call", True), has("call", False), has("result", True), has("result", False))
    cb, ca, rb, ra = (F.col(x) for x in ("call_True", "call_False", "result_True", "result_False"))
    # Which side of the boundary holds a half: (kind before, kind after).
    first = F.when(cb & ra, "call").when(ca & rb, "result").when(cb & ~rb & ~ca & ~ra, "call")
    second = F.when(cb & ra, "result").when(ca & rb, "call").when(ra & ~ca & ~cb & ~rb, "result")
    halves = rows.join(per.select("fingerprint", "session", "corr", first.alias("first"), second.alias("second")), ["fingerprint", "session", "corr"])
    torn = halves.where((F.col("before") & (F.col("side") == F.col("first"))) | (~F.col("before") & (F.col("side") == F.col("second"))))
    n = torn.groupBy("fingerprint", "session").agg(F.sum(F.col("before").cast("long")).alias("a"), F.sum((~F.col("before")).cast("long")).alias("b"))
    lesser = torn.join(n.select("fingerprint", "session", (F.col("a") < F.col("b")).alias("fore")), ["fingerprint", "session"]).where(F.col("before") == F.col("fore"))
    boundary = marks.join(n.select("fingerprint"), "fingerprint").select("fingerprint", "session", F.col("at").alias("idx"))
    return _edits(lesser.select("fingerprint", "session", "idx").unionByName(boundary), "drop")


@dataclass(frozen=True)
class Recipe:
    """How findings of a code are mended: name, edits, whether it loses data (salvage) and needs an acknowledgement."""

    code: str
    name: str
    edits: Callable[[DataFrame, DataFrame], DataFrame]
    salvage: bool = False
    ack: bool = False


RECIPES = [
    Recipe("SL002", "torn-terminal-record-discard", _torn),
    Recipe("SL003", "identical-duplicate-drop", _duplicates),
    Recipe("SL004", "proven-unique-parent-restore", _parents),
    Recipe("SL104", "duplicate-projection-removal", _extra_results),
    Recipe("SL108", "compaction-projection-reunion", _reunions),
    Recipe("SL001", "torn-record-excision", _excise, salvage=True, ack=True),
    Recipe("SL005", "unresolvable-branch-amputate", _components, salvage=True),
    Recipe("SL006", "unresolvable-branch-amputate", _components, salvage=True),
    Recipe("SL101", "orphan-result-drop", _orphans, salvage=True, ack=True),
    Recipe("SL102", "side-effect-unknown-truncate", _suffix, salvage=True, ack=True),
    Recipe("SL108", "torn-compaction-project", _projection, salvage=True),
]
#: Findings that a conservative recipe takes without a deterministic mark: the proof is in its edits.
PROVEN = ("SL004",)


def ambiguous(events: DataFrame) -> DataFrame:
    """Events whose execution is open, so that no conservative repair may touch them: reused correlators, several results, lone sides, calls of unknown effect."""
    pick = lambda df, why: df.select("session", "corr", F.lit(why).alias("reason"))
    lone = pairing.orphan_results(events).unionByName(pairing.dangling_calls(events)).where("corr is not null")
    reasons = pick(pairing.reused_calls(events), "reused").unionByName(pick(pairing.multiple_results(events).where("repairability = 'manual'"), "results")).unionByName(pick(lone, "lone"))
    paired = events.where("corr is not null").select("session", "corr", "idx", "id").join(reasons, ["session", "corr"]).select("session", "idx", "id", "reason")
    calls = events.where(F.col("kind").isin(*CALL))
    return paired.unionByName(calls.where("corr is null").select("session", "idx", "id", F.lit("uncorrelated").alias("reason"))).unionByName(calls.where("side_effects = 'unknown'").select("session", "idx", "id", F.lit("effects").alias("reason")))


def plan(events: DataFrame, findings: DataFrame, mode: str = "conservative", acknowledged: bool = False, recipes: list[Recipe] | None = None) -> tuple[DataFrame, DataFrame]:
    """(steps, edits). Steps: one row a finding with its recipe and ``status``: apply, or blocked and why.

    In the mode ``salvage`` the recipes that lose records take part, those that
    need it only with ``acknowledged``. Blocked: another tool event follows an
    unsafe point of the session (unsafe), no recipe takes such a finding
    (repairability), its precondition fails (precondition), or it would touch
    events whose execution is open or that had effects (scope).
    """
    f = cut(corpus.fingerprint(findings).select("fingerprint", "session", "code", "idx", "record_id", "repairability", "evidence").dropDuplicates(["fingerprint"]))
    chosen = [r for r in (RECIPES if recipes is None else recipes) if not r.salvage or mode == "salvage"]
    stopped = f.where("code = 'SL203'").select("session").distinct()
    open_ = ambiguous(events).select("session", "idx").distinct().withColumn("open", F.lit(True))
    done = f.select("fingerprint").limit(0)
    edits, named = None, None
    for r in chosen:
        mine = f.where(F.col("code") == r.code).join(done, "fingerprint", "left_anti")
        if not r.salvage:
            mine = mine.join(stopped, "session", "left_anti").where(F.lit(r.code in PROVEN) | (F.col("repairability") == "deterministic"))
        elif r.ack and not acknowledged:
            continue
        own = r.edits(events, mine)
        if not r.salvage:
            rows = own.join(events.select("session", "idx", "kind", "side_effects"), ["session", "idx"], "left").join(open_, ["session", "idx"], "left")
            effects = F.col("kind").isin(*CALL, *RESULT) & (F.coalesce("side_effects", F.lit("unknown")) != "none")
            bad = rows.where(F.coalesce("open", F.lit(False)) | F.coalesce(effects, F.lit(False)))
            out_of_scope = bad.select("fingerprint").distinct()
            tag = mine.select("fingerprint").join(own.select("fingerprint").distinct().withColumn("has", F.lit(True)), "fingerprint", "left").join(out_of_scope.withColumn("bad", F.lit(True)), "fingerprint", "left")
            own = own.join(out_of_scope, "fingerprint", "left_anti")
        else:
            tag = mine.select("fingerprint").join(own.select("fingerprint").distinct().withColumn("has", F.lit(True)), "fingerprint", "left").withColumn("bad", F.lit(None).cast("boolean"))
        status = F.when(F.col("bad"), "blocked:scope").when(F.col("has"), "apply").otherwise("blocked:precondition")
        tag = cut(tag.select("fingerprint", F.lit(r.name).alias("recipe"), status.alias("status")))
        named = tag if named is None else named.unionByName(tag)
        edits = own if edits is None else edits.unionByName(own)
        done = named.where("status = 'apply'").select("fingerprint")
    best = named.groupBy("fingerprint").agg(F.min(F.struct((F.col("status") != "apply").alias("no"), "status", "recipe")).alias("m")).select("fingerprint", "m.recipe", "m.status")
    reason = F.when(F.col("halt"), "blocked:unsafe").when(~F.col("code").isin(*{r.code for r in RECIPES}), "blocked:no-recipe").otherwise(F.concat(F.lit("blocked:"), "repairability"))
    steps = f.join(best, "fingerprint", "left").join(stopped.withColumn("halt", F.lit(True)), "session", "left")
    steps = steps.select("fingerprint", "session", "code", "idx", "record_id", "recipe", F.coalesce("status", reason).alias("status"))
    return cut(steps), cut(edits.distinct())


def apply(events: DataFrame, edits: DataFrame) -> DataFrame:
    """``events`` after the edits: ``idx`` still tells the row's place in the source, ``seq`` its new one."""
    gone = edits.where("action = 'drop'").select("session", "idx").distinct()
    once = edits.where("action in ('parent', 'behind')").groupBy("session", "idx").agg(F.max(F.when(F.col("action") == "parent", F.col("value"))).alias("_parent"), F.max(F.when(F.col("action") == "behind", F.col("value"))).cast("long").alias("_behind"))
    full = events.join(gone, ["session", "idx"], "left_anti").join(once, ["session", "idx"], "left")
    place = W.partitionBy("session").orderBy(F.coalesce(F.col("_behind") + 0.5, F.col("idx").cast("double")), "idx")
    out = full.withColumns({"parent_id": F.coalesce("_parent", "parent_id"), "seq": (F.row_number().over(place) - 1).cast("long")})
    return out.select(*events.columns)


def digest(events: DataFrame, order: str) -> DataFrame:
    """session, n, digest: a hash of its rows and their order, summed up, so that no session is gathered anywhere."""
    body = F.xxhash64(order, *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("id", *CONTENT)])
    again = F.xxhash64(body, F.lit("again"), order)
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    return events.groupBy("session").agg(F.count(F.lit(1)).alias("n"), total(body).alias("a"), total(again).alias("b")).select("session", "n", F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("digest"))


def manifest(events: DataFrame, output: DataFrame, edits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What a repair claims of each session: digests of source, plan and output, records lost, and the errors before."""
    total = F.sum(F.xxhash64("fingerprint", "idx", "action", F.coalesce("value", F.lit(""))).cast("decimal(38,0)"))
    planned = edits.groupBy("session").agg(F.sha2(total.cast("string"), 256).alias("plan_sha256"), F.count_distinct(F.when(F.col("action") == "drop", F.col("idx"))).alias("lost"))
    s = digest(events, "idx").select("session", F.col("n").alias("n_before"), F.col("digest").alias("source_sha256"))
    o = digest(output, "seq").select("session", F.col("n").alias("n_after"), F.col("digest").alias("output_sha256"))
    full = s.join(o, "session", "left").join(planned, "session", "left").join(verdicts.select("session", "errors"), "session", "left")
    return full.fillna({"lost": 0, "n_after": 0, "plan_sha256": "", "output_sha256": "", "errors": 0})


CHECKS = ("source_hash", "plan_fingerprint", "output_hash", "transformation_audit", "loss_audit", "assurance_audit", "idempotence")


def verify(claimed: DataFrame, events: DataFrame, output: DataFrame, edits: DataFrame, verdicts: DataFrame, after: DataFrame, again: DataFrame) -> dict[str, bool]:
    """Seven checks, all of them made whatever the others say.

    ``edits`` and ``verdicts`` are planned anew from the source, ``after`` are
    the verdicts of the output and ``again`` the steps planned on it.
    """
    made = manifest(events, output, edits, verdicts)
    both = cut(claimed.alias("c").join(made.alias("m"), "session", "full"))
    same = lambda c: both.where(~F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}"))).isEmpty()
    cols = ["session", "idx", "seq", "id", *CONTENT]
    replay = apply(events, edits).select(*cols)
    found = output.select(*cols)
    drops = edits.where("action = 'drop'").select("session", "idx").distinct()
    missing = events.select("session", "idx").join(output.select("session", "idx"), ["session", "idx"], "left_anti")
    worse = after.select("session", F.col("errors").alias("now")).join(verdicts.select("session", "errors"), "session").where("now > errors")
    return {
        "source_hash": same("source_sha256"),
        "plan_fingerprint": same("plan_sha256"),
        "output_hash": same("output_sha256"),
        "transformation_audit": replay.exceptAll(found).isEmpty() and found.exceptAll(replay).isEmpty(),
        "loss_audit": same("lost") and missing.exceptAll(drops).isEmpty() and drops.exceptAll(missing).isEmpty(),
        "assurance_audit": worse.isEmpty(),
        "idempotence": again.where("status = 'apply'").isEmpty(),
    }
