"""All detectors over parsed sessions: gates, coverage, findings, verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checkpoint, compatibility, graph, identity, pairing
from ..operators.graph import cut
from ..schema import CODES, REPAIR_OF, TIMESTAMP_SKEW_MS, as_findings
from ..sources import files as source
from ..sources.formats import FOREIGN
from . import corpus

ROLLOUT = "codex-rollout"


@dataclass(frozen=True)
class Profile:
    """Which rules run and how: name, codes, severities by code, skew, checkpoint sensitivity, supported versions (None: all)."""

    name: str = "neutral"
    enabled: frozenset[str] = frozenset(c for c, *_ in CODES)
    severities: dict[str, str] = field(default_factory=dict)
    skew_ms: int = TIMESTAMP_SKEW_MS
    sensitivity: str = "normal"
    supported_versions: tuple[str, ...] | None = None

    def select(self, select: list[str] | None = None, ignore: list[str] | None = None) -> Profile:
        """Rules by code or prefix."""
        chosen = {c for c in self.enabled if not select or any(c.startswith(s) for s in select)}
        return replace(self, enabled=frozenset(c for c in chosen if not any(c.startswith(i) for i in ignore or ())))


NEUTRAL = Profile()
STRICT = Profile("strict", severities={"SL107": "error", "SL108": "error"}, sensitivity="high")


def run(parts: dict[str, DataFrame], profile: Profile = NEUTRAL) -> dict[str, DataFrame]:
    """findings, coverage, verdicts of ``sources.files.split`` tables. A family that is switched off is not built at all."""
    on = profile.enabled
    every = parts["events"]
    if profile.supported_versions is not None:
        unsupported = compatibility.unsupported_versions(every, list(profile.supported_versions))
    else:
        declared = parts["files"].select("session", "format", F.lit(1).cast("long").alias("line"), F.col("facts")["version"].alias("version"))
        # A canonical header names its schema there; only a plain number is a version.
        declared = declared.where((F.col("format") == "openai-agents") | ((F.col("format") == "canonical") & F.col("version").rlike("^[vV]?[0-9]")))
        unsupported = compatibility.outside_builtin(every.where("format = 'claude-code-jsonl'").select("session", "format", "line", "version").unionByName(declared))
    unsupported = cut(unsupported)
    # Version-gated sessions take no further part.
    e = every.join(unsupported.select("session"), "session", "left_anti")
    out: list[tuple[str, DataFrame]] = []

    def add(code: str, build, idx=None, record=None, **more) -> None:
        if code in on:
            out.append((code, as_findings(code, build(), idx, record, **more)))

    settled = cut(graph.settle(e)) if on & {"SL005", "SL006", "SL106", "SL205"} else None
    pairs = pairing.clean_pairs(pairing.with_prefix_counts(e)) if on & {"SL105", "SL106", "SL107", "SL108"} else None
    not_rollout = F.col("format") != ROLLOUT
    add("SL301", lambda: unsupported, "line")
    add("SL003", lambda: identity.duplicate_ids(e), "first_index", "id", severity=F.when(F.col("identical"), "warning").otherwise("error"), repairability=F.when(F.col("identical"), "deterministic").otherwise("manual"))
    add("SL004", lambda: identity.missing_parents(e), "idx", "id")
    add("SL005", lambda: graph.cycles(settled), None, "entry")
    add("SL006", lambda: graph.disconnected(settled), None, "root_id")
    add("SL007", lambda: identity.ambiguous_heads(e))
    add("SL008", lambda: identity.timestamp_regressions(e, profile.skew_ms), "child_index", "record_id")
    add("SL009", lambda: identity.secret_material(e.select("session", F.col("idx").alias("record"), F.col("payload").alias("text"))), "record")
    add("SL010", lambda: identity.interleaved_writers(e))
    add("SL011", lambda: identity.size_anomalies(e.where(not_rollout)), "record_index")
    add("SL101", lambda: pairing.orphan_results(e.where(not_rollout)).unionByName(pairing.orphan_results(e.where(~not_rollout), null_corr=False)), "idx", "id")
    add("SL102", lambda: pairing.dangling_calls(e), "idx", "id")
    add("SL103", lambda: pairing.reused_calls(e), "first_index")
    add("SL104", lambda: pairing.multiple_results(e), "first_index", repairability=F.col("repairability"))
    add("SL105", lambda: pairing.reversed_pairs(pairs), "result_index")
    add("SL106", lambda: pairing.cross_branch(pairs, graph.components(settled)), "result_index")
    add("SL107", lambda: pairing.adjacency_gaps(pairs), "high")
    add("SL108", lambda: pairing.compaction_splits(pairs), "boundary_index", repairability=F.col("repairability"))
    gaps, apart = checkpoint.checkpoint_gaps(e, profile.sensitivity), checkpoint.checkpoint_divergence(e)
    add("SL201", lambda: gaps, "idx")
    add("SL202", lambda: apart, "idx")
    # These two formats write no checkpoints after a compaction, so the lack of one says nothing.
    add("SL203", lambda: checkpoint.unsafe_continuations(e, gaps, apart, ~F.col("format").isin("claude-code-jsonl", ROLLOUT)), "first_unsafe_index")
    add("SL204", lambda: checkpoint.usage_arithmetic(e), "idx")
    add("SL205", lambda: checkpoint.coverage_gaps(e, settled), "idx", "boundary_id")
    extra = lambda path: F.get_json_object("extra", path)
    rollout = e.where(~not_rollout)
    claims = parts["files"].select("session", F.col("facts")["claim"].cast("long").alias("claimed"))
    durable = rollout.select("session", "ordinal", (extra("$.durable") == "true").alias("durable")).join(claims, "session", "left")
    reasoning = rollout.select("session", "ordinal", extra("$.encrypted").cast("boolean").alias("present"))
    add("SL206", lambda: checkpoint.durable_prefix(durable).unionByName(checkpoint.missing_fields(reasoning)))
    add("SL207", lambda: checkpoint.context_pressure(rollout.select("session", "idx", extra("$.occupancy").cast("long").alias("occupancy"), extra("$.window_limit").cast("long").alias("window_limit"))), "idx")
    item = F.explode(F.from_json(extra("$.items"), "array<struct<id:string,type:string,corr:string>>")).alias("i")
    boundary = rollout.where("kind = 'compaction_boundary'").select("session", F.col("idx").alias("boundary_index"), item)
    kind_of = {"message": "message", "agent_message": "message", "reasoning": "opaque", "function_call": "tool_call", "custom_tool_call": "tool_call", "function_call_output": "tool_result", "custom_tool_call_output": "tool_result"}
    item_kind = F.create_map(*[F.lit(x) for kv in kind_of.items() for x in kv])[F.col("i.type")]
    add("SL208", lambda: checkpoint.snapshot_divergence(boundary.select("session", "boundary_index", F.col("i.id").alias("item_id"), item_kind.alias("item_type"), F.col("i.corr").alias("item_corr")), e), "boundary_index", "item_id")
    foreign_rows = [(t, f) for f, types in FOREIGN.items() for t in types]
    foreign = e.sparkSession.createDataFrame(foreign_rows, "record_type string, other string")
    strange = e.join(F.broadcast(foreign), "record_type").where("other <> format").select("session", "idx", F.lit("envelope").alias("drift"), F.lit(None).cast("string").alias("previous"), F.col("other").alias("observed"))
    add("SL304", lambda: compatibility.drift(e, None, unsupported).unionByName(strange.dropDuplicates(["session", "observed"])), "idx")
    shapes = rollout.where(extra("$.shape").isNotNull()).select("session", "ordinal", F.lit("reasoning").alias("family"), extra("$.shape").alias("shape"))
    add("SL305", lambda: compatibility.foreign_shapes(shapes), "first_ordinal")
    add("SL401", lambda: compatibility.unresolved_links(parts["links"], source.link_keys(parts)).withColumnRenamed("file", "session"), severity=F.when(F.col("resolution") == "unresolved", "info").otherwise("warning"))
    mendable = F.create_map(*[F.lit(x) for kv in REPAIR_OF.items() for x in kv])
    reader = parts["findings"].where(F.col("code").isin(*on)).select("session", "code", "severity", F.coalesce(mendable[F.col("code")], F.lit("manual")).alias("repairability"), "idx", "record_id", F.array().cast("array<string>").alias("related_ids"), "evidence")
    findings = reader.where("code <> 'SL306'").unionByName(_metadata(reader.where("code = 'SL306'")))
    for _, df in out:
        findings = findings.unionByName(df)
    if profile.severities:
        chosen = F.create_map(*[F.lit(x) for kv in profile.severities.items() for x in kv])
        findings = findings.withColumn("severity", F.coalesce(chosen[F.col("code")], F.col("severity")))
    findings = cut(findings)
    gates = parts["files"].select("session", F.col("facts")["gate"].alias("gate"))
    v = corpus.verdicts(parts["files"], findings).join(gates, "session")
    verdict = F.when(F.col("gate").isin("unsupported", "live-db"), "unsupported").when(F.col("gate") == "oversize", "skipped").when(F.col("gate").isin("unreadable", "empty"), "unreadable").otherwise(F.col("verdict"))
    verdicts = v.select("session", verdict.alias("verdict"), "errors", "warnings", F.coalesce("gate", F.lit("")).alias("reason"))
    # Verdicts count every finding; of each code a session lists so many, and how many more there were.
    return {"findings": corpus.capped(findings), "verdicts": verdicts, "coverage": coverage(parts, on, unsupported)}


def _metadata(rows: DataFrame) -> DataFrame:
    """SL306: one finding for each unknown type of a session, the types beyond the first 32 together."""
    typed = rows.select("session", F.col("idx").alias("line"), F.get_json_object("evidence", "$.type_value").alias("record_type"), F.lit(False).alias("semantic"))
    return as_findings("SL306", compatibility.unknown_metadata(typed, []), "first_line")


def coverage(parts: dict[str, DataFrame], enabled: frozenset[str], unsupported: DataFrame) -> DataFrame:
    """session, code, state: performed, or the first reason it wasn't: disabled, cap-exceeded, empty-input, version-gated."""
    seen = parts["events"].select("session").distinct().withColumn("has", F.lit(True))
    f = parts["files"].select("session", F.col("facts")["gate"].alias("gate")).join(seen, "session", "left")
    f = f.join(unsupported.select("session", F.lit(True).alias("gated")), "session", "left")
    state = F.when(~F.col("enabled"), "disabled").when(F.col("gate") == "oversize", "cap-exceeded").when(F.col("has").isNull(), "empty-input").when(F.coalesce("gated", F.lit(False)), "version-gated").otherwise("performed")
    # One row for each of the 35 codes of a file: the registry is exploded, not joined.
    every = f.withColumn("c", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(c in enabled).alias("enabled")) for c, *_ in CODES])))
    return every.select("session", "c.code", "c.enabled", "gate", "has", "gated").select("session", "code", state.alias("state"))
