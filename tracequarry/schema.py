"""The event table, the findings table and the code registry.

An event row is one record of one session; ``idx`` is its position there.
``EVENT`` lists every column a detector may read. Detectors take a DataFrame
that has the columns they name and ignore the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = """session string, idx long, id string, parent_id string, seq long, ts_ms long, actor string, kind string,
payload string, content_hash string, payload_hash string, corr string, branch_id string, interaction_id string,
agent_id string, execution_state string, side_effects string, line long, size long, writer string, version string,
record_type string, ckpt_seq long, state_hash string, usage map<string,long>, cumulative map<string,long>,
leaf_id string, ordinal long, extra string"""

FINDING = "session string, code string, severity string, repairability string, idx long, record_id string, related_ids array<string>, evidence string"

# Code, default severity, default repairability, category.
CODES = (
    ("SL001", "error", "manual", "syntax"),
    ("SL002", "error", "deterministic", "syntax"),
    ("SL003", "warning", "deterministic", "identity"),
    ("SL004", "error", "manual", "graph"),
    ("SL005", "fatal", "unsupported", "graph"),
    ("SL006", "warning", "manual", "graph"),
    ("SL007", "warning", "manual", "graph"),
    ("SL008", "warning", "manual", "structure"),
    ("SL009", "warning", "manual", "structure"),
    ("SL010", "warning", "manual", "structure"),
    ("SL011", "info", "manual", "structure"),
    ("SL101", "error", "manual", "pairing"),
    ("SL102", "error", "manual", "pairing"),
    ("SL103", "error", "manual", "pairing"),
    ("SL104", "error", "manual", "pairing"),
    ("SL105", "error", "manual", "pairing"),
    ("SL106", "error", "manual", "pairing"),
    ("SL107", "warning", "manual", "pairing"),
    ("SL108", "warning", "lossy-explicit", "pairing"),
    ("SL201", "error", "manual", "checkpoint"),
    ("SL202", "error", "manual", "checkpoint"),
    ("SL203", "error", "manual", "checkpoint"),
    ("SL204", "warning", "manual", "accounting"),
    ("SL205", "warning", "manual", "checkpoint"),
    ("SL206", "warning", "manual", "checkpoint"),
    ("SL207", "info", "manual", "accounting"),
    ("SL208", "warning", "manual", "checkpoint"),
    ("SL301", "error", "unsupported", "compatibility"),
    ("SL302", "error", "manual", "compatibility"),
    ("SL303", "warning", "manual", "syntax"),
    ("SL304", "warning", "manual", "compatibility"),
    ("SL305", "warning", "manual", "compatibility"),
    ("SL306", "info", "manual", "compatibility"),
    ("SL401", "warning", "manual", "linkage"),
    ("SL402", "warning", "manual", "linkage"),
)
#: What two records of one id must share to be the same record: everything but their place (idx, line, size, seq).
CONTENT = ("kind", "actor", "parent_id", "ts_ms", "corr", "branch_id", "interaction_id", "agent_id", "execution_state", "side_effects", "payload_hash")
SEVERITIES = ("fatal", "error", "warning", "info")
VERDICTS = ("healthy", "invalid", "unsupported", "unreadable", "skipped")
SEVERITY_OF = {c: s for c, s, _, _ in CODES}
REPAIR_OF = {c: r for c, _, r, _ in CODES}

CALL, RESULT = ("tool_call", "tool_use"), ("tool_result",)
#: Kinds that may stand between a call and its result.
TRANSPARENT = ("tool_call", "tool_use", "tool_result", "opaque")
TIMESTAMP_SKEW_MS = 2000
#: Findings of one code kept for a session before an overflow row replaces the rest.
CAPS = {"SL003": 1000, "SL009": 64} | {c: 500 for c, *_ in CODES if c[:3] in ("SL0", "SL1", "SL2") and c not in ("SL003", "SL009")}


def codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "code string, severity string, repairability string, category string")


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), c).cast("int"), F.lit(9))


def as_findings(code: str, df: DataFrame, idx: str | None = None, record: str | None = None, related: str | None = None, severity: Column | None = None, repairability: Column | None = None) -> DataFrame:
    """Findings from a detector's rows; the columns that are left become the evidence."""
    rest = [c for c in df.columns if c != "session"]
    return df.select(
        F.col("session").cast("string").alias("session"),
        F.lit(code).alias("code"),
        (severity if severity is not None else F.lit(SEVERITY_OF[code])).alias("severity"),
        (repairability if repairability is not None else F.lit(REPAIR_OF[code])).alias("repairability"),
        (F.col(idx) if idx else F.lit(None)).cast("long").alias("idx"),
        (F.col(record) if record else F.lit(None)).cast("string").alias("record_id"),
        (F.col(related) if related else F.array()).cast("array<string>").alias("related_ids"),
        F.to_json(F.struct(*rest)).alias("evidence"),
    )
