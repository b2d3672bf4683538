"""Reports and exports. Documents are small and written by the driver; event data is written by the executors."""

from __future__ import annotations

import html
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import corpus
from ..schema import CODES, SEVERITIES

#: Findings that a document lists; counts always cover all.
MAX_LISTED = 10_000
LEVEL = {"fatal": "error", "error": "error", "warning": "warning", "info": "note"}


def write_atomic(path: str, text: str, overwrite: bool = True) -> None:
    """Temporary file beside the target, synced, then published by a rename (or an exclusive link)."""
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(tmp, path)
        else:
            os.link(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)


def report(findings: DataFrame, verdicts: DataFrame | None = None) -> dict:
    """Counts over everything, and the first findings in reporting order."""
    by_code = {r.code: r.n for r in corpus.by_code(findings).collect()}
    by_severity = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}
    listed = [r.asDict() for r in corpus.total_order(findings).select("session", "code", "severity", "idx", "record_id", "evidence").limit(MAX_LISTED).collect()]
    out = {"counts": {"total": sum(by_code.values()), "by_code": dict(sorted(by_code.items())), "by_severity": {s: by_severity.get(s, 0) for s in SEVERITIES}}, "findings": listed, "not_listed": max(0, sum(by_code.values()) - len(listed))}
    if verdicts is not None:
        out["totals"] = {r.verdict: r.n for r in corpus.totals(verdicts).collect()}
    return out


def to_json(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True, ensure_ascii=False, indent=2) + "\n"


def to_text(doc: dict) -> str:
    c = doc["counts"]
    rows = [f"{c['total']} findings: " + ", ".join(f"{n} {s}" for s, n in c["by_severity"].items() if n)]
    rows += [f"{f['severity']:8} {f['code']} {f['session']}:{f['idx'] if f['idx'] is not None else '-'} {f['record_id'] or ''}".rstrip() for f in doc["findings"]]
    rows += [f"and {doc['not_listed']} more"] if doc.get("not_listed") else []
    return "\n".join(rows) + "\n"


def to_sarif(doc: dict) -> str:
    rules = [{"id": c, "properties": {"category": k}} for c, _, _, k in CODES]
    results = [
        {"ruleId": f["code"], "level": LEVEL[f["severity"]], "message": {"text": f["code"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["session"]}, "region": {"startLine": max(1, f["idx"] or 1)}}}]}
        for f in doc["findings"]
    ]
    return to_json({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "tracequarry", "rules": rules}}, "results": results}]})


def to_html(doc: dict) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(f[k] if f[k] is not None else ''))}</td>" for k in ("severity", "code", "session", "idx", "record_id")) + "</tr>" for f in doc["findings"])
    return f"<!doctype html><meta charset=utf-8><title>Findings</title><h1>{doc['counts']['total']} findings</h1><table><tr><th>severity<th>code<th>session<th>position<th>record</tr>{cells}</table>\n"


def bundle(events: DataFrame, findings: DataFrame) -> dict:
    """A support bundle without content: counts of kinds and the report's counts."""
    kinds = {r.kind: r.n for r in events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"kinds": kinds, "counts": report(findings)["counts"]}


def export_events(events: DataFrame, path: str) -> None:
    """Canonical JSON lines, one folder a session, in order; written by the executors."""
    body = F.to_json(F.struct("actor", F.col("corr").alias("correlation_id"), "id", "kind", "parent_id", F.try_parse_json("payload").alias("payload"), "seq", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts")))
    out = events.select(F.substring(F.sha2("session", 256), 1, 16).alias("session_key"), "idx", body.alias("value"))
    out.repartition("session_key").sortWithinPartitions("session_key", "idx").drop("idx").write.mode("errorifexists").partitionBy("session_key").text(path)


def write_back(lines: DataFrame, dropped: DataFrame, path: str) -> None:
    """The source lines (session, line, text) verbatim but for dropped ones (session, line)."""
    kept = lines.join(dropped.select("session", "line").distinct(), ["session", "line"], "left_anti")
    key = F.substring(F.sha2("session", 256), 1, 16)
    kept.select(key.alias("session_key"), "line", F.col("text").alias("value")).repartition("session_key").sortWithinPartitions("session_key", "line").drop("line").write.mode("errorifexists").partitionBy("session_key").text(path)
