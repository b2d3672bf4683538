"""Commands: python -m tracequarry.cli COMMAND ... — each prints one JSON document or lines of them."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import changes, graph, outcome
from .plans import corpus
from .plans.runner import NEUTRAL, STRICT, Profile
from .sources import files, sinks
from .streaming.watch import step

VERSION = "0.1.0"
COMMANDS = "check scan version repair verify seal bundle export completion diff stats triage outcome doctor watch hook".split()
#: Keys of a configuration file; others are refused.
KEYS = {"profile", "adapter", "fail_on", "select", "ignore", "max_files", "max_bytes", "max_findings_per_code", "timestamp_skew_ms", "exclude", "ext"}
MAX_HOOK = 1 << 20


class ConfigError(ValueError):
    pass


class SealError(ValueError):
    pass


def configure(path: str | None) -> dict:
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    if not isinstance(doc, dict) or set(doc) - KEYS:
        raise ConfigError(f"unknown keys: {sorted(set(doc) - KEYS) if isinstance(doc, dict) else doc}")
    return doc


def profile_of(options: dict) -> Profile:
    p = STRICT if options.get("profile") == "strict" else NEUTRAL
    if "timestamp_skew_ms" in options:
        p = replace(p, skew_ms=int(options["timestamp_skew_ms"]))
    return p.select(options.get("select"), options.get("ignore"))


def walk_of(options: dict) -> dict:
    out = {k: options[k] for k in ("exclude", "max_files", "max_bytes") if k in options}
    return out | ({"ext": tuple(options["ext"])} if "ext" in options else {})


def rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """Rows for printing, bounded."""
    return [{k: v if isinstance(v, int | float | str | bool | type(None)) else str(v) for k, v in r.asDict().items()} for r in df.limit(most).collect()]


def watch(spark: SparkSession, path: str, polls: int, interval: float) -> list[dict]:
    """Verdict transitions over so many polls (the streaming operator does the same for a table of polls)."""
    import pandas as pd

    state: dict = {}
    out = []
    for k in range(polls):
        got = api.check(spark, path)
        told_as = corpus.watch_verdicts(got["verdicts"], got["findings"])
        seen = told_as.join(files.walk(spark, path).select(F.col("path").alias("session"), "length", F.unix_millis("modificationTime").alias("mtime")), "session")
        for r in seen.collect():  # one small row a file of the watched folder
            poll = pd.DataFrame([{"at": pd.Timestamp.now(), "size_bytes": r.length, "mtime": r.mtime, "verdict": r.verdict}])
            state[r.session], told = step(state.get(r.session), poll)
            out += [{"path": r.session, "before": b, "verdict": v} for _, b, v in told]
        if k + 1 < polls:
            time.sleep(interval)
    return out


def hook(spark: SparkSession, payload: str) -> dict:
    """An advisory answer to a hook event; whatever goes wrong, it only says so."""
    try:
        if len(payload) > MAX_HOOK:
            return {"advice": "skip", "reason": "payload too long"}
        path = json.loads(payload).get("transcript_path") or json.loads(payload)["path"]
        bad = rows(api.check(spark, path)["verdicts"].where("verdict <> 'healthy'"))
        return {"advice": "look" if bad else "ok", "files": bad}
    except Exception as e:  # noqa: BLE001  advisory by contract
        return {"advice": "skip", "reason": type(e).__name__}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracequarry")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        if name not in ("version", "completion", "hook", "outcome", "diff"):
            c.add_argument("path")
        if name == "diff":
            c.add_argument("a")
            c.add_argument("b")
        if name == "outcome":
            c.add_argument("contract")
            c.add_argument("source")
            c.add_argument("target")
            c.add_argument("--as-of")
            c.add_argument("--explain", action="store_true")
        if name in ("check", "scan"):
            c.add_argument("--format", choices=["json", "text", "sarif", "html"], default="json")
            c.add_argument("--select", nargs="*")
            c.add_argument("--ignore", nargs="*")
        if name in ("check", "scan", "repair", "export", "seal"):
            c.add_argument("-o", "--output")
        if name in ("repair", "verify"):
            c.add_argument("--mode", choices=["conservative", "salvage"], default="conservative")
            c.add_argument("--acknowledge", action="store_true")
        if name == "watch":
            c.add_argument("--polls", type=int, default=2)
            c.add_argument("--interval", type=float, default=1.0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "completion":
        print(f"complete -W '{' '.join(COMMANDS)}' tracequarry")
        return 0
    options = configure(a.config)
    spark = spark or SparkSession.builder.getOrCreate()
    walk = walk_of(options)
    code = 0
    out: object
    if a.command in ("check", "scan"):
        options |= {k: v for k, v in (("select", a.select), ("ignore", a.ignore)) if v}
        got = api.scan(spark, a.path, profile_of(options), **walk)
        doc = sinks.report(got["findings"], got["verdicts"])
        text = {"json": sinks.to_json, "text": sinks.to_text, "sarif": sinks.to_sarif, "html": sinks.to_html}[a.format](doc)
        code = int(any(doc["counts"]["by_severity"][s] for s in ("fatal", "error")))
        if a.output:
            sinks.write_atomic(a.output, text)
            return code
        print(text, end="")
        return code
    if a.command == "repair":
        done = api.repair(spark, a.path, mode=a.mode, acknowledged=a.acknowledge, **walk)
        if a.output:
            sinks.export_events(done["events"], a.output)
        out = rows(done["steps"])
    elif a.command == "verify":
        done = api.repair(spark, a.path, mode=a.mode, acknowledged=a.acknowledge, **walk)
        out = api.verify(spark, a.path, done["events"], done["manifest"], mode=a.mode, acknowledged=a.acknowledge, **walk)
        code = int(not all(out.values()))
    elif a.command == "seal":
        listing = files.walk(spark, a.path, **walk).select(F.lit(a.path).alias("ledger"), F.expr("row_number() over (order by path)").alias("line"), F.concat_ws(" ", "path", F.sha2("content", 256)).alias("body"))
        heads, before = None, 0
        if a.output and os.path.exists(a.output):
            old = graph.cut(spark.read.parquet(a.output))
            if bad := rows(changes.verify_seal(old)):
                raise SealError(f"the ledger diverges and is not carried on: {bad}")
            heads = old.groupBy("ledger").agg(F.max(F.struct("seq", "entry_sha256")).alias("m")).select("ledger", "m.*")
            before = old.agg(F.max("line")).first()[0] or 0
        sealed = graph.cut(changes.seal(listing.withColumn("line", F.col("line") + before), heads))
        if a.output:
            sealed.write.mode("append").parquet(a.output)
        out = rows(sealed.select("seq", "body", "prev_sha256", "entry_sha256").orderBy("seq"))
    elif a.command == "bundle":
        got = api.check(spark, a.path, **walk)
        out = sinks.bundle(api.load(spark, a.path, **walk)["events"], got["findings"])
    elif a.command == "export":
        sinks.export_events(api.load(spark, a.path, **walk)["events"], a.output)
        out = {"written": a.output}
    elif a.command == "diff":
        out = rows(api.diff(spark, a.a, a.b))
        code = int(bool(out))
    elif a.command == "stats":
        out = {k: rows(v) for k, v in api.stats(spark, a.path, **walk).items()}
    elif a.command == "triage":
        got = api.triage(spark, a.path)
        out = {"impact": rows(got["impact"]), "verdicts": rows(got["verdicts"])}
    elif a.command == "outcome":
        with open(a.contract, encoding="utf-8") as f:
            contract = json.load(f)
        if a.explain:
            out = outcome.explain(contract)
        else:
            got = api.verify_outcome(spark, contract, a.source, a.target, a.as_of)
            out = {"outcome": rows(got["outcome"])[0], "summary": rows(got["summary"])}
            code = int(out["outcome"]["outcome"] != "VERIFIED")
    elif a.command == "doctor":
        out = {k: rows(v) for k, v in api.doctor(spark, a.path).items()}
    elif a.command == "watch":
        out = watch(spark, a.path, a.polls, a.interval)
    else:
        out = hook(spark, sys.stdin.read(MAX_HOOK + 1))
    print(json.dumps(out, sort_keys=True, ensure_ascii=False))
    return code


if __name__ == "__main__":
    sys.exit(main())
