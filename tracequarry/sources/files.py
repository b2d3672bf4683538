"""Session files, indexes, state databases and snapshots as DataFrames."""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT, SEVERITY_OF
from .formats import MAX_FILE, parse

MAX_FILES, MAX_BYTES = 10_000, 1 << 30
EXCLUDED = r"/(\.git|\.hg|\.svn|node_modules|__pycache__)/"
READ = f"tag string, session string, format string, event struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in EVENT.replace(chr(10), ' ').split(', '))}>, finding struct<code:string,line:long,severity:string,record_id:string,evidence:string>, facts map<string,string>"


def walk(spark: SparkSession, path: str, ext: tuple[str, ...] = ("jsonl", "json"), exclude: str | None = None, since: str | None = None, newest: int | None = None, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Files of a tree: path, modificationTime, length, content, over (beyond the caps, in path order).

    The gates are applied to the listing, without contents: files over the size
    limit or the caps come back with a null content, which is never read. Of a
    capped listing at most ``max_files`` paths come to the driver.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ext) + "}" if len(ext) > 1 else f"*.{ext[0]}")
    if since:
        reader = reader.option("modifiedAfter", since)

    def wanted(df: DataFrame) -> DataFrame:
        df = df.where(~F.col("path").rlike(EXCLUDED))
        return df.where(~F.col("path").rlike(exclude)) if exclude else df

    every = wanted(reader.load(path))
    listing = every.select("path", "modificationTime", "length")
    if newest:
        listing = listing.orderBy(F.desc("modificationTime"), "path").limit(newest)
    unread = F.lit(None).cast("binary").alias("content")
    columns = ["path", "modificationTime", "length", "content", "over"]
    if not newest and max_files is None and max_bytes is None:
        small = every.where(F.col("length") <= MAX_FILE).select("path", "modificationTime", "length", "content", F.lit(False).alias("over"))
        return small.unionByName(listing.where(F.col("length") > MAX_FILE).select("path", "modificationTime", "length", unread, F.lit(False).alias("over")))
    room, held, kept = max_bytes or 1 << 62, 0, []
    ordered = listing.orderBy("path")
    for row in (ordered.limit(max_files) if max_files else ordered).toLocalIterator():
        held += row.length
        if held > room:
            break
        kept.append((row.path, row.length))
    named = spark.createDataFrame(kept or [("", 0)], "path string, length long").select("path")
    fit = [_literal(p) for p, n in kept if n <= MAX_FILE]
    rest = listing.join(F.broadcast(named.withColumn("in", F.lit(True))), "path", "left").where(F.col("in").isNull() | (F.col("length") > MAX_FILE))
    out = rest.select("path", "modificationTime", "length", unread, F.col("in").isNull().alias("over"))
    if fit:
        read = spark.read.format("binaryFile").load(fit).where(F.col("length") <= MAX_FILE)
        out = read.withColumn("over", F.lit(False)).select(*columns).unionByName(out)
    return out


def _literal(path: str) -> str:
    """``path`` with the signs of a pattern taken literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest file, by time and then path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path").limit(1)


def read_sessions(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """Every file parsed in its task; tagged rows of events, reader findings, links and file facts (see ``split``)."""
    event_type = files.sparkSession.createDataFrame([], READ).schema["event"].dataType
    names = event_type.fieldNames()
    content = F.when(F.col("length") <= MAX_FILE, F.col("content"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(READ))

    def run(batches):
        for batch in batches:
            for path, length, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = parse(path, data, length, fmt)
                facts = {k: str(v) for k, v in p.facts.items() if v is not None} | {"path": path, "length": str(length)}
                rows = [{"tag": "file", "facts": facts}]
                rows += [{"tag": "event", "event": {n: e.get(n) for n in names if n != "session"} | {"session": path}} for e in p.events]
                rows += [{"tag": "finding", "finding": f} for f in p.findings]
                rows += [{"tag": "link", "facts": {"link_index": str(k), "link_kind": kind, "target": t}} for k, (kind, t) in enumerate(p.links)]
                for k in range(0, len(rows), 5000):
                    part = [{"session": path, "format": p.format, "tag": None, "event": None, "finding": None, "facts": None} | r for r in rows[k : k + 5000]]
                    yield pa.RecordBatch.from_pylist([{**r, "facts": list(r["facts"].items()) if r["facts"] is not None else None, "event": _maps(r["event"])} for r in part], schema=arrow)

    return files.select("path", "length", content.alias("content")).mapInArrow(run, READ)


def _maps(event: dict | None) -> dict | None:
    """Arrow takes maps as lists of pairs."""
    return event and {k: list(v.items()) if isinstance(v, dict) else v for k, v in event.items()}


def split(read: DataFrame) -> dict[str, DataFrame]:
    """events, findings, links and files of a ``read_sessions`` result (cache or write it first if several are used)."""
    default = F.create_map(*[F.lit(x) for kv in SEVERITY_OF.items() for x in kv])
    findings = read.where("tag = 'finding'").select(
        "session", F.col("finding.code").alias("code"), F.coalesce("finding.severity", default[F.col("finding.code")]).alias("severity"), F.col("finding.line").alias("idx"), F.col("finding.record_id").alias("record_id"), F.col("finding.evidence").alias("evidence")
    )
    links = read.where("tag = 'link'").select(F.col("session").alias("file"), F.col("facts.link_index").cast("int").alias("link_index"), F.col("facts.link_kind").alias("link_kind"), F.col("facts.target").alias("target"))
    return {"events": read.where("tag = 'event'").select("event.*", "format"), "findings": findings, "links": links, "files": read.where("tag = 'file'").select("session", "format", "facts")}


def link_keys(parts: dict[str, DataFrame]) -> DataFrame:
    """What a reference may name: session ids, file stems, rollout ids, and the tip event of each file."""
    f = parts["files"]
    stem = F.regexp_extract("session", r"([^/]+?)\.[^./]+$", 1)
    uuid = F.lower(F.regexp_extract("session", r"([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})\.jsonl$", 1))
    keys = f.select("session", F.explode(F.array_compact(F.array(F.col("facts")["session_id"], stem, F.when(uuid != "", uuid)))).alias("key"))
    tips = parts["events"].where("id is not null").groupBy("session").agg(F.max(F.struct("idx", "id")).alias("t")).select("session", F.col("t.id").alias("key"))
    return keys.unionByName(tips).distinct().select("key", F.col("session").alias("file"))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(key rows, state) of a session index: a JSON document with entries, or JSON lines; state complete, truncated, malformed or oversized.

    An index is one small document read on the driver within the file cap.
    """
    row = spark.read.format("binaryFile").load(path).first()
    schema = "key string"
    if row is None or row.length > MAX_FILE:
        return spark.createDataFrame([], schema), "oversized"
    text = bytes(row.content).decode("utf-8", "replace")
    try:
        doc = json.loads(text)
        entries = doc.get("entries") if isinstance(doc, dict) else doc
        if isinstance(entries, list):
            return spark.createDataFrame([(str(e.get("sessionId") or e.get("id")),) for e in entries if isinstance(e, dict)], schema), "complete"
        if isinstance(doc, dict) and "id" in doc:
            return spark.createDataFrame([(str(doc["id"]),)], schema), "complete"
        return spark.createDataFrame([], schema), "malformed"
    except ValueError:
        pass
    keys, state = [], "complete"
    body = [x for x in text.split("\n") if x.strip()]
    for k, x in enumerate(body):
        try:
            keys.append((str(json.loads(x)["id"]),))
        except (ValueError, KeyError, TypeError):
            state = "truncated" if k == len(body) - 1 and not text.endswith("\n") and keys else "malformed"
    return spark.createDataFrame(keys, schema), state


def read_state(spark: SparkSession, path: str, cap: int = 100_000) -> dict[str, DataFrame]:
    """threads, thread_spawn_edges and skipped migrations of a state database, opened read-only; a table of more than ``cap`` rows is refused."""
    tables = {"threads": ("id", "rollout_path"), "thread_spawn_edges": ("parent_thread_id", "child_thread_id"), "rollout_migration_skipped_rollouts": ("rollout_path", "reason")}
    out = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        have = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
        for name, cols in tables.items():
            own = {r[1] for r in con.execute(f"pragma table_info({name})")} if name in have else set()
            picks = ", ".join(c if c in own else f"null as {c}" for c in cols)
            rows = con.execute(f"select {picks} from {name} limit {cap + 1}").fetchall() if own else []
            if len(rows) > cap:
                raise ValueError(f"more than {cap} rows in {name}")
            out[name] = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in cols))
    return out


CELL = "map<string,struct<kind:string,text:string>>"
MAX_RECORDS = 1_000_000


def _cell(v) -> dict:
    if v is None:
        return {"kind": "null", "text": None}
    if isinstance(v, bool):
        return {"kind": "bool", "text": str(v).lower()}
    if isinstance(v, dict | list):
        return {"kind": "nested", "text": "" if not v else "…"}
    return {"kind": "string" if isinstance(v, str) else "number", "text": str(v)}


def snapshot_records(name: str, data: bytes) -> tuple[list[dict], dict]:
    """(records, envelope facts) of a CSV file, a JSON array, JSON lines or an envelope; short CSV rows leave fields out."""
    text = data.decode("utf-8-sig")
    facts: dict = {}
    if name.endswith(".csv"):
        rows = list(csv.reader(io.StringIO(text)))
        found = [{k: {"kind": "string", "text": v} for k, v in zip(rows[0], r, strict=False)} for r in rows[1:] if r] if rows else []
    else:
        try:
            doc = json.loads(text, parse_float=_Exact, parse_int=_Exact)
        except ValueError:
            doc = [json.loads(x, parse_float=_Exact, parse_int=_Exact) for x in text.split("\n") if x.strip()]
        if isinstance(doc, dict) and "records" in doc:
            facts = {k: v for k, v in doc.items() if k != "records"}
            doc = doc["records"]
        found = [{k: _cell(v) for k, v in r.items()} for r in (doc if isinstance(doc, list) else [doc])]
    if len(found) > MAX_RECORDS:
        raise ValueError(f"more than {MAX_RECORDS} records")
    return found, facts


class _Exact(float):
    """A number that keeps its spelling."""

    def __new__(cls, text):
        self = super().__new__(cls, text)
        self.text = text
        return self

    def __str__(self):
        return self.text


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A snapshot as flat records, one struct column a field; absent fields are null."""
    row = spark.read.format("binaryFile").load(path).first()
    records, facts = snapshot_records(path, bytes(row.content))
    names = sorted({k for r in records for k in r})
    schema = ", ".join(f"`{n}` struct<kind:string,text:string>" for n in names) or "none struct<kind:string,text:string>"
    return spark.createDataFrame([tuple(r.get(n) and (r[n]["kind"], r[n]["text"]) for n in names) for r in records], schema), facts
