"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, checkpoint, compatibility, graph, identity, outcome, pairing
from ..schema import CODES, as_findings
from ..sources import files
from . import corpus, derived, repairs, runner
from .derived import EV

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ev: bool = True):
    """Registers a query under the function's name, with its SQL over the derived view."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {EV} {sql}" if ev else sql
        return f

    return add


def ev(spark: SparkSession, d: str) -> DataFrame:
    return derived.events(spark, d)


# --- identity, structure ---


@query("""SELECT session, dup_id AS id, count(*) AS n, min(idx) AS first_index,
  count(DISTINCT kind) = 1 AND count(DISTINCT actor) = 1 AND count(DISTINCT payload_hash) = 1 AS identical,
  concat_ws(',', CASE WHEN count(DISTINCT actor) > 1 THEN 'actor' END, CASE WHEN count(DISTINCT kind) > 1 THEN 'kind' END,
            CASE WHEN count(DISTINCT payload_hash) > 1 THEN 'payload_hash' END) AS differing_fields
  FROM ev GROUP BY ALL HAVING count(*) > 1""".replace("GROUP BY ALL", "GROUP BY session, dup_id"))
def sl003_duplicate_ids(spark, d):
    return identity.duplicate_ids(ev(spark, d), "dup_id", ("kind", "actor", "payload_hash"))


@query("""SELECT session, dup_id AS id, count(*) AS n, min(idx) AS first_index, false AS identical,
  concat_ws(',', CASE WHEN count(DISTINCT actor) > 1 THEN 'actor' END, CASE WHEN count(DISTINCT coalesce(branch_id, '-')) > 1 THEN 'branch_id' END, CASE WHEN count(DISTINCT coalesce(corr, '-')) > 1 THEN 'corr' END,
            CASE WHEN count(DISTINCT kind) > 1 THEN 'kind' END, CASE WHEN count(DISTINCT coalesce(parent_id, '')) > 1 THEN 'parent_id' END, CASE WHEN count(DISTINCT payload_hash) > 1 THEN 'payload_hash' END,
            CASE WHEN count(DISTINCT ts_ms) > 1 THEN 'ts_ms' END) AS differing_fields
  FROM ev GROUP BY session, dup_id HAVING count(*) > 1""")
def sl003_all_fields(spark, d):
    return identity.duplicate_ids(ev(spark, d), "dup_id")


@query("SELECT session, id, idx, parent_id FROM ev e WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev p WHERE p.session = e.session AND p.id = e.parent_id)")
def sl004_missing_parent(spark, d):
    return identity.missing_parents(ev(spark, d))


#: Walks of the looped parents, for DuckDB: every node's path until it ends or meets itself.
WALK = """, e AS (SELECT session, id, idx, loop_parent AS p, EXISTS (SELECT 1 FROM ev q WHERE q.session = ev.session AND q.id = ev.loop_parent) AS ok FROM ev),
walk AS (
  SELECT session, id AS start, id AS at, [id] AS path, false AS closed FROM e
  UNION ALL
  SELECT w.session, w.start, e.p, list_append(w.path, e.p), list_contains(w.path, e.p)
  FROM walk w JOIN e ON e.session = w.session AND e.id = w.at WHERE NOT w.closed AND e.ok),
cyc AS (SELECT session, start, list_slice(path, 1, len(path) - 1) AS members FROM walk WHERE closed AND path[len(path)] = start)
"""


@query(WALK + """SELECT session, start AS entry, len(members) AS length, array_to_string(members, '>') || '>' || start AS cycle_path
  FROM cyc WHERE start = list_min(members)""")
def sl005_cycles(spark, d):
    return graph.cycles(graph.settle(ev(spark, d), "loop_parent"))


@query(WALK + """, term AS (
  SELECT w.session, w.start AS id, CASE WHEN w.closed THEN list_min(list_slice(w.path, list_position(w.path, w.at), len(w.path) - 1)) ELSE w.at END AS terminal, w.closed
  FROM walk w JOIN e ON e.session = w.session AND e.id = w.at WHERE w.closed OR NOT e.ok),
sized AS (SELECT session, terminal, count(*) AS size, CASE WHEN bool_or(closed) THEN min(id) ELSE terminal END AS root_id FROM term GROUP BY session, terminal)
SELECT session, root_id, size FROM sized QUALIFY row_number() OVER (PARTITION BY session ORDER BY size DESC, root_id) > 1""")
def sl006_components(spark, d):
    return graph.disconnected(graph.settle(ev(spark, d), "loop_parent"))


@query("""SELECT session, branch_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS heads FROM ev e
  WHERE kind NOT IN ('opaque', 'compaction_boundary') AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.session = e.session AND c.parent_id = e.id)
  GROUP BY session, branch_id HAVING count(*) > 1""")
def sl007_heads(spark, d):
    return identity.ambiguous_heads(ev(spark, d))


@query(""", late AS (SELECT c.session, c.id, c.idx, c.parent_id, p.ts_ms - c.ts_ms AS delta FROM ev c JOIN ev p ON p.session = c.session AND p.id = c.parent_id
  WHERE p.ts_ms - c.ts_ms > 2000)
SELECT session, count(*) AS n, max(delta) AS max_delta_ms, min(idx) AS child_index, arg_min(id, idx) AS record_id, arg_min(parent_id, idx) AS parent_id, arg_min(delta, idx) AS ts_delta_ms
FROM late GROUP BY session""")
def sl008_ts_order(spark, d):
    return identity.timestamp_regressions(ev(spark, d))


FAMILY_SQL = [(n, p, g) for n, p, g in identity.FAMILIES]


def _secret_sql() -> str:
    union = " UNION ALL ".join(f"SELECT doc_id AS record, '{n}' AS family, unnest(regexp_extract_all(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}')) AS m FROM documents" for n, p, _ in FAMILY_SQL)
    # RE2 has no back references: a value of one repeated sign is told by its letters.
    value = r"regexp_extract(m, '[:=][ ]*[""'']?([^:=]*)$', 1)"
    return rf"""WITH hits AS ({union}), v AS (SELECT *, {value} AS v FROM hits)
SELECT 'documents' AS session, record, family, count(*) AS n, array_to_string(list_sort(list_distinct(list(substr(sha256(m), 1, 16))))[1:16], ',') AS digests, max(strlen(m)) AS match_len
FROM v WHERE NOT regexp_matches(m, '{identity.PLACEHOLDER.replace(chr(39), chr(39) * 2)}') AND NOT (length(v) >= 2 AND len(list_distinct(string_split(v, ''))) = 1)
GROUP BY record, family"""


@query(_secret_sql(), ev=False)
def sl009_secrets(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return identity.secret_material(docs.select(F.lit("documents").alias("session"), F.col("doc_id").alias("record"), "text"))


@query(""", r AS (SELECT session, line, writer, row_number() OVER w AS rn, lag(writer) OVER w AS prev FROM ev WHERE writer IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY idx)),
runs AS (SELECT * FROM r WHERE prev IS NULL OR prev <> writer),
again AS (SELECT *, row_number() OVER (PARTITION BY session, writer ORDER BY rn) AS run FROM runs)
SELECT session, count(DISTINCT writer) AS writers, count(*) - 1 AS transitions, min(line) FILTER (run > 1) AS first_line FROM again GROUP BY session
HAVING min(line) FILTER (run > 1) IS NOT NULL AND count(*) >= 3""")
def sl010_writers(spark, d):
    return identity.interleaved_writers(ev(spark, d))


@query(""", o AS (SELECT session, idx, size, row_number() OVER (PARTITION BY session ORDER BY size, idx) - 1 AS r, count(*) OVER (PARTITION BY session) AS n FROM ev),
m AS (SELECT session, n, max(size) FILTER (r = n // 2) AS median, max(size) AS largest, min(idx) FILTER (size = mx) AS record_index
      FROM (SELECT *, max(size) OVER (PARTITION BY session) AS mx FROM o) GROUP BY session, n)
SELECT session, n, median, largest, record_index FROM m WHERE n >= 8 AND largest > greatest(median * 2, 1000)""")
def sl011_size(spark, d):
    return identity.size_anomalies(ev(spark, d), factor=2, floor=1000)


# --- pairing ---


@query("""SELECT session, corr, id, idx FROM ev r WHERE kind = 'tool_result' AND (corr IS NULL OR NOT EXISTS
  (SELECT 1 FROM ev c WHERE c.session = r.session AND c.corr = r.corr AND c.kind = 'tool_call'))""")
def sl101_orphan_results(spark, d):
    return pairing.orphan_results(ev(spark, d))


@query("""SELECT session, corr, id, idx FROM ev r WHERE kind = 'tool_call' AND (corr IS NULL OR NOT EXISTS
  (SELECT 1 FROM ev c WHERE c.session = r.session AND c.corr = r.corr AND c.kind = 'tool_result'))""")
def sl102_dangling_calls(spark, d):
    return pairing.dangling_calls(ev(spark, d))


@query("""SELECT session, corr, count(*) AS n, min(idx) AS first_index, array_to_string(list_sort(list(idx))[1:16], ',') AS indexes
  FROM ev WHERE kind = 'tool_call' AND corr IS NOT NULL GROUP BY session, corr HAVING count(*) > 1""")
def sl103_reused_calls(spark, d):
    return pairing.reused_calls(ev(spark, d))


@query("""SELECT session, corr, count(*) FILTER (kind = 'tool_result') AS n, min(idx) FILTER (kind = 'tool_result') AS first_index,
  CASE WHEN count(*) FILTER (kind = 'tool_call') = 1 AND count(DISTINCT payload_hash) FILTER (kind = 'tool_result') = 1 THEN 'deterministic' ELSE 'manual' END AS repairability
  FROM ev WHERE kind IN ('tool_call', 'tool_result') AND corr IS NOT NULL GROUP BY session, corr HAVING count(*) FILTER (kind = 'tool_result') > 1""")
def sl104_multiple_results(spark, d):
    return pairing.multiple_results(ev(spark, d))


PAIRS = """, g AS (SELECT session, corr FROM ev WHERE kind IN ('tool_call', 'tool_result') AND corr IS NOT NULL GROUP BY session, corr
  HAVING count(*) FILTER (kind = 'tool_call') = 1 AND count(*) FILTER (kind = 'tool_result') = 1),
pairs AS (SELECT g.session, g.corr, c.idx AS use_index, r.idx AS result_index, c.branch_id AS cb, r.branch_id AS rb, c.id AS cid, r.id AS rid
  FROM g JOIN ev c ON c.session = g.session AND c.corr = g.corr AND c.kind = 'tool_call' JOIN ev r ON r.session = g.session AND r.corr = g.corr AND r.kind = 'tool_result')
"""


def _pairs(spark, d):
    return pairing.clean_pairs(pairing.with_prefix_counts(ev(spark, d)))


@query(PAIRS + "SELECT session, corr, use_index, result_index FROM pairs WHERE result_index < use_index")
def sl105_reversed(spark, d):
    return pairing.reversed_pairs(_pairs(spark, d))


@query(PAIRS + """, up AS (SELECT session, id, id AS at FROM ev UNION ALL SELECT u.session, u.id, e.parent_id FROM up u JOIN ev e ON e.session = u.session AND e.id = u.at
    JOIN ev p ON p.session = e.session AND p.id = e.parent_id),
root AS (SELECT u.session, u.id, u.at FROM up u JOIN ev e ON e.session = u.session AND e.id = u.at WHERE NOT EXISTS (SELECT 1 FROM ev p WHERE p.session = e.session AND p.id = e.parent_id))
SELECT p.session, corr, use_index, result_index, CASE WHEN cb IS NULL AND rb IS NULL THEN 'component' ELSE 'branch_id' END AS fields
FROM pairs p JOIN root a ON a.session = p.session AND a.id = p.cid JOIN root b ON b.session = p.session AND b.id = p.rid
WHERE CASE WHEN cb IS NULL AND rb IS NULL THEN a.at <> b.at ELSE cb IS DISTINCT FROM rb END""")
def sl106_cross_branch(spark, d):
    return pairing.cross_branch(_pairs(spark, d), graph.components(graph.settle(ev(spark, d))))


@query(PAIRS + """SELECT p.session, p.corr, least(use_index, result_index) AS low, greatest(use_index, result_index) AS high, count(*) AS n
  FROM pairs p JOIN ev e ON e.session = p.session AND e.idx > least(use_index, result_index) AND e.idx < greatest(use_index, result_index)
  WHERE e.kind NOT IN ('tool_call', 'tool_use', 'tool_result', 'opaque') GROUP BY ALL""")
def sl107_adjacency(spark, d):
    return pairing.adjacency_gaps(_pairs(spark, d))


@query(PAIRS + """SELECT p.session, p.corr, use_index, result_index, min(e.idx) AS boundary_index, count(*) AS n, CASE WHEN count(*) = 1 THEN 'deterministic' ELSE 'lossy-explicit' END AS repairability
  FROM pairs p JOIN ev e ON e.session = p.session AND e.idx > least(use_index, result_index) AND e.idx < greatest(use_index, result_index)
  WHERE e.kind = 'compaction_boundary' GROUP BY ALL""")
def sl108_compaction_split(spark, d):
    return pairing.compaction_splits(_pairs(spark, d))


# --- checkpoints ---

GAPS = """, ck AS (SELECT session, idx, ckpt_seq, state_hash, lag(ckpt_seq) OVER (PARTITION BY session ORDER BY idx) AS prev FROM ev WHERE kind = 'checkpoint'),
gaps AS (SELECT session, idx, 'jump' AS reason, prev + 1 AS expected_seq, ckpt_seq AS found_seq FROM ck WHERE ckpt_seq - prev > 1
  UNION ALL SELECT session, idx, 'no_hash', NULL, ckpt_seq FROM ck WHERE state_hash IS NULL),
firsts AS (SELECT session, ckpt_seq, arg_min(state_hash, idx) AS hash_a FROM ck WHERE state_hash IS NOT NULL GROUP BY session, ckpt_seq),
divs AS (SELECT ck.session, ck.idx, ck.ckpt_seq, hash_a, ck.state_hash AS hash_b FROM ck JOIN firsts f ON f.session = ck.session AND f.ckpt_seq = ck.ckpt_seq WHERE ck.state_hash <> hash_a)
"""


@query(GAPS + "SELECT session, idx, reason, coalesce(expected_seq, -1) AS expected_seq, found_seq FROM gaps")
def sl201_checkpoint_gaps(spark, d):
    return checkpoint.checkpoint_gaps(ev(spark, d)).fillna(-1, ["expected_seq"])


@query(GAPS + "SELECT * FROM divs")
def sl202_divergence(spark, d):
    return checkpoint.checkpoint_divergence(ev(spark, d))


@query(GAPS + """, trig AS (SELECT session, idx, 'SL201' AS cause FROM gaps UNION SELECT session, idx, 'SL202' FROM divs UNION
  SELECT session, idx, 'compaction' FROM ev b WHERE kind = 'compaction_boundary' AND
    (SELECT min(idx) FROM ev t WHERE t.session = b.session AND t.idx > b.idx AND t.kind IN ('tool_call', 'tool_result'))
    < coalesce((SELECT min(idx) FROM ev c WHERE c.session = b.session AND c.idx > b.idx AND c.kind = 'checkpoint'), 1000000000)),
t2 AS (SELECT *, (SELECT min(idx) FROM ev t WHERE t.session = trig.session AND t.idx > trig.idx AND t.kind IN ('tool_call', 'tool_result')) AS tool FROM trig)
SELECT session, min(idx) AS trigger_index, min(tool) AS first_unsafe_index, string_agg(DISTINCT cause, ',' ORDER BY cause) AS caused_by FROM t2 WHERE tool IS NOT NULL GROUP BY session""")
def sl203_unsafe_continuation(spark, d):
    e = ev(spark, d)
    return checkpoint.unsafe_continuations(e, checkpoint.checkpoint_gaps(e), checkpoint.checkpoint_divergence(e))


@query(""", p AS (SELECT session, idx, contribution, cumulative, sum(CASE WHEN kind = 'compaction_boundary' THEN 1 ELSE 0 END) OVER w AS epoch,
  sum(CASE WHEN cumulative IS NOT NULL THEN 1 ELSE 0 END) OVER w - CASE WHEN cumulative IS NOT NULL THEN 1 ELSE 0 END AS win FROM ev WINDOW w AS (PARTITION BY session ORDER BY idx)),
a AS (SELECT session, epoch, win, sum(contribution) AS added FROM p GROUP BY ALL),
m AS (SELECT session, idx, epoch, win, cumulative, lag(cumulative) OVER (PARTITION BY session, epoch ORDER BY idx) AS base FROM p WHERE cumulative IS NOT NULL)
SELECT m.session, idx, CAST(1 AS BIGINT) AS mismatched_key_count, CAST(coalesce(base, 0) + added AS BIGINT) AS expected_total, cumulative AS observed_total
FROM m JOIN a USING (session, epoch, win) WHERE (epoch = 0 OR base IS NOT NULL) AND coalesce(base, 0) + added <> cumulative""")
def sl204_usage(spark, d):
    one = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.lit("tokens"), F.col(c)))
    return checkpoint.usage_arithmetic(ev(spark, d).withColumn("usage", one("contribution")).withColumn("cumulative", one("cumulative")))


@query(""", up AS (SELECT session, id, id AS at, idx AS peak FROM ev UNION ALL
  SELECT u.session, u.id, p.id, greatest(u.peak, p.idx) FROM up u JOIN ev e ON e.session = u.session AND e.id = u.at JOIN ev p ON p.session = e.session AND p.id = e.parent_id),
root AS (SELECT u.session, u.id, u.peak, e.parent_id AS above FROM up u JOIN ev e ON e.session = u.session AND e.id = u.at WHERE NOT EXISTS (SELECT 1 FROM ev p WHERE p.session = e.session AND p.id = e.parent_id))
SELECT b.session, b.idx, b.id AS boundary_id, b.leaf_id, CASE WHEN l.id IS NULL THEN 'missing' ELSE 'non_contiguous' END AS divergence
FROM ev b LEFT JOIN ev l ON l.session = b.session AND l.id = b.leaf_id LEFT JOIN root r ON r.session = b.session AND r.id = b.leaf_id
WHERE b.kind = 'compaction_boundary' AND b.leaf_id IS NOT NULL AND (l.id IS NULL OR l.idx >= b.idx OR r.above IS NOT NULL OR r.peak > b.idx)""")
def sl205_coverage(spark, d):
    e = ev(spark, d)
    return checkpoint.coverage_gaps(e, graph.settle(e))


@query(""", r AS (SELECT session, min(ordinal) FILTER (kind <> 'message') AS lo, max(ordinal) FILTER (kind <> 'message') AS hi, max(ordinal + 5) FILTER (claim) AS c FROM ev GROUP BY session),
h AS (SELECT session, ordinal, lead(ordinal) OVER (PARTITION BY session ORDER BY ordinal) AS nxt FROM (SELECT DISTINCT session, ordinal FROM ev))
SELECT session, 'claim_beyond_durable' AS divergence, c AS ordinal, 1 AS n FROM r WHERE c > hi
UNION ALL SELECT h.session, 'hole', min(ordinal + 1), CAST(sum(least(nxt, hi) - ordinal - 1) AS BIGINT) FROM h JOIN r ON r.session = h.session
WHERE nxt - ordinal > 1 AND ordinal >= lo AND ordinal < hi AND least(nxt, hi) - ordinal - 1 > 0 GROUP BY h.session""")
def sl206_durable_prefix(spark, d):
    rows = ev(spark, d).select("session", "ordinal", (F.col("kind") != "message").alias("durable"), F.when(F.col("claim"), F.col("ordinal") + 5).alias("claimed"))
    return checkpoint.durable_prefix(rows)


@query(""", m AS (SELECT session, max(idx) AS idx, arg_max(k * 2000, idx) AS occupancy FROM ev WHERE k % 3 = 0 GROUP BY session)
SELECT session, idx, occupancy, CAST(200000 AS BIGINT) AS window_limit, 200000 - occupancy AS headroom FROM m WHERE (200000 - occupancy) * 20 < 600000""")
def sl207_pressure(spark, d):
    marks = ev(spark, d).where("k % 3 = 0").select("session", "idx", (F.col("k") * 2000).alias("occupancy"), F.lit(200000).cast("long").alias("window_limit"))
    return checkpoint.context_pressure(marks)


@query(""", it AS (SELECT session, idx AS boundary_index, CASE WHEN k % 7 = 0 THEN nxt ELSE parent_id END AS item_id, CASE WHEN k % 2 = 0 THEN 'message' ELSE 'tool_call' END AS item_type, 'c' || CAST(k % 20 AS VARCHAR) AS item_corr
  FROM (SELECT *, lead(id) OVER (PARTITION BY session ORDER BY idx) AS nxt FROM ev) WHERE kind = 'compaction_boundary'),
j AS (SELECT it.*, e.kind, e.corr, e.idx FROM it JOIN ev e ON e.session = it.session AND e.id = it.item_id),
x AS (SELECT session, boundary_index, item_id, 'type-mismatch' AS divergence FROM j WHERE item_type <> kind UNION ALL
  SELECT session, boundary_index, item_id, 'correlation-mismatch' FROM j WHERE item_type = kind AND item_corr IS DISTINCT FROM corr UNION ALL
  SELECT session, boundary_index, item_id, 'future-item' FROM j WHERE idx > boundary_index)
SELECT session, divergence, count(*) AS occurrences, min(boundary_index) AS boundary_index, arg_min(item_id, boundary_index) AS item_id FROM x GROUP BY session, divergence""")
def sl208_snapshot(spark, d):
    from pyspark.sql import Window as W

    e = ev(spark, d)
    items = e.withColumn("nxt", F.lead("id").over(W.partitionBy("session").orderBy("idx"))).where("kind = 'compaction_boundary'").select(
        "session", F.col("idx").alias("boundary_index"), F.when(F.col("k") % 7 == 0, F.col("nxt")).otherwise(F.col("parent_id")).alias("item_id"),
        F.when(F.col("k") % 2 == 0, "message").otherwise("tool_call").alias("item_type"), F.concat(F.lit("c"), (F.col("k") % 20).cast("string")).alias("item_corr"),
    )
    return checkpoint.snapshot_divergence(items.where("item_id is not null"), e)


# --- compatibility, linkage ---


@query("SELECT session, min(line) AS line, arg_min(version, line) AS version FROM ev WHERE version IS NOT NULL AND version <> 'v0' AND version <> 'v1' GROUP BY session")
def sl301_versions(spark, d):
    return compatibility.unsupported_versions(ev(spark, d), ["v0", "v1"])


@query("SELECT session, line, kind AS record_type FROM ev WHERE kind NOT IN ('message', 'tool_call', 'tool_result') AND k % 2 = 0 OR k % 31 = 0")
def sl302_unknown_records(spark, d):
    rows = ev(spark, d).select("session", "line", F.col("kind").alias("record_type"), (F.col("k") % 2 == 0).alias("semantic"), F.array(F.when(F.col("k") % 31 == 0, "danger").otherwise("plain")).alias("keys"))
    return compatibility.unknown_records(rows, ["message", "tool_call", "tool_result"], ["danger"])


@query(r"""WITH j AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{"k":1,"k":2,"a":3}' WHEN event_id % 7 = 0 THEN '{"a":1,"b":2,"b":3,"b":4}' ELSE props END AS js FROM events),
k AS (SELECT event_id, unnest(regexp_extract_all(js, '"([a-z]+)":', 1)) AS key FROM j)
SELECT event_id AS record, key AS key_path, count(*) AS occurrence_count, CASE WHEN key = 'k' THEN 'error' ELSE 'warning' END AS severity FROM k GROUP BY event_id, key HAVING count(*) > 1""", ev=False)
def sl303_duplicate_keys(spark, d):
    js = F.when(F.col("event_id") % 5 == 0, '{"k":1,"k":2,"a":3}').when(F.col("event_id") % 7 == 0, '{"a":1,"b":2,"b":3,"b":4}').otherwise(F.col("props"))
    keys = F.json_object_keys(js)
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", keys.alias("keys")).where(F.size("keys") > F.size(F.array_distinct("keys")))
    got = rows.select(F.col("event_id").alias("record"), F.explode("keys").alias("key_path")).groupBy("record", "key_path").agg(F.count(F.lit(1)).alias("occurrence_count")).where("occurrence_count > 1")
    return got.withColumn("severity", F.when(F.col("key_path") == "k", "error").otherwise("warning"))


@query(""", m AS (SELECT session, idx, version, lag(version) OVER (PARTITION BY session ORDER BY idx) AS previous FROM ev WHERE version IS NOT NULL),
f AS (SELECT session, idx, 'version' AS drift, previous, version AS observed FROM m WHERE previous <> version UNION ALL
  SELECT session, idx, 'envelope', NULL, 'other' FROM ev WHERE kind = 'checkpoint'),
o AS (SELECT session, drift, previous, observed, min(idx) AS idx FROM f GROUP BY ALL)
SELECT * FROM o WHERE session NOT IN (SELECT session FROM ev WHERE version IS NOT NULL AND version NOT IN ('v0', 'v1', 'v2'))
QUALIFY row_number() OVER (PARTITION BY session ORDER BY idx, drift, observed) <= 8""")
def sl304_drift(spark, d):
    e = ev(spark, d).withColumn("record_type", F.col("kind"))
    foreign = spark.createDataFrame([("checkpoint", "other")], "record_type string, format string")
    return compatibility.drift(e, foreign, compatibility.unsupported_versions(e, ["v0", "v1", "v2"]))


@query("""SELECT session, count(*) AS item_count, min(ordinal) AS first_ordinal, CASE WHEN arg_min(k, (ordinal, CASE WHEN k % 4 = 1 THEN 'array' ELSE 'other' END)) % 4 = 1 THEN 'array' ELSE 'other' END AS shape
  FROM ev WHERE kind = 'message' AND k % 2 = 1 GROUP BY session""")
def sl305_foreign_shape(spark, d):
    items = ev(spark, d).select("session", "ordinal", F.when(F.col("kind") == "message", "reasoning").otherwise("other").alias("family"), F.when(F.col("k") % 4 == 1, "array").when(F.col("k") % 4 == 3, "other").otherwise("text").alias("shape"))
    return compatibility.foreign_shapes(items)


@query(""", t AS (SELECT session, 'x' || CAST(k % 50 AS VARCHAR) AS record_type, count(*) AS n, min(line) AS line FROM ev WHERE k % 2 = 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line, record_type) AS r FROM t)
SELECT session, CASE WHEN r <= 4 THEN record_type ELSE '<other-types>' END AS type_value, CAST(sum(n) AS BIGINT) AS n, min(line) AS first_line FROM r GROUP BY 1, 2""")
def sl306_unknown_metadata(spark, d):
    rows = ev(spark, d).select("session", "line", F.concat(F.lit("x"), (F.col("k") % 50).cast("string")).alias("record_type"), (F.col("k") % 2 == 0).alias("semantic"))
    return compatibility.unknown_metadata(rows, ["message"], 4)


@query("""WITH keys AS (SELECT 's' || CAST(s_suppkey % 80 AS VARCHAR) AS key, 'f' || CAST(s_suppkey AS VARCHAR) AS file FROM supplier
  UNION SELECT 'f' || CAST(s_suppkey AS VARCHAR), 'f' || CAST(s_suppkey AS VARCHAR) FROM supplier),
links AS (SELECT 'f' || CAST(o_custkey % 40 AS VARCHAR) AS file, o_orderkey AS link_index, CASE WHEN o_orderkey % 3 = 0 THEN 'head_ref' ELSE 'session_ref' END AS link_kind,
  CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 'f' END || CAST(o_orderkey % 120 AS VARCHAR) AS target FROM orders),
c AS (SELECT l.*, (SELECT count(DISTINCT k.file) FROM keys k WHERE k.key = l.target AND k.file <> l.file) AS candidate_count FROM links l)
SELECT file, link_index, link_kind, target, candidate_count, CASE WHEN candidate_count > 1 THEN 'ambiguous' WHEN link_kind = 'head_ref' THEN 'unresolved' ELSE 'missing' END AS resolution
FROM c WHERE candidate_count <> 1""", ev=False)
def sl401_links(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    o = spark.read.parquet(f"{d}/orders.parquet")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key = F.col("s_suppkey")
    keys = s.select(name("s", key % 80).alias("key"), name("f", key).alias("file")).union(s.select(name("f", key), name("f", key)))
    k = F.col("o_orderkey")
    links = o.select(
        name("f", F.col("o_custkey") % 40).alias("file"), k.alias("link_index"), F.when(k % 3 == 0, "head_ref").otherwise("session_ref").alias("link_kind"),
        F.concat(F.when(k % 2 == 0, "s").otherwise("f"), (k % 120).cast("string")).alias("target"),
    )
    return compatibility.unresolved_links(links, keys)


@query("""SELECT 'file-not-in-index' AS divergence, CAST(o_custkey AS VARCHAR) AS key FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT 'index-entry-no-file', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'spawn-edge-orphan-parent', CAST(p AS VARCHAR) FROM (SELECT DISTINCT l_suppkey AS p FROM lineitem) WHERE p NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT 'spawn-edge-orphan-child', CAST(c AS VARCHAR) FROM (SELECT DISTINCT l_partkey AS c FROM lineitem) WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)""", ev=False)
def sl402_index(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    text = lambda c: F.col(c).cast("string")
    index = read("customer").where("c_custkey % 3 <> 0").select(text("c_custkey").alias("key"))
    edges = read("lineitem").select(text("l_suppkey").alias("parent"), text("l_partkey").alias("child"))
    return compatibility.index_divergence(index, read("orders").select(text("o_custkey").alias("key")), True, edges)


# --- corpus ---


def findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings of the detectors that the corpus queries roll up; the events are derived once."""
    e = graph.cut(ev(spark, d))
    pairs = pairing.clean_pairs(pairing.with_prefix_counts(e))
    multi = pairing.multiple_results(e)
    parts = [
        as_findings("SL004", identity.missing_parents(e), "idx", "id"),
        as_findings("SL101", pairing.orphan_results(e), "idx", "id"),
        as_findings("SL102", pairing.dangling_calls(e), "idx", "id"),
        as_findings("SL103", pairing.reused_calls(e), "first_index"),
        as_findings("SL104", multi, "first_index", repairability=F.col("repairability")),
        as_findings("SL105", pairing.reversed_pairs(pairs), "result_index"),
        as_findings("SL108", pairing.compaction_splits(pairs), "boundary_index", repairability=F.col("repairability")),
        as_findings("SL202", checkpoint.checkpoint_divergence(e), "idx"),
        as_findings("SL301", compatibility.unsupported_versions(e, ["v0", "v1"]), "line"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _plain(name: str) -> str:
    """The SQL of another query without its view, to be nested."""
    return SQL[name].removeprefix(f"WITH RECURSIVE {EV} ")


def _findings_sql() -> str:
    """ev and the findings as common table expressions; each detector's own expressions are nested in its select."""

    def nested(name: str) -> str:
        body = _plain(name)
        return f"(WITH {body.lstrip(', ')})" if body.startswith(",") else f"({body})"

    rows = [
        ("SL004", "error", "sl004_missing_parent", "idx"), ("SL101", "error", "sl101_orphan_results", "idx"), ("SL102", "error", "sl102_dangling_calls", "idx"),
        ("SL103", "error", "sl103_reused_calls", "first_index"), ("SL104", "error", "sl104_multiple_results", "first_index"), ("SL105", "error", "sl105_reversed", "result_index"),
        ("SL108", "warning", "sl108_compaction_split", "boundary_index"), ("SL202", "error", "sl202_divergence", "idx"), ("SL301", "error", "sl301_versions", "line"),
    ]
    return ", fd AS (" + " UNION ALL ".join(f"SELECT session, '{c}' AS code, '{s}' AS severity, {i} AS idx FROM {nested(q)}" for c, s, q, i in rows) + ")"


FD = _findings_sql()
VERDICT = """, vd AS (SELECT s.session, CASE WHEN bool_or(code = 'SL301') THEN 'unsupported' WHEN count(*) FILTER (severity IN ('fatal', 'error')) > 0 THEN 'invalid' ELSE 'healthy' END AS verdict,
  count(*) FILTER (severity IN ('fatal', 'error')) AS errors, count(*) FILTER (severity = 'warning') AS warnings
  FROM (SELECT DISTINCT session FROM ev) s LEFT JOIN fd ON fd.session = s.session GROUP BY s.session)"""


@query("SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM ev GROUP BY kind UNION ALL SELECT 'actor', actor, count(*) FROM ev GROUP BY actor")
def stats_histograms(spark, d):
    return corpus.histograms(ev(spark, d))


@query(""", n AS (SELECT count(*) AS v FROM ev GROUP BY session), s AS (SELECT list_sort(list(v)) AS l, count(*) AS n, sum(v) AS total FROM n)
SELECT l[least(CAST(floor(0.5 * n) AS BIGINT), n - 1) + 1] AS p50, l[least(CAST(floor(0.95 * n) AS BIGINT), n - 1) + 1] AS p95, l[n] AS max, CAST(total AS BIGINT) AS total, n FROM s""")
def stats_nearest_rank(spark, d):
    sizes = ev(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("size"))
    return corpus.nearest_rank(sizes, "size", {"p50": 0.5, "p95": 0.95})


@query("SELECT corr AS value, count(*) AS n FROM ev WHERE kind = 'tool_call' AND corr IS NOT NULL GROUP BY corr ORDER BY n DESC, value LIMIT 5")
def stats_top_tools(spark, d):
    return corpus.top_values(ev(spark, d), F.when(F.col("kind") == "tool_call", F.col("corr")), 5)


@query(FD + VERDICT + " SELECT verdict, count(*) AS n FROM vd GROUP BY verdict")
def scan_totals(spark, d):
    return corpus.totals(corpus.verdicts(ev(spark, d), findings(spark, d)))


@query(FD + " SELECT code, count(*) AS n, count(DISTINCT session) AS sessions, CASE min(CASE severity WHEN 'error' THEN 2 ELSE 3 END) WHEN 2 THEN 2 ELSE 3 END AS severity_rank FROM fd GROUP BY code")
def scan_by_code(spark, d):
    return corpus.by_code(findings(spark, d))


@query(FD + VERDICT + " SELECT session, errors, warnings FROM vd WHERE errors > 0 OR warnings > 0 ORDER BY errors DESC, warnings DESC, session LIMIT 10")
def worst_sessions(spark, d):
    return corpus.worst_sessions(corpus.verdicts(ev(spark, d), findings(spark, d)))


@query(FD + " SELECT session, count(*) FILTER (severity = 'fatal') AS fatal, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM fd GROUP BY session")
def report_counts(spark, d):
    return corpus.severity_counts(findings(spark, d))


@query(FD + VERDICT + " SELECT session, verdict, CASE WHEN verdict = 'unsupported' THEN 'A0' WHEN errors > 0 THEN 'A1' WHEN warnings > 0 THEN 'A2' ELSE 'A3' END AS assurance FROM vd")
def assurance_levels(spark, d):
    v = corpus.verdicts(ev(spark, d), findings(spark, d))
    return v.select("session", "verdict", corpus.assurance(v).alias("assurance"))


@query(FD + """, r AS (SELECT session, code, row_number() OVER (PARTITION BY session, code ORDER BY idx) AS r FROM fd)
SELECT session, code, count(*) FILTER (r <= 3) AS kept, count(*) FILTER (r > 3) AS over FROM r GROUP BY session, code""")
def findings_capped(spark, d):
    got = corpus.capped(findings(spark, d), 3)
    over = F.get_json_object("evidence", "$.overflow").cast("long")
    return got.groupBy("session", "code").agg(F.sum(over.isNull().cast("long")).alias("kept"), F.coalesce(F.max(over), F.lit(0)).alias("over"))


@query("""SELECT session, id, idx FROM ev r WHERE kind = 'tool_result' AND (corr IS NULL OR NOT EXISTS
  (SELECT 1 FROM ev c WHERE c.session = r.session AND c.corr = r.corr AND c.kind = 'tool_call')) AND CAST(id AS BIGINT) % 3 <> 0""")
def baseline_filter(spark, d):
    f = corpus.fingerprint(as_findings("SL101", pairing.orphan_results(ev(spark, d)), "idx", "id"))
    known = f.where(F.col("record_id").cast("long") % 3 == 0).select("fingerprint", "key")
    return corpus.baseline_filter(f, known).select("session", F.col("record_id").alias("id"), "idx")


@query("SELECT session, kind, count(*) AS n FROM ev GROUP BY ALL")
def bundle_kind_counts(spark, d):
    return corpus.kind_counts(ev(spark, d))


@query("""WITH files AS (SELECT o_orderkey, 'a' || CAST(o_custkey % 3 AS VARCHAR) AS analysis, CAST(o_orderkey % 7 AS VARCHAR) AS sha FROM orders),
cache AS (SELECT o_orderkey, 'a1' AS analysis, CAST(o_orderkey % 5 AS VARCHAR) AS sha, o_orderstatus AS verdict FROM orders)
SELECT f.o_orderkey AS path, c.verdict FROM files f LEFT JOIN cache c ON c.o_orderkey = f.o_orderkey AND c.analysis = f.analysis AND c.sha = f.sha""", ev=False)
def cache_reuse(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    files = o.select(F.col("o_orderkey").alias("path"), F.concat(F.lit("a"), (F.col("o_custkey") % 3).cast("string")).alias("analysis"), (F.col("o_orderkey") % 7).cast("string").alias("sha256"))
    cache = o.select(F.col("o_orderkey").alias("path"), F.lit("a1").alias("analysis"), (F.col("o_orderkey") % 5).cast("string").alias("sha256"), F.col("o_orderstatus").alias("verdict"))
    held, anew = corpus.reusable(files, cache)
    return held.select("path", "verdict").unionByName(anew.select("path", F.lit(None).cast("string").alias("verdict")))


@query(""", seeds AS (SELECT DISTINCT session, id FROM ev WHERE parent_id IS NOT NULL AND parent_id LIKE '-%'),
down AS (SELECT session, id FROM seeds UNION SELECT e.session, e.id FROM down x JOIN ev e ON e.session = x.session AND e.parent_id = x.id)
SELECT e.session, count(d.id) AS affected, count(*) - count(d.id) AS outside, coalesce(min(e.idx) FILTER (d.id IS NOT NULL), -1) AS first_index FROM ev e LEFT JOIN down d ON d.session = e.session AND d.id = e.id GROUP BY e.session""")
def triage_impact(spark, d):
    e = ev(spark, d)
    return graph.impact(e, e.where("parent_id like '-%'")).fillna(-1, ["first_index"])


# --- diff and repair ---


def _versions(spark, d):
    a = ev(spark, d).withColumn("content_hash", F.concat("payload_hash", "actor"))
    eid = F.col("id").cast("long")
    b = a.where(eid % 13 != 0)
    b = b.withColumn("content_hash", F.when(eid % 11 == 1, F.lit("new")).otherwise(F.col("content_hash"))).withColumn("kind", F.when(eid % 17 == 1, F.lit("opaque")).otherwise(F.col("kind")))
    b = b.withColumn("idx", F.when(eid % 19 == 0, F.col("idx") + 5).otherwise(F.col("idx")) * 1000 + eid % 1000).withColumn("id", F.when(eid % 23 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id")))
    return a, b


VERSIONS = """, a AS (SELECT session, id, idx, kind, parent_id, payload_hash || actor AS content_hash FROM ev),
b AS (SELECT session, CASE WHEN CAST(id AS BIGINT) % 23 = 0 THEN 'n' || id ELSE id END AS id, (idx + CASE WHEN CAST(id AS BIGINT) % 19 = 0 THEN 5 ELSE 0 END) * 1000 + CAST(id AS BIGINT) % 1000 AS idx,
  CASE WHEN CAST(id AS BIGINT) % 17 = 1 THEN 'opaque' ELSE kind END AS kind, parent_id, CASE WHEN CAST(id AS BIGINT) % 11 = 1 THEN 'new' ELSE content_hash END AS content_hash FROM a WHERE CAST(id AS BIGINT) % 13 <> 0),
p1 AS (SELECT a.session, a.id, a.idx AS ia, b.idx AS ib, a.kind <> b.kind AS k, a.content_hash <> b.content_hash AS c FROM a JOIN b ON a.session = b.session AND a.id = b.id),
la AS (SELECT *, row_number() OVER (PARTITION BY session, kind, parent_id, content_hash ORDER BY idx) AS rn FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.session = a.session AND b.id = a.id)),
lb AS (SELECT *, row_number() OVER (PARTITION BY session, kind, parent_id, content_hash ORDER BY idx) AS rn FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.session = a.session AND b.id = a.id)),
p2 AS (SELECT la.session, la.id AS ida, lb.id AS idb, la.idx AS ia, lb.idx AS ib, coalesce(la.session, lb.session) AS s FROM la FULL JOIN lb ON la.session = lb.session AND la.kind = lb.kind AND la.parent_id IS NOT DISTINCT FROM lb.parent_id AND la.content_hash = lb.content_hash AND la.rn = lb.rn),
both_ AS (SELECT session, id, ia, ib FROM p1 UNION ALL SELECT session, ida, ia, ib FROM p2 WHERE ida IS NOT NULL AND idb IS NOT NULL)
SELECT s AS session, 'removed' AS delta, ida AS id, ia AS idx FROM p2 WHERE idb IS NULL UNION ALL SELECT s, 'added', idb, ib FROM p2 WHERE ida IS NULL
UNION ALL SELECT session, 'kind-changed', id, ia FROM p1 WHERE k UNION ALL SELECT session, 'content-changed', id, ia FROM p1 WHERE c
UNION ALL (SELECT session, 'seq-reordered', id, ia FROM (SELECT *, max(ib) OVER (PARTITION BY session ORDER BY ia ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM both_) WHERE top > ib)"""


@query(VERSIONS)
def diff_sessions(spark, d):
    return changes.diff(*_versions(spark, d))


@query("""SELECT session, id, idx FROM ev x WHERE NOT (length(dup_id) <= 3 AND EXISTS (SELECT 1 FROM ev y WHERE y.session = x.session AND y.dup_id = x.dup_id AND y.kind = x.kind AND y.actor = x.actor AND y.payload_hash = x.payload_hash AND y.idx < x.idx))""")
def repair_drop_duplicates(spark, d):
    return changes.drop_duplicates(ev(spark, d), "dup_id", ["kind", "actor", "payload_hash"]).select("session", "id", "idx")


@query("""SELECT session, id, idx FROM ev x WHERE NOT (kind = 'tool_result' AND corr IS NOT NULL AND EXISTS (SELECT 1 FROM ev y WHERE y.session = x.session AND y.kind = 'tool_result' AND y.corr = x.corr AND y.payload_hash = x.payload_hash AND y.idx < x.idx))""")
def repair_extra_results(spark, d):
    return changes.drop_extra_results(ev(spark, d)).select("session", "id", "idx")


@query(""", l AS (SELECT *, lag(kind) OVER w AS lk, lag(actor) OVER w AS la, lag(payload_hash) OVER w AS lp FROM ev WINDOW w AS (PARTITION BY session ORDER BY idx))
SELECT session, idx FROM l WHERE NOT (idx > 0 AND lk = kind AND la = actor AND lp = payload_hash)""")
def repair_collapse_adjacent(spark, d):
    return changes.collapse_adjacent(ev(spark, d).withColumn("id", F.lit("same")), ["kind", "actor", "payload_hash"]).select("session", "idx")


@query("SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY idx) - 1 AS seq FROM ev")
def repair_renumber(spark, d):
    return changes.renumber(ev(spark, d).withColumn("idx", F.col("idx") * 3 + 7)).select("session", "id", "seq")


@query("""SELECT e.session, e.id, coalesce(p.id, e.parent_id) AS parent_id FROM ev e LEFT JOIN ev p ON e.parent_id LIKE '-%' AND p.session = e.session AND p.idx = e.idx - 1 AND p.branch_id = e.branch_id""")
def repair_restore_parents(spark, d):
    e = ev(spark, d)
    near = e.select("session", (F.col("idx") + 1).alias("idx"), F.col("id").alias("candidate"), "branch_id")
    lost = identity.missing_parents(e).select("session", "id").join(e.select("session", "id", "idx", "branch_id"), ["session", "id"])
    return changes.restore_parents(e, lost.join(near, ["session", "idx", "branch_id"]).select("session", "id", "candidate")).select("session", "id", "parent_id")


@query("""SELECT session, id FROM ev e WHERE idx < coalesce((SELECT min(idx) FROM ev c WHERE c.session = e.session AND c.kind = 'compaction_boundary' AND c.k % 5 = 0), 1000000000)
  OR EXISTS (SELECT 1 FROM ev x WHERE x.session = e.session AND x.kind = 'checkpoint' AND x.idx >= (SELECT min(idx) FROM ev c WHERE c.session = e.session AND c.kind = 'compaction_boundary' AND c.k % 5 = 0))""")
def repair_discard_suffix(spark, d):
    e = ev(spark, d)
    cuts = e.where("kind = 'compaction_boundary' and k % 5 = 0").groupBy("session").agg(F.min("idx").alias("cut"))
    return changes.discard_suffix(e, cuts).select("session", "id")


@query("""SELECT session, id FROM ev e WHERE NOT (k % 9 = 0 AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.session = e.session AND c.parent_id = e.id))""")
def repair_drop_rows(spark, d):
    e = ev(spark, d)
    return changes.drop_rows(e, e.where("k % 9 = 0")).select("session", "id")


#: The chain of every ledger, link by link: what an entry's hash covers and what the broken copy has in its place.
CHAIN = """e AS (SELECT user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, props, sha256(props) AS body, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
link AS (
  SELECT ledger, line, body, k, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|1|' || body) AS h FROM e WHERE line = 1
  UNION ALL
  SELECT e.ledger, e.line, e.body, e.k, l.h, sha256(l.h || '|' || CAST(e.line AS VARCHAR) || '|' || e.body) FROM link l JOIN e ON e.ledger = l.ledger AND e.line = l.line + 1)
"""


def _sealed(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("ledger"), F.row_number().over(w).alias("line"), F.col("props").alias("body"))
    return changes.seal(raw).withColumn("k", F.get_json_object("body", "$.k").cast("long"))


@query(f"""WITH RECURSIVE {CHAIN}SELECT ledger, line AS seq, prev AS prev_sha256, h AS entry_sha256 FROM link""", ev=False)
def seal_chain(spark, d):
    return _sealed(spark, d).select("ledger", "seq", "prev_sha256", "entry_sha256")


@query(f"""WITH RECURSIVE {CHAIN}, t AS (SELECT ledger, line, line + CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END AS seq, CASE WHEN k % 37 = 0 THEN 'x' ELSE prev END AS prev_s, CASE WHEN k % 43 = 0 THEN sha256('other') ELSE body END AS body_s, h FROM link),
v AS (SELECT *, lag(seq, 1, 0) OVER w AS ls, lag(h, 1, repeat('0', 64)) OVER w AS lh FROM t WINDOW w AS (PARTITION BY ledger ORDER BY line)),
b AS (SELECT ledger, line, CASE WHEN seq <> ls + 1 THEN 'seq-gap' WHEN prev_s <> lh THEN 'chain-break' WHEN sha256(prev_s || '|' || CAST(seq AS VARCHAR) || '|' || body_s) <> h THEN 'hash-mismatch' END AS kind FROM v)
SELECT ledger, min(line) AS line, arg_min(kind, line) AS kind FROM b WHERE kind IS NOT NULL GROUP BY ledger""", ev=False)
def seal_verify(spark, d):
    k = F.col("k")
    torn = _sealed(spark, d).withColumns(
        {
            "seq": F.col("seq") + F.when(k % 41 == 0, 1).otherwise(0),
            "prev_sha256": F.when(k % 37 == 0, "x").otherwise(F.col("prev_sha256")),
            "body": F.when(k % 43 == 0, "other").otherwise(F.col("body")),
            "body_sha256": F.when(k % 43 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("body_sha256")),
        }
    )
    return changes.verify_seal(torn)


# --- outcome ---

CONTRACT = {
    "name": "orders shipped",
    "source_key": ["o_orderkey"],
    "target_key": ["l_orderkey"],
    "as_of": "1999-01-01T00:00:00Z",
    "observed_at": "1999-01-01T05:00:00+05:00",
    "conditions": [
        {"id": "shipped", "type": "exists"},
        {"id": "few", "type": "count", "min": 1, "max": 4},
        {"id": "flag", "type": "one_of", "field": "l_returnflag", "values": ["a", "n"], "normalize": ["trim", "casefold"], "advisory": True},
        {"id": "qty", "type": "range", "field": "l_quantity", "min": 1, "max": 45},
        {"id": "lane", "type": "route", "field": "l_linestatus", "cases": [{"when": [{"field": "o_orderpriority", "op": "eq", "value": "1-URGENT"}], "values": ["O"]}]},
        {"id": "open", "type": "required", "field": "l_shipdate", "when": [{"field": "o_orderstatus", "op": "in", "value": ["O", "P"]}]},
        {"id": "gone", "type": "required", "field": "l_nowhere", "advisory": True},
        {"id": "late", "type": "on_time", "field": "l_shipdate", "start_field": "o_orderdate", "due_seconds": 31536000, "advisory": True},
        {"id": "either", "type": "any_of", "advisory": True, "any": [{"id": "a", "type": "range", "field": "l_quantity", "min": 40}, {"id": "b", "type": "count", "min": 6}]},
    ],
}

#: The same contract spelled out; ranks as in the engine: 0 violated, 1 inconclusive, 2 pending, 3 verified, 4 not evaluated, 5 not applicable.
OUTCOME = """WITH j AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, l.* FROM orders LEFT JOIN lineitem l ON l_orderkey = o_orderkey),
g AS (SELECT CAST(o_orderkey AS VARCHAR) AS item, count(l_orderkey) AS n, any_value(o_orderstatus) AS st,
  coalesce(min(CASE WHEN l_orderkey IS NULL THEN NULL WHEN lower(l_returnflag) IN ('a', 'n') THEN 3 ELSE 0 END), 4) AS flag,
  coalesce(min(CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_quantity BETWEEN 1 AND 45 THEN 3 ELSE 0 END), 4) AS qty,
  coalesce(min(CASE WHEN l_orderkey IS NULL THEN NULL WHEN o_orderpriority <> '1-URGENT' THEN 5 WHEN l_linestatus = 'O' THEN 3 ELSE 0 END), 4) AS lane,
  coalesce(min(CASE WHEN l_orderkey IS NOT NULL THEN 3 END), 4) AS open0, coalesce(min(CASE WHEN l_orderkey IS NOT NULL THEN 1 END), 4) AS gone,
  coalesce(bool_or(l_shipdate >= o_orderdate AND l_shipdate <= TIMESTAMP '1999-01-01' AND l_shipdate <= o_orderdate + INTERVAL 31536000 SECOND), false) AS ontime,
  coalesce(bool_or(l_shipdate >= o_orderdate AND l_shipdate <= TIMESTAMP '1999-01-01'), false) AS counted, coalesce(bool_or(l_shipdate < o_orderdate), false) AS early,
  TIMESTAMP '1999-01-01' <= min(o_orderdate + INTERVAL 31536000 SECOND) AS waiting,
  coalesce(min(CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_quantity >= 40 THEN 3 ELSE 0 END), 4) AS ea
  FROM j GROUP BY o_orderkey),
c AS (SELECT item, n, CASE WHEN n > 0 THEN 3 ELSE 0 END AS shipped, CASE WHEN n BETWEEN 1 AND 4 THEN 3 ELSE 0 END AS few, flag, qty, lane, CASE WHEN st IN ('O', 'P') THEN open0 ELSE 5 END AS open, gone,
  CASE WHEN ontime THEN 3 WHEN early AND NOT counted THEN 1 WHEN waiting THEN 2 ELSE 0 END AS late,
  CASE WHEN ea = 3 OR n >= 6 THEN 3 ELSE 0 END AS either FROM g),
i AS (SELECT *, CASE WHEN least(shipped, few, qty, lane, open) = 3 AND (qty = 4 OR lane = 4 OR open = 4) THEN 1 ELSE least(shipped, few, qty, lane, open) END AS w FROM c),
names AS (SELECT ['VIOLATED', 'INCONCLUSIVE', 'PENDING', 'VERIFIED', 'NOT_EVALUATED', 'NOT_APPLICABLE'] AS s),
u AS (SELECT item, unnest(['shipped', 'few', 'flag', 'qty', 'lane', 'open', 'gone', 'late', 'either']) AS condition, unnest([shipped, few, flag, qty, lane, open, gone, late, either]) AS r FROM c)
"""


def _outcome(spark, d):
    s = outcome.record(spark.read.parquet(f"{d}/orders.parquet"), ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])
    t = outcome.record(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_returnflag", "l_quantity", "l_linestatus", "l_shipdate"])
    return outcome.evaluate(CONTRACT, s, t)


@query(OUTCOME + "SELECT item, n AS matched, s[w + 1] AS status FROM i, names", ev=False)
def outcome_items(spark, d):
    return _outcome(spark, d)["items"]


@query(OUTCOME + "SELECT item, condition, s[r + 1] AS status FROM u, names", ev=False)
def outcome_conditions(spark, d):
    return _outcome(spark, d)["conditions"]


@query(OUTCOME + "SELECT condition, s[r + 1] AS status, count(*) AS n FROM u, names GROUP BY ALL", ev=False)
def outcome_summary(spark, d):
    return _outcome(spark, d)["summary"]


@query(OUTCOME + "SELECT count(*) AS n_items, any_value(s)[min(w) + 1] AS outcome FROM i, names", ev=False)
def outcome_global(spark, d):
    return _outcome(spark, d)["outcome"]


# --- readers and runner: the derived events written as logs of each format, parsed, detected and run ---


def _logs(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """One log a session in ``fmt``, as the file table (path, length, content) that the readers take."""
    e = ev(spark, d).withColumn("at", F.date_format(F.expr("timestampadd(MILLISECOND, ts_ms, timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    kind, c = F.col("kind"), F.col
    pick = lambda **by: F.coalesce(*[F.when(kind == k, F.lit(v) if isinstance(v, str) else v) for k, v in by.items()])
    if fmt == "canonical":
        payload = F.struct(c("payload_hash").alias("p"), c("ckpt_seq").alias("checkpoint_seq"), "state_hash")
        line = F.to_json(F.struct("id", "parent_id", c("idx").alias("seq"), c("at").alias("ts"), "actor", "kind", payload.alias("payload"), c("corr").alias("correlation_id"), "branch_id"))
        head, tail, name, sep = F.concat(F.lit('{"schema_version":"any.session/v1","created_at":"2025-01-01T00:00:00Z","session_id":"'), "session", F.lit('"}\n')), F.lit("\n"), F.concat("session", F.lit(".jsonl")), "\n"
    elif fmt == "claude-code-jsonl":
        use = F.struct(F.lit("tool_use").alias("type"), c("corr").alias("id"), F.lit("Read").alias("name"), F.struct(c("payload_hash").alias("p")).alias("input"))
        result = F.struct(F.lit("tool_result").alias("type"), c("corr").alias("tool_use_id"), c("payload_hash").alias("content"))
        rest = F.struct(F.lit("text").alias("type"), c("payload_hash").alias("text"))
        content = F.when(kind == "tool_call", F.to_json(F.array(use))).when(kind == "tool_result", F.to_json(F.array(result))).otherwise(F.to_json(F.array(rest)))
        what = pick(tool_call="assistant", tool_result="user", message="user", checkpoint="attachment", compaction_boundary="summary")
        plain = F.to_json(F.struct(c("id").alias("uuid"), c("parent_id").alias("parentUuid"), what.alias("type"), c("at").alias("timestamp"), c("session").alias("sessionId"), c("branch_id").alias("branchId"), F.lit("2.0.30").alias("version")))
        line = F.concat(F.expr("left(plain, length(plain) - 1)"), F.lit(',"message":{"content":'), "content", F.lit("}}"))
        e = e.withColumns({"plain": plain, "content": content})
        head, tail, name, sep = F.lit(""), F.lit("\n"), F.concat("session", F.lit(".jsonl")), "\n"
    elif fmt == "codex-rollout":
        what = pick(tool_call="response_item", tool_result="response_item", message="response_item", checkpoint="event_msg", compaction_boundary="compacted")
        item = pick(tool_call="function_call", tool_result="function_call_output", message="message")
        payload = F.struct("id", item.alias("type"), F.when(kind == "message", "user").alias("role"), c("corr").alias("call_id"), c("payload_hash").alias("output"))
        line = F.to_json(F.struct(c("idx").alias("ordinal"), what.alias("type"), c("at").alias("timestamp"), payload.alias("payload")))
        head, tail, name, sep = F.lit(""), F.lit("\n"), F.concat(F.lit("rollout-"), "session", F.lit(".jsonl")), "\n"
    else:
        what = pick(compaction_boundary="compaction", message="message", tool_call="tool_call", tool_result="tool_result", checkpoint="checkpoint")
        line = F.to_json(F.struct("id", c("parent_id").alias("prev_id"), what.alias("type"), F.when(kind == "message", "user").alias("role"), c("corr").alias("call_id"), c("payload_hash").alias("content"), c("ckpt_seq").alias("seq"), c("state_hash").alias("hash"), c("at").alias("timestamp")))
        head, tail, name, sep = F.lit('{"run_state":{},"items":['), F.lit("]}"), F.concat("session", F.lit(".json")), ","
    body = e.select("session", "idx", line.alias("line")).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), sep).alias("body"))
    text = body.select(F.concat(F.lit("/logs/"), name).alias("path"), F.concat(head, "body", tail).cast("binary").alias("content"))
    return text.select("path", F.octet_length("content").cast("long").alias("length"), "content")


#: What the four logs of the same events have in common, by code; a rollout chains its records and asks no correlator of a result.
RUN_CODES = {
    "SL004": "sl004_missing_parent", "SL101": "sl101_orphan_results", "SL102": "sl102_dangling_calls", "SL103": "sl103_reused_calls", "SL104": "sl104_multiple_results",
    "SL105": "sl105_reversed", "SL106": "sl106_cross_branch", "SL108": "sl108_compaction_split", "SL201": "sl201_checkpoint_gaps", "SL202": "sl202_divergence", "SL203": "sl203_unsafe_continuation",
}
NO_CHECKPOINTS = [c for c in RUN_CODES if not c.startswith("SL2")]
CHAINED = [c for c in NO_CHECKPOINTS if c not in ("SL004", "SL106")]


def _run(spark: SparkSession, d: str, fmt: str, codes: list[str]) -> dict[str, DataFrame]:
    return runner.run(files.split(graph.cut(files.read_sessions(_logs(spark, d, fmt)))), runner.NEUTRAL.select(codes))


def _session(column: str = "session"):
    return F.regexp_extract(column, r"([0-9]+)\.jsonl?$", 1).alias("session")


def _run_sql(codes: list[str], where: dict[str, str] | None = None) -> str:
    def nested(name: str) -> str:
        body = _plain(name)
        return f"(WITH RECURSIVE {body.lstrip(', ')})" if body.startswith(",") else f"({body})"

    return " UNION ALL ".join(f"SELECT session, '{c}' AS code, count(*) AS n FROM {nested(RUN_CODES[c])} {(where or {}).get(c, '')} GROUP BY session" for c in codes)


def _counted(got: dict[str, DataFrame]) -> DataFrame:
    return got["findings"].select(_session(), "code").groupBy("session", "code").agg(F.count(F.lit(1)).alias("n"))


@query(_run_sql(list(RUN_CODES)))
def runner_canonical(spark, d):
    return _counted(_run(spark, d, "canonical", list(RUN_CODES)))


@query(_run_sql(NO_CHECKPOINTS))
def runner_chat(spark, d):
    return _counted(_run(spark, d, "claude-code-jsonl", list(RUN_CODES)))


@query(_run_sql(CHAINED, {"SL101": "WHERE corr IS NOT NULL"}))
def runner_rollout(spark, d):
    return _counted(_run(spark, d, "codex-rollout", list(RUN_CODES)))


@query(_run_sql([c for c in RUN_CODES if c != "SL106"]))
def runner_agents(spark, d):
    return _counted(_run(spark, d, "openai-agents", [c for c in RUN_CODES if c != "SL106"]))


@query(f""", fd AS ({_run_sql(list(RUN_CODES))})
SELECT s.session, CASE WHEN coalesce(sum(n) FILTER (code <> 'SL108'), 0) > 0 THEN 'invalid' ELSE 'healthy' END AS verdict, CAST(coalesce(sum(n) FILTER (code <> 'SL108'), 0) AS BIGINT) AS errors,
  CAST(coalesce(sum(n) FILTER (code = 'SL108'), 0) AS BIGINT) AS warnings FROM (SELECT DISTINCT session FROM ev) s LEFT JOIN fd ON fd.session = s.session GROUP BY s.session""")
def runner_verdicts(spark, d):
    return _run(spark, d, "canonical", list(RUN_CODES))["verdicts"].select(_session(), "verdict", "errors", "warnings")


@query(f"SELECT code, CASE WHEN code IN ({', '.join(repr(c) for c in RUN_CODES)}) THEN 'performed' ELSE 'disabled' END AS state, (SELECT count(DISTINCT session) FROM ev) AS n FROM (SELECT unnest([{', '.join(repr(c) for c, *_ in CODES)}]) AS code)")
def runner_coverage(spark, d):
    return _run(spark, d, "canonical", list(RUN_CODES))["coverage"].groupBy("code", "state").agg(F.count(F.lit(1)).alias("n"))
