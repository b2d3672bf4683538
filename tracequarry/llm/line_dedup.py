"""Cross-site boilerplate lines, DataFrame operations only.

A line (trimmed of spaces, of any length) is boilerplate when it stands on at
least ``min_sites`` different sites. Each line hash has a HyperLogLog sketch of
its sites, begun where the lines are read and merged by the aggregation, so a
line that is everywhere sends one sketch a task. Lines whose estimate is near
the threshold get an exact distinct count before anything is removed.

Defined cases: a null text is empty, a null site is the site ''; blank lines
are never boilerplate; a document all of whose non-blank lines are boilerplate
keeps its text, so no document is emptied; repeated rows are each treated
alike, and add no site; an empty table gives an empty result; extra columns are
passed through, whatever their names, but for those named like the two counts,
which give way to them. Lines are handled as hashes, so a very long line or
text costs no more than reading it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table, text_of

MIN_SITES = 5
#: Estimates within this share of the threshold are counted exactly.
MARGIN = 0.3
LG_K = 10


def _lines(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """i, th (a row's key), site, pos, k, k2 (two 64-bit hashes) of every line that is not blank."""
    own, body = F.col("row").getField, F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    split = docs.select("i", "th", F.coalesce(own(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(body, "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    return split.where(F.length(line) > 0).select("i", "th", "site", "pos", F.xxhash64(line).alias("k"), F.xxhash64(F.concat(F.lit("\x01"), line)).alias("k2"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns, so that no name can clash), and i and th, hashes of id and text: 128 bits that stand for the row in joins."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{id_col}`")).alias("i"), F.xxhash64(text_of(f"`{text_col}`")).alias("th"))


def _spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """k, k2 of the lines on ``min_sites`` sites or more."""
    sites = F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K))
    spread = cut(lines.groupBy("k", "k2").agg(sites.alias("sites")).where(F.col("sites") >= min_sites * (1 - MARGIN)))
    sure = spread.where(F.col("sites") > min_sites * (1 + MARGIN)).select("k", "k2")
    near = spread.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("k", "k2")
    exact = lines.select("k", "k2", "site").join(small(near), ["k", "k2"], "left_semi").distinct().groupBy("k", "k2").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("k", "k2"))


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Hash pairs (k, k2) of the lines that stand on ``min_sites`` sites or more."""
    return _spread(_lines(_rows(docs, text_col, text_col), text_col, site_col), min_sites)


def drop_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, counts: tuple[str, str] | None = ("_n_lines", "_n_removed")
) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text, and the numbers of lines and of removed ones unless ``counts`` is None."""
    keyed = _rows(docs, id_col, text_col)
    lines = _lines(keyed, text_col, site_col)
    # Cut before each join: it then has plain exchanges on both sides, and a very common line or row can be split.
    bad = cut(_spread(lines, min_sites))
    # Positions are bounded by the document's own lines; the text itself is exchanged once, with its row.
    hits = cut(lines.join(small(bad), ["k", "k2"]).groupBy("i", "th").agg(F.collect_set("pos").alias("hit")))
    joined = keyed.join(hits, ["i", "th"], "left").select("row", "hit")
    body = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    parts = F.split(body, "\n")
    full = F.size(F.filter(parts, lambda x: F.length(F.trim(x)) > 0)) == F.size("hit")
    take = F.col("hit").isNotNull() & ~full
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("hit"), i)), "\n")
    same = [c for c in docs.columns if c not in (counts or ())]
    out = [(F.when(take, kept).otherwise(F.col("row").getField(c)) if c == text_col else F.col("row").getField(c)).alias(c) for c in same]
    if counts:
        out += [F.size(parts).cast("long").alias(counts[0]), F.when(take, F.size("hit")).otherwise(0).cast("long").alias(counts[1])]
    return joined.select(*out)


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining text) for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs, counts=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", F.sha2(text_of(), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, u.line AS line, u.pos AS pos
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u),
bad AS (
  SELECT trim(line) AS t FROM l WHERE length(trim(line)) > 0
  GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT l.*, bad.t IS NOT NULL AS hit FROM l LEFT JOIN bad ON trim(l.line) = bad.t),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit, count(*) FILTER (length(trim(line)) > 0) AS n_full,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS kept, string_agg(line, chr(10) ORDER BY pos) AS whole
  FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, CASE WHEN n_hit = n_full THEN 0 ELSE n_hit END AS n_removed,
       sha256(CASE WHEN n_hit = n_full THEN whole ELSE kept END) AS kept_sha256
FROM d
"""
