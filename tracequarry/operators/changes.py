"""Differences between two logs, repairs of one, and the seal ledger."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import RESULT


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Deltas between two versions of each session: removed, added, kind-changed, parent-relinked, content-changed, seq-reordered.

    Rows pair by id, duplicates earliest first; the rest by kind, parent and
    content. A pair is reordered when an earlier pair stands later in ``b``; the
    running maximum is never raised by a pair that falls behind it.
    """
    cols = ["kind", "parent_id", "content_hash"]

    def ranked(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
        w = W.partitionBy("session", *keys).orderBy("idx")
        return df.select("session", "id", *[F.col(c).alias(f"{c}_{side}") for c in cols], F.col("idx").alias(f"idx_{side}"), F.row_number().over(w).alias("rn"))

    first = ranked(a, "a", ["id"]).join(ranked(b, "b", ["id"]), ["session", "id", "rn"], "full").drop("rn")
    pairs = first.where("idx_a is not null and idx_b is not null")
    left = first.where("idx_b is null").select("session", "id", *[F.col(f"{c}_a").alias(c) for c in cols], F.col("idx_a").alias("idx"))
    right = first.where("idx_a is null").select("session", "id", *[F.col(f"{c}_b").alias(c) for c in cols], F.col("idx_b").alias("idx"))
    # Null-safe second pass: nulls take a value of their own.
    fill = {"kind": "\0", "parent_id": "\0", "content_hash": "\0"}
    w2 = W.partitionBy("session", *cols).orderBy("idx")
    la = left.fillna(fill).withColumn("rn", F.row_number().over(w2)).select("session", *cols, "rn", F.col("id").alias("id_a"), F.col("idx").alias("idx_a"))
    rb = right.fillna(fill).withColumn("rn", F.row_number().over(w2)).select("session", *cols, "rn", F.col("id").alias("id_b"), F.col("idx").alias("idx_b"))
    second = la.join(rb, ["session", *cols, "rn"], "full")
    gone = second.where("idx_b is null").select("session", F.lit("removed").alias("delta"), F.col("id_a").alias("id"), F.col("idx_a").alias("idx"))
    new = second.where("idx_a is null").select("session", F.lit("added").alias("delta"), F.col("id_b").alias("id"), F.col("idx_b").alias("idx"))
    changed = F.array_compact(
        F.array(
            F.when(~F.col("kind_a").eqNullSafe(F.col("kind_b")), F.lit("kind-changed")),
            F.when(~F.col("parent_id_a").eqNullSafe(F.col("parent_id_b")), F.lit("parent-relinked")),
            F.when(~F.col("content_hash_a").eqNullSafe(F.col("content_hash_b")), F.lit("content-changed")),
        )
    )
    altered = pairs.select("session", F.explode(changed).alias("delta"), "id", F.col("idx_a").alias("idx"))
    both = pairs.select("session", "id", "idx_a", "idx_b").unionByName(second.where("idx_a is not null and idx_b is not null").select("session", F.col("id_a").alias("id"), "idx_a", "idx_b"))
    upto = W.partitionBy("session").orderBy("idx_a").rowsBetween(W.unboundedPreceding, -1)
    moved = both.withColumn("top", F.max("idx_b").over(upto)).where("top > idx_b").select("session", F.lit("seq-reordered").alias("delta"), "id", F.col("idx_a").alias("idx"))
    return gone.unionByName(new).unionByName(altered).unionByName(moved)


# --- repairs: each takes events and returns them rewritten; nothing else is touched ---


def discard_suffix(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """Keep what stands before the cut (session, cut), unless a checkpoint stands in the suffix: such sessions stay whole."""
    j = events.join(cuts, "session", "left")
    blocked = j.where("kind = 'checkpoint' and idx >= cut").select("session").distinct().withColumn("blocked", F.lit(True))
    return j.join(blocked, "session", "left").where("cut is null or blocked or idx < cut").drop("cut", "blocked")


def collapse_adjacent(events: DataFrame, content: list[str]) -> DataFrame:
    """R2: of two neighbours with equal id and content the second goes."""
    w = W.partitionBy("session").orderBy("idx")
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in ("id", *content)]
    first = F.lag(F.lit(1)).over(w).isNull()
    flags = events.select("*", *[s.alias(f"_s{k}") for k, s in enumerate(same)], first.alias("_first"))
    twin = ~F.col("_first")
    for k in range(len(same)):
        twin = twin & F.col(f"_s{k}")
    return flags.where(~twin).drop("_first", *[f"_s{k}" for k in range(len(same))])


def restore_parents(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Where exactly one candidate (session, id, candidate) is left for a missing parent, it becomes the parent."""
    one = candidates.groupBy("session", "id").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("candidate")).where("n = 1").drop("n")
    return events.join(one, ["session", "id"], "left").withColumn("parent_id", F.coalesce("candidate", "parent_id")).drop("candidate")


def reunite(events: DataFrame, splits: DataFrame) -> DataFrame:
    """A boundary alone between a clean pair (session, boundary_index, result_index) moves to just behind the pair."""
    to = splits.groupBy("session", F.col("boundary_index").alias("idx")).agg(F.max("result_index").alias("behind"))
    moved = events.join(to, ["session", "idx"], "left")
    w = W.partitionBy("session").orderBy(F.coalesce(F.col("behind") + 0.5, F.col("idx").cast("double")), "idx")
    return moved.withColumn("_n", F.row_number().over(w) - 1).withColumn("idx", F.col("_n").cast("long")).drop("_n", "behind")


def keep_first(events: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """Of the rows that ``where`` takes, the first of each key stays; the others are untouched."""
    hit = F.coalesce(where, F.lit(False))
    w = W.partitionBy("session", *keys).orderBy("idx")
    kept = events.where(hit).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return events.where(~hit).unionByName(kept)


def drop_extra_results(events: DataFrame) -> DataFrame:
    """Equal further results of a call go."""
    return keep_first(events, ["corr", "payload_hash"], F.col("kind").isin(*RESULT) & F.col("corr").isNotNull())


def drop_duplicates(events: DataFrame, id_col: str, content: list[str]) -> DataFrame:
    """Of identical rows of an id the first stays."""
    return keep_first(events, [id_col, *content], F.length(F.trim(F.col(id_col))) > 0)


def renumber(events: DataFrame) -> DataFrame:
    """Seq is the position."""
    return events.withColumn("seq", (F.row_number().over(W.partitionBy("session").orderBy("idx")) - 1).cast("long"))


def amputate(events: DataFrame, components: DataFrame, condemned: DataFrame, most: int = 10_000) -> DataFrame:
    """Drop condemned components (session, component) of at most ``most`` records, without a checkpoint, that aren't the whole session."""
    placed = events.select("session", "id", "kind").join(components, ["session", "id"]).join(condemned.distinct(), ["session", "component"])
    sizes = placed.groupBy("session", "component").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") == "checkpoint").alias("check"))
    whole = events.groupBy("session").agg(F.count(F.lit(1)).alias("total"))
    ok = sizes.join(whole, "session").where((F.col("n") <= most) & ~F.col("check") & (F.col("n") < F.col("total"))).select("session", "component")
    return events.join(components.join(ok, ["session", "component"]).select("session", "id"), ["session", "id"], "left_anti")


def drop_rows(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows named by (session, idx) go; one that another event hangs on stays (R13's refusal)."""
    named = events.join(rows.select("session", "idx").distinct(), ["session", "idx"])
    held = events.select("session", F.col("parent_id").alias("id")).where("id is not null").distinct()
    free = named.join(held, ["session", "id"], "left_anti").select("session", "idx")
    return events.join(free, ["session", "idx"], "left_anti")


def equivalent(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Sessions whose rows differ as multisets of (idx, columns): an exact comparison both ways."""
    x, y = a.select("session", "idx", *columns), b.select("session", "idx", *columns)
    return x.exceptAll(y).select("session").union(y.exceptAll(x).select("session")).distinct()


# --- seal ledger ---

#: What the first entry of a ledger is bound to.
GENESIS = "0" * 64


def entry_hash(prev: Column, seq: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, seq.cast("string"), body), 256)


def seal(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """A ledger (ledger, line, body) sealed as a chain: each entry's hash covers the one before, its number and the hash of its body.

    A chain is made one entry after the other, so a ledger is read in order by
    one task, which holds a hash and no more. ``heads`` (ledger, seq,
    entry_sha256) are the last entries of ledgers that are carried on.
    """
    kind = rows.schema["ledger"].dataType.simpleString()
    keyed = rows.select("ledger", "line", "body", F.sha2(F.col("body"), 256).alias("body_sha256"))
    if heads is not None:
        keyed = keyed.join(heads.select("ledger", F.col("seq").alias("from_seq"), F.col("entry_sha256").alias("from_sha256")), "ledger", "left")
    else:
        keyed = keyed.withColumns({"from_seq": F.lit(None).cast("long"), "from_sha256": F.lit(None).cast("string")})

    def run(batches):
        at, seq, prev = object(), 0, GENESIS
        for batch in batches:
            seqs, prevs, entries = [], [], []
            for ledger, body, start, head in zip(*(batch.column(c).to_pylist() for c in ("ledger", "body_sha256", "from_seq", "from_sha256")), strict=True):
                if ledger != at:
                    at, seq, prev = ledger, start or 0, head or GENESIS
                seq += 1
                entry = hashlib.sha256(f"{prev}|{seq}|{body or ''}".encode()).hexdigest()
                seqs.append(seq)
                prevs.append(prev)
                entries.append(entry)
                prev = entry
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(entries, pa.string())], ["ledger", "line", "body", "body_sha256", "seq", "prev_sha256", "entry_sha256"])

    dealt = keyed.select("ledger", F.col("line").cast("long").alias("line"), "body", "body_sha256", "from_seq", "from_sha256").repartition("ledger").sortWithinPartitions("ledger", "line")
    return dealt.mapInArrow(run, f"ledger {kind}, line long, body string, body_sha256 string, seq long, prev_sha256 string, entry_sha256 string")


def verify_seal(entries: DataFrame) -> DataFrame:
    """The first divergence of each ledger, by line: malformed-line, bad-schema, seq-gap, chain-break or hash-mismatch.

    An entry is bound to the hash of the one before, so each is checked with its
    neighbour alone, and a change anywhere shows at the next entry.
    """
    w = W.partitionBy("ledger").orderBy("line")
    seen = entries.select("*", F.lag("seq").over(w).alias("_seq"), F.lag("entry_sha256").over(w).alias("_entry"), F.row_number().over(w).alias("_n"))
    body = F.sha2(F.col("body"), 256) if "body" in entries.columns else F.col("body_sha256")
    kind = (
        F.when(F.col("seq").isNull() & F.col("body_sha256").isNull(), "malformed-line")
        .when(F.col("seq").isNull() | F.col("body_sha256").isNull() | F.col("entry_sha256").isNull() | F.col("prev_sha256").isNull(), "bad-schema")
        .when(F.col("seq") != F.when(F.col("_n") == 1, F.lit(1)).otherwise(F.col("_seq") + 1), "seq-gap")
        .when(F.col("prev_sha256") != F.when(F.col("_n") == 1, F.lit(GENESIS)).otherwise(F.coalesce("_entry", F.lit(""))), "chain-break")
        .when((F.coalesce(body, F.lit("")) != F.coalesce("body_sha256", F.lit(""))) | (entry_hash(F.col("prev_sha256"), F.col("seq"), F.coalesce("body_sha256", F.lit(""))) != F.col("entry_sha256")), "hash-mismatch")
    )
    bad = seen.withColumn("kind", kind).where("kind is not null")
    return bad.groupBy("ledger").agg(F.min(F.struct("line", "kind")).alias("m")).select("ledger", F.col("m.line").alias("line"), F.col("m.kind").alias("kind"))
