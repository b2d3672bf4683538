"""Histogram-sort sharding, DataFrame operations only.

Rows are ordered by the key (xxhash64 of the text, xxhash64 of the id, hash of
the row's position in the checkpointed table). Equal texts are neighbours in
that order, so a group of copies stays together as far as equal shard sizes
allow; a group larger than a shard is split by the hash of its ids, and rows
that repeat, null ids among them, by their positions. Such rows look the same,
so the result does not depend on which of them comes first. Splitters are found
by counting the exact bytes below candidate boundaries: every round divides the
key cells that still hold an unresolved splitter into ``2**BITS`` smaller cells
and counts again, until each boundary is within the tolerance of its target or
cannot be refined. Only then are the rows exchanged, once, for the numbering
inside the parts.

Defined cases: a null text has no bytes (size 8, crc 0) and sorts as the empty
text; a null id is an ordinary key value; repeated rows all get their own slot;
an empty table gives an empty result; extra columns are ignored, whatever their
names; of a long text only hashes and the length travel.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, text_of

#: A round divides a cell into 2**BITS cells; LEVELS rounds use up each of the three 64-bit words of the key (the last bits left aside).
BITS, LEVELS, WORDS = 6, 10, ("h", "h2", "h3")
OVERHEAD = 8
#: Rows of the table that maps the first bits of a key to its part, and parts that the driver finds splitters for.
LOOKUP_BITS, MAX_PARTS = 10, 8192


def _cell(level: int):
    """Digit number ``level`` of the key, most significant first."""
    return F.shiftrightunsigned(F.col(WORDS[level // LEVELS]), 64 - BITS * (level % LEVELS + 1)).bitwiseAND((1 << BITS) - 1)


def _prefix(levels: int):
    return F.concat_ws(".", *[_cell(k).cast("string") for k in range(levels)])


def splitters(keyed: DataFrame, targets: list[int], tolerance: int) -> list[tuple[int, ...]]:
    """For each byte target the cell path whose start is the boundary, by refined probes over the columns h, h2, h3, size.

    What comes to the driver is bounded by the number of probes, at most
    ``len(targets) * 2**BITS`` counts a round, whatever the table holds.
    """
    found: dict[int, tuple[int, ...]] = {}
    deepest = len(WORDS) * LEVELS - 1
    open_cells: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(len(targets))))}
    for level in range(deepest + 1):
        if not open_cells:
            break
        probe = keyed
        if level:
            probe = keyed.where(_prefix(level).isin([".".join(map(str, c)) for c in open_cells]))
        counted: dict[tuple[int, ...], dict[int, tuple[int, int]]] = {}
        by = probe.groupBy((_prefix(level) if level else F.lit("")).alias("cell"), _cell(level).alias("digit"))
        for r in by.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
            path = tuple(map(int, r.cell.split("."))) if r.cell else ()
            counted.setdefault(path, {})[r.digit] = (r.bytes, r.n)
        deeper: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for path, (below, waiting) in open_cells.items():
            inner = counted.get(path, {})
            digits = sorted(inner)
            starts = [below]
            for d in digits:
                starts.append(starts[-1] + inner[d][0])
            for j in waiting:
                k = min(max(bisect_left(starts, targets[j]) - 1, 0), len(digits) - 1)
                d = digits[k]
                left, right = targets[j] - starts[k], starts[k + 1] - targets[j]
                if min(left, right) <= tolerance or inner[d][1] == 1 or level == deepest:
                    found[j] = (*path, d) if left <= right else (*path, d + 1)
                else:
                    deeper.setdefault((*path, d), (starts[k], []))[1].append(j)
        open_cells = deeper
    return [found[j] for j in range(len(targets))]


def _unsigned(path: tuple[int, ...]) -> tuple[int, ...]:
    """The start of a cell as unsigned words (h, h2, h3); a digit of 2**BITS carries over, beyond the last cell to the greatest key."""
    value = 0
    for k in range(len(WORDS) * LEVELS):
        value = (value << BITS) + (path[k] if k < len(path) else 0)
    out = []
    for _ in WORDS:
        out.append((value & ((1 << BITS * LEVELS) - 1)) << (64 - BITS * LEVELS))
        value >>= BITS * LEVELS
    return ((1 << 64) - 1,) * len(WORDS) if value else tuple(reversed(out))


def histogram_shards(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 64 << 20, tolerance: float = 0.0005
) -> DataFrame:
    """Shard and slot of every row, law ``bytes``: id, size, text_crc32, shard, slot.

    Each shard is built from parts of about ``part_bytes`` of text, more where
    there would be over MAX_PARTS of them, each numbered by a task of its own
    from rows of a few numbers. ``tolerance`` is the accepted error of a
    boundary as a share of a part.
    """
    text, own = text_of(f"`{text_col}`"), F.col(f"`{id_col}`")
    # The positions are fixed by the checkpoint: a task that is run again reads them there.
    keyed = cut(
        docs.select(
            own.alias("id"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(own).alias("h2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("h3"),
        )
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    grain = max(1, min(MAX_PARTS // n_shards, -(-total // (n_shards * part_bytes))))
    parts = n_shards * grain
    targets = [total * j // parts for j in range(1, parts)]
    bounds = sorted(map(_unsigned, splitters(keyed, targets, int(total / parts * tolerance)))) if total else []
    # Rows find their part by the first bits of the key (a table of 2**LOOKUP_BITS rows) and by the few boundaries inside that cell.
    cells: dict[int, list[tuple[int, ...]]] = {}
    for b in bounds:
        cells.setdefault(b[0] >> (64 - LOOKUP_BITS), []).append(b)
    base, lookup = 0, []
    for d in range(1 << LOOKUP_BITS):
        inside = cells.get(d, [])
        lookup.append((d, base, [tuple(map(_flip, b)) for b in inside]))
        base += len(inside)
    spark = docs.sparkSession
    cell_table = spark.createDataFrame(lookup, "digit int, base int, inside array<struct<b:long,b2:long,b3:long>>")
    sign, used = F.lit(-(1 << 63)).cast("long"), F.lit(-(1 << (64 - BITS * LEVELS))).cast("long")
    # Only the bits that boundaries are made of, as the counts below them had it.
    ordered = keyed.select("id", "size", "text_crc32", *[F.col(w).bitwiseAND(used).bitwiseXOR(sign).alias(k) for w, k in zip(WORDS, ("k", "k2", "k3"), strict=True)], F.shiftrightunsigned("h", 64 - LOOKUP_BITS).cast("int").alias("digit"))
    passed = F.size(F.filter("inside", lambda b: b <= F.struct(F.col("k").alias("b"), F.col("k2").alias("b2"), F.col("k3").alias("b3"))))
    placed = ordered.join(F.broadcast(cell_table), "digit").select("id", "size", "text_crc32", "k", "k2", "k3", (F.col("base") + passed).alias("part"))
    counts = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
    offsets, at = [], 0
    for p in range(parts):
        at = 0 if p % grain == 0 else at
        offsets.append((p, at))
        at += counts.get(p, 0)
    first = F.broadcast(spark.createDataFrame(offsets, "part int, first long"))
    within = W.partitionBy("part").orderBy("k", "k2", "k3")
    numbered = placed.withColumn("rank", F.row_number().over(within)).join(first, "part")
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.expr(f"cast(part div {grain} as int)").alias("shard"),
        (F.col("first") + F.col("rank") - 1).alias("slot"),
    )


def _flip(x: int) -> int:
    """An unsigned 64-bit value as the signed one of the same rank."""
    return x - (1 << 63)


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
