"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero code of RADIUS + 1 bits; table v keeps the
positions whose code is orthogonal to v over GF(2). Two fingerprints that
differ in at most RADIUS positions leave, over all v, at least one non-zero v
orthogonal to all those codes, so they agree on some table's whole mask: no
pair within the radius is missed. A bucket of more than BUCKET fingerprints is
parted by a covering family over the positions that its mask leaves out, with
the same guarantee inside it, again and again: four levels leave at most seven
positions open, so no bucket stays larger than 128 and pairs are only formed
inside such buckets. Fingerprints, not rows, are linked; rows take the component
of their fingerprint. Components come from alternating large-star and
small-star steps over checkpointed edges.

Defined cases: null and empty texts, and texts without words, have fingerprint
zero and are linked like any other; texts of fewer words than a shingle are one
shingle; ties (exactly half the hashes) leave a bit 0; repeated rows share a
fingerprint; a null id is kept out of the smallest id unless alone; an empty
table gives an empty result; extra columns are ignored, whatever their names; a
very long text is read PIECE bytes at a time (a single word is held whole).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER_ASCII, cut, rows, table, texts, word_pieces

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a bucket that are compared pair by pair; more are parted first.
BUCKET = 128


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Words are runs of bytes other than ASCII white space, with A-Z lowered."""
    counts, n, held = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in word_pieces(text):
        w = held + piece.translate(LOWER_ASCII).split()
        if len(w) >= shingle:
            hashes = np.array([digest(b" ".join(s), seed) for s in zip(*(w[k:] for k in range(shingle)), strict=False)], np.uint64)
            bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(0, dtype=np.int64)
            n += len(hashes)
            held = w[len(w) - shingle + 1 :]
        else:
            held = w
    if not n:
        return digest(b" ".join(held), seed) if held else 0
    return int("".join("1" if 2 * c > n else "0" for c in counts.tolist()), 2)


def masks(radius: int = RADIUS, taken: int = 0) -> list[int]:
    """The 2**(radius + 1) - 1 bit masks of the covering family over the positions that are not in ``taken``, each with ``taken``."""
    free = [k for k in range(64) if not taken >> k & 1]
    codes = [1 + k % ((1 << radius + 1) - 1) for k in range(len(free))]
    return [taken | sum(1 << k for k, c in zip(free, codes, strict=True) if (c & v).bit_count() % 2 == 0) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: the fingerprint as a signed long."""

    def run(batches):
        for whole in batches:
            for batch in rows(whole, name="t"):
                fp = [_signed(fingerprint(x)) for x in texts(batch, "t")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` id", f"cast(`{text_col}` as string) t").mapInArrow(run, f"id {kind}, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs a < b of distinct fingerprints within ``radius`` differing bits, each once."""
    spark = distinct.sparkSession
    masked = [0]
    members = distinct.select("fp")
    found = None
    while members is not None:
        # A table of (2**(radius + 1) - 1)**level masks, whatever the data.
        parted = {m: masks(radius, m) for m in masked}
        masked = sorted({x for own in parted.values() for x in own})
        if found is None:
            each = members.select("fp", F.explode(F.array(*[F.lit(_signed(x)).cast("long") for x in masked])).alias("mask"))
        else:
            family = F.broadcast(spark.createDataFrame([(_signed(m), [_signed(x) for x in own]) for m, own in parted.items()], "mask long, inner array<long>"))
            each = members.join(family, "mask").select("fp", F.explode("inner").alias("mask"))
        tagged = each.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        # A bucket of one can't link: counted first, combined map-side.
        sizes = cut(tagged.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        all_fit = 1 << max(64 - m.bit_count() for m in masked) <= bucket
        few = sizes if all_fit else sizes.where(F.col("n") <= bucket)
        left = tagged.join(few, ["mask", "key"], "left_semi")
        pairs = left.select("mask", "key", F.col("fp").alias("a")).join(left.select("mask", "key", F.col("fp").alias("b")), ["mask", "key"])
        near = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
        found = near if found is None else found.unionByName(near)
        crowded = None if all_fit else sizes.where(F.col("n") > bucket)
        members = None
        if crowded is not None and not crowded.isEmpty():
            members = cut(tagged.join(crowded.select("mask", "key"), ["mask", "key"], "left_semi").select("fp", "mask").distinct())
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star then small-star until the edges stop changing; each round is cut
    by a checkpoint, and only counts and hash sums reach the driver. The least
    neighbours come to the edges by broadcast while those are few; beyond that
    they are cut, so that the join can split the many edges of one star.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == seen or not state.n:
            break
        seen = (state.n, state.s)
        # There are two ends to an edge at most.
        dealt = F.broadcast if 2 * state.n <= BROADCAST_ROWS else cut
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = dealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select("u", "v", "m")
        e = cut(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fp (signed long), component_id: the smallest id reachable over linked fingerprints."""
    marked = cut(fingerprints(docs, id_col, text_col))
    groups = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(groups.select("fp"), radius))
    # Few fingerprints are linked; the others are their own component.
    grouped = groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    class_of = grouped.join(smallest, "root").select("fp", "component_id")
    return marked.join(class_of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
