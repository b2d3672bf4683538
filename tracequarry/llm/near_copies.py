"""Near copies by covering SimHash and MinHash tables, linked by the exact Jaccard similarity of five-word shingles.

Fingerprints are those of ``simhash``, of five-word shingles, and the tables its
covering family for a radius of ``RADIUS`` bits: no similar pair within it is
missed. At a similarity of 0.8 some 10 of 64 bits differ, for which a covering
family would need 2**11 tables; so ``TABLES`` MinHash tables stand beside them.
A key there is made of ``ROWS`` minima, and all together miss a pair of
similarity 0.8 with a chance of (1 - 0.8**ROWS)**TABLES, 7 in 100 000, and a
closer pair less. Each text of a bucket is first checked against a leader of
the bucket, which is linear in the bucket's size; of a bucket that still holds
more than one component after ``STARS`` rounds, every pair across components is
checked too, so leaders save work and lose nothing. No pair is linked without
the check of its full shingle sets.

Defined cases: texts without words are copies of each other; texts of fewer
words than a shingle are one shingle; a null text is empty; repeated rows and ids
don't matter, since texts are linked by their hashes; an empty table gives an
empty result; extra columns are ignored. A very long text is sketched in pieces;
the check of a pair holds the shingle hashes of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, free, rows, shingle_hashes, text_of, texts

SHINGLE, SIMILARITY = 5, 0.8
ROWS, TABLES = 8, 50
#: Bits within which two fingerprints are certain to share a bucket, and the covering family's 2**(RADIUS + 1) - 1 masks.
RADIUS = 3
MASKS = simhash.masks(RADIUS)
#: Longs of one-bit minima, and the bits that may differ: 0.1 of 384 do at similarity 0.8, and 66 lie 4.7 deviations above.
WORDS, DIFFER = 6, 66
#: Rounds of leaders before the pairs across components.
STARS = 2
#: Shingles whose minima are taken at a time, for bounded memory on very long texts.
CHUNK = 1 << 10
#: Edges that one task settles, 16 MB of them; more go through the star rounds.
SETTLED = 1 << 20

_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, (ROWS * TABLES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the shingles, in order and with repeats; words are those of ``simhash.fingerprint``."""
    return np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, SHINGLE)])


def sketch(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of ``text`` in every table, the table's number part of it, the covering ones first, and a bit of each of ``64 * WORDS`` minima."""
    mark = simhash.fingerprint(text, SHINGLE)
    keys = [xxhash.xxh64_intdigest((mark & m).to_bytes(8, "little"), TABLES + k) for k, m in enumerate(MASKS)]
    least = np.full(ROWS * TABLES, np.iinfo(np.uint64).max)
    for s in shingle_hashes(text, SHINGLE):
        for k in range(0, len(s), CHUNK):
            np.minimum(least, (_FACTORS * s[k : k + CHUNK]).min(1), out=least)
    keys += [xxhash.xxh64_intdigest(part.tobytes(), t) for t, part in enumerate(least.reshape(TABLES, ROWS))]
    bits = (least[: 64 * WORDS] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(63)).astype(np.uint8)
    return np.array(keys, np.uint64).view(np.int64), np.packbits(bits).view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def text_hash(text_col: str = "text"):
    return F.xxhash64(text_of(text_col))


def _sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """h, keys, bits: the sketch of each distinct text."""

    def run(batches):
        for whole in batches:
            for batch in rows(whole, name="t"):
                found = [sketch(x) for x in texts(batch, "t")]
                lists = [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in range(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["h", "keys", "bits"])

    marked = docs.select(text_hash(text_col).alias("h"), text_of(text_col).alias("t")).mapInArrow(run, "h long, keys array<long>, bits array<long>")
    return cut(marked.dropDuplicates(["h"]))


def _similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of text hashes whose texts are similar enough."""

    def run(batches):
        for whole in batches:
            for batch in rows(whole, 16 << 20, "x"):
                ok = [jaccard(x, y) >= SIMILARITY for x, y in zip(texts(batch, "x"), texts(batch, "y"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = held.select(F.col("h").alias("a"), F.col("t").alias("x")), held.select(F.col("h").alias("b"), F.col("t").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _star(members: DataFrame, seed: int) -> DataFrame:
    """Pairs a > b of each member (key, h) and its bucket's leader, another in each bucket, so that one odd text does not lead everywhere."""
    leads = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("h", "key", F.lit(seed)), "h")).getField("h").alias("lead"))
    return members.join(leads, "key").where("h <> lead").select(F.greatest("h", "lead").alias("a"), F.least("h", "lead").alias("b")).distinct()


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, h, root of the members of those buckets that hold more than one component."""
    rooted = members.select("key", "h").join(roots, members.h == roots.node, "left").select("key", "h", F.coalesce("root", "h").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    return cut(rooted.join(mixed, "key", "left_semi"))


def settle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) that are not the least of their component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, (x, y) = np.arange(len(nodes)), np.split(at, 2)
    while (up[x] != up[y]).any():
        # Roots are hung below lesser roots only, so there is no cycle.
        np.minimum.at(up, np.maximum(up[x], up[y]), np.minimum(up[x], up[y]))
        while (up[up] != up).any():
            up = up[up]
    low = up != np.arange(len(nodes))
    return nodes[low], nodes[up[low]]


def components(edges: DataFrame) -> DataFrame:
    """As ``simhash.components``, whose rounds take a dozen plans each of the driver's memory; up to ``SETTLED`` edges need one task only."""

    def run(batches):
        found = [(np.empty(0, np.int64),) * 2, *((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in settle(*map(np.concatenate, zip(*found, strict=True)))], ["node", "root"])

    e = cut(edges.where("a <> b").select("a", "b").distinct())
    got = cut(e.coalesce(1).mapInArrow(run, "node long, root long") if e.count() <= SETTLED else simhash.components(e))
    # What this step has left on the driver's heap and the executors' disks would else pile up.
    free(edges.sparkSession)
    return got


def similar_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """h, root: of each text hash that is near another one, the least hash of its component; a root itself is left out."""
    marked = _sketches(docs, text_col)
    tagged = marked.select("h", F.explode("keys").alias("key"))
    shared = tagged.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = cut(tagged.join(shared, "key", "left_semi"))
    some = members.select("h").distinct()
    held = cut(docs.select(text_hash(text_col).alias("h"), text_of(text_col).alias("t")).join(some, "h", "left_semi").dropDuplicates(["h"]))
    roots, left = None, members
    for seed in range(STARS):
        found = _similar(_star(left, seed), held)
        roots = components(found if roots is None else found.union(roots.select("node", "root")))
        left = _mixed(left, roots)
    # Each pair across components once, by the first table that it shares; pairs whose bits are too far apart for 0.8 need no texts.
    full = left.join(marked, "h")
    a, b = (full.select("key", F.col("h").alias(x), F.col("root").alias(f"r{x}"), F.col("keys").alias(f"k{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    first = F.element_at(F.array_intersect("ka", "kb"), 1)
    differ = sum((F.bit_count(F.col("ba")[k].bitwiseXOR(F.col("bb")[k])) for k in range(WORDS)), F.lit(0))
    across = a.join(b, (a.key == b.key) & (F.col("ra") < F.col("rb")) & (differ <= DIFFER) & (first == a.key)).select("a", "b")
    every = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_similar(across, held)))
    return every.select(F.col("node").alias("h"), "root")
