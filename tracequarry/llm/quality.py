"""Document quality from overlapping heuristic labellers, without hand labels.

Each labeller votes good (1), bad (0) or abstains (2). Expectation-maximisation
over the counts of vote patterns of the whole corpus estimates every
labeller's accuracies and the share of good documents (independence given the
class); the posterior of a pattern labels its documents. Those posteriors train
a linear scorer over hashed byte trigrams on the TRAIN_ROWS documents whose
texts hash lowest, the only bounded sample; every document is then scored.

Defined cases: null and empty texts vote bad where a labeller looks at length
and abstain elsewhere; labellers that never vote keep their starting
accuracies; ties of the posterior (0.5) count as good, so nothing is dropped on
a draw; repeated rows get equal results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import cycle, islice
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows, table, texts

#: Bound of the training sample in rows; bits of a trigram slot; passes over the sample where it is small.
TRAIN_ROWS, BITS = 8_000, 14
#: Training steps at any size of the sample: ten passes over a full one.
UPDATES = 10 * TRAIN_ROWS
#: A document is kept at this score or more.
KEEP = 0.5
WORDY = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TAILS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f.][.,]?[#$%&*@^~|<>+=\\/_]{2,}(?=\s|$)")
#: Byte classes: 0 other, 1 letter or beyond ASCII, 2 digit, 3 white space, 4 sentence sign.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[48:58] = 2
CLASSES[[32, 9, 10, 11, 12, 13]] = 3
CLASSES[[*b".,;:!?'\"-()"]] = 4
GOOD, BAD, NONE = 1, 0, 2


def _vote(x: float, bad_from: float, good_to: float) -> int:
    """Good up to ``good_to``, bad from ``bad_from``, in between nothing."""
    return BAD if x >= bad_from else GOOD if x <= good_to else NONE


def votes(text: bytes) -> list[int]:
    """One vote of each labeller."""
    b = np.frombuffer(text, np.uint8)
    n = np.bincount(CLASSES[b], minlength=5)
    tokens = text.split()
    k = len(tokens)
    if not k:
        return [BAD] + [NONE] * 9
    count = Counter(tokens)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = int(np.count_nonzero((b >= 65) & (b <= 90)))
    lower = int(np.count_nonzero((b >= 97) & (b <= 122)))
    odd = sum(c for t, c in count.items() if not WORDY.search(t))
    ends = text.count(b".") + text.count(b"?") + text.count(b"!")
    excited = text.count(b"!!") + text.count(b"??")
    return [
        BAD if k < 2 and len(text) < 4 else GOOD if k >= 20 else NONE,
        _vote(n[0] / max(1, len(b) - n[3]), 0.08, 0.02),  # signs that are no sentence signs
        _vote(len(TAILS.findall(text)) / k, 0.2, 0.02) if k >= 5 else NONE,  # words that end in runs of signs
        _vote(upper / max(1, upper + lower), 0.5, 0.15),
        _vote(sum(map(eq, tokens, tokens[1:])) / k, 0.1, 0.03) if k >= 10 else NONE,  # a word after itself
        _vote(1 - len(count) / k, 0.8, 0.65) if k >= 25 else NONE,  # few different words
        _vote(odd / k, 0.15, 0.04) if k >= 10 else NONE,  # tokens without letters
        _vote(1 - len(set(lines)) / len(lines), 0.5, 0.1) if len(lines) >= 4 else NONE,  # repeated lines
        _vote(excited / k, 0.1, 0.01),
        GOOD if ends and 3 <= k / ends <= 40 else BAD if k / max(1, ends) > 400 else NONE,  # sentence length
    ]


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good, table[labeller, class, vote]) from pattern counts; class 1 is good by the start."""
    keys = np.array(list(patterns), np.int64).reshape(len(patterns), -1)
    weight = np.array(list(patterns.values()), np.float64)
    m = keys.shape[1]
    start = np.zeros((m, 2, 3))
    start[:, 1] = (0.02, 0.68, 0.3)
    start[:, 0] = (0.4, 0.3, 0.3)
    # First responsibilities: junk is of many kinds, so one labeller's bad vote makes a document likely bad.
    share, p, table_ = 0.9, np.where((keys == BAD).any(1), 0.1, 0.97), start.copy()
    for _ in range(rounds):
        new_share = float(np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99))
        for c, q in ((1, p), (0, 1 - p)):
            for j in range(m):
                # The start counts as a few documents, so an unused vote keeps its place.
                table_[j, c] = np.bincount(keys[:, j], weight * q, 3) + 5 * start[j, c]
                table_[j, c] /= table_[j, c].sum()
        done, share = abs(new_share - share) < 1e-9, new_share
        p = posterior(keys, share, table_)
        if done:
            break
    return share, table_


def posterior(keys: np.ndarray, share: float, table_: np.ndarray) -> np.ndarray:
    """Probability of good for each row of votes."""
    at = np.arange(keys.shape[1])
    # Whether a labeller votes at all says nothing: terms are conditional on a vote, and an abstention adds none.
    cast = table_[:, :, :2] / table_[:, :, :2].sum(2, keepdims=True)
    terms = np.concatenate([np.log(cast), np.zeros((len(cast), 2, 1))], 2)
    good = np.log(share) + terms[at, 1, keys].sum(1)
    bad = np.log(1 - share) + terms[at, 0, keys].sum(1)
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the whole text, class-folded: (slots, damped counts of unit length)."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0)
    total = np.zeros(1 << BITS, np.int64)
    for k in range(0, len(b) - 2, 1 << 20):
        x = b[k : k + (1 << 20) + 2]
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        h *= np.uint32(0x27D4EB2F)
        total += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(total)
    v = np.sqrt(total[at])
    return at, v / np.sqrt((v * v).sum())


def train(examples: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic weights on soft labels, AdaGrad in the given order, the two classes weighted alike."""
    w, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    bias, gb = 0.0, 1e-3
    good = max(1e-6, sum(y for *_, y in examples) / max(1, len(examples)))
    for at, v, y in islice(cycle(examples), UPDATES):
        p = 1 / (1 + np.exp(-np.clip(bias + w[at] @ v, -30, 30)))
        d = (p - y) * (0.5 / good * y + 0.5 / max(1e-6, 1 - good) * (1 - y))
        step = d * v
        g[at] += step * step
        w[at] -= 0.3 * step / np.sqrt(g[at])
        gb += d * d
        bias -= 0.3 * d / np.sqrt(gb)
    return w, float(bias)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, votes (array), posterior of the labellers, score of the linear model, kept."""
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def voted(batches):
        for whole in batches:
            for batch in rows(whole, name="t"):
                yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, votes(t))) for t in texts(batch, "t")], pa.string())], ["votes"])

    # At most 3 ** labellers patterns come to the driver, counted over all documents.
    counted = keyed.select("t").mapInArrow(voted, "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = {tuple(map(int, r.votes)): r.n for r in counted.collect()}
    if not patterns:
        return keyed.select(F.col("id").alias(id_col), F.lit("").alias("votes"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(True).alias("kept"))
    share, accuracies = expectation_maximisation(patterns)
    soft = dict(zip(patterns, posterior(np.array(list(patterns)), share, accuracies).tolist(), strict=True))
    h = F.xxhash64(F.coalesce(F.col("t"), F.lit("")))
    total = max(1, keyed.agg(F.approx_count_distinct(h, 0.02)).first()[0])
    # The sample: the lowest hashes of the distinct texts. Hashes alone, about TRAIN_ROWS of them, tell where the bound lies exactly.
    about = min((1 << 63) - 1, int(min(1.0, 1.2 * TRAIN_ROWS / total) * (1 << 64)) - (1 << 63))
    lowest = sorted(r.h for r in keyed.select(h.alias("h")).where(F.col("h") <= F.lit(about).cast("long")).distinct().collect())[:TRAIN_ROWS]
    chosen = keyed.select(h.alias("h"), "t").where(F.col("h") <= F.lit(lowest[-1] if lowest else -(1 << 63)).cast("long")).groupBy("h").agg(F.first("t").alias("t"))

    def profiled(batches):
        for whole in batches:
            for batch in rows(whole, name="t"):
                hs, at, vs, ys = [], [], [], []
                for hash_, text in zip(batch.column(0).to_pylist(), texts(batch, "t"), strict=True):
                    a, v = profile(text)
                    hs.append(hash_)
                    at.append(a.astype(np.uint16).tobytes())
                    vs.append(v.astype(np.float32).tobytes())
                    ys.append(soft[tuple(votes(text))])
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(at, pa.binary()), pa.array(vs, pa.binary()), pa.array(ys, pa.float64())], ["h", "at", "v", "y"])

    taken = chosen.mapInArrow(profiled, "h long, at binary, v binary, y double")
    examples = [(np.frombuffer(r.at, np.uint16), np.frombuffer(r.v, np.float32), r.y) for r in sorted(taken.toLocalIterator(), key=lambda r: r.h)]
    w, bias = train(examples)
    shared = docs.sparkSession.sparkContext.broadcast((soft, w.astype(np.float32), bias))

    def scored(batches):
        soft_, weights, b = shared.value
        for whole in batches:
            for batch in rows(whole, name="t"):
                out: list[list] = [[] for _ in range(3)]
                for text in texts(batch, "t"):
                    own = votes(text)
                    at, v = profile(text)
                    out[0].append("".join(map(str, own)))
                    out[1].append(round(soft_[tuple(own)], 9))
                    out[2].append(round(float(1 / (1 + np.exp(-np.clip(b + float(weights[at].astype(np.float64) @ v), -30, 30)))), 6))
                scores = pa.array(out[2], pa.float64())
                # A document goes only where both the labellers and the scorer find it bad.
                kept = pc.or_(pc.greater_equal(scores, KEEP), pc.greater_equal(pa.array(out[1], pa.float64()), KEEP))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1], pa.float64()), scores, kept], [id_col, "votes", "posterior", "score", "kept"])

    return keyed.mapInArrow(scored, f"{id_col} {id_type}, votes string, posterior double, score double, kept boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
