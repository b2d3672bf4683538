"""Toxicity by a weighted pattern grammar over clauses.

Five finite-state transducers read a clause as a string of token classes and
are composed left to right: negation weakens an insult that follows within its
scope, reported speech weakens what is quoted, the target machine strengthens
insults that stand with a target, the threat machine accepts modal - harm -
target sequences, and the insult machine accepts a clause in which an insult is
said of something, that is, stands with another word before or behind it. The
weights of insults count in an accepted clause alone: a word by itself, as in a
list or a heading, is no match. A document's evidence is the sum over its
clauses; words outside a matched clause count for nothing.

The insult lexicon and the calibration are learnt from labelled training rows:
words and word beginnings that are far more frequent in toxic than in other
documents, counted once for each group of near copies. At most MAX_POSITIVE and
MAX_NEGATIVE labelled ids are used, those that hash lowest, with one text each;
that bound is the only sampling. Labels, lang, source and doc_id are no inputs
of a score.

Defined cases: null and empty texts get the score of a document without
evidence; a null label or id is no training row; several labels of a row: toxic
if any says so; several texts of an id: the one of least hash is learnt from;
without training rows of both classes the lexicon is empty and every score is
PRIOR; repeated rows get equal scores; an empty table gives an empty result;
extra columns are passed through by ``score_documents``, but for one named like
the score, which gives way to it. A very long text is read clause by clause.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, rows, shingle_hashes, table

#: Bounds of the training sample.
MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
PREFIXES = range(3, 9)
MIN_DOCS, MIN_RATIO, SIGNATURES = 3, 8.0, 8
THRESHOLD, PRIOR = 0.7, 0.05

# Fixed values of the grammar: closed word classes.
TARGET = frozenset("you your yours he him his she her they them their these those all every du ihr sie er tu vous il elle ils usted ustedes él ella ellos".split())
NEGATION = frozenset("not no never nobody none without hardly isnt arent nicht kein keine nie niemals pas jamais aucun sans nunca jamás ningún sin".split())
REPORT = frozenset("said says say called calls wrote writes quoted quote claimed according sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
MODAL = frozenset("will shall gonna going should must want wanna ll gotta werde wirst wird werden soll sollte muss vais vas va allons vont devrait doit voy vamos van debe quiero".split())
HARM = frozenset(
    """kill hurt destroy beat shoot stab burn murder strangle attack crush smash punish choke drown hang slap kick punch harm
    töten schlagen verprügeln vernichten erschießen umbringen verbrennen erwürgen tuer frapper détruire brûler étrangler écraser
    matar golpear destruir quemar apuñalar estrangular pegar""".split()
)
WORD = re.compile(r"[^\W\d_]+")
#: A sign by itself or a new line ends a clause; signs in a row are emphasis.
END = re.compile(r"(?<![!?])[.!?;](?![!?])|\n|\Z")
PART = re.compile(r"[^\W\d_]+|[\"“”„«»]")


class Transducer:
    """A deterministic weighted transducer: step(state, symbol) -> (state, output, factor), and at the clause's end close(state) -> (factor of all arcs, weight added)."""

    def __init__(self, step, close=lambda state: (1.0, 0.0), start=0):
        self.step, self.close, self.start = step, close, start

    def compose(self, other: Transducer) -> Transducer:
        """``other`` reads what this one writes; transitions are built when first met."""
        made: dict = {}

        def step(state, symbol):
            if (found := made.get((state, symbol))) is None:
                a, out, f = self.step(state[0], symbol)
                b, out, g = other.step(state[1], out)
                found = made[state, symbol] = ((a, b), out, f * g)
            return found

        def close(state):
            (f, x), (g, y) = self.close(state[0]), other.close(state[1])
            return f * g, x + y

        return Transducer(step, close, (self.start, other.start))


# Symbols: I insult, T target, N negation, R report, M modal, H harm, Q quotation mark, o other; n and r are weakened insults.
def _negation(scope: int = 3) -> Transducer:
    def step(left, c):
        if c == "N":
            return scope, c, 1.0
        return (max(0, left - 1), "n", 0.3) if c == "I" and left else (max(0, left - 1), c, 1.0)

    return Transducer(step)


def _reported() -> Transducer:
    """State 1 after a reporting word, 2 inside quotation marks that follow one."""

    def step(s, c):
        if c == "R":
            return max(s, 1), c, 1.0
        if c == "Q":
            return {0: 0, 1: 2, 2: 0}[s], c, 1.0
        return (s, "r", 0.5) if s and c == "I" else (s, c, 1.0)

    return Transducer(step)


def _target(bonus: float = 0.5) -> Transducer:
    """Bits: a target is there, an insult is there."""

    def step(s, c):
        return s | (1 if c == "T" else 2 if c == "I" else 0), c, 1.0

    return Transducer(step, lambda s: (1.0, bonus if s == 3 else 0.0))


def _threat(weight: float = 2.0) -> Transducer:
    """modal, harm, target in this order, others between; a negation starts anew."""

    def step(s, c):
        if c == "N":
            return (s if s == 3 else 0), c, 1.0
        return (s + 1 if s < 3 and c == "MHT"[s] else s), c, 1.0

    return Transducer(step, lambda s: (1.0, weight if s == 3 else 0.0))


def _insult() -> Transducer:
    """An insult, weakened or not, and another word, in either order; without both the arcs of the clause count for nothing. Bits: word, insult."""

    def step(s, c):
        if c == "Q":
            return s, c, 1.0
        if c not in "Inr":
            return s | 1, c, 1.0
        return (s | 1 if s & 2 else s | 2), c, 1.0

    return Transducer(step, lambda s: (1.0 if s == 3 else 0.0, 0.0))


def grammar() -> Transducer:
    return reduce(Transducer.compose, [_negation(), _reported(), _target(), _threat(), _insult()])


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k <= len(word))]


class Scorer:
    CACHE = 300_000

    def __init__(self, lexicon: dict[str, float], bias: float = math.log(PRIOR / (1 - PRIOR)), slope: float = 0.0):
        self.lexicon, self.bias, self.slope = lexicon, bias, slope
        self.machine = grammar()
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if len(self.known) >= self.CACHE:
            self.known.clear()
        found = self.known[word] = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
        return found

    def _class(self, token: str) -> str:
        if self.known[token] if token in self.known else self.weight(token):
            return "I"
        for kind, words in (("T", TARGET), ("N", NEGATION), ("R", REPORT), ("M", MODAL), ("H", HARM)):
            if token in words:
                return kind
        return "Q" if not token.isalpha() else "o"

    def evidence(self, text: str) -> float:
        low = text.lower()
        known, weight = self.known, self.weight
        for m in WORD.finditer(low):
            w = m[0]
            x = known.get(w)
            if (weight(w) if x is None else x) or w in HARM:
                break
        else:
            return 0.0
        total, at = 0.0, 0
        for m in END.finditer(low):
            total += self._clause(low[at : m.start()])
            at = m.end()
        return total

    def _clause(self, clause: str) -> float:
        state, found = self.machine.start, 0.0
        for m in PART.finditer(clause):
            token = m[0]
            kind = self._class(token)
            state, _, factor = self.machine.step(state, kind)
            if kind == "I":
                found += factor * self.known[token]
        gain, more = self.machine.close(state)
        return found * gain + more

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(self.evidence(text))))))


_SALTS = np.array([xxhash.xxh64_intdigest(str(k)) | 1 for k in range(SIGNATURES)], np.uint64)


def signature(text: str) -> list[int]:
    """SIGNATURES minima of salted hashes over five-word shingles; near copies share one almost surely."""
    least = np.full(SIGNATURES, np.iinfo(np.uint64).max)
    for h in shingle_hashes(text.encode(), 5):
        for k in range(SIGNATURES):
            least[k] = min(least[k], (h * _SALTS[k]).min())
    return (least >> np.uint64(7)).tolist()


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The bounded training sample: id, toxic, text."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = one.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    take = lambda toxic, n: train.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = take(1, MAX_POSITIVE).unionByName(take(0, MAX_NEGATIVE))
    bodies = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    # One text an id, so that the bound holds whatever rows repeat; combined map-side.
    return bodies.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "toxic", "text")).alias("m")).select("doc_id", "m.toxic", "m.text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], float, float]:
    """(lexicon, bias, slope) from the labelled training rows; only bounded counts reach the driver."""
    sample = cut(_sample(docs, labels, id_col, text_col))

    def signed(batches):
        for whole in batches:
            for b in rows(whole):
                d = b.to_pydict()
                yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"]), pa.array(d["toxic"], pa.int32()), pa.array([signature(t) for t in d["text"]], pa.list_(pa.int64()))], ["doc_id", "toxic", "sig"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    seen: set = set()
    kept: dict = {}
    for r in sorted(sample.mapInArrow(signed, f"doc_id {id_type}, toxic int, sig array<long>").collect(), key=lambda r: r.doc_id):
        if not any((k, s) in seen for k, s in enumerate(r.sig)) and r.doc_id not in kept:
            kept[r.doc_id] = r.toxic
        seen.update(enumerate(r.sig))
    positive = sum(kept.values())
    negative = len(kept) - positive
    if not positive or not negative:
        return {}, math.log(PRIOR / (1 - PRIOR)), 0.0

    def counts(batches):
        for whole in batches:
            for b in rows(whole, 8 << 20):
                d = b.to_pydict()
                n: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for i, toxic, text in zip(d["doc_id"], d["toxic"], d["text"], strict=True):
                    if i in kept:
                        n[toxic].update({f for w in {m[0] for m in WORD.finditer(text.lower())} for f in features(w)})
                found = list(n[0].keys() | n[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([n[c][f] for f in found], pa.int64()) for c in (1, 0))], ["f", "a", "b"])

    counted = cut(sample.mapInArrow(counts, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= MIN_DOCS))
    share = positive / (positive + negative)
    needed = math.log(max(2, counted.count())) + 2
    # A beginning that says no more than one of its continuations gives way to it.
    begins = F.endswith("f", F.lit("*"))
    parent = F.concat(F.when(begins, F.expr("left(f, length(f) - 2)")).otherwise(F.expr(f"left(f, {PREFIXES[-1]})")), F.lit("*"))
    carried = counted.groupBy(parent.alias("f")).agg(F.max("a").alias("carried"))
    a, b = F.col("a"), F.col("b")
    ratio = ((a + 0.5) / (positive + 1)) / ((b + 0.5) / (negative + 1))
    gain = a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / (1 - share))).otherwise(0.0)
    own = counted.join(carried, "f", "left").where(~(begins & (a < 1.25 * F.coalesce("carried", F.lit(0)))))
    telling = own.where((ratio >= MIN_RATIO) & (gain >= needed) & (a >= 4 * b))
    lexicon = {r.f: round(min(5.0, math.log(r.ratio)) / 5.0, 4) for r in telling.select("f", ratio.alias("ratio")).collect()}
    scorer_of = Scorer(lexicon)

    def weighed(batches):
        for whole in batches:
            for b in rows(whole):
                d = b.to_pydict()
                at = [k for k, i in enumerate(d["doc_id"]) if i in kept]
                yield pa.RecordBatch.from_arrays([pa.array([d["toxic"][k] for k in at], pa.int32()), pa.array([scorer_of.evidence(d["text"][k]) for k in at], pa.float64())], ["toxic", "e"])

    bias, slope = _logistic([(math.log1p(r.e), r.toxic) for r in sample.mapInArrow(weighed, "toxic int, e double").collect()])
    return lexicon, bias, slope


def _logistic(points: list[tuple[float, int]], ridge: float = 0.5, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope by damped Newton steps with an L2 term on the slope."""
    grouped = Counter(points)
    b = s = 0.0
    for _ in range(rounds):
        gb = gs = hbb = hbs = hss = 0.0
        for (x, y), n in sorted(grouped.items()):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + s * x))))
            gb += n * (y - p)
            gs += n * (y - p) * x
            v = n * max(p * (1 - p), 1e-9)
            hbb, hbs, hss = hbb + v, hbs + v * x, hss + v * x * x
        gs, hss, hbb = gs - ridge * s, hss + ridge, hbb + 1e-6
        det = hbb * hss - hbs * hbs
        db, ds = (hss * gb - hbs * gs) / det, (hbb * gs - hbs * gb) / det
        scale = min(1.0, 3.0 / max(abs(db), abs(ds), 1e-12))
        b, s = b + scale * db, s + scale * ds
        if max(abs(db), abs(ds)) < 1e-9:
            break
    return b, max(0.0, s)


def score_documents(docs: DataFrame, model: tuple[dict[str, float], float, float], text_col: str = "text", out_col: str = "score", drop_from: float | None = None) -> DataFrame:
    """All columns of ``docs``, then the score; with ``drop_from`` rows of that score or more go and no score is added."""
    if drop_from is None:
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out_col])
    schema = docs.schema if drop_from is not None else T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(*shared.value)
        for whole in batches:
            for b in rows(whole, name=text_col):
                scores = [scorer.score(t or "") for t in b.column(at).to_pylist()]
                if drop_from is None:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, out_col])
                else:
                    yield b.filter(pa.array([s < drop_from for s in scores], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
