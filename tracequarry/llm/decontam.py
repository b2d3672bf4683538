"""Benchmark passages in documents, by an FM-index over each shard of the corpus.

Words are mapped to the vocabulary of the test phrases; every other word is a
break. What is left of a shard, stretches of vocabulary words at least as long
as the shortest phrase, is indexed: suffix order, Burrows-Wheeler transform,
a wavelet tree of bit planes with rank counts, and every ``SAMPLE``-th suffix
position. All phrases are searched backward at once; occurrences are located by
walking to a sampled position and their word spans are merged.

A phrase is a window of ``width`` consecutive words of an item; an item of
fewer words is one window. Defined cases: null and empty texts have no words;
an item without words has no window; equal windows of several items count for
each of them; overlapping occurrences merge; repeated rows are each searched;
an empty table on either side gives counts of nothing; extra columns are
ignored. The items reach the workers in blocks of at most ``block_words``
words, so what is broadcast is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, rows, table, texts

WIDTH, SAMPLE = 10, 8
#: Text of a shard in bytes, words of the benchmark in a broadcast block.
SHARD_BYTES, BLOCK_WORDS = 32 << 20, 1_000_000
#: Every byte that is no part of a word becomes a space.
CLEAN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER_ASCII)


def words(text: bytes) -> list[bytes]:
    return text.translate(CLEAN).split()


class Phrases:
    """The windows of a block of items as rows of word numbers; number 0 is the break."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = WIDTH):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for k in range(max(1, len(w) - width + 1) if w else 0):
                owners.setdefault(tuple(w[k : k + width]), set()).add(item)
        self.rows = list(owners)
        self.owners = [sorted(map(str, owners[r])) for r in self.rows]
        self.shortest = min(map(len, self.rows), default=0)
        self.lengths = np.array([len(r) for r in self.rows], np.int64)
        self.table = np.zeros((len(self.rows), width), np.int64)  # right-aligned
        for k, r in enumerate(self.rows):
            self.table[k, width - len(r) :] = r


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the unique smallest."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (max(int(rank.max()), n) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletTree:
    """Bit planes of a sequence, most significant first, each stably split by its bit; rank by prefix counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = symbols & symbols.dtype.type(1 << b) != 0
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:], dtype=np.int32)
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        #: Where the block of each symbol begins once all planes have split the sequence.
        self.block = np.zeros(1 << bits, np.int64)
        present, first = np.unique(symbols, return_index=True)
        self.block[present] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, for many at once."""
        low, high = np.zeros_like(at), at.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b) & 1 == 1
            ones = self.ones[level]
            l1, h1 = ones[low], ones[high]
            low = np.where(one, self.zeros[level] + l1, low - l1)
            high = np.where(one, self.zeros[level] + h1, high - h1)
        return high - low


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        """``symbols`` without the end mark, values below ``sigma``; they are raised by one to make room for it."""
        text = np.concatenate([symbols + 1, [0]]).astype(np.int64)
        order = suffix_order(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.tree = WaveletTree(self.bwt, int(sigma + 1).bit_length())
        kept = order % SAMPLE == 0
        self.kept = kept
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept_at = order[kept]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned phrases (0 fills the left), extended backward from the last word."""
        low = np.zeros(len(table), np.int64)
        high = np.full(len(table), self.n, np.int64)
        for k in range(table.shape[1] - 1, -1, -1):
            go = np.flatnonzero((table[:, k] > 0) & (high > low))
            c = table[go, k] + 1
            low[go] = self.before[c] + self.tree.rank(c, low[go])
            high[go] = self.before[c] + self.tree.rank(c, high[go])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step backward until a sampled one."""
        steps = np.zeros(len(at), np.int64)
        out = np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        while len(todo):
            here = at[todo]
            done = self.kept[here]
            out[todo[done]] = self.kept_at[self.kept_rank[here[done]]] + steps[todo[done]]
            todo = todo[~done]
            here = at[todo]
            c = self.bwt[here]
            at[todo] = self.before[c] + self.tree.rank(c, here)
            steps[todo] += 1
        return out


def search_shard(docs: list[bytes], phrases: Phrases):
    """For each document: number of words, merged word spans [start, end), items found."""
    n_words, pieces, starts, doc_of, word_of = [], [], [], [], []
    at = 0
    get = phrases.ids.get
    for d, text in enumerate(docs):
        w = words(text)
        n_words.append(len(w))
        if not phrases.rows or len(w) < phrases.shortest:
            continue
        ids = np.fromiter(map(get, w, [0] * len(w)), np.int64, len(w))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                pieces += [ids[a:b], [0]]
                starts.append(at)
                doc_of.append(d)
                word_of.append(a)
                at += b - a + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]
    if pieces:
        index = FMIndex(np.concatenate(pieces).astype(np.int64), len(phrases.ids) + 1)
        low, high = index.search(phrases.table)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        ranks = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        places = index.locate(ranks)
        piece = np.searchsorted(starts, places, side="right") - 1
        word = places - np.array(starts)[piece] + np.array(word_of)[piece]
        doc = np.array(doc_of)[piece]
        order = np.lexsort((word, doc))
        for k in order.tolist():
            d, a, r = int(doc[k]), int(word[k]), int(which[k])
            b = a + int(phrases.lengths[r])
            items[d].update(phrases.owners[r])
            if spans[d] and a <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
            else:
                spans[d].append((a, b))
    return n_words, spans, items


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span."""
    clean = text.translate(CLEAN)
    arr = np.frombuffer(clean, np.uint8) != 0x20
    edges = np.diff(np.concatenate([[False], arr, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : int(first[a])])
        at = int(last[b - 1])
    return b"".join([*out, text[at:]])


def cut_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, all columns kept, with the hit words and what lies between them cut out of the text.

    Blocks of the benchmark are searched one after the other over the same
    batch, so spans of all blocks are judged on the input text; a null stays null.
    """
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, item_col, item_text, block_words)]
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        made = None
        for whole in batches:
            for batch in rows(whole, SHARD_BYTES, text_col):
                bodies = texts(batch, text_col)
                spans: list[list[tuple[int, int]]] = [[] for _ in bodies]
                for shared in blocks:
                    if len(blocks) > 1 or made is None:
                        made = Phrases(shared.value, width)
                    for own, found in zip(spans, search_shard(bodies, made)[1], strict=True):
                        own += found
                whole_text = batch.column(at).to_pylist()
                for k, (body, own) in enumerate(zip(bodies, spans, strict=True)):
                    if own:
                        merged: list[tuple[int, int]] = []
                        for a, b in sorted(own):
                            if merged and a <= merged[-1][1]:
                                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                            else:
                                merged.append((a, b))
                        whole_text[k] = cut_words(body, merged).decode()
                columns = list(batch.columns)
                columns[at] = pa.array(whole_text, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """The items in blocks of bounded size, one after the other from the rows' iterator."""
    block, held = [], 0
    for item, text in benchmark.select(F.col(id_col), F.col(text_col).cast("binary")).toLocalIterator():
        n = len(words(bytes(text or b"")))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        if n:
            block.append((item, bytes(text)))
            held += n
    yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Each row's number of words, merged spans of hit words and the items found there: id, n_words, spans, items.

    With a single block, the usual case, this is one pass without an exchange;
    further blocks add a pass each and are united by row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    parts = []
    for block in _blocks(benchmark, item_col, item_text, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            phrases = Phrases(shared.value, width)
            for whole in batches:
                for batch in rows(whole, SHARD_BYTES, "t"):
                    n, spans, items = search_shard(texts(batch, "t"), phrases)
                    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    cols = [pa.array(n, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - 1], *cols], [*batch.schema.names[:-1], "n_words", "spans", "items"])

        parts.append((shared, run))
    out = f"{id_col} {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    if len(parts) == 1:
        return docs.selectExpr(f"`{id_col}`", f"cast(`{text_col}` as string) t").mapInArrow(parts[0][1], out)
    # One row for each distinct (id, text), found in every block and united; repeated rows come back by the join.
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), body.alias("t"))
    united = None
    for _, run in parts:
        got = keyed.dropDuplicates([id_col, "h1", "h2"]).mapInArrow(run, out.replace(", n_words", ", h1 long, h2 long, n_words"))
        united = got if united is None else united.unionByName(got)
    merged = united.groupBy(id_col, "h1", "h2").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.lit(None).cast("array<struct<start:int,end:int>>")
    fused = F.aggregate(
        "spans",
        F.coalesce(start, F.array().cast("array<struct<start:int,end:int>>")),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    a, b = keyed.drop("t").alias("a"), merged.withColumn("spans", fused).alias("b")
    same = F.col(f"a.{id_col}").eqNullSafe(F.col(f"b.{id_col}")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
    return a.join(b, same).select(f"a.{id_col}", "n_words", "spans", "items")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
