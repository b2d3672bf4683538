"""Repeated byte strings across all texts, by interval expansion on Burrows-Wheeler transforms.

A byte is removed when some ``length``-byte string covering it also starts
anywhere else, in its own text included. Every such string (a window) has a
minimizer, its k-gram of least hash, leftmost among equals; equal windows have
equal minimizers at equal offsets. So the windows of a text fall into segments,
runs of windows with the same minimizer position, and equal windows can only be
in segments that share the minimizer:

1. Minimizers are counted by hash, combined map-side; segments whose minimizer
   occurs once anywhere are dropped.
2. Of each different segment that is left, its first and its last occurrence
   (the only one, if there is one) are fetched from their texts and dealt by
   minimizer to shards of about SHARD_BYTES. Where a minimizer has but two places
   to compare, neighbours in the same two texts go as one stretch.
3. A shard is sorted into suffix order and its transform; breadth-first backward
   extension of its intervals yields the common prefix lengths in increasing
   order and stops at ``length``: what is not derived by then is at least that
   long, and those suffixes are repeats. Only the transform says what repeats.
4. A minimizer with more than HOT different segments would not fit a shard. Its
   segments are halved by the offset of the minimizer in the window: the windows
   of a half have a longer context in common, whose hash deals them anew. That
   goes on until a bucket fits; single windows with one context are one string.

Hashes choose shards, and tell which segments are occurrences of one kind (64
bits of the segment's bytes among those of one minimizer hash): the first and
last of a kind are compared byte by byte in the transform, those between take
their result.

Defined cases: a null text is empty; texts shorter than ``length`` are kept;
repeated rows are separate texts, so they are copies of each other; an empty
table gives an empty result; extra columns are ignored, whatever their names;
a very long text is worked on CHUNK bytes at a time and gives one row for each
segment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, rows, table, text_of, texts
from .decontam import WaveletTree

LENGTH, GRAM = 200, 64
#: Bytes of a shard, and different segments of a minimizer that may share one.
SHARD_BYTES, HOT = 1 << 20, 8_000
#: Bytes hashed at a time.
CHUNK = 1 << 15
_ODD = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_ODD, -1, 1 << 64)
    up = np.full(n, _ODD, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Minimizers:
    """Window segments of many texts at once."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.up, self.down = _powers(CHUNK + length + 1)
        self.salt = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def _part(self, data: np.ndarray):
        """Minimizer position of each window that starts in this part, and the hash of each gram."""
        n, k, w = len(data), self.gram, self.length - self.gram + 1
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.salt[data] * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        least = h & np.uint64(~((1 << 20) - 1) & ((1 << 64) - 1))
        least |= np.arange(len(h), dtype=np.uint64)
        # Least of w neighbours, by doubling spans.
        span = 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        return (least & np.uint64((1 << 20) - 1)).astype(np.int64), h

    def segments(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment in order: text number, first window, last window, minimizer position (in its text), minimizer hash."""
        sizes = np.array([len(b) for b in bodies], np.int64)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        n, length = len(data), self.length
        begin = np.cumsum(sizes) - sizes
        # Windows that would run over the end of their text start in [stop, end).
        stop, end = np.maximum(begin, begin + sizes - length + 1), begin + sizes
        firsts, ats, keys, before = [], [], [], -1
        for a in range(0, n - length + 1, CHUNK):
            at, h = self._part(data[a : min(n, a + CHUNK + length - 1)])
            fresh = np.concatenate([[at[0] + a != before], at[1:] != at[:-1]])
            for edge in (begin, stop):
                inside = edge[(edge >= a) & (edge < a + len(at))]
                fresh[inside - a] = True
            first = np.flatnonzero(fresh)
            firsts.append(first + a)
            ats.append(at[first] + a)
            keys.append(h[at[first]])
            before = int(at[-1]) + a
        if not firsts:
            none = np.empty(0, np.int64)
            return none, none, none, none, np.empty(0, np.uint64)
        first, at, key = np.concatenate(firsts), np.concatenate(ats), np.concatenate(keys)
        last = np.concatenate([first[1:], [n - length + 1]]) - 1
        source = np.searchsorted(end, first, side="right")
        whole = first < stop[source]
        source, first, last, at, key = source[whole], first[whole], last[whole], at[whole], key[whole]
        return source, first - begin[source], last - begin[source], at - begin[source], key


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def suffix_order(symbols: np.ndarray, breaks: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols; symbol 0 at ``breaks`` ends a part, each break smaller than those after it.

    Suffixes that agree that far are in no particular order. ``symbols`` are big-endian numbers of one or two bytes.
    """
    n, wide = len(symbols), symbols.itemsize
    depth = 8 // wide
    # The first ``depth`` symbols as one number, zeros from the break on.
    held = symbols.tobytes() + bytes(8)
    key = np.ndarray((n,), ">u8", held, strides=(wide,)).astype(np.uint64)
    begin = np.concatenate([[0], breaks[:-1] + 1])
    is_end = np.zeros(n, bool)
    for k in range(depth):  # ends with k symbols before the break
        at = breaks - k
        at = at[at >= begin]
        is_end[at] = True
        key[at] &= np.uint64(((1 << 8 * wide * k) - 1) << 8 * wide * (depth - k))
    order = np.argsort(key)
    ranked = key[order]
    ends = is_end[order]
    # Equal ends of different parts: in the order of their breaks, the same at every length.
    short = np.flatnonzero(ends)
    order[short] = order[short][np.lexsort((order[short], ranked[short]))]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:n])
    new[:n] |= ends
    new[1:] |= ends
    at_head = np.flatnonzero(new[:n])
    first = np.repeat(at_head, np.diff(np.concatenate([at_head, [n]])))
    rank = np.empty(n, np.int32)
    rank[order] = first
    where = np.flatnonzero(~(new[1:] & new[:n]))
    first = first[where]
    step, b = depth, n.bit_length()
    while len(where) and step < length:
        at = order[where]
        # Ranks of the next one or two spans, as many as fit a number beside the group's own.
        mixed = first << b
        mixed |= rank[at + step]
        if 3 * b <= 63:
            mixed <<= b
            mixed |= rank[np.minimum(at + 2 * step, n - 1)]
        o = np.argsort(mixed)
        at, mixed = at[o], mixed[o]
        order[where] = at
        m = len(where)
        new = np.empty(m + 1, bool)
        new[0] = new[m] = True
        np.not_equal(mixed[1:], mixed[:-1], out=new[1:m])
        at_head = np.flatnonzero(new[:m])
        first = np.repeat(where[at_head], np.diff(np.concatenate([at_head, [m]])))
        rank[at] = first
        open_ = ~(new[1:] & new[:m])
        where, first = where[open_], first[open_]
        step *= 3 if 3 * b <= 63 else 2
    return order


def repeats(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the window starts whose ``length`` bytes start anywhere else in the parts too."""
    sizes = np.array([len(p) for p in parts], np.int64)
    breaks = np.cumsum(sizes + 1) - 1
    n = int(breaks[-1]) + 1
    body = np.frombuffer(b"".join(parts), np.uint8)
    present = np.bincount(body, minlength=256) > 0
    sigma = int(present.sum())
    symbols = np.zeros(n, ">u1" if sigma < 256 else ">u2")
    mask = np.ones(n, bool)
    mask[breaks] = False
    symbols[mask] = np.cumsum(present).astype(symbols.dtype)[body]
    order = suffix_order(symbols, breaks, length)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    bwt = symbols[order - 1]
    bwt = bwt.astype(bwt.dtype.newbyteorder("="))
    back = rank[order - 1]  # the rank of the suffix one symbol longer
    tree = WaveletTree(bwt, max(1, sigma.bit_length()))
    starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))]).astype(np.int32)
    m = len(parts)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    # Level 0: the empty string extended by every symbol, the breaks each on its own.
    c = np.flatnonzero(np.diff(starts[1:])) + 1
    low = np.concatenate([np.arange(m, dtype=np.int32), starts[c]])
    high = np.concatenate([np.arange(1, m + 1, dtype=np.int32), starts[c + 1]])
    for _ in range(length):
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        known[high] = True
        # One or two suffixes are followed back at once, wider intervals descend the wavelet tree.
        width = high - low
        single = back[low[(width == 1) & (bwt[low] > 0)]]
        pair = low[width == 2]
        x, y, p, q = bwt[pair], bwt[pair + 1], back[pair], back[pair + 1]
        both, apart = (x == y) & (x > 0), x != y
        double = np.minimum(p[both], q[both])
        alone = np.concatenate([single, p[apart & (x > 0)], q[apart & (y > 0)]])
        many = width > 2
        low, high = _extend(tree, starts, low[many], high[many])
        low, high = np.concatenate([alone, double, low]), np.concatenate([alone + 1, double + 2, high])
    same = ~known[: n + 1]
    repeat = same[:n] | same[1:]
    where = np.sort(order[np.flatnonzero(repeat)])
    begin = breaks - sizes
    cuts = np.searchsorted(where, breaks)
    return [w - b for w, b in zip(np.split(where, cuts[:-1]), begin.tolist(), strict=True)]


def _extend(tree: WaveletTree, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of all left extensions by one symbol but a break: each interval descends the wavelet tree, splitting where both bits occur."""
    base, end, symbol = low, high, np.zeros(len(low), np.int32)
    for level in range(tree.bits):
        ones = tree.ones[level]
        l1, h1 = ones[base], ones[end]
        l0, h0 = base - l1, end - h1
        a, b = h0 > l0, h1 > l1
        z = tree.zeros[level]
        base, end, symbol = (
            np.concatenate([l0[a], l1[b] + z]),
            np.concatenate([h0[a], h1[b] + z]),
            np.concatenate([symbol[a] * 2, symbol[b] * 2 + 1]),
        )
    keep = symbol > 0
    base, end, symbol = base[keep], end[keep], symbol[keep]
    # After the last plane equal symbols are together, in the order of the transform: the offset in that block is the rank.
    at = (starts[symbol] - tree.block[symbol]).astype(np.int32)
    return base + at, end + at


def _runs(found: np.ndarray, length: int) -> list[dict]:
    """Covered byte ranges of sorted window starts."""
    edges = np.flatnonzero(np.diff(found) > length)
    first = np.concatenate([[found[0]], found[edges + 1]])
    last = np.concatenate([found[edges], [found[-1]]]) + length
    return [{"a": int(a), "b": int(b)} for a, b in zip(first, last, strict=True)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (the text's bytes), and i and h, the hashes of both: 128 bits, never null, that stand for the row in joins."""
    body = text_of(text_col)
    own = F.col(f"`{id_col}`")
    return docs.select(own.alias("id"), F.xxhash64(own).alias("i"), F.xxhash64(body).alias("h"), body.cast("binary").alias("t"))


#: A segment's place in one number: first byte, number of bytes (9 bits), offset of the minimizer (8 bits).
_A, _N = 17, 8


def _place(w):
    """(first byte, number of bytes, offset of the minimizer) of a place."""
    return F.shiftright(w, _A).cast("int"), F.shiftright(w, _N).bitwiseAND(511).cast("int"), w.bitwiseAND(255).cast("int")


def _minimizers(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches):
        find = Minimizers(length)
        for whole in batches:
            for batch in rows(whole, 4 << 20, "t"):
                key = find.segments(texts(batch, "t"))[-1]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["mini"])

    return keyed.select("t").mapInArrow(run, "mini long")


def _segments(keyed: DataFrame, id_type: str, length: int) -> DataFrame:
    """mini, seg (hashes of minimizer and bytes), id, h, w (the place) of every segment."""

    def run(batches):
        find = Minimizers(length)
        hash64 = xxhash.xxh3_64_intdigest
        for whole in batches:
            for batch in rows(whole, 4 << 20, "t"):
                bodies = texts(batch, "t")
                source, first, last, at, key = find.segments(bodies)
                views = [memoryview(b) for b in bodies]
                seg = [hash64(views[k][a:b]) for k, a, b in zip(source.tolist(), first.tolist(), (last + length).tolist(), strict=True)]
                place = first << _A | (last - first + length) << _N | (at - first)
                take = pa.array(source)
                columns = [pa.array(key.view(np.int64)), pa.array(np.array(seg, np.uint64).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["mini", "seg", "id", "h", "w"])

    return keyed.select("id", "h", "t").mapInArrow(run, f"mini long, seg long, id {id_type}, h long, w long")


RANGES = "array<struct<a:int,b:int>>"
INNER = "array<struct<mini:long,seg:long,o:int,n:int>>"
#: Bytes of a stretch of joined segments; a longer one is parted at a segment.
STRETCH = 1 << 16


def _stretches(pairs: DataFrame, id_type: str, length: int) -> DataFrame:
    """Pieces of the buckets with two places to compare: a kind's first and last occurrence, or the places of two kinds.

    Buckets whose windows follow on each other in the same two texts, the
    minimizers at the same distance, are joined to one stretch, so that the bytes
    where segments overlap are compared once. Only windows that follow on are
    joined: no other piece then holds the same window of the same text.
    """
    a, n, p = _place(F.col("w"))
    b, m, q = _place(F.col("w2"))
    one = F.struct(a.alias("a"), n.alias("n"), b.alias("b"), m.alias("m"), "mini", "seg", "seg2")
    lines = pairs.select("id", "h", "id2", "h2", (b + q - a - p).alias("shift"), one.alias("s"))
    grouped = lines.groupBy("id", "h", "id2", "h2", "shift").agg(F.sort_array(F.collect_list("s")).alias("s"))

    def run(batches):
        struct = pa.list_(pa.struct([("mini", pa.int64()), ("seg", pa.int64()), ("o", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            at, key, copy, start, size, inner = [], [], [], [], [], []
            for row, line in enumerate(batch.column(5).to_pylist()):
                held: list[dict] = []
                for s in [*line, None]:
                    if held and (s is None or s["a"] != last["a"] + last["n"] - length + 1 or s["b"] != last["b"] + last["m"] - length + 1 or s["a"] - held[0]["a"] > STRETCH):
                        first = held[0]
                        at += [row, row + len(batch)]
                        key += [first["seg"]] * 2
                        copy += [0, 1]
                        start += [first["a"], first["b"]]
                        size += [last["a"] + last["n"] - first["a"], last["b"] + last["m"] - first["b"]]
                        inner.append([{"mini": x["mini"], "seg": x["seg"], "o": x["a"] - first["a"], "n": x["n"]} for x in held])
                        # Of one kind the first occurrence speaks for both.
                        inner.append([{"mini": x["mini"], "seg": x["seg2"], "o": x["b"] - first["b"], "n": x["m"]} for x in held if x["seg"] != x["seg2"]])
                        held = []
                    if s is not None:
                        held.append(s)
                        last = s
            owner = pa.array(at, pa.int64())
            ids = pa.concat_arrays([batch.column(0), batch.column(2)]).take(owner)
            hs = pa.concat_arrays([batch.column(1), batch.column(3)]).take(owner)
            columns = [pa.array(key, pa.int64()), pa.array(copy, pa.int32()), ids, hs, pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array([0] * len(key), pa.int32()), pa.array(inner, struct)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "copy", "id", "h", "a", "n", "p", "inner"])

    out = grouped.mapInArrow(run, f"key long, copy int, id {id_type}, h long, a int, n int, p int, inner {INNER}")
    return out.withColumn("hot", F.lit(False))


def _single(kinds: DataFrame) -> DataFrame:
    """Pieces of one segment each, dealt by minimizer: the first occurrence of a kind and, where it has another, the last. ``hot`` is handed on."""
    first, last = F.struct("id", "h", "w"), F.struct(F.col("id2").alias("id"), F.col("h2").alias("h"), F.col("w2").alias("w"))
    sides = F.array(F.struct(F.lit(0).alias("copy"), first.alias("at")), F.struct(F.lit(1).alias("copy"), last.alias("at")))
    each = kinds.select("hot", "mini", "seg", F.explode(F.when(F.col("k") > 1, sides).otherwise(F.slice(sides, 1, 1))).alias("e"))
    a, n, p = _place(F.col("e.at.w"))
    inner = F.array(F.struct("mini", "seg", F.lit(0).alias("o"), n.alias("n")))
    return each.select("hot", F.col("mini").alias("key"), F.col("e.copy").alias("copy"), F.col("e.at.id").alias("id"), F.col("e.at.h").alias("h"), a.alias("a"), n.alias("n"), p.alias("p"), inner.cast(INNER).alias("inner"))


def _fetch(pieces: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """The bytes of pieces: key, copy, p, inner, part, hot. Repeated rows of one id and text are first made one, combined map-side."""
    asked = pieces.groupBy(F.xxhash64("id").alias("i"), "h").agg(F.collect_list(F.struct("key", "copy", "a", "n", "p", "inner", "hot")).alias("ask"))
    held = keyed.where(F.octet_length("t") >= length).groupBy("i", "h").agg(F.first("t").alias("t"))
    source = held.join(asked, ["i", "h"]).select("ask", "t")

    def run(batches):
        struct = pa.list_(pa.struct([("mini", pa.int64()), ("seg", pa.int64()), ("o", pa.int32()), ("n", pa.int32())]))
        types = [pa.int64(), pa.int32(), pa.int32(), struct, pa.binary(), pa.bool_()]

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["key", "copy", "p", "inner", "part", "hot"])

        for whole in batches:
            for batch in rows(whole, 1 << 20, "t"):
                out: list[list] = [[] for _ in types]
                held = 0
                for ask, text in zip(batch.column(0).to_pylist(), texts(batch, "t"), strict=True):
                    for x in ask:
                        for column, y in zip(out, (x["key"], x["copy"], x["p"], x["inner"], text[x["a"] : x["a"] + x["n"]], x["hot"]), strict=True):
                            column.append(y)
                        held += x["n"]
                        if held > 4 << 20:  # the pieces of a long text are handed on bit by bit
                            yield packed(out)
                            out, held = [[] for _ in types], 0
                yield packed(out)

    return source.mapInArrow(run, f"key long, copy int, p int, inner {INNER}, part binary, hot boolean")


def _expanded(fetched: DataFrame, volume: int, length: int) -> DataFrame:
    """mini, seg, ranges of the kinds of whose windows any repeats: the transform of each shard decides. Hot pieces come back as they are: mini, seg, p, part."""
    shards = max(1, -(-volume // SHARD_BYTES))
    kinds = [("mini", pa.int64()), ("seg", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("p", pa.int32()), ("part", pa.binary())]

    def expand(part: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in kinds]
        copy, inner, parts = (part.column(c).to_pylist() for c in ("copy", "inner", "part"))
        if part.column("hot")[0].as_py():
            for own, p, body in zip(inner, part.column("p").to_pylist(), parts, strict=True):
                for column, x in zip(out, (own[0]["mini"], own[0]["seg"], None, p, body), strict=True):
                    column.append(x)
        else:
            for own, found in zip(inner, repeats(parts, length), strict=True):
                if not own or not len(found):
                    continue
                low = np.searchsorted(found, [x["o"] for x in own]).tolist()
                high = np.searchsorted(found, [x["o"] + x["n"] - length for x in own], side="right").tolist()
                for x, a, b in zip(own, low, high, strict=True):
                    if b > a:
                        whole = b - a == x["n"] - length + 1
                        ranges = [{"a": 0, "b": x["n"]}] if whole else _runs(found[a:b] - x["o"], length)
                        for column, y in zip(out, (x["mini"], x["seg"], ranges, None, None), strict=True):
                            column.append(y)
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds, out, strict=True)})

    # Hot pieces are spread evenly; the others meet by their key.
    place = F.struct("hot", F.pmod(F.when(F.col("hot"), F.xxhash64("part")).otherwise(F.xxhash64("key")), F.lit(shards)))
    dealt = fetched.select("copy", "inner", "part", "p", "hot", place.alias("shard"))
    return dealt.groupBy("shard").applyInArrow(expand, f"mini long, seg long, ranges {RANGES}, p int, part binary")


def _halved(hot: DataFrame, length: int) -> DataFrame:
    """The pieces of hot minimizers, whose offsets in the window are ``least`` to ``most``, parted at the middle offset.

    Every window of a half holds the bytes from ``least`` before the minimizer
    to ``length`` less ``most`` after it; their hash is the new key. A half is a
    new kind (key, own) with its place in the old one: mini, seg, o.
    """

    def run(batches):
        hash64 = xxhash.xxh3_64_intdigest
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        for whole in batches:
            for batch in rows(whole, 1 << 20, "part"):
                out: list[list] = [[] for _ in types]
                columns = [batch.column(c).to_pylist() for c in range(6)]
                for p, mini, seg, part, low, high in zip(*columns, strict=True):
                    middle = (low + high) // 2
                    for least, most in ((low, middle), (middle + 1, high)):
                        near, far = max(least, p - len(part) + length), min(most, p)
                        if near > far:
                            continue
                        own = part[p - far : p - near + length]
                        context = part[p - least : p - most + length]
                        got = (_signed(hash64(context, least << 8 | most)), _signed(hash64(own, far)), mini, seg, p - far, far, own, least, most)
                        for column, x in zip(out, got, strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["key", "own", "mini", "seg", "o", "p", "part", "least", "most"])

    return hot.select("p", "mini", "seg", "part", "least", "most").mapInArrow(run, "key long, own long, mini long, seg long, o int, p int, part binary, least int, most int")


def _of_hot(hot: DataFrame, widest: int, length: int) -> DataFrame:
    """mini, seg, ranges of the kinds of hot minimizers (mini, seg, p, part), from halves that fit a shard; at most log2 of ``widest`` rounds."""
    left, rounds = hot.withColumns({"least": F.lit(0), "most": F.lit(widest)}), []
    while not left.isEmpty():
        halves = cut(_halved(left, length))
        at = F.struct("mini", "seg", "o", "p", "part", "least", "most")
        kinds = halves.groupBy("key", "own").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("k"))
        sides = F.array(F.struct(F.lit(0).alias("copy"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("copy"), F.col("hi").alias("at")))
        each = kinds.select("key", "own", F.explode(F.when(F.col("k") > 1, sides).otherwise(F.slice(sides, 1, 1))).alias("e"))
        inner = F.array(F.struct(F.col("key").alias("mini"), F.col("own").alias("seg"), F.lit(0).alias("o"), F.octet_length("e.at.part").alias("n")))
        pieces = cut(each.select("key", "own", F.col("e.copy").alias("copy"), "e.at.p", inner.cast(INNER).alias("inner"), "e.at.part", "e.at.least", "e.at.most", F.lit(False).alias("hot")))
        # At a single offset the windows of one context are one string, and nothing is left to halve.
        crowded = cut(pieces.where("copy = 0 and least < most").groupBy("key").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > HOT).select("key"))
        plain = pieces.join(crowded, "key", "left_anti")
        found = _expanded(plain, pieces.agg(F.sum(F.octet_length("part"))).first()[0] or 0, length)
        rounds.append((halves.select("key", "own", "mini", "seg", "o"), cut(found.select(F.col("mini").alias("key"), F.col("seg").alias("own"), "ranges"))))
        left = cut(pieces.join(crowded, "key", "left_semi").select(F.col("key").alias("mini"), F.col("own").alias("seg"), "p", "part", "least", "most"))
    answers = None
    for halves, found in reversed(rounds):
        if answers is not None:
            found = found.unionByName(answers.select(F.col("mini").alias("key"), F.col("seg").alias("own"), "ranges"))
        shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("o")).alias("a"), (r["b"] + F.col("o")).alias("b"))).cast(RANGES)
        answers = halves.join(found, ["key", "own"]).select("mini", "seg", shifted.alias("ranges"))
    return answers


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """i, h (hashes of id and text), ranges: the removed byte ranges, merged, of the rows that have any."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = _keyed(docs, id_col, text_col)
    # Cut before each join, so that it has plain exchanges on both sides and a hot minimizer can be split.
    twice = cut(_minimizers(keyed, length).groupBy("mini").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mini"))
    free(spark)
    shared = cut(_segments(keyed, id_type, length).join(twice, "mini", "left_semi"))
    del twice
    free(spark)
    # Of each kind its first and last occurrence, (id, h, w) and (id2, h2, w2), by an order of texts and places in them in one number,
    # so that neighbouring kinds in the same texts choose the same two, and all that is compared fits a hash table.
    order = F.shiftleft(F.shiftright(F.xxhash64("id", "h"), 31), 31).bitwiseOR(F.shiftright("w", _A))
    one, two = lambda c, by: F.min_by(c, by).alias(c), lambda c, of, by: F.max_by(of, by).alias(c)
    placed = shared.withColumn("o", order)
    kinds = cut(
        placed.groupBy("mini", "seg").agg(
            F.count(F.lit(1)).alias("k"), F.min("o").alias("o"), one("id", "o"), one("h", "o"), one("w", "o"), F.max("o").alias("o2"), two("id2", "id", "o"), two("h2", "h", "o"), two("w2", "w", "o")
        )
    )
    # By minimizer: the number of its kinds, and likewise the first and last place with their kinds.
    firsts = [one(c, "o") for c in ("id", "h", "w", "seg")]
    lasts = [two(c, of, "o2") for c, of in (("id2", "id2"), ("h2", "h2"), ("w2", "w2"), ("seg2", "seg"))]
    buckets = cut(kinds.groupBy("mini").agg(F.count(F.lit(1)).alias("d"), F.sum("k").alias("k"), *firsts, *lasts))
    free(spark)
    # Two kinds are two places, unless their order is a tie.
    paired = (F.col("d") == 1) | ((F.col("d") == 2) & (F.col("k") == 2) & (F.col("seg") != F.col("seg2")))
    crowds = buckets.where(~paired).select("mini", (F.col("d") > HOT).alias("hot"))
    others = cut(kinds.join(cut(crowds), "mini"))
    size = _place(F.col("w"))[1]
    # Joined segments hold a byte about four times less often than their sum says.
    volume = (buckets.where(paired).agg(F.sum(size / 2)).first()[0] or 0) + (others.agg(F.sum(size * F.least("k", F.lit(2)))).first()[0] or 0)
    pieces = _stretches(buckets.where(paired), id_type, length).unionByName(_single(others))
    covered = cut(_expanded(_fetch(pieces, keyed, length), int(volume), length))
    del kinds, buckets, others, pieces
    free(spark)
    hot = covered.where("part is not null").select("mini", "seg", "p", "part")
    flagged = covered.where("part is null").select("mini", "seg", "ranges")
    if not hot.isEmpty():
        flagged = cut(flagged.unionByName(_of_hot(hot, length - GRAM, length)))
    a = _place(F.col("w"))[0]
    hits = shared.join(flagged, ["mini", "seg"]).select(F.xxhash64("id").alias("i"), "h", a.alias("at"), F.explode("ranges").alias("r"))
    # Repeated rows of one id and text add nothing: made one before they meet.
    once = hits.groupBy("i", "h", (F.col("r.a") + F.col("at")).alias("a")).agg(F.max(F.col("r.b") + F.col("at")).alias("b"))
    runs = once.repartition("i", "h").sortWithinPartitions("i", "h", "a").mapInArrow(_joined_runs, "i long, h long, a int, b int")
    out = cut(runs.groupBy("i", "h").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges")))
    del shared, placed, covered, hot, flagged, hits, once, runs
    free(spark)
    return out


def _joined_runs(batches):
    """Maximal runs of ranges (i, h, a, b) that come sorted by (i, h, a); a run may go on in the next batch, and is handed on when it ends."""
    names = ["i", "h", "a", "b"]
    held = None
    for batch in batches:
        if not len(batch):
            continue
        i, h, a, b = (batch.column(c).to_numpy() for c in names)
        if held is not None:
            i, h, a, b = (np.concatenate([[x], y]) for x, y in zip(held, (i, h, a, b), strict=True))
        text = np.concatenate([[0], np.cumsum((i[1:] != i[:-1]) | (h[1:] != h[:-1]))])
        # The furthest end so far, of this text alone: a text's number outweighs all ends.
        end = np.maximum.accumulate(text << 32 | b.astype(np.int64))
        new = np.concatenate([[True], (text << 32 | a.astype(np.int64))[1:] > end[:-1]])
        first = np.flatnonzero(new)
        stop = np.concatenate([first[1:], [len(i)]]) - 1
        columns = [i[first], h[first], a[first], (end[stop] & 0xFFFFFFFF).astype(np.int32)]
        held = [c[-1] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], t) for x, t in zip(held, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_spans: bool = True) -> DataFrame:
    """Every row's id, n_bytes, n_removed, n_spans and kept_sha256; with ``with_spans`` also the removed spans and the remaining bytes."""
    id_type = docs.schema[id_col].dataType.simpleString()
    ranges = repeated_ranges(docs, id_col, text_col, length)
    keyed = _keyed(docs, id_col, text_col)
    joined = keyed.join(ranges, ["i", "h"], "left").select("id", "ranges", "t")
    schema = f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + f", spans {RANGES}, kept binary" * with_spans

    def run(batches):
        for whole in batches:
            for batch in rows(whole, name="t"):
                out: list[list] = [[] for _ in range(6)]
                for found, text in zip(batch.column(1).to_pylist(), texts(batch, "t"), strict=True):
                    spans = [(r["a"], r["b"]) for r in found or ()]
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(text[at:a])
                        at = b
                    rest = b"".join([*kept, text[at:]])
                    got = (len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"a": a, "b": b} for a, b in spans], rest)
                    for column, x in zip(out, got, strict=True):
                        column.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()]
                names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 7 if with_spans else 5]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))][: len(names)], names)

    return joined.mapInArrow(run, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_spans=False)
