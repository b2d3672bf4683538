"""Secret spans in whole texts: three fixed patterns, and credential values judged by their guess cost.

A value in a wider credential context (a key word, an optional sign, a value)
that no single span of the fixed patterns covers whole is segmented by dynamic programming into
dictionary words, dates, repeats, keyboard walks and brute-force spans; the
cheapest segmentation is what a guesser would need, in bits. A value that costs
at least ``MIN_BITS`` is reported as kind ``guess``, however short or long it is.

The dictionary is a ranked word list: the fixed pass words, then, where a
vocabulary file is named, the whole words of that file in its own order, which
is that of their frequency. The file is installed on the executors.

Defined cases: a null or empty text has no spans; spans are code points, end
exclusive; spans of different kinds may overlap; repeated rows are each
scanned; an empty table gives an empty result; extra columns are ignored; a
very long text or value is scanned whole (the search ends at ``MIN_BITS``).
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import rows, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
#: Contexts of the guess-cost search: more key words, and white space alone as the sign after a scheme's name; a value has no upper bound.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key)["']?\x20*(?:[:=]|\x20is\x20|=>)\x20*["']?(?:(?:bearer|basic)\x20+)?|bearer\x20+(?=[^\s"',;]*\d))([^\s"',;]+)""",
    re.ASCII | re.IGNORECASE,
)
MIN_BITS = 28.0

# Common pass words and the rows of a keyboard.
WORDS = """password pass word admin root user login welcome letmein secret token test example changeme default qwerty monkey dragon
master hello shadow sunshine princess football baseball iloveyou love abc access key api private public value name none null true false
your here insert todo the and for with this that from have""".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "~!@#$%^&*()_+", "7894561230")
LEET = str.maketrans("013457$@!", "oleastsai")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")

#: Words of a vocabulary file that count, by length; shorter ones are no cheaper than their letters.
SHORTEST, LONGEST = 3, 24
#: Characters before the end of their run at which repeats and walks may stop, so that what follows can begin inside it.
STOP = 32
_NEXT = {(a, b) for row in KEYBOARD for line in (row, row[::-1]) for a, b in zip(line, line[1:], strict=False)}


def _brute(c: str) -> float:
    """Bits of one character of its class."""
    size = 10 if c.isdigit() else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c.isascii() else 100
    return math.log2(size)


def ranked_words(path: str | None = None) -> dict[str, int]:
    """Rank of each dictionary word, from 1: WORDS, then the whole words of a vocabulary file in the order of their numbers."""
    words = list(WORDS)
    if path:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix") or ""
        whole = (w[: len(w) - len(end)].lower() for w in sorted(model["vocab"], key=model["vocab"].get) if w.endswith(end))
        words += [w for w in whole if w.isascii() and w.isalpha() and SHORTEST <= len(w) <= LONGEST]
    return {w: k + 1 for k, w in enumerate(dict.fromkeys(words))}


FIXED = ranked_words()


def guess_bits(value: str, enough: float = math.inf, ranks: dict[str, int] = FIXED) -> float:
    """Bits of the cheapest segmentation of ``value`` by dynamic programming over its prefixes; '' costs nothing.

    Ends early, with ``enough``, once no prefix under it is left to go on from.
    """
    n = len(value)
    low = value.lower()
    low = low if len(low) == n else value  # a letter whose lower case is longer
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    walked = [-1] * (n + 1)  # the end of the keyboard walk that is the best way here
    far = 0  # the last prefix that costs less than enough
    unlike = [-1] * 9  # by width: the first place, from here on, that differs from the one a width later
    walk = 0

    for i in range(n):
        if far < i:
            return enough
        if best[i] >= enough:
            continue
        here = best[i] + 1.0  # the choice of a segment kind

        def reach(j: int, bits: float, end: int = -1) -> None:
            nonlocal far
            if bits < best[j]:
                best[j], walked[j] = bits, end
                if bits < enough and j > far:
                    far = j

        reach(i + 1, best[i] + _brute(value[i]))
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            if (rank := ranks.get(low[i:j])) is not None:
                reach(j, here + math.log2(rank + 1) + (low[i:j] != value[i:j]))
            elif (rank := ranks.get(plain[i:j])) is not None:
                reach(j, here + math.log2(rank + 1) + 2)
        if value[i].isdigit() and (m := DATE.match(value, i)):
            reach(m.end(), here + (math.log2(365 * 120) if m.end() - i > 4 else math.log2(120)))
        if walk <= i:
            walk = i + 1
            while walk < n and (low[walk - 1], low[walk]) in _NEXT:
                walk += 1
        if walked[i] != walk:  # a walk cut in two costs more than the whole
            for j in range(max(i + 3, walk - STOP), walk + 1):
                reach(j, here + math.log2(len(_NEXT)) + math.log2(j - i), walk)
        for width in range(1, min(8, (n - i) // 2) + 1):
            if unlike[width] < i:
                k = i
                while k + width < n and value[k] == value[k + width]:
                    k += 1
                unlike[width] = k
            times = 1 + (unlike[width] - i) // width
            if times > 1:
                unit = here + sum(map(_brute, value[i : i + width]))
                for t in range(max(2, times - STOP // width), times + 1):
                    if t * width >= 3:
                        reach(i + t * width, unit + math.log2(t))
    return best[n]


def scan(text: str, min_bits: float = MIN_BITS, ranks: dict[str, int] = FIXED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, further spans), each (start, kind number, end) in order."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        if not any(s <= a and b <= e for s, _, e in base) and guess_bits(m[1], min_bits, ranks) >= min_bits:
            more.append((a, 3, b))
    return base, more


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS, words_path: str | None = None) -> DataFrame:
    """Counts, the digest of the base spans, all spans as text and, as ``found``, each with its matched text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,value:string>>"

    def run(batches):
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), item]
        ranks = ranked_words(words_path)
        for whole in batches:
            for batch in rows(whole, name="t"):
                out: list[list] = [[] for _ in types]
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    base, more = scan(text, min_bits, ranks)
                    every = sorted(base + more)
                    counts = [sum(k == j for _, k, _ in every) for j in range(4)]
                    values = [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in every]
                    for column, x in zip(out, [*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), values], strict=True):
                        column.append(x)
                names = [id_col, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "found"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, types)], names)

    return docs.selectExpr(f"`{id_col}`", f"cast(`{text_col}` as string) t").mapInArrow(run, schema)


def op2_secrets(spark: SparkSession, sf_dir: str, words_path: str | None = None) -> DataFrame:
    import public_tokenizers

    found = secret_spans(table(spark, sf_dir, "documents"), words_path=words_path or str(public_tokenizers.path("word_bpe_49k.json")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")
