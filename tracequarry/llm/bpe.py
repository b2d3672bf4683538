"""Byte-pair encoding and decoding with a public vocabulary file.

Encoding keeps the symbols of a word in a doubly linked list and the ranks of
adjacent pairs in a priority queue; an entry whose symbols have changed since
it was pushed is skipped. Decoding concatenates vocabulary strings. Words repeat,
so each worker remembers the encoded form of up to ``CACHE`` words, of
``CACHE_BYTES`` altogether.

Case and classes of characters come from Python's tables where these know the
character; a text with others is lowered and parted by the tables of the
tokenizers library, which may be of another version.

Defined cases: a null text is empty, and an empty text has no tokens and
decodes to ''; a symbol outside the vocabulary is left out (the file names no
unknown token); the strings of special tokens in a text become those tokens;
repeated rows are each encoded; an empty table gives an empty result; extra
columns are ignored; a very long text is one list of words, and a word of any
length is merged in the order of its queue.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import rows, table

CACHE, CACHE_BYTES = 600_000, 96 << 20
#: Unicode white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def _unknown(word: str) -> bool:
    """Whether Python's tables lack one of the characters."""
    return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)


def _lower(text: str) -> str:
    """Lower case character by character, without the rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class BytePairs:
    """A vocabulary with merge ranks, read from a tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in [*ids.items(), *self.special.items()]}
        self.chars = _byte_chars()
        # White space only parts words, so runs of it need no folding first.
        self.words = regex.compile(rf"\p{{L}}+|'(?:s|t|re|ve|m|ll|d)|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, str, str]] = {}
        self.held = 0
        self.spec, self.library = spec, None

    @classmethod
    def load(cls, path: str) -> BytePairs:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: str) -> list[int]:
        """Token ids of one word."""
        symbols = [self.chars[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get, pop, push = self.merges.get, heapq.heappop, heapq.heappush
        queue = [(found[0], k, pair, found[1]) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := get(pair))]
        heapq.heapify(queue)
        while queue:
            _, left, pair, joined = pop(queue)
            right = after[left]
            if right < 0 or ids[left] != pair[0] or ids[right] != pair[1]:
                continue  # stale: one of the two has been merged meanwhile
            ids[left], ids[right] = joined, -1
            beyond, ahead = after[right], before[left]
            after[left] = beyond
            if beyond >= 0:
                before[beyond] = left
                if found := get(pair := (joined, ids[beyond])):
                    push(queue, (found[0], left, pair, found[1]))
            if ahead >= 0 and (found := get(pair := (ids[ahead], joined))):
                push(queue, (found[0], ahead, pair, found[1]))
        return [i for i in ids if i >= 0]

    def _entry(self, word: str) -> tuple[int, str, str]:
        ids = self.merge(word)
        found = (len(ids), " ".join(map(str, ids)), " ".join(self.strings[i] for i in ids))
        size = len(word) + len(found[1]) + len(found[2])
        if len(self.known) >= CACHE or self.held + size > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        # A word that is remembered has no unknown character, so only new words need be looked at.
        if size <= CACHE_BYTES // 16 and not _unknown(word):
            self.known[word] = found
            self.held += size
        return found

    def _library_words(self, part: str) -> list[str]:
        """The words of a text without special tokens, lowered and parted by the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
        clean = self.library.normalizer.normalize_str(part)
        return [clean[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def pieces(self, text: str):
        """(number of tokens, ids, token strings) of each word or special token in turn, joined by one space."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield 1, str(self.special[part]), part
            elif part:
                words = self.words.findall(_lower(part if part.isascii() else unicodedata.normalize("NFC", part)))
                looked = list(map(self.known.get, words))
                if None in looked and not part.isascii() and any(found is None and _unknown(word) for word, found in zip(words, looked, strict=True)):
                    words = self._library_words(part)
                    looked = list(map(self.known.get, words))
                for word, found in zip(words, looked, strict=True):
                    found = found or self._entry(word)
                    if found[0]:
                        yield found

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: vocabulary strings, one space between them."""
        return " ".join(self.strings[i] for i in ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids, their number and hashes of ids and decoded text. ``path``: a tokenizer file that is installed on the executors."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        model = BytePairs.load(path)
        for whole in batches:
            for batch in rows(whole, name="t"):
                n, hashed, decoded, ids = [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = list(model.pieces(text or ""))
                    line = " ".join([x[1] for x in found])
                    n.append(sum([x[0] for x in found]))
                    hashed.append(hashlib.sha256(line.encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join([x[2] for x in found]).encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        ids.append([int(i) for i in line.split()])
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr(f"`{id_col}`", f"cast(`{text_col}` as string) t").mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), path or str(public_tokenizers.path("word_bpe_49k.json")), with_ids=False)
