"""BPE encoding and decoding with a public vocabulary of words with word ends.

A pre-token is merged in a contiguous rank array: its part boundaries and the ranks of adjacent
parts lie side by side, the array is scanned for the smallest rank, that boundary is deleted and
the ranks of its neighbours are looked up again.  Pre-tokens too long for repeated scans keep
the same ranks in a heap.  Each task keeps the codes of the pre-tokens it has met, in a table of
bounded size.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import lean, slices, texts

# Fixed values of the tokenizer file's format: contractions, letters, single numbers, other signs.
# The alternatives start with different characters, so the frequent ones come first.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^" + _SPACE + r"\p{L}\p{N}]+")
# The same for texts below U+0250, with the letters and numbers of that range spelled out.
_LATIN = "a-zªµºß-öø-ÿĀ-\u024f"
_LATIN_SPLIT = re.compile(f"[{_LATIN}]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\\t-\\r \x85\xa0{_LATIN}0-9²³¹¼-¾]+")
_BEYOND_LATIN = re.compile("[^\0-\u024f]")
_ASCII_SPLIT = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-z0-9]+")
SCAN_PARTS = 96  # parts above which the ranks of a pre-token go to a heap
CACHE = 250_000  # pre-tokens whose codes a task keeps
_WIDE = 24  # bits of an id
_ID = (1 << _WIDE) - 1
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves and the others take letters from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


_unknown: list[np.ndarray] = []


def _new_letters(text: str) -> bool:
    """Whether a text has a code point that Python's Unicode tables do not know."""
    if not _unknown:
        _unknown.append(np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)]))
    return bool(_unknown[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


class Vocabulary(dict):
    """Codes of pre-tokens as packed ids; a missing pre-token is merged and, while there is room, kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.letter = [ids[c] for c in byte_letters()]
        self.last = [ids[c + end] for c in byte_letters()]
        self.merges = {}  # pair -> rank and id in one number, ordered by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << _WIDE | ids[b]] = rank << _WIDE | ids[a + b]
        self.path, self.library = path, None
        self.names = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for name, i in [*ids.items(), *self.added.items()]:
            self.names[i] = name

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        parts = [self.letter[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        parts = self.scan(parts) if len(parts) <= SCAN_PARTS else self.heap(parts)
        code = struct.pack(f"<{len(parts)}I", *parts)
        if len(word) <= SCAN_PARTS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = code
        return code

    def scan(self, parts: list[int]) -> list[int]:
        """Merge by repeated scans of the contiguous ranks."""
        get = self.merges.get
        ranks = [get(a << _WIDE | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least & _ID
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << _WIDE | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << _WIDE | parts[i], _NONE)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long pre-token: ranks in a heap, neighbours by links."""
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i in range(n - 1) if (r := get(parts[i] << _WIDE | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or get(parts[i] << _WIDE | parts[j]) != r:
                continue
            parts[i] = r & _ID
            parts[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := get(parts[a] << _WIDE | parts[after[a]], _NONE)) != _NONE:
                    heapq.heappush(waiting, (r, a))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        out = []
        for piece in self.at_added.split(text):
            found = self.added.get(piece)
            out.append(self._plain(piece) if found is None else found.to_bytes(4, "little"))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = _ASCII_SPLIT.findall(text.lower())
        else:
            plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no rule for final sigma
            if not _BEYOND_LATIN.search(plain):
                words = _LATIN_SPLIT.findall(plain)
            else:
                words = self.library_words(text) if _new_letters(text) else _SPLIT.findall(plain)
        return b"".join(map(self.__getitem__, words))

    def library_words(self, text: str) -> list[str]:
        """Pre-tokens of a text with code points that are newer than Python's tables.

        Which of them are letters, and how they are lowered, depends on the tables inside the tokenizers
        library, so it is asked.
        """
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        named = dict(zip(byte_letters(), range(256)))
        return [
            bytes(named[c] for c in word).decode() for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)
        ]

    def decode(self, ids: bytes) -> str:
        """Names of the tokens, special ones included, with spaces between; ids out of range name nothing."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(names)])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _over(docs: DataFrame, column: str, name: str, kind: T.DataType, each) -> DataFrame:
    """Add ``name = each(value)`` in Arrow batches of bounded size."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = each(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the tokens of every whole text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens; columns that are there stay, and an existing column
    named ``ids`` is an error.
    """
    def each(column):
        known = vocabulary(path)
        return pa.array([known.encode(t) for t in texts(column)], pa.binary())

    return _over(docs, text, ids, T.BinaryType(), each)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the token names of ``ids`` joined by spaces; null ids decode to the empty text."""
    def each(column):
        known = vocabulary(path)
        return pa.array([known.decode(b or b"") for b in column.to_pylist()], pa.string())

    return _over(docs, ids, text, T.StringType(), each)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass over the rows: the text goes to Python and is not sent back.

    Columns named ``ids`` and ``decoded`` are replaced, others but the text stay.
    """
    kept = [c for c in docs.columns if c not in (text, ids, decoded)]
    docs = docs.select(*kept, text)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in slices(batches):
            codes = [known.encode(t) for t in texts(batch.column(batch.schema.get_field_index(text)))]
            values = [pa.array(codes, pa.binary()), pa.array([known.decode(c) for c in codes], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), *values], names=[*kept, ids, decoded]
            )
        known.clear()  # the worker lives on, and later stages need its memory

    return docs.mapInArrow(lean(run), schema)


def digests(encoded: DataFrame, *kept: str) -> DataFrame:
    """Number of tokens and digests of packed ids and decoded texts."""
    return encoded.select(
        *kept,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
