"""Exact repeated strings by suffix arrays, for texts spread over a cluster.

A string of ``length`` bytes is routed by its anchor: the place in it whose next ``ANCHOR``
bytes have the smallest hash.  Equal strings have equal anchors at equal places, so all copies
of a string meet under one key, wherever they stand.  Consecutive starts with one anchor form
a segment, and a text is cut into a few segments a kilobyte.

Equal segments are counted by hash.  Distinct segments of one key are put into a suffix array
in two stages: suffixes smaller than their successor are sorted directly, the others are induced
by scans over the buckets of first bytes.  Starts whose adjacent common prefix, counted in bytes,
reaches ``length`` are repeated.  Keys with too many distinct segments for one array have each of their strings
counted by a 128-bit hash instead, as rows that any number of tasks share.

Strings of words are found the same way in the 64-bit codes of a text's words; those of one key are compared by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, give_back, lean, row_key, saved, slices

ANCHOR = 128
ARRAY_BYTES = 512 << 10  # bytes that one suffix array takes
KEY_BYTES = 256 << 10  # bytes of distinct segments of one key above which its strings are counted by hash
PIECE = 1 << 20  # bytes of a text that are cut into segments at once
LEAP = 64
BROADCAST_ROWS = 2_000_000  # keys of rows up to which they are sent, so that only the texts they name are shuffled
_END = 255  # never part of UTF-8
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _codes(data: np.ndarray, seed: int) -> np.ndarray:
    """A number for each byte, or for each 64-bit word code, that the seed chooses."""
    if data.dtype == np.uint8:
        return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64)[data]
    out = (data ^ np.uint64(_MIX[0] * seed & (1 << 64) - 1)) * np.uint64(_MIX[1])
    return (out ^ (out >> np.uint64(29))) * np.uint64(_MIX[2])


def gram_hashes(data: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes or word codes, by doubling; ``size`` may be any number."""
    have = _codes(data, seed)
    have_size, out, out_size = 1, None, 0
    while True:
        if size & have_size:
            out, out_size = _joined(out, out_size, have), out_size + have_size
        if 2 * have_size > size:
            break
        have = _joined(have, have_size, have)
        have_size *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(_MIX[1])
    return out ^ (out >> np.uint64(29))


def _joined(a: np.ndarray | None, size: int, b: np.ndarray) -> np.ndarray:
    """Hashes of a string of ``size`` bytes followed by that of another hash."""
    if a is None:
        return b
    n = min(len(a), len(b) - size)
    out = (a[: max(0, n)] ^ (a[: max(0, n)] >> np.uint64(31))) * np.uint64(_MIX[0])
    return out + b[size : size + max(0, n)] * np.uint64(_MIX[2] + 2 * size)


def segments(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash of the anchor, first start, last start)`` of the runs of starts that have one anchor.

    The first of equally small hashes is the anchor, which depends on the string alone.
    """
    starts, anchors, keys = [], [], []
    total = len(data) - length + 1
    for at in range(0, max(0, total), PIECE):
        part = data[at : min(len(data), at + PIECE + length - 1)]
        hashes = gram_hashes(part, anchor)
        width = length - anchor + 1
        # Minima over windows by doubling, which keep the first place of the least hash.
        place, size = np.arange(len(hashes)), 1
        while 2 * size <= width:
            a, b = place[:-size], place[size:]
            place, size = np.where(hashes[b] < hashes[a], b, a), 2 * size
        a, b = place[: len(hashes) - width + 1], place[width - size : width - size + len(hashes) - width + 1]
        place = np.where(hashes[b] < hashes[a], b, a)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        starts.append(first + at)
        anchors.append(place[first] + at)
        keys.append(hashes[place[first]])
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, anchors, keys = map(np.concatenate, (starts, anchors, keys))
    new = np.concatenate([[True], anchors[1:] != anchors[:-1]])  # a run may go on in the next piece
    starts, keys = starts[new], keys[new]
    return keys, starts, np.concatenate([starts[1:], [total]]) - 1


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least; ``data`` ends with its largest byte, 255."""
    n = len(data)
    # A suffix is smaller than its successor if its next differing byte is larger; the last one counts as larger.
    change = np.flatnonzero(data[1:] != data[:-1])
    up = np.zeros(n, bool)
    if len(change):
        next_change = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
        inside = np.arange(n) <= change[-1]
        up[inside] = data[next_change[inside] + 1] > data[next_change[inside]]
    words = np.concatenate([_words(data), np.zeros(depth + 8, np.uint64)])
    leap = _prefix_hashes(data, LEAP, 4)
    small = _sorted_directly(words, leap, _prefix_hashes(data, depth, 2), np.flatnonzero(up), depth)
    small_by = np.searchsorted(data[small], np.arange(257))
    # Bucket scans: the larger suffixes of a bucket are the predecessors of what stands in this
    # and the earlier buckets, in the order in which these stand.
    queued: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(data, minlength=256)):
        if c == data[-1]:
            queued[c].insert(0, np.array([n - 1]))
        large = queued[c]
        level = np.concatenate(large) if large else np.zeros(0, np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            before = level - 1
            before = before[before >= 0]
            level = before[(data[before] == c) & ~up[before]]
        placed = np.concatenate([*bucket, small[small_by[c] : small_by[c + 1]]])
        out.append(placed)
        before = placed - 1
        before = before[before >= 0]
        before = before[(data[before] > c) & ~up[before]]
        if len(before):
            order = np.argsort(data[before], kind="stable")
            before = before[order]
            cuts = np.flatnonzero(np.diff(data[before])) + 1
            for part in np.split(before, cuts):
                queued[data[part[0]]].append(part)
    return np.concatenate(out)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one big-endian number; past the end stand zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = padded[: len(data)].copy()
    for i in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[i : i + len(data)]
    return out


def _sorted_directly(words: np.ndarray, leap: np.ndarray, same: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes, eight at a time; only ties are looked at again.

    ``same`` is a hash of the first ``depth`` bytes: of suffixes that agree in all of them one is
    sorted and the others stand beside it.  ``leap`` is a hash of ``LEAP`` bytes, which ties that agree in them skip.
    """
    _, first, of = np.unique(same[suffixes], return_index=True, return_inverse=True)
    one = suffixes[first]
    place = np.argsort(words[one], kind="stable")  # of the ones, in order
    value = words[one[place]]
    again = np.concatenate([[False], value[1:] == value[:-1]])[: len(one)]
    group = np.maximum.accumulate(np.where(again, 0, np.arange(len(one))))  # a tie is named by its first place
    tied = np.flatnonzero(again | np.concatenate([again[1:], [False]])[: len(one)])
    at = np.full(len(tied), 8)  # bytes in which a tie agrees; the same for all of it
    while len(tied):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(group[tied]) != 0]))
        size = np.diff(np.concatenate([starts, [len(tied)]]))
        far = leap[np.minimum(one[place[tied]] + at, len(leap) - 1)]
        agree = np.repeat(~np.logical_or.reduceat(far != np.repeat(far[starts], size), starts), size)
        at[agree] += LEAP
        pick = np.flatnonzero(~agree)
        if len(pick):
            here = tied[pick]
            value = words[one[place[here]] + at[pick]]
            order = np.lexsort((value, group[here]))
            place[here] = place[here][order]
            value, own = value[order], group[here]  # groups keep their places
            new = np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])])
            group[here] = here[np.maximum.accumulate(np.where(new, np.arange(len(here)), 0))]
            at[pick] += 8
            done = np.zeros(len(tied), bool)
            done[pick] = new & np.concatenate([new[1:], [True]])
        else:
            done = np.zeros(len(tied), bool)
        stay = ~done & (at < depth)
        tied, at = tied[stay], at[stay]
    rank = np.empty(len(one), np.int64)
    rank[place] = np.arange(len(one))
    return suffixes[np.argsort(rank[of], kind="stable")]


def _prefix_hashes(data: np.ndarray, depth: int, seed: int) -> np.ndarray:
    """A hash of the ``depth`` bytes at every place; past the end stand zeros."""
    return gram_hashes(np.concatenate([data, np.zeros(depth - 1, np.uint8)]), depth, seed)


def adjacent_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``; beyond ``most`` at least that many are counted.

    Neighbours are followed through the text: where the suffixes one byte on are neighbours too, they
    share one byte less, so bytes are compared only where such a chain begins.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], n - 1
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] == before[:-1] + 1) & (data[before[1:] - 1] == data[:-1])
    starts = np.flatnonzero(~chained)
    reach = np.diff(np.concatenate([starts, [n]])) + most
    words = np.concatenate([_words(data), np.zeros(8, np.uint64)])
    shared, alive = np.zeros(len(starts), np.int64), np.arange(len(starts))
    while len(alive):
        a, b = starts[alive] + shared[alive], before[starts[alive]] + shared[alive]
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = differ == 0
        # The first differing byte of a word is the highest that is not zero in the difference.
        last = differ[~same]
        bits = np.frexp((last >> np.uint64(32)).astype(np.float64))[1]
        low = np.frexp((last & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        shared[alive[~same]] += np.where(bits > 0, (32 - bits) // 8, 4 + (32 - low) // 8)
        alive = alive[same]
        shared[alive] += 8
        alive = alive[(shared[alive] < reach[alive]) & (np.maximum(starts[alive], before[starts[alive]]) + shared[alive] < n)]
    counts = np.repeat(shared, np.diff(np.concatenate([starts, [n]]))) - (np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]]))))
    counts = np.minimum(counts, n - np.maximum(before, np.arange(n)))
    counts[order[0]] = 0
    return counts[order]


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts in each part whose next ``length`` bytes start anywhere else in the parts too."""
    data = np.frombuffer(bytes([_END]).join(parts) + bytes([_END]), np.uint8)
    order = suffix_array(data, length)
    same = adjacent_prefixes(data, order, length) >= length
    flagged = np.zeros(len(data), bool)
    flagged[order[same]] = True
    flagged[order[:-1][same[1:]]] = True
    out, at = [], 0
    for part in parts:
        out.append(np.flatnonzero(flagged[at : at + max(0, len(part) - length + 1)]))
        at += len(part) + 1
    return out


def _spans(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Maximal ``[first, last start]`` runs of starts."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


def repeated_words(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Starts in each part of word codes whose next ``length`` words, by 128 bits, start anywhere else in the parts too."""
    grams = [(gram_hashes(p, length, 2), gram_hashes(p, length, 3)) for p in parts]
    a, b = (np.concatenate(x) for x in zip(*grams))
    order = np.lexsort((b, a))
    again = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    flagged = np.zeros(len(a), bool)
    flagged[order[1:][again]] = True
    flagged[order[:-1][again]] = True
    return [np.flatnonzero(f) for f in np.split(flagged, np.cumsum([len(x) for x, _ in grams])[:-1])]


def _bytes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def word_codes(data: bytes) -> np.ndarray:
    """Codes of a text's words; words are runs without ASCII white space, A-Z are lowered."""
    return np.fromiter(map(xxhash.xxh64_intdigest, data.lower().split()), np.uint64)


def _word_bytes(data: bytes, spans: list[dict]) -> list[dict]:
    """Spans of a text's words as spans of its bytes."""
    blank = np.ones(len(data) + 2, bool)
    raw = np.frombuffer(data, np.uint8)
    blank[1:-1] = (raw == 32) | (raw >= 9) & (raw <= 13)
    first, end = np.flatnonzero(blank[:-2] & ~blank[1:-1]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
    return [{"start": int(first[s["start"]]), "stop": int(end[s["stop"] - 1])} for s in spans]


def _occurrences(docs: DataFrame, text: str, length: int, anchor: int, coded: Callable[[bytes], np.ndarray]) -> DataFrame:
    """A row for each distinct segment of a text: key, hash of its bytes, the row it stands in, where it begins, and its last start from there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for row, data in enumerate(map(coded, byte_texts(batch.column(2)))):
                keys, first, last = segments(data, length, anchor)
                same: dict[tuple[int, int], list[int]] = {}
                reach = {}
                for key, a, b in zip(keys.view(np.int64).tolist(), first.tolist(), last.tolist()):
                    name = (key, xxhash.xxh3_64_intdigest(data[a : b + length]) - (1 << 63))
                    same.setdefault(name, []).append(a)
                    reach[name] = b - a
                for column, values in zip(out, ([k for k, _ in same], [h for _, h in same], [k1[row]] * len(same), [k2[row]] * len(same), same.values(), reach.values())):
                    column.extend(values)
            if out[0]:
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "segment", "_k1", "_k2", "firsts", "reach"])

    return docs.select(*row_key(*docs.columns), text).mapInArrow(
        lean(cut), "anchor long, segment long, _k1 long, _k2 long, firsts array<long>, reach long")


def _distinct_repeats(pieces: DataFrame, length: int, kind: type) -> DataFrame:
    """``anchor, segment, starts, stops``: runs of repeated starts in distinct segments of shared keys."""
    spec = "anchor long, segment long, starts array<long>, stops array<long>"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, size = [], [], 0
        for batch in batches:
            for anchor, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size > ARRAY_BYTES and names[-1][0] != anchor:
                    yield out(names, parts)
                    names, parts, size = [], [], 0
                names.append((anchor, segment))
                parts.append(data)
                size += len(data)
        if parts:
            yield out(names, parts)

    def out(names: list[tuple[int, int]], parts: list[bytes]) -> pa.RecordBatch:
        found = repeated_starts(parts, length) if kind is np.uint8 else repeated_words([np.frombuffer(p, kind) for p in parts], length)
        runs = [_spans(s, length) for s in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in names], pa.int64()), pa.array([s for _, s in names], pa.int64()),
             pa.array([a for a, _ in runs], pa.list_(pa.int64())), pa.array([b for _, b in runs], pa.list_(pa.int64()))],
            names=["anchor", "segment", "starts", "stops"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            for anchor, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = np.frombuffer(data, kind)
                a, b = gram_hashes(raw, length, 2), gram_hashes(raw, length, 3)
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, segment)), pa.array(np.arange(n)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    names=["anchor", "segment", "at", "h1", "h2"])

    few = pieces.where(~F.col("hot")).select("anchor", "segment", "data").repartition("anchor").sortWithinPartitions("anchor")
    strings = pieces.where("hot").select("anchor", "segment", "data").mapInArrow(lean(split), "anchor long, segment long, at long, h1 long, h2 long")
    often = strings.groupBy("h1", "h2").count().where("count > 1")
    hot = strings.join(often, ["h1", "h2"]).groupBy("anchor", "segment").agg(F.collect_list("at").alias("starts"))
    return few.mapInArrow(lean(sort), spec).unionByName(hot.select("anchor", "segment", "starts", F.col("starts").alias("stops")))


def _named(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is among ``keys`` (``left_semi``) or not (``left_anti``)."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, ["_k1", "_k2"], how)


def _marks(docs: DataFrame, text: str, length: int, anchor: int, coded: Callable[[bytes], np.ndarray], least: int) -> DataFrame:
    """``_k1, _k2, spans`` of the rows with repeated strings of ``length`` of the bytes or word codes of a text of ``least`` bytes or more."""
    found = saved(_occurrences(docs, text, length, anchor, coded), "segments")
    kind = coded(b"").dtype.type
    kinds = (
        found.groupBy("anchor", "segment")
        .agg(F.sum(F.size("firsts")).alias("n"), F.min(F.struct("_k1", "_k2", F.col("firsts")[0].alias("first"), "reach")).alias("one"))
    )
    by_key = kinds.groupBy("anchor").agg(
        F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum((F.col("one.reach") + length) * np.dtype(kind).itemsize).alias("bytes")
    ).where("all > 1").withColumnRenamed("anchor", "_anchor")
    shared = saved(
        kinds.join(by_key, F.col("anchor") == F.col("_anchor"))
        .select("anchor", "segment", "n", "one.*", "kinds", (F.col("bytes") > KEY_BYTES).alias("hot")),
        "shared",
    )
    whole = shared.where("n > 1").select(
        "anchor", "segment", F.array(F.lit(0).cast("long")).alias("starts"), F.array("reach").alias("stops")
    )
    # Keys with several distinct segments: one of each is read again.
    wanted = saved(shared.where("kinds > 1").groupBy("_k1", "_k2").agg(
        F.collect_list(F.struct("anchor", "segment", "first", "reach", "hot")).alias("wanted")
    ), "wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = [
                (w["anchor"], w["segment"], data[w["first"] : w["first"] + w["reach"] + length].tobytes(), w["hot"])
                for data, asked in zip(map(coded, byte_texts(batch.column(0))), batch.column(1).to_pylist()) for w in asked
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.bool_()))],
                names=["anchor", "segment", "data", "hot"])

    keyed = docs.select(*row_key(*docs.columns), F.col(text).alias("_text")).where(F.octet_length("_text") >= least)
    keyed = _named(keyed, wanted.select("_k1", "_k2"), "left_semi")
    pieces = saved(
        keyed.join(wanted, ["_k1", "_k2"]).select("_text", "wanted").mapInArrow(lean(read), "anchor long, segment long, data binary, hot boolean")
        .dropDuplicates(["anchor", "segment"]),
        "pieces",
    )
    runs = saved(whole.unionByName(_distinct_repeats(pieces, length, kind).where(F.size("starts") > 0)), "runs")
    marks = F.flatten(F.transform("firsts", lambda f: F.transform(
        F.arrays_zip("starts", "stops"), lambda r: F.struct((f + r["starts"]).alias("start"), (f + r["stops"] + length).alias("stop")))))
    return (
        found.join(runs, ["anchor", "segment"]).select("_k1", "_k2", marks.alias("marks"))
        .groupBy("_k1", "_k2").agg(F.sort_array(F.flatten(F.collect_list("marks"))).alias("spans"))
    )


def repeats(
    docs: DataFrame, text: str = "text", length: int = 400, anchor: int = ANCHOR, words: int | None = None, passages: str | None = None
) -> DataFrame:
    """Add ``spans array<struct<start long, stop long>>``: the bytes that repeat elsewhere.

    A span covers every byte of a string of ``length`` bytes that also starts anywhere else, in
    the same text or another, judged on the whole input; spans of one text may overlap, touch or be
    equal and stand in order of their start.  Bytes are those of UTF-8; null and short texts have no span.
    With ``words``, spans also cover that many words in a row that also stand anywhere else, however the white
    space between them or the case of A-Z differs; words are compared by hashes.  With ``passages`` these have a column of
    that name, whose places count words, and ``spans`` holds strings of bytes only.
    Rows that repeat are rows of their own and so repeat each other.  Other columns stay as they are,
    those of the added names are replaced.
    """
    names = [c for c in docs.columns if c not in ("spans", passages)]
    if len(names) != len(set(names)):
        raise ValueError("columns of one name")
    docs = docs.select(*names)
    spans = _marks(docs, text, length, anchor, _bytes_of, length)
    if words:
        of_words = _marks(docs, text, words, max(1, words * anchor // length), word_codes, 2 * words - 1)
        spans = spans.join(of_words.withColumnRenamed("spans", "_words"), ["_k1", "_k2"], "full")
    spans = saved(spans, "spans")
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    keyed = docs.select(*row_key(*names), F.struct(*names).alias("_row"))
    keys = spans.select("_k1", "_k2")
    marked = _named(keyed, keys, "left_semi").join(spans, ["_k1", "_k2"])
    every = F.coalesce("spans", empty)
    if passages:
        of_words = F.coalesce("_words", empty) if words else empty
        return marked.select("_row.*", every.alias("spans"), of_words.alias(passages)).unionByName(
            _named(keyed, keys, "left_anti").select("_row.*", empty.alias("spans"), empty.alias(passages)))
    if words:
        @F.arrow_udf("array<struct<start:bigint,stop:bigint>>")
        def in_bytes(column: pa.Array, coded: pa.Array) -> pa.Array:
            of = [_word_bytes(t.as_py() or b"", marks.as_py() or []) for t, marks in zip(column.cast(pa.binary()), coded)]
            out = pa.array(of, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            give_back()
            return out

        every = F.sort_array(F.concat(every, in_bytes(F.col(f"_row.`{text}`"), F.col("_words"))))
    return marked.select("_row.*", every.alias("spans")).unionByName(
        _named(keyed, keys, "left_anti").select("_row.*", empty.alias("spans")))


def _runs(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def remove(marked: DataFrame, text: str = "text", name: str = "kept", characters: bool = False) -> DataFrame:
    """Replace ``spans`` by ``name`` (bytes without the spans), ``removed`` bytes and ``runs`` of removed bytes.

    With ``characters`` a span gives up the bytes of characters that it holds in part, so that
    what is kept is a text.  Columns of the added names are replaced, others stay.
    """

    @F.arrow_udf("kept binary, removed long, runs long")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, marks in zip(column.cast(pa.binary()), spans):
            data, marks = text.as_py() or b"", marks.as_py()
            kept, at, removed, n = [], 0, 0, 0
            for a, b in _runs(marks):
                if characters:
                    while a < len(data) and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                kept.append(data[at:a])
                at, removed, n = b, removed + b - a, n + 1
            out.append((b"".join([*kept, data[at:]]), removed, n))
        out = pa.StructArray.from_arrays(
            [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
            names=["kept", "removed", "runs"])
        give_back()
        return out

    own = [c for c in marked.columns if c not in ("spans", name, "removed", "runs")]
    return marked.select(*own, cut(F.col(text), F.col("spans")).alias("_cut")).select(
        *own, F.col("_cut.kept").alias(name), F.col("_cut.removed").alias("removed"), F.col("_cut.runs").alias("runs")
    )
