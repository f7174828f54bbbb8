"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant that is within half the radius of
both.  Every distinct fingerprint emits all its variants, variants meet by value, and all
fingerprints that share one are linked to the smallest of them, so no pairs are listed.

Two fingerprints within ``radius`` bits agree in one of ``radius + 1`` blocks of their bits, so each is dealt once by
every block and the shuffle moves five rows a fingerprint, however many fingerprints there are.  Variants are
expanded where the rows arrive, of the fingerprints that agree with another one in two further parts of the other
bits as well, as all within ``radius`` do.  Blocks that very many share are dealt on by flips among the bits behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, give_back, lean, saved, text_key
from .graph import components

BITS = 64
SEED = 42
# Fingerprints that one bucket of the first deal holds on average, rows from which a bucket is dealt on by
# the rest of its block and then by further bits, the bits of such a deal, and variants that a task expands at once.
BUCKET = 8192
HOT_BUCKET = 200_000
MORE_BITS = 6
AT_ONCE = 1 << 21
_HASHES_AT_ONCE = 1 << 15
SKETCH = 128  # shingle hashes that are kept of every text; whole sets are made for the pairs that these leave open
# Texts and bytes of their sets in one tile of a group of candidates, and tiles up to which a group is compared tile by tile.
TILE, TILE_BYTES, TILES = 1024, 16 << 20, 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of one UTF-8 text, as a signed 64-bit integer.

    Letters A-Z are lowered; words are runs without ASCII white space; a text with fewer words
    than a shingle is one shingle; a text without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for hashes in _hashed(words, shingle):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text; null counts as empty."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        out = pa.array([fingerprint(t, shingle) for t in byte_texts(column)], pa.int64())
        give_back()
        return out

    return docs.withColumn(name, of(F.col(text)))


def _masks(bits: int, flips: int) -> np.ndarray:
    """All values with at most ``flips`` of the lowest ``bits`` bits set."""
    return np.array(
        [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)], dtype=np.uint64
    )


def _shared(
    prints: np.ndarray, left: np.ndarray, depth: int, masks: dict, kind: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(index, index)`` links among the prints of one bucket that share a variant.

    Without ``kind`` each is linked to the first of its variant; with it every pair of unlike kinds is listed.
    All variants here agree in the first ``depth`` bits with the bucket; ``left`` is how many
    flips each print has left for the other bits.  Too many variants for one look are split
    by the next bit, which keeps memory bounded however many prints lie close together.
    """
    if len(prints) < 2:
        return
    for k in set(left.tolist()):
        if (depth, k) not in masks:
            masks[depth, k] = _masks(BITS - depth, k)
    sizes = {k: len(masks[depth, k]) for k in set(left.tolist())}
    total = sum(int((left == k).sum()) * m for k, m in sizes.items())
    if total > AT_ONCE and depth < BITS:
        bit = (prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        for side in (0, 1):
            spent = (bit != side).astype(np.int64)
            keep = np.flatnonzero(left >= spent)
            for a, b in _shared(prints[keep] ^ (spent[keep].astype(np.uint64) << np.uint64(BITS - 1 - depth)),
                                left[keep] - spent[keep], depth + 1, masks, None if kind is None else kind[keep]):
                yield keep[a], keep[b]
        return
    variants, owners = [], []
    for k in sizes:
        who = np.flatnonzero(left == k)
        variants.append((prints[who, None] ^ masks[depth, k][None, :]).ravel())
        owners.append(np.repeat(who, sizes[k]))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(variants)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return
    again = np.unique(again)
    place = np.minimum(np.searchsorted(again, variants), len(again) - 1)
    hit = np.flatnonzero(again[place] == variants)
    place, owners = place[hit], owners[hit]
    if kind is not None:
        yield from _unlike(place, owners, kind, len(prints))
        return
    first = np.full(len(again), len(prints))
    np.minimum.at(first, place, owners)
    other = owners != first[place]
    pairs = np.unique(first[place[other]] * len(prints) + owners[other])
    yield pairs // len(prints), pairs % len(prints)


def _unlike(place: np.ndarray, owners: np.ndarray, kind: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of owners at one place whose kinds differ, in time and memory that follow the pairs."""
    order = np.lexsort((kind[owners], place))
    place, owners = place[order], owners[order]
    ends = np.searchsorted(place, place, "right")
    turn = np.flatnonzero((place[1:] != place[:-1]) | (kind[owners[1:]] != kind[owners[:-1]])) + 1
    run = np.append(turn, len(place))[np.searchsorted(turn, np.arange(len(place)), "right")]
    count = ends - run
    upto = np.cumsum(count)
    at = 0
    while at < len(place):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] - count[at] + AT_ONCE, "right")))
        own = count[at:stop]
        if own.sum():
            step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            a, b = owners[np.repeat(np.arange(at, stop), own)], owners[np.repeat(run[at:stop], own) + step]
            pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
            yield pairs // n, pairs % n
        at = stop


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` indexes reaches."""
    a, b = (np.concatenate(x) for x in zip(*links))
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == old).all():
            return label


def _blocks(radius: int) -> dict[int, int]:
    """First bit and number of bits of ``radius + 1`` blocks, of which two fingerprints within ``radius`` bits agree in one."""
    n = radius + 1
    return {BITS * i // n: BITS * (i + 1) // n - BITS * i // n for i in range(n)}


def _turned(start: int, prints: np.ndarray) -> np.ndarray:
    """Fingerprints turned so that the block at ``start`` leads."""
    return (prints << np.uint64(start)) | (prints >> np.uint64(BITS - start)) if start else prints


def _bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` with their bucket: the leading ``depth`` bits of the turned and flipped fingerprint."""
    turned = F.call_function("shiftleft", "origin", F.col("start")).bitwiseOR(
        F.call_function("shiftrightunsigned", "origin", F.lit(BITS) - F.col("start")))  # a shift by 64 is none
    return rows.withColumn("bucket", F.call_function("shiftrightunsigned", turned.bitwiseXOR(F.col("flips")), F.lit(BITS) - F.col("depth")))


def _deal(rows: DataFrame, bits: int) -> DataFrame:
    """Deal rows ``(table, start, origin, kind, flips, left, depth)`` by the next ``bits`` bits, flipping up to ``left`` of them."""
    depth = F.col("depth") + bits
    flipped = F.array(*[
        F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for c in combinations(range(bits), k)]) for k in range(3)
    ])
    parts = []
    for k in range(3):
        parts.append(
            rows.where(F.col("left") >= k)
            .select("*", F.explode(flipped[k]).alias("_mask"))
            .select(
                "table", "start", "origin", "kind",
                F.col("flips").bitwiseXOR(F.call_function("shiftleft", "_mask", F.lit(BITS) - depth)).alias("flips"),
                (F.col("left") - k).alias("left"),
                depth.alias("depth"),
            )
            if k
            else rows.select("table", "start", "origin", "kind", "flips", "left", depth.alias("depth"))
        )
    return _bucketed(parts[0].union(parts[1]).union(parts[2]))


def _accompanied(prints: np.ndarray, fixed: int, radius: int) -> np.ndarray:
    """Indexes of the prints that may have another one within ``radius`` bits that agrees in the first ``fixed`` bits.

    The other bits make ``radius + 2`` parts, of which two agree if no more than ``radius`` bits differ.
    """
    cuts = [(BITS - fixed) * i // (radius + 2) for i in range(radius + 3)]
    parts = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
    hit = np.zeros(len(prints), bool)
    for a, b in combinations(parts, 2):
        key = prints & np.uint64((1 << BITS) - (1 << BITS - fixed) | a | b)
        ordered = np.sort(key)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            hit |= again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    return np.flatnonzero(hit)


def links(prints: DataFrame, radius: int = 4, every: bool = False) -> DataFrame:
    """``(table, a, b)`` links that join all distinct fingerprints of a table within ``radius`` (4, 2 or 0) bits of one another.

    ``prints`` has distinct rows ``table, fingerprint``.  Fingerprints that share a
    variant are linked through the smallest of them in their bucket; the links of a bucket
    are a forest, so their number follows the fingerprints and not the pairs.

    With ``every``, ``prints`` also has ``kind long`` and the rows are all pairs of fingerprints within the
    radius whose kinds differ, each at least once; a null kind differs from any other.
    """
    half, blocks = radius // 2, _blocks(radius)
    n = prints.groupBy("table").count().agg(F.max("count")).first()[0] or 0
    bits = min(*blocks.values(), 30, max(2, math.ceil(math.log2(max(1, n) / BUCKET))))
    rows = _bucketed(prints.select(
        "table", F.col("fingerprint").alias("origin"), F.col("kind") if every else F.lit(None).cast("long").alias("kind"),
        F.lit(0).cast("long").alias("flips"), F.lit(half).alias("left"), F.lit(bits).alias("depth"),
        F.explode(F.array(*map(F.lit, blocks))).alias("start"),
    ))
    on = ["table", "start", "depth", "bucket"]
    whole = F.create_map(*[F.lit(x) for block in blocks.items() for x in block])[F.col("start")]
    ready = []
    while True:
        hot = saved(rows.groupBy(*on).count().where(F.col("count") > HOT_BUCKET).drop("count"), "hot")
        if hot.isEmpty() or rows.where(F.col("depth") <= BITS - MORE_BITS).isEmpty():
            break
        ready.append(rows.join(hot, on, "left_anti"))
        rows = rows.join(hot, on, "left_semi").drop("bucket")
        # Fingerprints of one bucket that do not agree in the whole block meet by another one.
        rows = saved(_deal(rows, MORE_BITS) if len(ready) > 1 else _bucketed(rows.withColumn("depth", F.greatest("depth", whole))), "dealt")
    for more in ready:
        rows = rows.unionByName(more)

    def meet(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(group))
        origin = got["origin"].to_numpy()
        order = np.argsort(origin, kind="stable")
        start, depth = int(got["start"][0].as_py()), int(got["depth"][0].as_py())
        fixed = max(depth, blocks[start])
        own = _turned(start, origin.view(np.uint64)) ^ got["flips"].to_numpy().view(np.uint64)
        some = _accompanied(own[order], fixed, radius)
        order = order[some]
        if not len(order):
            return
        origin, own, left = origin[order], own[order], got["left"].to_numpy().astype(np.int64)[order]
        bits = origin.view(np.uint64)
        earlier = [np.uint64((1 << BITS - at) - (1 << BITS - at - size)) for at, size in blocks.items() if at < start]

        def here(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # Two that agree in an earlier block as well are linked there.
            keep = np.ones(len(a), bool)
            for block in earlier:
                keep &= (bits[a] ^ bits[b]) & block != 0
            return a[keep], b[keep]

        if every:
            kinds = got["kind"].take(pa.array(order))
            kind = np.unique(kinds.fill_null(0).to_numpy(), return_inverse=True)[1]
            # Rows of one fingerprint are no pair, so a null kind is told apart by the fingerprint.
            kind = np.where(kinds.is_null().to_numpy(), len(kind) + np.unique(origin, return_inverse=True)[1], kind)
            for a, b in (here(a, b) for a, b in _shared(own, left, fixed, {}, kind)):
                yield batch(origin[a], origin[b], got["table"][0].as_py())
            return
        found = [here(a, b) for a, b in _shared(own, left, fixed, {})]
        if found:
            label = _forest(len(origin), found)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield batch(origin[label[moved]], origin[moved], got["table"][0].as_py())

    def batch(a: np.ndarray, b: np.ndarray, table: int) -> pa.RecordBatch:
        keep = a != b
        tables = pa.array(np.full(int(keep.sum()), table), pa.int32())
        return pa.RecordBatch.from_arrays([tables, pa.array(a[keep]), pa.array(b[keep])], names=["table", "a", "b"])

    return rows.groupBy(*on).applyInArrow(lean(meet), "table int, a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``id, fingerprint long, component_id``: one row per row of ``docs``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is
    the smallest id that links reach, itself included.  Equal fingerprints are one node, so a
    group of copies costs one.  Null and empty texts have fingerprint zero and are linked like
    any other.  Null ids are passed over when the smallest is chosen (null if there is no other);
    rows that repeat an id stay rows of their own.  An empty table gives an empty result.
    """
    prints = saved(
        fingerprints(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text", shingle).drop("_text"),
        "fingerprints",
    )
    nodes = saved(prints.groupBy("fingerprint").agg(F.min("_id").alias("least")), "nodes")
    roots = components(links(nodes.select(F.lit(0).alias("table"), "fingerprint"), radius))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = saved(rooted.join(least, "root").select("fingerprint", "component_id"), "members")
    return prints.join(member, "fingerprint").select(F.col("_id").alias(id), "fingerprint", "component_id")


def _sums(words: list[bytes], size: int, tables: int) -> list[int]:
    """Fingerprints of one text in several tables, each from its own mixing of the shingles' hashes."""
    if not words:
        return [0] * tables
    n = max(1, len(words) - size + 1)
    ones = np.zeros((tables, BITS), np.int64)
    for hashes in _hashed(words, size):
        for t in range(tables):
            own = hashes ^ np.uint64(t * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            own = (own ^ (own >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            own ^= own >> np.uint64(32)
            ones[t] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def _hashed(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, some at a time; fewer words are one shingle."""
    n = max(1, len(words) - size + 1)
    for at in range(0, n, _HASHES_AT_ONCE):
        part = words[at : min(n, at + _HASHES_AT_ONCE) + size - 1]
        joined = [b" ".join(part)] if len(part) <= size else map(b" ".join, zip(*(part[i:] for i in range(size))))
        yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), "<u8")


def _set(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingle hashes of one text, in order."""
    parts = [np.unique(h) for h in _hashed(words, size)] if words else []
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of distinct values have a Jaccard similarity of ``least`` or more; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return not every or both / every >= least


def _ruled_out(a: np.ndarray, n: int, b: np.ndarray, m: int, least: float) -> bool:
    """Whether the smallest values ``a`` and ``b`` of sets of ``n`` and ``m`` values prove a similarity below ``least``.

    Up to the lesser of the two ends both sets are known, and what one of them lacks there it lacks for good.
    """
    end = min(a[-1] if len(a) < n else np.uint64(2**64 - 1), b[-1] if len(b) < m else np.uint64(2**64 - 1))
    x, y = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    both = len(np.intersect1d(x, y, assume_unique=True))
    most = min(n - (len(x) - both), m - (len(y) - both))
    return n + m > 0 and most / (n + m - most) < least


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _verified(own: DataFrame, marked: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs of text keys whose similarity is ``least`` or more, as written rows ``a, b``.

    Pairs that sketches do not rule out are decided by the whole sets of shingles, which are made
    and moved for the texts of such pairs only.
    """
    sketches = _of_texts(marked.select("text_key", "sketch", "n"), pairs).groupBy("text_key")
    sketches = saved(sketches.agg(F.first("sketch").alias("sketch"), F.first("n").alias("n")), "sketches")

    @F.arrow_udf("boolean")
    def possible(u: pa.Array, n: pa.Array, v: pa.Array, m: pa.Array) -> pa.Array:
        rows = zip(u.to_pylist(), n.to_pylist(), v.to_pylist(), m.to_pylist())
        out = pa.array([not _ruled_out(np.frombuffer(a, "<u8"), i, np.frombuffer(b, "<u8"), j, least) for a, i, b, j in rows], pa.bool_())
        give_back()
        return out

    open = saved(
        pairs.join(sketches.toDF("x", "u", "n"), "x").join(sketches.toDF("y", "v", "m"), "y")
        .where(possible("u", "n", "v", "m")).select("x", "y"), "open")

    sets = _whole_sets(_of_texts(own.select("text_key", "_text"), open), shingle)

    @F.arrow_udf("boolean")
    def alike(u: pa.Array, v: pa.Array) -> pa.Array:
        # One value at a time, as sets of long texts are large.
        out = pa.array([similar(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8"), least) for a, b in zip(u, v)], pa.bool_())
        give_back()
        return out

    return saved(
        open.join(sets.toDF("x", "u"), "x").join(sets.toDF("y", "v"), "y")
        .where(alike("u", "v")).select(F.col("x").alias("a"), F.col("y").alias("b")), "checked")


def _whole_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Written rows ``text_key, set``: the whole set of shingle hashes of every text once."""

    @F.arrow_udf("binary")
    def whole(column: pa.Array) -> pa.Array:
        out = pa.array([_set((t.as_py() or b"").lower().split(), shingle).tobytes() for t in column.cast(pa.binary())], pa.binary())
        give_back()
        return out

    one = texts.groupBy("text_key").agg(F.first("_text").alias("_text"))
    return saved(one.select("text_key", whole("_text").alias("set")), "sets")


def _of_texts(rows: DataFrame, pairs: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of texts that are in a pair; up to ``broadcast_rows`` keys are sent, so no text is shuffled for them."""
    return _of_keys(rows, pairs.select(F.explode(F.array("x", "y")).alias("text_key")).distinct(), broadcast_rows)


def _of_keys(rows: DataFrame, keys: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    keys = saved(keys, "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= broadcast_rows else keys, "text_key", "left_semi")


def _joins(parts: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], n: int, radius: int, least: float) -> Iterator[tuple[int, int]]:
    """Links of similar texts that join the parts of one tile, or those of two of which the first has ``n`` texts.

    Texts are candidates if their prints are within ``radius`` bits in any table.  Pairs whose parts are joined already
    are passed over, all other candidates are decided, so the links are a forest that joins what all links would.
    """
    label = np.unique(parts, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    for i in range(n):
        first = i + 1 if n == len(sets) else n
        near = (np.bitwise_count(prints[first:] ^ prints[i]) <= radius).any(axis=1)
        even = np.minimum(size[first:], size[i]) >= np.maximum(size[first:], size[i]) * least - 1
        for j in (np.flatnonzero(near & even & (label[first:] != label[i])) + first).tolist():
            if label[i] == label[j] or _ruled_out(sets[i][:SKETCH], len(sets[i]), sets[j][:SKETCH], len(sets[j]), least):
                continue
            if similar(sets[i], sets[j], least):
                label[label == label[j]] = label[i]
                yield i, j


def _across(members: DataFrame, radius: int, least: float) -> DataFrame:
    """Written links ``a, b`` that join the parts of every group as all links between similar candidates would.

    ``members`` has ``root, tiles, text_key, part, prints, set``.  The texts of a group are dealt into tiles and every tile
    meets every tile in a task of its own, so a pair is no row and memory follows the tiles.
    """
    dealt = members.withColumn("_tile", F.pmod(F.xxhash64("text_key"), F.col("tiles"))).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))

    def meet(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(group)).sort_by([("_tile", "ascending"), ("text_key", "ascending")])
        tile = got["_tile"].to_numpy()
        if not len(tile):
            return
        prints = np.array(got["prints"].to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(s.as_py(), "<u8") for s in got["set"]]
        if int(got["_low"][0].as_py()) != int(got["_high"][0].as_py()) and tile[0] == tile[-1]:
            return  # the other tile is empty
        first = int(np.searchsorted(tile, tile[0], "right"))
        keys = got["text_key"]
        found = list(_joins(np.array(got["part"].to_pylist(), object), prints, sets, first, radius, least))
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[i].as_py() for i, _ in found], pa.binary()), pa.array([keys[j].as_py() for _, j in found], pa.binary())], names=["a", "b"])

    pairs = dealt.select("root", F.least("_tile", "_other").alias("_low"), F.greatest("_tile", "_other").alias("_high"),
                         "_tile", "text_key", "part", "prints", "set")
    return saved(pairs.groupBy("root", "_low", "_high").applyInArrow(lean(meet), "a binary, b binary"), "checked")


def similar_texts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8,
    radius: int = 4, tables: int = 8, feature: int = 2,
) -> DataFrame:
    """``id, text_key, component_id, kept``: groups of texts that links of similarity ``least`` or more join.

    Candidates are fingerprints within ``radius`` bits in any of ``tables`` independent tables, made of
    ``feature``-word shingles, which change less than longer ones under an edit.  Every candidate pair is
    verified unless verified links join its texts already.  A link stays if
    the whole sets of ``shingle``-word shingles, by their hashes, have a Jaccard similarity of at least ``least``.  Equal texts (``text_key``, 128 bits, stands for them) are one node; null is empty,
    and empty texts are equal.  ``kept`` marks the row of the smallest id of a component, or rows that
    repeat it; ``component_id`` is that id.
    """
    own = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = own.select("_id", "_text", text_key(F.col("_text")).alias("text_key"))
    spec = "prints array<long>, sketch binary, n long"

    @F.arrow_udf(spec)
    def mark(column: pa.Array) -> pa.Array:
        # One text at a time, as words as Python objects are many times a batch.
        sums, sketches, sizes = [], [], []
        for text in column.cast(pa.binary()):
            words = (text.as_py() or b"").lower().split()
            whole = _set(words, shingle)
            sums.append(_sums(words, feature, tables))
            sketches.append(whole[:SKETCH].tobytes())
            sizes.append(len(whole))
        out = pa.StructArray.from_arrays(
            [pa.array(sums, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())], names=["prints", "sketch", "n"])
        give_back()
        return out

    marked = saved(own.withColumn("_m", mark(F.col("_text"))).select("_id", "text_key", "_m.prints", "_m.sketch", "_m.n"), "marked")
    nodes = marked.groupBy("text_key").agg(F.first("prints").alias("prints"))
    prints = nodes.select("text_key", F.posexplode("prints").alias("table", "fingerprint"))
    # One node speaks for a fingerprint; another one in each table, so links run by more than one text.
    spoken = saved(
        prints.groupBy("table", "fingerprint").agg(F.min_by("text_key", F.xxhash64("table", "text_key")).alias("key")), "spoken")
    near = links(spoken.select("table", "fingerprint"), radius)
    a = spoken.select("table", F.col("fingerprint").alias("a"), F.col("key").alias("x"))
    b = spoken.select("table", F.col("fingerprint").alias("b"), F.col("key").alias("y"))
    across = near.join(a, ["table", "a"]).join(b, ["table", "b"]).select("x", "y")
    within = prints.join(spoken, ["table", "fingerprint"]).select(F.col("text_key").alias("x"), F.col("key").alias("y"))
    pairs = saved(_pairs(across.unionByName(within)), "pairs")
    checked = _verified(own, marked, pairs, shingle, least)
    # The pairs so far join all candidates, but stand for others: where their verified links leave a
    # group of candidates in several parts, every candidate pair of two parts is verified itself.
    parts = components(pairs, "x", "y").join(components(checked).toDF("node", "part"), "node", "left").select(
        F.col("node").alias("text_key"), "root", F.coalesce("part", "node").alias("part"))
    parts = saved(parts, "parts")
    torn = parts.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    torn = saved(parts.join(torn, "root", "left_semi"), "torn")
    if not torn.isEmpty():
        sets = _whole_sets(_of_keys(own.select("text_key", "_text"), torn.select("text_key")), shingle)
        sized = torn.join(sets.select("text_key", F.octet_length("set").alias("_bytes")), "text_key").groupBy("root").agg(
            F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("_bytes") / TILE_BYTES), F.lit(1)).alias("tiles"))
        torn = saved(torn.join(sized, "root"), "torn")
        members = torn.where(F.col("tiles") <= TILES).join(nodes, "text_key").join(sets, "text_key")
        checked = checked.unionByName(_across(members, radius, least))
        torn = torn.where(F.col("tiles") > TILES)
    # Larger groups are mostly chains, where few of all pairs are candidates: these are listed and verified.
    left = saved(prints.join(torn.select("text_key", "part"), "text_key"), "open")
    if not left.isEmpty():
        cells = saved(left.groupBy("table", "fingerprint").agg(F.min("part").alias("low"), F.max("part").alias("high")), "cells")
        kinds = cells.select("table", "fingerprint", F.when(F.col("low") == F.col("high"), F.xxhash64("low")).alias("kind"))
        mixed = kinds.where("kind is null").select("table", F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"))
        met = links(kinds, radius, every=True).distinct().unionByName(mixed)
        a = left.select("table", F.col("fingerprint").alias("a"), F.col("text_key").alias("x"), F.col("part").alias("p"))
        b = left.select("table", F.col("fingerprint").alias("b"), F.col("text_key").alias("y"), F.col("part").alias("q"))
        more = met.join(a, ["table", "a"]).join(b, ["table", "b"]).where("p <> q").select("x", "y")
        more = saved(_pairs(more).join(pairs, ["x", "y"], "left_anti"), "pairs")
        checked = checked.unionByName(_verified(own, marked, more, shingle, least))
    roots = components(checked)
    rooted = marked.select("_id", "text_key").join(roots, F.col("text_key") == F.col("node"), "left").select(
        "_id", "text_key", F.coalesce("root", "text_key").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("text_key").alias("key"))).alias("first"))
    return rooted.join(first, "root").select(
        F.col("_id").alias(id), "text_key", F.col("first.id").alias("component_id"),
        (F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.key"))).alias("kept"))
