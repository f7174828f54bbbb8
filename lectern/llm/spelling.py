"""Spelling variants: words one edit apart, found by sorted rotations.

Every word, ended by a terminator, gives all its rotations.  Turned so that the edited place comes last, the
words that differ there share everything before it: a replacement is one more letter behind the
shared prefix, and the word that lacks the letter is the prefix itself.  Rotations sorted by prefix
stand in groups of at most one letter each of the alphabet and the shorter word, whatever the number
of words, so a scan of a group counts neighbours and keeps the best without listing pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices

LETTERS = bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))  # fixed values: a-z and U+00C0 to U+00FF, one byte a letter
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in LETTERS else 0x20 for c in range(256))
ENTRIES = 200_000  # counted words after which a task passes its counts on
PIECE = 1 << 20  # letters of a text cut into words at once
END = "$"
LITERAL = 65  # letters up to which a prefix stands for itself; longer ones are named by a hash
_PRIME, _BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15


def runs(text: str) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters of a whole text, in lists of bounded size; one byte is one letter."""
    data, at = text.encode("latin-1", "replace").translate(_LOWER), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def words(docs: DataFrame, id: str = "doc_id", text: str = "text", letters: int = 6, least: int = 5, one_in: int = 199) -> DataFrame:
    """``word, n``: the runs of letters of all texts with at least ``letters`` letters and ``least`` occurrences.

    Only A-Z is lower-cased.  Of a run whose ``crc32`` of ``<id>:<run>`` is a multiple of ``one_in`` the
    letter at that number modulo its length is left out, the same in every occurrence in the document.
    Null texts have no runs, a null id counts as empty text, rows that repeat count again; other
    columns are not read.  Empty tables give no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{key or ''}:".encode())
                for part in runs(whole or ""):
                    for run, n in Counter(part).items():
                        if len(run) < letters:
                            continue
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % one_in == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < letters:
                                continue
                        total[run] += n
                if len(total) >= ENTRIES:
                    yield out(total)
                    total = Counter()
        if total:
            yield out(total)

    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in total]), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return (
        docs.select(F.col(id).cast("string"), text).mapInArrow(count, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    )


def rotations(word: str) -> Iterator[tuple[str, str, bool]]:
    """``(prefix, edited letter, first of its run)`` of all rotations of the ended word.

    A whole rotation has no edited letter; one that ends with a letter also stands under the prefix
    before it.  Leaving out any letter of a run of equal ones gives one word, so that only the first
    of a run meets the shorter word.  Prefixes of more than ``LITERAL`` letters are hashes, as the
    rotations of a long word are as many as its letters and as long.
    """
    n = len(word)
    if n + 1 > LITERAL:
        front, power = [0], [1]
        for c in word:
            front.append((front[-1] * _BASE + ord(c)) % _PRIME)
            power.append(power[-1] * _BASE % _PRIME)

        def turned(behind: int, before: int) -> str:
            back = (front[n] - front[behind] * power[n - behind]) % _PRIME
            return f"#{(back * power[before] % _PRIME * _BASE + ord(END) * power[before] + front[before]) % _PRIME:x}"

    for i in range(n + 1):
        yield (turned(i, i) if n + 1 > LITERAL else word[i:] + END + word[:i]), "", False
        if i:
            prefix = turned(i, i - 1) if n > LITERAL else word[i:] + END + word[: i - 1]
            yield prefix, word[i - 1], i == 1 or word[i - 2] != word[i - 1]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``place, n_near, best``: how many words are near that at ``place``, and the smallest place among them.

    ``vocabulary`` has distinct words with a distinct ``place``.  Words without neighbours are left out.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for place, word in zip(*(c.to_pylist() for c in batch.columns)):
                for row in rotations(word):
                    rows.append((*row, place))
                    if len(rows) >= 50_000:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["prefix", "letter", "first", "place"])

    turned = vocabulary.select("place", "word").mapInArrow(turn, "prefix string, letter string, first boolean, place long")
    # A group has the shorter word and one word for each letter of the alphabet at most.
    group = Window.partitionBy("prefix").orderBy("letter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edited = F.col("letter") != ""
    scanned = turned.select(
        "place", "first", edited.alias("edited"),
        F.count("*").over(group).alias("all"),
        F.max(F.when(~edited, F.col("place"))).over(group).alias("shorter"),
        F.array_sort(F.collect_list(F.when(edited, F.col("place"))).over(group)).alias("longer"),
        F.count(F.when(F.col("first"), 1)).over(group).alias("n_first"),
        F.min(F.when(F.col("first"), F.col("place"))).over(group).alias("best_first"),
    ).where("all > 1")
    other = F.when(F.col("longer")[0] != F.col("place"), F.col("longer")[0]).otherwise(F.get("longer", F.lit(1)))
    shorter = F.when(F.col("first"), F.col("shorter"))
    found = scanned.select(
        "place",
        F.when(F.col("edited"), F.size("longer") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).otherwise(F.col("n_first")).cast("long").alias("near"),
        F.when(F.col("edited"), F.least(other, shorter)).otherwise(F.col("best_first")).alias("best"),
    ).where("near > 0")
    return found.groupBy("place").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(counted: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct, non-null words with their counts ``n``.

    Words are near if they differ by one inserted, deleted or replaced letter.  The form of a word is
    its near word of largest ``n``, ties to the smallest in code-point order, if that is at least
    ``ratio`` times its own; the root is the last of the forms of forms.  Words hold neither the
    terminator nor ``#``.  Other columns are not read.
    """
    # Places grow in the order in which words are preferred, so that the smallest is the best.
    ordered = saved(
        counted.select("word", "n").orderBy(F.desc("n"), "word").withColumn("place", F.monotonically_increasing_id()), "vocabulary")
    near = neighbours(ordered)
    best = ordered.select(F.col("place").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = saved(ordered.join(near, "place", "left").join(best, "best", "left").withColumn(
        "formed", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))), "linked")
    roots = _ends(linked.where("formed").select("place", F.col("best").alias("next")))
    named = roots.join(ordered.select(F.col("place").alias("next"), F.col("word").alias("root")), "next").select("place", "root")
    return linked.join(named, "place", "left").select(
        "word", F.when(F.col("formed"), F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("form_n")).alias("form_n"),
    )


def _ends(links: DataFrame) -> DataFrame:
    """Follow ``place -> next`` to the last place; every round doubles the steps, and counts grow by a ratio a step."""
    now = saved(links, "roots")
    while True:
        on = now.select(F.col("place").alias("_at"), F.col("next").alias("_on"))
        moved = saved(now.join(on, F.col("next") == F.col("_at"), "left").select(
            "place", F.coalesce("_on", "next").alias("next"), F.col("_on").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("place", "next")
        now = moved.select("place", "next")


# The table of the checksum follows from its polynomial.
ORACLE = r"""
with recursive bits as (
    select v, v::ubigint as c, 0 as step from range(256) t(v)
    union all
    select v, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, step + 1 from bits where step < 8
), crc_table as (select list(c order by v) as codes from bits where step = 8),
cut as (
    select doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
    from documents
), distinct_runs as (
    select run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as digits
    from (select doc_id, run, count(*) as n from cut where length(run) >= 6 group by all)
), hashed as (
    select run, n, xor(list_reduce(
        list_prepend(4294967295::ubigint, list_transform(range(0, length(digits), 2), lambda i: ('0x' || substr(digits, i + 1, 2))::ubigint)),
        lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) as h
    from distinct_runs, crc_table
), words as (
    select word, sum(n)::bigint as n from (
        select n, case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
        from hashed)
    where length(word) >= 6 group by word having sum(n) >= 5
), shorter as (
    select distinct word, n, i, substr(word, 1, i) as a, substr(word, i + 2) as b from (select word, n, unnest(range(length(word))) as i from words)
), near as (
    select x.word, y.word as other, y.n as other_n from shorter x join shorter y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
    union select s.word, w.word, w.n from shorter s join words w on w.word = s.a || s.b
    union select w.word, s.word, s.n from shorter s join words w on w.word = s.a || s.b
), best as (
    select word, count(*) as n_near, arg_min(other, (-other_n, other)) as form, max(other_n) as form_n from near group by word
), formed as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.form_n >= 5 * w.n then b.form end as form,
        case when b.form_n >= 5 * w.n then b.form_n end as form_n
    from words w left join best b on b.word = w.word
), chain as (
    select word, word as root, 0 as steps from formed
    union all
    select c.word, f.form, steps + 1 from chain c join formed f on f.word = c.root where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near::bigint as n_near, f.form_n
from formed f join (select word, arg_max(root, steps) as root from chain group by word) c on c.word = f.word
"""
