"""Speech preparation: options, cache keys, work lists, positions, cost and audio merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import ENUMS_SPEECH_FORMATS, parse_options
from ..functions.text import cache_hash, page_number_of
from .library import PART_BUDGET
from .ordered import number_rows, parts, running, slice_of

LOOK_AHEAD = 2
CACHE_ENTRIES = 256
COMPOSER = "composer"

# Fixed values of the cost model.
FRAME_SLACK, FRAMES_PER_CHAR = 24, 2.0
SINGLE_WORD_FRAMES, EXTRA_SYLLABLE_FRAMES = 13, 5
SHORT_SYLLABLES, SHORT_CHARS = 4, 24
FRAMES_PER_SECOND, SYLLABLES_PER_SECOND = 12.5, 4.5
SLOWER_THAN_REALTIME, OVERHEAD_MS = 25.0, 30_000
MIN_BUDGET_MS, MAX_BUDGET_MS = 60_000, 480_000
CUE = "<|emotion_"
MARKUP = "<\\|emotion_[0-9]+\\|>|</?en>"
IPA_VOWELS = "aeiouyæɐɑɒɔəɘɛɜɤɯɵøœʉʊʌɪɨɚɝᵻᵿ"
TRANSPARENT_MARKS = "ːˈˌ0-9"


# -- cache ---------------------------------------------------------------------------


def with_cache_hash(sentences: DataFrame, voice: str | None, speed: float, fmt: str = "wav") -> DataFrame:
    return sentences.withColumn(
        "text_hash", cache_hash("text", F.lit(voice).cast("string"), F.lit(speed), F.lit(fmt))
    )


def cache_lookup(
    sentences: DataFrame, cache: DataFrame, voice: str | None, speed: float, fmt: str = "wav",
    strict: bool = False,
) -> DataFrame:
    """Sentences with their cached audio.

    The hash already covers voice, speed and format; ``strict`` also compares the stored columns.
    """
    if strict:
        cache = cache.filter(
            (F.col("voice_id") == (voice or "")) & (F.col("speed") == speed) & (F.col("format") == fmt)
        )
    return (
        with_cache_hash(sentences, voice, speed, fmt)
        .join(cache.select("text_hash", "file_path", F.col("duration_ms").alias("cached_ms")), "text_hash", "left")
        .withColumn("cache_hit", F.col("file_path").isNotNull())
    )


def missing_audio(sentences: DataFrame, cache: DataFrame, voice: str | None, speed: float, fmt: str = "wav") -> DataFrame:
    """Each text that still needs audio, once per corpus.

    Duplicates collapse before the anti join, so a sentence that fills a third of the
    corpus reaches it as one row.
    """
    keyed = with_cache_hash(sentences, voice, speed, fmt)
    wanted = keyed.groupBy("text_hash").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("occurrences")
    )
    return wanted.join(cache.select("text_hash"), "text_hash", "left_anti")


def stale_cache(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows whose audio file is gone."""
    return cache.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def evict(saves: DataFrame, n: int = CACHE_ENTRIES) -> DataFrame:
    """Keys that fall out of a cache of the ``n`` latest saves.

    The kept set has at most ``n`` rows, which is what makes the broadcast safe.
    """
    last = saves.groupBy("key").agg(F.max(F.struct("saved_at", "seq")).alias("last_save"))
    kept = last.orderBy(F.col("last_save").desc()).limit(n).select("key")
    return last.join(F.broadcast(kept), "key", "left_anti").select("key", "last_save.saved_at", "last_save.seq")


# -- voices and options --------------------------------------------------------------


def _names(voices: DataFrame) -> DataFrame:
    names = F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return voices.select("id", "pos", names.alias("name"))


def resolve_voice(requests: DataFrame, voices: DataFrame, default: str | None) -> DataFrame:
    """Exact id or alias, then without case, then the catalogue default, then the first voice."""
    names = _names(voices)
    exact = names.groupBy("name").agg(F.min_by("id", "pos").alias("exact_voice"))
    folded = names.groupBy(F.lower("name").alias("folded_name")).agg(F.min_by("id", "pos").alias("folded_voice"))

    def scalar(df: DataFrame) -> Column:
        return df.agg(F.min_by("id", "pos")).scalar()

    fallback = F.coalesce(
        scalar(names.filter(F.col("name") == F.lit(default))),
        scalar(names.filter(F.lower("name") == F.lower(F.lit(default)))),
        scalar(voices),
    )
    return (
        requests.withColumn("name", F.when(F.col("requested") != "", F.col("requested")))
        .withColumn("folded_name", F.lower("name"))
        .join(exact, "name", "left")
        .join(folded, "folded_name", "left")
        .select(
            *requests.columns,
            F.coalesce("exact_voice", "folded_voice", fallback).alias("voice_id"),
        )
    )


def resolve_options(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """A document's own options, else the composer's last used, else the stored defaults."""
    own = settings.filter(F.col("key").startswith("tts_options:")).select(
        F.substring("key", len("tts_options:") + 1, 2**31 - 1).alias("document_id"),
        parse_options("value").alias("own"),
    )

    def setting(key: str) -> DataFrame:
        return settings.filter(F.col("key") == key)

    def value(key: str) -> Column:
        return setting(key).agg(F.max("value")).scalar()

    composer = parse_options(value(f"tts_options:{COMPOSER}"))
    fmt = value("default_format")
    defaults = F.struct(
        value("default_voice_id").alias("voice_id"),
        F.coalesce(value("default_speed").try_cast("double"), F.lit(1.0)).alias("speed"),
        F.coalesce(value("default_volume").try_cast("double"), F.lit(1.0)).alias("volume"),
    )
    chosen = F.coalesce("own", composer, defaults)
    return (
        docs.select(F.col("uuid").alias("document_id"))
        .join(own, "document_id", "left")
        .select(
            "document_id",
            chosen["voice_id"].alias("voice_id"),
            chosen["speed"].alias("speed"),
            chosen["volume"].alias("volume"),
            F.when(
                F.col("own").isNull() & composer.isNull() & fmt.isin(*ENUMS_SPEECH_FORMATS), fmt
            ).otherwise(F.lit("wav")).alias("format"),
        )
    )


# -- positions, progress and statistics ----------------------------------------------


def elapsed(sentences: DataFrame) -> DataFrame:
    """Audio time before each sentence of its document."""
    return running(
        sentences, ["document_id"], ["idx"], [slice_of("idx")],
        {"elapsed_ms": ("sum", F.coalesce("duration_ms", F.lit(0)).cast("bigint"))},
    )


def remaining(sentences: DataFrame, positions: DataFrame) -> DataFrame:
    """Sentences after the current one, never below zero."""
    totals = sentences.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"))
    return positions.join(totals, "document_id").select(
        "document_id", "sentence_index",
        F.greatest(F.col("total") - F.col("sentence_index") - 1, F.lit(0)).alias("remaining"),
    )


def look_ahead(sentences: DataFrame, positions: DataFrame, k: int = LOOK_AHEAD) -> DataFrame:
    """The current sentence and the next ``k`` that still need audio.

    Positions are expanded to the wanted indices first, so the join is an equality on
    (document, index) and a long document contributes only its ``k + 1`` rows.
    """
    wanted = positions.select(
        "document_id",
        F.posexplode(F.sequence("sentence_index", F.col("sentence_index") + k)).alias("ahead", "idx"),
    )
    return wanted.join(sentences, ["document_id", "idx"]).filter(
        (F.col("ahead") == 0) | ~F.coalesce("status", F.lit("idle")).isin("ready", "played")
    )


def audio_stats(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("document_id").agg(
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("known_ms"),
        F.max("synthesis_ms").alias("slowest_ms"),
        F.coalesce(F.max(F.col("status") == "ready"), F.lit(False)).alias("has_audio"),
    )


def progress(sentences: DataFrame) -> DataFrame:
    """Completed counts failed sentences too: one bad sentence does not stop a run."""
    done = F.count_if(F.col("status").isin("ready", "played", "playing", "failed"))
    total = F.count(F.lit(1))
    return sentences.groupBy("document_id").agg(
        total.alias("total"),
        done.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.try_divide(done, total).alias("fraction"),
        F.floor(done * 100 / total).alias("percent"),
    )


def place_images(images: DataFrame, blocks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Each image after the last paragraph of its page.

    Where blocks and paragraphs do not line up, or no block is on the page, it goes after the
    last paragraph.  A missing page matches blocks without a page.
    """
    numbered = number_rows(blocks, ["document_id"], ["ord"], [slice_of("ord")], "paragraph")
    own = page_number_of("page_id")
    derived = F.when(
        F.col("page_id") == F.concat(F.col("document_id").cast("string"), F.lit("-p"), own.cast("string")), own
    )
    last_on_page = numbered.groupBy(
        "document_id", F.coalesce(derived, "page_number").alias("page")
    ).agg(F.max("paragraph").alias("page_paragraph"))
    counts = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    ends = sentences.groupBy("document_id").agg(F.max("paragraph").alias("last_paragraph"))

    i, p = images.alias("i"), last_on_page.alias("p")
    located = i.join(
        p,
        (F.col("i.document_id") == F.col("p.document_id")) & F.col("i.page_number").eqNullSafe(F.col("p.page")),
        "left",
    ).select("i.*", "p.page_paragraph")
    last = F.coalesce("last_paragraph", F.lit(-1))
    return (
        located.join(counts, "document_id", "left")
        .join(ends, "document_id", "left")
        .select(
            *images.columns,
            F.when(
                F.coalesce("n_blocks", F.lit(0)) == last + 1, F.coalesce("page_paragraph", last)
            ).otherwise(last).alias("after_paragraph"),
        )
    )


# -- cost ----------------------------------------------------------------------------


def speech_cost(df: DataFrame, phonemes: str = "phonemes") -> DataFrame:
    """Syllables, cue test, frame cap and time budget of phoneme text."""
    text = F.col(phonemes)
    plain = F.regexp_replace(text, MARKUP, "")
    has_cue = F.contains(text, F.lit(CUE))
    cue_only = has_cue & ~plain.rlike("\\p{L}")
    # Vowels beyond a to z become one of them and marks go in one walk; what is left for the pattern is a short class.
    letters = "".join(v for v in IPA_VOWELS if v.isascii())
    beyond = "".join(v for v in IPA_VOWELS if not v.isascii())
    marks = TRANSPARENT_MARKS.replace("0-9", "0123456789")
    simple = F.translate(plain, beyond + marks, letters[0] * len(beyond))
    runs = F.regexp_count(simple, F.lit(f"[{letters}]+"))
    measured = df.select(
        "*", runs.alias("syllables"), cue_only.alias("cue_only"), has_cue.alias("_cue"),
        F.length(plain).alias("_chars"),
    )
    long_cap = F.lit(FRAME_SLACK) + F.ceil(F.col("_chars") * FRAMES_PER_CHAR)
    effective = F.greatest("syllables", F.lit(1))
    short_cap = F.lit(SINGLE_WORD_FRAMES) + EXTRA_SYLLABLE_FRAMES * (effective - 1)
    is_short = ~F.col("_cue") & (effective <= SHORT_SYLLABLES) & (F.col("_chars") <= SHORT_CHARS * effective)
    capped = measured.withColumn(
        "frame_cap",
        F.when(F.col("cue_only"), F.least(long_cap, F.lit(SINGLE_WORD_FRAMES)))
        .when(is_short, F.least(long_cap, short_cap))
        .otherwise(long_cap),
    )
    expected = F.when(
        F.col("cue_only"), F.col("frame_cap") / FRAMES_PER_SECOND * SYLLABLES_PER_SECOND
    ).otherwise(F.col("syllables").cast("double"))
    seconds = F.when(expected < 1, 1.0).otherwise(expected / SYLLABLES_PER_SECOND)
    budget = F.round(seconds * SLOWER_THAN_REALTIME * 1000).cast("bigint") + OVERHEAD_MS
    return capped.withColumn(
        "budget_ms", F.least(F.greatest(budget, F.lit(MIN_BUDGET_MS)), F.lit(MAX_BUDGET_MS))
    ).drop("_cue", "_chars")


# -- audio merging -------------------------------------------------------------------

FORMAT_FIELDS = ("sample_rate", "channels", "bits", "audio_format")


def audio_compatibility(clips: DataFrame) -> DataFrame:
    """Whether all clips of a document share one format, and the first field that differs."""
    spread = clips.groupBy("document_id").agg(
        *[F.min_by(f, "idx").alias(f) for f in FORMAT_FIELDS],
        *[(F.min(f) != F.max(f)).alias(f"_{f}") for f in FORMAT_FIELDS],
    )
    first = F.coalesce(*[F.when(F.col(f"_{f}"), F.lit(f)) for f in FORMAT_FIELDS])
    return spread.select(
        "document_id", *FORMAT_FIELDS, first.isNull().alias("compatible"), first.alias("differs_in")
    )


def merge_plan(sentences: DataFrame, clips: DataFrame) -> DataFrame:
    """Byte offset of every clip in the merged file."""
    sized = sentences.select("document_id", "idx").join(
        clips.select("document_id", "idx", "data_bytes"), ["document_id", "idx"], "left"
    )
    placed = running(
        sized, ["document_id"], ["idx"], [slice_of("idx")],
        {"_before": ("sum", F.coalesce("data_bytes", F.lit(0)).cast("bigint"))},
    )
    return placed.select("document_id", "idx", "data_bytes", (F.col("_before") + 44).alias("offset"))


def merge_totals(plan: DataFrame, compatibility: DataFrame) -> DataFrame:
    """Total size per document and why it cannot be merged, if it cannot."""
    sums = plan.groupBy("document_id").agg(
        F.count_if(F.col("data_bytes").isNull()).alias("without_audio"),
        F.count("data_bytes").alias("with_audio"),
        (F.coalesce(F.sum("data_bytes"), F.lit(0)) + 44).alias("total_bytes"),
    )
    return sums.join(compatibility, "document_id", "left").select(
        *sums.columns,
        F.when(F.col("with_audio") == 0, "no_audio")
        .when(F.col("without_audio") > 0, "incomplete")
        .when(~F.col("compatible"), "mixed_formats")
        .when(F.col("total_bytes") - 8 > 2**32 - 1, "too_large")
        .alias("refused"),
    )


def estimate_bytes(ms: Column, sample_rate: int = 24_000, channels: int = 1, bits: int = 16) -> Column:
    return F.lit(44) + F.round(ms * (sample_rate * channels * (bits // 8)) / 1000).cast("bigint")


def little_endian(n: Column, size: int) -> Column:
    """An unsigned integer as ``size`` bytes, lowest first."""
    digits = F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def wav_header(data_bytes: Column, fmt: Column, channels: Column, rate: Column, bits: Column) -> Column:
    """The 44 bytes before uncompressed samples."""
    frame = channels * F.floor(bits / 8)
    return F.concat(
        F.encode(F.lit("RIFF"), "UTF-8"), little_endian(data_bytes + 36, 4),
        F.encode(F.lit("WAVEfmt "), "UTF-8"), little_endian(F.lit(16), 4),
        little_endian(fmt, 2), little_endian(channels, 2), little_endian(rate, 4),
        little_endian(rate * frame, 4), little_endian(frame, 2), little_endian(bits, 2),
        F.encode(F.lit("data"), "UTF-8"), little_endian(data_bytes, 4),
    )


def merge_audio(clips: DataFrame, budget: int = PART_BUDGET) -> DataFrame:
    """The merged audio of each document as ordered byte parts.

    ``clips`` holds ``(document_id, idx, data, audio_format, channels, sample_rate, bits)``
    of the documents that ``merge_totals`` does not refuse.  Part 0 starts with the header.
    """
    totals = clips.groupBy("document_id").agg(
        F.sum(F.length("data")).alias("total"),
        *[F.min_by(f, "idx").alias(f) for f in FORMAT_FIELDS],
    )
    sized = parts(
        clips.select("document_id", "idx", "data"), ["document_id"], ["idx"], [slice_of("idx")],
        F.length("data"), budget,
    )
    body = sized.groupBy("document_id", "part").agg(
        F.expr("listagg(data) within group (order by idx)").alias("bytes")
    )
    header = wav_header(
        F.col("total"), F.col("audio_format"), F.col("channels"), F.col("sample_rate"), F.col("bits")
    )
    return body.join(totals, "document_id").select(
        "document_id", "part",
        F.when(F.col("part") == 0, F.concat(header, F.col("bytes"))).otherwise(F.col("bytes")).alias("bytes"),
    )
