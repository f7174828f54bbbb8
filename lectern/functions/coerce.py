"""Tolerant decoding: unknown names, broken JSON and odd numbers degrade to defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SPEED, MAX_SPEED = 0.5, 2.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_enum(c: Column | str, allowed, fallback: str) -> Column:
    value = _col(c)
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def decode_json(c: Column | str) -> Column:
    """A JSON object as a string map; anything else is the empty map."""
    empty = F.create_map().cast("map<string,string>")
    value = _col(c)
    # As the only element of an array the text has to be one value and nothing else.
    only = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    return F.coalesce(F.when(value.rlike("^\\s*\\{") & (F.size(only) == 1), only[0]), empty)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def parse_options(c: Column | str) -> Column:
    """``struct<voice_id, speed, volume>`` from an options object, null when it is not one."""
    # As the only element of an array the text has to be one value and nothing else.
    only = F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit("]")))
    doc = F.when(F.try_variant_get(only, "$[1]", "variant").isNull(), F.try_variant_get(only, "$[0]", "variant"))

    def typed(field: str, kind: str, type_pattern: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))
        return F.when(found.rlike(type_pattern), F.try_variant_get(doc, f"$.{field}", kind))

    number = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"
    voice = typed("voiceId", "string", "^STRING")
    return F.when(
        F.schema_of_variant(doc).startswith("OBJECT"),
        F.struct(
            F.when(voice != "", voice).alias("voice_id"),
            clamp(F.coalesce(typed("speed", "double", number), F.lit(1.0)), MIN_SPEED, MAX_SPEED)
            .alias("speed"),
            clamp(F.coalesce(typed("volume", "double", number), F.lit(1.0)), 0.0, 1.0).alias("volume"),
        ),
    )


# Fixed value: the speech formats a stored default may name.
ENUMS_SPEECH_FORMATS = ("wav", "mp3")
