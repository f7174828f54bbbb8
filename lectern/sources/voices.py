"""The voice catalogue: one JSON document to one row per usable voice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOGUE = (
    "default_voice string, presets map<string, struct<description string, gender string, region string,"
    " style string, aliases array<string>, codes array<array<double>>, speaker_emb array<double>>>"
)


def read_voices(catalogues: DataFrame, json: str = "json") -> DataFrame:
    """Voices in catalogue order; presets without codes or embedding are dropped."""
    keys = [c for c in catalogues.columns if c != json]
    parsed = catalogues.select(*keys, F.from_json(json, CATALOGUE).alias("c"))
    usable = parsed.select(
        *keys, F.col("c.default_voice").alias("default_voice"), F.posexplode("c.presets").alias("pos", "id", "v")
    ).filter((F.size("v.codes") > 0) & F.col("v.speaker_emb").isNotNull())
    return usable.select(
        *keys, "default_voice", "pos", "id", "v.description", "v.gender", "v.region", "v.style",
        F.coalesce("v.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.col("v.speaker_emb").cast("array<float>").alias("embedding"),
        F.flatten("v.codes").cast("array<int>").alias("codes"),
        F.size("v.codes").alias("frames"),
        F.size(F.get("v.codes", 0)).alias("codebooks"),
    )
