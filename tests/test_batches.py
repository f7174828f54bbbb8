"""Batches and frames that pass through Python workers are bounded by their bytes."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import speech as P
from lectern.operators import stats as S
from lectern.operators import tokens as K
from lectern.session import RUNTIME, tune
from lectern.sources import epub, html


def test_frames_are_bounded():
    rows = [(i, "x" * (i % 7 * 100), None) for i in range(500)] + [(500, "y" * 5000, b"z" * 5000)]
    got = list(html.frames(rows, ["id", "text", "data"], size=2000))
    assert len(got) > 50 and max(len(f) for f in got) <= 32
    assert pd.concat(got)["text"].tolist() == [r[1] for r in rows] and pd.concat(got)["id"].tolist() == list(range(501))
    assert list(html.frames([], ["id"])) == []


def test_pages_come_in_parts(spark):
    """A batch of long pages gives several frames, whose blocks are those of every page."""
    pages = [(i, f"<h1>T{i}</h1>" + f"<p>{'word ' * 20_000}{i}</p>" * 2) for i in range(30)]
    df = tune(spark).createDataFrame([*pages, (30, None)], "page_id long, html string").coalesce(1)
    got = sorted((r["page_id"], r["ord"], r["content"]) for r in html.html_to_blocks(df).collect())
    assert got == [(k, i, b[2]) for k, page in pages for i, b in enumerate(html.blocks_of(page))]
    sizes = df.withColumn("data", F.encode("html", "UTF-8")).mapInPandas(
        lambda batches: (pd.DataFrame({"n": [b["data"].map(lambda d: len(d or b"")).sum()]}) for b in batches), "n long")
    assert int(RUNTIME["spark.sql.execution.arrow.maxBytesPerBatch"]) <= 8 << 20
    assert sizes.count() > 1 and sizes.agg(F.max("n")).first()[0] < 8 << 20
    none = spark.createDataFrame([("a", b"no zip")], "document_id string, content binary")
    assert [r["failure"] for r in epub.epub_to_blocks(none).collect()] == ["damaged"]


def test_ids_come_in_parts(spark):
    words = K.Vocabulary({s: i for i, s in enumerate(K.byte_symbols())} | {"ab": 256}, [("a", "b")])
    rows = [(i, "ab" * (i % 5) if i % 11 else None) for i in range(3 * K.ROWS + 1)]
    got = K.bpe_tokenize(spark.createDataFrame(rows, "i int, text string").coalesce(1), words).collect()
    assert {r["i"]: r["ids"] for r in got} == {i: [256] * len((t or "")[::2]) for i, t in rows}


def test_syllables_are_runs_of_vowels_between_which_marks_do_not_count(spark):
    rng, letters = random.Random(3), [*P.IPA_VOWELS, *"ːˈˌ059", *"btkñ漢😀 -/<"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(2000)] + [None, ""]
    cost = P.speech_cost(spark.createDataFrame([(t,) for t in texts], "phonemes string"))
    assert "ɐ]" not in cost._jdf.queryExecution().toString() and "regexp_replace(regexp_replace" not in cost._jdf.queryExecution().toString()
    want = {t: len(re.findall(f"[{P.IPA_VOWELS}]+", re.sub(f"[{P.TRANSPARENT_MARKS}]", "", t))) for t in texts if t is not None}
    got = {r["phonemes"]: r["syllables"] for r in cost.collect()}
    assert got.pop(None) is None and got == want


def test_the_best_items_need_no_join(spark):
    """Few items of a group keep one order; the same rows come from the sliced form for large groups."""
    rng = random.Random(5)
    rows = [(g if g else None, i, rng.choice([None, 1.0, 2.5, rng.random()])) for g in range(6) for i in range(g * 7 + 1)]
    df = spark.createDataFrame(rows, "g int, item long, score double")
    few = S.nucleus(df, ["g"], 0.8, 10, 0.9)
    assert "Join" not in few._jdf.queryExecution().toString()
    shown = lambda q: sorted((r["g"], r["rank"], r["item"], r["probability"] and round(r["probability"], 12)) for r in q.collect())
    assert shown(few) == shown(S.nucleus(df, ["g"], 0.8, 10, 0.9, rows=5)) and few.where("g is null").isEmpty()
