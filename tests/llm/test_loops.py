"""Vectors by plain loops, columns of clashing names, empty tables and odd rows in every operator and stage."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import near
from test_llm import DOCS, ODD, PIECES, SMALL, WORDS, frame, rng_text

from lectern.llm import bpe, counts, decontaminate, divergence, langid, quality, simhash, spelling, suffix, toxicity

# -- vectors by plain loops ----------------------------------------------------------


def test_context_vectors_by_a_plain_loop(spark):
    rng = random.Random(1)
    words = ["the", "cat", "Sat", "on", "mat", "9", "é", "!!", "漢字"]
    rows = [(i, rng_text(rng, words, rng.randint(0, 40)), "en", "s", 1) for i in range(40)] + [(50, "long words " * 40_000, None, None, None), (51, "", None, None, None)]
    docs = frame(spark, rows)
    model = quality.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    n = Counter(t.lower() for _, text, *_ in {(r[0] % 2, r[1]) for r in rows} for t in re.findall(r"\w+|[^\w\s]+", text))
    assert {w for w in model.known if w[0] != "\0" and w[0] != "!"} == {w for w, k in n.items() if k >= 5 and w != "!!"}
    sums = {w: np.zeros(quality.DIMENSIONS) for w in model.known}
    for _, text in {(r[0] % 2, r[1]) for r in rows}:
        tokens = re.findall(r"\w+|[^\w\s]+", text)
        low = [t.lower() for t in tokens]
        named = [w if w in model.known else s for w, s in zip(low, quality.shapes_of(tokens, low))]
        for i, a in enumerate(named):
            for j in (i + 1, i + 2):
                if j < len(named):
                    sums[a] += quality.index_vector(named[j])
                    sums[named[j]] += quality.index_vector(a)
    for w, i in model.known.items():
        size = np.sqrt((sums[w] ** 2).sum()) or 1
        assert np.allclose(model.vectors[i], quality.index_vector(w) + sums[w] / size, atol=1e-5), w
    assert not model.vectors[len(model.known)].any()


def test_bundles_and_cosines_by_a_plain_loop(spark):
    rng = random.Random(2)
    kinds = {"en": "the and of", "de": "der und ß", "fr": "le et ça"}
    rows = [(i, rng_text(rng, kinds[lang].split(), rng.randint(0, 12)) + " 7!", lang, "s", 1) for i, lang in enumerate(list(kinds) * 8)]
    rows += [(90, None, "en", "s", 1), (91, "ça", None, "s", 1)]
    letters = langid.Letters(langid.DIMENSIONS)

    def bundle(text):
        clean = " " + re.sub(r"[^a-zßç]+", " ", (text or "").lower()).strip() + " "
        out = np.zeros(langid.DIMENSIONS)
        for i in range(len(clean) - 2 if clean.strip() else 0):
            out += np.roll(letters[ord(clean[i + 2])], 0).astype(int) * np.roll(letters[ord(clean[i + 1])], 1) * np.roll(letters[ord(clean[i])], 2)
        return out

    sums = {lang: sum(bundle(t) for _, t, own, *_ in rows if own == lang) for lang in kinds}
    normed = {lang: v / np.sqrt(v @ v) for lang, v in sums.items()}
    centre = sum(normed.values()) / 3
    want = {lang: v - centre for lang, v in normed.items()}
    docs = frame(spark, rows)
    model = langid.prototypes(docs)
    got = {r["lang"]: np.array(r["prototype"]) for r in model.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[lang], want[lang]) for lang in want)
    for r in langid.predict(docs, model).collect():
        v = bundle(r["text"])
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosine = {lang: v @ p / np.sqrt(v @ v) / np.sqrt(p @ p) for lang, p in want.items()}
        best = max(sorted(cosine), key=cosine.get)
        share = 1 / sum(np.exp(langid.SHARPNESS * (c - cosine[best])) for c in cosine.values())
        assert r["lang_pred"] == best and r["score"] == pytest.approx(share, abs=1e-4)


# -- pieces of long texts and hashed prefixes, outside of tasks ------------------------


def test_pieces_cut_no_word(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("aéÀ× 漢1\n") for _ in range(4000))
    whole = [w for part in spelling.runs(text) for w in part], [w for part in divergence.terms(text.encode()) for w in part]
    monkeypatch.setattr(spelling, "PIECE", 37)
    monkeypatch.setattr(divergence, "PIECE", 37)
    assert ([w for part in spelling.runs(text) for w in part], [w for part in divergence.terms(text.encode()) for w in part]) == whole
    assert len(list(spelling.runs(text))) > 50


@pytest.mark.parametrize("literal", [65, 7, 2])
def test_rotations_meet_exactly_the_words_one_edit_apart(monkeypatch, literal):
    monkeypatch.setattr(spelling, "LITERAL", literal)
    rng = random.Random(literal)
    words = sorted({"".join(rng.choice("aabé") for _ in range(rng.randint(4, 8))) for _ in range(200)} | {"aaaaaa", "aaaaaaa"})
    groups = {}
    for w in words:
        for prefix, letter, first in spelling.rotations(w):
            groups.setdefault(prefix, []).append((w, letter, first))
    met = Counter()
    for group in groups.values():
        for a in group:
            for b in group:
                if a[0] < b[0] and (a[1] and b[1] or a[1] and a[2] and not b[1] or b[1] and b[2] and not a[1]):
                    met[a[0], b[0]] += 1
    assert met == {(a, b): 1 for a in words for b in words if a < b and near(a, b)}


def test_prefix_lengths_are_counted():
    rng = random.Random(5)
    for _ in range(20):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 50))) for _ in range(4)]
        data = np.frombuffer(b"\xff".join(b"".join(rng.choices(base, k=rng.randint(1, 7))) for _ in range(5)) + b"\xff", np.uint8)
        for depth in (8, 24, 40):
            order = suffix.suffix_array(data, depth)
            got = suffix.adjacent_prefixes(data, order, depth)
            raw = data.tobytes()
            for i in range(1, len(order)):
                a, b = raw[order[i - 1] :], raw[order[i] :]
                n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert min(got[i], depth) == min(n, depth) and got[i] <= n


# -- clashing names, empty tables, odd rows --------------------------------------------


ADDED = {
    "counts": (lambda d: counts.token_counts(d, PIECES), ("n_words", "n_tokens")),
    "bpe": (lambda d: bpe.encode_decode(d, WORDS), ("ids", "decoded")),
    "repeats": (lambda d: suffix.remove(suffix.repeats(d, length=20, anchor=8)), ("kept", "removed", "runs")),
}


@pytest.mark.parametrize("name", ADDED)
def test_columns_of_added_names_are_replaced(spark, name):
    run, added = ADDED[name]
    docs = frame(spark, ODD)
    clash = docs.select("*", *[F.lit("old").alias(c) for c in (*added, "spans", "anchor", "word", "_row")])
    got, plain = run(clash), run(docs)
    assert set(got.columns) - {"spans"} == {*plain.columns, "anchor", "word", "_row", *(set() if name == "repeats" else {"spans"})} - {"spans"}
    key = lambda q: sorted(map(repr, q.select(*plain.columns).collect()))
    assert key(got) == key(plain)
    assert run(docs.limit(0)).count() == 0


def test_models_score_clashing_columns_odd_rows_and_empty_tables(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = frame(spark, ODD).select("*", F.lit("old").alias("score"), F.lit("old").alias("lang_pred"), F.lit(1).alias("mean"), F.lit(2).alias("word"))
    proto = langid.prototypes(docs)
    for found in (quality.score(odd, quality.fit(docs, labels)), toxicity.score(odd, toxicity.fit(docs, labels)), langid.predict(odd, proto)):
        rows = found.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows) and len(set(found.columns)) == len(found.columns)
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    empty = frame(spark, [])
    assert langid.predict(empty, proto).count() == toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert langid.predict(frame(spark, ODD), langid.prototypes(empty)).where("lang_pred <> 'und'").count() == 0
    assert decontaminate.clean(frame(spark, ODD), frame(spark, [], "item_id long, text string")).count() == len(ODD)
    assert simhash.near_duplicates(empty, "doc_id", "text", shingle=4, radius=4).count() == 0


def test_stages_take_odd_rows_and_empty_tables_in_a_row(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    odd = docs.unionByName(frame(spark, ODD)).unionByName(frame(spark, [], DOCS))
    for start in (odd, frame(spark, [])):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.saved(stage(spark, now, SMALL), "odd")
            if name != "bpe":
                assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {"doc_id", "n_tokens"} <= set(now.columns) and (now.count() > 0) == (start is odd)
