"""Spelling variants, source divergence and mixing against brute force on small fixtures, and against their SQL."""

import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from test_llm import ODD, frame

from lectern.llm import divergence, mixing, queries, spelling

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_spelling", "op12_divergence", "op13_mixing"])
def test_query_matches_its_sql(spark, name):
    from oracle_check import compare, connect

    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) is None


# -- spelling ------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_variants(counts, ratio=5):
    out = {}
    for w in counts:
        others = sorted((o for o in counts if near(w, o)), key=lambda o: (-counts[o], o))
        form = others[0] if others and counts[others[0]] >= ratio * counts[w] else None
        out[w] = (form, len(others))
    rows = {}
    for w, (form, n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows[w] = (form, root, counts[w], n, counts[form] if form else None)
    return rows


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("literal", [65, 7])
def test_variants_meet_every_edit(spark, monkeypatch, literal):
    monkeypatch.setattr(spelling, "LITERAL", literal)
    rng = random.Random(literal)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(5, 8))) for _ in range(260)} | {"aaaaaa", "aaaaaaa", "aaaaab"}
    words |= {"x" * 63 + "y" * i for i in range(5)} | {"x" * 66, "x" * 65 + "z", "é" * 70, "é" * 71}
    counts = {w: rng.choice((5, 6, 25, 30, 125, 130, 700, 3500)) for w in words}
    rows = [(w, n, "extra") for w, n in counts.items()]
    got = found(spelling.variants(frame(spark, rows, "word string, n long, place string")))
    assert got == all_variants(counts)
    assert any(form for form, *_ in got.values()) and any(root != (form or w) for w, (form, root, *_) in got.items())


def test_words_of_texts(spark, monkeypatch):
    rng = random.Random(3)
    stems = ["Größe", "straßen", "house×s", "SEPARATE", "seperate", "ÀLAMODE", "alamode", "Ünder", "ab1cdefgh"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(stems) + rng.choice(["", ".", "…", "漢", "1"]) for _ in range(60)), "en", "s", 1) for i in range(60)]
    rows += [*ODD, rows[0], rows[0], (9, "longer " * 500 + "b" * 4000, None, None, 1)]
    want = Counter()
    for id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    want = {w: n for w, n in want.items() if n >= 5}
    docs = frame(spark, rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert {r["word"]: r["n"] for r in spelling.words(docs, one_in=3).collect()} == want
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "ENTRIES", 3)
    assert {r["word"]: r["n"] for r in spelling.words(docs, one_in=3).collect()} == want
    assert found(spelling.variants(spelling.words(docs, one_in=3))) == all_variants(want)
    assert spelling.variants(spelling.words(frame(spark, []))).count() == 0


# -- divergence ----------------------------------------------------------------------


def all_divergence(rows, least, k):
    texts = [((lang or "", source or ""), re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for (lang, source), terms in texts:
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        groups = sorted(s for g, s in n if g == lang)
        total = {s: sum(n[lang, s][t] for t in kept) for s in groups}
        whole = {t: sum(n[lang, s][t] for s in groups) for t in kept}
        share = lambda c, size: 1 + 10**9 * (c + 2) // (size + 2 * len(kept))
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in groups}
        q = {t: share(whole[t], sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            single = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", single, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("least,k", [(3, 10), (2, 2), (1000, 10)])
def test_divergence(spark, monkeypatch, least, k):
    monkeypatch.setattr(divergence, "ENTRIES", 40)
    monkeypatch.setattr(divergence, "PIECE", 64)
    rng = random.Random(least)
    words = [f"{a}{b}" for a in ("tre", "Ö", "漢字", "HE", "a", "\u0080z", "zz") for b in ("", "x", "é", "q-1")]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1 + (len(s or "") + i) % 3) for i in range(len(words))], k=rng.randint(0, 90))), lang, s)
            for _ in range(60) for lang, s in [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "bb", "ü", None]))]]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("one two", "fr", "a"), ("7 8", "it", None), rows[0], rows[0]]
    docs = frame(spark, rows, "text string, lang string, source string").repartition(5)
    clash = docs.selectExpr("*", "1 as n", "'x' as term", "2 as value", "3 as total", "4 as docs")
    assert sorted(map(tuple, divergence.divergence(clash, least=least, k=k).collect())) == all_divergence(rows, least, k)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_skyband_keeps_what_few_dominate(spark):
    rng = random.Random(8)
    rows = [("en", rng.choice("ab"), f"t{rng.randrange(10**6):06d}", rng.randrange(12), 0) for _ in range(900)]
    rows = [(a, b, t, n, n + rng.randrange(9)) for a, b, t, n, _ in {r[2]: r for r in rows}.values()]
    kept = divergence.skyband(frame(spark, rows, "lang string, source string, term string, n long, lang_n long").coalesce(1), 3)
    above = lambda a, b: a[1] == b[1] and a[3] >= b[3] and a[4] <= b[4] and a[2] < b[2]
    assert {r["term"] for r in kept.collect()} == {r[2] for r in rows if sum(above(o, r) for o in rows) < 3}
    docs = frame(spark, [(1, "word", None, None, 1)]).select("text", "lang", "source")
    assert divergence.term_counts(docs).where("term is null").count() == 1


# -- mixing --------------------------------------------------------------------------


def all_targets(sizes, weights, percent, epochs):
    left, active, out = Fraction(percent * sum(sizes.values()), 100), set(sizes), {}
    while active:
        whole = sum(weights[s] for s in active)
        above = {s for s in active if left * weights[s] / whole > epochs * sizes[s]}
        if not above:
            return out | {s: left * weights[s] / whole for s in active}
        for s in above:
            out[s] = Fraction(epochs * sizes[s])
            left -= out[s]
        active -= above
    return out


@pytest.mark.parametrize("percent,epochs,seed", [(150, 2, 1), (90, 3, 2), (450, 3, 3), (100, 1, 4)])
def test_mix(spark, percent, epochs, seed):
    rng = random.Random(seed)
    rows = [(i, " \t".join(["w"] * rng.choice((0, 1, 3, 40, 700))), "en", rng.choice(["a"] * 9 + ["b", "B", "ü", "\U0001F600", "zz", None]), 1) for i in range(400)]
    rows += [*ODD, (7, "lone", None, "one", 1), (8, "", None, "empty", 1)] + [(5, "same row of five words", "en", "a", 1)] * 30
    docs = frame(spark, rows).selectExpr("*", "1 as size", "'x' as draw", "2 as taken", "'y' as weight", "'z' as cell").repartition(3)
    weights = mixing.cycle_weights(docs, [5, 2, 1])
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    turn = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    assert {r["source"]: r["weight"] for r in weights.collect()} == turn
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = Counter({s: 0 for s in names})
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = all_targets(sizes, turn, percent, epochs)
    mixed = mixing.mix(docs, weights, percent, epochs, seed=seed)
    got = mixed.collect()
    assert len(got) == len(rows) and {"weight", "cell"} <= set(mixed.columns)
    taken = Counter()
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]])) and 0 <= r["taken"] <= epochs * r["size"]
        taken[r["source"]] += r["taken"]
        if r["size"]:
            assert r["taken"] // r["size"] in (int(want[r["source"]] / sizes[r["source"]]), int(want[r["source"]] / sizes[r["source"]]) + 1)
    assert {s: taken[s] for s in names} == {s: int(want[s]) for s in names}
    parts = Counter(r["source"] for r in got if r["size"] and r["taken"] % r["size"])
    assert max(parts.values(), default=0) <= 1
    again = mixing.mix(docs.repartition(7), weights, percent, epochs, seed=seed)
    key = lambda df: sorted(map(repr, df.select("doc_id", "text", "source", "taken").collect()))
    assert key(again) == key(mixed)
    texts = mixing.repeated(mixed).collect()
    per = Counter()
    for r in texts:
        per[r["source"]] += size(r["text"])
    assert {s: per[s] for s in names} == {s: taken[s] for s in names}
    assert mixing.mix(docs.limit(0), weights).count() == 0 and mixing.mix(docs, weights.where("source = 'a'")).where("source <> 'a'").isEmpty()


def test_mix_draws_inside_one_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_DIGITS", 1)
    monkeypatch.setattr(mixing, "LEVELS", 1)
    rows = frame(spark, [(i, "s", 3, f"{i % 2:x}{'0' * 31}") for i in range(1000)], "doc_id long, source string, size long, draw string")
    got = mixing.allot(rows, frame(spark, [("s", 1)], "source string, weight long")).collect()
    assert sum(r["taken"] for r in got) == 4500 and all(3 <= r["taken"] <= 6 for r in got)
    assert all(r["taken"] == (6 if r["draw"][0] == "0" else 3) for r in got)
