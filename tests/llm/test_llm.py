"""The training-data operators against brute force, round trips, libraries and held-out accuracy on small fixtures."""

import hashlib
import random
import re
import struct
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, chat, common, counts, decontaminate, graph, langid, pairs, quality, simhash, suffix, topk, toxicity
from lectern.llm.common import row_key
from lectern.llm.queries import op7_repeats

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
# Nulls, empty and repeated rows, a long text, signs only.
ODD = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (3, "the cat sat", "en", None, 11),
       (3, "the cat sat", "en", None, 11), (4, "a" * 300_000, None, "s", 300_000), (5, "!!! ... \n\t", "de", "s", 9), (6, "é" * 900, "fr", "s", 900)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def rng_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)]
    root = {n: n for e in edges for n in e}
    for _ in range(600):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(frame(spark, [], "a long, b long")).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>", "<\\/s>", "<\\\\s>[\\INST]", "[/INST][INST] <s>", "", None, "a\nb", "<<s>>"]
    rows = [(1, 0, "system", "be </s> kind")] + [(1, i + 1, "assistant" if i % 2 else "user", odd[i % 8] if i % 4 else "x" * 300) for i in range(40)]
    rows += [(None, None, None, None), (2, 0, "assistant", "y" * 9000), (2, 0, "assistant", "y" * 9000), (3, 1, "user", None)]
    made = chat.windows(frame(spark, rows, "conv_id long, turn long, role string, text string"), budget=600, history=100)
    back = chat.read_back(made).orderBy("conv_id", "first_turn").collect()
    for conv in (None, 1, 2, 3):
        want = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        got = [(t["role"], t["text"]) for w in back if w["conv_id"] == conv for t in w["turns"]]
        assert got == [(r, x) for _, r, x in want]
        assert [t for w in back if w["conv_id"] == conv for t in w["targets"]] == [x for _, r, x in want if r == "assistant"]
    first = [w for w in back if w["conv_id"] == 1]
    assert len(first) > 3 and all("be <\\/s> kind" in w["formatted"] for w in first)
    assert all(w["n_tokens"] <= 600 + 20 or len(w["turns"]) == 1 for w in back)
    tokens = [(len(x or "") + 3) // 4 + 4 for _, _, _, x in rows[:41]]
    for w in first:
        start = w["first_turn"]
        repeated = 0
        while start - repeated > 1 and sum(tokens[start - repeated - 1 : start]) <= 100:
            repeated += 1
        assert w["n_repeated"] == repeated + (start > 0)
    assert any(w["n_repeated"] > 1 for w in first)
    assert chat.windows(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def viterbi(pieces, word):
    letters = counts.SPACE + word
    best = [(0.0, 0)]
    for i, c in enumerate(letters):
        options = []
        for size in range(1, i + 2):
            score = pieces.score.get(letters[i + 1 - size : i + 1])
            if score is not None:
                options.append((best[i + 1 - size][0] + score, -size, best[i + 1 - size][1] + 1))
        if c not in pieces.score:
            n = len(c.encode())
            options.append((best[i][0] + n * pieces.byte, -1, best[i][1] + n))
        top = max(options)
        best.append((top[0], top[2]))
    return best[-1][1]


def test_token_counts(spark, monkeypatch):
    pieces = counts.Pieces(PIECES)
    rng = random.Random(2)
    words = ["".join(rng.choice("thaenrisoé漢\x07'") for _ in range(rng.randint(1, 20))) for _ in range(400)] + ["ab" * 700]
    known = counts.Trie(pieces)
    assert [known[w] for w in words] == [viterbi(pieces, w) for w in words]
    monkeypatch.setattr(counts, "NODES", 50)
    small = counts.Trie(pieces)
    assert [small[w] for w in words] == [known[w] for w in words]
    got = counts.token_counts(frame(spark, ODD), PIECES).collect()
    assert [(r["n_words"], r["n_tokens"]) for r in got[:3]] == [(0, 0)] * 3
    assert got[3]["n_words"] == 3 and got[3]["n_tokens"] == sum(known[w] for w in ("the", "cat", "sat"))
    assert counts.token_counts(frame(spark, []), PIECES).count() == 0


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = quality.score(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).select("quality", "score").collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in got) >= 0.93 * len(got)
    odd = quality.score(frame(spark, ODD), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[2]["score"] == pytest.approx(model.prior)
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(frame(spark, ODD), none).collect()} == {0.5}
    assert quality.score(frame(spark, []), model).count() == 0


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    library, known = Tokenizer.from_file(WORDS), bpe.Vocabulary(WORDS)
    rng = random.Random(3)
    signs = list("aAeéÉ  '\"sStTrRΣςİﬁ<|endoftext|>\0́123!?.,\n\t€漢字\x85 Ᲊ")
    whole = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 150))) for _ in range(400)]
    whole += ["x<|endoftext|>y<|startoftext|>", "abcdefinthan" * 300, "it's we'll 'S", ""]
    for t in whole:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(known.encode(t), "<u4").tolist() == ids
        assert known.decode(known.encode(t)) == library.decode(ids, skip_special_tokens=False)
    long = [known.letter[b] for b in b"thethethanin" * 9] + [known.last[ord("a")]]
    assert known.scan(list(long)) == known.heap(list(long))
    docs = frame(spark, ODD)
    rows = bpe.decode(bpe.encode(docs, WORDS), WORDS).collect()
    both = bpe.encode_decode(docs, WORDS).collect()
    assert [(r["ids"], r["decoded"]) for r in rows] == [(r["ids"], r["decoded"]) for r in both]
    assert rows[0]["ids"] == b"" and rows[0]["decoded"] == ""
    digest = bpe.digests(bpe.encode_decode(docs.where("doc_id = 3").limit(1), WORDS), "doc_id").first()
    ids = library.encode("the cat sat", add_special_tokens=False).ids
    assert digest["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and digest["n_tokens"] == len(ids)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.prototypes(docs.where("doc_id % 4 <> 0"))
    got = langid.predict(docs.where("doc_id % 4 = 0"), model).select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in got) >= 0.95 * len(got)
    odd = langid.predict(frame(spark, ODD), model).collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[6]["lang_pred"] == "und" and odd[3]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in langid.predict(frame(spark, ODD), langid.prototypes(frame(spark, []))).collect()} == {"und"}
    text = "Straße über alles " * 5000
    old, langid._CHUNK = langid._CHUNK, 1000
    try:
        parts = langid.grams(text)
    finally:
        langid._CHUNK = old
    assert all((a == b).all() for a, b in zip(parts, langid.grams(text)))


def slow_toxicity(rows, text):
    """Mean and largest log-likelihood difference of a text's distinct words, by dictionaries."""
    import math

    of = [Counter(w for t, y in rows if y == c for w in set(re.findall(r"\w+", (t or "").lower()))) for c in (0, 1)]
    every, words = sum(of[0].values()) + sum(of[1].values()), set(of[0]) | set(of[1])
    share = lambda w: (of[0][w] + of[1][w] + 0.5) / (every + 0.5 * (len(words) + 1))

    def log(c, w):
        k = Counter(of[c].values())
        off = toxicity.discounts(k[1], k[2], k[3], k[4])
        cut = lambda n: off[min(n, 3) - 1] if n else 0.0
        total = sum(of[c].values())
        return math.log((of[c][w] - cut(of[c][w])) / total + sum(cut(n) for n in of[c].values()) / total * share(w))

    def gain(w):
        if w in words:
            return log(1, w) - log(0, w)
        free = lambda c: math.exp(log(c, w)) / share(w)
        return math.log(free(1) / free(0))

    found = [gain(w) for w in set(re.findall(r"\w+", (text or "").lower()))]
    return (sum(found) / len(found), max(found), len(found)) if found else (0.0, 0.0, 0)


@pytest.mark.parametrize("head", [0, 3, 10_000])
def test_toxicity_evidence_equals_dictionaries(spark, head):
    rng = random.Random(16)
    words = [f"w{i}" for i in range(60)] + ["é", "Ü", "漢"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(63)], k=rng.randint(0, 30))) + (" vile" if i % 4 == 0 and i % 3 else ""), "en", "s", 1) for i in range(120)]
    rows += [(200, None, None, None, None), (201, "w1 " * 200_000 + "vile unseen", None, None, None)]
    docs = frame(spark, rows).withColumn("gain", F.lit(1)).withColumn("word", F.lit("x")).withColumn("n", F.lit(2))
    model = toxicity.fit(docs, frame(spark, [(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"))
    back = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    counted = [(t, i % 4 == 0) for i, t, *_ in rows if i < 120 and i not in back]
    got = toxicity.evidence(docs.select("doc_id", "text"), model, head=head).join(
        docs.select(*row_key("doc_id", "text"), "doc_id"), ["_k1", "_k2"]).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r["mean"], r["most"], r["n"]) == pytest.approx(slow_toxicity(counted, text[r["doc_id"]]))
    scored = toxicity.score(docs.unionByName(docs).withColumn("score", F.lit("old")), model)
    assert scored.count() == 2 * len(rows) and set(scored.columns) == {*docs.columns, "score"}
    assert toxicity.score(docs.limit(0), model).count() == 0


def slow_pairs(rows, text):
    """Mean log-likelihood difference of all pairs of neighbouring words of a text, by dictionaries."""
    import math

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    near = lambda t: list(zip(words(t), words(t)[1:]))
    of = [Counter(p for t, y in rows if y == c for p in near(t)) for c in (0, 1)]
    every, kinds = sum(of[0].values()) + sum(of[1].values()), set(of[0]) | set(of[1])

    def share(c, n, shared):
        k = Counter(of[c].values())
        off = toxicity.discounts(k[1], k[2], k[3], k[4])
        free = sum(off[min(x, 3) - 1] for x in of[c].values()) / sum(of[c].values())
        return (n - (off[min(n, 3) - 1] if n else 0)) / sum(of[c].values()) + free * shared

    shared = lambda p: (of[0][p] + of[1][p] + 0.5) / (every + 0.5 * (len(kinds) + 1))
    found = [math.log(share(1, of[1][p], shared(p)) / share(0, of[0][p], shared(p))) for p in near(text)]
    return sum(found) / len(found) if found else 0.0


@pytest.mark.parametrize("head", [0, 20, 10_000])
def test_toxicity_counts_every_pair_of_words(spark, monkeypatch, head):
    monkeypatch.setattr(pairs, "_AT_ONCE", 50)
    monkeypatch.setattr(pairs, "ENTRIES", 100)
    monkeypatch.setattr(pairs, "_KNOWN", 7)
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choices(["you", "are", "not", "bad", "é", "漢"], k=rng.randint(0, 40))), "en", "s", 1) for i in range(120)]
    rows += [(200, None, None, None, None), (201, "one", None, None, None), (202, "Not bad, not bad. not", None, None, None),
             (203, "bad not bad not not", None, None, None), (204, "new " * 300 + "bad", None, None, None)]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, frame(spark, [(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"))
    back = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    counted = [(t, i % 4 == 0) for i, t, *_ in rows if i < 120 and i not in back]
    asked = docs.unionByName(docs).select("doc_id", "text")
    got = toxicity.evidence(asked, model, pair_head=head).join(docs.select(*row_key("doc_id", "text"), "doc_id"), ["_k1", "_k2"]).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["pairs"] == pytest.approx(slow_pairs(counted, text[r["doc_id"]])), r["doc_id"]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[202]["mean"] == pytest.approx(by_id[203]["mean"]) and by_id[202]["pairs"] != pytest.approx(by_id[203]["pairs"])


def test_toxicity_calibration_meets_the_share_of_toxic_rows():
    rng = random.Random(19)
    rows = [(rng.gauss(-0.2, 0.1) + y, rng.gauss(1, 1) + y, -7 + rng.gauss(0, 0.01) + y / 100, y) for y in [0] * 60 + [1] * 6]
    weights, share = toxicity.calibrated(rows)
    found = [1 / (1 + np.exp(-np.dot(weights, (*r[:3], 1.0)))) for r in rows]
    assert share == pytest.approx(6 / 66) and sum(found) == pytest.approx(6, abs=1e-3)


def test_toxicity_fit_writes_its_counts_once(spark, monkeypatch):
    written, saved = [], toxicity.saved
    monkeypatch.setattr(toxicity, "saved", lambda df, name: written.append(name) or saved(df, name))
    docs = frame(spark, [(i, f"w{i % 9} w{i % 5}" + " vile" * (i % 4 == 0), "en", "s", 1) for i in range(60)])
    model = toxicity.fit(docs, frame(spark, [(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int"))
    assert written == ["words", "calibration", "met"] and model.table.columns == ["word", "gain", "n"]


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if i % 6 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["bad", "worse", "foulest", "foulish"])
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, int(i % 6 == 0)))
    labels += [(None, 1), (7, None), (8, 0)]
    docs, marks = frame(spark, rows), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id < 700 or doc_id is null"))
    got = toxicity.score(docs.where("doc_id >= 700"), model).collect()
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 6 == 0) for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(frame(spark, ODD), model).collect())
    blank = toxicity.fit(docs, marks.where("false"))
    assert len({r["score"] for r in toxicity.score(docs.limit(5), blank).collect()}) == 1


def removed(texts, length):
    whole = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in whole for i in range(len(x) - length + 1))
    out = []
    for x in whole:
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append((bytes(b for b, m in zip(x, mark) if not m), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))))
    return out


@pytest.mark.parametrize("key_bytes", [suffix.KEY_BYTES, 50])
def test_repeats(spark, monkeypatch, key_bytes):
    monkeypatch.setattr(suffix, "KEY_BYTES", key_bytes)
    rng = random.Random(6)
    words = ["the", "cat", "é", "sat", "on", "漢字", "mat", "of", "then"]
    passage = rng_text(rng, words, 60)
    texts = [rng_text(rng, words, rng.randint(0, 80)) for _ in range(25)]
    texts = [t[:40] + passage[rng.randrange(30) :] + t[40:] if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[0][:90] + "#" + texts[0][90:], "ab" * 200, None, "", "a" * 150, passage]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(99, "same row " * 12, None, None, None)] * 2 + [(None, texts[4], None, None, None)]
    docs = frame(spark, rows)
    for length, anchor in ((40, 12), (7, 7), (100, 33)):
        got = suffix.remove(suffix.repeats(docs, length=length, anchor=anchor)).collect()
        want = removed([r[1] for r in rows], length)
        key = lambda i, k: (i is None, i or 0, k)
        assert sorted(key(r["doc_id"], (bytes(r["kept"]), r["removed"], r["runs"])) for r in got) == sorted(key(r[0], w) for r, w in zip(rows, want))
    kept = suffix.remove(suffix.repeats(docs, length=7, anchor=4), characters=True).collect()
    assert all(bytes(r["kept"]).decode() is not None for r in kept)
    assert suffix.remove(suffix.repeats(frame(spark, []))).count() == 0


def words_removed(texts, length, n):
    """What repeated strings of ``length`` bytes and repeated rows of ``n`` words leave of every text."""
    spots = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    rows = [[(t or "").encode()[a:b].lower() for a, b in at] for t, at in zip(texts, spots)]
    seen = Counter(tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1))
    strings = Counter(x[i : i + length] for x in ((t or "").encode() for t in texts) for i in range(len(x) - length + 1))
    out = []
    for t, at, row in zip(texts, spots, rows):
        x = (t or "").encode()
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if strings[x[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        for i in range(len(row) - n + 1):
            if seen[tuple(row[i : i + n])] > 1:
                a, b = at[i][0], at[i + n - 1][1]
                mark[a:b] = b"\1" * (b - a)
        out.append(bytes(b for b, m in zip(x, mark) if not m))
    return out


@pytest.mark.parametrize("key_bytes", [suffix.KEY_BYTES, 50])
def test_repeats_of_words(spark, monkeypatch, key_bytes):
    monkeypatch.setattr(suffix, "KEY_BYTES", key_bytes)
    rng = random.Random(16)
    words = ["the", "Cat", "é", "sat", "on", "漢字", "mat", "of", "then", "a"]
    passage = rng_text(rng, words, 40)
    texts = [rng_text(rng, words, rng.randint(0, 60)) for _ in range(30)]
    texts = [t[:30] + passage[rng.randrange(30) :] + t[30:] if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [passage.replace(" ", "\n\t"), "  " + passage.upper() + "\x0b", "x " * 60, None, "", "é" * 90, texts[4]]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    for length, n in ((60, 8), (400, 12), (20, 30)):
        got = suffix.remove(suffix.repeats(docs, length=length, anchor=max(1, length // 3), words=n)).collect()
        assert {r["doc_id"]: bytes(r["kept"]) for r in got} == dict(enumerate(words_removed(texts, length, n)))
    assert suffix.repeats(frame(spark, []), words=5).count() == 0


def test_short_passages_of_many_words_leave_the_pipeline(spark):
    rng = random.Random(17)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage, short = own(52), own(30)
    assert len(passage) < 400
    texts = {i: f"{own(40)} {passage if i < 3 else short} {own(40)}" for i in range(6)}
    got = corpus_pipeline.without_repeats(spark, frame(spark, [(i, t, "en", "s", len(t)) for i, t in texts.items()]), SMALL).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: t.replace(passage, "") for i, t in texts.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_op7_marks_short_passages_of_many_words_and_removes_strings_only(spark, tmp_path):
    rng = random.Random(18)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage, long = own(52), own(90)
    texts = [f"{own(40)} {passage} {own(40)}", f"{own(9)}\n{passage.upper()}", f"{own(30)} {long}", f"{long} {own(30)}", own(120), "", None]
    frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7_repeats(spark, str(tmp_path)).collect()}
    assert [got[i]["has_passages"] for i in range(7)] == [True] * 4 + [False] * 3
    assert [got[i]["has_repeats"] for i in range(7)] == [False, False, True, True, False, False, False]
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(7)] == [
        (len((t or "").encode()), n, spans, hashlib.sha256(kept).hexdigest()) for t, (kept, n, spans) in zip(texts, removed(texts, 400))]


def test_strings_of_words_start_at_words():
    rng = random.Random(19)
    words = [f"w{i}".encode() for i in range(6)]
    parts = [[rng.choice(words) for _ in range(rng.randint(4, 60))] for _ in range(9)]
    codes = [suffix.word_codes(b" ".join(p)) for p in parts]
    assert [len(c) for c in codes] == [len(p) for p in parts]
    seen = Counter(tuple(p[i : i + 4]) for p in parts for i in range(len(p) - 3))
    assert [s.tolist() for s in suffix.repeated_words(codes, 4)] == [[i for i in range(len(p) - 3) if seen[tuple(p[i : i + 4])] > 1] for p in parts]


def _resident():
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * 4096 / 1e6


def test_workers_give_their_memory_back(monkeypatch):
    kept = []

    def hold(batches):
        kept.append([np.ones(10_000) for _ in range(2_000)][-1])  # 160 MB in pieces, the last of which stays
        yield from batches

    before = _resident()
    assert list(common.lean(hold)(iter([1, 2]))) == [1, 2]
    assert _resident() - before < 60
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    stopped = common.lean(hold)(iter([1, 2]))
    next(stopped)
    stopped.close()
    assert calls == [1]


def test_suffix_array_is_sorted():
    rng = random.Random(7)
    for letters in ("ab", "a", "abcdef"):
        data = np.frombuffer("".join(rng.choice(letters) for _ in range(300)).encode() + b"\xff", np.uint8)
        raw = data.tobytes()
        assert suffix.suffix_array(data, 304).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def slow_print(text, n=4):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot,at_once", [(simhash.HOT_BUCKET, simhash.AT_ONCE), (3, 300)])
def test_near_duplicates(spark, monkeypatch, hot, at_once):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    base = [rng_text(rng, words, 150).split() for _ in range(3)]
    rows = list(ODD[:4]) + [(7, "ÀB cd", None, None, None)]
    for i in range(60):
        own = list(base[i % 3])
        own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((100 - i, " ".join(own).upper(), None, None, None))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [slow_print(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((row[0] for row, s in zip(rows, root) if s == r and row[0] is not None), default=None) for r in root}
    want = Counter((row[0], p, least[r]) for row, p, r in zip(rows, prints, root))
    assert Counter((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_similar_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [rng_text(rng, words, 400).split() for _ in range(12)]
    rows = [(i, " ".join(b), None, None, None) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        near, far = list(b), list(b)
        near[50], near[300] = "x", "y"
        for k in range(0, 400, 12):
            far[k] = "z"
        rows += [(100 + i, " ".join(near), None, None, None), (200 + i, " ".join(far), None, None, None), (300 + i, " ".join(b), None, None, None)]
    got = {r["doc_id"]: r for r in simhash.similar_texts(frame(spark, rows)).collect()}
    assert all(got[i]["component_id"] == got[300 + i]["component_id"] == i and not got[300 + i]["kept"] for i in range(12))
    assert sum(got[100 + i]["component_id"] == i for i in range(12)) >= 11
    assert all(got[200 + i]["kept"] for i in range(12))


def test_search(spark):
    rng = np.random.default_rng(10)
    rows = [(int(i % 250), rng.integers(-9, 9, 6).tolist()) for i in range(300)] + [(None, [1] * 6), (4, None), (8, [3, 3])]
    rows += rows[:20]
    got = topk.search(frame(spark, rows, "vec_id long, codes array<long>"), F.col("vec_id") % 10 == 0, k=4).collect()
    whole = sorted({(i, tuple(c)) for i, c in rows if i is not None and c is not None})
    for q in range(0, 250, 10):
        options = sorted(((-sum(a * b for a, b in zip(x, y)), j) for i, x in whole if i == q for j, y in whole if j != q))
        assert [(r["rank"], -r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [
            (n, *o) for n, o in enumerate(options[:4], 1)]
    ids, scores = topk.best_of_shard(np.array([5]), np.array([[1, 1]]), np.arange(600), rng.integers(-50, 50, (600, 2)), 3)
    assert ids.shape == (1, 3) and 5 not in ids
    assert topk.search(frame(spark, [], "vec_id long, codes array<long>"), F.lit(True)).count() == 0
    bad = frame(spark, [(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, [0.5])], "i long, embedding array<float>")
    assert [r["i"] for r in bad.where(topk.usable()).collect()] == [5]


def test_decontamination(spark, monkeypatch):
    rng = random.Random(11)
    words, other = [f"w{i}" for i in range(300)], [f"v{i}" for i in range(300)]
    items = [(i, rng_text(rng, words, 30)) for i in range(20)] + [(50, "alpha beta gamma"), (51, None), (52, ""), (0, rng_text(rng, words, 30))]
    items[-1] = items[0]
    leak = items[3][1].split()
    changed = [w if i not in (6, 15, 24) else "zz" for i, w in enumerate(leak)]
    lone = rng_text(rng, other, 80).split()
    texts = {1: " ".join(lone), 2: " ".join(lone[:40] + leak + lone[40:]), 3: " ".join(lone[:10] + changed).upper(), 4: " ".join(lone + leak[:13]),
             5: " ".join(leak[:12]), 6: "x Alpha, beta; gamma!", 7: None, 8: "", 9: " ".join(lone * 3000 + leak)}
    docs = frame(spark, [(i, t, None, None, None) for i, t in texts.items()] * 2)
    bench = frame(spark, items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["n_equal"], r["n_tokens"], r["doc_start"], r["item_start"]) for r in decontaminate.contaminated(docs, bench).collect())
    want = {(2, 3, 30, 30, 40, 0), (3, 3, 27, 30, 10, 0), (4, 3, 13, 13, 80, 0), (6, 50, 3, 3, 1, 0), (9, 3, 30, 30, 240_000, 0)}
    assert got == Counter({w: 2 for w in want})
    assert sorted({r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}) == [1, 5, 7, 8]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(frame(spark, []), bench).count() == 0
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", 400))
    assert len(list(decontaminate.blocks(bench))) > 1
    again = Counter(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    assert again == got


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == names and 0.5 * docs.count() < after.count() <= docs.count()
    one = corpus_pipeline.one_of_each_group(spark, frame(spark, ODD), SMALL).collect()
    assert sorted((r["doc_id"] or 0) for r in one) == [1, 3, 4, 5, 6]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    assert "_score" not in corpus_pipeline.good_quality(spark, docs, SMALL).columns


def near_groups(rng, n, edits, variants):
    """Dense groups: copies of a text of ``n`` words, each with some of its words changed in its own way."""
    words = [f"w{i}" for i in range(3000)]
    base, out = rng_text(rng, words, n).split(), []
    for _ in range(variants):
        own = list(base)
        for k in rng.sample(range(n), edits):
            own[k] = f"x{rng.randrange(10**6)}"
        out.append(own)
        if rng.random() < 0.7:
            own = list(own)
            own[rng.randrange(n)] = f"y{rng.randrange(10**6)}"
            out.append(own)
    return [" ".join(t) for t in out]


def jaccard(a, b, shingle=5):
    a, b = ({tuple(t[i : i + shingle]) for i in range(max(1, len(t) - shingle + 1))} for t in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_similar_texts_equal_brute_force_on_dense_groups(spark):
    rng = random.Random(12)
    texts = [t for edits in (2, 3, 4) for t in near_groups(rng, 90, edits, 14)]
    prints = [simhash._sums(t.encode().lower().split(), 2, 8) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if root[i] != root[j] and any(((x ^ y) & (1 << 64) - 1).bit_count() <= 4 for x, y in zip(prints[i], prints[j])) and jaccard(texts[i], texts[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    got = simhash.similar_texts(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_similar_texts_are_alike_by_any_tiles(spark, monkeypatch):
    rng = random.Random(12)
    texts = [t for edits in (2, 3, 4) for t in near_groups(rng, 90, edits, 14)] + ["", ""]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = []
    for tile, tiles in ((1024, 16), (5, 1000), (5, 0)):  # one tile, many, and pairs listed by the tables
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "TILES", tiles)
        got.append({r["doc_id"]: (r["component_id"], r["kept"]) for r in simhash.similar_texts(frame(spark, rows)).collect()})
    assert got[0] == got[1] == got[2]


def test_similar_texts_write_no_pairs_of_a_group(spark, monkeypatch):
    rng = random.Random(15)
    texts = [t for edits in (4, 5) for t in near_groups(rng, 120, edits, 150)]
    most, write = [], simhash.saved

    def counted(df, name="step"):
        out = write(df, name)
        most.append((out.count(), name))
        return out

    monkeypatch.setattr(simhash, "saved", counted)
    got = simhash.similar_texts(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()
    assert len({r["component_id"] for r in got}) > 50  # many stay apart, though candidates of each other
    assert max(most)[0] <= 8 * len(texts)


def test_links_list_every_pair_of_unlike_kinds(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(63) for _ in range(4)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(62), rng.randrange(4))) for b in base for _ in range(25)})
    kinds = {p: rng.choice([1, 2, 3, None]) for p in prints}
    got = simhash.links(frame(spark, [(0, p, k) for p, k in kinds.items()], "table int, fingerprint long, kind long"), 4, every=True).collect()
    want = {(p, q) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= 4 and (kinds[p] is None or kinds[p] != kinds[q])}
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got} == want


@pytest.mark.parametrize("radius", [0, 2, 4])
@pytest.mark.parametrize("bucket,hot", [(simhash.BUCKET, simhash.HOT_BUCKET), (2, 20)])
def test_links_deal_a_fingerprint_once_by_every_block(spark, monkeypatch, radius, bucket, hot):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    dealt, bucketed = [], simhash._bucketed
    monkeypatch.setattr(simhash, "_bucketed", lambda rows: dealt.append(rows.count()) or bucketed(rows))
    rng = random.Random(17)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(15)} | {0, 1 << 63, (1 << 64) - 1}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    got = simhash.links(frame(spark, [(t, p) for p in signed for t in (0, 1)], "table int, fingerprint long"), radius).collect()
    assert dealt[0] == 2 * (radius + 1) * len(signed)  # however many fingerprints and buckets there are
    ends = {(signed[r["a"]], signed[r["b"]]) for r in got if r["table"] == 1}
    near = {(p, q) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= radius}

    def groups(pairs):
        root = {p: p for p in prints}
        while True:
            old = dict(root)
            for p, q in pairs:
                root[p] = root[q] = min(root[p], root[q])
            if root == old:
                return root

    assert groups(ends) == groups(near)


def test_similar_texts_decide_long_texts_exactly(spark):
    rng = random.Random(14)
    words, rows = [f"w{i}" for i in range(3000)], []
    for i in range(40):
        base = rng_text(rng, words, 504).split()  # 500 shingles; 5 are lost by a change, so 11 changes leave 445 of 555
        for extra, changes in ((0, 0), (100, 11), (200, 12)):
            own = list(base)
            for k in range(changes):
                own[20 + 40 * k] = f"x{i}"
            rows.append((1000 * i + extra, " ".join(own), None, None, None))
    pairs = [(x, y) for i in range(0, 120, 3) for x, y in ((i, i + 1), (i, i + 2))]
    own = frame(spark, [(i, r[1]) for i, r in enumerate(rows)], "text_key long, _text string")
    sets = [simhash._set(r[1].encode().split(), 5) for r in rows]
    marked = frame(spark, [(i, s[: simhash.SKETCH].tobytes(), len(s)) for i, s in enumerate(sets)], "text_key long, sketch binary, n long")
    kept = simhash._verified(own, marked, frame(spark, pairs, "x long, y long"), 5, 0.8).collect()
    assert {(r["a"], r["b"]) for r in kept} == {(x, y) for x, y in pairs if jaccard(rows[x][1], rows[y][1]) >= 0.8} == {p for p in pairs if p[1] % 3 == 1}
    for x, y in pairs:
        a, b = sets[x], sets[y]
        assert not simhash._ruled_out(a[:128], len(a), b[:128], len(b), 0.8) or not simhash.similar(a, b, 0.8)
    assert simhash.similar(sets[0][:0], sets[0][:0], 0.8) and not simhash.similar(sets[0], sets[0][:0], 0.8)
    assert simhash._ruled_out(sets[0][:128], 500, sets[3][:128], 200, 0.8)


def test_decontamination_finds_any_stretch_that_qualifies():
    rng = random.Random(15)
    item = [f"i{k}" for k in range(100)]
    block = decontaminate.Block([(1, " ".join(item))])
    runs = [w if k % 19 < 13 else "zz" for k, w in enumerate(item[:51])]
    spread = [w if k % 4 != 3 or k > 87 else "zz" for k, w in enumerate(item)]
    assert block.overlaps(" ".join(["a"] * 9 + runs + ["b"] * 9)) == {0: (26, 32, 9, 0)}
    assert block.overlaps(" ".join(spread)) == {0: (48, 60, 40, 40)} and spread.count("zz") == 22
    for n in (13, 20, 40):
        for _ in range(300):
            equal = np.array([rng.random() < rng.choice([0.7, 0.8]) for _ in range(n)])
            want = min(((-int(equal[i:j].sum()), j - i, i) for i in range(n) for j in range(i + 13, n + 1) if 5 * equal[i:j].sum() >= 4 * (j - i)), default=None)
            got = decontaminate._most_equal(equal, 13)
            assert got == (want and (want[2], want[2] + want[1]))


def test_masks_hit_every_overlap_by_enumeration():
    masks = [int(m[::-1], 2) for m in decontaminate.MASKS]
    for n in range(13, 26):  # of 26 tokens and more, one of two parts of at least 13 tokens is as equal as the whole
        left = np.array([(1 << n) - 1 ^ sum(1 << i for i in c) for c in combinations(range(n), n // 5)])
        for mask in masks:
            for at in range(n):
                left = left[(left >> at) & mask != mask]
        assert not len(left)
    for n in range(1, 13):
        masks = decontaminate.whole_masks(n)
        for changed in combinations(range(n), n // 5):
            assert any(len(m) == n and all(m[i] == "0" for i in changed) for m in masks)


def test_decontamination_finds_changed_short_items():
    for n, k in ((5, 1), (7, 1), (8, 1), (9, 1), (10, 2), (12, 2), (13, 2), (15, 3), (20, 4)):
        item = [f"i{i}" for i in range(n)]
        block = decontaminate.Block([(1, " ".join(item)), (2, "alpha beta")])
        for changed in combinations(range(n), k):
            text = ["a"] * 3 + ["zz" if i in changed else w for i, w in enumerate(item)] + ["b"] * 3
            assert 0 in block.overlaps(" ".join(text))
        assert not block.overlaps(" ".join(w if i % 2 else "zz" for i, w in enumerate(item)))
