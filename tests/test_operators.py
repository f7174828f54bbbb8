"""Operators against brute force on small fixtures."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import is_blank
from lectern.operators import library as L
from lectern.operators import ordered as R
from lectern.operators import search as S
from lectern.operators import speech as P
from lectern.operators import stats as T
from lectern.operators import tokens as K
from lectern.sources import epub, html, wav
from lectern.operators import sentences as N
from lectern.sources.exports import render_exports, render_json, write_exports
from lectern.sources.library import persist_documents, read_library, write_library


@pytest.mark.parametrize("rows_per_slice", [1, 3, 1000])
def test_running_does_not_depend_on_the_slices(spark, rows_per_slice):
    rng = random.Random(1)
    rows = [("g%d" % (i % 2), i, rng.choice([None, i % 7])) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    value = F.col("v")
    specs = {"s": ("sum", F.coalesce(value, F.lit(0))), "m": ("max", value), "n": ("min", value), "l": ("last", value)}
    got = R.running(df, ["g"], ["i"], [R.slice_of("i", rows_per_slice)], specs, inclusive=True).orderBy("i").collect()
    for g in ("g0", "g1"):
        seen = []
        for r in [r for r in got if r.g == g]:
            seen += [r.v] if r.v is not None else []
            assert (r.s, r.m, r.n, r.l) == (sum(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None)


def test_coarse_carries(spark):
    rows = [("d", p, q) for p in range(30) for q in range(p % 4 + 1)]
    df = spark.createDataFrame(rows, "d string, p long, q long").repartition(4)
    got = R.number_rows(df, ["d"], ["p", "q"], [F.col("p"), R.slice_of("q", 2)], coarse=lambda c: [R.slice_of(c[0], 5)])
    assert [(r.p, r.q) for r in got.orderBy("idx").collect()] == [(p, q) for _, p, q in rows]
    assert sorted(r.idx for r in got.collect()) == list(range(len(rows)))


def test_parts_join_to_the_whole_text(spark):
    rows = [("d", i, f"đoạn {i}" if i % 5 else "  ") for i in range(50)] + [("e", 0, "một")]
    df = spark.createDataFrame(rows, "document_id string, ord int, content string")
    got = L.document_text(df, budget=60).orderBy("document_id", "part").collect()
    assert len([r for r in got if r.document_id == "d"]) > 3
    assert "\n\n".join(r.text for r in got if r.document_id == "d") == "\n\n".join(t for d, _, t in rows if d == "d" and t.strip())


def wave(samples, rate=24000, extra=b""):
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_merged_audio_is_a_valid_file(spark):
    clips = [("d", i, bytes([i] * (10 + 2 * i)), 1, 1, 24000, 16) for i in range(12)]
    df = spark.createDataFrame(clips, "document_id string, idx int, data binary, audio_format int, channels int, sample_rate int, bits int")
    parts = P.merge_audio(df, budget=40).orderBy("part").collect()
    assert len(parts) > 3
    assert b"".join(bytes(r.bytes) for r in parts) == wave(b"".join(c[2] for c in clips))


def test_wav_walker(spark):
    chunk = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    files = {"plain": wave(b"12" * 600), "extra": wave(b"12" * 600, extra=chunk), "short": b"RIFF", "cut": wave(b"12" * 600)[:-9], "zero": wave(b"12" * 600, rate=0)}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {r.path: (r.data_bytes, r.duration_ms, r.reason) for r in wav.wav_inventory(df).collect()}
    assert got == {"plain": (1200, 25, None), "extra": (1200, 25, None), "short": (None, None, "too_short"),
                   "cut": (None, None, "truncated"), "zero": (1200, None, "zero_rate")}


def test_html_blocks():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><p>menu</p></nav><h2>Head &amp; more</h2>
    <div>lead <p>one<br>two</p><ul><li>a<li>b</ul></div><blockquote>q</blockquote><pre>x  y</pre><img src="i.png" alt="">
    <table><tr><td>cell</table><figcaption>c</figcaption><script>"</p>"</script></body></html>"""
    assert [r[:3] for r in html.blocks_of(page)] == [
        ("heading", 2, "Head & more"), ("paragraph", 0, "one\ntwo"), ("list", 0, "• a"), ("list", 0, "• b"), ("paragraph", 0, "q"),
        ("paragraph", 0, "x y"), ("image", 0, "i.png"), ("paragraph", 0, "cell"), ("paragraph", 0, "c"),
    ]
    assert html.blocks_of("<p>a</p>", "Title")[0][:3] == ("title", 1, "Title")


def book(**entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name, text in entries.items():
            archive.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return data.getvalue()


def test_epub(spark):
    container = '<container><rootfiles><rootfile full-path="o.opf"/></rootfiles></container>'
    opf = ('<package><metadata><title> Tên </title></metadata><manifest><item id="a" href="a.html" media-type="text/html"/></manifest>'
           '<spine><itemref idref="a"/></spine></package>')
    good = book(**{"META-INF__container_dot_xml": container, "o_dot_opf": opf, "a_dot_html": "<p>một</p><p>hai</p>"})
    rows = [("good", good), ("zip", b"PK\x03\x04broken"), ("none", book(x="y"))]
    got = epub.epub_to_blocks(spark.createDataFrame(rows, "document_id string, content binary")).collect()
    assert [(r.ord, r.type, r.content) for r in got if r.document_id == "good"] == [(0, "title", "Tên"), (1, "paragraph", "một"), (2, "paragraph", "hai")]
    assert {r.document_id: r.failure for r in got if r.failure} == {"zip": "damaged", "none": "no_container"}


def test_tokens(spark):
    symbols = K.byte_symbols()
    ids = {s: i for i, s in enumerate(symbols)} | {"ab": 300, "abc": 301}
    words = K.Vocabulary(ids, [("b", "c"), ("a", "b"), ("ab", "c")], {"<|x|>": 400})
    texts = ["abc ab", "a<|x|>ab", "tiếng\n", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = K.bpe_decode(K.bpe_tokenize(df, words), words).orderBy("i").collect()
    b = lambda t: [ids[symbols[x]] for x in t.encode()]
    assert out[0].ids[:2] == [b("a")[0], 0]  # "bc" merges first and is unknown, so it takes the unknown id
    assert out[1].ids == b("a") + [400] + [300]
    assert out[2].ids == b("tiếng\n") and out[2].decoded == "tiếng\n"
    assert out[3].ids == [] and out[1].decoded == "aab"


def test_search_fixture(spark):
    docs = spark.createDataFrame([("g", "Giáo trình"), ("n", "Nguyên lý cơ bản"), ("k", "Kinh tế")], "uuid string, name string")
    blocks = spark.createDataFrame(
        [("g", "g-p1", 0, "Trang đầu nói về lịch sử."), ("g", "g-p5", 1, "Chương sau nói về MÁY HỌC."), ("n", None, 0, "không liên quan"),
         ("k", None, 0, "Kinh tế tăng 100% năm nay"), ("k", None, 1, "x" * 400 + " kìa " + "x" * 400)],
        "document_id string, page_id string, ord int, content string",
    )
    pages = spark.createDataFrame([("g-p1", 1), ("g-p5", 5)], "uuid string, page_number int")
    find = lambda term: S.search(blocks, docs, pages, term).collect()
    assert [(r.document_id, r.page_number, r.match) for r in find(" máy học ")] == [("g", 5, "MÁY HỌC")]
    assert [(r.document_id, r.matched_in_title) for r in find("Nguyên lý")] == [("n", True)]
    assert [(r.document_id, r.matched_in_title) for r in find("kinh tế")] == [("k", False)]
    assert [r.document_id for r in find("100%")] == ["k"]
    assert find("   ") == []
    hit = find("kìa")[0]
    assert len(hit.before + hit.match + hit.after) < 200
    whole = find("đầu")[0]
    assert whole.before + whole.match + whole.after == "Trang đầu nói về lịch sử."


def test_speech_cost(spark):
    rows = [("hˈom nˈaj",), ("hˈom",), ("<|emotion_1|>",), ("ba " * 4000,)]
    got = P.speech_cost(spark.createDataFrame(rows, "phonemes string")).collect()
    assert [(r.syllables, r.frame_cap) for r in got[:3]] == [(2, 18), (1, 13), (0, 13)]
    assert got[3].budget_ms == 480_000 and got[1].budget_ms == 60_000 and got[2].cue_only


def test_otsu_splits_two_hills(spark):
    rows = [("g", v) for v in [10] * 50 + [12] * 30 + [200] * 40] + [("flat", 7)] * 3
    got = {r.g: r for r in T.otsu(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    assert got["g"].threshold == 12 and got["g"].separability > 0.99
    assert (got["flat"].threshold, got["flat"].separability) == (127, 0.0)


def test_json_parts(spark):
    docs = spark.createDataFrame([("d", 'T "1"', "a b "), ("e", "E", "")], "document_id string, title string, text string")
    rows = [("d", i, f"câu {i}", 5 if i % 2 else None) for i in range(20)]
    sentences = spark.createDataFrame(rows, "document_id string, idx int, text string, duration_ms int")
    got = render_json(docs, sentences, budget=200).orderBy("document_id", "part").collect()
    import json

    whole = json.loads("".join(r.content for r in got if r.document_id == "d"))
    assert whole["sentenceCount"] == 20 and [s["index"] for s in whole["sentences"]] == list(range(20))
    assert whole["sentences"][1] == {"index": 1, "text": "câu 1", "durationMs": 5} and whole["text"] == "a b"
    assert json.loads([r for r in got if r.document_id == "e"][0].content)["sentences"] == []


def test_exports_are_readable_files(spark, tmp_path):
    import glob
    import json

    docs = spark.createDataFrame([("d", "T", "a\n\nb  \n"), ("e", "E", "x")], "document_id string, title string, text string")
    rows = spark.createDataFrame([("d", i, f"câu {i}", None) for i in range(9)], "document_id string, idx int, text string, duration_ms int")
    write_exports({"txt": render_exports(docs, rows, "txt"), "json": render_json(docs, rows, budget=100)}, str(tmp_path))
    text = lambda fmt, d: open(glob.glob(f"{tmp_path}/format={fmt}/document_id={d}/*.txt")[0], encoding="utf8").read()
    assert text("txt", "d") == "a\n\nb\n"
    assert [s["text"] for s in json.loads(text("json", "d"))["sentences"]] == [f"câu {i}" for i in range(9)]


def test_library_round_trip(spark, tmp_path):
    block = [(0, "title", 1, "Tên", None, 1), (1, "paragraph", 0, "Nội dung", None, 2), (2, "paragraph", 0, "Hết", None, None)]
    nested = spark.createDataFrame(
        [("d", "N", "camera", block, [(1, "a.png")])],
        "uuid string, name string, source string, blocks array<struct<ord:int,type:string,level:int,content:string,page_id:string,page_number:int>>,"
        " images array<struct<page_number:int,file_path:string>>",
    )
    write_library(persist_documents(nested), str(tmp_path))
    pages = read_library(spark, str(tmp_path), "document_pages").orderBy("page_number").collect()
    assert [(p.uuid, p.source_type) for p in pages] == [("d-p1", "camera"), ("d-p2", "camera")]
    blocks = read_library(spark, str(tmp_path), "document_blocks").orderBy("ord").collect()
    assert [b.page_id for b in blocks] == ["d-p1", "d-p2", None]


def test_sentences_cover_their_paragraph(spark):
    texts = [("d%d" % i, t) for i, t in enumerate(["TS. A nói: “Vâng.” Rồi đi!\nXong", "a.b@c.vn. B… C?!", "x\n\n  y. z"])]
    df = spark.createDataFrame(texts, "document_id string, text string")
    squash = lambda t: "".join(t.split())
    got = N.sentences(df).orderBy("document_id", "idx").collect()
    for d, t in texts:
        own = [r for r in got if r.document_id == d]
        assert squash("".join(r.text for r in own)) == squash(t)
        assert [r.idx for r in own] == list(range(len(own)))


def test_blank(spark):
    df = spark.createDataFrame([(" ﻿\n",), ("a",)], "t string")
    assert [r.b for r in df.select(is_blank("t").alias("b")).collect()] == [True, False]
