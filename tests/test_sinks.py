"""Packed exports and range reads on real files."""

import glob
import struct

from pyspark.sql import functions as F

from lectern.sources import exports, wav


def wave(chunks):
    body = b"".join(name + struct.pack("<I", size) + data + b"\0" * (len(data) % 2) for name, size, data in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


FORMAT = (b"fmt ", 16, struct.pack("<HHIIHH", 1, 1, 24000, 48000, 2, 16))


def test_headers_are_read_by_ranges(spark, tmp_path):
    files = {
        "plain": wave([FORMAT, (b"data", 1200, b"12" * 600)]),
        "listed": wave([(b"LIST", 5, b"abcde"), FORMAT, (b"junk", 3, b"xyz"), (b"data", 1200, b"12" * 600)]),
        "short": b"RIFF", "other": b"x" * 60, "cut": wave([FORMAT, (b"data", 5000, b"12" * 600)]),
        "mute": wave([FORMAT, (b"LIST", 40, b"a" * 40)]), "none": wave([(b"data", 40, b"1" * 40)]),
        "zip": wave([(b"fmt ", 16, struct.pack("<HHIIHH", 7, 1, 24000, 48000, 2, 16)), (b"data", 40, b"1" * 40)]),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    loaded = spark.read.format("binaryFile").load(str(tmp_path))
    whole = wav.wav_inventory(loaded.select("path", "content"))
    ranged = wav.wav_headers(loaded.select("path", "length"))
    assert sorted(map(str, ranged.collect())) == sorted(map(str, whole.select(ranged.columns).collect()))
    missing = spark.createDataFrame([(f"{tmp_path}/gone.wav", 100)], "path string, length bigint")
    assert wav.wav_headers(missing).first()["reason"] == "unreadable"


def test_a_gigabyte_costs_its_chunk_heads(spark, tmp_path):
    path, size = tmp_path / "long.wav", 1 << 30
    head = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", size)
    with open(path, "wb") as file:  # a sparse file
        file.write(head)
        file.seek(len(head) + size)
        file.write(FORMAT[0] + struct.pack("<I", 16) + FORMAT[2] + b"data" + struct.pack("<I", size // 2))
        file.truncate(len(head) + size + 24 + 8 + size // 2)
    read = []

    def counted(at, n):
        with open(path, "rb") as file:
            file.seek(at)
            read.append(n)
            return file.read(n)

    assert wav._walk(counted, path.stat().st_size) == (1, 1, 24000, 16, size // 2, None) and sum(read) < 1000
    row = wav.wav_headers(spark.createDataFrame([(str(path), path.stat().st_size)], "path string, length bigint")).first()
    assert (row["data_bytes"], row["duration_ms"], row["reason"]) == (size // 2, round(size / 2 * 1000 / 48000), None)


def test_ten_thousand_documents_in_few_files(spark, tmp_path):
    text = F.repeat(F.concat(F.lit("Xin chào\n"), F.col("id").cast("string")), (F.col("id") % 7).cast("int"))
    docs = spark.range(10_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_id"), text.alias("text"), F.lit("T").alias("title"))
    sentences = spark.range(900).select(F.lit("d5").alias("document_id"), F.col("id").alias("idx"), F.lit("Câu.").alias("text"), F.lit(10).alias("duration_ms"))
    rendered = {"txt": exports.render_txt(docs), "md": exports.render_markdown(docs), "json": exports.render_json(docs, sentences, budget=9000)}
    exports.write_packed(rendered, str(tmp_path / "out"), buckets=20)
    assert len(glob.glob(f"{tmp_path}/out/files/bucket=*/part-*")) <= 20
    index = spark.read.parquet(f"{tmp_path}/out/index")
    want = {(r["document_id"], fmt, r["part"]): r["content"] for fmt, f in rendered.items() for r in f.collect()}
    got = {(r["document_id"], r["format"], r["part"]): r["content"] for r in exports.read_packed(index).collect()}
    assert got == want and len(want) > 30_000
    one = exports.read_packed(index.filter("document_id = 'd5' and format = 'json'")).orderBy("part").collect()
    assert len(one) > 1 and one[0]["content"].startswith("{") and one[-1]["content"].endswith("]\n}\n")
    exports.write_packed({"txt": exports.render_txt(docs.limit(0))}, str(tmp_path / "none"))
    assert spark.read.parquet(f"{tmp_path}/none/index").count() == 0
