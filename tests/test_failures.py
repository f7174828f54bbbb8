"""Inputs that must not end a job, malformed forms, and folds that start anew."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions.coerce import decode_json, parse_options
from lectern.functions.numbers import read_number_tokens
from lectern.sources import epub, files
from lectern.streaming import jobs

CONTAINER = (
    '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="o.opf"/></rootfiles></container>'
)
OPF = (
    '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>'
    '<item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
)


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("o.opf", OPF)
        for name in "ab":
            z.writestr(f"{name}.xhtml", f"<html><body><p>{name} " + " ".join(map(str, range(900))) + "</p></body></html>")
    return out.getvalue()


def test_broken_books_are_one_failure_row(spark):
    whole = book()
    flipped, locked = bytearray(whole), bytearray(whole)
    at = whole.index(b"b.xhtml") + 60
    flipped[at : at + 40] = bytes(255 - x for x in flipped[at : at + 40])
    central = whole.rindex(b"PK\x01\x02", 0, whole.rindex(b"a.xhtml"))
    locked[central + 8] |= 1  # the flag of an encrypted entry
    rows = [("whole", whole), ("flipped", bytes(flipped)), ("locked", bytes(locked)), ("cut", whole[:200]), ("empty", b""), ("null", None)]
    got = epub.epub_to_blocks(spark.createDataFrame(rows, "document_id string, content binary")).collect()
    by = {}
    for r in got:
        by.setdefault(r.document_id, []).append(r.failure)
    assert by["whole"] == [None, None]
    assert by["flipped"] == ["damaged"] and by["locked"] == ["encrypted_document"]
    assert len(by["cut"]) == len(by["empty"]) == len(by["null"]) == 1 and all(by[k][0] for k in ("cut", "empty", "null"))


def test_files_over_the_reader_limit(spark, tmp_path):
    (tmp_path / "small.txt").write_text("hello")
    with open(tmp_path / "huge.txt", "wb") as f:
        f.truncate(2_200_000_000)  # sparse
    found = files.read_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    got = {r["name"]: r["reason"] for r in files.validate_files(found).select("name", "reason").collect()}
    assert got == {"small.txt": None, "huge.txt": "too_large"}
    sums = {r["length"]: r["sha256"] for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert sums[2_200_000_000] is None and sums[5]


@pytest.mark.parametrize("text,want", [
    ('{"a":1}', {"a": "1"}), (' {"a":"]"} ', {"a": "]"}), ('{"a":1} xyz', {}), ('{"a":1}{"b":2}', {}),
    ('{"a":1},{"b":2}', {}), ("{'a':1}", {}), ("[1]", {}), ("", {}), (None, {}),
])
def test_json_objects(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(decode_json("x")).first()[0] == want


def test_options_take_nothing_behind_the_object(spark):
    rows = [('{"speed":0.75}',), ('{"speed":0.75} xyz',), ('{"speed":0.75},null',)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").coalesce(1).select(parse_options("x")).collect()]
    assert got[0]["speed"] == 0.75 and got[1:] == [None, None]


def test_decimal_mark_of_large_numbers(spark):
    got = spark.range(1).select(read_number_tokens(F.array(F.lit(""), F.lit("1234567890123,5"), F.lit("")))[1]).first()[0]
    assert got.endswith(" phẩy năm") and got.startswith("một hai ba bốn")


def test_job_enqueued_again_after_dismissal(spark):
    rows = [(1, 1, "enqueue"), (1, 2, "start"), (1, 3, "dismiss"), (1, 4, "enqueue"), (2, 1, "enqueue"), (2, 2, "dismiss"), (2, 3, "start")]
    events = spark.createDataFrame(rows, "job_id long, seq long, action string").select(
        "*", F.lit(None).cast("double").alias("progress"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("failure"))
    assert [(r.job_id, r.status, r.last_seq) for r in jobs.fold_jobs(events).collect()] == [(1, "queued", 4)]
