"""Total orders, keyset pages, slices of equal weight and the trigram index against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import library as L
from lectern.operators import ordered, postings, search, stats


def sort_key(order):
    def key(row):
        out = []
        for column, up in order:
            v = row[column]
            out.append((v is not None, v if v is not None else 0) if up else (v is None, -v if isinstance(v, (int, float)) and v is not None else 0))
        return out

    return key


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(1)
    rows = [(f"u{i:03d}", rng.choice([None, *range(6)]), rng.choice([None, 1.5, -2.0, 7.25])) for i in range(240)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "uuid string, last_opened_at int, score double").repartition(5)


ORDERS = [[("last_opened_at", up), ("score", down), ("uuid", True)] for up in (True, False) for down in (True, False)]


@pytest.mark.parametrize("order", ORDERS)
def test_pages_follow_cursors_through_the_whole_order(spark, library, order):
    want = [r["uuid"] for r in sorted(library.collect(), key=sort_key(order))]
    got = list(L.pages(library, order, 33))
    assert [r["uuid"] for p in got for r in L.sorted_by(p, order).collect()] == want
    assert [p.count() for p in got] == [33] * 7 + [9]
    plan = got[-1]._jdf.queryExecution().toString().lower()
    assert "offset" not in plan and "takeordered" in plan
    assert list(L.pages(library.limit(0), order)) == []


@pytest.mark.parametrize("order, copies", [(ORDERS[0], 1), (ORDERS[3], 7), (ORDERS[1], 50)])
def test_numbered_pages_are_those_of_the_cursors(spark, library, order, copies, monkeypatch):
    rows = library.limit(110 // copies).crossJoin(spark.range(copies)).drop("id").coalesce(2).localCheckpoint()
    rows = rows.unionByName(rows.limit(1).withColumn("uuid", F.lit(None).cast("string")))
    want = [(r["uuid"], i) for i, p in enumerate(L.pages(rows, order, 33)) for r in p.collect()]
    monkeypatch.setattr(L, "page_after", None)  # no job for each page
    got = [tuple(r) for r in L.numbered_pages(rows, order, 33).select("uuid", "page").collect()]
    assert Counter(got) == Counter(want)


def test_numbered_pages_of_an_empty_library(spark, library):
    assert L.numbered_pages(library.limit(0), ORDERS[0], 33).count() == 0


def test_positions_of_long_texts(spark):
    """Ranges know the first letters of a text only, and an inner sort costs nothing."""
    long = "x" * ordered.RANGE_LETTERS
    names = [long + str(i * 7 % 40) for i in range(40)] + [long, None, "", "y"] + ["a"] * 5
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, id int").repartition(7)
    for up in (True, False):
        order = [("name", up), ("id", not up)]
        key = lambda r: ((r["name"] is not None, r["name"] or ""), r["id"] if not up else -r["id"])
        rows = sorted(df.collect(), key=lambda r: -r["id"] if up else r["id"])
        rows = sorted(rows, key=lambda r: key(r)[0], reverse=not up)
        got = ordered.positions(L.sorted_by(df, order), order)
        assert {r["id"]: r["rank"] for r in got.collect()} == {r["id"]: i for i, r in enumerate(rows)}


def test_cursor_reaches_the_scan(spark, library, tmp_path):
    library.write.parquet(f"{tmp_path}/docs")
    page = L.page_after(spark.read.parquet(f"{tmp_path}/docs"), [("last_opened_at", True), ("uuid", True)], (3, "u100"))
    assert "GreaterThanOrEqual(last_opened_at,3)" in page._jdf.queryExecution().toString()


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("rows", [20, 1000])
def test_positions(spark, library, order, rows):
    want = {r["uuid"]: i for i, r in enumerate(sorted(library.collect(), key=sort_key(order)))}
    assert {r["uuid"]: r["rank"] for r in ordered.positions(library, order, rows=rows).collect()} == want


def test_positions_of_texts_and_dates(spark):
    df = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("name"), F.date_add(F.lit("2020-01-01"), (F.col("id") % 9).cast("int")).alias("day"), "id")
    rows = df.collect()
    for order, key in (([("name", True), ("id", True)], lambda r: (r["name"], r["id"])), ([("day", True), ("name", True)], lambda r: (r["day"], r["name"]))):
        want = {r["id"]: i for i, r in enumerate(sorted(rows, key=key))}
        assert {r["id"]: r["rank"] for r in ordered.positions(df, order, rows=10).collect()} == want


def test_equal_scores_are_spread_over_slices(spark):
    n = 40_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, F.rand(1)).otherwise(F.lit(0.5)).alias("cost"), "id")
    sliced, slices = ordered.equal_slices(df, ["g"], ["cost", "id"], rows=1000)
    sizes = Counter()
    for r in sliced.groupBy(*slices).count().collect():
        sizes[r[0], r[1]] = r["count"]
    assert sum(sizes.values()) == n and max(sizes.values()) < n / 100 and len(sizes) > 500
    marked = sliced.select("cost", "id", F.struct(*slices).alias("s")).orderBy("cost", "id").collect()
    assert all(tuple(a["s"]) <= tuple(b["s"]) for a, b in zip(marked, marked[1:]))
    whole = ordered.equal_slices(df, ["g"], ["cost", "id"])
    assert whole[0].select(*whole[1]).distinct().count() == 1


def test_nucleus_and_median_of_a_large_group(spark):
    rng = random.Random(4)
    rows = [("g", i, rng.choice([0.0, 0.0, 0.0, 1.0, rng.random()])) for i in range(3000)] + [("h", 1, 2.0), ("h", 2, None)]
    df = spark.createDataFrame(rows, "g string, item long, score double")
    some = df.filter("score is not null")
    key = lambda q: [(r["g"], r["item"], r["rank"], round(r["probability"], 9)) for r in q.orderBy("g", "rank").collect()]
    assert key(stats.nucleus(some, ["g"], 0.5, p=0.6, rows=50)) == key(stats.nucleus(some, ["g"], 0.5, p=0.6))
    values = sorted(r[2] for r in rows if r[0] == "g")
    got = {r["g"]: r["median"] for r in stats.middle_value(df, ["g"], "score", rows=20).collect()}
    assert got == {"g": values[len(values) // 2], "h": 2.0}


def test_histogram_of_any_range_is_bounded(spark):
    df = spark.range(10_000).select(F.lit("g").alias("g"), (F.col("id") * 1000 - 5_000_000).cast("double").alias("v"))
    bins = stats.histogram(df, ["g"], "v").collect()
    assert len(bins) <= stats.BINS and {r["bin"] for r in bins} == {0, 255} and sum(r["n"] for r in bins) == 10_000
    spread = stats.histogram(df, ["g"], "v", -5_000_000, 5_000_000).collect()
    assert len(spread) == 256 and max(r["n"] for r in spread) <= 40
    two = df.select("g", F.when(F.col("v") < 0, -4e6).otherwise(4e6).alias("v"))
    assert 0 < stats.otsu(two, ["g"], "v", -5e6, 5e6).first()["threshold"] < 255


def test_index_answers_as_the_scan_does(spark, tmp_path):
    rng = random.Random(9)
    words = ["Straße", "ÉTÉ", "mañana", "aaaa", "the", "漢字仮名", "x😀y", "İstanbul", "no", "tion", "a.b*c", "%_"]
    rows = [(f"d{i % 40}", i, f"p{i}", " ".join(rng.choices(words, k=rng.randint(0, 9))) if i % 11 else None, 1) for i in range(600)]
    blocks = spark.createDataFrame(rows, "document_id string, ord int, page_id string, content string, level int")
    docs = spark.createDataFrame([(f"d{i}", f"{words[i % 12]} {i}") for i in range(45)], "uuid string, name string")
    pages = spark.createDataFrame([(f"p{i}", f"d{i % 40}", i) for i in range(600)], "uuid string, document_id string, page_number int")
    index = postings.build(blocks, f"{tmp_path}/index", slice_blocks=100)
    terms = ["", " ", "t", "th", "the", " THE ", "aaaaa", "straße", "été mañana", "漢字仮", "😀", "x😀y", "istanbul", "i̇stanbul", "zzz", "b*c", "%_", "the a.b"]
    terms += [rng.choice([r[3] for r in rows if r[3]])[rng.randrange(6) :][: rng.randint(3, 12)] for _ in range(50)]
    every = lambda q: sorted(map(repr, q.collect()))
    for term in terms:
        hit = lambda rows: {(r["document_id"], r["ord"]) for r in search._matches(rows, "content", search._needle(term)).collect()}
        assert hit(index.candidates(term)) == hit(blocks), term
    for term in ("mañana", "the", "no"):
        assert every(index.search(docs, pages, term)) == every(search.search(blocks, docs, pages, term, max_hits=None))
    assert index.candidates("mañana été").count() < 600 and index.candidates("qqq").count() == 0
    empty = postings.build(blocks.limit(0), f"{tmp_path}/none")
    assert empty.search_blocks(docs, pages, "the").count() == 0


def test_index_inverts_a_slice_where_its_texts_stand(spark, tmp_path):
    rows = [(f"d{i % 40}", i, f"text {i % 7} of {i}" if i % 11 else None) for i in range(600)]
    blocks = spark.createDataFrame(rows + rows[:50], "document_id string, ord int, content string")
    index = postings.build(blocks, f"{tmp_path}/index", slice_blocks=100)
    slices = {r["_slice"]: sorted(r["numbers"]) for r in index.blocks.groupBy("_slice").agg(F.collect_list("_number").alias("numbers")).collect()}
    assert len(slices) == 7 and all(numbers == list(range(1, len(numbers) + 1)) for numbers in slices.values())
    lists = index.tables["postings"]
    assert lists.select("_slice", F.input_file_name()).distinct().count() == 7
    want = {(r["gram"], r["_slice"]): r["numbers"] for r in index.blocks.select("_slice", "_number", F.explode(postings.grams(F.col("content"))).alias("gram"))
            .groupBy("gram", "_slice").agg(F.sort_array(F.collect_list("_number")).alias("numbers")).collect()}
    got = lists.collect()
    assert {(r["gram"], r["_slice"]): r["blocks"] for r in got} == want and len(got) == len(want) and all(r["n"] == len(r["blocks"]) for r in got)
    assert index.candidates("text 3").count() == blocks.filter("content like 'text 3%'").count()
