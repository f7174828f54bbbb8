"""Partitioned tables on real folders, and byte-pair merges by their ids."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import maintenance as M
from lectern.operators import tokens as K


def times(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/part-*")}


def test_one_changed_key_rewrites_one_folder(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("uuid"), F.col("id").alias("n"), F.lit("a").alias("status"))
    path = str(tmp_path / "table")
    table = M.Partitioned.create(rows, path, "uuid", 16)
    before = times(path)
    assert len({os.path.dirname(f) for f in before}) == 16
    change = spark.createDataFrame([("k7", None, "b", 1, ["status"])], "uuid string, n long, status string, seq long, written array<string>")
    met = table.upsert(change, ["seq"])
    after = times(path)
    changed = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert len(met) == 1 and changed == {f"{path}/bucket={met[0]}"}
    assert all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in changed)
    assert table.read().filter("uuid = 'k7'").first()[:] == ("k7", 7, "b") and table.read().count() == 500
    new = spark.createDataFrame([("new", 1, "c", 2, ["n", "status"]), ("k8", 80, None, 2, ["n"])], change.schema)
    assert len(table.upsert(new, ["seq"])) <= 2 and table.read().count() == 501
    assert len(table.patch(new.withColumn("uuid", F.lit("unknown")), ["seq"])) == 1 and table.read().count() == 501
    assert table.upsert(new.limit(0), ["seq"]) == []
    whole = table._stored().filter(f"bucket = {met[0]}").select("uuid")
    left = 501 - whole.count()
    table.delete(whole)
    assert table.read().count() == left and not os.path.exists(f"{path}/bucket={met[0]}")
    table.delete(table.read().select("uuid"))
    assert table.read().count() == 0


def slow(parts, ranks):
    parts = list(parts)
    while True:
        found = min(((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
        if found[0] == 1 << 60:
            return parts
        parts[found[1] : found[1] + 2] = ["".join(parts[found[1] : found[1] + 2])]


def test_competing_merges_by_their_ids():
    rng = random.Random(2)
    for _ in range(300):
        symbols, pairs = list("abc"), []
        for _ in range(rng.randint(1, 12)):
            pair = rng.choice(symbols), rng.choice(symbols)
            if pair not in pairs:
                pairs.append(pair)
                symbols.append("".join(pair))
        ranks = {p: i for i, p in enumerate(pairs)}
        for _ in range(5):
            word = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
            assert K.merged(list(word), ranks) == slow(word, ranks)


def test_long_pieces_take_linear_logarithmic_time():
    ranks = {p: i for i, p in enumerate([("a", "a"), ("aa", "aa"), ("a", "b"), ("aaaa", "aaaa"), ("b", "a")])}
    rng = random.Random(3)

    def took(n):
        word = [rng.choice("aaab") for _ in range(n)]
        start = time.perf_counter()
        assert "".join(K.merged(list(word), ranks)) == "".join(word)
        return time.perf_counter() - start

    took(1000)
    assert took(100_000) < 60 * max(took(10_000), 0.005) and took(100_000) < 10


def test_unknown_and_added_tokens(spark):
    pairs = [("a", "b"), ("b", "a"), ("ab", "a")]
    ids = {s: i for i, s in enumerate(K.byte_symbols()) if s != "z"}
    ids |= {"ab": 300, "ba": 301, "aba": 302, K.UNKNOWN: 400}
    words = K.Vocabulary(ids, pairs, {"<|x|>": 500, "<|x|>y": 501})
    df = spark.createDataFrame([("ababa<|x|>yz baab<|x|>",), (None,), ("",)], "text string")
    got = [r["ids"] for r in K.bpe_tokenize(df, words).collect()]
    space = ids[K.byte_symbols()[32]]
    assert got == [[300, 302, 501, 400, space, 301, 300, 500], [], []]
    with pytest.raises(ValueError):
        K.bpe_tokenize(df, K.Vocabulary(dict.fromkeys(map(str, range(K.ENTRIES + 1)), 0), []))
