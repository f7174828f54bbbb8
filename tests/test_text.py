"""Literal cases for the text expressions."""

from pyspark.sql import functions as F

from lectern.functions import text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


def many(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return [r.r for r in df.select("i", fn("t").alias("r")).orderBy("i").collect()]


SENTENCES = [
    ("Một. Hai! Ba? Bốn…", ["Một.", "Hai!", "Ba?", "Bốn…"]),
    ("Một. . Hai.", ["Một.", ".", "Hai."]),
    ("Thật sao?! Đúng.", ["Thật sao?!", "Đúng."]),
    ("“Đi thôi.” Anh nói.", ["“Đi thôi.”", "Anh nói."]),
    ("TS. Nguyễn Văn A tốt nghiệp năm 2019. Ông nhận bằng năm 2020.",
     ["TS. Nguyễn Văn A tốt nghiệp năm 2019.", "Ông nhận bằng năm 2020."]),
    ("Gồm táo, lê, v.v. Rất ngon.", ["Gồm táo, lê, v.v.", "Rất ngon."]),
    ("H. Nguyễn là tác giả. Ông sinh năm 1990.", ["H. Nguyễn là tác giả.", "Ông sinh năm 1990."]),
    ("Giá trị là 3.14 và vẫn tăng.", ["Giá trị là 3.14 và vẫn tăng."]),
    ("Xem tại https://example.com. Rồi quay lại.", ["Xem tại https://example.com.", "Rồi quay lại."]),
    ("Gửi a.b@c.vn nhé. Xong.", ["Gửi a.b@c.vn nhé.", "Xong."]),
    ("Đoạn một\n\nĐoạn hai", ["Đoạn một", "Đoạn hai"]),
    ("Dòng một\nDòng hai.", ["Dòng một Dòng hai."]),
    ("USA. Then", ["USA. Then"]),
    ("Trường đh. Bách khoa. Hết", ["Trường đh. Bách khoa.", "Hết"]),
    ("   \n ", []),
    ("", []),
]


def test_sentences(spark):
    got = many(
        spark,
        lambda t: F.flatten(F.transform(X.paragraph_array(t), X.sentence_array)),
        [t for t, _ in SENTENCES],
    )
    assert got == [e for _, e in SENTENCES]


SPEECH = [
    ("a\r\nb\tc", "a\nb c"),
    ("a  \n  b\n \n\n  c   d ", "a\nb\n\nc d"),
    ("50%", "năm mươi phần trăm"),
    ("50000 VND", "năm mươi nghìn đồng"),
    ("20₫", "hai mươi đồng"),
    ("0", "không"),
    ("10", "mười"),
    ("105", "một trăm lẻ năm"),
    ("21", "hai mươi mốt"),
    ("15", "mười lăm"),
    ("55", "năm mươi lăm"),
    ("11", "mười một"),
    ("1000", "một nghìn"),
    ("1.234.567", "một triệu hai trăm ba mươi bốn nghìn năm trăm sáu mươi bảy"),
    ("1.005", "một nghìn lẻ năm"),
    ("1.026", "một nghìn không trăm hai mươi sáu"),
    ("2000000000", "hai tỷ"),
    ("3,14", "ba phẩy một bốn"),
    ("3.5", "ba phẩy năm"),
    ("1234.567", "một nghìn hai trăm ba mươi bốn phẩy năm sáu bảy"),
    ("COVID-19", "COVID-mười chín"),
    ("12345678901234567890", "một hai ba bốn năm sáu bảy tám chín không " * 2),
    ("1234567890123", "một hai ba bốn năm sáu bảy tám chín không một hai ba"),
    ("", ""),
    ("Giá 1.234.56 và 7", "Giá một nghìn hai trăm ba mươi bốn phẩy năm sáu và bảy"),
]


def test_normalize_speech(spark):
    assert many(spark, X.normalize_speech, [t for t, _ in SPEECH]) == [e.strip() for _, e in SPEECH]


def test_trim_knows_unicode_spaces(spark):
    assert one(spark, X.trim, " ﻿ a b \n") == "a b"


def test_title(spark):
    assert one(spark, X.title_from_text, "a b  c\nd e f g h i") == "a b c d e f g h…"
    assert one(spark, X.title_from_text, " a b ") == "a b"
    assert one(spark, X.title_from_text, " \n ") == "Văn bản"


def test_slug(spark):
    assert one(spark, lambda c: X.slug(c, "txt"), "Tài liệu thử") == "tài-liệu-thử.txt"
    assert one(spark, lambda c: X.slug(c, "json"), "///") == "van-ban.json"
    assert one(spark, lambda c: X.slug(c, "md"), "  a - b..") == "a-b.md"
    assert len(one(spark, lambda c: X.slug(c, "md"), "x" * 80)) == 63


def test_display_name(spark):
    assert one(spark, X.display_name, "a.b.pdf", " T ") == "T"
    assert one(spark, X.display_name, "a.b.pdf", "x" * 101) == "a.b"
    assert one(spark, X.display_name, "plain", " ") == "plain"


def test_page_number(spark):
    assert one(spark, X.page_number_of, "doc-p1-p12") == 12
    assert one(spark, X.page_number_of, "doc-px") is None
    assert one(spark, X.page_number_of, "doc") is None


def fnv(text):
    h, units = 0x811C9DC5, text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i:i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
    return f"len={len(units) // 2} lines={text.count(chr(10)) + 1} hash={h:x}"


def test_digest(spark):
    texts = ["abc", "tiếng Việt\ndòng hai\n", "a😀b", "x"]
    assert many(spark, X.text_digest, texts) == [fnv(t) for t in texts]


def test_digest_empty(spark):
    assert one(spark, X.text_digest, "") == "len=0"


def test_cache_key(spark):
    key = lambda c: X.cache_key(c, F.lit(None).cast("string"), F.lit(1.25), F.lit("wav"))
    assert one(spark, key, "Xin chào") == "null|1.25|wav|Xin chào"


def test_repeat_key(spark):
    assert one(spark, X.repeat_key, " Trang  12 / 30 ") == "trang # / #"
