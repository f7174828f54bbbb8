"""A written index of letter trigrams, so that a search reads the blocks that can match.

Every block stands in a slice, by a hash of its place, and has a number in it.  For each trigram
of its lower-cased text, posting rows ``(gram, slice, blocks)`` list the numbers slice by slice, so that a
trigram in a third of all blocks is many rows of bounded size.  A slice is inverted where its texts stand, so
what is shuffled are texts, never their trigrams.  A term is answered from the lists of
its rarest trigrams, intersected slice by slice; the blocks found are read and the term is verified in them, so
the result is that of the scan.  Terms under three letters are scanned for.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .library import block_locations
from .search import _matches, _needle, search_blocks, title_hits

GRAM = 3
SLICE_BLOCKS = 16_384  # blocks of a slice, and so numbers in a posting row; the trigrams of a slice are sorted in one task's memory
BUCKETS = 64  # folders the counts of trigrams are dealt to
RAREST = 4  # trigrams of a term that are intersected
PAGE_ROWS = 64  # posting rows of a page in the files, so that a trigram's list is read without the others
SENT_BLOCKS = 500_000  # candidates that are sent to the tasks which read the blocks; more are joined by a shuffle
SCHEMAS = {"postings": "gram string, _slice int, n int, blocks array<int>", "counts": "gram string, n bigint, bucket int"}


def grams(text):
    """The distinct trigrams of a lower-cased text; supplementary characters may add some, never lose one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


def _bucket(gram):
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def build(blocks: DataFrame, path: str, slice_blocks: int = SLICE_BLOCKS) -> "Index":
    """Write the index of ``blocks`` (``document_id, ord, content`` and any other columns) under ``path``.

    A block's slice is a hash of document and order, its number the place in the slice by another.  The lists are made from the
    blocks as written, so blocks that repeat a place have one number each in both.
    """
    slices = -(-blocks.count() // slice_blocks) or 1
    place = F.xxhash64("document_id", "ord")
    dealt = blocks.withColumn("_slice", F.pmod(place, F.lit(slices)).cast("int")).repartitionById(slices, "_slice")
    numbered = dealt.withColumn("_number", F.row_number().over(Window.partitionBy("_slice").orderBy(place)))
    numbered.limit(0).write.parquet(f"{path}/schema")
    numbered.write.partitionBy("_slice").parquet(f"{path}/blocks")
    spark = blocks.sparkSession
    stored = spark.read.schema(numbered.schema).parquet(f"{path}/blocks").select("_number", "_slice", "content")
    postings = (
        stored.repartitionById(slices, "_slice").select("_number", "_slice", F.explode(grams(F.col("content"))).alias("gram"))
        .groupBy("gram", "_slice").agg(F.sort_array(F.collect_list("_number")).alias("blocks"))
        .select("gram", "_slice", F.size("blocks").alias("n"), "blocks")
    )
    postings.sortWithinPartitions("gram", "_slice").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/postings")
    written = spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings")
    written.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions(
        "bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return Index(spark, path)


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        schema = spark.read.parquet(f"{path}/schema").schema
        self.blocks = spark.read.schema(schema).parquet(f"{path}/blocks")
        self.tables = {name: spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in SCHEMAS.items()}

    def candidates(self, term: str) -> DataFrame:
        """Blocks whose text can contain the term: all of its rarest trigrams are in them."""
        needle = _needle(term)
        needle = needle.lower() if needle.isascii() else self.spark.range(1).select(F.lower(F.lit(needle))).first()[0]
        wanted = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        if not wanted:
            return self.blocks
        buckets = sorted({crc32(g.encode()) % BUCKETS for g in wanted})
        counts = self.tables["counts"].filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        counted = {r["gram"]: r["n"] for r in counts.collect()}  # as many rows as the term has trigrams
        if len(counted) < len(wanted):
            return self.blocks.filter(F.lit(False))
        rarest = sorted(wanted, key=lambda g: (counted[g], g))[:RAREST]
        lists = self.tables["postings"].filter(F.col("gram").isin(rarest)).groupBy("_slice").agg(F.collect_list(F.struct("n", "blocks")).alias("lists"))
        shared = F.aggregate(F.slice(F.sort_array("lists"), 2, RAREST), F.sort_array("lists")[0]["blocks"], lambda a, x: F.array_intersect(a, x["blocks"]))
        found = lists.filter(F.size("lists") == len(rarest)).select("_slice", F.explode(shared).alias("_number"))
        return self.blocks.join(F.broadcast(found) if counted[rarest[0]] <= SENT_BLOCKS else found, ["_slice", "_number"], "left_semi")

    def search_blocks(self, docs: DataFrame, pages: DataFrame, term: str) -> DataFrame:
        """The hits of ``search_blocks`` over all indexed blocks."""
        matched = _matches(self.candidates(term), "content", _needle(term)).drop("_slice", "_number")
        return search_blocks(block_locations(matched, docs, pages), term)

    def search(self, docs: DataFrame, pages: DataFrame, term: str) -> DataFrame:
        """Body hits by the index, then the documents of which only the name matches."""
        hits = self.search_blocks(docs, pages, term)
        return hits.unionByName(title_hits(docs, hits, term))
