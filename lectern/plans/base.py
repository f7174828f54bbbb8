"""Registry of runnable queries and the adapters from the given tables to library shapes.

An adapter is SQL both engines accept, so a query and its oracle start from the same rows
and differ only in the operator under test.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW = ("region nation customer supplier part orders lineitem events documents embeddings"
       " pages benchmark labels conversations").split()


class Library:
    """The given tables and the adapters over them, for one session and folder."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = tune(spark), directory

    def __getitem__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(os.path.join(self.directory, f"{name}.parquet"))
        return self.sql(SHARED[name][0], self.__getitem__)

    def wide(self, name: str) -> DataFrame:
        """The same rows with every core at work, for queries that compute much per row."""
        if name in RAW:
            return spread(self[name])
        return self.sql(SHARED[name][0], self.wide)

    def sql(self, text: str, table) -> DataFrame:
        names = {n for n in (*RAW, *SHARED) if "{" + n + "}" in text}
        return self.spark.sql(text, **{n: table(n) for n in names})


def duck(text: str) -> str:
    """The DuckDB form of a text with ``{table}`` placeholders."""
    while True:
        names = [n for n in SHARED if "{" + n + "}" in text]
        if not names:
            break
        for n in names:
            text = text.replace("{" + n + "}", f"({SHARED[n][1]})")
    for n in RAW:
        text = text.replace("{" + n + "}", n)
    return text.replace("{{", "{").replace("}}", "}")


def query(name: str, oracle: str | None = None):
    """Register a query ``f(library) -> DataFrame``; the oracle may use placeholders."""

    def add(f):
        QUERIES[name] = lambda spark, directory: f(Library(spark, directory))
        QUERIES[name].__doc__ = f.__doc__
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return f

    return add


# name -> (Spark SQL, DuckDB SQL)
SHARED: dict[str, tuple[str, str]] = {}


def _both(name: str, text: str) -> None:
    SHARED[name] = (text, text)


_both("lib_docs", """
select 'd' || cast(doc_id as string) as uuid, doc_id,
  split_part(text, chr(10), 1) as name, text as extracted_text,
  case cast(doc_id % 7 as int) when 0 then 'typedText' when 1 then 'camera' when 2 then 'image' when 3 then 'pdf'
    when 4 then 'textFile' when 5 then 'markdown' else 'epub' end as source,
  case cast(doc_id % 6 as int) when 0 then 'queued' when 1 then 'extracting' when 2 then 'ocr' when 3 then 'failed'
    else 'ready' end as status,
  n_chars as file_size, doc_id % 3 = 0 as is_favorite,
  case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' else lang end as category,
  (doc_id * 7919) % 100003 as created_at, (doc_id * 104729) % 100003 as updated_at,
  case when doc_id % 4 = 0 then null else (doc_id * 15485863) % 100003 end as last_opened_at,
  cast(null as string) as failure_message, lang,
  case when doc_id % 9 = 0 then '{{"ocr_low_confidence_blocks":' || cast(doc_id % 4 as string) || '}}'
    when doc_id % 9 = 1 then 'not json' when doc_id % 9 = 2 then '[1]' when doc_id % 9 = 3 then ''
    when doc_id % 9 = 4 then null else '{{"origin":"' || source || '"}}' end as metadata
from {documents}""")

_LINES = ("select doc_id, lang, source as origin, posexplode(split(text, '\\n')) as (pos, content) from {documents}",
          "select doc_id, lang, source as origin, unnest(range(len(l))) as pos, unnest(l) as content from"
          " (select doc_id, lang, source, string_split(text, chr(10)) as l from {documents})")
SHARED["lib_lines"] = _LINES

_both("lib_blocks", """
select 'd' || cast(doc_id as string) || '-b' || cast(pos as string) as uuid, 'd' || cast(doc_id as string) as document_id,
  case when pos % 17 = 16 then null
    else 'd' || cast(doc_id as string) || '-p' || cast(cast(floor(pos / 5) as int) + 1 as string) end as page_id,
  case when pos % 17 = 16 then null else cast(floor(pos / 5) as int) + 1 end as page_number,
  case when pos = 0 then 'title' when pos % 7 = 3 then 'heading' when pos % 11 = 10 then 'footnote' else 'paragraph' end as type,
  cast(pos % 3 as int) as level, content, cast(pos as int) as ord, lang,
  case when pos % 4 = 1 then null else ((doc_id * 31 + pos * 17) % 100) / cast(100 as double) end as confidence,
  case when pos % 13 = 5 then '{{"skip_in_read_aloud":true}}' when pos % 13 = 6 then '{{"margin":"top"}}' else '{{}}' end as metadata
from {lib_lines}""")

_both("lib_pages", "select distinct page_id as uuid, document_id, page_number from {lib_blocks} where page_id is not null")

_both("lib_images", """
select 'i' || cast(doc_id as string) as uuid, cast(0 as int) as ord,
  case when doc_id % 10 = 0 then 'gone' || cast(doc_id as string) else 'd' || cast(doc_id as string) end as document_id,
  case when doc_id % 3 = 0 then null else cast(doc_id % 4 as int) + 1 end as page_number,
  'img/' || cast(doc_id as string) || '.png' as file_path, n_chars as file_size
from {documents}""")

_both("lib_turns", """
select cast(conv_id as string) as document_id, cast(turn as int) as ord, role, text as content from {conversations}""")

_both("lib_positions", """
select 'd' || cast(user_id as string) as document_id, event_id as seq, event_id as updated_at,
  cast(event_id % 23 as int) as sentence_index, cast(value * 1000 as bigint) as position_ms
from {events}""")

_both("lib_jobs", """
select 'j' || cast(o_orderkey as string) as uuid, cast(o_orderkey as bigint) as created_at,
  case cast(o_orderkey % 8 as int) when 0 then 'queued' when 1 then 'extracting' when 2 then 'ocr' when 3 then 'running'
    when 4 then 'succeeded' when 5 then 'failed' when 6 then 'completed' else 'cancelled' end as status,
  o_orderpriority = '1-URGENT' as retryable, o_orderdate as updated_at
from {orders}""")

_both("lib_logs", """
select event_id as seq, event_id as at, event_type as message,
  case event_type when 'error' then 'error' when 'purchase' then 'warning' when 'signup' then 'info' else 'debug' end as level
from {events}""")
