"""Exact top-k inner products by block-at-a-time pruning.

Components are terms.  The rows of a shard stand in blocks of neighbouring ids; a block keeps
its largest and smallest value of every term and its rows as a forward index.  A query visits
the blocks in the order of their summed maxima and stops at the first whose bound falls below
its k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 256
SHARD_ROWS = 16_384
LEAST_SHARD_ROWS = 2_048
QUERY_ROWS = 4_096
_EXACT = 1 << 53


def whole_codes(vector: str = "embedding", scale: int = 256) -> Column:
    """Each component as ``floor(scale * x)``, from doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: str = "embedding") -> Column:
    """Whether a vector and all its components are there and finite."""
    x = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, x)


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best_of_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int):
    """``(ids, scores)`` of each query's k best rows of a shard, best first; -1 << 62 where there are fewer."""
    none = -(1 << 62)
    order = np.argsort(ids, kind="stable")
    ids, codes = ids[order], codes[order]
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(codes).max(initial=0)) * max(1, codes.shape[1])
    kind = np.float64 if limit < _EXACT else np.int64  # doubles hold these sums exactly
    queries, codes = queries.astype(kind), codes.astype(kind)
    cuts = np.arange(0, len(ids), BLOCK_ROWS)
    high, low = np.maximum.reduceat(codes, cuts), np.minimum.reduceat(codes, cuts)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    visit = np.argsort(-bounds, axis=1, kind="stable")
    top_score = np.full((len(queries), k), none, np.int64)
    top_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    active = np.arange(len(queries))
    for turn in range(len(cuts)):
        block = visit[active, turn]
        go = bounds[active, block] >= top_score[active, -1]  # an equal score may have a smaller id
        active, block = active[go], block[go]
        if not len(active):
            break
        for b in np.unique(block):
            who = active[block == b]
            at = slice(int(cuts[b]), int(cuts[b]) + BLOCK_ROWS)
            scores = (queries[who] @ codes[at].T).astype(np.int64)
            scores[query_ids[who][:, None] == ids[at][None, :]] = none
            better = scores.max(1) >= top_score[who, -1]
            who, scores = who[better], scores[better]
            if len(who):
                both = np.concatenate([top_score[who], scores], 1)
                names = np.concatenate([top_id[who], np.broadcast_to(ids[at], scores.shape)], 1)
                best = np.lexsort((names, -both), axis=1)[:, :k]
                top_score[who], top_id[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    return top_id, top_score


def search(rows: DataFrame, is_query: Column, id: str = "vec_id", codes: str = "codes", k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every row that ``is_query`` marks.

    ``codes`` is an array of whole numbers; missing components at the end of a shorter one count as
    zero.  Candidates are all rows but those with the query's own id; ties go to the smaller id.
    Rows that repeat id and codes count once, rows with a null id or null codes take no part, and a
    query with fewer than k candidates has fewer rows.

    Queries and candidates meet tile by tile, a bounded number of each, and a tile sends on k rows
    a query at most.
    """
    rows = rows.where(F.col(id).isNotNull() & F.col(codes).isNotNull()).select(
        F.col(id).cast("long").alias("_id"), F.col(codes).cast("array<long>").alias("_codes"), is_query.alias("_query")
    ).distinct()
    count, queries = rows.agg(F.count("*"), F.count(F.when(F.col("_query"), 1))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-count // SHARD_ROWS), min(cores, -(-count // LEAST_SHARD_ROWS)), 1)
    groups = max(1, -(-queries // QUERY_ROWS))
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "_id", "_codes"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where("_query").select(place(groups, 1).alias("group"), every(shards).alias("shard"), "_id", "_codes")
    right = rows.select(every(groups).alias("group"), place(shards, 2).alias("shard"), "_id", "_codes")

    def tile(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if asked.num_rows and there.num_rows:
            q, c = asked["_codes"].to_pylist(), there["_codes"].to_pylist()
            width = max(map(len, [*q, *c]))
            names = asked["_id"].to_numpy()
            found, scores = best_of_shard(names, _matrix(q, width), there["_id"].to_numpy(), _matrix(c, width), k)
            has = scores > -(1 << 62)
            out = {"query_id": pa.array(np.repeat(names, k)[has.ravel()]), "vec_id": pa.array(found[has]), "score": pa.array(scores[has])}
        return pa.table(out)

    best = left.groupBy("group", "shard").cogroup(right.groupBy("group", "shard")).applyInArrow(
        tile, "query_id long, vec_id long, score long")
    # Equal rows of one id count once, also where their vectors differ and both are queries.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as codes from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_sum(list_transform(range(1, len(q.codes) + 1), lambda i: q.codes[i] * c.codes[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 5
"""
