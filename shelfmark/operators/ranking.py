"""Exact nearest neighbours, rankings and seeded sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.vectors import dot
from shelfmark.plans.runtime import broadcastable, cut

#: Bytes of query vectors broadcast at once (but QUERY_BLOCK queries at least), queries scored at once, and rows of the corpus scored at once.
QUERY_BYTES, QUERY_BLOCK, ROWS = 32 << 20, 4096, 1024
#: How far a matrix product may be off the sum in fixed order, as a share of the vectors' lengths.
SLACK = 1e-12
RANKED = "query_id bigint, idx bigint, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in one fixed order, so equal vectors have equal scores wherever they stand; NaN is the least."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 16):
        out[at : at + (1 << 16)] = (a[at : at + (1 << 16)] * b[at : at + (1 << 16)]).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


class _Best:
    """The best ``k`` rows of the corpus met so far, of each query of a block."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, matrix: np.ndarray, k: int, exclude: str):
        self.ids, self.own, self.matrix, self.k, self.exclude = ids, own, matrix, k, exclude
        self.slack = SLACK * np.linalg.norm(np.nan_to_num(matrix), axis=1)
        #: Query, row and score of what is kept, and the score a row must reach.
        self.of, self.who, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(len(ids), -np.inf)

    def add(self, idx: np.ndarray, vectors: np.ndarray) -> None:
        near = np.nan_to_num(self.matrix @ vectors.T, nan=-np.inf)
        same = idx[None, :] == self.own[:, None]
        if self.exclude != "none":
            near[same] = -np.inf
        slack = self.slack * (np.nanmax(np.linalg.norm(vectors, axis=1), initial=0.0) + 1.0)
        # The product in blocks is only a filter: what may be among the best is scored again, in fixed order.
        bar = self.bar if len(idx) <= self.k else np.maximum(self.bar, -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1])
        take = near >= (bar - slack)[:, None]
        if self.exclude == "drop":
            take &= ~same
        q, c = np.nonzero(take)
        if not q.size:
            return
        score = _exact(self.matrix[q], vectors[c])
        if self.exclude == "last":
            score[same[q, c]] = -np.inf
        of, who, score = np.concatenate([self.of, q]), np.concatenate([self.who, idx[c]]), np.concatenate([self.score, score])
        order = np.lexsort((who, -score, of))
        of, who, score = of[order], who[order], score[order]
        first = np.searchsorted(of, np.arange(len(self.ids)))
        keep = np.arange(of.size) - first[of] < self.k
        self.of, self.who, self.score = of[keep], who[keep], score[keep]
        full = np.bincount(self.of, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.of, np.arange(len(self.ids)), "right") - 1
        self.bar = np.where(full, self.score[np.maximum(last, 0)] if self.score.size else -np.inf, -np.inf)


def _top(held, k: int, exclude: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, matrix = held.value
        best = [_Best(ids[at : at + QUERY_BLOCK], own[at : at + QUERY_BLOCK], matrix[at : at + QUERY_BLOCK], k, exclude) for at in range(0, len(ids), QUERY_BLOCK)]
        for b in batches:
            idx, vectors = b.column(0).to_numpy(), _matrix(b.column(1))
            for at in range(0, len(idx), ROWS):
                for x in best:
                    x.add(idx[at : at + ROWS], vectors[at : at + ROWS])
        for x in best:
            if x.of.size:
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.of]), pa.array(x.who), pa.array(x.score)], ["query_id", "idx", "score"])

    return run


def _blocks(queries: DataFrame, extra: str, block: int | None) -> Iterator[tuple]:
    """The queries as matrices of at most about ``block`` rows, one after another."""
    queries = queries.where("vector is not null").select(F.col("query_id").cast("bigint"), F.col(extra).cast("bigint").alias("own") if extra else F.lit(None).cast("bigint").alias("own"), F.col("vector").cast("array<double>").alias("vector"))
    for t in _tables(queries, block):
        yield t["query_id"].combine_chunks().to_numpy(), t["own"].combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy(), _matrix(t["vector"].combine_chunks())


def _tables(queries: DataFrame, block: int | None) -> Iterator[pa.Table]:
    """One job where all fit into a block; else the queries are written once, counted, and read in parts by hash, each a pass over
    the corpus. Without ``block`` a part has QUERY_BYTES of vectors."""
    t = queries.limit((block or QUERY_BLOCK) + 1).toArrow()
    if t.num_rows <= (block or QUERY_BLOCK):
        yield t
        return
    block = block or max(QUERY_BLOCK, QUERY_BYTES // (8 * max(1, len(t["vector"][0]))))
    queries = cut(queries)
    n = -(-queries.count() // block)
    for k in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).toArrow()


def nearest(queries: DataFrame, corpus: DataFrame, k: int, *, exclude: str | None = None, how: str = "drop", strategy: str = "block", block: int | None = None) -> DataFrame:
    """``query_id, rank, idx, score``: the ``k`` rows of the corpus (``idx, vector``) with the largest inner product.

    Ties go to the lower ``idx``; NaN counts as the least score; rows and queries without a vector take no part.
    ``exclude`` names a column of ``queries`` with an ``idx`` to leave out: ``how="drop"`` drops it, ``"last"`` keeps it at
    the end of the list. ``strategy="block"`` sends the queries in blocks to the corpus, which stays where it is: each
    partition keeps the best ``k`` of each query, and only these are shuffled. ``"sql"`` is the same as a
    join of the broadcast queries, for at most ``block`` (4,096) of them; more go in blocks all the same. Scores are summed in one
    fixed order, so equal vectors tie wherever they stand.
    """
    if strategy == "sql" and broadcastable(queries, block or QUERY_BLOCK):
        q = queries.where("vector is not null").select("query_id", F.col("vector").alias("qv"), F.col(exclude).alias("own") if exclude else F.lit(None).cast("bigint").alias("own"))
        c = corpus.where("vector is not null").select("idx", F.col("vector").alias("cv"))
        scored = c.join(F.broadcast(q), F.lit(True)).withColumn("score", F.nanvl(dot(F.col("qv"), F.col("cv")), F.lit(float("-inf"))))
        same = F.coalesce(F.col("idx") == F.col("own"), F.lit(False))
        scored = scored.where(~same) if how == "drop" else scored.withColumn("score", F.when(same, F.lit(float("-inf"))).otherwise(F.col("score")))
        found = scored.select("query_id", "idx", "score")
    else:
        sc = queries.sparkSession.sparkContext
        vectors = corpus.where("vector is not null").select(F.col("idx").cast("bigint").alias("idx"), F.col("vector").cast("array<double>").alias("vector"))
        found = None
        for part in _blocks(queries, exclude or "", block):
            if len(part[0]):
                near = vectors.mapInArrow(_top(sc.broadcast(part), k, how if exclude else "none"), RANKED)
                found = near if found is None else found.unionByName(near)
        if found is None:
            found = queries.sparkSession.createDataFrame([], RANKED)
    return ranked(found).where(F.col("rank") <= k)


def ranked(scored: DataFrame, *, by: str = "query_id", ties: str = "idx") -> DataFrame:
    """``rank`` from 1 by descending score within ``by``; ties by the lower ``ties``; NaN last."""
    order = Window.partitionBy(by).orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), F.asc(ties))
    return scored.withColumn("rank", F.row_number().over(order)).select(by, "rank", *[c for c in scored.columns if c != by])


def _beaten(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, positive, matrix, goals = held.value
        scores = _exact(matrix, goals)
        count = np.zeros(len(ids), np.int64)
        size = SLACK * np.linalg.norm(np.nan_to_num(matrix), axis=1)
        for b in batches:
            idx, vectors = b.column(0).to_numpy(), _matrix(b.column(1))
            for at in range(0, len(idx), ROWS):
                part, some = idx[at : at + ROWS], vectors[at : at + ROWS]
                for q in range(0, len(ids), QUERY_BLOCK):
                    own = slice(q, q + QUERY_BLOCK)
                    score = np.nan_to_num(matrix[own] @ some.T, nan=-np.inf)
                    slack = (size[own] * (np.nanmax(np.linalg.norm(some, axis=1), initial=0.0) + 1.0))[:, None]
                    ahead = score > scores[own, None] + slack
                    # What is too close to call is summed in the order in which the positive's own score is.
                    i, j = np.nonzero(~ahead & (score >= scores[own, None] - slack))
                    exact, goal = _exact(matrix[own][i], some[j]), scores[own][i]
                    ahead[i, j] = (exact > goal) | ((exact == goal) & (part[j] < positive[own][i]))
                    count[own] += (ahead & (part[None, :] != positive[own, None])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count)], ["query_id", "ahead"])

    return run


def rank_of_positive(queries: DataFrame, corpus: DataFrame, *, block: int | None = None) -> DataFrame:
    """``query_id, positive, rank``: where the one known positive of each query (``query_id, vector, positive``) stands in
    the ranking of the whole corpus; rows of the same score stand in order of ``idx``. Each partition counts what stands before it;
    nothing is sorted. NaN is the least score."""
    sc = queries.sparkSession.sparkContext
    vectors = corpus.where("vector is not null").select(F.col("idx").cast("bigint").alias("idx"), F.col("vector").cast("array<double>").alias("vector"))
    goal = queries.join(vectors.select(F.col("idx").alias("positive"), F.col("vector").alias("goal")), "positive")
    goal = goal.select("query_id", "positive", F.col("vector").cast("array<double>").alias("vector"), "goal")
    out = None
    for t in _tables(goal, block):
        if not t.num_rows:
            continue
        matrix, goals = _matrix(t["vector"].combine_chunks()), _matrix(t["goal"].combine_chunks())
        ids, positive = t["query_id"].combine_chunks().to_numpy(), t["positive"].combine_chunks().to_numpy()
        part = vectors.mapInArrow(_beaten(sc.broadcast((ids, positive, matrix, goals))), "query_id bigint, ahead bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, positive bigint, rank bigint")
    ahead = out.groupBy("query_id").agg((F.sum("ahead") + 1).alias("rank"))
    return queries.select("query_id", "positive").join(ahead, "query_id")


def sample_groups(rows: DataFrame, group: str, key: str, k: int, seed: int, *, strict: bool = False) -> DataFrame:
    """``k`` rows of each group without replacement, numbered ``repeat_id`` from 1.

    The order is that of ``md5("seed:key")``, then ``key``: the same rows for the same seed on any cluster and
    in any other engine. With ``strict`` a group of fewer than ``k`` rows is an error.
    """
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    out = rows.withColumn("repeat_id", F.row_number().over(order)).where(F.col("repeat_id") <= k)
    if strict:
        size = F.count("*").over(Window.partitionBy(group))
        out = out.withColumn("repeat_id", F.when(size >= k, F.col("repeat_id")).otherwise(F.raise_error(F.lit(f"a group has fewer than {k} rows"))))
    return out


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.where(F.col("rank") <= k)


def beyond(scored: DataFrame, k: int) -> DataFrame:
    return scored.where(F.col("rank") > k)


def first_best(rows: DataFrame, score: Column, position: str) -> DataFrame:
    """The row of the largest score, the first of equals."""
    return rows.withColumn("_s", score).orderBy(F.desc("_s"), F.asc(position)).limit(1).drop("_s")
