"""Exact top-k search by inner product as a Voronoi join.

Vectors become integers, floor(scale * x). Pivots, the vectors with the least hashes of their keys, about as many as the
root of the number of vectors between 64 and `most_pivots`, cut the space into cells. One pass assigns every vector to its
nearest pivot; it also finds for each query a lower bound of its k-th best score, from SEEDS vectors of the table that
are broadcast (a fixed number; only how much is pruned depends on it). Summaries of the cells give the number, the
greatest length and the greatest distance to the pivot of all vectors there, and of the queries there the greatest
distance and the least bound. Groups of queries are packed from cells, large cells split by key.

From the summaries alone follows which cells a group needs: with pivot p and radius R of the group's queries and pivot c,
radius r and length m of the cell, no score there is above <p, c> + |p| r + R m. Queries go to blocks of needed cells
only, and of these a candidate x goes to a group only if <p, x> + R |x| reaches the group's bound. Each block of a group's
candidates is searched with one matrix product, and the best of the blocks give the answer.

Vectors that are null or hold a null, NaN or infinite component take no part; shorter vectors count as filled up with
zeros; null keys take no part; rows that share the query's key are its own and no candidates, and a repeated query key
is searched once (the least vector); ties go to the smaller key; repeated candidates appear as often as they occur.
An empty table gives an empty one; columns besides key and vector are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, session_of, small_batches


#: Vectors from which lower bounds of scores are found.
SEEDS = 2_048


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """k and v (array of bigint) of the rows that take part."""
    own = vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("x"))
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.where(F.col("k").isNotNull() & F.col("x").isNotNull() & fit).select("k", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of int64 vectors, filled up with zeros."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat, ends = flat[ends[0] : ends[-1]] if len(ends) else flat, ends - (ends[0] if len(ends) else 0)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T as int64: in floating point where no sum can pass 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    return a @ b.T


def best(scores: np.ndarray, keys: np.ndarray, own: np.ndarray, k: int):
    """For each row of scores the places of the k best, ties to the smaller key; columns must be in order of keys."""
    for row, (line, mine) in enumerate(zip(scores, own)):
        if len(line) > 4 * k:
            floor_ = np.partition(line, -2 * k)[-2 * k]
            at = np.flatnonzero(line >= floor_)
            others = at[keys[at] != mine]
            if len(others) < k:
                others = np.flatnonzero(keys != mine)
        else:
            others = np.flatnonzero(keys != mine)
        yield row, others[np.argsort(-line[others], kind="stable")[:k]]


def packed(sizes: dict[int, int], most: int) -> dict[int, list[int]]:
    """For each cell the bins it is dealt to: cells in order share a bin up to `most`, larger ones have several of their own."""
    bins: dict[int, list[int]] = {}
    made = room = 0
    for cell, n in sorted(sizes.items()):
        if n > most:
            parts = -(-n // most)
            bins[cell] = list(range(made, made + parts))
            made, room = made + parts, 0
        else:
            if n > room:
                made, room = made + 1, most
            bins[cell] = [made - 1]
            room -= n
    return bins


def chosen(vectors: DataFrame, n: int) -> tuple[list[int], list[list[int]]]:
    """Keys and vectors of the n rows with the least hashes."""
    rows = vectors.withColumn("h", F.xxhash64("k")).orderBy("h", "k", "v").limit(n).collect()  # at most n rows
    return [r["k"] for r in rows], [r["v"] for r in rows]


def filled(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256, pivots: int | None = None, most_pivots: int = 512, group_queries: int = 2_048, block_rows: int = 20_000) -> DataFrame:
    """query_id, rank, key and score: for each row whose key is divisible by query_step its k best among all other rows."""
    spark = session_of(vectors)
    small_batches(spark, 4_096)
    all_ = quantised(vectors, key, vector, scale)
    schema = f"query_id bigint, rank int, `{key}` bigint, score bigint"
    total, width = all_.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], schema)
    seed_keys, seeds = chosen(all_, SEEDS)
    n_pivots = pivots or min(most_pivots, max(64, math.isqrt(total)))
    seed_keys, seeds = np.array(seed_keys), filled(seeds, width)
    p = seeds[:n_pivots]
    held = spark.sparkContext.broadcast((p, seed_keys, seeds))

    def assign(batches):
        p, seed_keys, seeds = held.value
        squares = (p.astype(float) ** 2).sum(1)
        for batch in batches:
            keys, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            own = (x.astype(float) ** 2).sum(1)
            far = own[:, None] + squares - 2.0 * _products(x, p)
            cell = far.argmin(1) if len(x) else np.zeros(0, int)
            # The k-th best score among the seeds, the row's own left out, is a lower bound of its k-th best score.
            bound = np.full(len(x), np.iinfo(np.int64).min)
            asked = np.flatnonzero(keys % query_step == 0)
            for at in range(0, len(asked), 256):
                some = asked[at : at + 256]
                dots = np.where(seed_keys == keys[some][:, None], np.iinfo(np.int64).min, _products(x[some], seeds))
                if len(seeds) >= k:
                    bound[some] = np.partition(dots, -k, axis=1)[:, -k]
            near = np.sqrt(np.maximum(far[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(near, pa.float64()), pa.array(np.sqrt(own), pa.float64()), pa.array(bound, pa.int64())], ["k", "v", "cell", "far", "length", "bound"])

    assigned = cut(all_.mapInArrow(assign, "k bigint, v array<bigint>, cell int, far double, length double, bound bigint"), "cells")
    is_query = F.pmod("k", F.lit(query_step)) == 0
    asks = lambda c: F.when(is_query, F.col(c))
    summary = assigned.groupBy("cell").agg(F.count("k").alias("n"), F.max("far").alias("far"), F.max("length").alias("length"), F.count(asks("k")).alias("queries"), F.max(asks("far")).alias("radius"), F.min(asks("bound")).alias("bound"))
    cells = {r["cell"]: r for r in sorted(summary.collect())}  # at most one row a pivot
    # Groups of at most about group_queries queries, and blocks of about block_rows candidates: small cells together, in order; large cells in parts.
    groups = packed({c: r["queries"] for c, r in cells.items() if r["queries"]}, group_queries)
    if not groups:
        return spark.createDataFrame([], schema)
    blocks = packed({c: r["n"] for c, r in cells.items()}, block_rows)
    used, every = np.array(sorted(groups)), np.array(sorted(cells))
    radius, bound = (np.array([float(cells[c][f]) for c in used.tolist()]) for f in ("radius", "bound"))
    far, length = (np.array([cells[c][f] for c in every.tolist()]) for f in ("far", "length"))
    lengths = np.sqrt((p.astype(float) ** 2).sum(1))
    highest = _products(p[used], p[every]) + (lengths[used][:, None] * far + radius[:, None] * length) * (1 + 1e-9) + 1
    member = np.zeros((len(used), max(map(max, groups.values())) + 1), bool)
    for i, cell in enumerate(used.tolist()):
        member[i, groups[cell]] = True
    needs = ((highest >= bound[:, None]).T.astype(np.float32) @ member.astype(np.float32)) > 0  # by cell and group
    reach = spark.sparkContext.broadcast((used, radius, bound, member))

    def replicate(batches):
        """Each candidate once for every group of queries that it may serve."""
        p = held.value[0]
        used, radius, bound, member = reach.value
        for batch in batches:
            x, cell = _matrix(batch.column(1), width), batch.column(2)
            norms = np.sqrt((x.astype(float) ** 2).sum(1))
            may = _products(x, p[used]) + norms[:, None] * radius * (1 + 1e-9) + 1 >= bound
            rows, to = np.nonzero((may.astype(np.float32) @ member.astype(np.float32)) > 0)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in (batch.column(0), batch.column(1), cell)), pa.array(to, pa.int32())], ["k", "v", "cell", "grp"])

    dealt = F.broadcast(spark.createDataFrame([(c, bs) for c, bs in blocks.items()], "cell int, blocks array<int>"))  # at most one row a pivot
    spread = assigned.select("k", "v", "cell").mapInArrow(replicate, "k bigint, v array<bigint>, cell int, grp int")
    spread = spread.join(dealt, "cell").select("k", "v", "grp", F.expr("blocks[cast(pmod(xxhash64(k, v), size(blocks)) as int)]").alias("block"))
    table = spark.createDataFrame([(c, gs) for c, gs in groups.items()], "cell int, grps array<int>")  # at most one row a pivot
    asked = assigned.where(is_query).join(F.broadcast(table), "cell")
    asked = asked.withColumn("grp", F.expr("grps[cast(pmod(xxhash64(k), size(grps)) as int)]")).groupBy("grp", "k").agg(F.min("v").alias("v"))
    wanted = spark.createDataFrame([(int(c), np.flatnonzero(n).tolist()) for c, n in zip(every, needs)], "cell int, grps array<int>")
    wanted = wanted.join(dealt, "cell").select(F.explode("grps").alias("grp"), "blocks").select("grp", F.explode("blocks").alias("block")).distinct()
    asked = asked.join(wanted, "grp")

    def solve(queries, data):
        out: list[list] = [[], [], []]
        if len(queries) and len(data):
            qk, q = queries.column("k").to_numpy(), _matrix(queries.column("v").combine_chunks(), width)
            data = data.sort_by([("k", "ascending")])
            keys, x = data.column("k").to_numpy(), _matrix(data.column("v").combine_chunks(), width)
            for at in range(0, len(q), 256):
                scores = _products(q[at : at + 256], x)
                for row, found in best(scores, keys, qk[at : at + 256], k):
                    out[0] += [qk[at + row]] * len(found)
                    out[1] += keys[found].tolist()
                    out[2] += scores[row, found].tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", key, "score"])

    found = asked.groupBy("grp", "block").cogroup(spread.groupBy("grp", "block")).applyInArrow(solve, f"query_id bigint, `{key}` bigint, score bigint")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
