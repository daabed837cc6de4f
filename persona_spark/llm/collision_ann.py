"""Nearest neighbours by collision counting: query-centred windows on single projections, widened by virtual rehashing."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


K = 20
#: A vector is verified once it lies in the windows of so large a share of the projections.
COLLISION_SHARE = 0.8
#: Growth of the windows per round. The first width is fitted on so many queries of a block.
WIDENING = 1.06
FITTED_QUERIES = 16
#: A query is done in a block once so large a share of its vectors passed the threshold, and so many (or all) of them.
VERIFIED_SHARE = 0.1
VERIFIED_LEAST = 400
#: Vectors of one block and queries of one block: what a task holds at once.
BLOCK_VECTORS = 16_384  # at most 65,535: places are kept in two bytes
BLOCK_QUERIES = 2_048
SEED = 7


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that take part: vectors that are not null, not zero and hold finite numbers only."""
    c = F.col(vector)
    finite = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0.0))


def projections(dimensions: int, seed: int = SEED) -> np.ndarray:
    """Random directions at right angles, as many as there are dimensions: together they lose nothing of a distance.
    The last row belongs to the coordinate that makes all vectors equally long."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions + 1, dimensions + 1)))[0]


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that the nearest by distance are those with the largest inner product."""
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0.0))
    return np.hstack([x, rest[:, None]])


class Block:
    """The index of one block: per projection a sorted array, and each vector's place in it."""

    def __init__(self, projected: np.ndarray):
        order = np.argsort(projected, axis=1, kind="stable")
        self.ordered = np.take_along_axis(projected, order, axis=1)
        # Equal rows share a block, so it may hold more than two bytes can count.
        self.kind = np.uint16 if order.shape[1] <= np.iinfo(np.uint16).max else np.uint32
        self.places = np.empty(order.shape, self.kind)
        np.put_along_axis(self.places, order, np.arange(order.shape[1], dtype=self.kind)[None, :], axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per vector, in how many of the windows [low, high) of the sorted arrays it lies."""
        inside = (self.places - low.astype(self.kind)[:, None]) < (high - low).astype(self.kind)[:, None]
        return inside.sum(axis=0, dtype=np.uint16)

    def candidates(self, at: np.ndarray, need: int, threshold: int, width: float) -> list[np.ndarray]:
        """For every query (a row of projections) the vectors that collide with it on at least `threshold`
        projections. Windows around the queries grow round by round; a query with `need` candidates is done."""
        m, n = self.ordered.shape
        out: list[np.ndarray] = [np.array([], np.int64)] * len(at)
        waiting = np.arange(len(at))
        while len(waiting):
            low = np.array([np.searchsorted(self.ordered[j], at[waiting, j] - width, "left") for j in range(m)])
            high = np.array([np.searchsorted(self.ordered[j], at[waiting, j] + width, "right") for j in range(m)])
            going = []
            for k, query in enumerate(waiting):
                found = np.flatnonzero(self.collisions(low[:, k], high[:, k]) >= threshold)
                if len(found) >= min(need, n):
                    out[query] = found
                else:
                    going.append(query)
            waiting = np.array(going, np.int64)
            width *= WIDENING
        return out

    def fitted_width(self, projected: np.ndarray, at: np.ndarray, need: int, threshold: int) -> float:
        """Width to start from: below it, few of a sample of the queries would have `need` candidates."""
        need = min(need, projected.shape[1])
        widths = []
        for row in at[:: max(1, len(at) // FITTED_QUERIES)]:
            reach = np.partition(np.abs(projected - row[:, None]), threshold - 1, axis=0)[threshold - 1]
            widths.append(np.partition(reach, need - 1)[need - 1])
        return max(float(np.quantile(widths, 0.1)), np.finfo(float).tiny)


def collision_ann(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    share: float = COLLISION_SHARE,
    verified: float = VERIFIED_SHARE,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
    seed: int = SEED,
) -> DataFrame:
    """The k nearest found of every query: query_id, rank, vec_id, score (inner product in double precision).

    `vectors` and `queries` hold vec_id and embedding. A query is no candidate of itself (by vec_id); ties go to the
    smaller id. Rows whose id or vector is null, whose vector is zero, or holds null or non-finite components take no
    part; vectors of another length than most are an error. Repeated rows are candidates each. Other columns
    are left out; no vectors, or no queries, give no rows.

    Vectors are dealt out by a hash into blocks of bounded size. Each block is indexed (all vectors of it, in sorted
    arrays per projection) and meets the queries in blocks of bounded size too; per block the candidates are
    verified exactly and the k best kept, so that what is shuffled back is k rows per query and block.
    """
    base = usable(vectors.select("vec_id", F.col("embedding").cast("array<double>"))).filter("vec_id IS NOT NULL")
    asked = usable(queries.select("vec_id", F.col("embedding").cast("array<double>"))).filter("vec_id IS NOT NULL")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    facts = base.agg(
        F.count("*").alias("n"),
        F.sqrt(F.max(squares)).alias("longest"),
        F.max(F.size("embedding")).alias("d"),
        F.min(F.size("embedding")).alias("least"),
    ).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not facts.n:
        return vectors.sparkSession.createDataFrame([], result)
    if facts.d != facts.least:
        raise ValueError(f"vectors of {facts.least} and of {facts.d} components")
    n_queries = asked.count()
    blocks = -(-facts.n // block_vectors)
    query_blocks = max(1, -(-n_queries // block_queries))
    directions = projections(facts.d, seed)
    longest, threshold = facts.longest, max(1, int(np.ceil(share * (facts.d + 1))))

    def matrix(column: pd.Series) -> np.ndarray:
        return np.array(column.to_list(), np.float64).reshape(len(column), -1)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own, questions = pdf[~pdf["asked"]], pdf[pdf["asked"]]
        if own.empty or questions.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = matrix(own["embedding"]), own["vec_id"].to_numpy()
        projected = np.ascontiguousarray((_lifted(x, longest) @ directions).T)
        block = Block(projected)
        need = max(VERIFIED_LEAST, int(verified * len(x)))
        # Queries have no length to lift: the best direction for a query is the query itself, scaled to `longest`.
        q = matrix(questions["embedding"])
        q_scaled = q * (longest / np.linalg.norm(q, axis=1))[:, None]
        at = np.hstack([q_scaled, np.zeros((len(q), 1))]) @ directions
        width = block.fitted_width(projected, at, need, threshold)
        parts = []
        for i, found in enumerate(block.candidates(at, need, threshold, width)):
            query_id = questions["vec_id"].iloc[i]
            found = found[ids[found] != query_id]
            scores = (x[found] * q[i]).sum(axis=1)
            best = np.lexsort((ids[found], -scores))[:k]
            parts.append((np.full(len(best), query_id), ids[found][best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    dealt = base.select(
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
        F.lit(False).alias("asked"),
        "vec_id",
        "embedding",
    )
    spread = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"),
        F.lit(True).alias("asked"),
        "vec_id",
        "embedding",
    )
    found = dealt.unionByName(spread).groupBy("block", "query_block").applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    nearest = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
