"""Exact nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised once to int8 and packed into blocks; groups of query blocks meet lanes of candidate blocks by an equality join on
(group, lane), and only int8 values, steps and sums move there. Each tile is an int8 product, which gives every inner product up to
a proven error: with x = s (q + e), |e| <= 1/2 in each component,

    |x.y - s_x s_y q_x.q_y| <= s_x s_y (|q_x|_1 + |q_y|_1 + d / 2) / 2

in which |q|_1 is the sum of absolute values. A pair survives if its upper bound reaches the k-th lower bound seen for its query, in its lane first,
then over lanes. Survivors are joined to the original vectors and computed again in double precision, and the best are kept by
bounded heaps, before the shuffle by query and after it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a block, blocks of a lane, and query blocks of a group.
BLOCK, LANE, GROUP = 2_048, 64, 16
#: Relative and absolute room for rounding in the bounds themselves, and what is too large to be bounded.
ROOM, TINY, HUGE = 1e-9, 1e-300, 1e300
#: Pairs of a query block that are held before those that fell behind are let go, and parts of a group of copies.
HELD, PARTS = 4_000_000, 1_024
BLOCKS = "block long, n int, dim int, ids binary, q binary, steps binary, ones binary"
PAIRS = "query_id long, vec_id long, high double, floor double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim): vectors with an id that are not null, empty or zero and have finite components only; one for each id."""
    v = F.col(vector_col).cast("array<double>")
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return plain.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def distinct_candidates(rows: DataFrame, k: int) -> DataFrame:
    """Candidates without those that cannot be among the k nearest of any query: of equal vectors all but the k + 1 of the smallest ids.

    A group of copies is cut in parts before it is brought together, so the largest costs no task more than a part of it.
    """
    first = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    parts = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)).alias("part")).agg(first(F.collect_list("vec_id")).alias("ids"))
    return parts.groupBy("v").agg(first(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.explode("ids").alias("vec_id"), "v", F.size("v").alias("dim"))


def packed_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of quantised vectors of one dimension."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        q, step, ones = quantised(np.stack(pdf["v"].to_numpy()).astype("f8"))
        return pd.DataFrame({"block": [key[0]], "n": [len(pdf)], "dim": [key[1]], "ids": [pdf["vec_id"].to_numpy("i8").tobytes()], "q": [q.tobytes()], "steps": [step.tobytes()], "ones": [ones.astype("i8").tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long"))
    return dealt.groupBy("block", "dim").applyInPandas(pack, BLOCKS)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, each row's step, and the sum of the absolute values."""
    step = np.maximum(np.abs(x).max(1) / 127, np.finfo("f8").tiny)
    q = np.rint(x / step[:, None]).astype("i1")
    return q, step, np.abs(q.astype("i4")).sum(1)


def tile_bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two quantised blocks; what overflows is bounded by nothing. Products of int8 are summed in
    float32, which holds every whole number below 2^24: exact for up to 1,040 components, and in float64 beyond."""
    (qa, sa, la), (qb, sb, lb) = a, b
    kind = "f4" if qa.shape[1] <= 1_040 else "f8"
    dot = (qa.astype(kind) @ qb.astype(kind).T).astype("f8")
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        scale = sa[:, None] * sb[None, :]
        error = scale * (la[:, None] + lb[None, :] + qa.shape[1] / 2) / 2
        middle = scale * dot
        error += ROOM * (np.abs(middle) + error) + TINY
        low, high = middle - error, middle + error
    open_ = ~(np.abs(middle) + error < HUGE)
    low[open_], high[open_] = -np.inf, np.inf
    return low, high


def block_of(row: tuple) -> tuple[np.ndarray, tuple]:
    return np.frombuffer(row.ids, "i8"), (np.frombuffer(row.q, "i1").reshape(row.n, row.dim), np.frombuffer(row.steps, "f8"), np.frombuffer(row.ones, "i8"))


def lane_search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The pairs of a group of query blocks with a lane that can be among the k nearest, with their upper bounds and the query's k-th lower bound."""
    out = []
    for query in queries.itertuples():
        ids, x = block_of(query)
        floor = np.full((len(ids), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for row in candidates[candidates["dim"] == query.dim].itertuples():
            other, y = block_of(row)
            low, high = tile_bounds(x, y)
            own = ids[:, None] == other[None, :]
            low[own] = -np.inf
            floor = -np.partition(-np.concatenate([floor, low], 1), k - 1, 1)[:, :k]
            at, where = np.nonzero((high >= floor.min(1)[:, None]) & ~own)
            found.append((at, other[where], high[at, where]))
            held += len(at)
            if held > HELD:
                found = [_above(found, floor.min(1))]
                held = len(found[0][0])
        at, vec, high = _above(found, floor.min(1)) if found else (np.zeros(0, "i8"),) * 3
        out.append(pd.DataFrame({"query_id": ids[at], "vec_id": vec, "high": high, "floor": floor.min(1)[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "high": [], "floor": []})


def _above(found: list[tuple], floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, vec, high = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = high >= floor[at]
    return at[keep], vec[keep], high[keep]


def inner_product(x: Column, y: Column) -> Column:
    """Summed in order of the components."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def nearest(vectors: DataFrame, scratch: Scratch, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, lane: int = LANE, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products for each id divisible by `every`, ties to the smaller id.

    The query's own id is no candidate. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    without an id; of rows that share an id the least vector counts, in order of components. Vectors meet those of their own dimension
    only. A product that overflows is infinite, and one that is then no number comes after all others. With fewer than k candidates all are
    returned; an empty table gives no rows; other columns are not read.
    """
    rows = scratch.write(usable(vectors, id_col, vector_col), "usable")
    n = rows.count()
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // (every * block)))
    groups = -(-query_blocks // group)
    lanes = max(-(-blocks // lane), min(blocks, -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups)))
    queries = packed_blocks(asked, query_blocks).withColumn("group", F.pmod("block", F.lit(groups)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    tiles = packed_blocks(distinct_candidates(rows, k), blocks).withColumn("lane", F.pmod("block", F.lit(lanes)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = queries.groupBy("group", "lane").cogroup(tiles.groupBy("group", "lane")).applyInPandas(lambda a, b: lane_search(a, b, k), PAIRS)
    pairs = scratch.write(pairs, "pairs")
    floors = pairs.groupBy("query_id").agg(F.max("floor").alias("least"))
    left = pairs.join(floors, "query_id").filter("high >= least").select("query_id", "vec_id")
    both = left.join(rows.select("vec_id", F.col("v").alias("y")), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("x")), "query_id")
    scored = both.select("query_id", "vec_id", inner_product(F.col("x"), F.col("y")).alias("score"))
    key = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), key.desc(), "vec_id"))
    return scored.withColumn("rank", ranks).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "neighbours"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, min(v) AS v FROM v GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
