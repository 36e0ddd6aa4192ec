"""Hard negatives by a norm-bucketed search.

Candidates are sorted by norm, dealt by range, and packed into buckets; a bucket knows its greatest norm. By Cauchy and Schwarz no vector of a bucket has a
greater inner product with an anchor than |anchor| times that norm. Groups of anchors meet lanes of buckets by an equality join on (group, lane), twice:
first for the nearest vectors of the anchor's own label, the positives; then for the negatives, whose window lies between two shares of a
positive's score. A bucket is not sent to a group if it lies below every lower limit of the group's windows. Inside a task buckets come in falling
order of norm, and one is passed over for those anchors for which it lies below the lower limits and below the k-th score seen so far; when that holds for
all anchors, the rest of the lane is passed over. Scores are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, finite_components

#: Vectors of a bucket at most, components of a bucket, anchors that are multiplied at a time, anchors of a group, buckets of a lane.
BUCKET, VALUES, ANCHORS, GROUP, LANE = 2_048, 1 << 19, 1_024, 16_384, 32
#: Parts of a group of copies, room for rounding in bounds, and where scores end.
PARTS, ROOM, MOST = 1_024, 1e-9, 1 << 56
BUCKETS = "bucket long, n int, dim int, top double, kind string, ids binary, labels binary, q binary"
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(vectors: DataFrame, label: Column, v: Column, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, label, v, norm, dim): rows with an id, a label and a vector of finite components; of rows that share an id the least by label and vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite_components(F.col("v")))
    best = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    return best.select("*", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"), F.size("v").alias("dim"))


def distinct_candidates(rows: DataFrame, k: int) -> DataFrame:
    """Candidates without those that cannot be chosen: of equal vectors of one label all but the k of the smallest ids.

    A group of copies is cut in parts before it is brought together, so the largest costs no task more than a part of it.
    """
    first = lambda ids: F.slice(F.array_sort(ids), 1, k)
    parts = rows.groupBy("label", "v", "norm", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)).alias("part")).agg(first(F.collect_list("vec_id")).alias("ids"))
    return parts.groupBy("label", "v", "norm", "dim").agg(first(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.explode("ids").alias("vec_id"), "label", "v", "norm", "dim")


def buckets_of(rows: DataFrame, size: int) -> DataFrame:
    """Candidates by falling norm, as buckets of at most `size` vectors of one dimension, one or more a partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def bucket(rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
            dim = rows.column(4)[0].as_py()
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column(2).chunks]).reshape(-1, dim)
            kind = "<i2" if np.abs(x).max() < 32_000 else "<f8"
            top = float(np.max(rows.column(3).to_numpy()))
            blob = lambda i: rows.column(i).to_numpy().astype("<i8").tobytes()
            data = {"bucket": [(part << 32) + seq], "n": [len(x)], "dim": [dim], "top": [top], "kind": [kind], "ids": [blob(0)], "labels": [blob(1)], "q": [x.astype(kind).tobytes()]}
            return pa.RecordBatch.from_pydict(data, schema=pa.schema([("bucket", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("top", pa.float64()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary())]))

        for batch in batches:
            table = pa.Table.from_batches([*held, batch]) if held else pa.Table.from_batches([batch])
            dims, at, held = table.column(4).to_numpy(), 0, []
            while at < len(dims):
                other = np.flatnonzero(dims[at:] != dims[at])
                same = int(other[0]) if len(other) else len(dims) - at
                want = max(1, min(size, VALUES // int(dims[at])))
                if same < want and at + same == len(dims):
                    break
                yield bucket(table.slice(at, min(same, want)))
                seq, at = seq + 1, at + min(same, want)
            held = table.slice(at).to_batches()
        if held:
            yield bucket(pa.Table.from_batches(held))

    order = ["dim", F.desc("norm"), "vec_id"]
    dealt = rows.select("vec_id", "label", "v", "norm", "dim").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(pack, BUCKETS)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as doubles or integers; beyond 2^56 they count as 2^56."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2**53:
        kind = "f4" if most < 2**24 else "f8"
        return (x.astype(kind) @ y.astype(kind).T).astype("f8")
    if most < MOST:
        return x.astype("i8") @ y.astype("i8").T
    whole = lambda z: np.array([[int(v) for v in row] for row in z], object).reshape(z.shape)
    return np.clip(whole(x) @ whole(y).T, -MOST, MOST).astype("i8")


class Best:
    """The k best (score, id) seen of each key: greater scores first, then smaller ids."""

    def __init__(self, keys: int, k: int):
        self.k, self.kth = k, np.full(keys, -np.inf)
        self.key = self.score = self.id = np.zeros(0, "i8")

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score.astype("i8")]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(starts, np.diff(starts, append=len(key)))
        keep = place < self.k
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.kth[key[last]] = score[last]


def chosen(s: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in s that fit and can be among the k greatest of their row."""
    if np.count_nonzero(fits) > 8 * k * len(s) and s.shape[1] > k:
        part = np.where(fits, s, -np.inf)
        fits = fits & (s >= np.partition(part, s.shape[1] - k, 1)[:, s.shape[1] - k][:, None])
    return np.nonzero(fits)


def bucket_of(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.labels, "<i8"), np.frombuffer(row.q, row.kind).reshape(row.n, row.dim)


def reach(norms: np.ndarray, top: float) -> np.ndarray:
    """The greatest inner product that each anchor can have in a bucket."""
    return np.minimum(norms * top * (1 + ROOM) + ROOM, MOST)


def parts_of(anchors: pd.DataFrame, buckets: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, list]]:
    """Anchors of one dimension, some at a time, as a frame and a matrix, and the buckets of that dimension by falling norm."""
    for dim, some in anchors.groupby("dim"):
        theirs = list(buckets[buckets["dim"] == dim].sort_values("top", ascending=False).itertuples())
        for i in range(0, len(some) if theirs else 0, ANCHORS):
            part = some.iloc[i : i + ANCHORS]
            yield part, np.stack(part["v"].to_numpy()), theirs


def positives_of(anchors: pd.DataFrame, buckets: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k first vectors of each anchor's label in a lane."""
    out = []
    for part, x, theirs in parts_of(anchors, buckets):
        own, labels, norms = (part[c].to_numpy() for c in ("vec_id", "label", "norm"))
        best = Best(len(x), k)
        for row in theirs:
            on = np.flatnonzero(reach(norms, row.top) >= best.kth)
            if not len(on):
                break
            ids, other, y = bucket_of(row)
            s = products(x[on], y)
            at, where = chosen(s, (labels[on][:, None] == other) & (own[on][:, None] != ids) & (s >= best.kth[on][:, None]), k)
            best.add(on[at], s[at, where], ids[where])
        out.append(pd.DataFrame({"anchor_id": own[best.key], "positive_id": best.id, "positive_score": best.score}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype="i8")


def negatives_of(anchors: pd.DataFrame, buckets: pd.DataFrame, k: int, low: int, high: int) -> tuple[pd.DataFrame, int]:
    """The k first vectors of other labels in each window of each anchor in a lane, and how many pairs were multiplied."""
    out, work = [], 0
    for part, x, theirs in parts_of(anchors, buckets):
        own, labels, norms = (part[c].to_numpy() for c in ("vec_id", "label", "norm"))
        scores, which = part["scores"].to_list(), part["positives"].to_list()
        width = max(map(len, scores))
        lower, upper, positive = np.full((len(x), width), MOST + 1, "i8"), np.full((len(x), width), -MOST - 1, "i8"), np.zeros((len(x), width, 2), "i8")
        for i, (p, ids) in enumerate(zip(scores, which, strict=True)):
            for j, (score, id_) in enumerate(zip(p.tolist(), ids.tolist(), strict=True)):
                lower[i, j], upper[i, j], positive[i, j] = -(-low * score // 100), high * score // 100, (id_, score)
        best = Best(len(x) * width, k)
        for row in theirs:
            limit = np.maximum(lower, best.kth.reshape(len(x), width))
            on = np.flatnonzero((reach(norms, row.top) >= limit.min(1)))
            if not len(on):
                break
            ids, other, y = bucket_of(row)
            s = products(x[on], y)
            work += s.size
            differs = labels[on][:, None] != other
            some = differs & (s >= limit[on].min(1)[:, None]) & (s <= upper[on].max(1)[:, None])
            found = []
            if some.any():
                for j in range(width):
                    at, where = chosen(s, some & (s >= limit[on, j][:, None]) & (s <= upper[on, j][:, None]), k)
                    found.append((on[at] * width + j, s[at, where], ids[where]))
                best.add(*(np.concatenate(c) for c in zip(*found, strict=True)))
        of = positive.reshape(-1, 2)[best.key]
        out.append(pd.DataFrame({"anchor_id": own[best.key // width], "positive_id": of[:, 0], "positive_score": of[:, 1], "negative_id": best.id, "negative_score": best.score}))
    empty = pd.DataFrame({c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}, dtype="i8")
    return (pd.concat(out) if out else empty), work


def first(rows: DataFrame, keys: list[str], score: str, id_: str, k: int) -> DataFrame:
    """The k first rows of each key, with their rank."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), id_))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def sent(buckets: DataFrame, needs: DataFrame) -> DataFrame:
    """(bucket, group): the buckets that a group's windows (group, dim, need) can reach into; only norms are compared, no vector moves for it."""
    heads = buckets.groupBy("dim", "bucket").agg(F.max("top").alias("top"))
    return heads.join(needs, "dim").filter(F.col("top") >= F.col("need")).select("bucket", "group")


def mined(rows: DataFrame, scratch: Scratch, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, bucket: int = BUCKET) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for usable rows of whole numbers.

    Anchors are the rows whose id is divisible by `every`. A positive is one of the first `positives` other rows of the anchor's label, by inner product, ties to
    the smaller id. For each, the first `negatives` rows of another label whose score is from `low` to `high` per cent of the positive's, both included. Where
    there are fewer, all are returned; a window of a negative score is empty; vectors meet those of their own dimension. Scores beyond 2^56 count as 2^56.
    """
    rows = scratch.write(rows, "rows")
    spark = rows.sparkSession
    asked = rows.filter(F.col("vec_id") % every == 0)
    groups = max(1, -(-asked.count() // GROUP))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    buckets = scratch.write(buckets_of(distinct_candidates(rows, max(positives + 1, negatives)), bucket), "buckets")
    n = buckets.count()
    lanes = max(1, -(-n // LANE), min(n, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)))
    lane = F.pmod(F.shiftright("bucket", 32) + F.col("bucket").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(lanes)).cast("int").alias("lane")
    in_lanes = lambda df: df.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    everywhere = buckets.select("*", lane).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    near = in_lanes(asked).groupBy("group", "lane").cogroup(everywhere.groupBy("group", "lane")).applyInPandas(lambda a, b: positives_of(a, b, positives), POSITIVES)
    near = scratch.write(first(near, ["anchor_id"], "positive_score", "positive_id", positives).filter("positive_score >= 0"), "positives")

    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("w"))
    windows = asked.join(windows, "vec_id").select("vec_id", "label", "v", "norm", "dim", "group", F.col("w.positive_score").alias("scores"), F.col("w.positive_id").alias("positives"))
    windows = scratch.write(windows, "windows")
    least = F.array_min("scores") * low / 100 * (1 - ROOM) - ROOM
    needs = windows.groupBy("group", "dim").agg(F.min(F.when(F.col("norm") > 0, least / F.col("norm") * (1 - ROOM) - ROOM).when(least <= 0, 0.0).otherwise(float("inf"))).alias("need"))
    needs = scratch.write(needs, "needs")
    reached = buckets.join(sent(buckets, needs), "bucket").select(*buckets.columns, "group", lane)
    work = lambda a, b: negatives_of(a, b, negatives, low, high)[0]
    hard = in_lanes(windows).groupBy("group", "lane").cogroup(reached.groupBy("group", "lane")).applyInPandas(work, NEGATIVES)
    hard = first(hard, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole(x: Column) -> Column:
    """floor(256 x) as a double; what has no place after the point already stays."""
    y = 256 * x.cast("double")
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(usable(vectors, label, F.transform("embedding", whole)), Scratch(spark, "mining"))


OP11_SQL = """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM u a JOIN u c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
