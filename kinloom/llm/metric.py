"""Near-duplicate vectors by an exact metric range join.

Two vectors of one label are linked if their cosine reaches COSINE, that is if their unit vectors are no further apart than r = sqrt(2 - 2 COSINE). Equal
vectors of a label form a class, which one vector stands for. Pivots, far apart in a bounded sample, partition the classes: each is native
to the cell of its nearest pivot. Cells keep, for each pivot, how near and how far their natives are. By the triangle inequality a vector has no partner in a
cell if for some pivot it lies more than r outside that range, nor if the plane halfway between its own pivot and the cell's is more than r away (a partner lies
beyond it); to all other cells of a smaller number it goes as a guest. So every pair within r meets once, in the cell of the smaller number, and cells join independently: natives with natives, and with guests.

A cell with many rows is cut into chunks, and pairs of chunks are tasks of their own. Inside a task pairs are counted, not listed: what leaves
it is the number of links of each vector and a spanning forest, from which components are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.graph import components

from .common import Scratch, finite_components

COSINE = 0.98
#: Pivots at least and at most, classes a pivot, and the rows from which pivots are taken (those of the least hashes).
FEW, MANY, PER_PIVOT, SAMPLE = 8, 256, 4_000, 2_048
#: Rows of a chunk, room for rounding in distances, and cosines so near the limit are computed again in order of the components.
CHUNK, ROOM, CLOSE = 1_024, 1e-6, 1e-9
PLACED = "rep long, label long, weight long, dim int, v array<double>, cell int, far array<double>"
COLUMNS = ["label", "dim", "cell", "native", "rep", "weight", "v"]
COPIES = "label long, dim int, cell int, native boolean, rep long, weight long, v array<double>"
LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so no square overflows or vanishes."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed in order of the components."""
    x, y = scaled(x), scaled(y)
    total = lambda a: np.cumsum(a, 1)[:, -1]
    return total(x * y) / (np.sqrt(total(x * x)) * np.sqrt(total(y * y)))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def far_apart(sample: list[list[float]], k: int) -> np.ndarray:
    """k unit vectors of the sample, each the furthest from those before; shorter ones are filled up with zeros, which changes no distance."""
    wide = max(map(len, sample))
    x = np.zeros((len(sample), wide))
    for i, v in enumerate(sample):
        x[i, : len(v)] = unit(np.array([v]))[0]
    picked, near = [0], 2 - 2 * (x @ x[0])
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmax(near)))
        near = np.minimum(near, 2 - 2 * (x @ x[picked[-1]]))
    return x[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    m = min(x.shape[1], pivots.shape[1])
    return np.sqrt(np.maximum(0, 2 - 2 * (x[:, :m] @ pivots[:, :m].T)))


def placed(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Classes with their cell and their distances from all pivots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                far = distances(unit(matrix(part.column(4), dim)), pivots)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(far.argmin(1).astype("i4")), pa.array(list(far), pa.list_(pa.float64()))], names=["rep", "label", "weight", "dim", "v", "cell", "far"])

    return classes.select("rep", "label", "weight", F.size("v").alias("dim"), "v").mapInArrow(work, PLACED)


def rings(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How near and how far the natives of each cell are from each pivot: two tables of k times k."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            cell, far = batch.column(0).to_numpy(), matrix(batch.column(1), k)
            np.minimum.at(low, cell, far)
            np.maximum.at(high, cell, far)
        cell = np.flatnonzero(np.isfinite(low[:, 0]))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, k).astype("i4")), pa.array(np.tile(np.arange(k, dtype="i4"), len(cell))), pa.array(low[cell].reshape(-1)), pa.array(high[cell].reshape(-1))], names=["cell", "pivot", "low", "high"])

    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    parts = rows.select("cell", "far").mapInArrow(work, "cell int, pivot int, low double, high double")
    for r in parts.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # k * k rows at most
        low[r.cell, r.pivot], high[r.cell, r.pivot] = r.low, r.high
    return low, high


def copies(rows: DataFrame, low: np.ndarray, high: np.ndarray, pivots: np.ndarray, r: float) -> DataFrame:
    """Each class in its own cell, and as a guest in those of smaller numbers that can hold partners."""
    room, between = r + ROOM, distances(pivots, pivots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(batch: pa.RecordBatch, at: np.ndarray, to: np.ndarray, native: bool) -> pa.RecordBatch:
            some = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([some.column(1), some.column(3), pa.array(to.astype("i4")), pa.array(np.full(len(to), native)), some.column(0), some.column(2), some.column(4)], names=COLUMNS)

        for batch in batches:
            cell, far = batch.column(5).to_numpy(), matrix(batch.column(6), len(low))
            yield put(batch, np.arange(len(cell)), cell, True)
            for j in range(int(cell.max(initial=0))):
                at = np.flatnonzero(cell > j)
                own = cell[at]
                at = at[far[at, j] ** 2 - far[at, own] ** 2 <= 2 * room * between[own, j] + ROOM]
                at = at[((far[at] >= low[j] - room) & (far[at] <= high[j] + room)).all(1)]
                if len(at):
                    yield put(batch, at, np.full(len(at), j), False)

    return rows.select("rep", "label", "weight", "dim", "v", "cell", "far").mapInArrow(work, COPIES)


def tiles(rows: DataFrame, chunk: int) -> DataFrame:
    """Copies with the tiles (lo, hi) in which they meet: natives of chunk lo with the rows of chunk hi. Small cells are one tile."""
    keys = ["label", "dim", "cell"]
    sizes = rows.groupBy(*keys).agg(F.count_if("native").alias("n"), F.count("*").alias("all")).filter(F.col("all") > chunk)
    parts = sizes.select(*keys, F.ceil(F.col("n") / chunk).cast("int").alias("own"), F.ceil((F.col("all") - F.col("n")) / chunk).cast("int").alias("others"))
    hash_ = F.xxhash64("rep")
    joined = rows.join(parts, keys, "left")
    own, others = F.coalesce("own", F.lit(1)), F.coalesce("others", F.lit(0))
    at = F.when(F.col("native") | (others == 0), F.pmod(hash_, own)).otherwise(own + F.pmod(hash_, F.greatest(others, F.lit(1)))).cast("int")
    with_ = F.when(F.col("native") | (others == 0), F.sequence(F.lit(0), own + others - 1)).otherwise(F.sequence(F.lit(0), own - 1))
    dealt = joined.withColumn("at", at).withColumn("with", F.explode(with_))
    return dealt.select(*COLUMNS, "at", F.least("at", "with").alias("lo"), F.greatest("at", "with").alias("hi"))


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that it can reach by the links (i, j)."""
    out = np.arange(n)
    while True:
        least = np.minimum(out[i], out[j])
        before = out.copy()
        np.minimum.at(out, before[i], least)
        np.minimum.at(out, before[j], least)
        while not np.array_equal(out, out[out]):
            out = out[out]
        if np.array_equal(out, before):
            return out


def meet(table: pa.Table, cosine: float) -> pa.Table:
    """(rep, links, root) of the rows of a tile that have links there: how many vectors they are linked with, and a node of their tree."""
    native, at, lo, hi = (table.column(c).to_numpy() for c in ("native", "at", "lo", "hi"))
    if not len(at) or not native.any():
        return LINKS.empty_table()
    left = np.flatnonzero(native & (at == lo))
    right = np.concatenate([left, np.flatnonzero(~native)]) if lo[0] == hi[0] else np.flatnonzero(at == hi)
    v, weight, rep = matrix(table.column("v"), table.column("dim")[0].as_py()), table.column("weight").to_numpy(), table.column("rep").to_numpy()
    u = unit(v)
    s = u[left] @ u[right].T
    near = s >= cosine
    i, j = np.nonzero(np.abs(s - cosine) < CLOSE)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        near[a, b] = cosines(v[left[a]], v[right[b]]) >= cosine
    if lo[0] == hi[0]:
        near[:, : len(left)] &= np.arange(len(left))[None, :] > np.arange(len(left))[:, None]
    i, j = np.nonzero(near)
    if not len(i):
        return LINKS.empty_table()
    links = np.zeros(len(rep), "i8")
    np.add.at(links, left[i], weight[right[j]])
    np.add.at(links, right[j], weight[left[i]])
    root, some = roots(left[i], right[j], len(rep)), np.flatnonzero(links)
    return pa.table([rep[some], links[some], rep[root[some]]], schema=LINKS)


def linked(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", chunk: int = CHUNK, pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Vectors of one label, which is not null, and of one dimension are linked if their cosine in double precision is at least `cosine` (from 0 to 1). n_links counts the
    others linked directly, copies each by itself; component_id is the smallest id that can be reached, the vector's own included, and kept marks the vector that has
    it. Vectors that are null, empty, zero or hold null or non-finite components, or have no label, are linked with nothing and kept. Rows that share
    an id are one vector: the first usable by label and components. Each row without an id is kept, linked with nothing, and has no
    component. An empty table gives no rows; other columns are not read.
    """
    if not 0 <= cosine <= 1:
        raise ValueError("the cosine must be from 0 to 1")
    v = F.col(vector_col).cast("array<double>")
    fit = finite_components(v) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull()
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.when(fit, v).alias("v"))
    best = given.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct(F.col("v").isNull().alias("none"), "label", "v")).alias("r"))
    nodes = scratch.write(best.select("vec_id", "r.label", "r.v", F.xxhash64("r.v").alias("h")), "nodes")
    classes = nodes.filter("v IS NOT NULL").groupBy("label", "h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = scratch.write(classes, "classes")
    sample = [r.v for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()]
    alone = vectors.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if not sample:
        return nodes.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")).unionByName(alone)
    chosen = far_apart(sample, pivots or min(MANY, max(FEW, classes.count() // PER_PIVOT)))
    rows = scratch.write(placed(classes, chosen), "placed")
    low, high = rings(rows, len(chosen))
    all_ = scratch.write(copies(rows, low, high, chosen, math.sqrt(2 - 2 * cosine)), "copies")
    found = tiles(all_, chunk).groupBy("label", "dim", "cell", "lo", "hi").applyInArrow(lambda t: meet(t, cosine), "rep long, links long, root long")
    found = scratch.write(found, "links")
    reached = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch, "vectors")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links")).join(reached.select(F.col("node").alias("rep"), "component"), "rep")
    many = classes.filter("weight > 1").select("label", "h", "v", "rep", "weight")
    of = nodes.join(many, ["label", "h", "v"], "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    out = of.join(sums, "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")).unionByName(alone)


def op13_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "vectors"))


OP13_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reach(vec_id, node) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.node = l.a
), least AS (
  SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT l.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, l.component_id, l.vec_id = l.component_id AS kept FROM least l LEFT JOIN n ON n.vec_id = l.vec_id
"""
