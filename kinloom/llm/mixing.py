"""Mixing sources to target weights: every document floor(rate) times, and once more with the rate's fraction as probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents

#: A source's target, and so a document's copies, stop at so many times what there is.
MAX_RATE = 3
#: Weights that sources get in code-point order, again and again.
WEIGHTS = (1, 2, 3)
SEED = "mix"


def size_of(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    The targets share the sum of all sizes by weight; none is above max_rate times its source's size, and what is cut
    off goes to the others by weight until none is above. That level is found in one pass: in order of size / weight a
    source is capped as long as its cap is no more than its share of what the sources before it leave. Only
    sums of sources are windowed here, never documents.
    """
    d = "decimal(38,0)"
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_rate).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(every),
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    per = per.withColumn("capped", F.col("cap").cast(d) * F.col("left").cast("decimal(18,0)") <= (F.col("total") - F.col("before")).cast(d) * F.col("weight").cast("decimal(18,0)"))
    cut = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    per = per.withColumns({"rest": (F.col("total") - cut).cast("double"), "open": open_weight})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest") * F.col("weight") / F.col("open"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text alone, so that reruns and lost tasks agree."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(row, size, source_size, target, rate, copies): row is the whole row of docs as a struct, so no name can clash.

    The sums of the sources are written once; read again, their size is known, so that Spark broadcasts them only if
    they are below its threshold and otherwise shuffles both sides, splitting a hot source. A null text has size 0, a
    null source is a source of its own, the last. Rows that repeat get the same decision. An empty table gives no rows.
    """
    sources = scratch.write(source_targets(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), weights, max_rate), "sources")
    sources = sources.select(F.col("source").alias("of"), "source_size", "target")
    base = docs.select(F.struct("*").alias("row"), size_of(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), draw(seed, F.col(id_col), F.col(text_col)).alias("draw"))
    joined = base.join(sources, base["source"].eqNullSafe(sources["of"]))
    joined = joined.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    extra = F.col("draw") < F.col("rate") - F.floor("rate")
    return joined.select("row", "size", "source_size", "target", "rate", (F.floor("rate") + extra.cast("long")).alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as copies() says, with the columns of docs alone."""
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    mixed = copies(docs, Scratch(spark, "mixing"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s
), c AS (
  SELECT *, cap * open <= (total - before) * weight AS capped FROM o
), l AS (
  SELECT *, (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE AS rest, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS left_weight FROM c
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE rest * weight / left_weight END AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
