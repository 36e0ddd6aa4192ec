"""Queries on expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import numbers
from kinloom.operators import expression
from kinloom.plans.registry import query

STATS = "stats AS (SELECT gene, arg_min(organ, sample_idx) AS organ, arg_min(genome, sample_idx) AS genome, experiment, grp, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(sample_idx) AS first_sample FROM expr WHERE value IS NOT NULL GROUP BY gene, experiment, grp)"


def stats(i):
    return expression.tissue_stats(i.expr)


@query(f"WITH {STATS} SELECT * FROM stats", "expr")
def a11_e02_tissue_stats(i):
    return stats(i)


@query(f"WITH {STATS} SELECT gene, organ, round(avg(mean) + 1.2345e-9, 5) AS mean, min(first_sample) AS first_sample FROM stats GROUP BY 1, 2", "expr")
def a17_organ_means(i):
    return expression.organ_means(stats(i)).withColumn("mean", F.round(F.col("mean") + 1.2345e-9, 5))


@query(f"WITH {STATS}, n AS (SELECT gene, organ, count(DISTINCT experiment || grp) AS g FROM stats GROUP BY 1, 2) SELECT s.gene, CASE WHEN g = 1 THEN s.organ ELSE s.organ || ' / ' || experiment || ' / ' || grp END AS label, mean, s.n FROM stats s JOIN n ON s.gene = n.gene AND s.organ = n.organ", "expr")
def e06_compact_or_grouped(i):
    return expression.normalised_groups(stats(i))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 65535 ELSE CAST(least(65534, greatest(0, round_even(value * 10, 0))) AS INT) END AS code, CASE WHEN value IS NOT NULL THEN CAST(least(65534, greatest(0, round_even(value * 10, 0))) AS INT) / 10 END AS back FROM events")
def p26_stored_values(i):
    return i.events.select("event_id", numbers.encoded(F.col("value")).alias("code")).withColumn("back", numbers.decoded(F.col("code")))


OWNER = """sets(dataset_id, genome) AS (VALUES ('ds0', 'genome1'), ('ds1', 'genome2'), ('ds2', 'other')), smp AS (SELECT DISTINCT dataset_id FROM expr WHERE genome = 'genome2' AND dataset_id = 'ds2'),
c AS (SELECT DISTINCT e.gene, e.dataset_id, CASE WHEN s.genome = 'genome2' THEN 0 WHEN e.dataset_id IN (SELECT dataset_id FROM smp) THEN 1 ELSE 2 END AS tier FROM expr e JOIN sets s ON e.dataset_id = s.dataset_id)"""


@query(f"WITH {OWNER}, r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY tier, dataset_id) AS k FROM c) SELECT gene, dataset_id, tier FROM r WHERE k = 1", "expr")
def j13_e01_owning_data_set(i):
    sets = i.spark.createDataFrame([("ds0", "genome1"), ("ds1", "genome2"), ("ds2", "other")], "dataset_id string, genome string")
    smp = i.expr.filter("dataset_id = 'ds2'").select("dataset_id", "genome").distinct()
    return expression.owner(sets, smp, i.expr.select("gene", "dataset_id").distinct(), "genome2").select("gene", "dataset_id", "tier")


@query("WITH n AS (SELECT dataset_id, genome, count(*)::BIGINT AS n, min(sample_idx) AS first FROM expr GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, first) AS k FROM n) SELECT dataset_id, genome, n FROM r WHERE k = 1", "expr")
def s21_majority_genome(i):
    return expression.majority_genome(i.expr)


TITLES = "rows AS (SELECT gene, experiment, organ AS category, value, sample_idx AS line, CASE WHEN sample_idx % 7 = 0 THEN '' ELSE 't ' || grp END AS short_title, '' AS title FROM expr), titles AS (SELECT experiment, short_title AS title FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY short_title = '', line) AS k FROM rows) WHERE k = 1 AND experiment <> 'e4')"


def records(i):
    short = F.when(F.col("sample_idx") % 7 == 0, "").otherwise(F.concat(F.lit("t "), "grp"))
    return i.expr.select("gene", "experiment", F.col("organ").alias("category"), "value", F.col("sample_idx").alias("line"), short.alias("short_title"), F.lit("").alias("title"))


@query(f"WITH {TITLES} SELECT * FROM titles", "expr")
def a18_experiment_titles(i):
    return expression.experiment_titles(records(i)).filter("experiment <> 'e4'").select("experiment", F.col("short_title").alias("title"))


@query(f"""WITH {TITLES}, f AS (SELECT gene, experiment, min(line) AS first FROM rows GROUP BY 1, 2), x AS (SELECT gene, experiment, CAST(row_number() OVER (PARTITION BY gene ORDER BY first) - 1 AS INT) AS experiment_index FROM f)
SELECT r.gene, r.experiment, r.line, x.experiment_index, coalesce(t.title, r.experiment) AS title FROM rows r JOIN x ON r.gene = x.gene AND r.experiment = x.experiment LEFT JOIN titles t ON t.experiment = r.experiment""", "expr")
def j29_w08_e03_differential(i):
    rows = records(i)
    titles = expression.experiment_titles(rows).filter("experiment <> 'e4'").select("experiment", F.col("short_title").alias("title"))
    return expression.differential(rows.drop("title", "short_title"), titles).select("gene", "experiment", "line", "experiment_index", "title")


@query(f"WITH {TITLES}, every AS (SELECT DISTINCT category FROM rows), g AS (SELECT DISTINCT gene FROM rows), m AS (SELECT gene, category FROM g, every EXCEPT SELECT gene, category FROM rows) SELECT g.gene, coalesce(string_agg(m.category, '|' ORDER BY m.category), '') AS without FROM g LEFT JOIN m ON g.gene = m.gene GROUP BY g.gene", "expr")
def a15_u04_categories_without(i):
    return expression.categories_without(records(i), records(i))


@query(f"WITH {TITLES}, r AS (SELECT gene, least(min(value), 0.0) AS low, greatest(max(value), 0.0) AS high FROM rows GROUP BY 1) SELECT gene, round(low - 0.1 * (high - low), 6) AS low, round(high + 0.1 * (high - low), 6) AS high FROM r", "expr")
def e07_axis_range(i):
    return expression.value_range(records(i))


@query("WITH c AS (SELECT DISTINCT user_id % 10 AS target, 'g' || CAST(user_id * 3 AS STRING) AS gene, user_id AS pos FROM events), h AS (SELECT DISTINCT gene FROM expr), r AS (SELECT c.*, h.gene IS NOT NULL AS has, row_number() OVER (PARTITION BY target ORDER BY h.gene IS NULL, pos) AS k FROM c LEFT JOIN h ON c.gene = h.gene) SELECT target, gene, has FROM r WHERE k = 1", "expr")
def e05_first_gene_with_data(i):
    c = i.events.select((F.col("user_id") % 10).alias("target"), F.concat(F.lit("g"), (F.col("user_id") * 3).cast("string")).alias("gene"), F.col("user_id").alias("pos")).distinct()
    return expression.first_with_data(c, i.expr)


WIDE = "wide AS (SELECT 'g' || CAST(user_id AS STRING) AS gene, sum(value) FILTER (event_id % 3 = 0) AS s0, sum(value) FILTER (event_id % 3 = 1) AS s1, sum(value) FILTER (event_id % 3 = 2) AS s2 FROM events GROUP BY 1)"


def matrix(i):
    e = i.events.select(F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("gene"), "event_id", "value")
    wide = e.groupBy("gene").agg(*[F.sum(F.when(F.col("event_id") % 3 == k, F.col("value"))).alias(f"s{k}") for k in range(3)])
    samples = i.spark.createDataFrame([("s0", 2, "root"), ("s1", 0, "leaf"), ("s2", 1, "seed")], "sample_acc string, sample_idx int, organ string")
    return wide, samples


@query(f"WITH {WIDE} SELECT gene, sample_acc, round(value, 6) AS value FROM (SELECT gene, 's0' AS sample_acc, s0 AS value FROM wide UNION ALL SELECT gene, 's1', s1 FROM wide UNION ALL SELECT gene, 's2', s2 FROM wide)")
def s18_matrix_rows(i):
    return expression.matrix_rows(matrix(i)[0], "gene", ["s0", "s1", "s2"]).withColumn("value", F.round("value", 6))


@query(f"WITH {WIDE} SELECT gene, organ, sample_idx, round(value, 6) AS value FROM (SELECT gene, 'leaf' AS organ, 0 AS sample_idx, s1 AS value FROM wide UNION ALL SELECT gene, 'seed', 1, s2 FROM wide UNION ALL SELECT gene, 'root', 2, s0 FROM wide)")
def j28_values_by_position(i):
    wide, samples = matrix(i)
    values = expression.arrays(expression.matrix_rows(wide, "gene", ["s0", "s1", "s2"]), samples)
    return expression.by_position(values, samples).select("gene", "organ", "sample_idx", F.round("value", 6).alias("value"))
