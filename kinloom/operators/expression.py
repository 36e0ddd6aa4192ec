"""Expression of genes by tissue, and differential expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import numbers
from kinloom.operators.pick import pick


def matrix_rows(wide: DataFrame, gene: str, samples: list[str]) -> DataFrame:
    """(gene, sample, value) of a wide matrix; samples that the matrix lacks are an error."""
    missing = [s for s in samples if s not in wide.columns]
    if missing:
        raise ValueError(f"samples without a column: {', '.join(missing)}")
    return wide.unpivot([gene], samples, "sample_acc", "value")


def arrays(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """(gene, values): one array a gene in order of the samples' index; null where a sample has no value."""
    indexed = rows.join(samples.select("sample_acc", "sample_idx"), "sample_acc")
    pairs = F.array_sort(F.collect_list(F.struct("sample_idx", "value")))
    return indexed.groupBy("gene").agg(F.transform(pairs, lambda x: x["value"]).alias("values"))


def stored_arrays(values: DataFrame) -> DataFrame:
    """(gene, codes): arrays as they are stored, whole numbers in tenths, with a number of their own for what is missing."""
    return values.select("gene", F.transform("values", numbers.encoded).alias("codes"))


def read_arrays(stored: DataFrame, samples: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(gene, sample_idx, value, ... of samples): the stored values of a gene with the samples of their positions; keys are further columns of both."""
    one = stored.select(*keys, "gene", F.posexplode(F.transform("codes", numbers.decoded)).alias("sample_idx", "value"))
    return one.join(samples, [*keys, "sample_idx"])


def by_position(values: DataFrame, samples: DataFrame) -> DataFrame:
    """Each value of an array with the sample of its position."""
    return values.select("gene", F.posexplode("values").alias("sample_idx", "value")).join(samples, "sample_idx")


def tissue_stats(rows: DataFrame) -> DataFrame:
    """n, mean and sample deviation (0 for one sample) of each gene, experiment and group, with the organ and genome of the group's
    first sample. Samples without a value do not count; a group without any value has no row."""
    s = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    first = F.min(F.struct("sample_idx", "organ", "genome"))
    per = rows.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("gene", "experiment", "grp").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(s, 6).alias("sd"), first.alias("f"))
    return per.select("gene", "f.organ", "f.genome", "experiment", "grp", "n", "mean", "sd", F.col("f.sample_idx").alias("first_sample"))


def summary(genes: DataFrame, stats: DataFrame) -> DataFrame:
    """Of each gene asked: experiments, samples and organs with values, and whether there is something to show."""
    per = stats.groupBy("gene").agg(F.count_distinct("experiment").alias("experiments"), F.sum("n").alias("samples"), F.count_distinct("organ").alias("organs"))
    none = F.lit(0).cast("long")
    out = genes.join(per, "gene", "left").select("gene", *[F.coalesce(c, none).alias(c) for c in ("experiments", "samples", "organs")])
    return out.withColumn("status", F.when(F.col("samples") > 0, "ok").otherwise("no_data"))


def organ_means(stats: DataFrame) -> DataFrame:
    """Mean of the groups' means by organ, and the organs' order of first appearance."""
    return stats.groupBy("gene", "organ").agg(F.avg("mean").alias("mean"), F.min("first_sample").alias("first_sample"))


def normalised_groups(stats: DataFrame) -> DataFrame:
    """Rows for a plot: organs with one group only by organ (compact), others by group."""
    n = stats.groupBy("gene", "organ").agg(F.count_distinct("experiment", "grp").alias("groups"))
    both = stats.join(n, ["gene", "organ"])
    compact = both.filter("groups = 1").select("gene", F.col("organ").alias("label"), "mean", "n")
    grouped = both.filter("groups > 1").select("gene", F.concat_ws(" / ", "organ", "experiment", "grp").alias("label"), "mean", "n")
    return compact.unionByName(grouped)


def owner(datasets: DataFrame, samples: DataFrame, genes: DataFrame, genome: str) -> DataFrame:
    """The data set that answers for each gene: one of the genome, else one with a sample of it, else the first by id."""
    has = genes.join(datasets, "dataset_id").join(samples.filter(F.col("genome") == genome).select("dataset_id").distinct().withColumn("sampled", F.lit(True)), "dataset_id", "left")
    tier = F.when(F.col("genome") == genome, 0).when(F.col("sampled"), 1).otherwise(2)
    return pick(has.select("gene", "dataset_id", tier.alias("tier")), ["gene"], [F.col("tier"), F.col("dataset_id")])


def majority_genome(samples: DataFrame) -> DataFrame:
    """The genome of most samples of each data set; of equals the one seen first."""
    n = samples.groupBy("dataset_id", "genome").agg(F.count("*").alias("n"), F.min("sample_idx").alias("first"))
    return pick(n, ["dataset_id"], [-F.col("n"), F.col("first")]).select("dataset_id", "genome", "n")


def experiment_titles(rows: DataFrame) -> DataFrame:
    """One row an experiment: the first with a title, else the first."""
    blank = (F.coalesce("short_title", F.lit("")) == "") & (F.coalesce("title", F.lit("")) == "")
    return pick(rows, ["experiment"], [blank, F.col("line")])


def differential(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Records with their experiment's title (its id without) and the experiment's index in order of first appearance."""
    first = rows.groupBy("gene", "experiment").agg(F.min("line").alias("first"))
    index = first.withColumn("experiment_index", F.row_number().over(Window.partitionBy("gene").orderBy("first")) - 1).drop("first")
    out = rows.join(index, ["gene", "experiment"]).join(titles.select("experiment", "title"), "experiment", "left")
    return out.withColumn("title", F.coalesce("title", "experiment"))


def categories_without(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Categories of the data set that a gene has no record of."""
    all_of = every.select("category").distinct().agg(F.array_sort(F.collect_set("category")).alias("every"))
    has = rows.groupBy("gene").agg(F.collect_set("category").alias("has"))
    return has.crossJoin(F.broadcast(all_of)).select("gene", F.array_join(F.array_except("every", "has"), "|").alias("without"))


def value_range(rows: DataFrame, pad: float = 0.1) -> DataFrame:
    """The range of an axis: least and greatest value and 0, widened by a share of their distance."""
    low, high = F.least(F.min("value"), F.lit(0.0)), F.greatest(F.max("value"), F.lit(0.0))
    return rows.groupBy("gene").agg(F.round(low - pad * (high - low), 6).alias("low"), F.round(high + pad * (high - low), 6).alias("high"))


def first_with_data(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each target's candidates (target, gene, pos) the first that has data, else the first."""
    have = rows.select("gene").distinct().withColumn("has", F.lit(True))
    marked = candidates.join(have, "gene", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return pick(marked, ["target"], [~F.col("has"), F.col("pos")]).select("target", "gene", "has")
