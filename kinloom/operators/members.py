"""Clusters and their members: membership, sizes, lookups, subgenomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.pick import pick


def located(members: DataFrame, owners: DataFrame) -> DataFrame:
    """Members, as often as the source lists them, with the accession (gene_id, accession) of their gene; those of genes without one go."""
    return members.join(owners, "gene_id")


def genes(members: DataFrame, order: list[Column]) -> DataFrame:
    """One row a gene: its first cluster in the order of the source."""
    return pick(members, ["gene_id"], order)


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Members of each cluster as the source lists them, and without repetitions."""
    return members.groupBy("pangene").agg(F.count("*").alias("gene_count"), F.count_distinct("gene_id").alias("distinct_gene_count"))


def statistics(genes: DataFrame) -> DataFrame:
    return genes.agg(F.count_distinct("accession").alias("accessions"), F.count_distinct("pangene").alias("pan_genes"), F.count("*").alias("genes"))


def search(genes: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """Genes whose id equals the query, in any case; only if there is none, those that contain it. By id, the first `limit`."""
    q = query.lower()
    tier = F.when(F.lower("gene_id") == q, 0).when(F.contains(F.lower("gene_id"), F.lit(q)), 1)
    hits = genes.withColumn("tier", tier).filter("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best"), "left_semi").orderBy("gene_id").limit(limit)


def suggestions(genes: DataFrame, part: str, limit: int = 15) -> DataFrame:
    if len(part) < 3:
        return genes.limit(0)
    return genes.filter(F.contains(F.lower("gene_id"), F.lit(part.lower()))).orderBy("gene_id").limit(limit)


def with_size(genes: DataFrame, info: DataFrame) -> DataFrame:
    """Genes with the stored size of their cluster, counted where none is stored. The count is an aggregation and a join: a window
    would bring a large cluster to one task."""
    counted = genes.groupBy("pangene").agg(F.count("*").alias("counted"))
    return genes.join(info, "pangene", "left").join(counted, "pangene").withColumn("size", F.coalesce("gene_count", "counted")).drop("gene_count", "counted")


def with_places(genes: DataFrame, placed: DataFrame) -> DataFrame:
    """Members with the coordinates of their accession; null for members without coordinates, which stay."""
    return genes.join(placed, ["gene_id", "accession"], "left")


def subgenome_counts(placed: DataFrame) -> DataFrame:
    """Members of each cluster on A, B, D and elsewhere or without coordinates, and the subgenome with most, A before B before D; ? if all are 0."""
    sg = F.coalesce("subgenome", F.lit("?"))
    counts = placed.groupBy("pangene").agg(*[F.count_if(sg == s).alias(f"n_{s.lower()}") for s in "ABD"], F.count_if(~sg.isin("A", "B", "D")).alias("n_other"))
    top = F.greatest("n_a", "n_b", "n_d")
    dominant = F.when(top == 0, "?").when(F.col("n_a") == top, "A").when(F.col("n_b") == top, "B").otherwise("D")
    return counts.withColumn("dominant", dominant)


def triads(counts: DataFrame, family: str) -> DataFrame:
    """Families of clusters that are three, one for each subgenome."""
    return counts.groupBy(family).agg((F.array_sort(F.collect_list("dominant")) == F.array(*map(F.lit, "ABD"))).alias("triad"), F.count("*").alias("clusters")).withColumn("triad", F.col("triad") & (F.col("clusters") == 3))


def partitioned(placed: DataFrame, limit: int = 600) -> DataFrame:
    """Members of a cluster by subgenome (? for others and those without coordinates), in order of accession and id: the first `limit` of
    the cluster; which of those shown lack coordinates; how many there are and are shown, and whether there were more.

    Members are ranked within one cluster; what is aggregated is bounded by the limit.
    """
    order = Window.partitionBy("pangene").orderBy("accession", "gene_id")
    ranked = placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    sizes = placed.groupBy("pangene").agg(F.count("*").alias("total"))
    named = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene_id"))), lambda x: x["gene_id"]), "|").alias(c)
    bucket = F.when(F.upper("subgenome").isin("A", "B", "D"), F.upper("subgenome")).otherwise("?")
    missing = ranked.filter("chr IS NULL").groupBy("pangene").agg(F.array_join(F.array_sort(F.collect_set("gene_id")), "|").alias("missing"))
    kept = ranked.groupBy("pangene", bucket.alias("bucket")).agg(named("genes"), F.count("*").alias("n"))
    out = kept.join(sizes, "pangene").join(missing, "pangene", "left")
    return out.select("pangene", "bucket", "genes", "n", F.coalesce("missing", F.lit("")).alias("missing"), "total", F.least("total", F.lit(limit).cast("long")).alias("shown"), (F.col("total") > limit).alias("truncated"))


def accession_counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("accession").agg(F.count("*").alias("genes"), *[F.count_if(F.col("subgenome") == s).alias(f"genes_{s.lower()}") for s in "ABD"], F.count_if(F.col("subgenome").isNull()).alias("genes_unplaced"))


def focal(genes: DataFrame, query: str) -> DataFrame:
    """The gene of each cluster that a view starts from: an equal id, else one that contains the query, else the first."""
    q = query.lower()
    tier = F.when(F.lower("gene_id") == q, 0).when(F.contains(F.lower("gene_id"), F.lit(q)), 1).otherwise(2)
    return pick(genes, ["pangene"], [tier, F.col("gene_id"), F.col("accession")])


def first_with_coords(genes: DataFrame, coords: DataFrame) -> DataFrame:
    return genes.join(coords.select("gene_id").distinct(), "gene_id", "left_semi").groupBy("pangene").agg(F.min("gene_id").alias("gene_id"))


def reference_genes(genes: DataFrame, accession: str, strip: bool = False) -> DataFrame:
    """Distinct ids of one accession, whatever its case and, with strip, its punctuation."""
    name = F.lower("accession")
    name = F.regexp_replace(name, "[^a-z0-9]", "") if strip else name
    return genes.filter(name == accession).select("gene_id").distinct()


def restricted(genes: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked ids (pos, gene_id) that are in the cluster, in the order asked."""
    return asked.join(genes.select("gene_id", "accession").distinct(), "gene_id").orderBy("pos", "accession")


def route(query: Column) -> Column:
    """The species that an id's prefix tells; null for others."""
    return F.when(query.rlike(r"(?i)^HORVU\."), "barley").when(query.rlike("(?i)^TraesCS"), "wheat").when(query.rlike(r"(?i)^AVESA\."), "oat")


def gene_list(genes: DataFrame, coords: DataFrame) -> DataFrame:
    """Lines of a gene list: id, accession, chromosome, start, end."""
    joined = genes.join(coords, ["gene_id", "accession"], "left")
    return joined.select(F.concat_ws("\t", "gene_id", "accession", F.coalesce("chr", F.lit("")), F.coalesce(F.col("begin_pos").cast("string"), F.lit("")), F.coalesce(F.col("end_pos").cast("string"), F.lit(""))).alias("line"))


