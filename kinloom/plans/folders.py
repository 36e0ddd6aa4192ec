"""Queries on what is read from folders of files, which are written from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom import homology, predictions
from kinloom.functions import snapshot
from kinloom.functions.scratch import Workspace
from kinloom.operators import graph, sinks
from kinloom.plans.files import path
from kinloom.plans.registry import query
from kinloom.sources import annotations, genomes

PACKED = "packed AS (SELECT DISTINCT split_part(gene_id, '.', 1) AS grp, chr || '__' || gene_id || '__' || CAST(begin_pos AS STRING) || '__' || CAST(end_pos AS STRING) || '__' || strand AS member, chr, gene_id, CAST(begin_pos AS STRING) AS begin_pos, CAST(end_pos AS STRING) AS end_pos FROM coord), allowed AS (SELECT * FROM (VALUES ('chr1A', 'chr1B'), ('chr1B', 'chr1A'), ('chr2A', 'chr2A'), ('chr3D', 'chr4A'), ('chr4A', 'chr3D')) t(chr_a, chr_b))"


@query(f"WITH {PACKED} SELECT DISTINCT x.chr AS chr1, x.gene_id AS gene_id1, x.begin_pos AS begin_pos1, x.end_pos AS end_pos1, y.chr AS chr2, y.gene_id AS gene_id2, y.begin_pos AS begin_pos2, y.end_pos AS end_pos2 FROM packed x JOIN packed y ON x.grp = y.grp AND x.member < y.member JOIN allowed ON chr_a = x.chr AND chr_b = y.chr", "coord")
def s28_j22_matches_of_files(i):
    name = F.concat_ws("__", "chr", "gene_id", F.col("begin_pos").cast("string"), F.col("end_pos").cast("string"), "strand")
    rows = i.coord.select(F.substring_index("gene_id", ".", 1).alias("grp"), name.alias("member"))
    # a cluster's lines are in one file, as the programs write them
    rep = rows.groupBy("grp").agg(F.min("member").alias("rep"), F.collect_set("member").alias("m")).select(F.explode(F.transform("m", lambda m: F.concat_ws("\t", "rep", m))).alias("value"))
    members = homology.packed_members(i.spark, [path(i, "clusters", rep)])
    allowed = graph.symmetric(i.spark.createDataFrame([("1a", "1b"), ("2a", "2a"), ("3d", "4a")], "chr_a string, chr_b string"), "chr_a", "chr_b")
    return homology.matched(members, allowed).select(*homology.COLUMNS).distinct()


@query("WITH s AS (SELECT 'P' || CAST(p_partkey AS STRING) AS id, upper(replace(p_brand || p_type, ' ', '')) AS seq FROM part) SELECT id, CASE WHEN length(seq) % 3 <> 0 THEN reverse(seq) END AS q3_decoded FROM s")
def d02_s37_d03_predictions_of_files(i):
    work = Workspace(i.spark, "predictions")
    rows = i.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene_id"), F.lower(F.concat("p_brand", "p_type")).alias("seq"))
    mapping = predictions.unique_sequences(i.spark, [path(i, "a.fa", rows, sinks.fasta)], work.path("unique"))
    distinct = snapshot.read(i.spark, work.path("unique"), "sequences")
    made = distinct.filter(F.length("seq") % 3 != 0).select(F.col("uniq_id").alias("id"), F.reverse("seq").alias("q3"), F.lit("C").alias("q8"))
    made.write.csv(work.path("predicted"), header=True)
    predictions.recombined(i.spark, mapping, predictions.predictions(i.spark, work.path("predicted"), "*.csv"), work.path("back"))
    return snapshot.read(i.spark, work.path("back"), "structures").select("id", "q3_decoded")


@query("SELECT DISTINCT 'g' || CAST(l_partkey AS STRING) AS gene_id FROM lineitem")
def s23_gene_universe(i):
    line = F.concat_ws("\t", F.lit("1A"), F.lit("1"), F.col("l_linenumber").cast("string"), F.concat(F.lit(" g"), F.col("l_partkey").cast("string")))
    return genomes.gene_universe(i.spark, path(i, "a.bed", i.lineitem.select(line.alias("value"))))


@query("SELECT lower(n_name) AS species, n_regionkey AS accessions, n_nationkey AS pan_genes, CAST(length(n_name) AS BIGINT) AS genes FROM (SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation) WHERE n_nationkey % 7 <> 0")
def s33_statistics_files(i):
    number = F.when(F.col("n_nationkey") % 7 == 0, "x").otherwise(F.col("n_nationkey").cast("string"))
    rows = i.nation.select(F.col("n_name").alias("Species"), F.col("n_regionkey").alias("accessions"), number.alias("pan_genes"), F.length("n_name").alias("genes"))
    return annotations.statistics(i.spark, path(i, "stats.tsv", rows, sinks.tsv)).select("species", "accessions", "pan_genes", "genes")
