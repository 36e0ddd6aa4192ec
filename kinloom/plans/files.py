"""Queries that write files in the engine's formats and read them again: what is read must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions.scratch import Workspace
from kinloom.functions.spread import spread
from kinloom.operators import graph, sinks
from kinloom.operators.pick import pick
from kinloom.plans.clusters import GENES, PLACED, genes, placed
from kinloom.plans.registry import query
from kinloom.sources import annotations, genomes


def path(i, name: str, df, write=sinks.lines, **more) -> str:
    where = Workspace(i.spark, "files").path(name)
    write(df, where, **more)
    return where


@query(f"WITH {PLACED} SELECT gene_id, chr, begin_pos, end_pos, strand, subgenome FROM placed", "coord")
def s02_s03_bed(i):
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chr"), F.col("begin_pos").cast("string"), F.col("end_pos").cast("string"), F.concat(F.lit("x|"), "gene_id"), F.lit("."), "strand")
    noise = i.spark.createDataFrame([("# comment",), ("",), ("1A\tx\ty\tg\t.\t+",), ("short\t1",)], "value string")
    return genomes.bed(i.spark, path(i, "a.bed", placed(i).select(line.alias("value")).union(noise))).select("gene_id", "chr", "begin_pos", "end_pos", "strand", "subgenome")


@query(f"WITH {PLACED} SELECT gene_id, chr, begin_pos - 1 AS begin_pos, end_pos, strand FROM placed", "coord")
def s30_gff_genes(i):
    line = F.concat_ws("\t", "chr", F.lit("x"), F.lit("gene"), F.col("begin_pos").cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("Name=n;ID=gene:"), "gene_id"))
    other = F.concat_ws("\t", "chr", F.lit("x"), F.lit("mRNA"), F.lit("1"), F.lit("2"), F.lit("."), "strand", F.lit("."), F.lit("ID=t"))
    rows = placed(i).select(line.alias("value")).union(placed(i).select(other.alias("value")))
    return genomes.gff(i.spark, path(i, "a.gff3", rows)).select("gene_id", "chr", "begin_pos", "end_pos", "strand")


@query("SELECT id AS name, regexp_replace(seq, '\\s', '', 'g') AS seq FROM (SELECT 'd' || CAST(id AS STRING) AS id, seq FROM doc) WHERE regexp_replace(seq, '\\s', '', 'g') <> ''", "doc")
def s04_k03_fasta(i):
    rows = i.doc.select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("gene_id"), F.regexp_replace("seq", r"\s", "").alias("seq")).filter("seq <> ''")
    where = Workspace(i.spark, "files").path("a.fa")
    sinks.fasta(rows, where)
    return genomes.fasta(i.spark, where).select("name", "seq")


@query("SELECT 'g' || CAST(p_partkey AS STRING) AS gene_id, replace(p_name, ' ', '')  AS seq FROM part WHERE p_size > 10")
def s05_resolved_headers(i):
    name = F.concat(F.lit("g"), F.col("p_partkey").cast("string"))
    rec = F.concat(F.lit(">t"), F.col("p_partkey").cast("string"), F.lit(" cds x|"), name, F.lit(" none\n"), F.replace("p_name", F.lit(" "), F.lit("\n")))
    known = i.part.filter("p_size > 10").select(name.alias("gene_id"))
    rows = i.part.select(rec.alias("value"))
    return genomes.resolved(genomes.fasta(i.spark, path(i, "h.fa", rows)), known).select("gene_id", "seq")


@query(f"WITH {GENES} SELECT pangene, gene_id FROM genes", "member")
def s08_long_clusters(i):
    return genomes.cluster_members(i.spark, path(i, "a.hsh.tsv", genes(i).select(F.concat_ws("\t", "pangene", "gene_id").alias("value")))).select("pangene", "gene_id")


@query(f"WITH {GENES} SELECT pangene, gene_id FROM genes", "member")
def s08_k06_wide_clusters(i):
    wide = graph.wide(genes(i).select(F.col("gene_id").alias("node"), F.col("pangene").alias("cluster"))).select(F.col("line").alias("value"))
    return genomes.cluster_members(i.spark, path(i, "a.clust.tsv", wide), "wide").select("pangene", "gene_id")


@query("SELECT * FROM edge", "edge")
def s22_edges(i):
    line = F.when(F.length("a") % 2 == 0, F.concat_ws("\t", "a", "b", F.lit("0.9"))).otherwise(F.concat_ws("  ", "a", "b"))
    noise = i.spark.createDataFrame([("#x\ty",), ("same\tsame",), ("alone",)], "value string")
    return annotations.edges(i.spark, path(i, "a.RBH", i.edge.select(line.alias("value")).union(noise))).select("a", "b")


@query("SELECT a, b FROM edge", "edge")
def s24_collinear_pairs(i):
    per = i.edge.withColumn("k", F.col("b")).groupBy("k").agg(F.array_join(F.collect_list(F.concat_ws(",", "a", "b")), ";").alias("pairs"))
    return annotations.collinear_pairs(i.spark, path(i, "c.info", per.select(F.concat_ws("\t", "k", "k", "k", "k", "k", "pairs").alias("value"))))


@query("SELECT 'g' || CAST(p_partkey AS STRING) AS gene_id, CASE WHEN p_size > 10 THEN p_name ELSE '' END AS q3, CASE WHEN p_size < 40 THEN p_brand ELSE '' END AS q8 FROM part")
def s10_structures(i):
    name = F.concat(F.lit("g"), F.col("p_partkey").cast("string"))
    work = Workspace(i.spark, "files")
    i.part.filter("p_size > 10").select(name.alias("id"), F.col("p_name").alias("q3_decoded")).write.csv(work.path("q3.csv"), header=True)
    i.part.filter("p_size < 40").select(name.alias("id"), F.col("p_brand").alias("q8_decoded")).write.csv(work.path("q8.csv"), header=True)
    return genomes.structures(i.spark, work.path("q3.csv"), work.path("q8.csv"))


@query("""SELECT gene_id, species, ref_id, evalue, pident FROM (SELECT 'g' || CAST(p_partkey AS STRING) AS gene_id, 'arabidopsis' AS species, p_name AS ref_id, p_retailprice AS evalue, CAST(NULL AS DOUBLE) AS pident FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'g' || CAST(p_partkey AS STRING), 'rice', p_brand, NULL, p_size::DOUBLE FROM part WHERE p_size % 3 = 0)""")
def s15_best_hit_files(i):
    rows = i.part.select(
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("NA").alias("arabidopsis"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(".").alias("rice"),
        F.col("p_retailprice").cast("string").alias("arabidopsis_evalue"), F.col("p_size").cast("string").alias("rice_pident"),
    )
    return annotations.best_hits(i.spark, path(i, "acc.tsv", rows, sinks.tsv)).select("gene_id", "species", "ref_id", "evalue", "pident")


@query("SELECT cluster, genome, cell FROM (SELECT 'c' || CAST(o_orderkey AS STRING) AS cluster, unnest(['x', 'y']) AS genome, unnest([o_orderstatus || ', ' || o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END]) AS cell FROM orders) WHERE cell IS NOT NULL")
def s29_orthogroup_table(i):
    o = i.orders.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("HOG"), F.lit("o").alias("OG"), F.lit("n").alias("Gene Tree Parent Clade"), F.concat_ws(", ", "o_orderstatus", "o_orderpriority").alias("x.primary.protein"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("y"))
    return annotations.orthogroup_cells(i.spark, path(i, "N0.tsv", o, sinks.tsv))


@query("SELECT species, n FROM (SELECT 'n' || CAST(s_nationkey + 12 AS STRING) AS species, count(*)::BIGINT AS n FROM supplier GROUP BY 1) UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), count(*) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey + 12 FROM supplier) GROUP BY 1")
def k05_u08_merged_statistics(i):
    """Half of the new species are among the old."""
    name = lambda c: F.concat(F.lit("n"), c.cast("string")).alias("species")
    old = i.customer.groupBy(name(F.col("c_nationkey"))).agg(F.count("*").alias("n"))
    return sinks.merged_statistics(old, i.supplier.groupBy(name(F.col("s_nationkey") + 12)).agg(F.count("*").alias("n")))


@query("SELECT gene_id, accession, species FROM (SELECT gene_id, accession, species, row_number() OVER (PARTITION BY gene_id ORDER BY accession, species, ref_id) AS k FROM hit) WHERE k = 1", "hit")
def k01_table_round_trip(i):
    one = pick(i.hit, ["gene_id"], [F.col("accession"), F.col("species"), F.col("ref_id")]).select("gene_id", "accession", "species")
    where = path(i, "t", one, sinks.table, by=("species",), order=("gene_id",))
    return i.spark.read.parquet(where).select("gene_id", "accession", F.col("species").cast("string").alias("species"))


@query("SELECT count(*)::BIGINT AS records, least(100, count(*))::BIGINT AS largest, true AS plain FROM part")
def k08_chunked_records(i):
    """Records of all files, those of the largest chunk, and whether no star is left."""
    where = Workspace(i.spark, "files").path("chunks")
    rows = i.part.select(F.col("p_partkey").cast("string").alias("n"), F.concat("p_name", F.lit("*")).alias("s"))
    sinks.chunked_fasta(spread(rows), where, "n", "s", 100)
    records = genomes.fasta(i.spark, where).withColumn("chunk", F.col("src.file"))
    per = records.groupBy("chunk").agg(F.count("*").alias("n"), F.count_if(F.contains("seq", F.lit("*"))).alias("stars"))
    return per.agg(F.sum("n").alias("records"), F.max("n").alias("largest"), (F.sum("stars") == 0).alias("plain"))
