"""From folders of accession pairs to clusters: best-hit edges, where they are collinear, and their components.

An analysis has accessions/<name>/<name>.bed and, for each pair of accessions, a folder pairs/<pair> with edges (*.RBH) and what tells collinearity. All pairs are read
in one scan a kind of file; the folder of a line is its pair, so the rules that hold for each pair are joins and groupings by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import ids, snapshot
from kinloom.functions.scratch import Workspace, listed
from kinloom.functions.snapshot import Snapshot
from kinloom.operators import coords, graph, sinks
from kinloom.operators.pick import pick
from kinloom.sources import annotations
from kinloom.sources.lines import content, fields, lines, whitespace_fields

#: Suffixes of a pair's files. Fixed values.
EDGES, INFO, ANCHORS, BLOCKS = ".RBH", (".collinearity_info", ".colinearity_info"), ".anchors", ".block_pos"
#: What a pair's collinearity comes from, in order of preference.
SOURCES = ("info", "anchors", "blocks")


def pair_files(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Files of all pairs by kind: all edges, the first info file and the first anchors of each pair, all blocks. Without edges it is an error."""
    out: dict[str, list[str]] = {"edges": [], "info": [], "anchors": [], "blocks": []}
    for _, folder, is_folder in listed(spark, root):
        if is_folder:
            inside = listed(spark, folder)
            named = lambda suffix: [p for n, p, d in inside if not d and n.endswith(suffix)]  # noqa: B023, E731
            edges = named(EDGES)
            if edges:
                out["edges"] += edges
                out["info"] += [p for s in INFO for p in named(s)][:1]
                out["anchors"] += [p for _, sub, d in inside if d for n, p, deep in listed(spark, sub) if not deep and n.endswith(ANCHORS)][:1]
                out["blocks"] += named(BLOCKS)
    if not out["edges"]:
        raise ValueError(f"no {EDGES} files in the folders of {root}")
    return out


def pair_of(path: Column) -> Column:
    """The folder of a pair, from the path of one of its files; anchors are in a folder inside it."""
    return F.when(F.endswith(path, F.lit(ANCHORS)), F.regexp_extract(path, "([^/]*)/[^/]*/[^/]*$", 1)).otherwise(F.regexp_extract(path, "([^/]*)/[^/]*$", 1))


def chromosome_key(c: Column) -> Column:
    """The group and letter of a chromosome, 1A for chr1a; null for other names."""
    return F.concat(ids.chromosome_group(F.trim(c)), F.upper(F.right(F.trim(c), F.lit(1))))


def gene_beds(spark: SparkSession, root: str) -> list[str]:
    return [p for name, folder, is_folder in listed(spark, root) if is_folder for n, p, d in listed(spark, folder) if not d and n == f"{name}.bed"]


def loci(spark: SparkSession, root: str) -> DataFrame:
    """(gene_id, accession, chr, begin_pos, end_pos) of genes on chromosomes with a group. A gene on two groups or accessions is an error, and so is none at all."""
    beds = gene_beds(spark, root)
    if not beds:
        raise ValueError(f"no accessions in {root}")
    f = F.col("f")
    rows = content(lines(spark, beds)).select(fields(F.col("line")).alias("f"), "src").filter(F.size("f") >= 4)
    begin = F.coalesce(F.trim(f[1]).try_cast("long"), F.lit(0).cast("long"))
    rows = rows.select(F.trim(f[3]).alias("gene_id"), pair_of(F.col("src.file")).alias("accession"), chromosome_key(f[0]).alias("chr"), begin.alias("begin_pos"), F.coalesce(F.trim(f[2]).try_cast("long"), begin).alias("end_pos"))
    rows = rows.filter("gene_id <> '' AND chr IS NOT NULL")
    out = pick(rows, ["gene_id"], [F.col("begin_pos"), F.col("end_pos"), F.col("chr"), F.col("accession")], last=True)
    twice = graph.inconsistent_loci(rows).select("gene_id").first()
    if twice:
        raise ValueError(f"gene {twice.gene_id} is on two groups of chromosomes or in two accessions")
    if out.isEmpty():
        raise ValueError(f"no gene of {root} is on a chromosome with a group")
    return out


def block_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pair, chr1, s1, e1, chr2, s2, e2): lines of six fields with chromosomes of a group and whole numbers; others go."""
    f = F.col("f")
    rows = content(lines(spark, paths)).select(whitespace_fields(F.col("line")).alias("f"), "src").filter(F.size("f") >= 6)
    number = lambda i: F.trim(f[i]).try_cast("long")
    out = rows.select(pair_of(F.col("src.file")).alias("pair"), chromosome_key(f[0]).alias("chr1"), number(1).alias("s1"), number(2).alias("e1"), chromosome_key(f[3]).alias("chr2"), number(4).alias("s2"), number(5).alias("e2"))
    return out.dropna()


def collinear_edges(spark: SparkSession, root: str, places: DataFrame, work: Workspace) -> DataFrame:
    """(pair, a, b, kind, source, collinear) of each edge of each pair with its kind (missing, cross, exact, homeologue).

    Collinearity of a pair comes from its info file if there is one; else from its anchors if any of them is an edge on one group; else from its blocks. A pair with none of these is an error.
    """
    files = pair_files(spark, root)
    edges = annotations.edges(spark, files["edges"]).select(pair_of(F.col("src.file")).alias("pair"), "a", "b")
    kinds = work.write(graph.classified(graph.with_loci(edges, places)), "edges")
    near = kinds.filter("kind IN ('exact', 'homeologue')")
    keys = near.select("pair", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    none = spark.createDataFrame([], "pair string, p string, q string")
    key = lambda df: df.filter("a <> '' AND b <> '' AND a <> b").select("pair", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    has_info = spark.createDataFrame([(p.rsplit("/", 2)[1],) for p in files["info"]], "pair string")
    info = key(_pairs_of_info(spark, files["info"])).join(keys, ["pair", "p", "q"]) if files["info"] else none
    told = key(annotations.edges(spark, files["anchors"]).select(pair_of(F.col("src.file")).alias("pair"), "a", "b")).join(keys, ["pair", "p", "q"]) if files["anchors"] else none
    told = work.write(told.join(has_info, "pair", "left_anti"), "anchors")
    has_anchors = told.select("pair").distinct()
    blocks = block_rows(spark, files["blocks"]) if files["blocks"] else spark.createDataFrame([], "pair string, chr1 string, s1 long, e1 long, chr2 string, s2 long, e2 long")
    blocks = blocks.join(has_info, "pair", "left_anti").join(has_anchors, "pair", "left_anti")
    # a pair's blocks concern its own edges only: its name becomes part of the chromosome
    within = lambda df: df.withColumn("chr1", F.concat_ws("|", "pair", "chr1"))
    wide = coords.mirrored_blocks(blocks.withColumns({"chr1": F.concat_ws("|", "pair", "chr1"), "chr2": F.concat_ws("|", "pair", "chr2")}))
    wide = work.write(wide.withColumn("chr2", F.regexp_replace("chr2", r"^.*\|", "")), "blocks")
    in_blocks = coords.in_blocks(within(near), wide).select("pair", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "a", "b").distinct()
    source = F.lit(None).cast("string")
    for name, df in zip(SOURCES, (has_info, has_anchors, wide.select(F.regexp_extract("chr1", r"^(.*)\|", 1).alias("pair")).distinct()), strict=True):
        kinds = kinds.join(df.select("pair", F.lit(True).alias(f"has_{name}")), "pair", "left")
        source = F.coalesce(source, F.when(F.col(f"has_{name}"), F.lit(name)))
    kinds = kinds.withColumn("source", source)
    bare = kinds.filter("source IS NULL").select("pair").first()
    if bare:
        raise ValueError(f"no collinearity in pair {bare.pair}: an info file, anchors among its edges, or blocks are needed")
    unordered = info.unionByName(told).distinct().withColumn("by_pair", F.lit(True))
    ordered = in_blocks.select("pair", "a", "b", F.lit(True).alias("by_block"))
    out = kinds.withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")}).join(unordered, ["pair", "p", "q"], "left").join(ordered, ["pair", "a", "b"], "left")
    hit = F.when(F.col("source") == "blocks", F.col("by_block")).otherwise(F.col("by_pair"))
    return out.select("pair", "a", "b", "kind", "source", (F.coalesce(hit, F.lit(False)) & F.col("kind").isin("exact", "homeologue")).alias("collinear"))


def _pairs_of_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = content(lines(spark, paths)).select(fields(F.col("line")).alias("f"), "src").filter(F.size("f") >= 6)
    one = rows.select(pair_of(F.col("src.file")).alias("pair"), F.explode(F.split(F.col("f")[5], ";")).alias("x")).filter(F.contains("x", F.lit(",")))
    ends = F.split(F.trim("x"), ",", 2)
    return one.select("pair", F.trim(ends[0]).alias("a"), F.trim(ends[1]).alias("b"))


def pan_clusters(spark: SparkSession, analysis: str, out: str, prefix: str = "OGI", collinear: bool = True, singletons: bool = True, force: bool = False) -> DataFrame:
    """Clusters of all accessions as a snapshot: members (cluster, gene_id), edges with what became of them, counters; and lists in both forms, long and wide, as text.

    With collinear only edges on one group of chromosomes that are collinear count, else all. Genes of the accessions that are in no cluster are clusters of
    their own unless singletons is false. Clusters are numbered by their first members. Returns the counters.
    """
    work = Workspace(spark, "pairs")
    if collinear:
        places = work.write(loci(spark, f"{analysis}/accessions"), "loci")
        edges = work.write(collinear_edges(spark, f"{analysis}/work/pairs", places, work), "collinear")
        kept, counters = edges.filter("collinear").select("a", "b"), graph.edge_counters(edges)
    else:
        files = pair_files(spark, f"{analysis}/work/pairs")
        edges = work.write(annotations.edges(spark, files["edges"]).select(pair_of(F.col("src.file")).alias("pair"), "a", "b"), "plain")
        kept, counters = edges.select("a", "b"), edges.agg(F.count("*").alias("edges"), F.count("*").alias("kept"))
    found = work.write(graph.components(kept, work, "components"), "components")
    if singletons:
        from kinloom.sources import genomes

        beds = gene_beds(spark, f"{analysis}/accessions")
        universe = genomes.gene_universe(spark, beds).withColumnRenamed("gene_id", "node")
        found = work.write(graph.with_singletons(found, universe), "every")
    named = work.write(graph.numbered(found, prefix.strip("_") or "OGI", work), "named")
    with Snapshot(spark, out, force) as snap:
        snap.write(named.select("cluster", F.col("node").alias("gene_id")), "members", order=("cluster", "gene_id"), dealt=True, bloom=("gene_id",))
        snap.write(edges, "edges", order=("pair",))
        snap.write(counters, "counters")
        snap.write(graph.size_histogram(found), "sizes")
        sinks.lines(named.select(F.concat_ws("\t", "cluster", "node").alias("value")).orderBy("cluster", "node"), snap.path("long"))
        sinks.lines(graph.wide(named).withColumnRenamed("line", "value").orderBy("value"), snap.path("wide"))
        for name in ("long", "wide"):
            snap.tables[name] = {"path": f"{snap.folder}/{name}"}
    return snapshot.read(spark, out, "counters")
