"""From folders of sequence clusters to clusters of genes: pairs on chromosomes that may match, collinear chains, and flow clusters of what they leave.

An analysis has config/<...>expected_chr_matches<...>.inc and, for each comparison of genomes, work/03_mmseqs/<comparison>_cluster.tsv with representatives and members
whose names are packed with their places. Programs outside may add work/04_dag/<comparison>_matches.tsv and .aligncoords. All comparisons are read in one scan a kind of file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions import snapshot
from kinloom.functions.scratch import Workspace, listed
from kinloom.functions.snapshot import Snapshot
from kinloom.operators import chains, graph
from kinloom.operators.pick import pick
from kinloom.sources.lines import content, fields, lines, stem, whitespace_fields

#: Names of files and lines that are no pairs. Fixed values.
CLUSTERS, MATCHES, CHAINS, EXPECTED, FRAME = "_cluster.tsv", "_matches.tsv", ".aligncoords", "expected_chr_matches", ("expected_chr_matches=(", ")")
#: The columns of a match: where both genes are, as they are written.
SIDE = ("chr", "gene_id", "begin_pos", "end_pos")
COLUMNS = tuple(f"{c}{i}" for i in (1, 2) for c in SIDE)


def files_of(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    return [p for n, p, is_folder in listed(spark, folder) if not is_folder and n.endswith(suffix)]


def allowed_chromosomes(spark: SparkSession, analysis: str) -> DataFrame:
    """(chr_a, chr_b) in lower case and both directions, from the first include file; one that ends with the usual name goes before others. None is an error."""
    found = [(not n.endswith(f"_{EXPECTED}.inc"), p) for n, p, d in listed(spark, f"{analysis}/config") if not d and EXPECTED in n and n.endswith(".inc")]
    if not found:
        raise FileNotFoundError(f"no {EXPECTED} in {analysis}/config")
    rows = content(lines(spark, min(found)[1])).filter(~F.trim("line").isin(*FRAME)).select(F.split(F.lower(F.trim("line")), r"\s+").alias("f")).filter(F.size("f") >= 2)
    return graph.symmetric(rows.select(F.col("f")[0].alias("chr_a"), F.col("f")[1].alias("chr_b")), "chr_a", "chr_b")


def packed_members(spark: SparkSession, paths: list[str], sample: int = 50) -> DataFrame:
    """(comparison, rep, member, key, chr1, gene_id, begin_pos, end_pos) of the files whose first lines have packed names; each gene of a cluster once, its representative among them.

    key is the chromosome as the include file names it. A name of fewer than four parts in such a file is an error.
    """
    f = F.col("f")
    rows = lines(spark, paths).filter(F.trim("line") != "").select(fields(F.col("line")).alias("f"), stem(F.col("file"), (CLUSTERS,)).alias("comparison"), "src").filter(F.size(f) >= 2)
    # the first lines of a file are in its first split, and a ranking that is cut keeps no more of it
    start = rows.filter("src.block = 0").select("comparison", "src", (F.contains(f[0], F.lit("__")) & F.contains(f[1], F.lit("__"))).alias("named")).withColumn("k", F.row_number().over(Window.partitionBy("comparison").orderBy("src"))).filter(F.col("k") <= sample)
    whole = start.groupBy("comparison").agg(F.bool_and("named").alias("packed")).filter("packed").select("comparison")
    # one row a file: a shuffle by file would put a whole file in one task
    out = rows.join(F.broadcast(whole), "comparison", "left_semi").select("comparison", f[0].alias("rep"), F.explode(F.array(f[0], f[1])).alias("member")).distinct()
    p = F.split(F.trim("member"), "__")
    bad = F.raise_error(F.concat(F.lit("not packed with its place: "), F.col("member")))
    out = out.withColumn("p", F.when(F.size(p) >= 4, p).otherwise(bad))
    key = F.regexp_replace(F.lower(F.trim(F.col("p")[0])), "^chr", "")
    return out.select("comparison", "rep", "member", key.alias("key"), *[F.col("p")[i].alias(c) for i, c in enumerate(SIDE)])


def unordered(side: tuple[str, ...] = SIDE) -> tuple[Column, Column]:
    """The two genes of a match, the smaller first."""
    x, y = (F.struct(*[F.col(f"{c}{i}").alias(c) for c in side]) for i in (1, 2))
    return F.least(x, y), F.greatest(x, y)


def matched(members: DataFrame, allowed: DataFrame) -> DataFrame:
    """(comparison, low, high, chr1, gene_id1, ..., end_pos2): pairs of members of one cluster on allowed chromosomes, once for each two genes (low, high).

    The gene with the smaller packed name is first. The pairs of a cluster meet by (cluster, chromosome), so that only those that may match are made. allowed has some rows a
    chromosome, however many genes there are, and is broadcast: a shuffle by chromosome would put all genes of one in one task.
    """
    side = lambda i: [F.col(c).alias(f"{c}{i}") for c in SIDE]
    x = members.join(F.broadcast(allowed.select(F.col("chr_a").alias("key"), F.col("chr_b").alias("wanted"))), "key").select("comparison", "rep", F.col("wanted").alias("key"), F.col("member").alias("a"), *side(1))
    y = members.select("comparison", "rep", "key", F.col("member").alias("b"), *side(2))
    low, high = unordered()
    found = x.join(y, ["comparison", "rep", "key"]).filter("a < b").select("comparison", *COLUMNS, "a", "b").withColumns({"low": low, "high": high})
    return pick(found, ["comparison", "low", "high"], [F.col("a"), F.col("b")], last=True).select("comparison", "low", "high", *COLUMNS)


def matches(spark: SparkSession, analysis: str, merge: bool = False) -> DataFrame:
    """(comparison, chr1, gene_id1, ..., end_pos2) of a folder's cluster files. With merge the rows of matches that the folder has already stay, unless the same two
    genes are found anew. No cluster files at all is an error."""
    paths = files_of(spark, f"{analysis}/work/03_mmseqs", CLUSTERS)
    if not paths:
        raise FileNotFoundError(f"no {CLUSTERS} files in {analysis}/work/03_mmseqs")
    new = matched(packed_members(spark, paths), allowed_chromosomes(spark, analysis))
    old = files_of(spark, f"{analysis}/work/04_dag", MATCHES) if merge else []
    if old:
        low, high = unordered()
        rows = stored_matches(spark, old).withColumns({"low": low, "high": high})
        kept = pick(rows, ["comparison", "low", "high"], [F.col("src")], last=True).drop("src").join(new.select("comparison", "low", "high"), ["comparison", "low", "high"], "left_anti")
        new = new.unionByName(kept.select(new.columns))
    return new.drop("low", "high")


def stored_matches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Matches of files of eight columns or more, with src; shorter lines go."""
    f = F.col("f")
    rows = lines(spark, paths).filter(F.trim("line") != "").select(fields(F.col("line")).alias("f"), stem(F.col("file"), (MATCHES,)).alias("comparison"), "src").filter(F.size(f) >= 8)
    return rows.select("comparison", *[f[i].alias(c) for i, c in enumerate(COLUMNS)], "src")


def filtered_pairs(spark: SparkSession, analysis: str, strict: bool = False) -> DataFrame:
    """(a, b): the distinct pairs of the chains that a program has left in 04_dag; of its matches as well unless strict. Files of chains must be there, and one of them have a line."""
    folder = f"{analysis}/work/04_dag"
    ends = lambda paths: content(lines(spark, paths)).select(F.split(F.trim("line"), r"\s+").alias("f"))
    coords = files_of(spark, folder, CHAINS)
    if not coords or ends(coords).isEmpty():
        raise ValueError(f"no chains in {folder}")
    rows = ends(coords + ([] if strict else files_of(spark, folder, MATCHES))).filter(F.size("f") >= 6)
    return rows.select(F.col("f")[1].alias("a"), F.col("f")[5].alias("b")).distinct()


def chained_pairs(found: DataFrame, workspace: Workspace, reach: int = 10, gap: float = 1.0, least: int = 4) -> DataFrame:
    """(comparison, a, b, score, length) of the matches through which a chain of at least so many goes, forwards or backwards, with the best such chain's score.

    Genes are ranked along each chromosome of a comparison among the genes that match at all. The best chain that ends in a match and the best that starts there (one that
    ends there when both ranks run the other way) are found in one call; together they are the best chain through it.
    """
    number = lambda c: F.col(c).try_cast("long")
    rows = found.select("comparison", *[F.col(c) for c in ("chr1", "chr2")], F.col("gene_id1").alias("a"), F.col("gene_id2").alias("b"), number("begin_pos1").alias("at1"), number("begin_pos2").alias("at2"))
    ends = rows.select("comparison", F.explode(F.array(*[F.struct(F.col(f"chr{i}").alias("chr"), F.col(g).alias("gene"), F.col(f"at{i}").alias("at")) for i, g in ((1, "a"), (2, "b"))])).alias("g")).select("comparison", "g.*").distinct()
    ranked = workspace.write(ends.withColumn("rank", F.row_number().over(Window.partitionBy("comparison", "chr").orderBy("at", "gene")).cast("long")), "ranks")  # a chromosome's genes are bounded
    on = lambda i, g, n: ranked.select("comparison", F.col("chr").alias(f"chr{i}"), F.col("gene").alias(g), F.col("at").alias(f"at{i}"), F.col("rank").alias(n))
    placed = rows.join(on(1, "a", "x"), ["comparison", "chr1", "a", "at1"]).join(on(2, "b", "y"), ["comparison", "chr2", "b", "at2"])
    # a way of looking at the same matches: y turned for chains that run backwards, both turned for chains that start in a match
    ways = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.lit(up).alias("up"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for w, up, x, y in (("+", True, 1, 1), ("-", True, 1, -1), ("+", False, -1, -1), ("-", False, -1, 1))])).alias("s")
    # two ranks are one number: neither reaches 2^31
    anchors = placed.select("comparison", "chr1", "chr2", "a", "b", "x", "y", (F.shiftleft("x", 31) + F.col("y")).alias("id"))
    anchors = workspace.write(anchors.withColumn("place", F.concat_ws("|", "comparison", "chr1", "chr2")), "anchors")
    turned = anchors.select("place", "id", "x", "y", ways).select(F.concat_ws("|", "place", "s.way", F.col("s.up").cast("string")).alias("pair"), "id", (F.col("x") * F.col("s.sx")).alias("x"), (F.col("y") * F.col("s.sy")).alias("y"), F.lit(1.0).alias("w"))
    best = chains.chained(turned, workspace, reach, gap).select(F.regexp_extract("pair", r"^(.*)\|(?:true|false)$", 1).alias("line"), "id", "score", "ord")
    through = best.groupBy("line", "id").agg((F.sum("score") - 1).alias("score"), (F.sum("ord") - 1).alias("length")).filter(F.col("length") >= least)
    kept = through.groupBy(F.regexp_extract("line", r"^(.*)\|[+-]$", 1).alias("place"), "id").agg(F.max(F.struct("score", "length")).alias("best"))
    out = anchors.join(kept, ["place", "id"]).groupBy("comparison", "a", "b").agg(F.max("best").alias("best"))
    return out.select("comparison", "a", "b", "best.score", "best.length")


def gene_clusters(spark: SparkSession, analysis: str, out: str, strict: bool = True, prefix: str = "PAN", inflation: float = 2.0, merge: bool = False, force: bool = False) -> DataFrame:
    """From cluster files to numbered clusters of genes, as a snapshot: matches by comparison, the pairs that count, members (cluster, gene_id). Returns counters.

    Pairs are those on chains; of all matches unless strict. Flow clustering weighs a pair by how many comparisons have it.
    """
    work = Workspace(spark, "homology")
    found = work.write(matches(spark, analysis, merge), "matches")
    on_chains = work.write(chained_pairs(found, work), "chained")
    used = on_chains.select("comparison", "a", "b") if strict else found.select("comparison", F.col("gene_id1").alias("a"), F.col("gene_id2").alias("b")).distinct()
    pairs = work.write(used.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count_distinct("comparison").cast("double").alias("w")), "pairs")
    flow = work.write(chains.flow_clusters(pairs, work, inflation).withColumnRenamed("cluster", "component"), "flow")
    named = work.write(graph.numbered(flow, prefix, work), "named")
    counts = [(n, df.count()) for n, df in (("matches", found), ("chained", on_chains), ("pairs", pairs), ("genes", named))]
    with Snapshot(spark, out, force) as snap:
        snap.write(found, "matches", by=("comparison",), order=("chr1", "chr2"))
        snap.write(pairs, "pairs", order=("a", "b"))
        snap.write(named.select("cluster", F.col("node").alias("gene_id")), "members", order=("cluster", "gene_id"), dealt=True, bloom=("gene_id",))
        snap.write(spark.createDataFrame(counts, "name string, n long"), "counters")
    return snapshot.read(spark, out, "counters")
