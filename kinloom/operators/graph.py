"""Homology edges and their components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinloom.functions import ids
from kinloom.functions.scratch import Workspace
from kinloom.operators.pick import pick, ranked


def components(edges: DataFrame, workspace: Workspace, name: str = "edges") -> DataFrame:
    """(node, component) for each node of edges (a, b): the least node that can be reached.

    Nodes with one neighbour only are set aside first and follow their neighbour at the end; what is left, the core, is often small. There large and small stars take turns:
    first every node ties its larger neighbours to its least one, then its smaller ones and itself. The rounds are logarithmic in number. Each is written
    to the shared folder, and counted with a checksum while it is written; these stop changing when all edges are stars, and are all that the driver sees.
    """
    whole = workspace.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-all")
    ends = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("near"))
    leaves = workspace.write(ends.filter("n = 1").select(F.col("a").alias("leaf"), "near"), f"{name}-leaves")
    mark = lambda c: leaves.select(F.col("leaf").alias(c))
    core = _core_components(whole.join(mark("a"), "a", "left_anti").join(mark("b"), "b", "left_anti").select("a", "b"), workspace, name)
    core = workspace.write(core, f"{name}-core")
    led = leaves.join(core.select(F.col("node").alias("near"), "component"), "near", "left").select("leaf", "near", F.coalesce("component", F.least("leaf", "near")).alias("pair"), F.coalesce("component", "near").alias("label"))
    # a component of two nodes is a pair of leaves, each the other's neighbour; any other has its label in the core or in the middle of its star
    apart = led.join(leaves.select(F.col("leaf").alias("near"), F.lit(True).alias("two")), "near", "left").select("leaf", "near", F.when(F.col("two"), F.col("pair")).otherwise(F.col("label")).alias("label"), F.coalesce("two", F.lit(False)).alias("two"))
    apart = workspace.write(apart, f"{name}-apart")
    least = apart.groupBy("label").agg(F.min("leaf").alias("least"))
    middles = apart.filter(~F.col("two") & (F.col("label") == F.col("near"))).select(F.col("near").alias("node"), "label").distinct()
    known = core.select("node", F.col("component").alias("label"))
    nodes = known.unionByName(middles.join(known.select("node"), "node", "left_anti")).unionByName(apart.select(F.col("leaf").alias("node"), "label"))
    return nodes.join(least, "label", "left").select("node", F.coalesce(F.least("least", "label"), "label").alias("component"))


def _core_components(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    now, seen = _counted(edges, workspace, f"{name}-0")
    k = 0
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # used twice, shuffled once
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        k += 1
        before = seen
        now, seen = _counted(large.join(low, "a").select(ties.alias("e")).select("e.*").filter("a <> b").distinct(), workspace, f"{name}-{k}")
        workspace.drop(f"{name}-{k - 1}")
        if seen == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _counted(edges: DataFrame, workspace: Workspace, name: str) -> tuple[DataFrame, tuple]:
    """Edges written, with their number and a checksum, observed on the way."""
    seen = Observation()
    observed = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return workspace.write(observed, name), (seen.get["n"], seen.get["sum"])


def with_singletons(found: DataFrame, universe: DataFrame) -> DataFrame:
    """Components, and each node of the universe (node) that is in none as its own."""
    alone = universe.select("node").distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def numbered(found: DataFrame, prefix: str, workspace: Workspace) -> DataFrame:
    """(node, cluster): names by rank of the components' first members."""
    per = found.groupBy("component").agg(F.min("node").alias("first"))
    names = ranked(per, ["first"], workspace, "first-members").select("component", F.format_string(f"{prefix}_%06d", "rank").alias("cluster"))
    return found.join(names, "component").select("node", "cluster")


def size_histogram(found: DataFrame) -> DataFrame:
    """Components and nodes by size class."""
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    s = F.col("size")
    label = F.when(s == 1, "1").when(s == 2, "2").when(s <= 5, "3-5").when(s <= 10, "6-10").when(s <= 50, "11-50").otherwise(">50")
    return sizes.groupBy(label.alias("size_class")).agg(F.count("*").alias("components"), F.sum("size").alias("nodes"))


def largest(found: DataFrame, k: int = 12) -> DataFrame:
    return found.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(k)


def wide(found: DataFrame) -> DataFrame:
    """A line for each cluster: its name and its members in order. Clusters of related genes are small; long form is for the rest."""
    return found.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("node")), "\t").alias("members")).select(F.concat_ws("\t", "cluster", "members").alias("line"))


def with_loci(edges: DataFrame, loci: DataFrame) -> DataFrame:
    """Edges with the loci (gene_id, chr, begin_pos, end_pos) of both ends; null where one is unknown."""
    side = lambda s, n: loci.select(F.col("gene_id").alias(s), F.col("chr").alias(f"chr{n}"), F.floor((F.col("begin_pos") + F.col("end_pos")) / 2).alias(f"mid{n}"))
    return edges.join(side("a", 1), "a", "left").join(side("b", 2), "b", "left")


def classified(edges: DataFrame) -> DataFrame:
    """Edges with loci and their kind: missing, cross (chromosome groups differ), exact or homeologue."""
    g1, g2 = ids.chromosome_group(F.col("chr1")), ids.chromosome_group(F.col("chr2"))
    kind = F.when(g1.isNull() | g2.isNull(), "missing").when(g1 != g2, "cross").when(F.upper("chr1") == F.upper("chr2"), "exact").otherwise("homeologue")
    return edges.withColumn("kind", kind)


def collinear(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges that are among the pairs (a, b), in either direction."""
    key = pairs.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    return edges.join(key, (F.least("a", "b") == F.col("p")) & (F.greatest("a", "b") == F.col("q")), "left_semi")


def edge_counters(edges: DataFrame) -> DataFrame:
    """How many edges there are of each kind, and which share is kept, in one pass over classified edges with `collinear`."""
    kept = F.col("kind").isin("exact", "homeologue") & F.col("collinear")
    n = F.count("*")
    return edges.agg(
        n.alias("edges"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "cross", "exact", "homeologue")],
        F.count_if(F.col("kind").isin("exact", "homeologue") & ~F.col("collinear")).alias("not_collinear"),
        F.count_if(kept).alias("kept"), F.round(100 * F.count_if(kept) / F.greatest(n, F.lit(1)), 6).alias("kept_pct"),
    )


def preferred_source(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each key those of its best source (least `tier`)."""
    best = rows.groupBy(*keys).agg(F.min("tier").alias("best"))
    return rows.join(best, keys).filter("tier = best").drop("best")


def inconsistent_loci(loci: DataFrame) -> DataFrame:
    """Genes that are on more than one chromosome group or accession."""
    return loci.groupBy("gene_id").agg(F.count_distinct(F.struct(ids.chromosome_group(F.col("chr")), F.col("accession"))).alias("places")).filter("places > 1")


def member_pairs(clusters: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Pairs of members (rep, member, chr) of each cluster, each once, the smaller first; with allowed (chr_a, chr_b) only of such chromosomes.

    The pairs are the result here: one for each two members, as clusters of homologous genes are bounded. allowed is joined by equality and
    broadcast by Spark only below its threshold.
    """
    m = clusters.select("rep", "member", "chr").distinct()
    x, y = m.alias("x"), m.alias("y")
    pairs = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.member") < F.col("y.member"))).select(F.col("x.rep").alias("rep"), F.col("x.member").alias("a"), F.col("x.chr").alias("chr_a"), F.col("y.member").alias("b"), F.col("y.chr").alias("chr_b"))
    return pairs if allowed is None else pairs.join(allowed, ["chr_a", "chr_b"], "left_semi").select("rep", "a", "chr_a", "b", "chr_b")


def symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(a, b).union(pairs.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def unordered_pairs(names: DataFrame, col: str) -> DataFrame:
    """All pairs of a few names (accessions), the smaller first."""
    x, y = names.select(col).distinct(), names.select(F.col(col).alias("other")).distinct()
    return x.join(y, F.col(col) < F.col("other")).select(F.col(col).alias("a"), F.col("other").alias("b"))


def last_of_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each two ends whatever their order, the last of the source."""
    return pick(edges.withColumn("p", F.least("a", "b")).withColumn("q", F.greatest("a", "b")), ["p", "q"], order, last=True).drop("p", "q")


def grown(labels: DataFrame, edges: DataFrame, workspace: Workspace, name: str = "grown") -> DataFrame:
    """Components (node, component) after new edges (a, b), from those before.

    New edges are led to the components of their ends, which contracts all that was known: components are found among those few labels, and
    old nodes follow their label. Rounds are as many as the new edges' own chains need, however large the old graph.
    """
    of = labels.select("node", "component")
    a = edges.filter("a <> b").join(of.select(F.col("node").alias("a"), F.col("component").alias("p")), "a", "left")
    both = a.join(of.select(F.col("node").alias("b"), F.col("component").alias("q")), "b", "left")
    both = workspace.write(both.select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q")), f"{name}-ends")
    moved = components(both.select(F.col("p").alias("a"), F.col("q").alias("b")), workspace, f"{name}-labels")
    moved = workspace.write(moved, f"{name}-moved")
    new = both.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("p").alias("component")), F.struct(F.col("b").alias("node"), F.col("q").alias("component")))).alias("n")).select("n.*").distinct()
    every = of.unionByName(new.join(of.select("node"), "node", "left_anti"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return every.join(to, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
