"""Ordered places on chromosomes: ranks, neighbourhoods, gaps, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import ids
from kinloom.operators.pick import pick


def owners(coords: DataFrame, order: list[Column]) -> DataFrame:
    """(gene_id, accession): one accession a gene, that of its last row in the order of the source, whichever others have coordinates of it too."""
    return pick(coords.select("gene_id", "accession", *[o.alias(f"_o{i}") for i, o in enumerate(order)]), ["gene_id"], [F.col(f"_o{i}") for i in range(len(order))], last=True).select("gene_id", "accession")


def placed(coords: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each (gene, accession), the last in the order of the source, with chromosome and subgenome in one spelling."""
    last = pick(coords, ["gene_id", "accession"], order, last=True)
    return last.withColumn("chr", ids.chromosome(F.col("chr"))).withColumn("subgenome", ids.subgenome(F.col("chr")))


def chrom_index(coords: DataFrame) -> DataFrame:
    """Rank of each gene on its chromosome, from 0. Partitions are chromosomes of one accession, bounded by biology."""
    order = Window.partitionBy("accession", "chr").orderBy("begin_pos", "end_pos", "gene_id")
    return coords.withColumn("chrom_index", (F.row_number().over(order) - 1).cast("int"))


def neighbourhoods(indexed: DataFrame, focals: DataFrame, five: int, three: int) -> DataFrame:
    """Slots around each focal gene, `five` on its 5' side and `three` on its 3' side, in order of place; empty where the chromosome ends.

    On the minus strand the sides swap. Slots are made from the focal genes and joined by equality on (accession, chr, rank).
    """
    back = ids.minus(F.col("strand"))
    f = focals.join(indexed, ["gene_id", "accession"]).select(
        F.col("gene_id").alias("focal"), "accession", "chr", F.col("chrom_index").alias("at"),
        F.when(back, three).otherwise(five).alias("low"), F.when(back, five).otherwise(three).alias("high"),
    )
    slots = f.select("focal", "accession", "chr", "at", "low", F.explode(F.sequence(F.lit(0), F.col("low") + F.col("high"))).alias("slot"))
    slots = slots.withColumn("chrom_index", F.col("at") - F.col("low") + F.col("slot"))
    genes = indexed.select("accession", "chr", "chrom_index", "gene_id", "begin_pos", "end_pos", "strand")
    out = slots.join(genes, ["accession", "chr", "chrom_index"], "left")
    return out.select("focal", "accession", "chr", "slot", (F.col("chrom_index") == F.col("at")).alias("is_focal"), "gene_id", "begin_pos", "end_pos", "strand")


def span(slots: DataFrame) -> DataFrame:
    """Least and greatest coordinate of each neighbourhood, and how many slots are filled."""
    return slots.groupBy("focal", "accession").agg(F.min("begin_pos").alias("low"), F.max("end_pos").alias("high"), F.count("gene_id").alias("filled"), F.count("*").alias("slots"))


def legend(slots: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters of each neighbourhood in order of first appearance."""
    found = slots.filter("gene_id IS NOT NULL").join(members.select("gene_id", "pangene"), "gene_id")
    first = found.groupBy("focal", "accession", "pangene").agg(F.min("slot").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "pangene")))
    return first.groupBy("focal", "accession").agg(F.array_join(F.transform(listed, lambda x: x["pangene"]), "|").alias("legend"))


def presence(slots: DataFrame, members: DataFrame, share: float) -> DataFrame:
    """Clusters present in at least a share of the neighbourhoods, each neighbourhood counted once; those of focal genes always."""
    found = slots.filter("gene_id IS NOT NULL").join(members.select("gene_id", "pangene"), "gene_id")
    rows = slots.select("focal", "accession").distinct().agg(F.count("*").alias("strips"))
    per = found.groupBy("pangene").agg(F.count_distinct("focal", "accession").alias("present"), F.max("is_focal").alias("has_focal"))
    return per.crossJoin(F.broadcast(rows)).filter(F.col("has_focal") | (F.col("present") >= share * F.col("strips"))).select("pangene", "present", "has_focal")


def track_links(slots: DataFrame, members: DataFrame, tracks: DataFrame) -> DataFrame:
    """Genes of one cluster on neighbouring tracks; tracks gives each focal gene its track number."""
    on = slots.filter("gene_id IS NOT NULL").join(members.select("gene_id", "pangene"), "gene_id").join(tracks, ["focal", "accession"]).select("track", "pangene", "gene_id").distinct()
    below = on.select((F.col("track") - 1).alias("track"), "pangene", F.col("gene_id").alias("gene_below"))
    return on.join(below, ["track", "pangene"]).select("track", "pangene", "gene_id", "gene_below")


def gaps(coords: DataFrame) -> DataFrame:
    """Distance from the gene before on the same chromosome, where they do not overlap."""
    order = Window.partitionBy("accession", "chr").orderBy("begin_pos", "end_pos", "gene_id")
    before = F.lag("end_pos").over(order)
    return coords.withColumn("gap", F.when(F.col("begin_pos") > before, F.col("begin_pos") - before))


def average_gap(coords: DataFrame, keys: tuple[str, ...] = ("accession",)) -> DataFrame:
    """Mean gap, rounded down to whole hundreds."""
    return gaps(coords).groupBy(*keys).agg((F.floor(F.sum("gap") / F.count("gap") / 100) * 100).cast("long").alias("mean_gap"), F.count("gap").alias("n_gaps"))


def mirrored_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (chr1, s1, e1, chr2, s2, e2) with their intervals in order, and each also the other way round."""
    b = blocks.select("chr1", F.least("s1", "e1").alias("s1"), F.greatest("s1", "e1").alias("e1"), "chr2", F.least("s2", "e2").alias("s2"), F.greatest("s2", "e2").alias("e2"))
    turned = b.select(F.col("chr2").alias("chr1"), F.col("s2").alias("s1"), F.col("e2").alias("e1"), F.col("chr1").alias("chr2"), F.col("s1").alias("s2"), F.col("e1").alias("e2"))
    return b.unionByName(turned)


#: Levels of the grid go up by so many powers of two; a level's cells have sides of 2^level.
LEVEL_STEP = 2


def _level(low: str, high: str, least: int) -> Column:
    """The least level, from `least` on, whose cells are no shorter than the interval, which then touches two of them at most."""
    powers = F.ceil(F.log2(F.col(high) - F.col(low) + 1) / LEVEL_STEP) * LEVEL_STEP
    return F.greatest(powers, F.lit(least)).cast("int")


def block_grid(blocks: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Blocks (chr1, s1, e1, chr2, s2, e2) listed by the cells of a grid over both intervals, each at the level of its own sides; and the levels in use.

    Half of the blocks are on the lowest level of a side, which follows from the median length; longer ones are on coarser levels, so no block has more than four
    cells, however long it is. Levels are a few numbers: at most (64 / LEVEL_STEP)^2 pairs.
    """
    b = blocks.select("chr1", "chr2", *[F.col(c).cast("long").alias(c) for c in ("s1", "e1", "s2", "e2")]).filter("s1 <= e1 AND s2 <= e2").distinct()
    half = b.agg(*[F.percentile_approx(F.col(f"e{i}") - F.col(f"s{i}") + 1, 0.5).alias(f"m{i}") for i in (1, 2)]).first()
    least = [-(-(int(m or 1) - 1).bit_length() // LEVEL_STEP) * LEVEL_STEP for m in half]
    leveled = b.withColumn("l1", _level("s1", "e1", least[0])).withColumn("l2", _level("s2", "e2", least[1]))
    cells = leveled
    for i in (1, 2):
        cells = cells.withColumn(f"c{i}", F.explode(F.expr(f"sequence(shiftright(s{i}, l{i}), shiftright(e{i}, l{i}))")))
    return cells, sorted((r.l1, r.l2) for r in leveled.select("l1", "l2").distinct().collect())


def in_blocks(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges (chr1, mid1, chr2, mid2) for which some block holds both midpoints.

    A pair of midpoints is one point, looked up once however many edges have it; on each level in use it lies in one cell, and meets the blocks listed
    there by equality. So what is compared grows with edges and blocks, not with the blocks of a pair of chromosomes. Edges without a midpoint are in no block.
    """
    grid, levels = block_grid(blocks)
    if not levels:
        return edges.limit(0)
    point = ["chr1", "mid1", "chr2", "mid2"]
    points = edges.select(*point).distinct()
    at = points.withColumn("l", F.explode(F.array(*[F.struct(F.lit(a).alias("l1"), F.lit(b).alias("l2")) for a, b in levels]))).select(*point, "l.*")
    at = at.withColumn("c1", F.expr("shiftright(cast(mid1 as long), l1)")).withColumn("c2", F.expr("shiftright(cast(mid2 as long), l2)"))
    keys = ["chr1", "chr2", "l1", "l2", "c1", "c2"]
    x, y = at.alias("x"), grid.alias("y")
    on = F.col("x.mid1").between(F.col("y.s1"), F.col("y.e1")) & F.col("x.mid2").between(F.col("y.s2"), F.col("y.e2"))
    for k in keys:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    return edges.join(x.join(y, on, "left_semi").select(*point).distinct(), point, "left_semi")
