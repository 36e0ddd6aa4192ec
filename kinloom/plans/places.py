"""Queries on ordered places."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions.scratch import Workspace
from kinloom.operators import coords
from kinloom.operators.pick import ranked
from kinloom.plans.clusters import GENES, PLACED, genes, placed
from kinloom.plans.registry import query

INDEXED = f"{PLACED}, indexed AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY accession, chr ORDER BY begin_pos, end_pos, gene_id) - 1 AS INT) AS chrom_index FROM placed)"
SLOTS = f"""{GENES}, {INDEXED}, lead AS (SELECT pangene, min(gene_id) AS gene_id FROM genes GROUP BY pangene), focal AS (SELECT i.gene_id AS focal, accession, chr, chrom_index AS spot, CASE WHEN strand = '-' THEN 1 ELSE 3 END AS low, CASE WHEN strand = '-' THEN 3 ELSE 1 END AS high FROM indexed i JOIN lead l ON i.gene_id = l.gene_id),
slot AS (SELECT focal, accession, chr, spot, low, unnest(range(0, low + high + 1)) AS slot FROM focal), asked AS MATERIALIZED (SELECT focal, accession, chr, low, slot, CAST(spot - low + slot AS INT) AS at_index FROM slot),
strips AS MATERIALIZED (SELECT s.focal, s.accession, s.chr, CAST(s.slot AS INT) AS slot, s.slot = s.low AS is_focal, i.gene_id, i.begin_pos, i.end_pos, i.strand FROM asked s LEFT JOIN indexed i ON i.accession = s.accession AND i.chr = s.chr AND i.chrom_index = s.at_index)"""


def indexed(i):
    return coords.chrom_index(placed(i))


def strips(i, held=None):
    """Neighbourhoods of the first gene of each cluster. Places are ranked once and written, as focal genes, their places and their neighbours are all looked up there."""
    lead = (genes(i) if held is None else held).groupBy("pangene").agg(F.min("gene_id").alias("gene_id")).select("gene_id")
    at = Workspace(i.spark, "places").write(indexed(i), "indexed")
    return coords.neighbourhoods(at, at.join(lead, "gene_id", "left_semi").select("gene_id", "accession"), 3, 1)


def written_genes(i):
    """A workspace, and the genes in it, for what asks for them more than once."""
    work = Workspace(i.spark, "strips")
    return work, work.write(genes(i), "genes")


@query(f"WITH {INDEXED} SELECT gene_id, accession, chr, chrom_index FROM indexed", "coord")
def w01_w04_chrom_index(i):
    return indexed(i).select("gene_id", "accession", "chr", "chrom_index")


@query(f"WITH {SLOTS} SELECT * FROM strips", "coord", "member")
def w02_neighbourhoods(i):
    return strips(i)


@query(f"WITH {SLOTS} SELECT focal, accession, min(begin_pos) AS low, max(end_pos) AS high, count(gene_id)::BIGINT AS filled, count(*)::BIGINT AS slots FROM strips GROUP BY focal, accession", "coord", "member")
def a16_strip_span(i):
    return coords.span(strips(i))


@query(f"WITH {SLOTS}, f AS (SELECT s.focal, s.accession, g.pangene, min(s.slot) AS first FROM strips s JOIN genes g ON s.gene_id = g.gene_id GROUP BY 1, 2, 3) SELECT focal, accession, string_agg(pangene, '|' ORDER BY first, pangene) AS legend FROM f GROUP BY 1, 2", "coord", "member")
def a16_strip_legend(i):
    return coords.legend(strips(i), genes(i))


@query(f"WITH {SLOTS}, n AS (SELECT count(*) AS strips FROM (SELECT DISTINCT focal, accession FROM strips)), f AS (SELECT g.pangene, count(DISTINCT s.focal || ' ' || s.accession)::BIGINT AS present, bool_or(s.is_focal) AS has_focal FROM strips s JOIN genes g ON s.gene_id = g.gene_id GROUP BY 1) SELECT pangene, present, has_focal FROM f, n WHERE has_focal OR present >= 0.02 * strips", "coord", "member")
def w09_presence(i):
    work, held = written_genes(i)
    return coords.presence(work.write(strips(i, held), "strips"), held, 0.02)


@query(f"""WITH {SLOTS}, t AS (SELECT focal, accession, CAST(rank() OVER (ORDER BY focal, accession) AS INT) AS track FROM (SELECT DISTINCT focal, accession FROM strips)), o AS (SELECT DISTINCT t.track, g.pangene, s.gene_id FROM strips s JOIN genes g ON s.gene_id = g.gene_id JOIN t ON t.focal = s.focal AND t.accession = s.accession)
SELECT a.track, a.pangene, a.gene_id, b.gene_id AS gene_below FROM o a JOIN o b ON b.track = a.track + 1 AND a.pangene = b.pangene""", "coord", "member")
def w10_track_links(i):
    work, held = written_genes(i)
    s = work.write(strips(i, held), "strips")
    tracks = ranked(s.select("focal", "accession").distinct(), ["focal", "accession"], work, "tracks").select("focal", "accession", F.col("rank").cast("int").alias("track"))
    return coords.track_links(s, held, tracks)


@query(f"WITH {PLACED}, g AS (SELECT *, lag(end_pos) OVER (PARTITION BY accession, chr ORDER BY begin_pos, end_pos, gene_id) AS before FROM placed) SELECT gene_id, accession, CASE WHEN begin_pos > before THEN begin_pos - before END AS gap FROM g", "coord")
def w03_gaps(i):
    return coords.gaps(placed(i)).select("gene_id", "accession", "gap")


@query(f"WITH {PLACED}, g AS (SELECT *, lag(end_pos) OVER (PARTITION BY accession, chr ORDER BY begin_pos, end_pos, gene_id) AS before FROM placed), h AS (SELECT accession, CASE WHEN begin_pos > before THEN begin_pos - before END AS gap FROM g) SELECT accession, CAST(floor(sum(gap) / count(gap) / 100) * 100 AS BIGINT) AS mean_gap, count(gap)::BIGINT AS n_gaps FROM h GROUP BY accession", "coord")
def a20_mean_gap(i):
    return coords.average_gap(placed(i))


BLOCKS = "raw AS (SELECT 'c' || CAST(o_custkey % 5 AS STRING) AS chr1, o_orderkey % 50000 * 100 AS s1, o_orderkey % 50000 * 100 + CAST(o_totalprice AS BIGINT) % 9000 - 3000 AS e1, 'c' || CAST(o_orderkey % 5 AS STRING) AS chr2, o_custkey * 300 AS s2, o_custkey * 300 + 200000 AS e2 FROM orders)"
TURNED = f"{BLOCKS}, b AS (SELECT chr1, least(s1, e1) AS s1, greatest(s1, e1) AS e1, chr2, least(s2, e2) AS s2, greatest(s2, e2) AS e2 FROM raw), blocks AS (SELECT * FROM b UNION ALL SELECT chr2, s2, e2, chr1, s1, e1 FROM b)"
EDGES = "e AS (SELECT l_orderkey AS a, l_partkey AS b, l_linenumber AS k, 'c' || CAST(l_suppkey % 5 AS STRING) AS chr1, l_orderkey % 50000 * 100 + l_linenumber AS mid1, 'c' || CAST(l_partkey % 5 AS STRING) AS chr2, l_partkey * 200 AS mid2 FROM lineitem)"


def blocks(i):
    o = i.orders
    return o.selectExpr("concat('c', o_custkey % 5) chr1", "o_orderkey % 50000 * 100 s1", "o_orderkey % 50000 * 100 + cast(floor(o_totalprice + 0.5) as bigint) % 9000 - 3000 e1", "concat('c', o_orderkey % 5) chr2", "o_custkey * 300 s2", "o_custkey * 300 + 200000 e2")


@query(f"WITH {TURNED.replace('CAST(o_totalprice AS BIGINT)', 'CAST(floor(o_totalprice + 0.5) AS BIGINT)')} SELECT * FROM blocks")
def s26_mirrored_blocks(i):
    return coords.mirrored_blocks(blocks(i))


@query(f"WITH {TURNED.replace('CAST(o_totalprice AS BIGINT)', 'CAST(floor(o_totalprice + 0.5) AS BIGINT)')}, {EDGES} SELECT a, b, k FROM e WHERE EXISTS (SELECT 1 FROM blocks x WHERE x.chr1 = e.chr1 AND x.chr2 = e.chr2 AND e.mid1 BETWEEN x.s1 AND x.e1 AND e.mid2 BETWEEN x.s2 AND x.e2)")
def j21_edges_in_blocks(i):
    e = i.lineitem.selectExpr("l_orderkey a", "l_partkey b", "l_linenumber k", "concat('c', l_suppkey % 5) chr1", "l_orderkey % 50000 * 100 + l_linenumber mid1", "concat('c', l_partkey % 5) chr2", "l_partkey * 200 mid2")
    return coords.in_blocks(e, coords.mirrored_blocks(blocks(i))).select("a", "b", "k")
