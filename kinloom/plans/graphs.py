"""Queries on homology edges, clusters and distinct sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions.scratch import Workspace
from kinloom.operators import dedup, graph, sinks
from kinloom.operators.pick import pick
from kinloom.plans.clusters import PLACED, placed
from kinloom.plans.registry import query

REACH = "both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), reach(node, to_node) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.to_node = e.a), comp AS (SELECT node, min(to_node) AS component FROM reach GROUP BY node)"
ALL = f"{REACH}, universe AS (SELECT DISTINCT 'P' || CAST(p_partkey AS STRING) AS node FROM part), every AS (SELECT node, component FROM comp UNION ALL SELECT node, node FROM universe WHERE node NOT IN (SELECT node FROM comp))"


def found(i):
    return graph.components(i.edge, Workspace(i.spark, "components"))


def universe(i):
    return i.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node")).distinct()


@query(f"WITH RECURSIVE {REACH} SELECT node, component FROM comp", "edge")
def h06_components(i):
    return found(i)


@query(f"WITH RECURSIVE {ALL} SELECT node, component FROM every", "edge")
def u02_with_singletons(i):
    return graph.with_singletons(found(i), universe(i))


@query(f"WITH RECURSIVE {ALL}, r AS (SELECT component, 'CL_' || lpad(CAST(row_number() OVER (ORDER BY component) AS STRING), 6, '0') AS cluster FROM (SELECT DISTINCT component FROM every)) SELECT node, cluster FROM every JOIN r USING (component)", "edge")
def w07_h07_numbered_clusters(i):
    work = Workspace(i.spark, "numbered")
    return graph.numbered(graph.with_singletons(graph.components(i.edge, work), universe(i)), "CL", work)


@query(f"WITH RECURSIVE {ALL}, r AS (SELECT component, 'CL_' || lpad(CAST(row_number() OVER (ORDER BY component) AS STRING), 6, '0') AS cluster FROM (SELECT DISTINCT component FROM every)) SELECT cluster || chr(9) || string_agg(node, chr(9) ORDER BY node) AS line FROM every JOIN r USING (component) GROUP BY cluster", "edge")
def k06_wide_clusters(i):
    return graph.wide(w07_h07_numbered_clusters(i))


@query(f"WITH RECURSIVE {ALL}, s AS (SELECT component, count(*) AS size FROM every GROUP BY 1) SELECT CASE WHEN size = 1 THEN '1' WHEN size = 2 THEN '2' WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' WHEN size <= 50 THEN '11-50' ELSE '>50' END AS size_class, count(*)::BIGINT AS components, sum(size)::BIGINT AS nodes FROM s GROUP BY 1", "edge")
def a13_size_histogram(i):
    return graph.size_histogram(graph.with_singletons(found(i), universe(i)))


@query(f"WITH RECURSIVE {REACH} SELECT component, count(*)::BIGINT AS size FROM comp GROUP BY 1 ORDER BY size DESC, component LIMIT 12", "edge")
def t08_largest_components(i):
    return graph.largest(found(i))


PAIRED = f"{PLACED}, loci AS (SELECT gene_id, min(chr) AS chr, min(begin_pos) AS begin_pos, min(end_pos) AS end_pos FROM placed GROUP BY gene_id), e AS (SELECT DISTINCT 'LI' || CAST(l_orderkey AS STRING) || '.1' AS a, 'LI' || CAST(l_orderkey AS STRING) || '.' || CAST(1 + l_linenumber AS STRING) AS b FROM lineitem), pairs AS (SELECT DISTINCT least(a, b) AS p, greatest(a, b) AS q FROM e WHERE length(b) % 2 = 0), loc AS (SELECT e.a, e.b, x.chr AS chr1, y.chr AS chr2, regexp_extract(x.chr, '^([0-9]+)[ABCDH]$', 1) AS g1, regexp_extract(y.chr, '^([0-9]+)[ABCDH]$', 1) AS g2 FROM e LEFT JOIN loci x ON e.a = x.gene_id LEFT JOIN loci y ON e.b = y.gene_id), cls AS (SELECT *, CASE WHEN coalesce(g1, '') = '' OR coalesce(g2, '') = '' THEN 'missing' WHEN g1 <> g2 THEN 'cross' WHEN chr1 = chr2 THEN 'exact' ELSE 'homeologue' END AS kind, EXISTS (SELECT 1 FROM pairs WHERE p = least(a, b) AND q = greatest(a, b)) AS collinear FROM loc)"


def classified(i):
    loci = placed(i).groupBy("gene_id").agg(F.min("chr").alias("chr"), F.min("begin_pos").alias("begin_pos"), F.min("end_pos").alias("end_pos"))
    k = F.concat(F.lit("LI"), F.col("l_orderkey").cast("string"), F.lit("."))
    e = i.lineitem.select(F.concat(k, F.lit("1")).alias("a"), F.concat(k, (F.col("l_linenumber") + 1).cast("string")).alias("b")).distinct()
    pairs = e.filter(F.length("b") % 2 == 0)
    marked = graph.collinear(e, pairs).withColumn("collinear", F.lit(True))
    out = graph.classified(graph.with_loci(e, loci)).join(marked, ["a", "b"], "left")
    return out.withColumn("collinear", F.coalesce("collinear", F.lit(False)))


@query(f"WITH {PAIRED} SELECT a, b, kind, collinear FROM cls", "coord")
def j19_j20_classified_edges(i):
    return classified(i).select("a", "b", "kind", "collinear")


@query(f"WITH {PAIRED}, c AS (SELECT count(*)::BIGINT AS edges, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'cross') AS \"cross\", count(*) FILTER (kind = 'exact') AS exact, count(*) FILTER (kind = 'homeologue') AS homeologue, count(*) FILTER (kind IN ('exact', 'homeologue') AND NOT collinear) AS not_collinear, count(*) FILTER (kind IN ('exact', 'homeologue') AND collinear) AS kept FROM cls) SELECT *, round(100 * kept / edges, 6) AS kept_pct FROM c", "coord")
def a14_edge_counters(i):
    return graph.edge_counters(classified(i))


@query(f"WITH RECURSIVE {PAIRED}, kept AS (SELECT a, b FROM cls WHERE kind IN ('exact', 'homeologue') AND collinear AND a <> b), bw AS (SELECT a, b FROM kept UNION SELECT b, a FROM kept), reach(node, to_node) AS (SELECT a, a FROM bw UNION SELECT r.node, e.b FROM reach r JOIN bw e ON r.to_node = e.a) SELECT node, min(to_node) AS component FROM reach GROUP BY node", "coord")
def h08_collinear_clusters(i):
    kept = classified(i).filter("kind IN ('exact', 'homeologue') AND collinear").select("a", "b")
    return graph.components(kept, Workspace(i.spark, "collinear"))


@query("WITH r AS (SELECT l_orderkey AS k, l_linenumber AS tier, l_partkey AS v FROM lineitem) SELECT DISTINCT k, tier, v FROM r WHERE tier = (SELECT min(tier) FROM r x WHERE x.k = r.k)")
def h09_best_source(i):
    rows = i.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("tier"), F.col("l_partkey").alias("v"))
    return graph.preferred_source(rows, ["k"]).distinct()


@query(f"WITH {PLACED}, g AS (SELECT gene_id, count(DISTINCT accession || '/' || coalesce(nullif(regexp_extract(chr, '^([0-9]+)[ABCDH]$', 1), ''), '-'))::BIGINT AS places FROM placed GROUP BY gene_id) SELECT gene_id, places FROM g WHERE places > 1", "coord")
def h10_inconsistent_loci(i):
    return graph.inconsistent_loci(placed(i))


REPS = "reps AS (SELECT DISTINCT l_orderkey AS rep, 'g' || CAST(l_partkey AS STRING) AS member, 'c' || CAST(l_partkey % 5 AS STRING) AS chr FROM lineitem), allowed AS (SELECT * FROM (VALUES ('c0', 'c1'), ('c1', 'c0'), ('c2', 'c2'), ('c3', 'c4'), ('c4', 'c3')) t(chr_a, chr_b))"


def reps(i):
    return i.lineitem.selectExpr("l_orderkey rep", "concat('g', l_partkey) member", "concat('c', l_partkey % 5) chr")


@query(f"WITH {REPS} SELECT x.rep, x.member AS a, x.chr AS chr_a, y.member AS b, y.chr AS chr_b FROM reps x JOIN reps y ON x.rep = y.rep AND x.member < y.member JOIN allowed w ON w.chr_a = x.chr AND w.chr_b = y.chr")
def j22_member_pairs(i):
    allowed = graph.symmetric(i.spark.createDataFrame([("c0", "c1"), ("c2", "c2"), ("c3", "c4")], "chr_a string, chr_b string"), "chr_a", "chr_b")
    return graph.member_pairs(reps(i), allowed)


@query("SELECT l_partkey % 97 AS a, l_suppkey % 89 AS b FROM lineitem UNION SELECT l_suppkey % 89, l_partkey % 97 FROM lineitem")
def s27_u03_symmetric_pairs(i):
    return graph.symmetric(i.lineitem.selectExpr("l_partkey % 97 a", "l_suppkey % 89 b"), "a", "b")


@query("SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_name < y.n_name")
def j23_j24_accession_pairs(i):
    return graph.unordered_pairs(i.nation, "n_name")


@query("WITH e AS (SELECT l_orderkey % 50 AS a, l_partkey % 50 AS b, l_shipdate AS src, l_extendedprice AS x FROM lineitem) SELECT a, b, x FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY src DESC, x DESC, a DESC, b DESC) AS k FROM e) WHERE k = 1")
def g09_u09_last_edge_wins(i):
    e = i.lineitem.selectExpr("l_orderkey % 50 a", "l_partkey % 50 b", "l_shipdate src", "l_extendedprice x")
    return graph.last_of_edges(e, [F.col("src"), F.col("x"), F.col("a"), F.col("b")]).select("a", "b", "x")


@query("SELECT l_orderkey % 5000 AS a, l_partkey % 40 AS b FROM lineitem UNION SELECT l_orderkey % 5000, l_suppkey % 40 FROM lineitem")
def u01_distinct_union(i):
    x = i.lineitem.selectExpr("l_orderkey % 5000 a", "l_partkey % 40 b")
    return x.union(i.lineitem.selectExpr("l_orderkey % 5000 a", "l_suppkey % 40 b")).distinct()


@query("SELECT l_orderkey AS id FROM lineitem INTERSECT SELECT p_partkey FROM part")
def u06_shared_ids(i):
    return i.lineitem.selectExpr("l_orderkey id").intersect(i.part.selectExpr("p_partkey id"))


@query("WITH x AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), y AS (SELECT DISTINCT p_partkey AS id FROM part) SELECT (SELECT count(*) FROM x WHERE id IN (SELECT id FROM y))::BIGINT AS shared, (SELECT count(*) FROM x WHERE id NOT IN (SELECT id FROM y))::BIGINT AS only_a, (SELECT count(*) FROM y WHERE id NOT IN (SELECT id FROM x))::BIGINT AS only_b")
def j26_id_overlap(i):
    return dedup.id_overlap(i.lineitem.selectExpr("l_orderkey id"), i.part.selectExpr("p_partkey id"), "id")


@query("SELECT coalesce(x.k, y.k) AS k, coalesce(x.q3, '') AS q3, coalesce(y.q8, '') AS q8 FROM (SELECT p_partkey AS k, p_name AS q3 FROM part WHERE p_size > 10) x FULL JOIN (SELECT p_partkey AS k, p_brand AS q8 FROM part WHERE p_size < 40) y ON x.k = y.k")
def j14_paired_structures(i):
    x, y = i.part.filter("p_size > 10").selectExpr("p_partkey k", "p_name q3"), i.part.filter("p_size < 40").selectExpr("p_partkey k", "p_brand q8")
    return x.join(y, "k", "full").select("k", F.coalesce("q3", F.lit("")).alias("q3"), F.coalesce("q8", F.lit("")).alias("q8"))


KEYED = "keyed AS (SELECT id, seq, 'u' || substr(sha256(replace(replace(upper(replace(seq, 'ß', 'ss')), ' ', ''), chr(10), '')), 1, 16) AS uniq_id FROM doc)"


def sequences(i):
    return dedup.distinct_sequences(i.doc, [F.col("id")])


@query(f"WITH {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY uniq_id ORDER BY id) AS k FROM keyed) SELECT uniq_id, seq FROM r WHERE k = 1", "doc")
def d01_d02_p27_distinct_sequences(i):
    return sequences(i)[0]


@query(f"WITH {KEYED} SELECT id, uniq_id FROM keyed", "doc")
def k07_sequence_mapping(i):
    return sequences(i)[1]


@query(f"WITH {KEYED}, p AS (SELECT uniq_id, max(length(seq)) AS q3 FROM keyed WHERE id % 3 <> 0 GROUP BY 1) SELECT k.id, p.q3 FROM keyed k LEFT JOIN p ON k.uniq_id = p.uniq_id", "doc")
def d03_j25_recombined(i):
    keyed = i.doc.join(sequences(i)[1], "id")
    p = keyed.filter("id % 3 <> 0").select("uniq_id", F.length("seq").alias("q3"))
    return dedup.recombined(sequences(i)[1], p, [-F.col("q3")]).select("id", F.col("q3").cast("long").alias("q3"))


@query("SELECT id, q3 FROM (SELECT user_id AS id, event_type AS q3, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def g10_s37_first_prediction(i):
    return pick(i.events.selectExpr("user_id id", "event_type q3", "event_id line"), ["id"], [F.col("line")]).select("id", "q3")


CELLS = "cells AS (SELECT p_brand AS cluster, p_type AS genome, string_agg(replace(p_name, ' ', '_') || '.' || CAST(p_size % 3 AS STRING), ', ' ORDER BY p_partkey) AS cell FROM part GROUP BY 1, 2)"


def cells(i):
    p = i.part.select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("genome"), F.struct("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), (F.col("p_size") % 3).cast("string")).alias("g")).alias("x"))
    return p.groupBy("cluster", "genome").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["g"]), ", ").alias("cell"))


@query(f"WITH {CELLS}, g AS (SELECT cluster, genome, unnest(string_split(cell, ',')) AS gene, unnest(range(0, len(string_split(cell, ',')))) AS pos FROM cells), t AS (SELECT cluster, regexp_replace(trim(gene), '\\.[0-9]+$', '') AS gene, genome, pos FROM g), f AS (SELECT cluster, gene, min((genome, pos)) AS spot FROM t GROUP BY 1, 2) SELECT cluster, string_agg(gene, '|' ORDER BY spot, gene) AS genes, count(*)::BIGINT AS n FROM f GROUP BY cluster HAVING count(*) >= 2")
def d04_s29_orthogroups(i):
    return dedup.orthogroups(cells(i))


@query(f"WITH {CELLS} SELECT count(DISTINCT genome)::BIGINT AS accessions, count(DISTINCT cluster)::BIGINT AS clusters, sum(len(string_split(cell, ', ')))::BIGINT AS genes FROM cells")
def a12_s34_matrix_summary(i):
    return dedup.matrix_summary(cells(i))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 40 AS INT) AS batch FROM events")
def w06_round_robin(i):
    return sinks.round_robin(i.events.select("event_id"), ["event_id"], 40, Workspace(i.spark, "turns")).select("event_id", "batch")
