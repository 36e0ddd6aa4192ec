"""Queries on alignments, codons and k-mers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.functions.spread import spread
from kinloom.operators import alignment, similarity
from kinloom.plans.registry import query

LONG = "w AS (SELECT grp, max(length(seq)) AS n FROM aln GROUP BY grp), long AS (SELECT a.grp, gene_id, unnest(range(1, n + 1))::INTEGER AS col, unnest(string_split(rpad(seq, n::INTEGER, '-'), '')) AS aa FROM aln a JOIN w ON a.grp = w.grp)"
TOP = f"{LONG}, cnt AS (SELECT grp, col, aa, count(*) AS n, min(gene_id) AS first FROM long WHERE aa <> '-' GROUP BY 1, 2, 3), top AS (SELECT *, row_number() OVER (PARTITION BY grp, col ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY grp, col) AS total FROM cnt), cols AS (SELECT e.grp, e.col, coalesce(t.aa, '-') AS consensus, coalesce(round(t.n / t.total, 6), 0.0)::DOUBLE AS conservation FROM (SELECT DISTINCT grp, col FROM long) e LEFT JOIN top t ON t.grp = e.grp AND t.col = e.col AND t.k = 1)"
REF = f"{LONG}, ref AS (SELECT l.grp, l.col, l.aa AS ref FROM long l JOIN (SELECT grp, min(gene_id) AS gene_id FROM aln GROUP BY grp) f ON l.grp = f.grp AND l.gene_id = f.gene_id), var AS (SELECT l.grp, l.col, ref, count(*) FILTER (aa <> ref) AS differ, round(count(*) FILTER (aa <> ref) / count(*), 6) AS frequency, count(DISTINCT aa)::BIGINT AS residues FROM long l JOIN ref r ON l.grp = r.grp AND l.col = r.col GROUP BY 1, 2, 3 HAVING count(*) FILTER (aa <> ref) > 0)"


def aln(i):
    return alignment.long_form(i.aln)


@query(f"WITH {TOP} SELECT * FROM cols", "aln")
def m01_m02_columns(i):
    return alignment.columns(aln(i))


@query(f"WITH {TOP} SELECT grp, string_agg(consensus, '' ORDER BY col) AS consensus FROM cols GROUP BY grp", "aln")
def m01_consensus(i):
    return alignment.consensus(aln(i))


@query(f"WITH {REF} SELECT * FROM var", "aln")
def m06_m07_variant_columns(i):
    return alignment.variant_columns(aln(i))


@query(f"WITH {REF} SELECT l.grp, l.gene_id, string_agg(l.aa, chr(9) ORDER BY l.col) AS line FROM long l JOIN var v ON l.grp = v.grp AND l.col = v.col GROUP BY 1, 2", "aln")
def k04_variant_matrix(i):
    return alignment.variant_matrix(aln(i))


@query(f"WITH {REF} SELECT grp, col, frequency, residues FROM var ORDER BY residues DESC, frequency DESC, grp, col LIMIT 40", "aln")
def t09_variants_by_diversity(i):
    return alignment.variant_columns(aln(i)).select("grp", "col", "frequency", "residues").orderBy(F.desc("residues"), F.desc("frequency"), "grp", "col").limit(40)


@query(f"WITH {TOP} SELECT l.grp, gene_id, count(*) FILTER (aa = '-') AS gap, count(*) FILTER (aa <> '-' AND aa = consensus) AS match, count(*) FILTER (aa <> '-' AND aa <> consensus) AS diff FROM long l JOIN cols c ON l.grp = c.grp AND l.col = c.col GROUP BY 1, 2", "aln")
def m10_cell_classes(i):
    return alignment.cell_classes(aln(i))


CODE = "code AS (SELECT b1 || b2 || b3 AS codon, nullif(substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * (strpos('TCAG', b1) - 1) + 4 * (strpos('TCAG', b2) - 1) + strpos('TCAG', b3) AS INT), 1), '*') AS aa, b1, b2, b3 FROM (SELECT unnest(['T', 'C', 'A', 'G']) AS b1), (SELECT unnest(['T', 'C', 'A', 'G']) AS b2), (SELECT unnest(['T', 'C', 'A', 'G']) AS b3)), ct AS (SELECT c.codon, c.aa, CASE WHEN c.aa IS NULL THEN 0.0 ELSE (SELECT count(*) FROM code d WHERE d.aa = c.aa AND (CAST(d.b1 <> c.b1 AS INT) + CAST(d.b2 <> c.b2 AS INT) + CAST(d.b3 <> c.b3 AS INT)) = 1) / 3.0 END AS syn FROM code c)"
CODED = f"""{LONG}, clean AS (SELECT gene_id, regexp_replace(upper(cds), '[^ATCG]', '', 'g') AS cds FROM cds), need AS (SELECT grp, gene_id, count(*) FILTER (aa <> '-') AS need FROM long GROUP BY 1, 2), fit AS (SELECT n.grp, n.gene_id, c.cds FROM need n JOIN clean c ON n.gene_id = c.gene_id WHERE need > 0 AND length(cds) >= 3 * need),
ranked AS (SELECT grp, gene_id, col, aa, sum(CAST(aa <> '-' AS INT)) OVER (PARTITION BY grp, gene_id ORDER BY col) AS k FROM long), coded AS (SELECT r.grp, r.gene_id, col, CASE WHEN aa = '-' THEN '---' ELSE substr(cds, CAST(3 * k - 2 AS INT), 3) END AS codon FROM ranked r JOIN fit f ON r.grp = f.grp AND r.gene_id = f.gene_id)"""
SUBS = f"""{CODED}, {CODE}, lead AS (SELECT grp, min(gene_id) AS gene_id FROM coded GROUP BY grp), rf AS (SELECT c.grp, c.col, c.codon, t.aa, t.syn FROM coded c JOIN lead l ON c.grp = l.grp AND c.gene_id = l.gene_id LEFT JOIN ct t ON t.codon = c.codon), q AS (SELECT c.grp, c.gene_id, c.col, c.codon, t.aa, t.syn FROM coded c JOIN lead l ON c.grp = l.grp AND c.gene_id <> l.gene_id LEFT JOIN ct t ON t.codon = c.codon),
subs AS (SELECT q.grp, q.gene_id, q.col, rf.codon = '---' AS ref_gap, CASE WHEN q.aa IS NOT NULL AND rf.aa IS NOT NULL THEN (q.syn + rf.syn) / 2 ELSE 0 END AS s, CASE WHEN q.aa IS NOT NULL AND rf.aa IS NOT NULL THEN 3 - (q.syn + rf.syn) / 2 ELSE 0 END AS n, CASE WHEN q.codon <> rf.codon AND q.aa = rf.aa THEN 1 ELSE 0 END AS sd, CASE WHEN q.codon <> rf.codon AND q.aa <> rf.aa THEN 1 ELSE 0 END AS nd FROM q JOIN rf ON q.grp = rf.grp AND q.col = rf.col)"""


def coded(i):
    return alignment.codons(aln(i), i.cds)


def subs(i, references=None):
    return alignment.substitutions(coded(i), alignment.codon_table(i.spark), references)


def last_ones(i):
    """A reference that the caller chooses: the group's last sequence."""
    return i.aln.groupBy("grp").agg(F.max("gene_id").alias("gene_id"))


CHOSEN = SUBS.replace("lead AS (SELECT grp, min(gene_id) AS gene_id FROM coded GROUP BY grp)", "lead AS (SELECT grp, max(gene_id) AS gene_id FROM aln GROUP BY grp)")
TOTALS = "t AS (SELECT grp, gene_id, sum(s) AS s, sum(n) AS n, sum(sd)::BIGINT AS sd, sum(nd)::BIGINT AS nd FROM subs GROUP BY 1, 2) SELECT grp, gene_id, round(s, 6) AS s_sites, round(n, 6) AS n_sites, sd, nd, round(CASE WHEN n > 0 THEN nd / n END, 6) AS ka, round(CASE WHEN s > 0 THEN sd / s END, 6) AS ks, round(CASE WHEN s > 0 AND sd > 0 AND n > 0 THEN (nd / n) / (sd / s) END, 6) AS omega, CASE WHEN s <= 0 AND n <= 0 THEN 'no_valid_sites' END AS error FROM t"


@query(f"WITH {CODED} SELECT * FROM coded", "aln", "cds")
def m03_codons(i):
    return coded(i)


@query(f"WITH {SUBS} SELECT grp, gene_id, col, round(s, 6) AS s, round(n, 6) AS n, sd, nd FROM subs", "aln", "cds")
def m04_substitutions(i):
    return subs(i).select("grp", "gene_id", "col", F.round("s", 6).alias("s"), F.round("n", 6).alias("n"), "sd", "nd")


@query(f"WITH {SUBS}, {TOTALS}", "aln", "cds")
def m05_pairwise_rates(i):
    return alignment.pairwise(subs(i))


@query(f"WITH {CHOSEN}, {TOTALS}", "aln", "cds")
def m05_rates_against_a_chosen_gene(i):
    return alignment.pairwise(subs(i, last_ones(i)))


@query(f"WITH {LONG}, need AS (SELECT grp, gene_id, count(*) FILTER (aa <> '-') AS need FROM long GROUP BY 1, 2) SELECT n.grp, n.gene_id, CASE WHEN c.cds IS NULL OR c.cds = '' THEN 'no_cds' WHEN need = 0 OR length(regexp_replace(upper(c.cds), '[^ATCG]', '', 'g')) < 3 * need THEN 'cds_length_mismatch' END AS error FROM need n LEFT JOIN cds c ON n.gene_id = c.gene_id", "aln", "cds")
def m05_codon_errors(i):
    return alignment.codon_errors(aln(i), i.cds)


FRAMES = "frames AS (SELECT grp, gene_id, col, ref_gap, sum(s) OVER f AS s, sum(n) OVER f AS n, sum(sd) OVER f AS sd, sum(nd) OVER f AS nd FROM subs WINDOW f AS (PARTITION BY grp, gene_id ORDER BY col ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT grp, col, round(round(avg(CASE WHEN NOT ref_gap AND n > 0 AND s > 0 AND sd > 0 THEN (nd / n) / (sd / s) END), 6) + 1e-7, 4) AS omega FROM frames GROUP BY 1, 2"


@query(f"WITH {SUBS}, {FRAMES}", "aln", "cds")
def w05_m08_sliding_ratio(i):
    return alignment.sliding(subs(i)).withColumn("omega", F.round(F.col("omega") + 1e-7, 4))


@query(f"WITH {CHOSEN}, {FRAMES}", "aln", "cds")
def m08_ratio_along_a_chosen_gene(i):
    return alignment.sliding(subs(i, last_ones(i))).withColumn("omega", F.round(F.col("omega") + 1e-7, 4))


KMERS = "letters AS (SELECT grp, gene_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS s FROM aln), k AS (SELECT grp, gene_id, list_sort(list_distinct(list_transform(range(1, CAST(length(s) - 3 AS BIGINT)), lambda j: CAST((1 + ascii(substr(s, j, 1)) + ascii(substr(s, j + 1, 1)) + ascii(substr(s, j + 2, 1)) + ascii(substr(s, j + 3, 1)) + ascii(substr(s, j + 4, 1))) % 4096 AS INT)))) AS k FROM letters)"


@query(f"WITH {KMERS} SELECT gene_id, array_to_string(k, '|') AS classes FROM k", "aln")
def h01_kmer_classes(i):
    return i.aln.select("gene_id", F.array_join(F.transform(similarity.kmer_classes(F.col("seq")), lambda x: x.cast("string")), "|").alias("classes"))


@query(f"WITH {KMERS} SELECT x.grp, x.gene_id AS a, y.gene_id AS b, round(1 - CASE WHEN len(x.k) = 0 AND len(y.k) = 0 THEN 1.0 ELSE len(list_intersect(x.k, y.k)) / greatest(1, len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))) END, 6) AS distance FROM k x JOIN k y ON x.grp = y.grp AND x.gene_id < y.gene_id", "aln")
def h02_h03_distances(i):
    return similarity.distances(spread(i.aln, "grp", rows=5_000))


@query()
def h04_h05_track_order(i):
    return similarity.track_order(i.aln)


#: A tree for each group: a chain of its members, each leaf as long as its part is large, each inner branch 1.
TREES = "tip AS (SELECT 'c' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS STRING) AS tree, CAST(p_partkey AS STRING) AS name, p_size + 1 AS len, row_number() OVER (PARTITION BY CAST(floor(p_partkey / 50) AS BIGINT) ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY CAST(floor(p_partkey / 50) AS BIGINT)) AS n FROM part)"


def trees(i, chain: bool):
    """(tree, newick): flat trees, or ((((a:1,b:1):1,c:1):1,...): chains."""
    name, size = F.col("p_partkey").cast("string"), (F.col("p_size") + 1).cast("string")
    grp = F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 50).cast("string"))
    tips = i.part.groupBy(grp.alias("tree")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws(":", name, size).alias("tip")))), lambda x: x["tip"]).alias("tips"))
    if not chain:
        return tips.select("tree", F.concat(F.lit("("), F.array_join("tips", ","), F.lit(");")).alias("newick"))
    rest = F.slice("tips", F.lit(2), F.greatest(F.size("tips") - 1, F.lit(0)))
    grown = F.aggregate(rest, F.concat(F.lit("("), F.element_at("tips", 1), F.lit(")")), lambda acc, t: F.concat(F.lit("("), acc, F.lit(":1,"), t, F.lit(")")))
    return tips.select("tree", F.concat(grown, F.lit(";")).alias("newick"))


@query(f"WITH {TREES} SELECT tree, CAST(k - 1 AS INT) AS rank, name AS leaf, (len + n - greatest(k, 1))::DOUBLE AS depth FROM tip")
def h11_leaf_order(i):
    return similarity.leaf_order(trees(i, chain=True))


@query("SELECT gene_id, replace(replace(seq, '.', ''), '-', '') AS plain, rpad(substr('HHEECC', 1, length(replace(seq, '-', ''))::INTEGER), length(replace(seq, '-', ''))::INTEGER, '-') AS fitted, translate(upper('he-C. b'), 'EC-. ', 'SLLLL') AS states FROM aln", "aln")
def p23_p24_m09_structures(i):
    return i.aln.select("gene_id", text.ungapped(F.col("seq")).alias("plain"), text.fitted_structure(F.lit("HHEECC"), F.col("seq")).alias("fitted"), text.three_states(F.lit("he-C. b")).alias("states"))
