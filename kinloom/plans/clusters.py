"""Queries on clusters and their members."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import ids
from kinloom.operators import coords, members
from kinloom.operators.pick import prioritised_lookup
from kinloom.plans.registry import query

GENES = "genes AS (SELECT gene_id, pangene, accession FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY src, pangene, accession) AS k FROM member) WHERE k = 1)"
PLACED = r"""placed AS (SELECT gene_id, accession, regexp_replace(chr, '^chr', '') AS chr, begin_pos, end_pos, strand, nullif(regexp_extract(chr, '^chr[0-9]+([ABCD])$', 1), '') AS subgenome
  FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, accession ORDER BY src DESC, begin_pos DESC, end_pos DESC, chr DESC, strand DESC) AS k FROM coord) WHERE k = 1)"""


def genes(i):
    return members.genes(i.member, [F.col("src"), F.col("pangene"), F.col("accession")]).select("gene_id", "pangene", "accession")


def placed(i):
    order = [F.col(c) for c in ("src", "begin_pos", "end_pos", "chr", "strand")]
    return coords.placed(i.coord, order).select("gene_id", "accession", "chr", "begin_pos", "end_pos", "strand", "subgenome")


def member_places(i):
    """Members with the places of their accession; about half have none under the accession that they go by here."""
    g = genes(i).withColumn("accession", F.concat(F.lit("acc"), (F.substring("accession", 4, 10).cast("int") % 20).cast("string")))
    return members.with_places(g, placed(i))


@query("""WITH every AS (SELECT gene_id, accession, src FROM coord UNION ALL SELECT 'LI' || CAST(l_orderkey + 32 AS STRING) || '.' || CAST(l_linenumber AS STRING), 'acc' || CAST(l_partkey % 10 AS STRING), l_shipdate FROM lineitem),
o AS (SELECT gene_id, accession FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY src DESC, accession DESC) AS k FROM every) WHERE k = 1) SELECT m.gene_id, m.pangene, o.accession FROM member m JOIN o ON m.gene_id = o.gene_id""", "member", "coord")
def j01_located_members(i):
    """Many genes have coordinates in two accessions; the later source has them."""
    other = i.lineitem.selectExpr("concat('LI', l_orderkey + 32, '.', l_linenumber) gene_id", "concat('acc', l_partkey % 10) accession", "l_shipdate src")
    every = i.coord.select("gene_id", "accession", "src").unionByName(other)
    return members.located(i.member.select("gene_id", "pangene"), coords.owners(every, [F.col("src"), F.col("accession")]))


@query(f"WITH {GENES} SELECT gene_id, pangene, accession FROM genes", "member")
def g01_first_cluster_wins(i):
    return genes(i)


@query(f"WITH {PLACED} SELECT * FROM placed", "coord")
def g05_last_coordinates_win(i):
    return placed(i)


@query("SELECT pangene, count(*)::BIGINT AS gene_count, count(DISTINCT gene_id)::BIGINT AS distinct_gene_count FROM member GROUP BY pangene", "member")
def a01_cluster_sizes(i):
    return members.cluster_sizes(i.member)


@query("SELECT pangene, count(*)::BIGINT AS n FROM member WHERE pangene IN ('pan00001', 'pan00002', 'pan00500') GROUP BY pangene", "member")
def a02_sizes_of_some(i):
    return i.member.filter(F.col("pangene").isin("pan00001", "pan00002", "pan00500")).groupBy("pangene").agg(F.count("*").alias("n"))


@query(f"WITH {GENES} SELECT count(DISTINCT accession)::BIGINT AS accessions, count(DISTINCT pangene)::BIGINT AS pan_genes, count(*)::BIGINT AS genes FROM genes", "member")
def a03_statistics(i):
    return members.statistics(genes(i))


@query(f"WITH {GENES}, info AS (SELECT pangene, count(*) AS gene_count FROM member WHERE pangene < 'pan01000' GROUP BY pangene) SELECT g.gene_id, g.pangene, g.accession, coalesce(i.gene_count, count(*) OVER (PARTITION BY g.pangene))::BIGINT AS size FROM genes g LEFT JOIN info i ON g.pangene = i.pangene", "member")
def j09_a04_stored_or_counted_size(i):
    info = i.member.filter("pangene < 'pan01000'").groupBy("pangene").agg(F.count("*").alias("gene_count"))
    return members.with_size(genes(i), info).select("gene_id", "pangene", "accession", "size")


@query(f"WITH {GENES}, {PLACED} SELECT g.gene_id, g.pangene, p.accession, p.chr, p.begin_pos, p.end_pos FROM genes g LEFT JOIN placed p ON g.gene_id = p.gene_id AND 'acc' || CAST(CAST(substr(g.accession, 4) AS INT) % 10 AS STRING) = p.accession", "member", "coord")
def j02_members_with_places(i):
    g = genes(i).withColumn("accession", F.concat(F.lit("acc"), (F.substring("accession", 4, 10).cast("int") % 10).cast("string")))
    c = placed(i).select("gene_id", F.col("accession").alias("acc2"), "chr", "begin_pos", "end_pos")
    out = g.join(c, (g["gene_id"] == c["gene_id"]) & (g["accession"] == c["acc2"]), "left")
    return out.select(g["gene_id"], "pangene", F.col("acc2").alias("accession"), "chr", "begin_pos", "end_pos")


ASKED = "asked AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'LI' || CAST(l_orderkey AS STRING) WHEN 1 THEN 'LI' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) ELSE 'LI' || CAST(l_orderkey AS STRING) || '.77' END AS asked FROM lineitem)"


def asked(i):
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    name = F.when(n % 3 == 0, F.concat(F.lit("LI"), k)).when(n % 3 == 1, F.concat(F.lit("LI"), k, F.lit("."), n.cast("string"))).otherwise(F.concat(F.lit("LI"), k, F.lit(".77")))
    return i.lineitem.select(name.alias("asked")).distinct()


@query(f"""WITH {GENES}, {ASKED}, v AS (SELECT asked, 0 AS pos, asked AS key FROM asked UNION ALL SELECT asked, 1, CASE WHEN regexp_matches(asked, '\\.[0-9]+$') THEN regexp_replace(asked, '\\.[0-9]+$', '') ELSE asked || '.1' END FROM asked),
h AS (SELECT v.asked, g.gene_id, g.pangene, row_number() OVER (PARTITION BY v.asked ORDER BY v.pos) AS k FROM v JOIN genes g ON g.gene_id = v.key)
SELECT a.asked, h.gene_id, h.pangene FROM asked a LEFT JOIN h ON a.asked = h.asked AND h.k = 1""", "member")
def j04_j05_lookup_by_variants(i):
    return prioritised_lookup(asked(i), genes(i).select("gene_id", "pangene"), ids.id_variants(F.col("asked")), F.col("gene_id"))


@query(f"""WITH {PLACED}, {ASKED}, w AS (SELECT asked, 'ACC3' AS accession FROM asked), v AS (SELECT asked, accession, 0 AS pos, asked AS key FROM w UNION ALL SELECT asked, accession, 1, CASE WHEN regexp_matches(asked, '\\.[0-9]+$') THEN regexp_replace(asked, '\\.[0-9]+$', '') ELSE asked || '.1' END FROM w),
h AS (SELECT v.asked, p.gene_id, p.chr, p.begin_pos, row_number() OVER (PARTITION BY v.asked ORDER BY v.pos) AS k FROM v JOIN placed p ON p.gene_id = v.key AND lower(p.accession) = lower(v.accession))
SELECT a.asked, h.gene_id, h.chr, h.begin_pos FROM asked a LEFT JOIN h ON a.asked = h.asked AND h.k = 1""", "coord")
def j03_places_by_variants(i):
    want = asked(i).withColumn("acc", F.lit("acc3"))
    table = placed(i).select("gene_id", "chr", "begin_pos", F.lower("accession").alias("acc_of"))
    out = prioritised_lookup(want, table, ids.id_variants(F.col("asked")), F.col("gene_id"), [("acc", "acc_of")])
    return out.select("asked", "gene_id", "chr", "begin_pos")


@query(f"WITH {GENES} SELECT gene_id, pangene, accession FROM genes WHERE lower(gene_id) = 'li100.1' OR (NOT EXISTS (SELECT 1 FROM genes WHERE lower(gene_id) = 'li100.1') AND contains(lower(gene_id), 'li100.1')) ORDER BY gene_id LIMIT 200", "member")
def p01_p03_exact_search(i):
    return members.search(genes(i), "Li100.1").select("gene_id", "pangene", "accession")


@query(f"WITH {GENES} SELECT gene_id, pangene, accession FROM genes WHERE contains(lower(gene_id), 'li10') ORDER BY gene_id LIMIT 200", "member")
def p02_t05_partial_search(i):
    return members.search(genes(i), "LI10").select("gene_id", "pangene", "accession")


@query(f"WITH {GENES} SELECT gene_id, pangene FROM genes WHERE contains(lower(gene_id), 'li12') ORDER BY gene_id LIMIT 15", "member")
def t04_suggestions(i):
    return members.suggestions(genes(i), "Li12").select("gene_id", "pangene")


WITH_PLACES = f"{GENES}, {PLACED}, held AS (SELECT gene_id, pangene, 'acc' || CAST(CAST(substr(accession, 4) AS INT) % 20 AS STRING) AS accession FROM genes)"
COUNTS = f"""{WITH_PLACES}, counts AS (SELECT g.pangene, count(*) FILTER (p.subgenome = 'A') AS n_a, count(*) FILTER (p.subgenome = 'B') AS n_b, count(*) FILTER (p.subgenome = 'D') AS n_d, count(*) FILTER (coalesce(p.subgenome, '?') NOT IN ('A', 'B', 'D')) AS n_other
  FROM held g LEFT JOIN placed p ON g.gene_id = p.gene_id AND g.accession = p.accession GROUP BY g.pangene), dom AS (SELECT *, CASE WHEN greatest(n_a, n_b, n_d) = 0 THEN '?' WHEN n_a >= n_b AND n_a >= n_d THEN 'A' WHEN n_b >= n_d THEN 'B' ELSE 'D' END AS dominant FROM counts)"""


@query(f"WITH {COUNTS} SELECT * FROM dom", "member", "coord")
def a05_subgenome_counts(i):
    return members.subgenome_counts(member_places(i))


@query(f"WITH {COUNTS} SELECT CAST(substr(pangene, 4) AS INT) // 3 AS family, (count(*) = 3 AND string_agg(dominant, '' ORDER BY dominant) = 'ABD') AS triad, count(*)::BIGINT AS clusters FROM dom GROUP BY 1", "member", "coord")
def a06_triads(i):
    counts = members.subgenome_counts(member_places(i)).withColumn("family", F.floor(F.substring("pangene", 4, 9).cast("int") / 3).cast("int"))
    return members.triads(counts, "family").select("family", "triad", "clusters")


@query(f"""WITH {WITH_PLACES}, r AS (SELECT g.pangene, g.gene_id, p.chr, coalesce(p.subgenome, '?') AS bucket, row_number() OVER (PARTITION BY g.pangene ORDER BY g.accession, g.gene_id) AS k, count(*) OVER (PARTITION BY g.pangene) AS total FROM held g LEFT JOIN placed p ON g.gene_id = p.gene_id AND g.accession = p.accession),
m AS (SELECT pangene, string_agg(gene_id, '|' ORDER BY gene_id) AS missing FROM r WHERE k <= 600 AND chr IS NULL GROUP BY pangene)
SELECT r.pangene, bucket, string_agg(gene_id, '|' ORDER BY k) AS genes, count(*)::BIGINT AS n, coalesce(any_value(m.missing), '') AS missing, any_value(total)::BIGINT AS total, least(600, any_value(total))::BIGINT AS shown, any_value(total) > 600 AS truncated FROM r LEFT JOIN m ON r.pangene = m.pangene WHERE k <= 600 GROUP BY r.pangene, bucket""", "member", "coord")
def a07_partitioned_members(i):
    return members.partitioned(member_places(i))


@query(f"WITH {COUNTS} SELECT pangene, dominant, n_a, n_b, n_d, n_other, pangene = 'pan00007' AS is_current FROM dom", "member", "coord")
def a08_cluster_picker(i):
    now = F.col("pangene") == "pan00007"
    return members.subgenome_counts(member_places(i)).select("pangene", "dominant", "n_a", "n_b", "n_d", "n_other", now.alias("is_current")).orderBy(F.desc("is_current"), "pangene")


@query(f"WITH {PLACED} SELECT accession, count(*)::BIGINT AS genes, count(*) FILTER (subgenome = 'A') AS genes_a, count(*) FILTER (subgenome = 'B') AS genes_b, count(*) FILTER (subgenome = 'D') AS genes_d, count(*) FILTER (subgenome IS NULL) AS genes_unplaced FROM placed GROUP BY accession", "coord")
def a19_accession_counts(i):
    return members.accession_counts(placed(i))


@query(f"WITH {GENES}, r AS (SELECT *, row_number() OVER (PARTITION BY pangene ORDER BY CASE WHEN lower(gene_id) = 'li7.2' THEN 0 WHEN contains(lower(gene_id), 'li7.2') THEN 1 ELSE 2 END, gene_id, accession) AS k FROM (SELECT gene_id, pangene, accession FROM genes)) SELECT pangene, gene_id, accession FROM r WHERE k = 1", "member")
def g11_focal_gene(i):
    return members.focal(genes(i), "Li7.2").select("pangene", "gene_id", "accession")


@query(f"WITH {GENES} SELECT pangene, min(gene_id) AS gene_id FROM genes WHERE gene_id IN (SELECT gene_id FROM coord WHERE accession = 'acc3') GROUP BY pangene", "member", "coord")
def g12_first_with_coordinates(i):
    return members.first_with_coords(genes(i), i.coord.filter("accession = 'acc3'"))


@query(f"WITH {GENES} SELECT DISTINCT gene_id FROM genes WHERE regexp_replace(lower(accession), '[^a-z0-9]', '', 'g') = 'acc42'", "member")
def p22_reference_genes(i):
    return members.reference_genes(genes(i), "acc42", strip=True)


@query(f"WITH {GENES} SELECT a.pos, g.gene_id, g.accession FROM (VALUES (0, 'LI5.3'), (1, 'LI1.1'), (2, 'nothing'), (3, 'LI2.2'), (4, 'LI7.1')) a(pos, gene_id) JOIN genes g ON a.gene_id = g.gene_id", "member")
def j32_requested_in_order(i):
    want = i.spark.createDataFrame([(0, "LI5.3"), (1, "LI1.1"), (2, "nothing"), (3, "LI2.2"), (4, "LI7.1")], "pos int, gene_id string")
    return members.restricted(genes(i), want).select("pos", "gene_id", "accession")


@query(f"WITH {GENES}, {PLACED} SELECT g.gene_id || chr(9) || g.accession || chr(9) || coalesce(p.chr, '') || chr(9) || coalesce(CAST(p.begin_pos AS STRING), '') || chr(9) || coalesce(CAST(p.end_pos AS STRING), '') AS line FROM genes g LEFT JOIN placed p ON g.gene_id = p.gene_id AND g.accession = p.accession", "member", "coord")
def k02_gene_list(i):
    return members.gene_list(genes(i), placed(i))


@query(f"WITH {GENES} SELECT gene_id, pangene, accession FROM genes WHERE pangene = 'pan00011' ORDER BY accession, gene_id", "member")
def t06_members_in_order(i):
    return genes(i).filter("pangene = 'pan00011'").orderBy("accession", "gene_id")


@query(f"WITH {WITH_PLACES} SELECT g.gene_id, g.accession, CASE p.subgenome WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'D' THEN 2 ELSE 3 END AS ordinal FROM held g LEFT JOIN placed p ON g.gene_id = p.gene_id AND g.accession = p.accession", "member", "coord")
def t07_by_subgenome(i):
    sg = F.col("subgenome")
    o = F.when(sg == "A", 0).when(sg == "B", 1).when(sg == "D", 2).otherwise(3)
    return member_places(i).select("gene_id", "accession", o.alias("ordinal")).orderBy("ordinal", "gene_id")
