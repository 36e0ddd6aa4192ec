"""Queries of the expressions that other operators are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import ids, numbers, text
from kinloom.operators import members
from kinloom.plans.registry import query

#: Ids of all shapes, made from a key: with and without bars, transcripts, prefixes of species.
ID_SQL = "CASE p_partkey % 9 WHEN 0 THEN 'A|' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'A|' WHEN 3 THEN 'A|b|' || p_brand WHEN 4 THEN ' x.' || CAST(p_size AS STRING) || ' ' WHEN 5 THEN 'HORVU.MOREX.r3.' || CAST(p_size AS STRING) WHEN 6 THEN 'TraesCS' || CAST(p_size AS STRING) || 'A.2' WHEN 7 THEN 'avesa.' || p_brand ELSE 'AT1G' || lpad(CAST(p_partkey AS STRING), 5, '0') || '.' || CAST(p_size AS STRING) END"


@query(rf"""SELECT p_partkey, s, coalesce(nullif(regexp_extract(s, '^[^|]*\|\s*(.*\S)\s*$', 1), ''), trim(s)) AS canonical, lower(regexp_replace(trim(s), '\.\d+$', '')) AS normalised, CASE WHEN len(string_split(s, '.')) >= 3 THEN string_split(s, '.')[2] ELSE s END AS accession,
CASE WHEN regexp_matches(s, '(?i)^HORVU\.') THEN 'barley' WHEN regexp_matches(s, '(?i)^TraesCS') THEN 'wheat' WHEN regexp_matches(s, '(?i)^AVESA\.') THEN 'oat' END AS species FROM (SELECT p_partkey, {ID_SQL} AS s FROM part)""")
def p05_identifier_rules(i):
    c = F.col("s")
    return i.part.selectExpr("p_partkey", f"{ID_SQL} AS s").select("p_partkey", "s", ids.canonical_id(c).alias("canonical"), ids.normalised_id(c).alias("normalised"), ids.dotted_accession(c).alias("accession"), members.route(c).alias("species"))


@query(r"""SELECT chr, regexp_replace(chr, '^chr', '') AS name, coalesce(nullif(regexp_extract(upper(chr), '^CHR[0-9]+([ABCD])$', 1), ''), NULL) AS subgenome, nullif(regexp_extract(chr, '(?i)^(?:chr)?([0-9]+)[ABCDH]$', 1), '') AS grp, strand, strand = '-' AS is_minus FROM coord GROUP BY ALL""", "coord")
def p17_p18_p19_chromosomes(i):
    c = F.col("chr")
    return i.coord.select("chr", "strand").distinct().select("chr", ids.chromosome(c).alias("name"), ids.subgenome(c).alias("subgenome"), ids.chromosome_group(c).alias("grp"), "strand", ids.minus(F.col("strand")).alias("is_minus"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[;:{}()*<>''\"`\\|?%#=\[\]^$@!~/&+]', '', 'g')) AS cleaned FROM documents")
def p04_cleaned_queries(i):
    return i.documents.select("doc_id", text.cleaned_query(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9]{2,}'), ' ') AS tokens FROM documents")
def p06_tokens(i):
    return i.documents.select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT p_partkey, (('0x' || substr(md5(p_name), 1, 4))::INT) % 77 AS slot FROM part")
def p21_palette_slots(i):
    return i.part.select("p_partkey", text.palette_slot(F.col("p_name")).alias("slot"))


MISSING_SQL = "CASE o_orderkey % 7 WHEN 0 THEN ' NA ' WHEN 1 THEN 'None' WHEN 2 THEN '1,' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '.5' WHEN 3 THEN o_orderstatus WHEN 4 THEN '.' WHEN 5 THEN ' ' || CAST(o_custkey AS STRING) ELSE o_orderpriority END"
PRESENT = "CASE WHEN lower(trim(s)) IN ('null', 'none', 'na', 'n/a', '.') THEN '' ELSE trim(s) END"


@query(f"SELECT o_orderkey, {PRESENT} AS present, TRY_CAST(replace({PRESENT}, ',', '') AS DOUBLE) AS number FROM (SELECT o_orderkey, {MISSING_SQL} AS s FROM orders)")
def p12_p13_missing_values(i):
    return i.orders.selectExpr("o_orderkey", f"{MISSING_SQL} AS s").select("o_orderkey", text.present(F.col("s")).alias("present"), text.number(F.col("s")).alias("number"))


LISTED_SQL = "p_brand || CASE p_partkey % 4 WHEN 0 THEN ', ' WHEN 1 THEN ';' WHEN 2 THEN ' | ' ELSE '/' END || replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN ',' WHEN 1 THEN ' ' ELSE ' ;;' END) || '; ' || p_brand"


@query(f"""WITH r AS (SELECT p_partkey, {LISTED_SQL} AS s FROM part), u AS (SELECT p_partkey, unnest(string_split_regex(s, '[,;|/]')) AS x, unnest(range(0, len(string_split_regex(s, '[,;|/]')))) AS pos FROM r),
f AS (SELECT p_partkey, trim(x) AS x, min(pos) AS pos FROM u WHERE trim(x) <> '' GROUP BY ALL) SELECT p_partkey, string_agg(x, '|' ORDER BY pos) AS listed FROM f GROUP BY p_partkey""")
def p14_p15_synonyms(i):
    return i.part.selectExpr("p_partkey", f"{LISTED_SQL} AS s").select("p_partkey", text.piped(text.listed(F.col("s"))).alias("listed"))


@query("SELECT p_partkey, CAST(greatest(1, least(15, p_size)) AS INT) AS clamped FROM part")
def p20_clamps(i):
    return i.part.select("p_partkey", numbers.clamped(F.col("p_size"), 1, 15).alias("clamped"))


SCORE_SQL = "CASE l_linenumber % 6 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN l_discount / 1000 WHEN 2 THEN l_discount WHEN 3 THEN l_quantity * 1000 WHEN 4 THEN l_tax / 100000000000 ELSE l_quantity + l_discount END"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN e IS NULL THEN '—' WHEN e = 0 THEN '0' WHEN e >= 0.01 THEN printf('%.4g', e) ELSE printf('%.2e', e) END AS evalue, CASE WHEN p IS NULL THEN '—' ELSE printf('%.1f%%', p) END AS identity,
CASE WHEN e IS NULL THEN '' WHEN e < 0.01 THEN regexp_replace(printf('%.2e', e), 'e([+-])0([0-9])$', 'e\\1\\2') WHEN e < 1 THEN printf('%.3f', e) ELSE printf('%.2f', e) END AS fdr
FROM (SELECT *, {SCORE_SQL} AS e, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax * 100 END AS p FROM lineitem)""")
def p11_p31_labels(i):
    rows = i.lineitem.selectExpr("*", f"{SCORE_SQL} AS e", "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax * 100 END AS p")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.evalue_label(F.col("e")).alias("evalue"), text.identity_label(F.col("p")).alias("identity"), text.fdr_label(F.col("e")).alias("fdr"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN '\"' || p_name || chr(9) || replace(p_brand, '#', '\"\"') || '\"' ELSE '' END AS cell FROM part")
def p31_quoted_cells(i):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("\t"), F.replace("p_brand", F.lit("#"), F.lit('"'))))
    return i.part.select("p_partkey", text.quoted_cell(raw).alias("cell"))


@query("SELECT l_orderkey % 100 AS k, 'c' || CAST(l_partkey % 5 AS STRING) AS chr, 'g' || CAST(l_partkey AS STRING) AS gene_id, l_partkey AS begin_pos, l_partkey + 5 AS end_pos FROM lineitem")
def s28_packed_genes(i):
    packed = F.concat_ws("__", F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string")), F.concat(F.lit("g"), F.col("l_partkey").cast("string")), F.col("l_partkey").cast("string"), (F.col("l_partkey") + 5).cast("string"))
    return i.lineitem.select((F.col("l_orderkey") % 100).alias("k"), ids.packed_gene(packed).alias("g")).select("k", "g.chr", "g.gene_id", "g.begin_pos", "g.end_pos")


SPECIES_SQL = "CASE p_partkey % 4 WHEN 0 THEN 'wheat' WHEN 1 THEN 'barley' WHEN 2 THEN 'oat' ELSE 'rye' END"


@query(f"SELECT p_partkey, CASE s WHEN 'wheat' THEN CASE WHEN p_size % 2 = 0 THEN 'Traes_' ELSE 'TRAES_' END WHEN 'barley' THEN 'HORVU_' WHEN 'oat' THEN 'Avena_' ELSE '' END || CASE WHEN p_size % 3 = 0 AND s <> 'oat' THEN 'pan_' ELSE 'pan' END || p_name AS cluster, CASE s WHEN 'wheat' THEN 0 WHEN 'barley' THEN 1 WHEN 'oat' THEN 2 ELSE 3 END AS tab FROM (SELECT *, {SPECIES_SQL} AS s FROM part)")
def p29_t10_cluster_names(i):
    s = F.col("s")
    had = F.when((s == "wheat") & (F.col("p_size") % 2 == 1), "TRAES_").otherwise("")
    return i.part.selectExpr("*", f"{SPECIES_SQL} AS s").select("p_partkey", ids.cluster_id(s, F.concat(had, F.when(F.col("p_size") % 3 == 0, "pan_").otherwise("pan"), "p_name")).alias("cluster"), ids.species_tab(s).alias("tab"))


@query("SELECT p_partkey, replace(p_name, '*', '') AS protein, rtrim(upper(p_name || '**'), '*') AS coding FROM part")
def s07_clean_sequences(i):
    return i.part.select("p_partkey", text.protein(F.col("p_name")).alias("protein"), text.coding(F.concat("p_name", F.lit("**"))).alias("coding"))
