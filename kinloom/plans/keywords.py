"""Queries of keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.functions.scratch import Workspace
from kinloom.functions.spread import spread
from kinloom.operators import keyword
from kinloom.operators.pick import pick
from kinloom.plans.clusters import GENES, genes
from kinloom.plans.registry import query

BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, species ORDER BY evalue IS NULL, evalue, pident IS NULL, pident DESC, ref_id) AS k FROM hit) WHERE k = 1)"
ROLLED = """usable AS (SELECT * FROM hit WHERE evalue IS NULL OR evalue <= 1e-5), sizes AS (SELECT pangene, count(DISTINCT gene_id) AS size FROM member GROUP BY pangene),
rolled AS (SELECT u.pangene, count(DISTINCT u.gene_id || ' ' || u.accession)::BIGINT AS matched_genes, count(DISTINCT u.ref_id)::BIGINT AS matched_refs, count(*)::BIGINT AS hit_rows, count(DISTINCT u.accession)::BIGINT AS genomes, min(u.evalue) AS min_evalue, max(u.pident) AS max_pident, any_value(s.size)::BIGINT AS size,
  round(100.0 * count(DISTINCT u.gene_id || ' ' || u.accession) / any_value(s.size), 6)::DOUBLE AS density_pct FROM usable u JOIN sizes s ON u.pangene = s.pangene GROUP BY u.pangene)"""
FOLDED = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
TERMS = f"terms AS (SELECT doc_id, {FOLDED.format('text')} AS t FROM documents), posts AS (SELECT term, doc_id, length, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::INTEGER AS length, unnest(t) AS term FROM terms) GROUP BY ALL)"


def rolled(i):
    sizes = i.member.groupBy("pangene").agg(F.count_distinct("gene_id").alias("size"))
    return keyword.rollup(keyword.usable_hits(i.hit), sizes)


@query(f"WITH {ROLLED} SELECT * FROM rolled", "hit", "member")
def a09_cluster_rollup(i):
    return rolled(i)


@query(f"WITH {ROLLED} SELECT pangene, min_evalue, density_pct, matched_genes FROM rolled ORDER BY coalesce(min_evalue, 1.0), density_pct DESC, matched_genes DESC, pangene LIMIT 100", "hit", "member")
def t01_ranked_clusters(i):
    return keyword.ranked(rolled(i)).select("pangene", "min_evalue", "density_pct", "matched_genes")


@query("WITH n AS (SELECT pangene, accession, count(*) AS n FROM hit GROUP BY 1, 2) SELECT pangene, string_agg(accession || ':' || CAST(n AS STRING), '|' ORDER BY n DESC, accession) AS by_genome FROM n GROUP BY pangene", "hit")
def a10_hits_by_genome(i):
    return keyword.hits_by_genome(i.hit)


@query(f"WITH {BEST} SELECT gene_id, species, ref_id, evalue, pident FROM best", "hit")
def g08_best_hits(i):
    return keyword.best_hits(i.hit).select("gene_id", "species", "ref_id", "evalue", "pident")


@query("SELECT gene_id, accession, species, ref_id, evalue FROM hit WHERE evalue IS NULL OR evalue <= 1e-5", "hit")
def x05_evalue_cutoff(i):
    return keyword.usable_hits(i.hit).select("gene_id", "accession", "species", "ref_id", "evalue")


@query("SELECT gene_id, species, ref_id, accession, evalue, pident FROM (SELECT *, row_number() OVER (PARTITION BY accession, gene_id, species, ref_id ORDER BY coalesce(evalue, -1) DESC, coalesce(pident, -1) DESC, pangene DESC) AS k FROM hit) WHERE k = 1", "hit")
def g07_last_hit_wins(i):
    last = pick(i.hit, ["accession", "gene_id", "species", "ref_id"], [F.coalesce("evalue", F.lit(-1.0)), F.coalesce("pident", F.lit(-1.0)), F.col("pangene")], last=True)
    return last.select("gene_id", "species", "ref_id", "accession", "evalue", "pident")


@query(f"WITH {GENES} SELECT h.gene_id, h.accession, h.ref_id, g.pangene FROM hit h JOIN genes g ON h.gene_id = g.gene_id AND h.accession = g.accession", "hit", "member")
def j11_j15_hits_in_active_clusters(i):
    return keyword.remapped(i.hit, genes(i)).select("gene_id", "accession", "ref_id", "pangene")


@query(f"""WITH {BEST}, d AS (SELECT p_name AS ref_id, min(p_brand || ' ' || p_type) AS description FROM part GROUP BY p_name), asked AS (SELECT DISTINCT 'LI' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber + 1 AS STRING) AS gene_id FROM lineitem), b AS (SELECT best.*, d.description FROM best JOIN d ON best.ref_id = d.ref_id)
SELECT a.gene_id, max(ref_id) FILTER (species = 'arabidopsis') AS arabidopsis_ref, max(ref_id) FILTER (species = 'rice') AS rice_ref, max(description) FILTER (species = 'arabidopsis') AS arabidopsis_description, max(description) FILTER (species = 'rice') AS rice_description FROM asked a LEFT JOIN b ON a.gene_id = b.gene_id GROUP BY a.gene_id""", "hit")
def x09_j10_annotations(i):
    refs = i.part.groupBy(F.col("p_name").alias("ref_id")).agg(F.min(F.concat_ws(" ", "p_brand", "p_type")).alias("description"))
    want = i.lineitem.select(F.concat(F.lit("LI"), F.col("l_orderkey").cast("string"), F.lit("."), (F.col("l_linenumber") + 1).cast("string")).alias("gene_id"))
    return keyword.annotations(want, i.hit, refs, ("arabidopsis", "rice"))


@query("SELECT DISTINCT p_name AS ref_id FROM part WHERE p_name IN (SELECT ref_id FROM hit WHERE species = 'rice')", "hit")
def j12_actionable_refs(i):
    hits = i.hit.filter("species = 'rice'")
    return i.part.select(F.col("p_name").alias("ref_id")).distinct().join(hits.select("ref_id").distinct(), "ref_id", "left_semi")


@query(f"WITH {TERMS} SELECT term, doc_id, length, tf FROM posts")
def x02_postings(i):
    return keyword.postings(i.documents, "doc_id", F.col("text")).select("term", "doc_id", "length", "tf")


BM25 = f"""{TERMS}, q AS (SELECT unnest(['th', 'er']) AS token), h AS (SELECT token, doc_id, length, sum(tf) AS tf FROM posts JOIN q ON starts_with(term, token) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM h GROUP BY token), w AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM posts)),
s AS (SELECT doc_id, round(sum(CASE WHEN df < n - df THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN df USING (token), w GROUP BY doc_id HAVING count(*) = 2)"""


@query(f"WITH {BM25} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 100")
def x03_t02_ranked_retrieval(i):
    return keyword.retrieved(keyword.postings(i.documents, "doc_id", F.col("text")), "doc_id", ["th", "er"], keyword.candidate_cap(25))


#: The columns of a reference gene that are searched, in order.
SEARCHED = ("symbols", "full_name", "description", "synonyms", "short", "curator", "computed")
REF_TERMS = "rt AS (SELECT ref_id, " + " || ".join(f"list_value({FOLDED.format(c)})" for c in SEARCHED) + " AS t FROM (SELECT *, ref_id || ' ' || symbols || ' Ünïted' AS synonyms FROM ref))"


def searched_refs(i):
    refs = spread(i.ref, "ref_id").withColumn("synonyms", F.concat("ref_id", F.lit(" "), "symbols", F.lit(" Ünïted")))
    return keyword.postings(refs, "ref_id", *map(F.col, SEARCHED))


@query(f"WITH {REF_TERMS} SELECT term, ref_id, length, count(*)::BIGINT AS tf FROM (SELECT ref_id, len(flatten(t))::INTEGER AS length, unnest(flatten(t)) AS term FROM rt) GROUP BY ALL", "ref")
def x02_reference_postings(i):
    return searched_refs(i).select("term", "ref_id", "length", "tf")


@query(f"WITH {REF_TERMS}, p AS (SELECT DISTINCT ref_id, unnest(flatten(t)) AS term FROM rt) SELECT ref_id FROM p WHERE starts_with(term, 'widg') INTERSECT SELECT ref_id FROM p WHERE starts_with(term, 'uni')", "ref")
def x03_stored_index_search(i):
    work = Workspace(i.spark, "postings")
    keyword.stored_postings(searched_refs(i), work.path("postings"))
    return keyword.retrieved(i.spark.read.parquet(work.path("postings")), "ref_id", ["WIDG", "uni"], 2**31 - 1).select("ref_id")


def alias_kinds(i):
    return keyword.alias_rows(i.ref, {"id": F.array("ref_id"), "symbol": F.split("symbols", " "), "name": F.split("full_name", r"\|")})


ALIASES = "aliases AS (SELECT DISTINCT lower(trim(alias)) AS alias_norm, ref_id, kind FROM (SELECT ref_id AS alias, ref_id, 'id' AS kind FROM ref UNION ALL SELECT unnest(string_split(symbols, ' ')), ref_id, 'symbol' FROM ref UNION ALL SELECT unnest(string_split(full_name, '|')), ref_id, 'name' FROM ref) WHERE trim(alias) <> '')"


@query(f"WITH {ALIASES} SELECT * FROM aliases", "ref")
def x01_alias_rows(i):
    return alias_kinds(i)


@query(f"WITH {ALIASES} SELECT DISTINCT ref_id FROM aliases WHERE alias_norm IN ('red widget', 'red', 'widget')", "ref")
def x04_p08_alias_tier(i):
    terms = i.spark.sql("SELECT 'Red  widget' AS q").select(F.explode(text.alias_terms(F.regexp_replace("q", " +", " "))).alias("alias_norm"))
    return alias_kinds(i).join(F.broadcast(terms), "alias_norm", "left_semi").select("ref_id").distinct()


@query(f"""WITH {ALIASES}, tiers AS (SELECT ref_id, min(tier) AS tier FROM (SELECT ref_id, 0 AS tier FROM aliases WHERE alias_norm = 'ring' UNION ALL SELECT ref_id, 1 FROM ref WHERE contains(description, 'widget') UNION ALL SELECT '17', 2) GROUP BY ref_id),
have AS (SELECT DISTINCT CAST(l_partkey AS STRING) AS ref_id FROM lineitem WHERE l_suppkey < 50), top AS (SELECT ref_id, tier, row_number() OVER (ORDER BY tier, ref_id) AS rank FROM tiers WHERE tier < 2 AND ref_id IN (SELECT ref_id FROM have) ORDER BY tier, ref_id LIMIT 25)
SELECT ref_id, CASE tier WHEN 0 THEN 'alias' ELSE 'text' END AS kind, CAST(rank AS INT) AS rank FROM top UNION ALL SELECT ref_id, 'selected', 26 FROM (SELECT '17' AS ref_id) WHERE ref_id IN (SELECT ref_id FROM have) AND ref_id NOT IN (SELECT ref_id FROM top)""", "ref")
def t03_x06_matched_refs(i):
    alias_hits = alias_kinds(i).filter("alias_norm = 'ring'").select("ref_id").distinct()
    text_hits = i.ref.filter(F.contains("description", F.lit("widget"))).select("ref_id", F.lit(0.0).alias("score"))
    hits = i.lineitem.filter("l_suppkey < 50").select(F.col("l_partkey").cast("string").alias("ref_id"))
    chosen = i.spark.sql("SELECT '17' AS ref_id")
    return keyword.matched_refs(alias_hits, text_hits, hits, 25, chosen)


@query("""WITH c AS (SELECT ref_id, species, CASE WHEN symbols = full_name THEN symbols ELSE symbols || '|' || full_name END AS names, CASE WHEN species = 'arabidopsis' THEN symbols || '. ' || CASE WHEN curator = '' THEN computed ELSE curator || '. ' || computed END ELSE trim(description) END AS whole FROM long),
f AS (SELECT *, CASE WHEN strpos(lower(whole), 'of br') > 0 THEN strpos(lower(whole), 'of br') ELSE strpos(lower(whole), 'widget') END AS spot FROM c), e AS (SELECT *, greatest(0, spot - 47) AS b, least(length(whole), spot + 139) AS e FROM f)
SELECT ref_id, species, names, whole, CASE WHEN spot = 0 THEN left(whole, 140) || CASE WHEN length(whole) > 140 THEN '...' ELSE '' END ELSE CASE WHEN b > 0 THEN '...' ELSE '' END || substr(whole, b + 1, e - b) || CASE WHEN e < length(whole) THEN '...' ELSE '' END END AS snippet FROM e""".replace("FROM long)", "FROM (SELECT ref_id, species, symbols, full_name, description || repeat(' ' || full_name, 9) AS description, curator, computed || repeat(' ' || symbols, 12) AS computed FROM ref))"), "ref")
def x07_p09_p10_reference_cards(i):
    refs = i.ref.withColumn("description", F.concat("description", F.repeat(F.concat(F.lit(" "), "full_name"), F.lit(9)))).withColumn("computed", F.concat("computed", F.repeat(F.concat(F.lit(" "), "symbols"), F.lit(12))))
    return keyword.cards(refs, ["of br", "Widget"])


SELECTED = """chosen AS (SELECT * FROM hit WHERE upper(ref_id) IN (SELECT DISTINCT upper(p_name) FROM part WHERE p_partkey IN (3, 5, 11)) AND (evalue IS NULL OR evalue <= 1e-5)), mapped AS (SELECT c.* EXCLUDE (pangene), g.pangene FROM chosen c JOIN genes g ON c.gene_id = g.gene_id AND c.accession = g.accession),
sizes AS (SELECT pangene, count(*) AS size FROM member GROUP BY pangene), per AS (SELECT pangene, count(DISTINCT gene_id || ' ' || accession)::BIGINT AS matched_genes, count(DISTINCT ref_id)::BIGINT AS matched_refs, count(*)::BIGINT AS hit_rows, min(evalue) AS min_evalue FROM mapped GROUP BY pangene), n AS (SELECT pangene, accession, count(*) AS n FROM mapped GROUP BY 1, 2),
b AS (SELECT pangene, string_agg(accession || ':' || CAST(n AS STRING), '|' ORDER BY n DESC, accession) AS by_genome FROM n GROUP BY pangene)"""


@query(f"WITH {GENES}, {SELECTED} SELECT per.pangene, matched_genes, matched_refs, hit_rows, size::BIGINT AS size, round(100.0 * matched_genes / size, 2)::DOUBLE AS density_pct, by_genome, CASE WHEN min_evalue IS NULL THEN '—' WHEN min_evalue = 0 THEN '0' WHEN min_evalue >= 0.01 THEN printf('%.4g', min_evalue) ELSE printf('%.2e', min_evalue) END AS min_evalue_label FROM per JOIN sizes USING (pangene) JOIN b USING (pangene) ORDER BY coalesce(min_evalue, 1.0), matched_genes / size DESC, matched_genes DESC, per.pangene LIMIT 100", "hit", "member")
def x08_selected_groups(i):
    chosen = [r.p_name for r in i.part.filter("p_partkey IN (3, 5, 11)").select("p_name").distinct().collect()]
    sizes = i.member.groupBy("pangene").agg(F.count("*").alias("size"))
    out = keyword.selected_groups(i.hit, [c.upper() for c in chosen], genes(i), sizes)
    return out.select("pangene", "matched_genes", "matched_refs", "hit_rows", "size", "density_pct", "by_genome", "min_evalue_label")


@query("SELECT d.p_brand AS brand, max(len(d.p_name))::INTEGER AS longest, first(d.p_name ORDER BY len(d.p_name) DESC, d.p_partkey) AS p_name FROM part d GROUP BY 1")
def g02_g04_longest_description(i):
    out = keyword.longest(i.part.select("p_brand", "p_name", "p_partkey"), "p_brand", F.col("p_name"), [F.col("p_partkey")])
    return out.select(F.col("p_brand").alias("brand"), F.length("p_name").alias("longest"), "p_name")


@query("WITH f AS (SELECT p_type, p_name, min(p_partkey) AS first FROM part GROUP BY 1, 2) SELECT p_type, string_agg(p_name, '|' ORDER BY first, p_name) AS p_name FROM f GROUP BY p_type")
def g03_ordered_symbols(i):
    return keyword.ordered_distinct(i.part, "p_type", "p_name", "p_partkey")


@query("SELECT coalesce(d.locus, a.locus) AS locus, d.description, a.symbol FROM (SELECT p_partkey AS locus, p_name AS description FROM part WHERE p_partkey % 3 <> 0) d FULL JOIN (SELECT p_partkey AS locus, p_brand AS symbol FROM part WHERE p_partkey % 2 = 0) a ON d.locus = a.locus")
def j17_descriptions_full_aliases(i):
    p = i.part.withColumnRenamed("p_partkey", "locus")
    return keyword.merged_refs(p.filter("locus % 3 <> 0").select("locus", F.col("p_name").alias("description")), p.filter("locus % 2 = 0").select("locus", F.col("p_brand").alias("symbol")), "locus")


@query("SELECT d.locus, d.description, a.symbol FROM (SELECT p_partkey AS locus, p_name AS description FROM part WHERE p_partkey % 3 <> 0) d LEFT JOIN (SELECT p_partkey AS locus, p_brand AS symbol FROM part WHERE p_partkey % 2 = 0) a ON d.locus = a.locus")
def j18_descriptions_left_symbols(i):
    p = i.part.withColumnRenamed("p_partkey", "locus")
    return keyword.merged_refs(p.filter("locus % 3 <> 0").select("locus", F.col("p_name").alias("description")), p.filter("locus % 2 = 0").select("locus", F.col("p_brand").alias("symbol")), "locus", "left")


@query("WITH t AS (SELECT l_suppkey AS acc, min(l_partkey % 4) AS ds FROM lineitem GROUP BY 1) SELECT acc, ds FROM t")
def j16_owner_of_accession(i):
    rows = i.lineitem.select(F.col("l_suppkey").alias("acc"), (F.col("l_partkey") % 4).alias("ds"))
    return pick(rows, ["acc"], [F.col("ds")]).select("acc", "ds")
