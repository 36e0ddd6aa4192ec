"""Further queries: lookups through stored maps, readers of annotation and expression files, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import ids, text
from kinloom.functions.scratch import Workspace
from kinloom.functions.spread import spread
from kinloom.operators import alignment, dedup, expression, keyword, similarity, sinks
from kinloom.operators.pick import pick, prioritised_lookup
from kinloom.plans.alignments import KMERS, TREES, trees
from kinloom.plans.expressions import STATS
from kinloom.plans.files import path
from kinloom.plans.graphs import KEYED
from kinloom.plans.keywords import FOLDED
from kinloom.plans.registry import query
from kinloom.sources import annotations, genomes, lines


@query(f"WITH {KEYED}, r AS (SELECT uniq_id, seq, row_number() OVER (PARTITION BY uniq_id ORDER BY id) AS k FROM keyed) SELECT k.id, r.seq FROM keyed k JOIN r ON k.uniq_id = r.uniq_id AND r.k = 1", "doc")
def j06_sequences_through_the_map(i):
    uniq, mapping = dedup.distinct_sequences(i.doc, [F.col("id")])
    return dedup.stored(mapping, uniq).select("id", "seq")


CDS_ASKED = "asked AS (SELECT 'g' || lpad(CAST(p_partkey AS STRING), 7, '0') || CASE WHEN p_partkey % 2 = 0 THEN '.3' ELSE '' END AS asked FROM part)"


@query(f"WITH {CDS_ASKED} SELECT a.asked, c.cds FROM asked a LEFT JOIN cds c ON c.gene_id = regexp_replace(a.asked, '\\.3$', '')", "cds")
def j07_coding_sequences_by_variants(i):
    name = F.concat(F.lit("g"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.when(F.col("p_partkey") % 2 == 0, ".3").otherwise(""))
    asked = i.part.select(name.alias("asked"))
    return prioritised_lookup(asked, i.cds, ids.id_variants(F.col("asked")), F.col("gene_id")).select("asked", "cds")


@query("SELECT 'x|G' || CAST(p_partkey AS STRING) AS asked, CASE WHEN p_size < 30 THEN p_name ELSE repeat('-', CAST(p_size AS INT)) END AS q3 FROM part")
def j08_structures_by_variants(i):
    table = i.part.filter("p_size < 30").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("q3"))
    asked = i.part.select(F.concat(F.lit("x|G"), F.col("p_partkey").cast("string")).alias("asked"), F.col("p_size").alias("n"))
    c = ids.canonical_id(F.col("asked"))
    found = prioritised_lookup(asked, table, F.array(F.col("asked"), c, F.lower("asked"), F.lower(c)), F.col("key"))
    return found.select("asked", F.coalesce("q3", F.repeat(F.lit("-"), F.col("n").cast("int"))).alias("q3"))


@query(f"SELECT r.ref_id, r.species, count(*)::BIGINT AS terms FROM (SELECT ref_id, species, unnest(list_distinct({FOLDED.format('description')})) AS t FROM ref) r GROUP BY 1, 2", "ref")
def j27_postings_with_references(i):
    posts = keyword.postings(i.ref, "ref_id", F.col("description"))
    return posts.join(i.ref.select("ref_id", "species"), "ref_id").groupBy("ref_id", "species").agg(F.count("*").alias("terms"))


@query("SELECT 'g' || CAST(p_partkey AS STRING) AS gene FROM part UNION SELECT 'g' || CAST(l_partkey + 50 AS STRING) FROM lineitem ORDER BY 1")
def j30_reference_gene_union(i):
    gene = lambda c: F.concat(F.lit("g"), c.cast("string")).alias("gene")
    return i.part.select(gene(F.col("p_partkey"))).union(i.lineitem.select(gene(F.col("l_partkey") + 50))).distinct().orderBy("gene")


@query("WITH v AS (SELECT key, max(l_suppkey) AS acc FROM (SELECT 'LI' || CAST(l_orderkey AS STRING) AS key, l_suppkey FROM lineitem UNION ALL SELECT 'LI' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING), l_suppkey FROM lineitem) GROUP BY key) SELECT key, acc FROM v")
def j31_accessions_by_variants(i):
    k = F.concat(F.lit("LI"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return i.lineitem.select(F.explode(ids.id_variants(k)).alias("key"), "l_suppkey").groupBy("key").agg(F.max("l_suppkey").alias("acc"))


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({FOLDED.format('text')}, lambda x: starts_with(x, 'tion'))) > 0 AND len(list_filter({FOLDED.format('text')}, lambda x: starts_with(x, 'an'))) > 0")
def p07_prefix_and_match(i):
    posts = keyword.postings(i.documents, "doc_id", F.col("text"))
    return keyword.retrieved(posts, "doc_id", ["tion", "an"], 2**31 - 1).select("doc_id")


@query("SELECT gene_id, seq FROM (SELECT gene_id, CASE WHEN ascii(right(gene_id, 1)) % 3 = 0 THEN seq || '1' WHEN ascii(right(gene_id, 1)) % 3 = 1 THEN repeat(seq, 20000) ELSE seq END AS seq FROM aln) WHERE length(gene_id) <= 256 AND length(seq) BETWEEN 1 AND 120000 AND regexp_full_match(seq, '[A-Z.*-]+')", "aln")
def p25_sane_alignments(i):
    last = F.ascii(F.substring("gene_id", -1, 1)) % 3
    made = F.when(last == 0, F.concat("seq", F.lit("1"))).when(last == 1, F.repeat("seq", F.lit(20_000))).otherwise(F.col("seq"))
    rows = spread(i.aln, "gene_id").select("gene_id", F.explode(F.array(made)).alias("seq"))  # made once, and not before rows are spread
    return alignment.sane(rows).select("gene_id", "seq")


@query("SELECT p_partkey, 'https://x.org/' || p_name || '?c=1A&s=' || CAST(p_size AS STRING) AS url FROM part")
def p30_links(i):
    out = text.templated("https://x.org/{gene_id}?c={chr}&s={start}", {"gene_id": F.col("p_name"), "chr": F.lit("1A"), "start": F.col("p_size")})
    return i.part.select("p_partkey", out.alias("url"))


@query("SELECT 'AT1G' || lpad(CAST(p_partkey % 99999 AS STRING), 5, '0') AS locus, p_name AS short, '' AS curator, p_type AS computed FROM part")
def s11_descriptions(i):
    n = F.concat(F.lit("at1g"), F.lpad((F.col("p_partkey") % 99999).cast("string"), 5, "0"), F.lit(".1"))
    rows = i.part.select(n.alias("name"), F.lit("protein_coding").alias("gene_model_type"), F.col("p_name").alias("short_description"), F.lit("NULL").alias("Curator_summary"), F.col("p_type").alias("Computational_description"))
    return annotations.descriptions(i.spark, path(i, "d.tsv", rows, sinks.tsv)).select("locus", "short", "curator", "computed")


@query("SELECT 'AT2G' || lpad(CAST(p_partkey % 99999 AS STRING), 5, '0') AS locus, p_brand AS symbol, p_name AS full_name FROM part")
def s12_aliases(i):
    n = F.concat(F.lit("AT2G"), F.lpad((F.col("p_partkey") % 99999).cast("string"), 5, "0"))
    rows = i.part.select(n.alias("locus_name"), F.col("p_brand").alias("symbol"), F.col("p_name").alias("full_name"))
    return annotations.aliases(i.spark, path(i, "al.tsv", rows, sinks.tsv))


@query("SELECT 'Os01g' || lpad(CAST(p_partkey AS STRING), 7, '0') AS locus, p_name AS description, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS symbols FROM part")
def s13_rice_annotation(i):
    n = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    rows = i.part.select(F.concat(F.lit("Os01t"), n, F.lit("-01")).alias("Transcript_ID"), F.concat(F.lit("Os01g"), n).alias("Locus_ID"), F.col("p_name").alias("Description"), F.concat_ws(", ", "p_brand", "p_type").alias("CGSNL Gene Symbol"), F.col("p_brand").alias("Other Symbol Synonym"), F.lit("").alias("Gene Name"))
    return annotations.rice(i.spark, path(i, "rice.tsv", rows, sinks.tsv)).select("locus", "description", text.piped(F.col("symbols")).alias("symbols"))


@query("SELECT 'Os02g' || lpad(CAST(p_partkey AS STRING), 7, '0') AS locus, unnest(list_distinct([p_brand, p_type])) AS symbol FROM part")
def s14_rice_symbols(i):
    rows = i.part.select(F.concat_ws("|", "p_brand", "p_type").alias("Symbol"), F.concat(F.lit("Os02g"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("RAPdb"), F.lit("m").alias("MSU"))
    return annotations.rice_symbols(i.spark, path(i, "rs.tsv", rows, sinks.tsv))


@query("SELECT 's' || CAST(n_nationkey AS STRING) AS sample_acc, n_name AS organ FROM nation")
def s17_samples(i):
    rows = i.nation.orderBy("n_nationkey").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("Run"), F.col("n_name").alias("Tissue"))
    return annotations.samples(i.spark, path(i, "meta.tsv", rows.coalesce(1), sinks.tsv)).select("sample_acc", "organ")


@query("SELECT 'g' || CAST(user_id AS STRING) AS gene_id, event_type AS experiment_acc, round(value, 6) AS logfc FROM events")
def s19_records(i):
    rows = i.events.select(F.concat(F.lit("acc|g"), F.col("user_id").cast("string")).alias("Gene"), F.col("event_type").alias("Study"), F.col("value").cast("string").alias("log2FC"))
    return annotations.records(i.spark, path(i, "deg.tsv", rows, sinks.tsv)).select("gene_id", "experiment_acc", F.round("logfc", 6).alias("logfc"))


@query("SELECT DISTINCT a, b FROM edge", "edge")
def s25_anchors(i):
    marks = i.spark.createDataFrame([("###",)], "value string")
    rows = marks.union(i.edge.select(F.concat_ws("\t", "a", "b", F.lit("99")).alias("value")))
    return annotations.edges(i.spark, path(i, "x.anchors", rows)).select("a", "b").distinct()


@query("SELECT '1A' || chr(9) || '5' || chr(9) || '9' || chr(9) || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END || chr(9) || '.' || chr(9) || '+' AS line FROM part")
def s31_seven_column_bed(i):
    row = F.concat_ws("\t", F.lit("1A"), F.lit("5"), F.lit("9"), "p_name", F.lit("."), F.lit("+"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")))
    return genomes.bed7(i.spark, path(i, "a.bed7", i.part.select(row.alias("value"))))


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey IN (0, 2)")
def s32_scoped_links(i):
    genome = F.when(F.col("n_regionkey") == 0, "Wheat").when(F.col("n_regionkey") == 2, "").otherwise("oat")
    return annotations.scoped(i.nation.withColumn("genome", genome), "wheat").select("n_name", "n_regionkey")


@query("SELECT n_name AS line FROM nation")
def s01_gzip_lines(i):
    where = Workspace(i.spark, "files").path("a.txt.gz")
    i.nation.select("n_name").write.option("compression", "gzip").text(where)
    return lines.lines(i.spark, where).select("line")


@query("SELECT n_name, CAST(n_regionkey AS STRING) AS genome FROM nation")
def k09_files_by_genome(i):
    where = Workspace(i.spark, "files").path("split")
    sinks.per_genome(i.nation.select("n_name", F.col("n_regionkey").cast("string").alias("genome")), where, "genome")
    return i.spark.read.csv(where, header=True).select("n_name", F.col("genome").cast("string").alias("genome"))


@query("SELECT p_partkey, p_name || chr(9) || '\"' || p_brand AS value FROM part")
def k10_quoted_export(i):
    rows = i.part.select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat("p_name", F.lit('\t"'), "p_brand").alias("value"))
    back = i.spark.read.csv(path(i, "q.tsv", rows, sinks.tsv), sep="\t", header=True, quote='"', escape="\\")
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "value")


@query("WITH x AS (SELECT l_orderkey AS k, l_linenumber AS cluster, l_partkey AS seq FROM lineitem) SELECT k, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cluster DESC, seq DESC) AS n FROM x) WHERE n = 1")
def u07_g06_later_sequence_wins(i):
    rows = i.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("cluster"), F.col("l_partkey").alias("seq"))
    return pick(rows, ["k"], [F.col("cluster"), F.col("seq")], last=True).select("k", "seq")


@query("SELECT grp, unnest(range(1, length(seq) + 1))::INTEGER AS col, CASE WHEN unnest(string_split(seq, '')) = '-' THEN 0.0 ELSE 1.0 END AS conservation FROM (SELECT gene_id AS grp, seq FROM aln)", "aln")
def m11_single_sequences(i):
    one = i.aln.select(F.col("gene_id").alias("grp"), "gene_id", "seq")
    return alignment.columns(alignment.long_form(one)).select("grp", "col", "conservation")


@query(f"WITH {STATS} SELECT gene, count(DISTINCT experiment)::BIGINT AS experiments, sum(n)::BIGINT AS samples, count(DISTINCT organ)::BIGINT AS organs, 'ok' AS status FROM stats GROUP BY gene", "expr")
def e04_response_summary(i):
    return expression.summary(i.expr.select("gene").distinct(), expression.tissue_stats(i.expr)).filter("status = 'ok'")


@query("WITH f AS (SELECT p_partkey % 4 AS k, sha1(string_agg(CAST(p_partkey AS STRING), chr(10) ORDER BY p_partkey) || chr(10)) AS s FROM part GROUP BY 1) SELECT k, v FROM (SELECT 'genes' AS k, CAST(count(*) AS STRING) AS v FROM part UNION ALL SELECT 'schema_version', '3' UNION ALL SELECT 'source_sha1', string_agg(s, '' ORDER BY k) FROM f)")
def x10_index_metadata(i):
    """Checksums of source files in order of their paths, counts and version, written beside the index and read again; another run over the same files gives the same."""
    work = Workspace(i.spark, "meta")
    rows = i.part.select((F.col("p_partkey") % 4).alias("k"), "p_partkey").repartition("k").sortWithinPartitions("k", "p_partkey")
    rows.select("k", F.col("p_partkey").cast("string").alias("value")).write.partitionBy("k").text(work.path("source"))
    sums = sinks.checksums(i.spark, work.path("source"))
    sinks.metadata(i.spark, work.path("meta"), {"schema_version": sinks.SCHEMA_VERSION, "genes": i.part.count(), "source_sha1": "".join(sums.values())})
    return i.spark.read.parquet(work.path("meta"))


NEAR = f"{KMERS}, ref AS (SELECT grp, min(gene_id) AS ref FROM aln GROUP BY grp), d AS (SELECT y.grp, y.gene_id, 'a' || right(y.gene_id, 1) AS accession, round(1 - CASE WHEN len(x.k) = 0 AND len(y.k) = 0 THEN 1.0 ELSE len(list_intersect(x.k, y.k)) / greatest(1, len(x.k) + len(y.k) - len(list_intersect(x.k, y.k))) END, 6) AS distance FROM ref JOIN k x ON x.grp = ref.grp AND x.gene_id = ref.ref JOIN k y ON y.grp = ref.grp AND y.gene_id <> ref.ref)"


@query(f"WITH {NEAR} SELECT grp, accession, gene_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY grp, accession ORDER BY distance, gene_id) AS n FROM d) WHERE n = 1", "aln")
def g13_most_similar_member(i):
    rows = i.aln.withColumn("accession", F.concat(F.lit("a"), F.substring("gene_id", -1, 1)))
    return similarity.most_similar(rows, i.aln.groupBy("grp").agg(F.min("gene_id").alias("ref"))).select("grp", "accession", "gene_id", "distance")


@query(f"""WITH {TREES}, two AS (SELECT tree, arg_max(name, (len, -CAST(name AS BIGINT))) AS far, max(len) AS far_len, max(n) AS n FROM tip GROUP BY tree), next AS (SELECT t.tree, max(t.len) AS second FROM tip t JOIN two ON t.tree = two.tree AND t.name <> two.far GROUP BY t.tree)
SELECT t.tree, t.name, CASE WHEN next.second IS NULL THEN t.len::DOUBLE WHEN t.name = two.far THEN (two.far_len + next.second) / 2.0 ELSE t.len + (two.far_len - next.second) / 2.0 END AS x FROM tip t JOIN two ON t.tree = two.tree LEFT JOIN next ON next.tree = t.tree""")
def h12_h13_tree_layouts(i):
    """Of a flat tree: the root lies on the longest leaf's branch, half the longest path from its tip."""
    return similarity.layouts(trees(i, chain=False)).filter("name <> ''").select("tree", "name", "x")
