"""Queries through stored structures: each builds the structure from whole tables, and asks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import ids, numbers, snapshot
from kinloom.functions.scratch import Workspace
from kinloom.functions.snapshot import Snapshot
from kinloom.functions.spread import spread
from kinloom.operators import chains, dedup, expression, graph, keyword, lookup, members, prefixes
from kinloom.operators.pick import prioritised_lookup
from kinloom.plans.clusters import GENES, PLACED, genes, placed
from kinloom.plans.expressions import STATS
from kinloom.plans.graphs import KEYED, REACH
from kinloom.plans.keywords import BM25
from kinloom.plans.registry import query


def built(i, name, **tables):
    """An index in a workspace: each table is (frame, options of Snapshot.write)."""
    root = Workspace(i.spark, name).path("index")
    with Snapshot(i.spark, root) as snap:
        for t, (df, options) in tables.items():
            snap.write(df, t, **options)
    return lambda t: snapshot.read(i.spark, root, t)


def id_index(i, parts=True):
    """Genes by key, and trigrams with their frequencies where parts of ids are asked for."""
    root = Workspace(i.spark, "ids").path("index")
    with Snapshot(i.spark, root) as snap:
        table = snap.write(lookup.keyed(genes(i)), "genes", order=("pangene", "accession", "gene_id"), dealt=True, bloom=("gene_id", "gene_key"))
        if parts:
            snap.write(lookup.postings(table), "trigrams", order=("term",))
    read = lambda t: snapshot.read(i.spark, root, t)
    if not parts:
        return read("genes")
    return read("genes"), read("trigrams"), lookup.frequencies(read("trigrams"))


@query(f"WITH {GENES} SELECT gene_id, pangene, accession FROM genes WHERE contains(lower(gene_id), 'li10') ORDER BY gene_id LIMIT 200", "member")
def p02_t05_trigram_search(i):
    return lookup.search(*id_index(i), "LI10").select("gene_id", "pangene", "accession")


@query(f"WITH {GENES} SELECT gene_id, pangene, accession FROM genes WHERE lower(gene_id) = 'li100.1' OR (NOT EXISTS (SELECT 1 FROM genes WHERE lower(gene_id) = 'li100.1') AND contains(lower(gene_id), 'li100.1')) ORDER BY gene_id LIMIT 200", "member")
def p01_p03_stored_key_search(i):
    return lookup.search(*id_index(i), "Li100.1").select("gene_id", "pangene", "accession")


@query(f"WITH {GENES} SELECT gene_id, pangene FROM genes WHERE contains(lower(gene_id), 'li12') ORDER BY gene_id LIMIT 15", "member")
def t04_trigram_suggestions(i):
    return lookup.suggestions(*id_index(i), "Li12").select("gene_id", "pangene")


@query("SELECT l_orderkey % 32 AS k, count(*)::BIGINT AS terms FROM (SELECT DISTINCT l_orderkey, l_linenumber, term FROM (SELECT l_orderkey, l_linenumber, unnest([substr(g, x, 3) for x in range(1, len(g) - 1)]) AS term FROM (SELECT l_orderkey, l_linenumber, 'li' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS g FROM lineitem))) GROUP BY 1")
def p02_trigrams(i):
    posts = lookup.postings(i.member)
    return posts.groupBy((F.regexp_extract("gene_id", r"^LI(\d+)\.", 1).cast("long") % 32).alias("k")).agg(F.count("*").alias("terms"))


ASKED_FEW = ["LI1", "LI2.1", "LI3.77", "LI4.2", "LI5", "LI7.1", "LI32.1", "LI33.3", "LI34.1", "LI35.9", "LI39.4", "LI64", "LI65.2", "none"]
FEW = ", ".join(f"('{a}')" for a in ASKED_FEW)


@query(f"""WITH {GENES}, few(asked) AS (VALUES {FEW}), v AS (SELECT asked, 0 AS pos, asked AS key FROM few UNION ALL SELECT asked, 1, CASE WHEN regexp_matches(asked, '\\.[0-9]+$') THEN regexp_replace(asked, '\\.[0-9]+$', '') ELSE asked || '.1' END FROM few),
h AS (SELECT v.asked, g.gene_id, g.pangene, row_number() OVER (PARTITION BY v.asked ORDER BY v.pos) AS k FROM v JOIN genes g ON g.gene_id = v.key)
SELECT f.asked, h.gene_id, h.pangene FROM few f LEFT JOIN h ON f.asked = h.asked AND h.k = 1""", "member")
def j04_j05_stored_lookup(i):
    asked = i.spark.createDataFrame([(a,) for a in ASKED_FEW], "asked string")
    variants = ids.id_variants(F.col("asked"))
    table = id_index(i, parts=False).select("gene_id", "pangene")
    return prioritised_lookup(asked, lookup.rows_of(table, asked, variants, "gene_id"), variants, F.col("gene_id"))


#: Buckets of the tables that are joined by gene are no fewer than this, and hold some so many rows each: a bucket is sorted in one task.
BUCKETS, BUCKET_ROWS = 8, 500_000


def bucketed(i, keys, rows: int, **tables):
    """Tables of at most so many rows in buckets of the keys."""
    n = max(BUCKETS, -(-rows // BUCKET_ROWS))
    root = Workspace(i.spark, "buckets").path("index")
    with Snapshot(i.spark, root) as snap:
        for t, df in tables.items():
            snap.write_bucketed(df, t, keys, n)
    return lambda t: snapshot.bucketed(i.spark, root, t)


@query(f"WITH {GENES}, {PLACED}, held AS (SELECT gene_id, pangene, 'acc' || CAST(CAST(substr(accession, 4) AS INT) % 10 AS STRING) AS accession FROM genes) SELECT g.gene_id, g.pangene, g.accession, p.chr, p.begin_pos, p.end_pos FROM held g LEFT JOIN placed p ON g.gene_id = p.gene_id AND g.accession = p.accession", "member", "coord")
def j02_bucketed_places(i):
    g = genes(i).withColumn("accession", F.concat(F.lit("acc"), (F.substring("accession", 4, 10).cast("int") % 10).cast("string")))
    table = bucketed(i, ("gene_id", "accession"), i.lineitem.count(), genes=g, places=placed(i))
    return members.with_places(table("genes"), table("places")).select("gene_id", "pangene", "accession", "chr", "begin_pos", "end_pos")


@query(f"WITH {KEYED}, r AS (SELECT uniq_id, seq, row_number() OVER (PARTITION BY uniq_id ORDER BY id) AS k FROM keyed) SELECT k.id AS gene_id, 'p' || CAST(k.id % 7 AS STRING) AS pangene, r.seq FROM keyed k JOIN r ON k.uniq_id = r.uniq_id AND r.k = 1", "doc")
def j06_j07_bucketed_sequences(i):
    uniq, mapping = dedup.distinct_sequences(i.doc, [F.col("id")])
    g = i.doc.select(F.col("id").alias("gene_id"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("pangene"))
    table = bucketed(i, ("gene_id",), i.documents.count(), genes=g, sequences=dedup.stored(mapping, uniq).select(F.col("id").alias("gene_id"), "seq"))
    return table("genes").join(table("sequences"), "gene_id")


#: Texts whose terms one task counts: texts are dealt by their keys, not their terms.
TEXTS = 2_000


@query(f"WITH {BM25} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 100")
def x03_t02_bounded_retrieval(i):
    root = Workspace(i.spark, "prefixes").path("index")
    with Snapshot(i.spark, root) as snap:
        texts = spread(i.documents.select("doc_id", "text"), "doc_id", rows=TEXTS)
        posts = snap.write(keyword.postings(texts, "doc_id", F.col("text")), "postings", order=("term",))
        prefixes.write(snap, posts, "doc_id", snap.write(keyword.corpus_numbers(posts, "doc_id"), "numbers"))
    return prefixes.best(i.spark, root, "doc_id", ["th", "er"], keyword.candidate_cap(25))


CODED = "coded AS (SELECT * EXCLUDE (value), CASE WHEN value IS NOT NULL THEN CAST(least(65534, greatest(0, round_even(value * 10, 0))) AS INT) / 10 END AS value FROM expr)"


@query(f"WITH {CODED}, {STATS.replace('FROM expr', 'FROM coded')} SELECT gene, organ, genome, experiment, grp, n, mean, sd, first_sample FROM stats", "expr")
def p26_j28_e02_stored_arrays(i):
    """Samples once, and one array a gene: here every event is a sample, so arrays are dealt by gene, and hold the samples' numbers in it."""
    e = i.expr
    rank = F.array_sort(F.collect_list(F.struct("sample_idx", "value")))
    arrays = e.groupBy("gene").agg(rank.alias("a")).select("gene", F.transform("a", lambda x: x["value"]).alias("values"), F.transform("a", lambda x: x["sample_idx"]).alias("samples"))
    samples = e.select("sample_idx", "organ", "experiment", "grp", "genome").distinct()
    stored = expression.stored_arrays(arrays.select("gene", "values")).join(arrays.select("gene", "samples"), "gene")
    read = built(i, "arrays", values=(stored, {"order": ("gene",), "dealt": True, "bloom": ("gene",)}), samples=(samples, {"order": ("sample_idx",), "dealt": True}))
    one = read("values").select("gene", F.explode(F.arrays_zip("codes", "samples")).alias("x")).select("gene", numbers.decoded(F.col("x.codes")).alias("value"), F.col("x.samples").alias("sample_idx"))
    return expression.tissue_stats(one.join(read("samples"), "sample_idx"))


@query(f"WITH RECURSIVE {REACH} SELECT node, component FROM comp", "edge")
def h06_u09_grown_components(i):
    """Components of nine tenths of the edges, stored, and then the rest."""
    work, late = Workspace(i.spark, "grown"), F.pmod(F.xxhash64("a", "b"), F.lit(10)) == 0
    old = work.write(graph.components(i.edge.filter(~late), work, "old"), "old")
    return graph.grown(old, i.edge.filter(late), work)


@query()
def h15_collinear_chains(i):
    """Lines as anchors: orders in order of their keys along one chromosome of some 4,000 genes, parts near that place along the other."""
    at, k = "l_orderkey div 8", "l_linenumber"
    a = i.lineitem.selectExpr(f"concat({at} div 4000, '-', l_orderkey % 4) pair", f"l_orderkey * 8 + {k} id", f"{at} % 4000 x", f"{at} % 4000 + l_orderkey % 9 - 4 + {k} y", f"cast({k} + 2 as double) w").dropDuplicates(["pair", "id"])
    return chains.chain_ends(chains.chained(a, Workspace(i.spark, "chains"), reach=10), score=20.0, anchors=4)


@query()
def h15_flow_clusters(i):
    edges = i.lineitem.groupBy(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("P"), (F.col("l_orderkey").cast("long") / 8 + F.when(F.col("l_partkey") % 25 == 0, 1).otherwise(0)).cast("long").cast("string")).alias("b")).agg(F.sum("l_quantity").alias("w"))
    return chains.flow_clusters(edges, Workspace(i.spark, "flow"))
