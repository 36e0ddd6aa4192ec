"""Keyword search: reference genes, their aliases and postings, ranked retrieval, hits and the rollup to clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators.pick import pick

#: Hits above this e-value do not count; hits without one do.
MAX_EVALUE = 1e-5
#: BM25 parameters (Robertson and Zaragoza 2009); configuration, as only the ranking by BM25 is fixed.
K1, B = 1.2, 0.75


def longest(rows: DataFrame, key: str, value: Column, order: list[Column]) -> DataFrame:
    """The row of each key with the longest text, the first of equals."""
    return pick(rows, [key], [-F.length(value), *order])


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of each key in order of first appearance, joined by bars."""
    first = rows.filter(F.col(value) != "").groupBy(key, value).agg(F.min(order).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value])
    return first.groupBy(key).agg(F.array_join(listed, "|").alias(value))


def merged_refs(descriptions: DataFrame, aliases: DataFrame, key: str, how: str = "full") -> DataFrame:
    """Descriptions and alias lists of the same loci: all of both (full), or only described ones (left)."""
    return descriptions.join(aliases, key, how)


def alias_rows(refs: DataFrame, names: dict[str, Column]) -> DataFrame:
    """(alias_norm, ref_id, kind): each name that finds a reference gene; names gives an array column for each kind."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("names")) for k, c in names.items()])
    one = refs.select("ref_id", F.explode(kinds).alias("k")).select("ref_id", "k.kind", F.explode("k.names").alias("alias"))
    return one.select(F.lower(F.trim("alias")).alias("alias_norm"), "ref_id", "kind").filter("alias_norm <> ''").distinct()


def postings(refs: DataFrame, key: str, *bodies: Column) -> DataFrame:
    """(term, key, tf, length): terms of all the given text columns, without case and diacritics, and the terms of a row in all."""
    every = F.flatten(F.array(*map(text.terms, bodies)))
    one = refs.select(key, every.alias("terms")).select(key, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return one.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def stored_postings(posts: DataFrame, path: str, force: bool = False) -> None:
    """Postings dealt and sorted by term, so that a search reads the row groups of its prefixes only."""
    posts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite" if force else "errorifexists").option("compression", "zstd").parquet(path)


def matching(posts: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """(key, token, tf, length): how often a term that starts with the token stands in each text; the prefixes are filters of the scan."""
    tokens = [t.lower() for t in tokens]
    some = F.lit(False)
    for t in tokens:
        some = some | F.startswith(F.col("term"), F.lit(t))
    query = F.array(*[F.lit(t) for t in tokens])
    hit = posts.filter(some).withColumn("token", F.explode(F.filter(query, lambda t: F.startswith(F.col("term"), t))))
    return hit.groupBy("token", key, "length").agg(F.sum("tf").alias("tf"))


def retrieved(posts: DataFrame, key: str, tokens: list[str], limit: int, whole: DataFrame | None = None) -> DataFrame:
    """Texts that have, for each token, a term that starts with it, by BM25, the first `limit`; ties by key.

    Corpus numbers (n, mean) are one row, which may be given, and join as a broadcast of that row. A token that more than
    half of all texts have counts next to nothing, as its idf is kept above 0.
    """
    tokens = list(dict.fromkeys(t.lower() for t in tokens))
    tf = matching(posts, key, tokens)
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    if whole is None:
        whole = corpus_numbers(posts, key)
    s = tf.join(df, "token").crossJoin(F.broadcast(whole))
    plain = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(plain > 0, plain).otherwise(1e-6)
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    ranked = s.groupBy(key).agg(F.sum(score).alias("score"), F.count("*").alias("tokens")).filter(F.col("tokens") == len(tokens))
    return ranked.select(key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def corpus_numbers(posts: DataFrame, key: str) -> DataFrame:
    """One row: texts with a term, and their mean length."""
    return posts.select(key, "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def candidate_cap(ref_limit: int) -> int:
    """How many texts a search ranks before it looks for those with hits."""
    return max(4 * ref_limit, 50)


def matched_refs(alias_hits: DataFrame, text_hits: DataFrame, hits: DataFrame, limit: int = 25, selected: DataFrame | None = None) -> DataFrame:
    """(ref_id, kind, rank): alias matches, then text matches in order; only those with a hit; the first `limit`, and selected ones beyond."""
    a = alias_hits.select("ref_id", F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    t = text_hits.select("ref_id", F.lit(1).alias("tier"), F.col("score"))
    both = a.unionByName(t)
    if selected is not None:
        both = both.unionByName(selected.select("ref_id", F.lit(2).alias("tier"), F.lit(0.0).alias("score")))
    best = pick(both, ["ref_id"], [F.col("tier"), -F.col("score")]).join(hits.select("ref_id").distinct(), "ref_id", "left_semi")
    top = best.filter("tier < 2").orderBy("tier", F.desc("score"), "ref_id").limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "ref_id")))
    if selected is not None:
        extra = selected.select("ref_id").distinct().join(hits.select("ref_id").distinct(), "ref_id", "left_semi").join(top, "ref_id", "left_anti")
        top = top.unionByName(extra.select("ref_id", F.lit(2).alias("tier"), F.lit(0.0).alias("score"), F.lit(limit + 1).alias("rank")))
    kind = F.when(F.col("tier") == 0, "alias").when(F.col("tier") == 1, "text").otherwise("selected")
    return top.select("ref_id", kind.alias("kind"), "rank")


def usable_hits(hits: DataFrame, max_evalue: float = MAX_EVALUE) -> DataFrame:
    return hits.filter(F.col("evalue").isNull() | (F.col("evalue") <= max_evalue))


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit for each gene and species: least e-value (none last), greatest identity (none last), least reference id."""
    order = [F.col("evalue").isNull(), F.col("evalue"), F.col("pident").isNull(), -F.col("pident"), F.col("ref_id")]
    return pick(hits, ["gene_id", "species"], order)


def annotations(asked: DataFrame, hits: DataFrame, refs: DataFrame, species: tuple[str, ...]) -> DataFrame:
    """Best annotation of each asked gene in each species, side by side; genes without any are kept."""
    best = best_hits(hits).join(refs, "ref_id")
    wide = best.groupBy("gene_id").agg(*[F.min(F.when(F.col("species") == s, F.col("ref_id"))).alias(f"{s}_ref") for s in species], *[F.min(F.when(F.col("species") == s, F.col("description"))).alias(f"{s}_description") for s in species])
    return asked.select("gene_id").distinct().join(wide, "gene_id", "left")


def remapped(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits with the cluster that their gene has in the active set; others go."""
    return hits.drop("pangene").join(genes.select("gene_id", "accession", "pangene").distinct(), ["gene_id", "accession"])


def rollup(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each cluster: genes and references matched, hits, accessions with hits, best e-value and identity, size, and density in percent.

    Hits are first summed by (cluster, gene, accession, reference), so counts of distinct things need no row of a large cluster twice.
    """
    pair = F.struct("gene_id", "accession")
    per = hits.groupBy("pangene").agg(
        F.count_distinct(pair).alias("matched_genes"), F.count_distinct("ref_id").alias("matched_refs"), F.count("*").alias("hit_rows"),
        F.count_distinct("accession").alias("genomes"), F.min("evalue").alias("min_evalue"), F.max("pident").alias("max_pident"),
    )
    share = 100.0 * F.col("matched_genes") / F.coalesce(F.when(F.col("size") > 0, F.col("size")), F.greatest("matched_genes", F.lit(1)))
    return per.join(sizes, "pangene", "left").withColumn("density_pct", F.round(share, 6))


def ranked(groups: DataFrame, limit: int = 100) -> DataFrame:
    """Best e-value first (1 without any), then density, matched genes and id."""
    return groups.orderBy(F.coalesce("min_evalue", F.lit(1.0)), F.desc("density_pct"), F.desc("matched_genes"), "pangene").limit(limit)


def hits_by_genome(hits: DataFrame) -> DataFrame:
    """accession:count of each cluster, most hits first."""
    n = hits.groupBy("pangene", "accession").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "accession", "n")))
    return n.groupBy("pangene").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["accession"], F.lit(":"), x["n"].cast("string"))), "|").alias("by_genome"))


def cards(refs: DataFrame, tokens: list[str]) -> DataFrame:
    """What a reference gene's card shows: all names, the whole description and the part of it around the first token found."""
    whole = F.when(F.lower("species") == "arabidopsis", text.sentences(F.col("short"), F.col("curator"), F.col("computed"))).otherwise(F.trim("description"))
    names = text.piped(F.concat(F.split("symbols", r"\|"), F.split("full_name", r"\|")))
    return refs.select("ref_id", "species", names.alias("names"), whole.alias("whole")).withColumn("snippet", text.snippet(F.col("whole"), tokens))


def selected_groups(hits: DataFrame, chosen: list[str], genes: DataFrame | None, sizes: DataFrame, max_evalue: float = MAX_EVALUE, limit: int = 100) -> DataFrame:
    """Clusters ranked by their hits of the chosen references (in any case): cutoff, cluster of each gene in the active set (genes; the
    hits' own without), rollup, rank and labels, in one."""
    names = [c.upper() for c in chosen]
    used = usable_hits(hits.filter(F.upper("ref_id").isin(*names)), max_evalue)
    used = used if genes is None else remapped(used, genes)
    used = used.filter(F.coalesce("pangene", F.lit("")) != "")
    groups = ranked(rollup(used, sizes), limit).withColumn("density_pct", F.round("density_pct", 2))
    groups = groups.join(hits_by_genome(used), "pangene")
    out = groups.withColumn("min_evalue_label", text.evalue_label(F.col("min_evalue"))).withColumn("max_pident_label", text.identity_label(F.col("max_pident")))
    return out.orderBy(F.coalesce("min_evalue", F.lit(1.0)), F.desc(F.col("matched_genes") / F.coalesce(F.when(F.col("size") > 0, F.col("size")), F.greatest("matched_genes", F.lit(1)))), F.desc("matched_genes"), "pangene")
