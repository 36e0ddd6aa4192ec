"""Indexes from folders of input files: genomes, reference genes with their hits, expression.

An index is a snapshot of Parquet tables, dealt and sorted by what they are looked up by, which counts from the moment its manifest is there: a build that fails leaves
what was. An existing index is an error unless force is given; statistics of species that are not built again stay.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import ids, snapshot, text
from kinloom.functions.scratch import Workspace, listed
from kinloom.functions.snapshot import Snapshot
from kinloom.operators import coords, dedup, expression, keyword, lookup, members, prefixes, sinks
from kinloom.operators.pick import pick
from kinloom.sources import annotations, genomes, layout

#: Columns of a reference gene that are searched, in their order. Fixed value.
SEARCHED = ("symbols", "full_name", "description", "synonyms", "short", "curator", "computed")

#: Genes of a bucket of the tables that are joined by gene.
BUCKET_ROWS = 1_000_000


def genome_index(spark: SparkSession, folder: str, out: str, force: bool = False, species: str | None = None) -> DataFrame | None:
    """One species (the folder's name, if none is given) as a snapshot; its statistics as one row. None without clusters or coordinates.

    genes, with ids in lower case as a key and Bloom filters on both, trigrams of the ids, gene_coords, clusters, sequences and their map, structures; and genes, places
    and sequences in buckets of what they are joined by, as Spark uses buckets only where they are of all keys of a join. A gene has the accession of the last file of coordinates that has it, clusters have their
    species' prefix, and a cluster counts its members as they are listed.
    """
    species = (species or folder.rstrip("/").rsplit("/", 1)[-1]).strip().lower()
    inside = {n: p for n, p, is_folder in listed(spark, folder)}
    name, beds = layout.cluster_file(list(inside)), layout.files(spark, inside.get("bed", f"{folder}/bed"), genomes.BED)
    if name is None or not beds:
        return None
    work = Workspace(spark, "build")
    with Snapshot(spark, out, force) as snap:
        rows = genomes.bed(spark, beds).filter("gene_id <> ''")
        owners = work.write(coords.owners(rows, [F.col("src")]), "owners")
        places = coords.chrom_index(coords.placed(rows, [F.col("src")]))
        places = snap.write(places.select("gene_id", "accession", "chr", "begin_pos", "end_pos", "strand", "subgenome", "chrom_index"), "gene_coords", order=("accession", "chr", "chrom_index"), dealt=True, bloom=("gene_id",))
        listed_members = genomes.cluster_members(spark, inside[name]).withColumn("pangene", ids.cluster_id(F.lit(species), F.col("pangene"))).filter("pangene <> ''")
        located = work.write(members.located(listed_members, owners), "located")
        genes = members.genes(located, [F.col("src"), F.col("pos"), F.col("accession")]).select("gene_id", "pangene", "accession")
        genes = snap.write(lookup.keyed(genes), "genes", order=("pangene", "accession", "gene_id"), dealt=True, bloom=("gene_id", "gene_key"))
        snap.write(members.cluster_sizes(located), "clusters", order=("pangene",), dealt=True)
        posts = snap.write(lookup.postings(genes), "trigrams", order=("term",))
        snap.write(lookup.frequencies(posts), "trigram_counts", order=("term",), dealt=True)
        buckets = max(1, -(-genes.count() // BUCKET_ROWS))
        plain = genes.select("gene_id", "pangene", "accession")
        for name, df, keys in (("genes_by_place", plain, ("gene_id", "accession")), ("coords_by_place", places, ("gene_id", "accession")), ("genes_by_id", plain, ("gene_id",))):
            snap.write_bucketed(df, name, keys, buckets)
        for kind, clean in (("prot", text.protein), ("cds", text.coding)):
            found = layout.files(spark, inside.get(kind, f"{folder}/{kind}"), genomes.FASTA)
            if found:
                records = genomes.resolved(genomes.fasta(spark, found), genes).withColumn("seq", clean(F.col("seq")))
                records = pick(records.select(F.col("gene_id").alias("id"), "seq", "src"), ["id"], [F.col("src")], last=True)
                records = work.write(records, f"{kind}_records")
                uniq, mapping = dedup.distinct_sequences(records, [F.col("id")])
                uniq = snap.write(uniq, f"{kind}_sequences", order=("uniq_id",), dealt=True, bloom=("uniq_id",))
                mapping = snap.write(mapping, f"{kind}_map", order=("id",), dealt=True, bloom=("id",))
                snap.write_bucketed(dedup.stored(mapping, uniq).select(F.col("id").alias("gene_id"), "seq"), f"{kind}_by_id", ("gene_id",), buckets)
        q = {k: layout.files(spark, inside.get("porter6", f"{folder}/porter6"), (f".{k}.csv", f".{k}.csv.gz")) for k in ("q3", "q8")}
        if q["q3"] and q["q8"]:
            snap.write(genomes.structures(spark, q["q3"], q["q8"]), "structures", order=("gene_id",), dealt=True, bloom=("gene_id",))
        return spark.createDataFrame(members.statistics(genes).collect(), "accessions long, pan_genes long, genes long")


def genome_indexes(spark: SparkSession, root: str, out: str, force: bool = False, only: list[str] | None = None) -> DataFrame:
    """An index for each species folder of root (or those named), and the statistics of all; (species, accessions, pan_genes, genes)."""
    chosen = layout.requested(layout.species_folders(spark, root), only)
    rows = []
    for species, folder in chosen.items():
        found = genome_index(spark, folder, f"{out}/{species}", force, species)
        if found is not None:
            rows.append((species, *found.first()))
    new = spark.createDataFrame(rows, "species string, accessions long, pan_genes long, genes long")
    where = f"{out}/stats"
    kept = snapshot.read(spark, where, "stats") if snapshot.tables(spark, where) else new.limit(0)
    with Snapshot(spark, where, force=True) as snap:
        snap.write(sinks.merged_statistics(kept, new), "stats")
    return snapshot.read(spark, where, "stats")


def reference_genes(descriptions: DataFrame, aliases: DataFrame, rice: DataFrame, rice_symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference genes of both model species in ten columns, and the names that find them (alias_norm, ref_id, kind).

    A locus has the description of its transcript with the longest text; symbols and names keep their order. Loci that only the
    table of symbols has are left out for rice and kept for arabidopsis.
    """
    whole = F.concat("short", "curator", "computed")
    line = F.monotonically_increasing_id()
    d = pick(descriptions.withColumn("line", line), ["locus"], [-F.length(whole), F.col("line")]).select("locus", "short", "curator", "computed")
    transcripts = descriptions.groupBy("locus").agg(F.array_sort(F.collect_set("transcript")).alias("transcripts"))
    a = aliases.withColumn("line", line)
    a = keyword.ordered_distinct(a, "locus", "symbol", "line").join(keyword.ordered_distinct(a, "locus", "full_name", "line"), "locus", "full")
    at = keyword.merged_refs(d.join(transcripts, "locus"), a, "locus")
    empty, none = F.lit(""), F.array().cast("array<string>")
    blank = lambda c: F.coalesce(F.col(c), empty)
    parts = lambda c: F.filter(F.split(blank(c), r"\|"), lambda x: x != "")
    at = at.select(
        F.col("locus").alias("ref_id"), F.lit("arabidopsis").alias("species"), blank("symbol").alias("symbols"), blank("full_name").alias("full_name"), empty.alias("description"),
        text.piped(F.concat(parts("symbol"), parts("full_name"))).alias("synonyms"), blank("short").alias("short"), blank("curator").alias("curator"), blank("computed").alias("computed"),
        F.concat(F.array("locus"), F.coalesce("transcripts", none)).alias("as_id"), parts("symbol").alias("as_symbol"), parts("full_name").alias("as_name"),
    )
    r = pick(rice.withColumn("line", line), ["locus"], [-F.length("description"), F.col("line")])
    lists = rice.groupBy("locus").agg(F.array_distinct(F.flatten(F.collect_list("symbols"))).alias("symbols"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.array_sort(F.collect_set("transcript")).alias("transcripts"))
    more = rice_symbols.groupBy("locus").agg(F.collect_list("symbol").alias("more"))
    r = keyword.merged_refs(r.select("locus", "description").join(lists, "locus"), more, "locus", "left")
    symbols = F.array_distinct(F.concat("symbols", F.coalesce("more", none), "names"))
    r = r.select(
        F.col("locus").alias("ref_id"), F.lit("rice").alias("species"), text.piped(symbols).alias("symbols"), empty.alias("full_name"), "description", empty.alias("synonyms"), *[empty.alias(c) for c in ("short", "curator", "computed")],
        F.concat(F.array("locus"), "transcripts", F.transform("transcripts", lambda t: F.regexp_replace(t, r"-\d+$", ""))).alias("as_id"), symbols.alias("as_symbol"), none.alias("as_name"),
    )
    both = at.unionByName(r)
    names = keyword.alias_rows(both, {"id": F.col("as_id"), "symbol": F.col("as_symbol"), "name": F.col("as_name")})
    return both.drop("as_id", "as_symbol", "as_name"), names


def keyword_index(spark: SparkSession, files: dict[str, str], hits_root: str, genes: dict[str, DataFrame], out: str, force: bool = False) -> DataFrame:
    """refs, aliases, postings, hits by data set, and metadata with checksums of the four annotation files (descriptions, aliases, rice, rice_symbols; the last may lack).

    Each accession's hits go to the first data set that has it; hits of genes that are in no cluster there are counted and left out. Returns the metadata.
    """
    for need in ("descriptions", "aliases", "rice"):
        if need not in files:
            raise ValueError(f"missing file of {need}")
    folders = layout.hit_folders(spark, hits_root)
    if not folders:
        raise ValueError(f"no folder of hits in {hits_root}")
    work = Workspace(spark, "keywords")
    symbols = annotations.rice_symbols(spark, files["rice_symbols"]) if "rice_symbols" in files else spark.createDataFrame([], "locus string, symbol string")
    refs, names = reference_genes(annotations.descriptions(spark, files["descriptions"]), annotations.aliases(spark, files["aliases"]), annotations.rice(spark, files["rice"]), symbols)
    with Snapshot(spark, out, force) as snap:
        refs = snap.write(refs, "refs", order=("ref_id",), dealt=True, bloom=("ref_id",))
        snap.write(names, "aliases", order=("alias_norm",), dealt=True, bloom=("alias_norm",))
        posts = snap.write(keyword.postings(refs, "ref_id", *map(F.col, SEARCHED)), "postings", order=("term",), dealt=True)
        whole = snap.write(keyword.corpus_numbers(posts, "ref_id"), "numbers")
        prefixes.write(snap, posts, "ref_id", whole)
        every = None
        for data_set, g in sorted(genes.items()):
            part = g.select("gene_id", "accession", "pangene", F.lit(data_set).alias("dataset_id"))
            every = part if every is None else every.unionByName(part)
        owners = pick(every.select("accession", "dataset_id").distinct(), ["accession"], [F.col("dataset_id")])
        found = [p for f in folders for p in layout.files(spark, f, (".tsv", ".tsv.gz"))]
        rows = work.write(annotations.best_hits(spark, found).join(owners, "accession"), "hits")
        kept = work.write(rows.join(every, ["dataset_id", "accession", "gene_id"]), "kept")
        last = pick(kept, ["dataset_id", "gene_id", "species", "ref_id"], [F.col("src"), F.col("accession")], last=True).drop("src")
        last = snap.write(last, "hits", by=("dataset_id",), order=("species", "ref_id"), bloom=("gene_id",))
        sums = {f"{k}_sha1": "".join(sinks.checksums(spark, p).values()) for k, p in files.items()}
        meta = {"schema_version": sinks.SCHEMA_VERSION, "refs_count": refs.count(), "hits_files": len(found), "hits_total": last.count(), "hits_unmatched": rows.count() - kept.count(), **sums}
        snap.write(spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "k string, v string"), "meta")
    return snapshot.read(spark, out, "meta")


def expression_index(spark: SparkSession, root: str, out: str, force: bool = False) -> DataFrame:
    """samples, values, records and experiments of all data sets of root, each table in a folder a data set; returns (dataset_id, genome, label, samples). A file
    dataset.json overrides genome and label. Samples are kept once; values are one row a gene: its stored numbers in order of the samples."""
    rows, tables = [], {"samples": [], "values": [], "records": [], "experiments": []}
    own = lambda df, data_set: df.withColumn("dataset_id", F.lit(data_set))
    with Snapshot(spark, out, force) as snap:
        for data_set, folder in layout.data_sets(spark, root).items():
            given = next((json.loads("\n".join(r.value for r in spark.read.text(p).collect())) for n, p, _ in listed(spark, folder) if n == "dataset.json"), {})
            if not isinstance(given, dict):
                raise ValueError(f"{folder}/dataset.json: not an object")
            meta = annotations.samples(spark, layout.table_file(spark, folder, layout.SAMPLES))
            for c in ("experiment_acc", "organ", "group", "genome", "short_title", "title"):
                meta = meta if c in meta.columns else meta.withColumn(c, F.lit(""))
            n = meta.count()
            if not n:
                raise ValueError(f"{folder}: no samples")
            common = expression.majority_genome(meta.filter("trim(genome) <> ''").withColumn("dataset_id", F.lit(data_set))).first()
            genome = given.get("genome") or (common.genome if common else "")
            values = annotations.matrix(spark, layout.table_file(spark, folder, layout.VALUES), [r.sample_acc for r in meta.select("sample_acc").collect()])
            tables["samples"].append(own(meta.select("sample_idx", "sample_acc", F.col("experiment_acc").alias("experiment"), "organ", F.col("group").alias("grp"), "genome", "short_title", "title"), data_set))
            tables["values"].append(own(expression.stored_arrays(expression.arrays(values, meta)), data_set))
            records = layout.table_file(spark, folder, layout.RECORDS)
            if records:
                r = annotations.records(spark, records)
                for c in ("category", "comparison", "short_title", "title"):
                    r = r if c in r.columns else r.withColumn(c, F.lit(""))
                r = r.withColumnRenamed("gene_id", "gene").withColumnRenamed("experiment_acc", "experiment")
                tables["records"].append(own(r, data_set))
                tables["experiments"].append(own(expression.experiment_titles(r).select("experiment", "short_title", "title"), data_set))
            rows.append((data_set, genome, given.get("label") or data_set, n))
        orders = {"samples": ("sample_idx",), "values": ("gene",), "records": ("gene", "line"), "experiments": ("experiment",)}
        for name, parts in tables.items():
            if parts:
                whole = parts[0]
                for p in parts[1:]:
                    whole = whole.unionByName(p, allowMissingColumns=True)
                snap.write(whole, name, by=("dataset_id",), order=orders[name], dealt=True, bloom=("gene",) if "gene" in whole.columns else ())
        snap.write(spark.createDataFrame(rows, "dataset_id string, genome string, label string, samples long"), "datasets")
    return snapshot.read(spark, out, "datasets")
