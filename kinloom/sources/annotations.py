"""Readers of descriptions, aliases, hits, expression tables, and small configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import ids, text
from kinloom.sources.lines import delimiter, lines, renamed, required, source_order, stem, table

#: Other names of columns in expression files. Fixed values.
SAMPLE_ALIASES = {"sample_acc": ("sample", "sample_id", "run", "sample_accession"), "experiment_acc": ("experiment", "study", "study_acc"), "organ": ("tissue",), "group": ("sample_group", "condition"), "genome": ("accession", "variety")}
RECORD_ALIASES = {"gene_id": ("gene", "geneid"), "experiment_acc": ("experiment", "study"), "logfc": ("log2fc", "log2foldchange", "logfoldchange"), "fdr": ("padj", "adj.p.val", "qvalue")}


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(locus, transcript, short, curator, computed) of a description table."""
    need = ("name", "gene_model_type", "short_description", "Curator_summary", "Computational_description")
    t = required(table(spark, path), need, "descriptions")
    return t.select(ids.locus(F.col("name")).alias("locus"), F.trim("name").alias("transcript"), text.present(F.col("short_description")).alias("short"), text.present(F.col("Curator_summary")).alias("curator"), text.present(F.col("Computational_description")).alias("computed"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    t = required(table(spark, path), ("locus_name", "symbol", "full_name"), "aliases")
    return t.select(ids.locus(F.col("locus_name")).alias("locus"), text.present(F.col("symbol")).alias("symbol"), text.present(F.col("full_name")).alias("full_name"))


def rice(spark: SparkSession, path: str) -> DataFrame:
    """(locus, transcript, description, symbols, names): all columns whose name has Symbol or Name feed the lists, in order."""
    t = required(table(spark, path), ("Transcript_ID", "Locus_ID", "Description"), "rice annotation")
    lists = lambda part: F.array_distinct(F.flatten(F.array(F.array().cast("array<string>"), *[text.listed(F.col(f"`{c}`")) for c in t.columns if part in c])))
    return t.select(ids.locus(F.col("Locus_ID")).alias("locus"), F.trim("Transcript_ID").alias("transcript"), text.present(F.col("Description")).alias("description"), lists("Symbol").alias("symbols"), lists("Name").alias("names"))


def rice_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(locus, symbol) of a gene table with lists of symbols."""
    t = required(table(spark, path), ("Symbol", "RAPdb", "MSU"), "rice genes")
    return t.select(ids.locus(F.col("RAPdb")).alias("locus"), F.explode(text.listed(F.col("Symbol"))).alias("symbol")).filter("locus <> ''")


def best_hits(spark: SparkSession, path: str | list[str], species: tuple[str, ...] = ("arabidopsis", "rice")) -> DataFrame:
    """(gene_id, accession, species, ref_id, evalue, pident, src): a row for each species that a line names; the accession is the file's name. src orders the rows by
    file and place, and stays with its row through joins."""
    t = required(table(spark, path), ("gene_id", *species), "hits")
    side = lambda s: F.struct(F.lit(s).alias("species"), ids.locus(text.present(F.col(s))).alias("ref_id"), *[(text.number(F.col(f"{s}_{k}")) if f"{s}_{k}" in t.columns else F.lit(None).cast("double")).alias(k) for k in ("evalue", "pident")])
    rows = t.select(ids.canonical_id(F.col("gene_id")).alias("gene_id"), stem(F.col("_metadata.file_name"), (".tsv.gz", ".tsv")).alias("accession"), source_order().alias("src"), F.explode(F.array(*map(side, species))).alias("h"))
    return rows.select("gene_id", "accession", "h.*", "src").filter("ref_id <> '' AND gene_id <> ''")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples in order of the file; a blank or repeated sample is an error."""
    t = required(renamed(table(spark, path, delimiter(path)), SAMPLE_ALIASES), ("sample_acc",), "samples")
    t = t.withColumn("sample_acc", F.trim("sample_acc"))
    blank, twice = t.agg(F.count_if(F.coalesce("sample_acc", F.lit("")) == ""), F.count("*") - F.count_distinct("sample_acc")).first()
    if blank or twice:
        raise ValueError(f"samples: {blank} blank and {twice} repeated sample_acc")
    # samples of one data set are a driver-sized list: one task reads the file from its start
    return t.coalesce(1).withColumn("sample_idx", F.monotonically_increasing_id().cast("int"))


def matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(gene, sample_acc, value) of a matrix whose first column is the gene; other columns than names are ignored. Missing
    samples, ragged rows, blank genes and what is no number are errors."""
    sep = delimiter(path)
    t = table(spark, path, sep)
    gene = t.columns[0]
    required(t, tuple(names), "matrix")
    wide = lines(spark, path).filter(F.trim("line") != "").agg(F.count_if(F.size(F.split("line", sep, -1)) != len(t.columns))).first()[0]
    if wide:
        raise ValueError(f"matrix: {wide} lines without {len(t.columns)} fields")
    quoted = [F.col(f"`{c}`") for c in names]
    bad = [text.measurement(c).isNull() & ~F.upper(F.trim(F.coalesce(c, F.lit("")))).isin(*text.MISSING_NUMBERS) for c in quoted]
    n_bad, blank = t.agg(F.count_if(F.exists(F.array(*bad), lambda x: x)), F.count_if(F.trim(F.coalesce(F.col(f"`{gene}`"), F.lit(""))) == "")).first()
    if n_bad or blank:
        raise ValueError(f"matrix: {n_bad} rows with bad numbers, {blank} without a gene")
    values = t.select(ids.canonical_id(F.col(f"`{gene}`")).alias("gene"), *[text.measurement(c).alias(n) for c, n in zip(quoted, names, strict=True)])
    return values.unpivot(["gene"], names, "sample_acc", "value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Differential expression; a row without a gene or an experiment is an error."""
    t = required(renamed(table(spark, path, delimiter(path)), RECORD_ALIASES), ("gene_id", "experiment_acc"), "records")
    n = t.agg(F.count_if((F.trim(F.coalesce("gene_id", F.lit(""))) == "") | (F.trim(F.coalesce("experiment_acc", F.lit(""))) == ""))).first()[0]
    if n:
        raise ValueError(f"records: {n} rows without gene_id or experiment_acc")
    for c in ("logfc", "fdr"):
        if c in t.columns:
            t = t.withColumn(c, text.measurement(F.col(c)))
    return t.withColumn("gene_id", ids.canonical_id(F.col("gene_id"))).withColumn("line", F.monotonically_increasing_id())


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(species, accessions, pan_genes, genes) of a statistics table, in lower case. A file without a species column is of the old
    layout: its first row is wheat's. Rows that lack one of the three numbers go; optional numbers are 0 where they are missing."""
    t = table(spark, path)
    t = t.toDF(*[c.strip().lower() for c in t.columns])
    if "species" not in t.columns:
        t = t.limit(1).withColumn("species", F.lit("wheat"))
    need = ("accessions", "pan_genes", "genes")
    required(t, need, "statistics")
    number = lambda c: F.trim(F.col(c)).try_cast("long")
    rest = [F.coalesce(number(c), F.lit(0).cast("long")).alias(c) for c in t.columns if c not in (*need, "species")]
    out = t.select(F.lower(F.trim("species")).alias("species"), *[number(c).alias(c) for c in need], *rest)
    return out.filter(" AND ".join(f"{c} IS NOT NULL" for c in need))


def catalogue_of_folder(stems: list[str]) -> dict[str, dict]:
    """Without a configuration each index in the folder is a species with itself as its only variant."""
    return catalogue(json.dumps({s.lower(): {"variants": {s.lower(): {"label": s[:1].upper() + s[1:]}}} for s in sorted(stems)}))


def catalogue(text_of_config: str) -> dict[str, dict]:
    """Species and their variants from a configuration in JSON, in its order; the first variant is the default. Labels default to names."""
    out = {}
    for species, entry in json.loads(text_of_config).items():
        variants = {v: {"label": v, **x} for v, x in entry.get("variants", {}).items()}
        out[species] = {"label": entry.get("label", species.capitalize()), "variants": variants, "default": next(iter(variants), None)}
    return out


def scoped(rows: DataFrame, species: str) -> DataFrame:
    """Link rows of a species: those that name it or none."""
    return rows if "genome" not in rows.columns else rows.filter(F.lower(F.trim(F.coalesce("genome", F.lit("")))).isin("", species.lower()))


def orthogroup_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, genome, cell) of an orthogroup table in either of its layouts; genome names without their file suffix."""
    t = table(spark, path)
    key, skip = (t.columns[0], 3) if "OG" in t.columns[:3] else (t.columns[0], 1)
    genomes = t.columns[skip:]
    long = t.select(F.col(f"`{key}`").alias("cluster"), *[F.col(f"`{g}`").alias(g.replace(".primary.protein", "")) for g in genomes])
    return long.unpivot(["cluster"], [g for g in long.columns if g != "cluster"], "genome", "cell").filter(F.trim(F.coalesce("cell", F.lit(""))) != "")


def edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(a, b, file, src): the first two fields of each line, between tabs or else blanks; comments and edges to itself go."""
    from kinloom.sources.lines import content, whitespace_fields

    f = F.col("f")
    rows = content(lines(spark, path)).select(whitespace_fields(F.col("line")).alias("f"), "file", "src").filter(F.size("f") >= 2)
    return rows.select(ids.canonical_id(f[0]).alias("a"), ids.canonical_id(f[1]).alias("b"), "file", "src").filter("a <> b")


def collinear_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(a, b) from the sixth field of each line: pairs between semicolons, their ends between a comma."""
    from kinloom.sources.lines import content, fields

    rows = content(lines(spark, path)).select(fields(F.col("line")).alias("f")).filter(F.size("f") >= 6)
    pair = F.split(F.trim("p"), ",", 2)
    out = rows.select(F.explode(F.split(F.col("f")[5], ";")).alias("p")).filter(F.contains("p", F.lit(",")))
    return out.select(F.trim(pair[0]).alias("a"), F.trim(pair[1]).alias("b")).filter("a <> '' AND b <> ''")
