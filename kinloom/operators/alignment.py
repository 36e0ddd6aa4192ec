"""Columns of alignments: consensus, conservation, variants, and codon substitution rates.

Alignments are in long form: (grp, gene_id, ord, col, aa), columns from 1. A shorter sequence is filled with gaps.

Spark judges a table by the bytes of the files that it comes from, and long form is many times larger; so joins that meet it say that they are by shuffle, as nothing that
grows with the input may be broadcast.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.spread import spread

#: Standard genetic code, codons in order of TCAG at each place. Fixed value.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def long_form(rows: DataFrame) -> DataFrame:
    """Long form of (grp, gene_id, seq), every sequence as long as its group's longest. ord is the place of a sequence in its alignment, as rows give it; without it, the id."""
    rows = rows if "ord" in rows.columns else rows.withColumn("ord", F.col("gene_id"))
    length = rows.groupBy("grp").agg(F.max(F.length("seq")).alias("n"))
    full = rows.join(length.hint("merge"), "grp").withColumn("seq", F.rpad("seq", F.col("n"), F.lit("-")))
    full = spread(full.select("grp", "gene_id", "ord", "seq"), "grp", "gene_id", of=rows)
    return full.select("grp", "gene_id", "ord", F.posexplode(F.split("seq", "")).alias("col", "aa")).withColumn("col", F.col("col") + 1)


def sane(rows: DataFrame) -> DataFrame:
    """Rows of (gene_id, seq) that a client may send: ids of up to 256 characters, sequences of 1 to 120,000 of the alphabet, whose letters are one byte each."""
    return rows.filter(F.length("gene_id").between(1, 256) & F.octet_length("seq").between(1, 120_000) & F.col("seq").rlike(r"^[A-Z.*-]+$"))


def residue_counts(aln: DataFrame) -> DataFrame:
    return aln.groupBy("grp", "col", "aa").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def columns(aln: DataFrame) -> DataFrame:
    """Consensus and conservation of each column: the most frequent residue, of equals that of the first sequence by ord; a gap and 0 for a column of gaps."""
    residue = F.col("aa") != "-"
    top = F.min(F.when(residue, F.struct((-F.col("n")).alias("o"), "first", "aa")))
    out = residue_counts(aln).groupBy("grp", "col").agg(top.alias("top"), F.sum(F.when(residue, F.col("n"))).alias("total"))
    return out.select("grp", "col", F.coalesce("top.aa", F.lit("-")).alias("consensus"), F.coalesce(F.round(-F.col("top.o") / F.col("total"), 6), F.lit(0.0)).alias("conservation"))


def consensus(aln: DataFrame) -> DataFrame:
    cols = columns(aln)
    return cols.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "consensus"))), lambda x: x["consensus"]), "").alias("consensus"))


def variant_columns(aln: DataFrame) -> DataFrame:
    """Columns in which some sequence differs from the first by id: how many do, their share, and how many residues there are."""
    first = aln.groupBy("grp").agg(F.min("gene_id").alias("gene_id"))
    ref = aln.join(first.hint("merge"), ["grp", "gene_id"]).select("grp", "col", F.col("aa").alias("ref"))
    cells = aln.join(ref.hint("merge"), ["grp", "col"])
    out = cells.groupBy("grp", "col", "ref").agg(F.count_if(F.col("aa") != F.col("ref")).alias("differ"), F.count("*").alias("n"), F.count_distinct("aa").alias("residues"))
    return out.filter("differ > 0").select("grp", "col", "ref", "differ", F.round(F.col("differ") / F.col("n"), 6).alias("frequency"), "residues")


def variant_matrix(aln: DataFrame) -> DataFrame:
    """A line for each sequence: its residues in the variant columns."""
    cells = aln.join(variant_columns(aln).select("grp", "col").hint("merge"), ["grp", "col"])
    return cells.groupBy("grp", "gene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "aa"))), lambda x: x["aa"]), "\t").alias("line"))


def cell_classes(aln: DataFrame) -> DataFrame:
    """How many cells of each sequence are gaps, match the consensus, or differ."""
    cells = aln.join(columns(aln).select("grp", "col", "consensus").hint("merge"), ["grp", "col"])
    gap = F.col("aa") == "-"
    return cells.groupBy("grp", "gene_id").agg(F.count_if(gap).alias("gap"), F.count_if(~gap & (F.col("aa") == F.col("consensus"))).alias("match"), F.count_if(~gap & (F.col("aa") != F.col("consensus"))).alias("diff"))


def codon_table(spark: SparkSession) -> DataFrame:
    """(codon, aa, syn): each codon, its amino acid (null for stops) and its synonymous sites; 64 rows made from the code."""
    code = dict(zip(map("".join, product("TCAG", repeat=3)), GENETIC_CODE, strict=True))
    rows = []
    for codon, aa in code.items():
        same = sum(code[codon[:i] + b + codon[i + 1 :]] == aa for i in range(3) for b in "TCAG" if b != codon[i])
        rows.append((codon, None if aa == "*" else aa, 0.0 if aa == "*" else same / 3.0))
    return spark.createDataFrame(rows, "codon string, aa string, syn double")


def codons(aln: DataFrame, cds: DataFrame) -> DataFrame:
    """Long form with the codon of each residue, --- for gaps: the k-th residue takes the k-th codon of the cleaned coding sequence.

    Sequences whose coding sequence is missing or too short are left out; see codon_errors.
    """
    clean = cds.select("gene_id", F.regexp_replace(F.upper("cds"), "[^ATCG]", "").alias("cds"))
    order = Window.partitionBy("grp", "gene_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    ranked = aln.withColumn("k", F.sum((F.col("aa") != "-").cast("int")).over(order))
    need = aln.groupBy("grp", "gene_id").agg(F.count_if(F.col("aa") != "-").alias("need"))
    fit = clean.join(need.hint("merge"), "gene_id").filter((F.col("need") > 0) & (F.length("cds") >= 3 * F.col("need"))).select("grp", "gene_id", "cds")
    codon = F.when(F.col("aa") == "-", "---").otherwise(F.substring("cds", 3 * F.col("k") - 2, F.lit(3)))
    return ranked.join(fit.hint("merge"), ["grp", "gene_id"]).select("grp", "gene_id", "col", codon.alias("codon"))


def codon_errors(aln: DataFrame, cds: DataFrame) -> DataFrame:
    need = aln.groupBy("grp", "gene_id").agg(F.count_if(F.col("aa") != "-").alias("need"))
    n = F.length(F.regexp_replace(F.upper("cds"), "[^ATCG]", ""))
    error = F.when(F.col("cds").isNull() | (F.col("cds") == ""), "no_cds").when((F.col("need") == 0) | (n < 3 * F.col("need")), "cds_length_mismatch")
    return need.join(cds.hint("merge"), "gene_id", "left").select("grp", "gene_id", error.alias("error"))


def substitutions(coded: DataFrame, table: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(grp, gene_id, col, s, n, sd, nd): sites and differences of each column against the group's reference: its sequence in
    references (grp, gene_id), or its first one without. A group whose reference has no codons gives no rows.

    A column counts if both codons are amino acids. Sites are the mean of both codons'; a differing codon is one difference, of the same
    amino acid a synonymous one.
    """
    first = coded.groupBy("grp").agg(F.min("gene_id").alias("gene_id")) if references is None else references.select("grp", "gene_id")
    side = lambda df, n: df.join(F.broadcast(table.select(F.col("codon"), F.col("aa").alias(f"aa{n}"), F.col("syn").alias(f"syn{n}"))), "codon", "left").withColumnRenamed("codon", f"codon{n}")
    ref = side(coded.join(first.hint("merge"), ["grp", "gene_id"]).select("grp", "col", "codon"), 1)
    rest = side(coded.join(first.hint("merge"), ["grp", "gene_id"], "left_anti"), 2)
    both = rest.join(ref.hint("merge"), ["grp", "col"])
    ok = F.col("aa1").isNotNull() & F.col("aa2").isNotNull()
    s = F.when(ok, (F.col("syn1") + F.col("syn2")) / 2).otherwise(0.0)
    differ = ok & (F.col("codon1") != F.col("codon2"))
    same = F.col("aa1") == F.col("aa2")
    return both.select("grp", "gene_id", "col", s.alias("s"), F.when(ok, 3 - s).otherwise(0.0).alias("n"), F.when(differ & same, 1).otherwise(0).alias("sd"), F.when(differ & ~same, 1).otherwise(0).alias("nd"), (F.col("codon1") == "---").alias("ref_gap"))


def rates(s: Column, n: Column, sd: Column, nd: Column) -> tuple[Column, Column, Column]:
    """Ka, Ks and their ratio; null where a divisor is not above 0."""
    ka, ks = F.when(n > 0, nd / n), F.when(s > 0, sd / s)
    return ka, ks, F.when(ks > 0, ka / ks)


def pairwise(subs: DataFrame) -> DataFrame:
    """Totals and rates of each sequence against its group's first; `no_valid_sites` if no column counts."""
    t = subs.groupBy("grp", "gene_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("sd").alias("sd"), F.sum("nd").alias("nd"))
    ka, ks, omega = rates(F.col("s"), F.col("n"), F.col("sd"), F.col("nd"))
    none = (F.col("s") <= 0) & (F.col("n") <= 0)
    r = lambda c: F.round(c, 6)
    return t.select("grp", "gene_id", r(F.col("s")).alias("s_sites"), r(F.col("n")).alias("n_sites"), "sd", "nd", r(ka).alias("ka"), r(ks).alias("ks"), r(omega).alias("omega"), F.when(none, "no_valid_sites").alias("error"))


def sliding(subs: DataFrame, half: int = 5) -> DataFrame:
    """Mean ratio over sequences in a window of columns around each column; null where the first sequence has a gap or no sequence a ratio.

    The windows are frames within one sequence of one group.
    """
    half = max(1, min(half, 80))
    w = Window.partitionBy("grp", "gene_id").orderBy("col").rowsBetween(-half, half)
    sums = subs.select("grp", "gene_id", "col", "ref_gap", *[F.sum(c).over(w).alias(c) for c in ("s", "n", "sd", "nd")])
    omega = rates(F.col("s"), F.col("n"), F.col("sd"), F.col("nd"))[2]
    return sums.groupBy("grp", "col").agg(F.round(F.avg(F.when(~F.col("ref_gap"), omega)), 6).alias("omega"))
