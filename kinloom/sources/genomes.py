"""Readers of coordinates, sequences, clusters and structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import ids
from kinloom.sources.lines import content, fields, lines, stem, table

#: File suffixes. Fixed values.
BED, FASTA = (".bed6.gz", ".bed.gz", ".bed6", ".bed"), (".fasta.gz", ".fa.gz", ".faa.gz", ".fna.gz", ".fasta", ".fa", ".faa", ".fna")


def bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(gene_id, accession, chr, begin_pos, end_pos, strand, subgenome, src); rows of fewer than six fields or without whole numbers go.
    The accession is the file's name, the gene id that of the seventh field if there is one."""
    p = content(lines(spark, path)).select(fields(F.col("line")).alias("f"), "file", "src")
    p = p.filter(F.size("f") >= 6).select(
        ids.canonical_id(F.col("f")[3]).alias("gene_id"), stem(F.col("file"), BED).alias("accession"), ids.chromosome(F.col("f")[0]).alias("chr"),
        F.trim(F.col("f")[1]).try_cast("long").alias("begin_pos"), F.trim(F.col("f")[2]).try_cast("long").alias("end_pos"), F.trim(F.col("f")[5]).alias("strand"), "src",
    )
    return p.filter(F.col("begin_pos").isNotNull() & F.col("end_pos").isNotNull()).withColumn("subgenome", ids.subgenome(F.col("chr")))


def gene_universe(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(gene_id): the distinct ids in the fourth field; a line of fewer fields is an error."""
    rows = content(lines(spark, path)).select(F.col("line"), fields(F.trim("line")).alias("f"))
    bad = rows.filter(F.size("f") < 4).select("line").first()
    if bad:
        raise ValueError(f"fewer than 4 fields: {bad.line[:80]!r}")
    return rows.select(F.trim(F.col("f")[3]).alias("gene_id")).filter("gene_id <> ''").distinct()


def bed7(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line) in six fields, the id from the seventh field where there is one."""
    f = F.col("f")
    name = F.when((F.size(f) >= 7) & (F.trim(F.get(f, F.lit(6))) != ""), F.get(f, F.lit(6))).otherwise(f[3])
    return content(lines(spark, path)).select(fields(F.col("line")).alias("f")).filter(F.size("f") >= 6).select(F.concat_ws("\t", f[0], f[1], f[2], name, f[4], f[5]).alias("line"))


def gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Genes of a GFF file in BED form: starts one less; the id from ID, else gene_id, else Name, without quotes and a leading `gene:`."""
    f = F.col("f")
    attribute = lambda k: F.nullif(F.regexp_extract(f[8], rf'(?:^|;)\s*{k}[= ]"?([^";]+)', 1), F.lit(""))
    rows = content(lines(spark, path)).select(fields(F.col("line")).alias("f"), "src").filter((F.size("f") >= 9) & (F.lower(f[2]) == "gene"))
    name = F.regexp_replace(F.trim(F.coalesce(attribute("ID"), attribute("gene_id"), attribute("Name"))), "^gene:", "")
    out = rows.select(f[0].alias("chr"), (f[3].try_cast("long") - 1).alias("begin_pos"), f[4].try_cast("long").alias("end_pos"), name.alias("gene_id"), f[6].alias("strand"), "src")
    return out.filter("gene_id IS NOT NULL AND begin_pos IS NOT NULL AND end_pos IS NOT NULL")


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(header, name, seq, accession, src) of records that may span lines; a `>` inside a line starts none."""
    rows = lines(spark, path, "\n>").select(F.regexp_replace("line", "^>", "").alias("rec"), "file", "src").filter(F.trim("rec") != "")
    header = F.trim(F.regexp_extract("rec", r"^([^\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace("rec", r"^[^\n]*", ""), r"\s", "")
    return rows.select(header.alias("header"), F.split(header, r"\s+")[0].alias("name"), seq.alias("seq"), stem(F.col("file"), FASTA).alias("accession"), "src")


def resolved(records: DataFrame, genes: DataFrame) -> DataFrame:
    """Records with the first word of their header, the id before the description, that is a known gene; others go."""
    words = records.select("src", "seq", F.posexplode(F.split("header", r"\s+")).alias("pos", "word"))
    known = words.withColumn("gene_id", ids.canonical_id(F.col("word"))).join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    best = known.groupBy("src").agg(F.min(F.struct("pos", "gene_id", "seq")).alias("b"))
    return best.select("b.gene_id", "b.seq", "src")


def cluster_members(spark: SparkSession, path: str | list[str], layout: str | None = None) -> DataFrame:
    """(pangene, gene_id, src, pos): members of clusters in wide form (a line a cluster) or long form (a line a member).

    Without a layout each file's first line decides: more than two fields make the file wide.
    """
    rows = content(lines(spark, path)).select(fields(F.col("line")).alias("f"), "file", "src").filter(F.size("f") >= 2)
    if layout is None:
        first = rows.groupBy("file").agg(F.min(F.struct("src", F.size("f").alias("n"))).alias("first"))
        rows = rows.join(first.select("file", (F.col("first.n") > 2).alias("wide")), "file")
    else:
        rows = rows.withColumn("wide", F.lit(layout == "wide"))
    last = F.when(F.col("wide"), F.size("f") - 1).otherwise(1)
    out = rows.select(F.trim(F.col("f")[0]).alias("pangene"), "src", F.posexplode(F.slice("f", F.lit(2), last)).alias("pos", "gene"))
    return out.filter(F.trim("gene") != "").select("pangene", ids.canonical_id(F.col("gene")).alias("gene_id"), "src", "pos")


def is_packed(spark: SparkSession, path: str | list[str], sample: int = 50) -> bool:
    """Whether both names of each of the first lines (rep, member) are packed with their places."""
    f = F.col("f")
    some = lines(spark, path).filter(F.trim("line") != "").select(fields(F.col("line")).alias("f")).filter(F.size(f) >= 2).limit(sample)
    n, plain = some.agg(F.count("*"), F.count_if(~(F.contains(f[0], F.lit("__")) & F.contains(f[1], F.lit("__"))))).first()
    return n > 0 and plain == 0


def representatives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rep, member) of clusters with their representatives, each of a cluster's genes once, the representative among them."""
    f = F.col("f")
    rows = lines(spark, path).filter(F.trim("line") != "").select(fields(F.col("line")).alias("f")).filter(F.size(f) >= 2)
    return rows.select(f[0].alias("rep"), F.explode(F.array(f[0], f[1])).alias("member")).distinct()


def match_rows(pairs: DataFrame) -> DataFrame:
    """Eight columns, the places of both genes, of pairs (a, b) of packed genes; one row for each two genes, whatever their order; pairs that cannot be unpacked go."""
    x, y = ids.packed_gene(F.col("a")), ids.packed_gene(F.col("b"))
    both = pairs.select(x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    cols = [F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "x"), (2, "y")) for c in ("chr", "gene_id", "begin_pos", "end_pos")]
    key = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in ("chr", "gene_id", "begin_pos", "end_pos")])
    return both.withColumn("turned", key("x") > key("y")).select(F.when(F.col("turned"), F.col("y")).otherwise(F.col("x")).alias("x"), F.when(F.col("turned"), F.col("x")).otherwise(F.col("y")).alias("y")).select(*cols).distinct()


def structures(spark: SparkSession, q3: str | list[str], q8: str | list[str]) -> DataFrame:
    """(gene_id, q3, q8) from two kinds of files, blank where one has none; rows blank in both go."""
    a = table(spark, q3, ",").select(ids.canonical_id(F.col("id")).alias("gene_id"), F.trim("q3_decoded").alias("q3"))
    b = table(spark, q8, ",").select(ids.canonical_id(F.col("id")).alias("gene_id"), F.trim("q8_decoded").alias("q8"))
    both = a.join(b, "gene_id", "full").select("gene_id", F.coalesce("q3", F.lit("")).alias("q3"), F.coalesce("q8", F.lit("")).alias("q8"))
    return both.filter("q3 <> '' OR q8 <> ''")


