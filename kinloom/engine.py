"""What a user asks of the indexes that build makes: one method for each kind of request, DataFrames in and out.

Limits of a request are checked before a plan is made. Lookups are filters on stored columns that the tables are sorted by or have Bloom filters on, so they read
few row groups; parts of identifiers go through trigrams, words through lists of prefixes with bounds. What joins all genes is stored in buckets of the gene.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import guards, ids, snapshot, text
from kinloom.functions.scratch import listed
from kinloom.operators import alignment, coords, dedup, expression, keyword, lookup, members, prefixes, similarity, sinks
from kinloom.operators.pick import pick, prioritised_lookup
from kinloom.sources import annotations
from kinloom.sources.lines import table

#: How many genes a search and a suggestion list show, and reference genes and clusters a keyword search. Fixed values.
FOUND, SUGGESTED, REFS, GROUPS = 200, 15, 25, 100


class Engine:
    """Indexes of variants in genomes/<variant>, of keywords in keywords, of expression in expression, under one root."""

    def __init__(self, spark: SparkSession, root: str, config: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        folders = [n for n, _, folder in listed(spark, f"{self.root}/genomes") if folder and n != "stats"]
        self.catalogue = annotations.catalogue(config) if config else annotations.catalogue_of_folder(folders)
        self.installed = [v for s in self.catalogue.values() for v in s["variants"] if v in folders]

    def resolve(self, name: str) -> str:
        """A variant by its own name, or a species' first installed one."""
        name = name.strip().lower()
        if name in self.installed:
            return name
        for v in self.catalogue.get(name, {}).get("variants", ()):
            if v in self.installed:
                return v
        raise KeyError(f"no index of {name}")

    def _folder(self, variant: str) -> str:
        return f"{self.root}/genomes/{self.resolve(variant)}"

    def table(self, variant: str, name: str) -> DataFrame:
        return snapshot.read(self.spark, self._folder(variant), name)

    def bucketed(self, variant: str, name: str) -> DataFrame:
        """genes_by_place and coords_by_place, in buckets of gene and accession; genes_by_id, prot_by_id and cds_by_id, of the gene: joins by these shuffle nothing."""
        return snapshot.bucketed(self.spark, self._folder(variant), name)

    def has(self, variant: str, name: str) -> bool:
        return name in snapshot.tables(self.spark, self._folder(variant))

    def species_of(self, variant: str) -> str:
        """The species that a variant belongs to."""
        name = self.resolve(variant)
        return next((s for s, e in self.catalogue.items() if name in e["variants"]), name)

    def cluster(self, name: str, variant: str) -> str:
        """The stored id of a cluster that a user names, with or without its prefix."""
        return self.spark.range(1).select(ids.asked_cluster_id(F.lit(self.species_of(variant)), F.lit(name)).alias("c")).first().c

    def stats(self, variant: str) -> DataFrame:
        """Accessions, clusters and genes as they are shown, with thousands commas."""
        rows = snapshot.read(self.spark, f"{self.root}/genomes/stats", "stats").filter(F.col("species") == variant.strip().lower())
        return rows.select("species", *[F.format_number(c, 0).alias(c) for c in ("accessions", "pan_genes", "genes")])

    # genes and clusters

    def search(self, query: str, variant: str | None = None) -> DataFrame:
        """Genes by id; without a variant the prefix of the id tells the species."""
        q = self.spark.range(1).select(text.cleaned_query(F.lit(query)).alias("q"), members.route(F.lit(query.strip())).alias("species")).first()
        name = variant or q.species or self.installed[0]
        genes = self.table(name, "genes")
        return lookup.search(genes, self.table(name, "trigrams"), self.table(name, "trigram_counts"), q.q, FOUND) if q.q else genes.limit(0)

    def suggest(self, part: str, variant: str) -> DataFrame:
        sizes = self.table(variant, "clusters")
        found = lookup.suggestions(self.table(variant, "genes"), self.table(variant, "trigrams"), self.table(variant, "trigram_counts"), part.strip(), SUGGESTED)
        return members.with_size(found, sizes.select("pangene", "gene_count")).orderBy("gene_id")

    def pangene(self, cluster: str, variant: str) -> DataFrame:
        """Members with their coordinates, by accession and id."""
        genes = self.table(variant, "genes").filter(F.col("pangene") == self.cluster(cluster, variant)).drop("gene_key")
        return members.with_places(genes, self.bucketed(variant, "coords_by_place")).orderBy("accession", "gene_id")

    def genes_with_places(self, variant: str) -> DataFrame:
        """All genes with their clusters and coordinates, bucket by bucket."""
        return members.with_places(self.bucketed(variant, "genes_by_place"), self.bucketed(variant, "coords_by_place"))

    def genes_with_sequences(self, variant: str, kind: str = "prot") -> DataFrame:
        """All genes that have a sequence, with it, bucket by bucket."""
        return self.bucketed(variant, "genes_by_id").join(self.bucketed(variant, f"{kind}_by_id"), "gene_id")

    def is_large(self, cluster: str, variant: str) -> bool:
        row = self.table(variant, "clusters").filter(F.col("pangene") == self.cluster(cluster, variant)).first()
        return bool(row) and guards.is_large(row.gene_count)

    def subgenomes(self, cluster: str, variant: str) -> DataFrame:
        return members.partitioned(self.pangene(cluster, variant), guards.ALIGNED)

    def picker(self, clusters: list[str], current: str, variant: str) -> DataFrame:
        """Clusters with their dominant subgenome, the current one first."""
        genes = self.table(variant, "genes").filter(lookup.among("pangene", [self.cluster(c, variant) for c in guards.listed_ids(clusters)]))
        counts = members.subgenome_counts(members.with_places(genes, self.bucketed(variant, "coords_by_place")))
        return counts.withColumn("is_current", F.col("pangene") == self.cluster(current, variant)).orderBy(F.desc("is_current"), "pangene")

    def sequences(self, genes: list[str], variant: str, kind: str = "prot") -> DataFrame:
        """Stored sequences of the genes asked, by id or its variants, in the order asked."""
        asked = self.spark.createDataFrame(list(enumerate(guards.listed_ids(genes))), "pos int, asked string")
        variants = ids.id_variants(F.col("asked"))
        found = prioritised_lookup(asked, lookup.rows_of(self.table(variant, f"{kind}_map"), asked, variants, "id"), variants, F.col("id"))
        return dedup.stored(found.filter("uniq_id IS NOT NULL").select("id", "uniq_id", "pos", "asked"), self.table(variant, f"{kind}_sequences")).join(asked, F.col("id").isNotNull() & (F.col("id") == F.col("asked")), "left").select("id", "seq")

    def cluster_sequences(self, clusters: list[str], variant: str, kind: str = "prot") -> tuple[DataFrame, list[str]]:
        """(pangene, id, seq) of all members of several clusters, and which of these have none. Clusters are taken in order of their ids; an id that several
        have keeps the last one's. No clusters, or fewer than two sequences, are an error."""
        asked = sorted({self.cluster(c, variant) for c in guards.listed_ids(clusters)})
        if not asked:
            raise ValueError("no clusters")
        own = self.table(variant, "genes").filter(lookup.among("pangene", asked)).select("pangene", F.col("gene_id").alias("id"))
        mapping = pick(self.table(variant, f"{kind}_map").join(own, "id"), ["id"], [F.col("pangene")], last=True)
        rows = mapping.join(self.table(variant, f"{kind}_sequences"), "uniq_id").select("pangene", "id", "seq").orderBy("pangene", "id")
        counts = {r.pangene: r.n for r in own.join(mapping.select("id"), "id").groupBy("pangene").agg(F.count("*").alias("n")).collect()}
        if rows.limit(2).count() < 2:
            raise ValueError("fewer than two sequences")
        return rows, [c for c in asked if c not in counts]

    def _listed(self, name: str, variant: str, columns: tuple[str, ...], need: str) -> DataFrame:
        """Rows of a small table beside the indexes that are of the variant's species or of none; blank where a column or the file is missing."""
        path = f"{self.root}/{name}"
        none = self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        if not any(n == name and not folder for n, _, folder in listed(self.spark, self.root)):
            return none
        rows = table(self.spark, path, ",")
        value = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
        rows = rows.select(*[(F.lower(value(c)) if c == "genome" else value(c)).alias(c) for c in columns])
        return annotations.scoped(rows.filter(F.col(need) != ""), self.species_of(variant))

    def accession_table(self, variant: str) -> DataFrame:
        """(genome, accession, source, version, link) from genomes.csv."""
        return self._listed("genomes.csv", variant, ("genome", "accession", "source", "version", "link"), "accession")

    def links(self, genes: list[str], variant: str) -> DataFrame:
        """(gene_id, database, type, accession, url) from links.csv: addresses with the gene and its place filled in. A row with an accession is for its genes only; one that
        needs a place is left out for genes without one."""
        rows = self._listed("links.csv", variant, ("genome", "database", "type", "accession", "url"), "url").collect()  # a species' list of sites
        among = lookup.among("gene_id", guards.listed_ids(genes))
        placed = members.with_places(self.table(variant, "genes").filter(among).select("gene_id", "accession"), self.table(variant, "gene_coords").filter(among))
        values = {"gene_id": F.col("gene_id"), "chr": F.col("chr"), "start": F.col("begin_pos"), "end": F.col("end_pos")}
        one = lambda r: F.when(
            (F.lit(r.accession == "") | (F.lower("accession") == r.accession.lower())) & (F.col("begin_pos").isNotNull() | F.lit(not any(f"{{{v}}}" in r.url for v in ("chr", "start", "end")))),
            F.struct(*[F.lit(r[c]).alias(c) for c in ("database", "type", "accession")], text.templated(r.url, values).alias("url")),
        )
        found = F.array(*map(one, rows)) if rows else F.array().cast("array<struct<database:string,type:string,accession:string,url:string>>")
        return placed.select("gene_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("l")).select("gene_id", "l.*").orderBy("gene_id", "database", "type", "url")

    def neighborhood(self, focals: list[tuple[str, str]], five: int, three: int, variant: str) -> DataFrame:
        """Slots around (gene, accession), each with the cluster of its gene."""
        guards.tracks(len(focals))
        five, three = (max(0, min(15, n)) for n in (five, three))
        asked = self.spark.createDataFrame(focals, "gene_id string, accession string").distinct()
        slots = coords.neighbourhoods(self.table(variant, "gene_coords"), asked, five, three)
        clusters = self.table(variant, "genes").select("gene_id", "pangene")
        return slots.join(clusters, "gene_id", "left").withColumn("colour", text.palette_slot(F.col("pangene"))).orderBy("focal", "accession", "slot")

    # exports

    def gene_list(self, cluster: str, variant: str) -> DataFrame:
        return members.gene_list(self.table(variant, "genes").filter(F.col("pangene") == self.cluster(cluster, variant)), self.bucketed(variant, "coords_by_place"))

    def download(self, cluster: str, variant: str, kind: str, path: str, force: bool = False) -> None:
        """gene_list, prot or cds of a cluster as a file."""
        if kind == "gene_list":
            sinks.lines(self.gene_list(cluster, variant).withColumnRenamed("line", "value"), path, force)
            return
        own = self.table(variant, "genes").filter(F.col("pangene") == self.cluster(cluster, variant)).select(F.col("gene_id").alias("id"))
        mapping = self.table(variant, f"{kind}_map").join(own, "id", "left_semi")
        sinks.fasta(dedup.stored(mapping, self.table(variant, f"{kind}_sequences")).orderBy("id"), path, "id", "seq", force=force)

    # alignments that the caller brings

    def _aligned(self, sequences: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame([("a", g, s, k) for k, (g, s) in enumerate(sequences.items())], "grp string, gene_id string, seq string, ord int")

    def alignment_statistics(self, sequences: dict[str, str]) -> DataFrame:
        guards.aligned(list(sequences))
        return alignment.columns(alignment.long_form(alignment.sane(self._aligned(sequences)))).orderBy("col")

    def variants(self, sequences: dict[str, str]) -> DataFrame:
        return alignment.variant_columns(alignment.long_form(alignment.sane(self._aligned(sequences)))).orderBy("col")

    def kaks(self, sequences: dict[str, str], reference: str, variant: str, half: int | None = None) -> DataFrame:
        """Rates against the chosen gene from the stored coding sequences, errors among them; with half a profile along the columns."""
        guards.rated(sequences, reference)
        aln = alignment.long_form(self._aligned(sequences))
        cds = self.sequences(list(sequences), variant, "cds").select(F.col("id").alias("gene_id"), F.col("seq").alias("cds"))
        lead = self.spark.createDataFrame([("a", reference)], "grp string, gene_id string")
        subs = alignment.substitutions(alignment.codons(aln, cds), alignment.codon_table(self.spark), lead)
        if half is not None:
            return alignment.sliding(subs, half).orderBy("col")
        errors = alignment.codon_errors(aln, cds).filter(F.col("error").isNotNull() & (F.col("gene_id") != reference))
        return alignment.pairwise(subs).unionByName(errors, allowMissingColumns=True).orderBy("gene_id")

    def track_order(self, sequences: dict[str, str]) -> DataFrame:
        guards.ordered(sequences)
        return similarity.track_order(self._aligned(sequences)).select("gene_id", "rank").orderBy("rank")

    # keywords

    def keyword_table(self, name: str) -> DataFrame:
        return snapshot.read(self.spark, f"{self.root}/keywords", name)

    @cached_property
    def metadata(self) -> dict[str, str]:
        """Of the keyword index; one of an older layout is an error."""
        out = {r.k: r.v for r in self.keyword_table("meta").collect()}
        if int(out.get("schema_version", 0)) < sinks.SCHEMA_VERSION:
            raise ValueError("the keyword index is of an older layout: build it again")
        return out

    def _hits(self, data_set: str) -> DataFrame:
        assert self.metadata
        return self.keyword_table("hits").filter(F.col("dataset_id") == data_set.strip().lower())

    def references(self, query: str, data_set: str, chosen: list[str] | None = None) -> DataFrame:
        """Cards of the reference genes that the query finds and that have hits: names first, then texts by rank; chosen ones beyond the limit."""
        found = self.spark.range(1).select(text.tokens(F.lit(query)).alias("tokens"), text.alias_terms(F.lit(query)).alias("terms")).first()
        aliases = self.keyword_table("aliases").filter(F.col("alias_norm").isin(*found.terms)).select("ref_id").distinct()
        by_text = prefixes.best(self.spark, f"{self.root}/keywords", "ref_id", found.tokens, keyword.candidate_cap(REFS)) if found.tokens else aliases.limit(0).withColumn("score", F.lit(0.0))
        selected = self.keyword_table("refs").filter(F.upper("ref_id").isin(*[c.strip().upper() for c in chosen])).select("ref_id") if chosen else None
        matched = keyword.matched_refs(aliases, by_text, self._hits(data_set), REFS, selected)
        cards = keyword.cards(self.keyword_table("refs"), found.tokens)
        out = matched.join(cards, "ref_id")
        is_chosen = F.upper("ref_id").isin(*[c.strip().upper() for c in chosen]) if chosen else F.lit(False)
        return out.withColumn("selected", is_chosen).orderBy("rank", "ref_id")

    def keyword_groups(self, chosen: list[str], data_set: str, variant: str | None = None, max_evalue: float = keyword.MAX_EVALUE) -> DataFrame:
        """Clusters ranked by the hits of the chosen reference genes; those of a variant's own set where one is given. Nothing chosen, nothing found."""
        hits = self._hits(data_set)
        if not chosen:
            hits = hits.limit(0)
        genes = self.table(variant, "genes") if variant else None
        sizes = self.table(variant or data_set, "clusters").select("pangene", F.col("gene_count").alias("size"))
        return keyword.selected_groups(hits.select("gene_id", "accession", "pangene", "species", "ref_id", "evalue", "pident"), [c.strip() for c in chosen], genes, sizes, max_evalue, GROUPS)

    def best_annotations(self, genes: list[str], data_set: str) -> DataFrame:
        asked = self.spark.createDataFrame([(g,) for g in guards.listed_ids(genes)], "gene_id string")
        refs = self.keyword_table("refs")
        whole = F.when(F.col("species") == "arabidopsis", text.sentences(F.col("short"), F.col("curator"), F.col("computed"))).otherwise(F.trim("description"))
        return keyword.annotations(asked, self._hits(data_set), refs.select("ref_id", whole.alias("description")), ("arabidopsis", "rice"))

    # expression

    def _expression(self, name: str, data_set: str | None = None) -> DataFrame:
        table = snapshot.read(self.spark, f"{self.root}/expression", name)
        return table if data_set is None else table.filter(F.col("dataset_id") == data_set)

    def data_set_of(self, gene: str, genome: str | None = None):
        """(dataset_id, genome) of the data set that answers for a gene: one of the genome, else one with a sample of it, else the first; None if no set has it."""
        values, sets = self._expression("values").filter(F.col("gene") == gene.strip()), self._expression("datasets").select("dataset_id", "genome")
        named = self._expression("samples").select("dataset_id", F.trim("genome").alias("genome"))
        wanted = genome.strip() if genome and genome.strip() else "\x00"  # no genome is named so
        owner = expression.owner(sets, named, values.select("gene", "dataset_id"), wanted)
        return owner.join(sets, "dataset_id").select("dataset_id", "genome").first()

    def expression_of(self, gene: str, genome: str | None = None) -> tuple[str, DataFrame | None]:
        """(status, statistics by experiment and group) of a gene, from the data set that answers for it: ok, no_data or not_found."""
        owner = self.data_set_of(gene, genome)
        if owner is None:
            return "not_found", None
        values = self._expression("values", owner.dataset_id).filter(F.col("gene") == gene.strip())
        rows = expression.read_arrays(values, self._expression("samples", owner.dataset_id), ("dataset_id",))
        stats = expression.tissue_stats(rows).orderBy("organ", "experiment", "grp")
        return ("no_data" if stats.isEmpty() else "ok"), stats

    def response(self, gene: str, genome: str | None = None) -> dict:
        """All that is known of a gene's expression: status, data_set, genome, tissue (statistics), differential (records with their experiment's title and index), and the
        data set's categories of records, with those of which the gene has none (without). What is not there is None or empty."""
        out: dict = {"gene": gene.strip(), "status": "not_found", "data_set": None, "genome": None, "tissue": None, "differential": None, "categories": [], "without": []}
        owner = self.data_set_of(gene, genome) if gene.strip() else None
        if owner is None:
            return out
        out["status"], out["tissue"] = self.expression_of(gene, genome)
        out |= {"data_set": owner.dataset_id, "genome": owner.genome or None}
        if "records" in snapshot.tables(self.spark, f"{self.root}/expression"):
            records = self._expression("records", owner.dataset_id).filter(F.coalesce("category", F.lit("")) != "")
            out["differential"] = self.differential(gene, owner.dataset_id)
            out["categories"] = sorted(r.category for r in records.select("category").distinct().collect())
            has = {r.category for r in records.filter(F.col("gene") == gene.strip()).select("category").distinct().collect()}
            out["without"] = [c for c in out["categories"] if c not in has]
        return out

    def differential(self, gene: str, data_set: str) -> DataFrame:
        own = lambda name: self._expression(name, data_set).drop("dataset_id")
        rows = own("records").filter(F.col("gene") == gene.strip()).drop("title", "short_title")
        titles = own("experiments").select("experiment", F.coalesce(F.nullif("short_title", F.lit("")), F.nullif("title", F.lit(""))).alias("title"))
        return expression.differential(rows, titles).orderBy("category", "experiment", "comparison")
