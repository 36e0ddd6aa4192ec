"""Small fixtures whose results follow from the definitions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import ids, numbers, text
from kinloom.functions.scratch import Workspace
from kinloom.functions.spread import spread
from kinloom.operators import alignment, coords, expression, graph, keyword, members, similarity, sinks
from kinloom.operators.pick import pick, prioritised_lookup, ranked
from kinloom.plans import registry, stored, views
from kinloom.sources import annotations, genomes


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_identifiers(spark):
    assert column(spark, ["A|g1", "g2", "A|", "A|b|c"], ids.canonical_id) == ["g1", "g2", "A|", "b|c"]
    assert column(spark, ["1A", "chrD4", "7H", "Un"], ids.subgenome) == ["A", "D", None, None]
    assert column(spark, ["g.2", "g"], ids.id_variants) == [["g.2", "g"], ["g", "g.1"]]
    assert column(spark, ["at1g01010.1", "Os01t0100200-01", "x"], ids.locus) == ["AT1G01010", "Os01g0100200", "x"]
    assert column(spark, ["1A__g__5__9", "1A__g__x__9", "a"], ids.packed_gene)[1:] == [None, None]


def test_stored_values(spark):
    assert column(spark, [0.25, 1e9, None, float("nan"), 0.35, -1.0], numbers.encoded, "double") == [2, 65534, 65535, 65535, 4, 0]
    assert column(spark, [2, 65534, 65535], numbers.decoded, "int") == [0.2, 6553.4, None]


def test_text(spark):
    assert column(spark, ["a, b;b|c / d", "none", None], lambda c: text.piped(text.listed(c))) == ["a|b|c|d", "", ""]
    assert column(spark, ["x."], lambda c: text.sentences(c, F.lit(""), F.lit("y"), F.lit("z"))) == ["x. y. z"]
    assert column(spark, ["A" * 100], lambda c: text.fasta(F.lit("n"), c)) == [">n\n" + "A" * 80 + "\n" + "A" * 20]


def test_pick_and_lookup(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in pick(df, ["k"], [F.col("o")]).collect()} == {"a": "y", "b": "z"}
    asked = spark.createDataFrame([("g.2",), ("h",), ("q",)], "id string")
    table = spark.createDataFrame([("g", 1), ("h.1", 2)], "key string, n int")
    got = prioritised_lookup(asked, table, ids.id_variants(F.col("id")), F.col("key"))
    assert {r.id: r.n for r in got.collect()} == {"g.2": 1, "h": 2, "q": None}


def test_sizes_count_repetitions(spark):
    m = spark.createDataFrame([("g1", "p1"), ("g1", "p2"), ("g2", "p1")], "gene_id string, pangene string")
    assert {r.pangene: (r.gene_count, r.distinct_gene_count) for r in members.cluster_sizes(m).collect()} == {"p1": (2, 2), "p2": (1, 1)}


def test_neighbourhoods_end_with_the_chromosome_and_follow_the_strand(spark):
    c = spark.createDataFrame([(f"g{i}", "a", "1A", i * 10, i * 10 + 5, "-" if i == 1 else "+") for i in (1, 2, 3)], "gene_id string, accession string, chr string, begin_pos int, end_pos int, strand string")
    at = coords.chrom_index(c)
    slots = lambda g, five, three: [r.gene_id for r in coords.neighbourhoods(at, at.filter(F.col("gene_id") == g).select("gene_id", "accession"), five, three).orderBy("slot").collect()]
    assert slots("g3", 1, 1) == ["g2", "g3", None]
    assert slots("g1", 1, 0) == ["g1", "g2"]


def test_best_hit_and_cutoff(spark):
    h = spark.createDataFrame([("g", "s", "r1", None, 99.0), ("g", "s", "r2", 1e-8, 90.0), ("g", "s", "r3", 1e-8, 95.0), ("g", "t", "r4", 2e-5, None)], "gene_id string, species string, ref_id string, evalue double, pident double")
    assert {r.species: r.ref_id for r in keyword.best_hits(h).collect()} == {"s": "r3", "t": "r4"}
    assert keyword.usable_hits(h).count() == 3


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.components(df, Workspace(spark, "t")).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_numbered_with_singletons(spark):
    work = Workspace(spark, "t")
    found = graph.components(spark.createDataFrame([("n1", "n2"), ("n2", "n3"), ("n8", "n9")], "a string, b string"), work)
    every = graph.with_singletons(found, spark.createDataFrame([("n7",), ("n1",)], "node string"))
    got = {r.node: r.cluster for r in graph.numbered(every, "C", work).collect()}
    assert got == {"n1": "C_000001", "n2": "C_000001", "n3": "C_000001", "n7": "C_000002", "n8": "C_000003", "n9": "C_000003"}


def test_columns(spark):
    rows = spark.createDataFrame([("p", "g1", "A-"), ("p", "g2", "C"), ("p", "g3", "A"), ("p", "g4", "-")], "grp string, gene_id string, seq string")
    got = {r.col: (r.consensus, r.conservation) for r in alignment.columns(alignment.long_form(rows)).collect()}
    assert got == {1: ("A", 0.666667), 2: ("-", 0.0)}


def test_codon_table(spark):
    t = {r.codon: (r.aa, round(r.syn, 6)) for r in alignment.codon_table(spark).collect()}
    assert len(t) == 64 and t["ATG"] == ("M", 0.0) and t["TAA"][0] is None and t["GGG"] == ("G", 1.0)


def test_kmers_and_order(spark):
    assert column(spark, ["MKVLAA", "AB", None], similarity.kmer_classes) == [[368, 380], [], []]
    rows = spark.createDataFrame([("p", f"g{i}", "MKVLAADEF"[: 5 + i % 4]) for i in range(9)], "grp string, gene_id string, seq string")
    got = similarity.track_order(rows).collect()
    assert sorted(r.gene_id for r in got) == [f"g{i}" for i in range(9)] and sorted(r["rank"] for r in got) == list(range(9))


def test_track_order_against_brute_force(spark, monkeypatch):
    """Average linkage from the definition: means over all pairs of leaves, in exact fractions, the first of equal pairs in order of creation."""
    from fractions import Fraction

    rnd = random.Random(3)
    rows = [(f"p{g}", f"g{i:02d}", "".join(rnd.choice("MKV") for _ in range(rnd.randrange(0, 12)))) for g in range(12) for i in range(rnd.randrange(1, 12))]
    df = spark.createDataFrame(rows, "grp string, gene_id string, seq string")
    bags = {(r.grp, r.gene_id): set(r.k) for r in df.select("grp", "gene_id", similarity.kmer_classes(F.col("seq")).alias("k")).collect()}
    want = {}
    for grp in {r[0] for r in rows}:
        far = lambda a, b, grp=grp: 1 - Fraction(len(bags[grp, a] & bags[grp, b]), len(bags[grp, a] | bags[grp, b])) if bags[grp, a] | bags[grp, b] else Fraction(0)
        alive = [[g] for p, g in sorted(bags) if p == grp]
        while len(alive) > 1:
            mean = {(i, j): sum(far(a, b) for a in alive[i] for b in alive[j]) / (len(alive[i]) * len(alive[j])) for i in range(len(alive)) for j in range(i + 1, len(alive))}
            i, j = min(mean, key=lambda k: (mean[k], k))
            alive = [c for k, c in enumerate(alive) if k not in (i, j)] + [alive[i] + alive[j]]
        want |= {(grp, g): k for k, g in enumerate(alive[0])}
    order = similarity.track_order(df)
    assert {(r.grp, r.gene_id): r["rank"] for r in order.collect()} == want
    plan = order._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(similarity, "LARGEST_GROUP", 5)
    with pytest.raises(Exception, match="too many to order"):
        similarity.track_order(df).collect()


def test_trees(spark):
    t = spark.createDataFrame([("t", "((a:1,'b c':2)x:1,d:5);")], "tree string, newick string")
    assert [(r.leaf, r.depth) for r in similarity.leaf_order(t).orderBy("rank").collect()] == [("a", 2.0), ("b c", 3.0), ("d", 5.0)]
    depths = [x for n, x, _ in similarity.layout(similarity.midpoint("((a:1,b:2):1,d:5);")) if n]
    assert max(depths) == 4.0
    assert similarity.layout("(a:1,b:1);")[-1][2] == 0.5


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", min_size=0, max_size=6), min_size=1, max_size=6))
def test_average_linkage_is_a_permutation(words):
    import numpy as np

    d = np.array([[abs(len(a) - len(b)) + (a != b) for b in words] for a in words], float)
    assert sorted(similarity.average_linkage(d)) == list(range(len(words)))


def test_blocks(spark):
    b = coords.mirrored_blocks(spark.createDataFrame([("1", 20, 10, "2", 100, 300_000)], "chr1 string, s1 long, e1 long, chr2 string, s2 long, e2 long"))
    e = spark.createDataFrame([(1, "1", 15, "2", 250_000), (2, "2", 250_000, "1", 15), (3, "1", 25, "2", 150)], "k int, chr1 string, mid1 long, chr2 string, mid2 long")
    assert sorted(r.k for r in coords.in_blocks(e, b).collect()) == [1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "acc.bed6").write_text("#c\n\nchr1A\t5\t9\tx|g1\t.\t-\n1B\t1\tx\tg2\t.\t+\nshort\n")
    r = genomes.bed(spark, str(tmp_path / "acc.bed6")).collect()
    assert [(x.gene_id, x.accession, x.chr, x.subgenome) for x in r] == [("g1", "acc", "1A", "A")]
    (tmp_path / "a.fa").write_text(">t1 d > x|g1\nAC\nGT\n>t2\n\n")
    assert [(x.name, x.seq) for x in genomes.fasta(spark, str(tmp_path / "a.fa")).orderBy("src").collect()] == [("t1", "ACGT"), ("t2", "")]
    (tmp_path / "c.clust.tsv").write_text("p0\tg0\np1\tg1\tg2\n")
    assert genomes.cluster_members(spark, str(tmp_path / "c.clust.tsv")).count() == 2
    assert genomes.cluster_members(spark, str(tmp_path / "c.clust.tsv"), "wide").count() == 3
    (tmp_path / "d.clust.tsv").write_text("p0\tg0\tg1\np1\tg2\n")
    assert genomes.cluster_members(spark, str(tmp_path / "d.clust.tsv")).count() == 3


def test_reader_errors(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("symbol\tfull_name\n")
    with pytest.raises(ValueError, match="locus_name"):
        annotations.aliases(spark, str(tmp_path / "a.tsv"))
    (tmp_path / "m.tsv").write_text("run\torgan\ns1\troot\ns1\tleaf\n")
    with pytest.raises(ValueError, match="repeated"):
        annotations.samples(spark, str(tmp_path / "m.tsv"))
    (tmp_path / "x.tsv").write_text("gene\ts1\ts2\ng1\t1\tNA\ng2\t2\n")
    with pytest.raises(ValueError, match="lines without"):
        annotations.matrix(spark, str(tmp_path / "x.tsv"), ["s1"])
    with pytest.raises(ValueError, match="s9"):
        annotations.matrix(spark, str(tmp_path / "x.tsv"), ["s9"])
    (tmp_path / "d.tsv").write_text("gene\texperiment\ng1\t\n")
    with pytest.raises(ValueError, match="experiment"):
        annotations.records(spark, str(tmp_path / "d.tsv"))


def test_tables_are_not_overwritten_unasked(spark, tmp_path):
    df = spark.range(3)
    sinks.table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exists"):
        sinks.table(df, str(tmp_path / "t"))
    sinks.table(df, str(tmp_path / "t"), force=True)


def test_catalogue():
    c = annotations.catalogue('{"oat": {"variants": {"v1": {"db": "x"}, "v2": {"label": "L"}}}}')
    assert c["oat"]["default"] == "v1" and c["oat"]["variants"]["v2"]["label"] == "L" and c["oat"]["label"] == "Oat"


def test_snippets_as_the_search_shows_them(spark):
    words = "alpha " * 20
    long = words + "target here " + words
    show = lambda v, tokens: column(spark, [v], lambda c: text.snippet(c, tokens))[0]
    at = long.index("target")
    assert show(long, ["zz", "Target"]) == "..." + long[at - 46 : at + 140] + "..." * (at + 140 < len(long))
    short = "x" * 60 + " target and the rest of a text"
    assert show(short, ["target"]) == "..." + short[61 - 46 :]
    assert show(short, ["zz"]) == short and show("y" * 150, ["zz"]) == "y" * 140 + "..." and show(None, ["a"]) == "" and show("y" * 150, []) == "y" * 140 + "..."
    assert show("b target a", ["a", "target"]) == "b target a"


def test_labels(spark):
    assert column(spark, [None, 0.0, 0.005, 0.5, 15.0, 1e-300, 2e-310, 1234.4, 12340.0, 0.01, 100.0, 0.012345, 1000.0], text.evalue_label, "double") == ["—", "0", "5.00e-03", "0.5", "15", "1.00e-300", "2.0e-310", "1234", "1.234e+04", "0.01", "100", "0.01235", "1000"]
    assert column(spark, [None, 33.333, 100.0], text.identity_label, "double") == ["—", "33.3%", "100.0%"]
    assert column(spark, [None, 0.0, 0.004, 1e-12, 0.05, 1.0], text.fdr_label, "double") == ["", "0.00e+0", "4.00e-3", "1.00e-12", "0.050", "1.00"]
    assert column(spark, ["a", 'b"c', "d\te", None], text.quoted_cell) == ["a", '"b""c"', '"d\te"', ""]


def test_terms_lose_case_and_diacritics(spark):
    assert column(spark, ["Müller naïve éte x-1", "Łódź ß 日本", None], text.terms) == [["muller", "naive", "ete", "x", "1"], ["łodz", "ß", "日本"], []]


def test_tissue_stats_by_experiment_and_group(spark):
    rows = [("g", "leaf", "e", "t", 2, 4.0, "A"), ("g", "root", "e", "t", 1, None, "B"), ("g", "stem", "e", "t", 3, 8.0, "C"), ("g", "seed", "e", "u", 4, None, "C"), ("g", "seed", "f", "t", 5, 1.0, "C")]
    got = {(r.experiment, r.grp): (r.organ, r.genome, r.n, r["mean"], r.first_sample) for r in expression.tissue_stats(spark.createDataFrame(rows, "gene string, organ string, experiment string, grp string, sample_idx int, value double, genome string")).collect()}
    assert got == {("e", "t"): ("leaf", "A", 2, 6.0, 2), ("f", "t"): ("seed", "C", 1, 1.0, 5)}


def test_members_without_coordinates_count_as_unknown(spark):
    genes = spark.createDataFrame([("g1", "p", "x"), ("g2", "p", "x"), ("g3", "p", "y"), ("g4", "q", "x")], "gene_id string, pangene string, accession string")
    places = coords.placed(spark.createDataFrame([("g1", "x", "1B", 1, 2, "+"), ("g3", "z", "1A", 1, 2, "+")], "gene_id string, accession string, chr string, begin_pos int, end_pos int, strand string"), [F.col("begin_pos")])
    held = members.with_places(genes, places)
    assert {r.pangene: (r.n_a, r.n_b, r.n_d, r.n_other, r.dominant) for r in members.subgenome_counts(held).collect()} == {"p": (0, 1, 0, 2, "B"), "q": (0, 0, 0, 1, "?")}
    got = {(r.pangene, r.bucket): (r.genes, r.missing, r.total, r.shown, r.truncated) for r in members.partitioned(held, 2).collect()}
    assert got == {("p", "B"): ("g1", "g2", 3, 2, True), ("p", "?"): ("g2", "g2", 3, 2, True), ("q", "?"): ("g4", "g4", 1, 1, False)}


def test_most_similar_member_of_each_accession(spark):
    rows = spark.createDataFrame([("p", "r", "a", "MKVLAADEF"), ("p", "s", "b", "MKVLAADEF"), ("p", "t", "b", "MKVLAADEG"), ("p", "u", "c", "QQQQQQ")], "grp string, gene_id string, accession string, seq string")
    got = {r.accession: (r.gene_id, r.distance) for r in similarity.most_similar(rows, spark.createDataFrame([("p", "r")], "grp string, ref string")).collect()}
    assert got["b"] == ("s", 0.0) and got["c"] == ("u", 1.0)


def test_ranks_over_all(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k")).repartition(5)
    got = ranked(df, ["k"], Workspace(spark, "t"), "r").collect()
    assert all(r["rank"] == r.k + 1 for r in got) and len(got) == 500


def test_retrieval_needs_every_token(spark):
    refs = spark.createDataFrame([("a", "Red widget", "small"), ("b", "red thing", "Widgets here"), ("c", "red", None)], "ref_id string, x string, y string")
    posts = keyword.postings(refs, "ref_id", F.col("x"), F.col("y"))
    assert [r.ref_id for r in keyword.retrieved(posts, "ref_id", ["widg", "RED"], 9).collect()] == ["a", "b"]
    assert keyword.candidate_cap(25) == 100 and keyword.candidate_cap(3) == 50


@pytest.mark.parametrize(("name", "fixed"), [("k04_variant_matrix", 0), ("m06_m07_variant_columns", 0), ("t09_variants_by_diversity", 0), ("m01_consensus", 0), ("m10_cell_classes", 0), ("m04_substitutions", 2), ("m05_pairwise_rates", 2), ("w05_m08_sliding_ratio", 2)])
def test_cells_of_alignments_are_not_broadcast(spark, tmp_path, name, fixed):
    """Nor anything else of them, but the table of codons on both sides; and there are more tasks than files."""
    spark.range(1000).selectExpr("id p_partkey", "concat('red ', id % 7, ' ring') p_name").repartition(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == fixed
    assert "SinglePartition" not in plan


def test_rows_are_spread_by_their_number(spark):
    few, many = spark.range(10).coalesce(1), spark.range(95).coalesce(1)
    assert spread(few, "id", rows=10).rdd.getNumPartitions() == 1
    assert spread(many, "id", rows=10).rdd.getNumPartitions() == 10
    assert spread(many, "id", of=few, rows=5).rdd.getNumPartitions() == 2


def test_long_sequences_are_made_and_tested_after_rows_are_spread(spark, tmp_path):
    """The test does not slip below the exchange, where one task would make all texts."""
    spark.range(40_001).selectExpr("id p_partkey", "'red' p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = registry.queries()["p25_sane_alignments"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "repeat" in plan and "repeat" not in below and ", 3)" in below.splitlines()[0]


@pytest.mark.parametrize("name", ["x02_reference_postings", "h02_h03_distances"])
def test_rows_are_spread_before_much_is_made_of_each(spark, tmp_path, name):
    spark.range(40_001).selectExpr("id p_partkey", "'red ring' p_name", "'b' p_brand", "'t' p_type", "1 p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_chunks_are_files_of_one_folder(spark, tmp_path):
    """No folder for a chunk, no file over its size, every record once and without stars."""
    df = spark.range(0, 25, 1, 2).selectExpr("concat('g', id) n", "'MK*' s")
    sinks.chunked_fasta(df, str(tmp_path / "c"), "n", "s", 5)
    files = [f for f in (tmp_path / "c").iterdir() if f.name.startswith("part-")]
    assert all(f.is_file() for f in files) and [f for f in (tmp_path / "c").iterdir() if f.is_dir()] == []
    heads = [[x for x in f.read_text().splitlines() if x.startswith(">")] for f in files]
    assert max(map(len, heads)) == 5 and sorted(sum(heads, [])) == sorted(f">g{i}" for i in range(25))
    assert not any("*" in f.read_text() for f in files)


def test_buckets_grow_with_rows(spark, monkeypatch):
    df = spark.range(40).selectExpr("concat('g', id) gene_id", "id v")

    def plan() -> str:
        table = stored.bucketed(views.Inputs(spark, ""), ("gene_id",), 40, a=df, b=df.selectExpr("gene_id", "v + 1 w"))
        both = table("a").join(table("b").hint("merge"), "gene_id")
        assert both.count() == 40
        return both._jdf.queryExecution().toString()

    monkeypatch.setattr(stored, "BUCKET_ROWS", 4)
    assert "10 out of 10" in plan()
    monkeypatch.setattr(stored, "BUCKET_ROWS", 1_000)
    assert f"{stored.BUCKETS} out of {stored.BUCKETS}" in plan()
