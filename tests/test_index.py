"""What an index is made of: snapshots, keys, trigrams, buckets, prefix lists, arrays; and the rules of a build."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom import build
from kinloom.engine import Engine
from kinloom.functions import ids, snapshot
from kinloom.functions.snapshot import Snapshot
from kinloom.operators import alignment, coords, expression, keyword, lookup, prefixes
from kinloom.sources import annotations

#: Small pages and row groups, so that a small table has many.
SMALL = {"parquet.page.row.count.limit": "50", "parquet.block.row.count.limit": "200"}


def rows_scanned(df):
    """Rows that the scans of a plan gave, after what statistics and Bloom filters left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            total += p.metrics().apply("numOutputRows").value()
        if "QueryStage" in p.getClass().getSimpleName():
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def genes(spark):
    rnd = random.Random(2)
    names = [f"TraesCS{rnd.randrange(1, 8)}{rnd.choice('ABD')}02G{rnd.randrange(10**6):06d}.{rnd.randrange(1, 3)}" for _ in range(4_000)]
    return spark.createDataFrame([(g, f"p{k % 900}", f"acc{k % 9}") for k, g in enumerate(dict.fromkeys(names))], "gene_id string, pangene string, accession string")


def test_a_failed_build_leaves_the_index(spark, tmp_path):
    root = f"{tmp_path}/index"
    one = spark.range(5).withColumnRenamed("id", "x")
    with Snapshot(spark, root) as snap:
        snap.write(one, "a")
        snap.write(one, "b")
    before = snapshot.tables(spark, root)
    with pytest.raises(ZeroDivisionError), Snapshot(spark, root, force=True) as snap:
        snap.write(one.limit(1), "a")
        1 / 0  # noqa: B018
    assert snapshot.tables(spark, root) == before and snapshot.read(spark, root, "a").count() == 5
    with pytest.raises(FileExistsError):
        Snapshot(spark, root)
    with Snapshot(spark, root, force=True, keep=True) as snap:
        snap.write(one.limit(2), "a")
        assert snapshot.read(spark, root, "a").count() == 5  # readers see the old one until it is published
    assert snapshot.read(spark, root, "a").count() == 2 and snapshot.read(spark, root, "b").count() == 5
    first, second = (Snapshot(spark, root, force=True) for _ in range(2))
    first.write(one.limit(3), "a")
    second.write(one.limit(4), "a")
    first.publish()
    with pytest.raises(FileExistsError):
        second.publish()
    assert snapshot.read(spark, root, "a").count() == 3 and snapshot.expire(spark, root) == 3 and snapshot.read(spark, root, "a").count() == 3
    with pytest.raises(KeyError):
        snapshot.read(spark, root, "b")


def test_parts_of_ids_by_trigrams(spark, tmp_path, genes):
    root = f"{tmp_path}/ids"
    with Snapshot(spark, root) as snap:
        table = snap.write(lookup.keyed(genes), "genes", order=("pangene", "gene_id"), bloom=("gene_id", "gene_key"), options=SMALL)
        posts = snap.write(lookup.postings(genes), "trigrams", order=("term", "gene_id"), dealt=True, options=SMALL)
        terms = snap.write(lookup.frequencies(posts), "counts", order=("term",))
    every = sorted(r.gene_id for r in genes.collect())
    rnd = random.Random(3)
    parts = [every[5][3:], every[9].lower(), "CS1A02G0", "g00", "02g", "zzz", "Traes", "es", "1", "%", ".2"] + [(lambda g, a: g[a : a + rnd.randrange(3, 9)])(rnd.choice(every), rnd.randrange(12)) for _ in range(8)]
    for part in parts:
        q = part.lower()
        exact = [g for g in every if g.lower() == q]
        want = (exact or [g for g in every if q in g.lower()])[:200]
        assert [r.gene_id for r in lookup.search(table, posts, terms, part).collect()] == want, part
        assert [r.gene_id for r in lookup.suggestions(table, posts, terms, part).collect()] == ([g for g in every if q in g.lower()][:15] if len(q) >= 3 else []), part
    found = lookup.containing(posts, terms, every[7][8:14])
    assert rows_scanned(found) < posts.count() / 20 and "In(term" in plan_of(found)
    assert lookup.containing(posts, terms, "qqqq").count() == 0
    with pytest.raises(ValueError):
        lookup.containing(posts, terms, "ab")


def test_keys_reach_few_rows(spark, tmp_path, genes):
    """The table is in order of clusters, so that the statistics of ids do not help: Bloom filters do."""
    with Snapshot(spark, f"{tmp_path}/a") as snap:
        snap.write(lookup.keyed(genes).coalesce(1), "genes", order=("pangene",), bloom=("gene_id", "gene_key"), options=SMALL)
    with Snapshot(spark, f"{tmp_path}/b") as snap:
        snap.write(lookup.keyed(genes).coalesce(1), "genes", order=("pangene",), options=SMALL)
    with_, without = (snapshot.read(spark, f"{tmp_path}/{x}", "genes") for x in "ab")
    some = [r.gene_id for r in genes.limit(12).collect()]
    ask = spark.createDataFrame([(g,) for g in some] + [("nothing",)], "asked string")
    rows = lookup.rows_of(with_, ask, ids.id_variants(F.col("asked")), "gene_id")
    assert {r.gene_id for r in rows.collect()} >= set(some)
    assert rows_scanned(with_.filter(F.col("gene_key") == some[0].lower())) <= 400 < rows_scanned(without.filter(F.col("gene_key") == some[0].lower()))
    assert rows_scanned(with_.filter(lookup.among("gene_id", some[:3]))) <= 800 and with_.filter(lookup.among("gene_id", [])).count() == 0


def test_buckets_join_without_a_shuffle(spark, tmp_path, genes):
    root = f"{tmp_path}/buckets"
    places = genes.select("gene_id", "accession", F.lit("1A").alias("chr"))
    with Snapshot(spark, root) as snap:
        snap.write_bucketed(genes, "genes", ("gene_id", "accession"), 6)
        snap.write_bucketed(places, "places", ("gene_id", "accession"), 6)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = snapshot.bucketed(spark, root, "genes").join(snapshot.bucketed(spark, root, "places"), ["gene_id", "accession"], "left")
        assert "Exchange" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
        assert both.count() == genes.count() == both.filter("chr = '1A'").count()
        assert "Exchange" in plan_of(snapshot.read(spark, root, "genes").join(snapshot.read(spark, root, "places"), ["gene_id", "accession"], "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    with pytest.raises(KeyError):
        snapshot.bucketed(spark, root, "none")


def test_prefix_lists_find_the_same_and_read_less(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = ["kinase", "kinesin", "kin", "transport", "transferase", "transcription", "zinc", "Zn", "protéin", "a", "x1", "abcdefghijklmnopqrstu"]
    texts = [(i, " ".join(rnd.choices(vocabulary, weights=[1, 1, 2, 9, 9, 9, 3, 3, 20, 20, 1, 1], k=rnd.randrange(0, 60)))) for i in range(3_000)]
    texts += [(9_000 + i, "kinase zinc " * 3) for i in range(4)]
    root = f"{tmp_path}/lists"
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    with Snapshot(spark, root) as snap:
        posts = snap.write(keyword.postings(docs, "doc_id", F.col("text")), "postings")
        prefixes.write(snap, posts, "doc_id", snap.write(keyword.corpus_numbers(posts, "doc_id"), "numbers"))
    for tokens, limit in ((["kin"], 5), (["KINA", "zi"], 4), (["trans"], 60), (["trans", "prot", "zn"], 20), (["nothing"], 5), (["kin", "nothing"], 5), (["a"], 3), (["abcdefghijklmnopqr"], 3), (["x1"], 100_000), (["prot", "prot"], 1)):
        read = []
        got = [(r.doc_id, r.score) for r in prefixes.best(spark, root, "doc_id", tokens, limit, read).collect()]
        want = [(r.doc_id, r.score) for r in keyword.retrieved(posts, "doc_id", tokens, limit).collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-5 for g, w in zip(got, want, strict=True)), tokens
        if tokens == ["KINA", "zi"]:
            assert sum(read) < snapshot.read(spark, root, "prefixes").filter("token = 'zi'").count() * 0.7


def test_values_as_arrays(spark):
    rows = spark.createDataFrame([("g", "s0", 0.25), ("g", "s1", None), ("g", "s2", 1e9), ("h", "s2", 3.0)], "gene string, sample_acc string, value double")
    samples = spark.createDataFrame([("s0", 1, "leaf"), ("s1", 0, "root"), ("s2", 2, "seed")], "sample_acc string, sample_idx int, organ string")
    full = rows.select("gene").distinct().crossJoin(samples.select("sample_acc")).join(rows, ["gene", "sample_acc"], "left")
    stored = expression.stored_arrays(expression.arrays(full, samples))
    assert {r.gene: r.codes for r in stored.collect()} == {"g": [65_535, 2, 65_534], "h": [65_535, 65_535, 30]}
    back = {(r.gene, r.organ): r.value for r in expression.read_arrays(stored, samples).collect()}
    assert back == {("g", "root"): None, ("g", "leaf"): 0.2, ("g", "seed"): 6553.4, ("h", "root"): None, ("h", "leaf"): None, ("h", "seed"): 3.0}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_rules_of_a_build(spark, tmp_path):
    """A gene of two files of coordinates has the accession of the last, and counts once; ids of clusters have their species' prefix."""
    wheat, oat = tmp_path / "input" / "Wheat", tmp_path / "input" / "oat"
    bed = "chr1A\t{}\t{}\t{}\t.\t+\n"
    write(wheat / "c.clust.tsv", "p1\tg1\tg2\nTRAES_p2\tg3\n")
    write(wheat / "bed" / "acc1.bed", bed.format(1, 5, "g1") + bed.format(7, 9, "g3"))
    write(wheat / "bed" / "acc2.bed", bed.format(11, 15, "g1") + bed.format(20, 21, "g2"))
    write(oat / "m.hsh.tsv", "pan_0001\tx1\n")
    write(oat / "bed" / "a.bed", bed.format(1, 5, "x1"))
    out = f"{tmp_path}/out"
    assert sorted(tuple(r) for r in build.genome_indexes(spark, f"{tmp_path}/input", f"{out}/genomes").collect()) == [("oat", 1, 1, 1), ("wheat", 2, 2, 3)]
    engine = Engine(spark, out)
    assert sorted(tuple(r) for r in engine.table("wheat", "genes").collect()) == [("g1", "Traes_p1", "acc2", "g1"), ("g2", "Traes_p1", "acc2", "g2"), ("g3", "TRAES_p2", "acc1", "g3")]
    assert {r.pangene: (r.gene_count, r.distinct_gene_count) for r in engine.table("wheat", "clusters").collect()} == {"Traes_p1": (2, 2), "TRAES_p2": (1, 1)}
    assert engine.table("wheat", "gene_coords").count() == 4 and engine.genes_with_places("wheat").filter("gene_id = 'g1'").first().begin_pos == 11
    assert engine.cluster("pan_0001", "oat") == engine.cluster("pan0001", "oat") == engine.table("oat", "genes").first().pangene == "Avena_pan0001"
    assert engine.pangene("pan_0001", "oat").count() == 1 and engine.cluster("N0.HOG1", "oat") == "N0.HOG1" and engine.cluster("pan7", "wheat") == "Traes_pan7"


def test_the_last_hit_of_a_file_stays_last(spark, tmp_path):
    """Whatever join the rows go through."""
    write(tmp_path / "acc1.tsv", "gene_id\tarabidopsis\trice\tarabidopsis_evalue\n" + "".join(f"g{i % 7}\tAT1G01010\t.\t1e-{i + 1}\n" for i in range(70)))
    hits = annotations.best_hits(spark, f"{tmp_path}/acc1.tsv")
    owners = spark.createDataFrame([("acc1", "d")], "accession string, dataset_id string")
    for hint in ("merge", "broadcast", "shuffle_hash"):
        last = build.pick(hits.join(owners.hint(hint), "accession").repartition(5, "evalue"), ["dataset_id", "gene_id", "species", "ref_id"], [F.col("src")], last=True)
        assert {r.gene_id: r.evalue for r in last.collect()} == {f"g{i % 7}": pytest.approx(float(f"1e-{i + 1}")) for i in range(63, 70)}


def test_ties_go_to_the_first_sequence_given(spark):
    rows = spark.createDataFrame([("a", "b", "AC", 0), ("a", "a", "CC", 1), ("a", "c", "-", 2)], "grp string, gene_id string, seq string, ord int")
    assert [(r.consensus, r.conservation) for r in alignment.columns(alignment.long_form(rows)).orderBy("col").collect()] == [("A", 0.5), ("C", 1.0)]
    assert [r.consensus for r in alignment.columns(alignment.long_form(rows.drop("ord"))).orderBy("col").collect()] == ["C", "C"]


def test_edges_in_blocks_by_brute_force(spark):
    rnd = random.Random(6)
    blocks = []
    for _ in range(250):
        a, b = rnd.randrange(-500, 5_000), rnd.randrange(5_000)
        blocks.append((rnd.choice("xy"), a, a + rnd.choice([0, 1, 5, 63, 64, 900, 40_000]), rnd.choice("xy"), b, b + rnd.choice([0, 3, 100, 2_000])))
    edges = [(k, rnd.choice("xyz"), rnd.randrange(-600, 7_000), rnd.choice("xy"), rnd.randrange(7_000)) for k in range(800)] + [(900, "x", None, "y", 3)]
    edges += edges[:20]
    e = spark.createDataFrame(edges, "k int, chr1 string, mid1 long, chr2 string, mid2 long")
    b = spark.createDataFrame(blocks, "chr1 string, s1 long, e1 long, chr2 string, s2 long, e2 long")
    want = sorted(k for k, c1, m1, c2, m2 in edges if m1 is not None and any(c1 == x[0] and c2 == x[3] and x[1] <= m1 <= x[2] and x[4] <= m2 <= x[5] for x in blocks))
    assert sorted(r.k for r in coords.in_blocks(e, b).collect()) == want and 50 < len(want) < 800
    grid, levels = coords.block_grid(b)
    assert grid.count() <= 4 * len(set(blocks)) and len(levels) < 16 and coords.in_blocks(e, b.limit(0)).count() == 0


def test_postings_move_once_for_all_their_prefixes(spark):
    """Lists are made where a block's postings are: nothing is dealt after terms are cut into prefixes."""
    posts = spark.range(2000).selectExpr("concat('abcdefgh', id % 9) term", "id % 300 doc", "7L length", "1L tf").distinct()
    found = prefixes.lists(posts, "doc", spark.createDataFrame([(300, 7.0)], "n long, mean double"), 3)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    steps = found._jdf.queryExecution().executedPlan().toString()
    above = steps[: steps.index("Generate explode")]
    assert "Generate" in plan and "Exchange hashpartitioning" not in above
    got = {(r.token, r.block): r.n for r in found.collect()}
    assert sum(n for (t, _), n in got.items() if t == "ab") == 300


def test_lists_are_made_where_their_blocks_are_by_brute_force(spark, tmp_path):
    """A file has the lists of a few neighbouring blocks, in order of token: lists are made once, and neither dealt nor sorted after. A key with two lengths is two texts."""
    rnd = random.Random(12)
    words = ["kin", "kinase", "kinesin", "k", "ki", "abcdefghijklmnop", "abcdefghijklmnopq", "abcdefghijklmnoxyz", "é1", "𝒳𝒴z", "𝒳𝒴w", "12", "123"] + [f"{chr(97 + x % 26)}{x}" for x in range(150)]
    texts = [(f"d{x % 2_600}" if x % 97 else None, " ".join(rnd.choices(words, k=rnd.randrange(0, 25)))) for x in range(2_700)]
    posts = keyword.postings(spark.createDataFrame(texts, "doc string, text string"), "doc", F.col("text")).localCheckpoint()
    root = f"{tmp_path}/lists"
    with Snapshot(spark, root) as snap:
        prefixes.write(snap, posts, "doc", snap.write(keyword.corpus_numbers(posts, "doc"), "numbers"))
    numbers, table = snapshot.read(spark, root, "numbers").first(), snapshot.read(spark, root, "prefixes")
    want = {}
    for p in posts.collect():
        for n in range(2, min(16, len(p.term)) + 1):
            at = p.term[:n], p.doc, p.length
            want[at] = want.get(at, 0) + p.tf
    rows = table.collect()
    assert {(r.token, k, n): tf for r in rows for k, tf, n in zip(r.keys, r.tfs, r.lengths, strict=True)} == want and sum(r.n for r in rows) == len(want)
    assert all(r.n == len(r.keys) and r.top == pytest.approx(max(f / (f + 1.2 * (0.25 + 0.75 * n / numbers.mean)) for f, n in zip(r.tfs, r.lengths, strict=True)), abs=1e-12) for r in rows)
    assert len({(r.token, r.block) for r in rows}) == len(rows)
    files = [[(r.token, r.block) for r in spark.read.parquet(f).coalesce(1).collect()] for f in table.inputFiles()]
    assert len(files) == 3 and all(f == sorted(f) and len({b // prefixes.DEALT for _, b in f}) == 1 for f in files)


def test_lists_are_made_in_runs_of_whole_blocks(monkeypatch):
    """However small the runs, and the batches of tokens."""
    rnd = random.Random(13)
    rows = [(rnd.randrange(5), "".join(rnd.choices("ab", k=rnd.randrange(2, 20))), rnd.randrange(40), 9, rnd.randrange(1, 4)) for _ in range(600)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("block", "term", "key", "length", "tf"), r, strict=True)) for r in rows], pa.schema([("block", pa.int32()), ("term", pa.string()), ("key", pa.int64()), ("length", pa.int32()), ("tf", pa.int64())]))

    def found():
        runs = [[r for b in prefixes._listed(t, 9.0) for r in b.to_pylist()] for t in prefixes._runs(iter([batch.slice(0, 250), batch.slice(250), batch.slice(0, 0)]))]
        assert all([r["token"] for r in run] == sorted(r["token"] for r in run) for run in runs)
        lists = [(r["token"], x["block"], x["n"], tuple(x["keys"]), tuple(x["tfs"]), tuple(x["lengths"]), x["top"]) for run in runs for r in run for x in r["lists"]]
        return len(runs), sorted(lists)

    one, whole = found()
    monkeypatch.setattr(prefixes, "RUN", 100)
    monkeypatch.setattr(prefixes, "TOKENS", 3)
    some, parts = found()
    assert one == 1 and some > 2 and parts == whole
    assert sum(sum(x[4]) for x in whole) == sum(tf * (min(16, len(t)) - 1) for _, t, _, _, tf in rows)
    assert list(prefixes._runs(iter([]))) == []


def test_trigrams_are_listed_where_their_ids_are(spark, tmp_path, monkeypatch):
    """An id's trigrams are in one file, each once, in order of term: ids were dealt, not their lists."""
    from kinloom.functions import snapshot
    from kinloom.operators import lookup

    monkeypatch.setattr(lookup, "IDS", 40)
    ids_ = [f"LI{n}.{n % 7}" for n in range(90, 290)] + ["aaaaAAAA", "xY", "", "é1é1é1", "LI100.2", "LI100.2", None]
    with snapshot.Snapshot(spark, f"{tmp_path}/index") as snap:
        posts = snap.write(lookup.postings(spark.createDataFrame([(x,) for x in ids_], "gene_id string")), "trigrams", order=("term",))
    rows = posts.selectExpr("term", "gene_id", "input_file_name() AS file", "monotonically_increasing_id() AS at").collect()
    want = {(x.lower()[k : k + 3], x) for x in ids_ if x for k in range(len(x) - 2)}
    assert len(rows) == len(want) and {(r.term, r.gene_id) for r in rows} == want
    files = {}
    for r in rows:
        files.setdefault(r.gene_id, set()).add(r.file)
    assert all(len(f) == 1 for f in files.values()) and len({r.file for r in rows}) > 1
    for f in {r.file for r in rows}:
        terms = [r.term for r in sorted(rows, key=lambda r: r.at) if r.file == f]
        assert terms == sorted(terms)
