"""Folders of sequence clusters and of predictions, and small tables beside the indexes."""

import glob
import hashlib
import os
import random
from itertools import combinations

import pytest

from kinloom import homology, predictions
from kinloom.functions import snapshot


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


INCLUDE = "# pairs\nexpected_chr_matches=(\n  1A 1A\n 1A 1D x\n2b 2B\nodd\n)\n"


@pytest.fixture
def analysis(tmp_path):
    write(tmp_path / "config" / "a_expected_chr_matches_old.inc", "3A 3A\n")
    write(tmp_path / "config" / "z_expected_chr_matches.inc", INCLUDE)
    m = tmp_path / "work" / "03_mmseqs"
    rep, b, c, d = "chr1A__a__1__5__+", "CHR1d__b__2__6__-", "chr10__c__2__6", "chr2B__d__3__9__+"
    write(m / "X.x.Y_cluster.tsv", f"{rep}\t{rep}\n{rep}\t{b}\n\n{rep}\t{c}\nshort\n{rep}\t{d}\n{d}\tchr2B__e__4__8__+\n{rep}\t{b}\n")
    write(m / "X.x.Z_cluster.tsv", f"{rep}\tchr1A__f__7__9__+\n")
    write(m / "plain_cluster.tsv", f"g1\tg2\n{rep}\t{b}\n")
    return tmp_path


def test_matches_of_folders(spark, analysis):
    assert {tuple(r) for r in homology.allowed_chromosomes(spark, str(analysis)).collect()} == {("1a", "1a"), ("1a", "1d"), ("1d", "1a"), ("2b", "2b")}
    got = {tuple(r) for r in homology.matches(spark, str(analysis)).collect()}
    ab = ("X.x.Y", "CHR1d", "b", "2", "6", "chr1A", "a", "1", "5")
    assert got == {ab, ("X.x.Y", "chr2B", "d", "3", "9", "chr2B", "e", "4", "8"), ("X.x.Z", "chr1A", "a", "1", "5", "chr1A", "f", "7", "9")}
    # an old row of the same two genes is replaced, another stays, and so does the last of those that repeat
    write(analysis / "work" / "04_dag" / "X.x.Y_matches.tsv", "chr1A\ta\t1\t5\tCHR1d\tb\t2\t6\n9\tq\t1\t2\t9\tr\t1\t2\tmore\n9\tr\t1\t2\t9\tq\t1\t2\nshort\t1\n")
    assert {tuple(r) for r in homology.matches(spark, str(analysis), merge=True).collect()} == got | {("X.x.Y", "9", "r", "1", "2", "9", "q", "1", "2")}


def test_faults_of_folders(spark, analysis, tmp_path):
    write(analysis / "work" / "03_mmseqs" / "W_cluster.tsv", "1A__a__1\t1A__b__2\n")
    with pytest.raises(Exception, match="not packed with its place"):
        homology.matches(spark, str(analysis)).collect()
    with pytest.raises(FileNotFoundError):
        homology.matches(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        homology.allowed_chromosomes(spark, f"{tmp_path}/none")


def test_pairs_of_chains(spark, analysis):
    dag = analysis / "work" / "04_dag"
    with pytest.raises(ValueError, match="no chains"):
        homology.filtered_pairs(spark, str(analysis))
    write(dag / "u.aligncoords", "## alignment\n\n")
    with pytest.raises(ValueError, match="no chains"):
        homology.filtered_pairs(spark, str(analysis))
    write(dag / "v.aligncoords", "## alignment 1\n1A a 1 2 1A b 3 4 9\n1A\tc\t1\t2\t1A\td\n1A a 1 2 1A b 3 4 7\n1A x 1 2 3\n")
    write(dag / "v_matches.tsv", "1A\te\t1\t2\t1A\tf\t3\t4\n1A\ta\t1\t2\t1A\tb\t3\t4\n")
    assert {tuple(r) for r in homology.filtered_pairs(spark, str(analysis), strict=True).collect()} == {("a", "b"), ("c", "d")}
    assert {tuple(r) for r in homology.filtered_pairs(spark, str(analysis)).collect()} == {("a", "b"), ("c", "d"), ("e", "f")}


def test_clusters_of_folders(spark, tmp_path):
    """Two genomes with a run forwards, a run backwards and scattered matches: only what is on a chain of four or more counts."""
    rnd, rows = random.Random(5), []
    name = lambda c, g, at: f"{c}__{g}__{at}__{at + 50}__+"
    for k in range(8):
        rows.append((name("chr1A", f"x{k}", 1000 * k), name("chr1D", f"y{k}", 1000 * k)))
        rows.append((name("chr2B", f"v{k}", 1000 * k), name("chr2B", f"w{k}", 90_000 - 1000 * k)))
    for k, at in enumerate(rnd.sample(range(50, 100), 3)):
        rows.append((name("chr1A", f"s{k}", 200_000 + 20_000 * at), name("chr1A", f"t{k}", 900_000 - 3_000 * at)))
    rnd.shuffle(rows)
    write(tmp_path / "config" / "a_expected_chr_matches.inc", INCLUDE)
    write(tmp_path / "work" / "03_mmseqs" / "X.x.Y_cluster.tsv", "".join(f"{a}\t{b}\n" for a, b in rows))
    c = {r.name: r.n for r in homology.gene_clusters(spark, str(tmp_path), f"{tmp_path}/out").collect()}
    assert c == {"matches": 19, "chained": 16, "pairs": 16, "genes": 32}
    got = {}
    for r in snapshot.read(spark, f"{tmp_path}/out", "members").collect():
        got.setdefault(r.cluster, set()).add(r.gene_id)
    assert sorted(map(sorted, got.values())) == sorted([f"v{k}", f"w{k}"] for k in range(8)) + sorted([f"x{k}", f"y{k}"] for k in range(8))
    with pytest.raises(FileExistsError):
        homology.gene_clusters(spark, str(tmp_path), f"{tmp_path}/out")
    c = {r.name: r.n for r in homology.gene_clusters(spark, str(tmp_path), f"{tmp_path}/out", strict=False, force=True).collect()}
    assert c["pairs"] == 19 and c["genes"] == 38


def test_matches_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    chrs = ["chr1A", "1a", "chr1D", "chr2B", "chr7H"]
    genes = [f"{rnd.choice(chrs)}__g{k}__{rnd.randrange(99)}__{100 + k}__{rnd.choice('+-')}" for k in range(60)]
    rows = {n: [(rnd.choice(genes[:9]), rnd.choice(genes)) for _ in range(80)] for n in ("P.x.Q", "Q.x.P")}
    write(tmp_path / "config" / "a_expected_chr_matches.inc", INCLUDE)
    want = set()
    for n, some in rows.items():
        write(tmp_path / "work" / "03_mmseqs" / f"{n}_cluster.tsv", "".join(f"{a}\t{b}\n" for a, b in some))
        allowed = {("1a", "1a"), ("1a", "1d"), ("1d", "1a"), ("2b", "2b")}
        for rep in {a for a, _ in some}:
            for a, b in combinations(sorted({rep} | {y for x, y in some if x == rep}), 2):
                if tuple(x.split("__")[0].lower().removeprefix("chr") for x in (a, b)) in allowed:
                    want.add((n, *a.split("__")[:4], *b.split("__")[:4]))
    assert {tuple(r) for r in homology.matches(spark, str(tmp_path)).collect()} == want


def test_predictions_of_folders(spark, tmp_path):
    src, out = tmp_path / "in", f"{tmp_path}/unique"
    write(src / "b.faa", ">g3 words\nMK v\n>g4\n\n>g5\nMKVL\n")
    write(src / "a.fasta", ">g1\nmkv\n>g2\nQQ\nQ\n")
    write(src / "z.txt", ">no\nAAA\n")
    rows = [tuple(r) for r in predictions.unique_sequences(spark, str(src), out).orderBy("orig_idx").collect()]
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert rows == [(k + 1, f, g, f"u{h(s)}", h(s)) for k, (f, g, s) in enumerate([("a.fasta", "g1", "MKV"), ("a.fasta", "g2", "QQQ"), ("b.faa", "g3", "MKV"), ("b.faa", "g5", "MKVL")])]
    where = snapshot.tables(spark, out)
    assert [r.value for f in sorted(glob.glob(f"{where['unique']}/part*")) for r in spark.read.text(f).collect()] == [x for s in ("MKV", "QQQ", "MKVL") for x in (f">u{h(s)}", s)]
    assert spark.read.csv(where["map"], sep="\t", header=True).columns == ["orig_idx", "source_file", "header_id", "uniq_id", "seq_hash"]
    write(tmp_path / "p" / "batch_1" / "x_predictions_merged.csv", f"id,q3,q8,more\n{'u' + h('MKV')} ,HHH,GGG,1\n")
    write(tmp_path / "p" / "batch_2" / "x_predictions_merged.csv", f"id,q3,q8,more\n{'u' + h('MKV')},EEE,EEE,1\n{'u' + h('QQQ')},CCC,SSS,2\n")
    write(tmp_path / "p" / "other.csv", "x\n1\n")
    got = predictions.predictions(spark, f"{tmp_path}/p")
    r = predictions.recombined(spark, snapshot.read(spark, out, "mapping"), got, f"{tmp_path}/back").first()
    assert tuple(r) == (4, 1)
    back = {(x.genome, x.id): (x.q3_decoded, x.q8_decoded) for x in snapshot.read(spark, f"{tmp_path}/back", "structures").collect()}
    assert back == {("a", "g1"): ("HHH", "GGG"), ("a", "g2"): ("CCC", "SSS"), ("b", "g3"): ("HHH", "GGG"), ("b", "g5"): (None, None)}
    assert sorted(os.listdir(snapshot.tables(spark, f"{tmp_path}/back")["q3"]))[-2:] == ["genome=a", "genome=b"]
    with pytest.raises(ValueError, match="q8"):
        write(tmp_path / "bad" / "x_predictions_merged.csv", "id,q3\nu,H\n")
        predictions.predictions(spark, f"{tmp_path}/bad")
    with pytest.raises(FileNotFoundError):
        predictions.unique_sequences(spark, f"{tmp_path}/none", f"{tmp_path}/no")


def test_genes_are_not_dealt_by_chromosome_or_file_alone(spark, tmp_path, request):
    import re

    from kinloom import homology

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where Spark does not know that a side is small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    path = tmp_path / "x_cluster.tsv"
    path.write_text("".join(f"1A__g{i}__1__2__+\t1B__h{i}__1__2__+\n" for i in range(9)))
    allowed = spark.createDataFrame([("1a", "1b"), ("1b", "1a")], "chr_a string, chr_b string")
    found = homology.matched(homology.packed_members(spark, [str(path)]), allowed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(key#\d+, \d+\)", plan) and plan.count("BroadcastHashJoin") >= 2
    assert sorted((r.gene_id1, r.gene_id2) for r in found.collect()) == [(f"g{i}", f"h{i}") for i in range(9)]
