"""Folders of accession pairs to clusters, by each source of collinearity."""

import pytest

from kinloom import pairs
from kinloom.functions import snapshot


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def analysis(tmp_path):
    acc = tmp_path / "accessions"
    for name, rows in {"A": [("chr1A", 10, 20, "a1"), ("chr1A", 30, 40, "a2"), ("chr2B", 10, 20, "a3"), ("chr1A", 900, 950, "a4"), ("scaffold7", 1, 2, "a9")], "B": [("1B", 10, 20, "b1"), ("1A", 30, 40, "b2"), ("2B", 15, 25, "b3"), ("1A", 910, 960, "b4")], "C": [("1D", 10, 20, "c1"), ("1A", 30, 40, "c2"), ("2B", 10, 20, "c3")]}.items():
        write(acc / name / f"{name}.bed", "#x\n" + "".join(f"{c}\t{s}\t{e}\t{g}\n" for c, s, e, g in rows))
    work = tmp_path / "work" / "pairs"
    write(work / "A_x_B" / "x.RBH", "# c\na1\tb1\t9\na2\tb2\na3\tb2\na3\tb3\na4\tb4\na9\tb1\na1\ta1\n")
    write(work / "A_x_B" / "x.collinearity_info", "1\t2\t3\t4\t5\tb1,a1;a2 , b2;a3,b2\n")
    write(work / "A_x_B" / "x.block_pos", "1A\t1\t9999\t1A\t1\t9999\n")  # the info file goes before
    write(work / "A_x_C" / "x.RBH", "a1\tc1\na2\tc2\na3\tc3\n")
    write(work / "A_x_C" / "output" / "x.anchors", "###\nc2\ta2\t7\nzz\tyy\n")
    write(work / "B_x_C" / "x.RBH", "b1\tc1\nc2\tb2\nb3\tc3\n")
    write(work / "B_x_C" / "output" / "x.anchors", "zz\tyy\n")  # none of the edges: blocks count
    write(work / "B_x_C" / "x.block_pos", "chr1B\t25\t5\tchr1D\t0\t50\n1A\t31\t39\t1A\t31\t39\nbad\t1\t2\t1A\t1\t2\n2B 1 x 2B 1 2\n")
    return tmp_path


def test_clusters_of_pairs(spark, analysis):
    out = f"{analysis}/out"
    c = pairs.pan_clusters(spark, str(analysis), out, prefix="T_").first()
    assert (c.edges, c.missing, c.cross, c.exact, c.homeologue, c.not_collinear, c.kept) == (12, 1, 1, 7, 3, 5, 5)
    edges = {(r.pair, r.a, r.b): (r.kind, r.source, r.collinear) for r in snapshot.read(spark, out, "edges").collect()}
    assert edges["A_x_B", "a1", "b1"] == ("homeologue", "info", True) and edges["A_x_B", "a4", "b4"] == ("exact", "info", False) and edges["A_x_B", "a3", "b2"][0] == "cross"
    assert edges["A_x_C", "a2", "c2"] == ("exact", "anchors", True) and edges["A_x_C", "a1", "c1"] == ("homeologue", "anchors", False)
    assert edges["B_x_C", "b1", "c1"] == ("homeologue", "blocks", True) and edges["B_x_C", "c2", "b2"] == ("exact", "blocks", True) and not edges["B_x_C", "b3", "c3"][2]
    text = lambda name: sorted(r.value for r in spark.read.text(snapshot.tables(spark, out)[name]).collect())
    assert text("wide") == ["T_000001\ta1\tb1\tc1", "T_000002\ta2\tb2\tc2", "T_000003\ta3", "T_000004\ta4", "T_000005\ta9", "T_000006\tb3", "T_000007\tb4", "T_000008\tc3"]
    assert text("long")[:3] == ["T_000001\ta1", "T_000001\tb1", "T_000001\tc1"] and snapshot.read(spark, out, "members").count() == 12
    with pytest.raises(FileExistsError):
        pairs.pan_clusters(spark, str(analysis), out)


def test_all_edges(spark, analysis):
    out = f"{analysis}/plain"
    assert pairs.pan_clusters(spark, str(analysis), out, collinear=False, singletons=False).first().kept == 12
    got = {}
    for r in snapshot.read(spark, out, "members").collect():
        got.setdefault(r.cluster, set()).add(r.gene_id)
    assert sorted(map(sorted, got.values())) == [["a1", "a9", "b1", "c1"], ["a2", "a3", "b2", "b3", "c2", "c3"], ["a4", "b4"]]


def test_faults(spark, analysis, tmp_path):
    write(analysis / "work" / "pairs" / "B_x_D" / "x.RBH", "b1\tb2\n")
    with pytest.raises(ValueError, match="B_x_D"):
        pairs.pan_clusters(spark, str(analysis), f"{analysis}/bad")
    write(analysis / "accessions" / "C" / "C.bed", "1A\t1\t2\ta1\n")
    with pytest.raises(ValueError, match="a1"):
        pairs.loci(spark, f"{analysis}/accessions")
    with pytest.raises(ValueError, match="no .RBH"):
        pairs.pair_files(spark, f"{analysis}/accessions")
