"""Components that grow, chains, flow clusters, and SQLite files."""

import random
import sqlite3
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.engine import Engine
from kinloom.functions.scratch import Workspace, listed
from kinloom.operators import chains, graph
from kinloom.sources import sqlite


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")


def labels(df):
    return {r.node: r.component for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_that_grow(spark, work, seed):
    """Three parts of the edges one after the other give what all of them give, whatever the split."""
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(150):03d}", f"n{rnd.randrange(150):03d}") for _ in range(110)] + [("a", "a"), ("n001", "zz")]
    rnd.shuffle(edges)
    df = lambda e: spark.createDataFrame(e, "a string, b string")
    found = work.write(graph.components(df(edges[:50]), work, "first"), "labels-0")
    for k, part in enumerate((edges[50:80], edges[80:], [])):
        found = work.write(graph.grown(found, df(part), work, f"grown-{k}"), f"labels-{k + 1}")
    assert labels(found) == labels(graph.components(df(edges), work, "whole"))


def test_growth_does_not_walk_the_old_graph(spark, work):
    """A chain of a thousand nodes and one new edge: the labels meet in one contracted pair."""
    path = spark.range(1_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    old = work.write(graph.components(path, work, "path").unionByName(spark.createDataFrame([(5_000, 5_000)], "node long, component long")), "old")
    grown = graph.grown(old, spark.createDataFrame([(700, 5_000)], "a long, b long"), work)
    assert spark.read.parquet(work.path("grown-ends")).select("p", "q").collect() == [(0, 5_000)]
    assert set(labels(grown).values()) == {0} and grown.count() == 1_002


def chains_by_hand(rows, reach, gap, least):
    out = {}
    by = defaultdict(list)
    for pair, i, x, y, w in rows:
        by[pair].append((x, y, i, w))
    for pair, a in by.items():
        a.sort()
        best = {}
        for x, y, i, w in a:
            options = [(best[j][0] - gap * (max(x - p, y - q) - 1), -j) for p, q, j, _ in a if 0 < x - p <= reach and 0 < y - q <= reach]
            top = max(options, default=None)
            best[i] = (w + top[0], best[-top[1]][1], best[-top[1]][2] + 1) if top and top[0] > least else (w, i, 1)
        out |= {(pair, i): b for i, b in best.items()}
    return out


@pytest.mark.parametrize(("side", "reach", "gap"), [(4_096, 10, 1.0), (8, 5, 0.5), (20, 12, 0.0)])
def test_chains(spark, work, side, reach, gap):
    rnd = random.Random(side)
    rows = []
    for pair in ("1A-1B", "1A-2B", "3D-3D"):
        for i in range(160):
            x = rnd.randrange(-20, 90)
            rows.append((pair, i, x, x + rnd.randrange(-3, 4) if rnd.random() < 0.7 else rnd.randrange(90), float(rnd.choice([1, 2, 2, 5, -1]))))
    anchors = spark.createDataFrame([*rows, ("none", None, 1, 1, 1.0), (None, 1, 1, 1, 1.0)], "pair string, id long, x long, y long, w double")
    got = {(r.pair, r.id): (r.score, r.chain, r.ord) for r in chains.chained(anchors, work, reach, gap, 0.0, side).collect()}
    want = chains_by_hand(rows, reach, gap, 0.0)
    assert got == want and max(w[2] for w in want.values()) > 8
    ends = chains.chain_ends(chains.chained(anchors, Workspace(spark, "ends"), reach, gap, 0.0, side), 6.0, 3).collect()
    best = {}
    for (pair, i), (s, c, n) in want.items():
        best[pair, c] = max(best.get((pair, c), (-1e9,)), (s, -i, n))
    assert {(r.pair, r.chain, r.end, r.score, r.n) for r in ends} == {(p, c, -b[1], b[0], b[2]) for (p, c), b in best.items() if b[0] >= 6 and b[2] >= 3}


def test_chains_take_only_blocks_whose_past_moved(spark, tmp_path):
    """Pairs inside a block take one round; of the others only the blocks after a rank that moved are solved again, and of equals the smaller id still counts."""
    apart = [("short", i, i, i, 2.0) for i in range(1, 30)]
    once = Workspace(spark, "once")
    df = lambda rows: spark.createDataFrame(rows, "pair string, id long, x long, y long, w double")
    got = {(r.pair, r.id): (r.score, r.chain, r.ord) for r in chains.chained(df(apart), once, side=40).collect()}
    assert got == chains_by_hand(apart, 10, 1.0, 0.0)
    assert sorted(n for n, _, _ in listed(spark, once.root)) == ["chains-1"]
    rnd = random.Random(3)
    rows = [*apart, *[("long", i, i, i, 2.0) for i in range(1, 170)], *[("long", 1_000 + i, rnd.randrange(170), rnd.randrange(170), 2.0) for i in range(150)]]
    rows += [("tied", i, x, y, 1.0) for i, (x, y) in enumerate([(1, 2), (2, 1), (1, 1), (3, 3), (4, 4), (4, 4)], 7)]
    work = Workspace(spark, "some")
    got = {(r.pair, r.id): (r.score, r.chain, r.ord) for r in chains.chained(df(rows), work, side=40).collect()}
    assert got == chains_by_hand(rows, 10, 1.0, 0.0)
    due = spark.read.parquet(work.path("chains-due-1")).collect()
    assert {r.pair for r in due} == {"long"} and 0 not in {r.block for r in due}


def test_blocks_together_within_bounds(monkeypatch):
    """Anchors of many blocks in one call, compared a few at a time: the same as one block at a time."""
    rnd, cols = random.Random(5), ("pair", "id", "x", "y", "w", "score", "chain", "ord", "block", "mine")
    rows = [(p, i, x := rnd.randrange(b * 20, b * 20 + 20), x + rnd.randrange(-2, 3), 2.0, 2.0, i, 1, b, True) for p in "ab" for b in (-1, 0, 3) for i in range(b * 100, b * 100 + 60)]
    table = lambda rows: pa.table(dict(zip(cols, map(list, zip(*rows, strict=True)), strict=True)))
    want = [r for p in "ab" for b in (-1, 0, 3) for r in chains.best_in_blocks(table([r for r in rows if r[0] == p and r[8] == b]), 20, 5, 1.0, 0.0).to_pylist()]
    monkeypatch.setattr(chains, "PAIRS", 7)
    rnd.shuffle(rows)
    got = chains.best_in_blocks(table(rows), 20, 5, 1.0, 0.0).to_pylist()
    key = lambda r: (r["pair"], r["id"])
    assert sorted(got, key=key) == sorted(want, key=key) and any(r["ord"] > 3 for r in got)


def flow_by_hand(edges, inflation, keep, least, digits=6):
    m = defaultdict(float)
    for a, b, w in edges:
        if a != b and w > 0:
            m[b, a] += w
            m[a, b] += w
    nodes = sorted({k[0] for k in m})
    for n in nodes:
        m[n, n] = max(v for (r, c), v in m.items() if c == n and r != c)

    def columns(m, power, least):
        out = {}
        for n in nodes:
            col = [(r, v**power) for (r, c), v in m.items() if c == n]
            total = sum(v for _, v in col)
            col = sorted([(-v / total, r) for r, v in col if v / total >= least])[:keep]
            s = -sum(v for v, _ in col)
            out |= {(r, n): round(-v / s, digits) for v, r in col if round(-v / s, digits) > 0}
        return out

    m = columns(m, 1.0, 0.0)
    for _ in range(60):
        square = defaultdict(float)
        for (r, k), v in m.items():
            for (k2, c), u in m.items():
                if k == k2:
                    square[r, c] += v * u
        new = columns(square, inflation, least)
        if new == m:
            break
        m = new
    of = {n: n for n in nodes}
    for _ in nodes:
        for r, c in m:
            of[r] = of[c] = min(of[r], of[c])
    return of


def test_flow_clusters(spark, work):
    """Three dense groups with thin bridges, and a star."""
    rnd = random.Random(4)
    edges = [(f"g{g}n{i}", f"g{g}n{j}", 1.0 + rnd.random()) for g in range(3) for i in range(7) for j in range(i) if rnd.random() < 0.8]
    edges += [("g0n0", "g1n0", 0.1), ("g1n3", "g2n2", 0.05), ("s", "s", 9.0), ("x", "y", 0.0)] + [("hub", f"leaf{i}", 1.0) for i in range(12)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    got = {r.node: r.cluster for r in chains.flow_clusters(df, work).collect()}
    assert got == flow_by_hand(edges, 2.0, 32, 1e-4) and len(set(got.values())) == 4 and "s" not in got
    pruned = {r.node: r.cluster for r in chains.flow_clusters(df, Workspace(spark, "few"), keep=3).collect()}
    assert set(pruned) == set(got)
    assert chains.flow_clusters(df.limit(0), Workspace(spark, "none")).count() == 0


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "an index.db")
    con = sqlite3.connect(path)
    con.executescript(
        "CREATE TABLE genes (gene_id TEXT PRIMARY KEY, pangene TEXT NOT NULL, accession TEXT NOT NULL); CREATE TABLE pangene_info (pangene TEXT PRIMARY KEY, clade TEXT, gene_count INTEGER);"
        "CREATE TABLE gene_coords (gene_id TEXT, accession TEXT, chr TEXT, start INTEGER, end INTEGER, strand TEXT, subgenome TEXT, chrom_index INTEGER, PRIMARY KEY (gene_id, accession));"
        "CREATE TABLE protein_seq_uniq (uniq_id INTEGER PRIMARY KEY, seq_comp BLOB); CREATE TABLE protein_seq_map (gene_id TEXT PRIMARY KEY, uniq_id INTEGER);"
        "CREATE TABLE cpm (dataset_id TEXT, gene_id TEXT, cpm_blob BLOB); CREATE TABLE deg (gene_id TEXT, logFC REAL, n INTEGER);"
    )
    for i in range(500):
        con.execute("INSERT INTO genes VALUES (?, ?, ?)", (f"Gene{i:04d}", f"p{i % 50}", f"acc{i % 3}"))
        con.execute("INSERT INTO gene_coords VALUES (?, ?, '1A', ?, ?, '+', 'A', ?)", (f"Gene{i:04d}", f"acc{i % 3}", i * 10, i * 10 + 5, i // 3))
        con.execute("INSERT INTO protein_seq_map VALUES (?, ?)", (f"Gene{i:04d}", i % 7 + 1))
    con.executemany("INSERT INTO pangene_info VALUES (?, '', 10)", [(f"p{i}",) for i in range(50)])
    con.executemany("INSERT INTO protein_seq_uniq VALUES (?, ?)", [(i, zlib.compress(("MKV" + "L" * i).encode())) for i in range(1, 8)])
    con.execute("INSERT INTO cpm VALUES ('d', 'g1', ?), ('d', 'g2', ?)", (zlib.compress(struct.pack("<3H", 0, 65535, 259)), zlib.compress(b"")))
    con.executemany("INSERT INTO deg VALUES (?, ?, ?)", [("a", 1.5, 1), ("b", None, None), ("é'", -2, 3)])
    con.commit()
    con.close()
    return path


def test_sqlite_tables(spark, database):
    genes = sqlite.read(spark, database, "genes", 6)
    assert genes.rdd.getNumPartitions() == 6 and genes.count() == genes.distinct().count() == 500
    assert genes.dtypes == [("gene_id", "string"), ("pangene", "string"), ("accession", "string")]
    assert [r.pangene for r in genes.filter("gene_id = 'Gene0007'").collect()] == ["p7"] and genes.filter("gene_id >= 'Gene0490'").count() == 10
    assert genes.filter(F.col("pangene").isin("p1", "p2")).count() == 20 and genes.filter(F.length("gene_id") == 8).count() == 500
    deg = sqlite.read(spark, [database, database], "deg")
    assert sorted(map(tuple, deg.distinct().collect())) == [("a", 1.5, 1), ("b", None, None), ("é'", -2.0, 3)] and deg.count() == 6
    assert deg.filter("n > 1").count() == 2 and deg.filter("n IS NULL").count() == 2 and deg.filter("logFC < 0 AND gene_id = \"é'\"").count() == 2
    with pytest.raises(Exception, match="no table"):
        sqlite.read(spark, database, "nothing").count()


def test_filters_reach_sqlite(database):
    reader = sqlite.SqliteReader([database], "genes", 2, [], sqlite.schema_of(sqlite.opened(database), "genes", []))
    left = list(reader.pushFilters([sqlite.EqualTo(("gene_id",), "Gene0003"), sqlite.GreaterThan(("pangene",), 3), sqlite.In(("accession",), ("acc0", "acc1"))]))
    assert [type(f) for f in left] == [sqlite.GreaterThan] and reader.where == ['"gene_id" = ?', '"accession" IN (?, ?)']
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("Gene0003", "p3", "acc0")]


def test_an_index_in_sqlite_is_imported(spark, database, tmp_path):
    out = f"{tmp_path}/out"
    sqlite.import_genomes(spark, database, f"{out}/genomes/oat", partitions=3)
    engine = Engine(spark, out)
    assert [r.gene_id for r in engine.search("gene0003", "oat").collect()] == ["Gene0003"] and engine.search("E004", "oat").count() == 10
    assert {r.id: r.seq for r in engine.sequences(["Gene0000", "Gene0007"], "oat").collect()} == {"Gene0000": "MKVL", "Gene0007": "MKVL"}
    assert engine.pangene("p5", "oat").filter("begin_pos IS NOT NULL").count() == 10 and engine.genes_with_sequences("oat").count() == 500
    assert {r.gene: r.codes for r in sqlite.expression_arrays(spark, database).collect()} == {"g1": [0, 65_535, 259], "g2": []}
    with pytest.raises(FileExistsError):
        sqlite.import_genomes(spark, database, f"{out}/genomes/oat")


@pytest.mark.parametrize("seed", [1, 2])
def test_flow_clusters_inside_tasks_and_by_rounds(spark, seed):
    """Components of all sizes: the same clusters whether tasks take them whole, all take the rounds, or some do; small ones write no rounds."""
    rnd = random.Random(seed)
    edges = [(f"c{c:02d}n{rnd.randrange(4 + c)}", f"c{c:02d}n{rnd.randrange(4 + c)}", rnd.choice([1.0, 2.5, 0.3])) for c in range(12) for _ in range(2 * c + 3)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    run = lambda name, **k: (w := Workspace(spark, name), sorted(map(tuple, chains.flow_clusters(df, w, **k).collect())))
    inside, got = run("inside")
    assert got == run("rounds", whole=0)[1] == run("some", whole=30)[1]
    assert len(got) == len({n for a, b, _ in edges if a != b for n in (a, b)})
    assert not spark.sparkContext._jvm.java.io.File(inside.path("flow-0")).exists()
