"""Indexes built from small folders, and what the engine answers from them."""

import pytest
from pyspark.sql import functions as F

from kinloom import build
from kinloom.engine import Engine
from kinloom.functions import guards, snapshot
from kinloom.functions.scratch import listed
from kinloom.operators import graph
from kinloom.sources import annotations, genomes, layout

BED = "chr1A\t{}\t{}\t{}\t.\t{}\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("index")
    oat = base / "input" / "Oat"
    write(oat / "a.count.clust.tsv", "x\ty\tz\n")
    write(oat / "b.leftover.clust.tsv", "x\ty\tz\n")
    write(oat / "c.clust.tsv", "p1\tg1.1\tg2\tlost\np2\tg3\tg2\n")
    write(oat / "bed" / "acc1.bed", BED.format(10, 20, "x|g1.1", "+") + BED.format(30, 40, "g3", "-") + BED.format(50, 60, "g4", "+"))
    write(oat / "bed" / "acc2.bed6", BED.format(5, 9, "g2", "+"))
    write(oat / "prot" / "p.fa", ">g1.1 x\nMKV\n>t9 g2\nMK*\n>g3\nmkv\n")
    write(oat / "cds" / "c.fa", ">g1.1\nATGAAAGTT\n>g2\nATGAAG\n>g3\nATGAAAGTC\n")
    (base / "input" / "rye").mkdir()
    search = base / "search"
    write(search / "desc.tsv", "name\tgene_model_type\tshort_description\tCurator_summary\tComputational_description\nAT1G01010.1\tp\tshort\tNULL\tlong text of a transcription factor.\nAT1G01010.2\tp\tx\t\t\n")
    write(search / "alias.tsv", "locus_name\tsymbol\tfull_name\nAT1G01010\tNAC1\tNo apical meristém\nAT1G01010\tNAC1\tother\nAT2G00001\tONLY\t\n")
    write(search / "rice.tsv", "Transcript_ID\tLocus_ID\tDescription\tCGSNL Gene Symbol\tGene Name\nOs01t0100200-01\tOs01g0100200\tkinase\tKIN, NA\tKinase one\n")
    write(search / "mmseqs_oat" / "acc1.tsv", "gene_id\tarabidopsis\trice\tarabidopsis_evalue\trice_evalue\tarabidopsis_pident\trice_pident\ng1.1\tAT1G01010.1\tOs01t0100200-01\t1e-30\t0.5\t80\t50\ng3\tAT1G01010\t.\t1e-9\t\t70\t\ng4\tAT1G01010\tNA\t1e-9\t\t70\t\n")
    write(search / "mmseqs_oat" / "acc2.tsv", "gene_id\tarabidopsis\trice\ng2\tAT1G01010\tnone\n")
    ex = base / "expression_input" / "set1"
    write(ex / "meta.tsv", "Sample\texperiment_acc\torgan\tgroup\tgenome\ns1\te\tleaf\tt\tacc1\ns2\te\troot\tt\tacc1\ns3\tf\tseed\tu\tacc2\n")
    write(ex / "cpm.tsv", "gene\ts3\ts1\ts2\ng1.1\t1.26\t2\t4\ng2\tNA\t\tNA\n")
    write(ex / "deg.tsv", "gene\texperiment\tcategory\tcomparison\tlogFC\tFDR\ng1.1\te\tc\ta vs b\t2.5\t0.01\n")
    write(base / "expression_input" / "half" / "meta.tsv", "sample\n")
    out = f"{base}/out"
    stats = build.genome_indexes(spark, f"{base}/input", f"{out}/genomes")
    assert [tuple(r) for r in stats.collect()] == [("oat", 2, 2, 3)]
    meta = build.keyword_index(spark, {k: f"{search}/{f}.tsv" for k, f in (("descriptions", "desc"), ("aliases", "alias"), ("rice", "rice"))}, str(search), {"oat": snapshot.read(spark, f"{out}/genomes/oat", "genes")}, f"{out}/keywords")
    got = {r.k: r.v for r in meta.collect()}
    assert got["refs_count"] == "3" and got["hits_files"] == "2" and got["hits_total"] == "4" and got["hits_unmatched"] == "1" and len(got["rice_sha1"]) == 40
    sets = build.expression_index(spark, f"{base}/expression_input", f"{out}/expression")
    assert [tuple(r) for r in sets.collect()] == [("set1", "acc1", "set1", 3)]
    return base


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(spark, f"{root}/out")


def test_an_index_is_not_overwritten_unasked(spark, root):
    with pytest.raises(Exception, match="exists"):
        build.genome_indexes(spark, f"{root}/input", f"{root}/out/genomes")
    assert build.genome_indexes(spark, f"{root}/input", f"{root}/out/genomes", force=True, only=["OAT"]).count() == 1
    with pytest.raises(ValueError, match="barley"):
        build.genome_indexes(spark, f"{root}/input", f"{root}/out/genomes", only=["barley"])


def test_clusters(engine):
    assert [(r.gene_id, r.pangene, r.accession) for r in engine.search("G1", "oat").collect()] == [("g1.1", "Avena_p1", "acc1")]
    assert engine.search("", "oat").count() == 0 and [r.gene_id for r in engine.suggest("g1.", "oat").collect()] == ["g1.1"] and engine.suggest("g1", "oat").count() == 0
    assert [(r.gene_id, r.begin_pos) for r in engine.pangene("Avena_p1", "oat").collect()] == [("g1.1", 10), ("g2", 5)]
    assert engine.stats("oat").first().genes == "3" and not engine.is_large("Avena_p1", "oat")
    assert {r.bucket: r.genes for r in engine.subgenomes("Avena_p1", "oat").collect()} == {"A": "g1.1|g2"}
    assert [(r.pangene, r.dominant) for r in engine.picker(["Avena_p1", "Avena_p2"], "Avena_p2", "oat").collect()] == [("Avena_p2", "A"), ("Avena_p1", "A")]
    slots = engine.neighborhood([("g3", "acc1")], 1, 2, "oat").collect()
    assert [r.gene_id for r in slots] == [None, "g1.1", "g3", "g4"] and [r.pangene for r in slots] == [None, "Avena_p1", "Avena_p2", None]
    with pytest.raises(ValueError):
        engine.neighborhood([("g", "a")] * 151, 1, 1, "oat")
    with pytest.raises(KeyError):
        engine.search("x", "rye")


def test_sequences_and_rates(engine, tmp_path):
    assert {r.id: r.seq for r in engine.sequences(["g1", "g2", "none"], "oat").collect()} == {"g1.1": "MKV", "g2": "MK"}
    rates = {r.gene_id: (r.error, r.sd, r.nd) for r in engine.kaks({"g1.1": "MKV", "g2": "MK-", "g3": "MKV", "zz": "MKV"}, "g1.1", "oat").collect()}
    assert rates["g3"] == (None, 1, 0) and rates["g2"][1:] == (1, 0) and rates["zz"][0] == "no_cds"
    with pytest.raises(ValueError):
        engine.kaks({"a": "M"}, "b", "oat")
    engine.download("Avena_p1", "oat", "prot", f"{tmp_path}/p.fa")
    assert engine.spark.read.text(f"{tmp_path}/p.fa").count() == 4
    engine.download("Avena_p1", "oat", "gene_list", f"{tmp_path}/p.tsv")
    assert sorted(r.value for r in engine.spark.read.text(f"{tmp_path}/p.tsv").collect()) == ["g1.1\tacc1\t1A\t10\t20", "g2\tacc2\t1A\t5\t9"]
    assert [r["rank"] for r in engine.track_order({"a": "MKVLAAD", "b": "MKVLAAE", "c": "QQQQQQQ"}).collect()] == [0, 1, 2]
    assert [r.consensus for r in engine.alignment_statistics({"a": "MK", "b": "MQ"}).collect()] == ["M", "K"] and engine.variants({"a": "MK", "b": "MQ"}).count() == 1


def test_sequences_of_clusters(engine):
    rows, without = engine.cluster_sequences(["Avena_p2", " p1 ", "Avena_p1", "Avena_none"], "oat")
    assert [(r.pangene, r.id, r.seq) for r in rows.collect()] == [("Avena_p1", "g1.1", "MKV"), ("Avena_p1", "g2", "MK"), ("Avena_p2", "g3", "MKV")] and without == ["Avena_none", "p1"]
    assert {r.id: r.seq for r in engine.cluster_sequences(["Avena_p1"], "oat", "cds")[0].collect()} == {"g1.1": "ATGAAAGTT", "g2": "ATGAAG"}
    for bad in ([], ["Avena_none"], ["Avena_p2"]):
        with pytest.raises(ValueError):
            engine.cluster_sequences(bad, "oat")


def test_small_tables_beside_the_indexes(engine, root):
    assert engine.links(["g2"], "oat").count() == engine.accession_table("oat").count() == 0
    write(root / "out" / "links.csv", "genome,database,type,accession,url\nOat,DB,gene,,https://x.org/{gene_id}\n,Map,place,ACC1,https://y.org/{chr}:{start}-{end}?g={gene_id}\nrye,Z,gene,,https://z.org\noat,Blank,gene,,\n")
    assert [tuple(r) for r in engine.links(["g2", "g1.1", "none"], "oat").collect()] == [
        ("g1.1", "DB", "gene", "", "https://x.org/g1.1"), ("g1.1", "Map", "place", "ACC1", "https://y.org/1A:10-20?g=g1.1"), ("g2", "DB", "gene", "", "https://x.org/g2"),
    ]
    write(root / "out" / "genomes.csv", "accession,source,link\nacc1,here , https://h\n,no,\nacc2,,\n")
    assert [tuple(r) for r in engine.accession_table("oat").orderBy("accession").collect()] == [("", "acc1", "here", "", "https://h"), ("", "acc2", "", "", "")]


def test_keywords(engine):
    assert [(r.ref_id, r.kind, r.names) for r in engine.references("nac1", "oat").collect()] == [("AT1G01010", "alias", "NAC1|No apical meristém|other")]
    text = engine.references("meristem trans", "oat").first()
    assert text.kind == "text" and text.whole == "short. long text of a transcription factor." and text.snippet == text.whole
    assert engine.references("only", "oat").count() == 0
    assert [(r.ref_id, r.selected) for r in engine.references("nac1", "oat", ["os01g0100200"]).collect()] == [("AT1G01010", False), ("Os01g0100200", True)]
    groups = engine.keyword_groups(["at1g01010"], "oat", "oat").collect()
    assert [(r.pangene, r.matched_genes, r.min_evalue_label, r.max_pident_label, r.by_genome, r.density_pct) for r in groups] == [("Avena_p1", 2, "1.00e-30", "80.0%", "acc1:1|acc2:1", 100.0), ("Avena_p2", 1, "1.00e-09", "70.0%", "acc1:1", 50.0)]
    assert engine.keyword_groups(["Os01g0100200"], "oat").count() == 0 and engine.keyword_groups([], "oat").count() == 0
    best = {r.gene_id: (r.arabidopsis_ref, r.rice_description) for r in engine.best_annotations(["g1.1", "g9"], "oat").collect()}
    assert best == {"g1.1": ("AT1G01010", "kinase"), "g9": (None, None)}


def test_expression(engine):
    status, stats = engine.expression_of("g1.1", "acc1")
    assert status == "ok" and [(r.organ, r.experiment, r.grp, r.n, r["mean"]) for r in stats.collect()] == [("leaf", "e", "t", 2, 3.0), ("seed", "f", "u", 1, 1.3)]
    assert engine.expression_of("g2")[0] == "no_data" and engine.expression_of("none")[0] == "not_found"
    assert [(r.experiment, r.title, r.experiment_index) for r in engine.differential("g1.1", "set1").collect()] == [("e", "e", 0)]
    r = engine.response(" g1.1 ", "acc1")
    assert (r["status"], r["data_set"], r["genome"], r["categories"], r["without"]) == ("ok", "set1", "acc1", ["c"], []) and r["tissue"].count() == 2 and r["differential"].count() == 1
    r = engine.response("g2")
    assert (r["status"], r["categories"], r["without"]) == ("no_data", ["c"], ["c"]) and r["differential"].count() == 0
    assert engine.response("none")["status"] == engine.response(" ")["status"] == "not_found"


def test_layouts(spark, tmp_path):
    assert layout.cluster_file(["z.clust.tsv", "b.Leftover.clust.tsv", "a.counts.clust.tsv"]) == "z.clust.tsv" and layout.cluster_file(["b.hsh.tsv", "a_HSH.tsv"]) == "a_HSH.tsv" and layout.cluster_file([]) is None
    for n in ("mmseqs", "mmseqs_b", "mmseqs_a", "other"):
        (tmp_path / n).mkdir()
    assert [p.rsplit("/", 1)[1] for p in layout.hit_folders(spark, str(tmp_path))] == ["mmseqs_a", "mmseqs_b"]
    assert listed(spark, f"{tmp_path}/none") == []
    write(tmp_path / "old.tsv", "accessions\tpan_genes\tgenes\n3\t4\t5\n")
    assert [tuple(r) for r in annotations.statistics(spark, f"{tmp_path}/old.tsv").collect()] == [("wheat", 3, 4, 5)]
    write(tmp_path / "new.tsv", "Species\taccessions\tpan_genes\tgenes\textra\nOat\t3\t4\t5\t\nrye\tx\t1\t2\t7\n")
    assert [tuple(r) for r in annotations.statistics(spark, f"{tmp_path}/new.tsv").collect()] == [("oat", 3, 4, 5, 0)]
    assert annotations.catalogue_of_folder(["oat", "barley"]) == {"barley": {"label": "Barley", "variants": {"barley": {"label": "Barley"}}, "default": "barley"}, "oat": {"label": "Oat", "variants": {"oat": {"label": "Oat"}}, "default": "oat"}}


def test_representatives_and_matches(spark, tmp_path):
    write(tmp_path / "packed.tsv", "1A__a__1__5\t1A__a__1__5\n1A__a__1__5\t1B__b__2__6\n1A__a__1__5\t2B__c__2__6\n")
    write(tmp_path / "plain.tsv", "a\tb\n1__x__2__3\t1__y__2__3\n")
    assert genomes.is_packed(spark, f"{tmp_path}/packed.tsv") and not genomes.is_packed(spark, f"{tmp_path}/plain.tsv")
    members = genomes.representatives(spark, f"{tmp_path}/packed.tsv")
    assert members.count() == 3
    pairs = graph.member_pairs(members.withColumn("chr", F.split("member", "__")[0]), graph.symmetric(spark.createDataFrame([("1A", "1B")], "chr_a string, chr_b string"), "chr_a", "chr_b"))
    assert [tuple(r) for r in genomes.match_rows(pairs).collect()] == [("1A", "a", 1, 5, "1B", "b", 2, 6)]
    write(tmp_path / "g.bed", "#c\n1A\t1\t2\tg1\n1A\t1\t2\t\n")
    assert [r.gene_id for r in genomes.gene_universe(spark, f"{tmp_path}/g.bed").collect()] == ["g1"]
    write(tmp_path / "bad.bed", "1A\t1\t2\n")
    with pytest.raises(ValueError, match="fewer than 4"):
        genomes.gene_universe(spark, f"{tmp_path}/bad.bed")


def test_guards():
    assert guards.listed_ids([" a ", "", "b"]) == ["a", "b"] and len(guards.listed_ids(["x"] * 3000)) == 2000
    assert guards.aligned(["a", "b", "a"]) == ["a", "b"] and guards.is_large(501) and not guards.is_large(500)
    for bad in (lambda: guards.aligned(["a"]), lambda: guards.ordered({"a": "M"}), lambda: guards.ordered({"a": "M" * 15_001, "b": "M"}), lambda: guards.rated({"a": "M" * 30_001}, "a")):
        with pytest.raises(ValueError):
            bad()
