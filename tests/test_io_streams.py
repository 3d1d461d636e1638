import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from veldt.sources import readers, writers
from veldt.streaming import bus


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_delimited_and_counts(spark, tmp_path):
    p = put(tmp_path, "a.tsv", "# note\n\tctrl\tctrl\ttreat\n001\t1\t2\t3\n002\t4\t5\t6\n003\t7\t8\t9\n004\t0\t0\t1\n")
    df = readers.delimited(spark, p)
    assert df.columns == ["column_0", "ctrl", "ctrl_2", "treat"] and [r[0] for r in df.orderBy("column_0").collect()] == ["001", "002", "003", "004"]
    fc = put(tmp_path, "fc.txt", "Geneid\tChr\tStart\tEnd\tStrand\tLength\ts1\ts2\ng1\tc\t1\t2\t+\t9\t1\t2\ng2\tc\t1\t2\t+\t9\t3\t4\ng3\tc\t1\t2\t+\t9\t0\t4\n")
    assert readers.count_matrix(spark, [fc]).agg(F.sum("value")).first()[0] == 14
    one, two = put(tmp_path, "x.counts", "id,n\nA,5\nB,1\n__none,7\n"), put(tmp_path, "y.counts", "id,n\nB,2\n")
    assert {tuple(r) for r in readers.count_matrix(spark, [one, two]).collect()} == {("A", "x", 5.0), ("B", "x", 1.0), ("A", "y", 0.0), ("B", "y", 2.0)}
    with pytest.raises(ValueError):
        readers.count_matrix(spark, [put(tmp_path, "n.csv", "g,s1,s2\na,1.5,2\nb,1,2\nc,1,1\n")])
    warnings = []
    assert readers.table(spark, str(tmp_path / "none.csv"), warnings).count() == 0 and len(warnings) == 1


def test_cpm_sets_and_models(spark, tmp_path):
    wide, long = put(tmp_path, "w.csv", "gene,001,002\nA,1,2\nB,3,\n"), put(tmp_path, "l.csv", "gene,sample_id,cpm\nA,001,1\n")
    got = {(r["gene"], r["sample"]): r["cpm"] for r in readers.cpm_matrix(spark, wide, {"B": "A"}).collect()}
    assert got == {("A", "001"): 4.0, ("A", "002"): 2.0} and readers.cpm_matrix(spark, long).first()["sample"] == "001"
    g = put(tmp_path, "s.gmt", "t1\td\ta\tB\t\nt2\td\n")
    assert {tuple(r) for r in readers.gmt(spark, g).collect()} == {("t1", "A"), ("t1", "B")}
    rows = ['c\tx\tgene\t11\t100\t.\t+\t.\tgene_id "G1.3"; gene_name "A"; gene_type "protein_coding";'] + [f'c\tx\texon\t{s}\t{e}\t.\t+\t.\tgene_id "G1.3"; transcript_id "T";' for s, e in ((11, 20), (15, 30), (91, 100))]
    rows += ['c\tx\ttranscript\t11\t100\t.\t+\t.\tgene_id "G1.3"; gene_name "A"; transcript_id "T2"; gene_type "protein_coding";', 'c\tx\ttranscript\t41\t90\t.\t+\t.\tgene_id "G1.3"; gene_name "A"; transcript_id "T1"; gene_type "protein_coding"; tag "MANE_Select";']
    gtf = readers.gtf(spark, put(tmp_path, "m.gtf", "#c\n" + "\n".join(rows) + "\n"))
    m = readers.gene_models(gtf).first()
    assert (m["tss"], m["gene"], len(m["exons"])) == (10, "A", 3)
    assert readers.gene_symbols(gtf).first()["length"] == 30 and readers.gene_symbols(gtf).first()["gene_id"] == "G1"
    assert readers.canonical_tss(gtf).first()["tss"] == 40


def test_intervals_sequences_matrices(spark, tmp_path):
    p = put(tmp_path, "p.narrowPeak", "c\t1\t5\tn\t0\t.\t7.5\t1\t1\t2\nc\t9\t3\tn\t0\t.\t1\t1\t1\t2\nc\t1\t5\tn\t0\t.\tinf\t1\t1\t2\n")
    assert [tuple(r) for r in readers.peaks(spark, p).collect()] == [("c", 1, 5, 7.5)]
    assert readers.peaks(spark, put(tmp_path, "b.bed", "track x\nc\t1\t5\t2\n")).first()["score"] == 2.0
    f = put(tmp_path, "f.tsv", "#h\nc\t5\t9\tX\t2\nc\t1\t2\tY\t1\n")
    assert readers.fragments(spark, f, 1).first()["barcode"] == "Y"
    fa = readers.fasta(spark, put(tmp_path, "a.fa", ">s1 x\nACG\nT\n>s2\nGG\n"))
    assert {tuple(r) for r in fa.collect()} == {("s1", "ACGT"), ("s2", "GG")}
    d = tmp_path / "mex"
    d.mkdir()
    for n, t in (("matrix.mtx", "%%x\n%\n2 2 2\n1 1 5\n2 2 7\n"), ("barcodes.tsv", "AA\nBB\n"), ("features.tsv", "f1\tA\nf2\tB\n")):
        (d / n).write_text(t)
    assert {tuple(r) for r in readers.mex(spark, str(d)).collect()} == {("AA", "f1", 5.0), ("BB", "f2", 7.0)}
    meme = put(tmp_path, "m.meme", "MEME\nMOTIF M1 CTCF\nletter\n 0.1 0.2 0.3 0.4\n 1 0 0 0\n")
    assert readers.motifs_meme(spark, meme) == {"CTCF": [[0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]]}
    assert readers.detect_assay(["chrom", "start", "end", "barcode"]) == "fragments" and readers.detect_assay(["gene", "log2FC", "padj"]) == "differential"
    assert readers.json_document(spark, put(tmp_path, "j.json", '{"a":\n1}')) == {"a": 1}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("g1", "s1", 3), ("g1", "s2", 1), ("g2", "s1", 2)], "feature string, sample string, value int")
    writers.count_matrix(df, str(tmp_path / "m"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).collect()} == {("g1", "3", "1"), ("g2", "2", "0")}
    de = spark.createDataFrame([("a", 0.01, 1.0), ("b", 0.5, 1.0), ("c", None, 1.0)], "feature string, padj double, log2fc double")
    writers.differential(de, str(tmp_path / "de"), spark.createDataFrame([("a", "A")], "feature string, symbol string"))
    assert [r["symbol"] for r in spark.read.csv(str(tmp_path / "de"), sep="\t", header=True).collect()] == ["A"]
    writers.append_json(df, str(tmp_path / "j"))
    writers.append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    warnings = []
    assert writers.persist(lambda p: 1 / 0, "x", "p", warnings) is None and warnings == ["x: ZeroDivisionError: division by zero"]


@pytest.fixture
def log(tmp_path):
    folder = str(tmp_path / "bus")
    at = "2024-01-01T00:00:0{}Z"
    bus.publish(folder, {"id": "a", "type": "finding", "experiment_id": "e", "sender": "x", "timestamp": at.format(1)}, {"id": "q1", "type": "escalation", "checkpoint": True, "experiment_id": "e", "sender": "x", "timestamp": at.format(2)})
    bus.publish(folder, {"id": "a", "type": "finding", "experiment_id": "e", "sender": "y", "timestamp": at.format(3)}, {"id": "q2", "type": "escalation", "checkpoint": True, "experiment_id": None, "sender": "y", "timestamp": at.format(4)}, {"type": "progress", "payload": {"phase": 2}, "experiment_id": "e", "sender": "x", "timestamp": at.format(5)})
    with open(folder + "/0-bad.json", "w") as f:
        f.write("not json\n")
    return folder


def test_log_views(spark, log):
    m = bus.messages(spark, log)
    assert m.count() == 5 and bus.merged(m).count() == 4 and [r["id"] for r in bus.replay(spark, log, "e").collect()][:2] == ["a", "q1"]
    assert {r["id"] for r in bus.pending(m).collect()} == {"q1", "q2"} and bus.findings(m, "e").count() == 2
    assert bus.bind(m, "e", ["y"]).where("experiment_id = 'e'").count() == 5 and bus.retained(m, 2).count() == 2
    view, beats = bus.snapshot(m, "2024-01-01 00:02:04", 120)
    assert view.where("experiment_id = 'e'").first()["open_checkpoints"] == 1 and {r["sender"]: r["stale"] for r in beats.collect()} == {"x": False, "y": False}
    assert bus.drain(spark, log, lambda r: "yes" if r["id"] == "q1" else None) == 1
    assert bus.wait_for(spark, log, "q1", 5) == "yes" and bus.wait_for(spark, log, "q2", 0) is None
    assert {r["id"] for r in bus.pending(bus.messages(spark, log)).collect()} == {"q2"}


def test_streams(spark, log, tmp_path):
    got, failed = [], []
    receivers = {"x": lambda df: got.extend(r["id"] for r in df.collect()), "bad": lambda df: 1 / 0}
    q = bus.deduplicated(bus.message_stream(spark, log)).writeStream.foreachBatch(bus.fan_out(receivers, failed)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(x for x in got if x in ("a", "q1", "q2")) == ["a", "q1", "q2"] and failed[0][1] == "bad"
    out = str(tmp_path / "states")
    q = bus.checkpoint_states(bus.message_stream(spark, log)).writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="1 second").start()
    states = lambda: {tuple(r) for r in spark.read.schema("id string, state string, decision string").json(out).collect()}
    told = []

    def done():
        if not told and ("q1", "asked", None) in states():
            told.append(bus.publish(log, bus.resolution("q1", "go")))
        return ("q1", "resolved", "go") in states()

    assert bus.run_until(q, done, 90)
    assert ("q2", "asked", None) in states()


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "k", 1.0), ("2024-01-01 00:00:50", "k", 2.0), ("2024-01-01 00:05:00", "k", 4.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["n"], r["total"]) for r in bus.tumbling(df, "ts", "1 minute", ["k"], "v").orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]
    assert sorted(r["n"] for r in bus.sessions(df, "ts", "1 minute", ["k"]).collect()) == [1, 2]
    ok, late = bus.split_late(df.withColumn("seen", F.lit("2024-01-01 00:01:00").cast("timestamp")), "ts", "seen", "30 seconds")
    assert (ok.count(), late.count()) == (2, 1)


def test_soft_files(spark, tmp_path):
    text = """^SERIES = G1
!Series_title = old
!Series_title = A = B
!Series_supplementary_file = NONE
!Series_supplementary_file = ftp://x/a.gz
!Series_relation = SRA: https://x?term=SRP12 and prjna7
!Sample_title = before any sample
^SAMPLE = S1
!Sample_title = one
!Sample_organism_ch1 =
!Sample_characteristics_ch1 = Tissue: a
!Sample_characteristics_ch1 = tissue: b: c
!Sample_characteristics_ch1 = none
!Sample_relation = SRX5, SRP12
^SAMPLE = S1
!Sample_organism_ch1 = Mus musculus
!Sample_library_strategy = RNA-Seq
"""
    p = put(tmp_path, "f.soft", text)
    got = [(r["sample"], r["title"], r["organism"], r["library_strategy"], r["characteristics"]) for r in readers.soft_samples(spark, p).orderBy("block").collect()]
    assert got == [("S1", "one", "", "", {"tissue": "b: c"}), ("S1", "", "Mus musculus", "RNA-Seq", {})]
    r = readers.soft_series(spark, p).first()
    assert (r["title"], r["organism"], r["library_strategy"], r["files"], r["accessions"]) == ("A = B", "Mus musculus", "RNA-Seq", ["ftp://x/a.gz"], ["SRP12", "PRJNA7", "SRX5"])
    assert readers.soft_samples(spark, put(tmp_path, "e.soft", "")).count() == 0


def test_directory_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.csv", "a/y.csv", "a/b/z.csv", "a/n.txt"):
        put(tmp_path, name, "123456" if name == "a/y.csv" else "1")
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    found, report = readers.scan_directory(spark, str(tmp_path), r"\.csv$")
    assert sorted(f[-5:] for f in found) == ["x.csv", "y.csv", "z.csv"] and report["files_seen"] == 4 and report["skipped_links"] == 1 and report["ended_by"] is None
    assert readers.scan_directory(spark, str(tmp_path), r"\.csv$", max_depth=1)[1]["skipped_deep"] == 1
    assert readers.scan_directory(spark, str(tmp_path), r"\.csv$", max_bytes=2)[1]["skipped_large"] == 1
    for bound, n in (("max_files", 1), ("max_entries", 2), ("max_seconds", 0)):
        assert readers.scan_directory(spark, str(tmp_path), **{bound: n})[1]["ended_by"] == bound
    found, report = readers.scan_directory(spark, str(tmp_path / "none"))
    assert found == [] and len(report["errors"]) == 1


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "m.db")
    with sqlite3.connect(p) as db:
        db.execute("create table f (id text, n int)")
        db.executemany("insert into f values (?, ?)", [("a", 1), ("b", None), ("c", 3)])
    db.close()
    assert [tuple(r) for r in readers.sqlite(spark, p, "select id, n from f where id > ? order by id", "id string, n int", ("a",)).collect()] == [("b", None), ("c", 3)]
    with pytest.raises(ValueError):
        readers.sqlite(spark, p, "select * from f", "id string, n int", max_rows=2)
    with pytest.raises(sqlite3.OperationalError):
        readers.sqlite(spark, p, "insert into f values ('d', 4)", "id string")
