"""Text scalars, sequencing, contacts, vectors, joins, governance and state."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.functions import scalars as sc
from veldt.operators import contacts, counts, embedding, governance, joins, sequencing, sets, state
from veldt.plans.model import PlanViolation


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_names_and_texts(spark):
    got = values(spark, [("chr1:20-10",), ("chrUn_x_5_9",), ("2-1-3",), ("bad",), (None,)], "s string", sc.parse_interval(F.col("s")))
    assert [None if r[0] is None else tuple(r[0]) for r in got] == [("chr1", 10, 20), ("chrUn_x", 5, 9), ("2", 1, 3), None, None]
    assert values(spark, [("chrM",), ("CHR7",), (" X",)], "s string", sc.canonical_contig(F.col("s"))) == [("MT",), ("7",), ("X",)]
    assert values(spark, [("FOS::jun(var.2)",), ("CTCF",)], "s string", sc.subunits(F.col("s"))) == [(["FOS", "JUN"],), (["CTCF"],)]
    assert [r[0] and tuple(r[0]) for r in values(spark, [("a_vs_b_vs_c",), ("a",)], "s string", sc.contrast_arms(F.col("s")))] == [("a", "b_vs_c"), None]
    assert values(spark, [("1e3",), ("inf",), ("x",), (None,)], "s string", sc.finite(F.col("s"))) == [(1000.0,), (None,), (None,), (None,)]
    assert values(spark, [("ACGT", "ACGA"), ("ACGT", "CAGT"), ("A", "AC")], "a string, b string", sc.within_one_mismatch(F.col("a"), F.col("b"))) == [(True,), (False,), (False,)]
    assert values(spark, [("AACGT",)], "s string", sc.reverse_complement(F.col("s"))) == [("ACGTT",)]
    assert values(spark, [("a tumour-cell", ), ("tumours",)], "s string", sc.has_keyword(F.col("s"), ["tumour"])) == [(True,), (False,)]
    assert values(spark, [("X causes Y",), ("X does not cause; it never causes Y",)], "s string", sc.unnegated(F.col("s"), ["causes"])) == [(["causes"],), ([],)]
    assert values(spark, [("Up 2.5 and -3e2 in TP53. Then 4!",)], "s string", sc.numbers(F.col("s")), sc.entities(F.col("s")), F.size(sc.sentences(F.col("s")))) == [([2.5, -300.0, 4.0], ["TP53"], 2)]
    assert values(spark, [("patientName",), ("age",), ("gene",)], "s string", sc.sensitivity(F.col("s"))) == [("identifying",), ("quasi",), ("none",)]
    assert values(spark, [("at /home/me/x.txt by a@b.org token=abc",)], "s string", sc.redact_text(F.col("s"))) == [("at <path> by <email> token=<redacted>",)]
    assert sc.redact_params({"api_key": 1, "p": ["/root/x", {"token": "t"}]}) == {"api_key": "<redacted>", "p": ["<path>", {"token": "<redacted>"}]}
    assert values(spark, [('gene_id "G1.2"; gene_name "A";',)], "s string", sc.gtf_attribute(F.col("s"), "gene_name"), sc.gtf_attribute(F.col("s"), "tag")) == [("A", None)]
    assert values(spark, [("GSE12345",), ("GSE12",)], "s string", sc.accession_folder(F.col("s"))) == [("GSE12nnn",), ("GSEnnn",)]
    assert values(spark, [("2024-01-01T00:00:00Z",), ("2023-12-31T23:59:30Z",), ("x",)], "s string", sc.since(F.col("s"), "2024-01-01 00:00:00", 40)) == [(True,), (True,), (False,)]
    assert sc.unwrap({"result": {"data": [1]}}) == [1] and sc.json_safe_value({"a": [math.nan, 1.0]}) == {"a": [None, 1.0]}
    p = [r[0] for r in values(spark, [(0.0,), (0.01,), (1.0,)], "p double", sc.neg_log10(F.col("p")))]
    assert p == pytest.approx([3.0, 2.0, 0.0])


def test_transforms(spark):
    df = spark.createDataFrame([("a", "s", 1), ("b", "s", 3), ("a", "z", 0)], "feature string, sample string, value int")
    assert {tuple(r) for r in sc.cpm(df).select("feature", "sample", "cpm").collect()} == {("a", "s", 250000.0), ("b", "s", 750000.0), ("a", "z", 0.0)}
    assert sum(r["clr"] for r in sc.clr(df).where("sample = 's'").collect()) == pytest.approx(0)
    lengths = spark.createDataFrame([("a", 1000), ("b", 0)], "feature string, length int")
    assert {r["sample"]: r["tpm"] for r in sc.tpm(df, lengths).collect()} == {"s": 1e6, "z": 0.0}
    assert values(spark, [(math.log1p(1e4 * 3 / 50), 50)], "v double, l int", sc.undo_lognorm(F.col("v"), F.col("l"))) == [(3,)]
    assert values(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>", sc.l2_unit(F.col("v"))) == [([0.6, 0.8],), ([0.0, 0.0],)]


def test_umi_collapse_and_reads(spark):
    rows = [("c", "+", 5, "AAAA", "r1", 30, 10), ("c", "+", 5, "AAAA", "r2", 40, 10), ("c", "+", 5, "AAAA", "r3", 40, 12), ("c", "+", 5, "AAAT", "r4", 60, 1), ("c", "+", 5, "GGGG", "r5", 1, 1), ("c", "-", 5, "AAAT", "r6", 1, 1)]
    df = spark.createDataFrame(rows, "chrom string, strand string, anchor int, umi string, name string, mapq int, quality int")
    assert sorted((r["strand"], r["cluster"], r["name"], r["reads"]) for r in sequencing.umi_dedup(df).collect()) == [("+", "AAAA", "r4", 4), ("+", "GGGG", "r5", 1), ("-", "AAAT", "r6", 1)]
    genes = spark.createDataFrame([("c", 0, 100, "+"), ("c", 200, 300, "-"), ("c", 250, 260, "+")], "chrom string, start long, end long, strand string")
    reads = spark.createDataFrame([("c", 10, 20, "+", "a"), ("c", 30, 40, "+", "b"), ("c", 210, 220, "-", "d"), ("c", 255, 256, "-", "e")], "chrom string, start long, end long, strand string, name string")
    r = sequencing.strandedness(reads, genes, 2).first()
    assert (r["informative"], r["sense"], r["strandedness"]) == (3, 1.0, "forward")
    frags = spark.createDataFrame([("c", 0, 10, "x", 2), ("c", 5, 30, "x", 1), ("c", 90, 95, "y", 1)], "chrom string, start long, end long, barcode string, n long")
    peaks = spark.createDataFrame([("c", 8, 12), ("c", 20, 25)], "chrom string, start long, end long")
    m, cells = sequencing.fragments_to_matrix(frags, peaks)
    assert {tuple(r) for r in m.collect()} == {("x", "c:8-12", 3), ("x", "c:20-25", 1)} and cells.count() == 2
    with pytest.raises(ValueError):
        sequencing.fragments_to_matrix(frags, peaks.union(peaks))
    f = counts.frip(frags, peaks).first()
    assert f["frip"] == pytest.approx(2 / 3)
    manifest = sequencing.fastq_manifest(["a/s1_S1_L001_R1_001.fastq.gz", "s1_S1_L001_R2_001.fastq.gz", "s2_1.fq", "odd.txt"])
    assert [(x["sample"], x["paired"], x["error"]) for x in manifest] == [("s1", True, None), ("odd.txt", False, "unknown name"), ("s2", False, None)] or {(x["sample"], x["paired"]) for x in manifest} == {("s1", True), ("s2", False), ("odd.txt", False)}


def test_motif_threshold_is_exact(spark):
    import itertools

    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(4, 4)), 2)
    scores = sorted((sum(m[i][c] for i, c in enumerate(w)) for w in itertools.product(range(4), repeat=4)), reverse=True)
    t = sequencing.motif_threshold(m, p=0.05)
    assert sum(s >= t - 1e-9 for s in scores) / 256 <= 0.05 < sum(s >= t - 0.01 - 1e-9 for s in scores) / 256 + 0.01
    best = "".join("ACGT"[c] for c in m.argmax(1))
    seqs = spark.createDataFrame([("s", "NN" + best + "NN"), ("n", None)], "id string, sequence string")
    hits = sequencing.scan_motifs(seqs, {"m": m.tolist()}, 0.01).where("strand = '+'").collect()
    assert (hits[0]["start"], hits[0]["score"]) == (2, pytest.approx(scores[0]))


def test_contacts(spark):
    rng = np.random.default_rng(3)
    a = rng.poisson(5, (12, 12)) + 20 * np.equal.outer(np.arange(12) // 6, np.arange(12) // 6)
    a = np.triu(a) + np.triu(a, 1).T
    pix = spark.createDataFrame([("c", i, j, int(a[i, j])) for i in range(12) for j in range(i, 12)], "chrom string, i long, j long, count long")
    w = {r["i"]: r["w"] for r in contacts.ice_weights(pix, 60).collect()}
    sums = [sum(a[i, j] * w[i] * w[j] for j in range(12)) for i in range(12)]
    assert np.std(sums) / np.mean(sums) < 0.02
    ins = contacts.insulation(pix, 3).where("boundary").collect()
    assert [r["bin"] for r in ins] == [6]
    e = contacts.compartments(pix, spark.createDataFrame([("c", i, float(i >= 6)) for i in range(12)], "chrom string, i long, gc double")).toPandas().set_index("i").e1
    assert (e[:6] < 0).all() and (e[6:] > 0).all()
    same = contacts.stratum_correlation(pix, pix, 8).first()
    assert same["scc"] == pytest.approx(1.0)
    b = spark.createDataFrame([("c", 0, 1.0), ("c", 6, 3.0), ("c", 9, 5.0)], "chrom string, bin long, strength double")
    assert [tuple(r) for r in contacts.domains(b).orderBy("start").collect()] == [("c", 0, 6, 2.0), ("c", 6, 9, 4.0)]
    x = spark.createDataFrame([("c", 0, 1.0, True), ("c", 1, -1.0, True), ("c", 2, 1.0, False), ("c", 3, 0.1, True), ("c", 4, 0.1, True)], "chrom string, i long, e1 double, phased boolean")
    y = spark.createDataFrame([("c", 0, -1.0, True), ("c", 1, 1.0, True), ("c", 2, -1.0, True), ("c", 3, 0.9, True), ("c", 4, 0.2, True)], "chrom string, i long, e1 double, phased boolean")
    assert [r["switch"] for r in contacts.compartment_switch(x, y).orderBy("i").collect()] == ["A_to_B", "B_to_A", "unphased_sign_flip", "quantitative_shift", "unchanged"]
    spot = spark.createDataFrame([("c", i, j, 200 if (i, j) == (10, 20) else 10) for i in range(30) for j in range(i, 30)], "chrom string, i long, j long, count long")
    assert [(r["i"], r["j"]) for r in contacts.loops(spot, fdr=0.01).where("expected > 5 and count > 100").collect()] == [(10, 20)]


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)) + np.repeat(np.eye(5)[:3] * 8, 20, 0)
    df = spark.createDataFrame([(i, [float(x) for x in r], i // 20) for i, r in enumerate(v)], "id long, vector array<double>, label int")
    want = {}
    for metric in ("cosine", "euclidean"):
        u = v / np.linalg.norm(v, axis=1)[:, None] if metric == "cosine" else v
        s = u @ u.T if metric == "cosine" else -np.linalg.norm(u[:, None] - u[None], axis=2)
        np.fill_diagonal(s, -np.inf)
        want[metric] = {i: list(np.argsort(-s[i], kind="stable")[:4]) for i in range(60)}
        for block in (4096, 7):
            monkeypatch.setattr(embedding, "BLOCK", block)
            got = embedding.nearest(df, df, 4, metric=metric).orderBy("id", "rank").collect()
            assert {i: [r["neighbour"] for r in got if r["id"] == i] for i in range(60)} == want[metric]
    edges = embedding.nearest(df, df, 4)
    assert embedding.median_lisi(edges, df).first()["median_lisi"] == pytest.approx(1.0)
    assert embedding.silhouette(df).first()["silhouette"] > 0.5
    labels = embedding.label_propagation(edges.withColumnRenamed("similarity", "weight"), 6).collect()
    assert all(r["label"] // 20 == r["id"] // 20 for r in labels)
    long = spark.createDataFrame([(f"c{i}", f"f{j}", float(x)) for i, r in enumerate(v) for j, x in enumerate(r)], "cell string, feature string, value double")
    got = embedding.truncated_svd(long, 2, rounds=60).toPandas().set_index("cell").scores
    u_, s_, _ = np.linalg.svd(v)
    mine = np.array([got[f"c{i}"] for i in range(60)])
    assert np.abs(np.abs((mine[:, 0] / np.linalg.norm(mine[:, 0])) @ u_[:, 0]) - 1) < 1e-2
    scores, shares = embedding.sample_pca(long.withColumnRenamed("cell", "sample"), 2, log_cpm=False)
    assert scores.shape == (60, 2) and shares[0] > shares[1]
    auc = embedding.enrichment_scores(long.where("value > 0"), spark.createDataFrame([("t", "f0")], "term string, gene string"), 0.4).collect()
    assert all(0 <= r["score"] <= 1 for r in auc)


def test_joins_with_rules(spark):
    c = spark.createDataFrame([("f", "s1", 1), ("f", "s2", 2)], "feature string, sample string, value int")
    m = spark.createDataFrame([("s1",), ("s3",)], "sample string")
    with pytest.raises(PlanViolation):
        joins.enforce_correspondence(c, m)
    with pytest.raises(PlanViolation):
        joins.enforce_correspondence(c, m, ["s1", "s2", "s3"])
    assert joins.enforce_correspondence(c, m, ["s2", "s3"]).count() == 1
    q = spark.createDataFrame([("AAA-1",), ("CCC-1",)], "barcode string")
    ref = spark.createDataFrame([("AAA", "T"), ("CCC", " ")], "barcode string, label string")
    out = joins.join_labels(q, ref, [lambda x: x, lambda x: F.regexp_replace(x, r"-\d+$", "")])
    assert {tuple(r) for r in out.collect()} == {("AAA-1", "T"), ("CCC-1", "unassigned")}
    with pytest.raises(PlanViolation):
        joins.join_labels(q, ref.union(ref), [lambda x: F.regexp_replace(x, r"-\d+$", "")])
    assert joins.grids_equal(ref.selectExpr("barcode as chrom", "1 as start", "2 as end"), ref.selectExpr("barcode as chrom", "1 as start", "2 as end"))
    nodes = spark.createDataFrame([("rna", "de", "n1", "ran"), ("rna", "ora", "n2", "error")], "modality string, analysis string, node string, status string")
    claims = spark.createDataFrame([("rna", "de"), ("rna", "ora"), ("rna", "x"), (None, "de")], "modality string, analysis string")
    assert sorted((r["linked"], r["reason"] or "") for r in joins.link_claims(claims, nodes).collect()) == [(False, "claim names no analysis"), (False, "no such node"), (False, "node did not run"), (True, "")] or len(joins.link_claims(claims, nodes).where("linked").collect()) == 1


def test_governance_rules(spark):
    blocks = spark.createDataFrame([(1, "TP53 rose 2.5 fold", "causal", "s"), (2, "MDM2 drives 9 genes", "associative", None), (3, "", "associative", "s")], "block int, text string, tier string, source string")
    facts = spark.createDataFrame([(1, 2.5, "tp53"), (2, 4.0, None)], "block int, value double, entity string")
    card = {r["block"]: r for r in governance.evidence_card(blocks, facts).collect()}
    assert card[1]["supported"] and not card[2]["supported"] and card[2]["unsupported_numbers"] == [9.0] and card[2]["unsupported_entities"] == ["MDM2"] and card[3]["supported"]
    assert {r["block"]: r["errors"] for r in governance.validate_blocks(blocks).collect()} == {1: [], 2: ["no source", "causal wording"], 3: ["no text"]}
    claims = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "")], "claim string, text string")
    v = spark.createDataFrame([("a", True, None)], "claim string, supported boolean, reason string")
    assert {r["claim"]: (r["state"], r["reason"]) for r in governance.publish(claims, v).collect()} == {"a": ("published", None), "b": ("withheld", "not verified"), "c": ("no_claim", None)}
    ex = spark.createDataFrame([("n1", "success", False), ("n1", "skipped", None), ("n2", "weird", None), ("n3", "success", True), ("n3", "error", True)], "node string, status string, ran boolean")
    got = {r["node"]: (r["status"], r["divergence"]) for r in governance.reconcile(spark.createDataFrame([("n1",), ("n3",), ("n4",)], "node string"), ex).collect()}
    assert got == {"n1": ("skipped", "planned_not_run"), "n2": ("not_run", None), "n3": ("ran", None), "n4": ("not_run", "planned_not_run")}
    h = spark.createDataFrame([(1, "up", "down", ["A"], ["A"], 0, 0), (2, "up", "UP", ["A"], ["A"], 0, 1), (3, "up", "down", ["B"], ["A"], 0, 2)], "id int, prediction string, refuted_by string, entities array<string>, known array<string>, caveats int, position int")
    assert [r["quarantined"] for r in governance.hypothesis_gates(h).orderBy("id").collect()] == [False, True, True]
    s = spark.createDataFrame([(3, "l1", 0.5), (3, "l1", 2.0), (1, "l1", 1.0), (1, "l2", 1.0)], "id int, lineage string, effect double")
    assert [r["id"] for r in governance.rank_hypotheses(h, s).orderBy("rank").collect()] == [1, 3, 2]
    lic = spark.createDataFrame([("e", "i", "randomized", "p", "true"), ("e", "i", "observed", "p", "true"), ("e", None, "randomized", "p", "true")], "estimand string, intervention string, assignment string, population string, identified string")
    assert [r[0] for r in lic.select(governance.causal_licence(F.struct("*"))).collect()] == [True, False, False]


def test_manifests_and_store(spark, tmp_path):
    f = tmp_path / "in.txt"
    f.write_text("x")
    m = state.stage_manifest("s", [str(f)], {"a": 1}, "1")
    assert state.is_current(m, "s", [str(f)], {"a": 1}, "1") and not state.is_current(m, "s", [str(f)], {"a": 2}, "1")
    f.write_text("y")
    assert not state.is_current(m, "s", [str(f)], {"a": 1}, "1") and not state.is_current(None, "s", [], {}, "1")
    d = state.decision_manifest("e", {"x": 1}, [{"k": "v"}])
    assert state.verify_manifest(d) and not state.verify_manifest(d | {"parent": "z"})
    log = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b"), ("e", 3, "a"), ("e", 4, "c")], "experiment string, seq int, spec string")
    assert [(r["index"], r["kind"]) for r in state.fork_index(log).orderBy("seq").collect()] == [(0, "primary"), (1, "post_hoc_fork"), (0, "replay"), (2, "post_hoc_fork")]
    cap = state.capsule({"a": str(f)})
    assert state.verify_capsule(cap, {"a": str(f)}) == []
    f.write_text("z")
    assert state.verify_capsule(cap, {"a": str(f)}) == ["a: changed"]
    store = state.Store(spark, str(tmp_path / "db"))
    store.upsert("wings", {"id": "w", "name": "first"}, {"id": "v"})
    store.upsert("wings", {"id": "w", "name": "second"})
    store.upsert("halls", {"id": "h", "wing_id": "w"}, {"id": "lost", "wing_id": "gone"})
    store.upsert("rooms", {"id": "r", "hall_id": "h"})
    store.upsert("findings", {"id": "f", "room_id": "r", "confidence": 0.5}, {"id": "g", "room_id": "r"})
    store.upsert("decisions", {"id": "d", "wing_id": "w", "question": "use covariate batch?", "decision": "approved"})
    assert {r["id"]: r["name"] for r in store.read("wings").collect()} == {"w": "second", "v": None}
    store.invalidate("f")
    assert [r["id"] for r in store.active_findings("r").collect()] == ["g"]
    assert {k: v.count() for k, v in store.snapshot("w").items()} == {"wings": 1, "halls": 1, "rooms": 1, "findings": 2, "tunnels": 0, "decisions": 1}
    assert [tuple(r) for r in store.dangling().collect()] == [("halls", "lost")]
    assert store.similar_decisions(["batch", "covariate"]).first()["score"] == 2 and store.startup_context(1).count() == 1
    made = []
    df = state.cached(spark.range(3).withColumn("x", F.lit(len(made))), str(tmp_path / "cache"), {"q": 1})
    assert state.cached(spark.range(9), str(tmp_path / "cache"), {"q": 1}).count() == df.count() == 3


def test_scripts_and_json(tmp_path):
    run = state.Script("double", lambda p: {"y": 2 * p["x"]}, "1", {"x": True}, ("y",))
    assert run({"x": 2}) == {"y": 4, "status": "success"} and run({})["status"] == "error"
    assert state.Script("bad", lambda p: 1 / 0, "1", {}, ())({})["error"].startswith("ZeroDivisionError")
    assert state.Script("thin", lambda p: {}, "1", {}, ("y",))({})["status"] == "error"
    state.write_json(str(tmp_path / "a.json"), {"x": math.nan, "y": [1, math.inf]})
    assert json.loads((tmp_path / "a.json").read_text()) == {"x": None, "y": [1, None]}


def test_kappa_and_neighbours(spark):
    r = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (4, "c")], "unit int, label string")
    assert counts.krippendorff_alpha(r).first()["alpha"] == pytest.approx(1 - (2 / 6) / ((36 - 18) / (6 * 5)), abs=1e-9)
    a = spark.createDataFrame([(1, [2, 3]), (2, [])], "cell int, neighbours array<int>")
    b = spark.createDataFrame([(1, [3, 4]), (2, [])], "cell int, neighbours array<int>")
    assert [tuple(x) for x in sets.neighbour_overlap(a, b).orderBy("cell").collect()] == [(1, pytest.approx(1 / 3), 0.5), (2, None, None)]


def test_research_crate():
    crate = state.research_crate({"version": "1", "commit": "c", "ended": "2024-01-01"}, [{"path": "in.csv", "sha256": "h", "bytes": 3}], ["report.html"], [{"id": "k", "text": "x", "tier": "association"}, {"text": "no id"}])
    nodes = {x["@id"]: x for x in crate["@graph"]}
    assert len(nodes) == len(crate["@graph"]) == 7 and nodes["in.csv"]["sha256"] == "h" and nodes["#claim-k"]["text"] == "x"

    def refs(x):
        found = [x["@id"]] if set(x) == {"@id"} else []
        return found + [r for v in x.values() for y in (v if isinstance(v, list) else [v]) if isinstance(y, dict) for r in refs(y)]

    assert {r for x in crate["@graph"] for r in refs(x)} - {"https://w3id.org/ro/crate/1.1"} <= set(nodes)
    for bad in ({"id": "s", "tier": "speculative"}, {"id": "s", "node": "hypothesis://1"}):
        with pytest.raises(ValueError):
            state.research_crate({}, [], [], [bad])
