import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldt import queries as core
from veldt.functions import special as sp
from veldt.operators import counts, models, sampling, sets, verbs
from veldt.plans.model import PlanViolation


def test_tails_have_known_values():
    assert sp.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert sp.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert sp.f_sf(4.0, 2, 20) == pytest.approx(1.4**-10)
    assert sp.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert sp.t_two_sided(math.inf, 5) == 0 and sp.t_two_sided(None, 5) is None
    for k in range(6):
        want = sum(math.comb(10, i) * math.comb(40, 5 - i) for i in range(k, 6)) / math.comb(50, 5)
        assert sp.hypergeometric_sf(k, 50, 10, 5) == pytest.approx(want)
    assert sp.fisher_exact(8, 2, 1, 5)[1] == pytest.approx(0.0349650, abs=1e-6)
    assert sp.fisher_exact(8, 2, 1, 5, "greater")[1] == pytest.approx(0.024475524, abs=1e-8)


def test_verb_rows_and_errors(spark):
    df = spark.createDataFrame([(1, "1.5", 2.0, None), (2, "x", None, None), (3, "2", 4.0, 1.0)], "k int, a string, b double, c double")
    rows = {r["k"]: r for r in verbs.row_aggregate(df, "k", ["a", "b", "c"], "sum", "s").join(verbs.row_aggregate(df, "k", ["a", "b", "c"], "median", "m"), "k").join(verbs.row_aggregate(df, "k", ["a", "b", "c"], "var", "v"), "k").collect()}
    assert (rows[1]["s"], rows[2]["s"], rows[3]["s"]) == (3.5, 0.0, 7.0)
    assert (rows[1]["m"], rows[2]["m"], rows[3]["m"]) == (1.75, None, 2.0) and rows[2]["v"] is None and rows[3]["v"] == pytest.approx(7 / 3)
    with pytest.raises(PlanViolation):
        verbs.corr(df, "a", "zz")
    with pytest.raises(ValueError):
        verbs.corr(df, "a", "b")
    assert [r["value"] for r in verbs.value_counts(df, "c").collect()] == ["nan", "1.0"]
    assert verbs.head(df, ["k"], 99).count() == 3


def test_rank_sum_exact_and_normal(spark):
    x, y = [1.1, 2.2, 3.3], [2.5, 4.4, 5.5, 6.6]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", v) for v in y], "g string, v double")
    got = verbs.rank_sum(df, "v", "g", "a", "b")
    import itertools

    u = sum(p > q for p in x for q in y)
    us = [sum(p > q for p in c for q in [z for z in x + y if z not in c]) for c in itertools.combinations(x + y, 3)]
    assert got["statistic_U"] == u and got["p_value"] == pytest.approx(min(1, 2 * min(np.mean([k <= u for k in us]), np.mean([k >= u for k in us]))))
    big = spark.createDataFrame([("a", float(i % 7)) for i in range(40)] + [("b", float(i % 9)) for i in range(50)], "g string, v double")
    assert 0 < verbs.rank_sum(big, "v", "g", "a", "b")["p_value"] < 1


@pytest.fixture(scope="module")
def arms(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{f:02d}", f"u{u}", "a" if u < 5 else "b", float(rng.normal(3 * (f < 5) * (u < 5), 1 + f % 3))) for f in range(30) for u in range(10)]
    return pd.DataFrame(rows, columns=["feature", "unit", "g", "value"]), spark.createDataFrame(rows, "feature string, unit string, g string, value double")


def test_moderated_and_jackknife_against_numpy(arms):
    pdf, df = arms

    def contrast(d):
        out = {}
        stats = {f: (x[x.g == "a"].value, x[x.g == "b"].value) for f, x in d.groupby("feature")}
        s2 = {f: ((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(a) + len(b) - 2) for f, (a, b) in stats.items()}
        s0 = np.median([v for v in s2.values() if v > 1e-12])
        for f, (a, b) in stats.items():
            n = len(a) + len(b) - 2
            post = (4 * s0 + n * s2[f]) / (4 + n)
            out[f] = (a.mean() - b.mean(), (a.mean() - b.mean()) / math.sqrt(post * (1 / len(a) + 1 / len(b))), 4 + n)
        return out

    got = {r["feature"]: r for r in models.moderated(df, "g", "a", "b").collect()}
    for f, (e, t, d) in contrast(pdf).items():
        assert got[f]["t"] == pytest.approx(t) and got[f]["effect"] == pytest.approx(e) and got[f]["df"] == d
        assert got[f]["p"] == pytest.approx(sp.t_two_sided(t, d))
    jack = {r["feature"]: r for r in models.leave_one_out(df, "g", "a", "b").collect()}
    folds = {u: contrast(pdf[pdf.unit != u]) for u in pdf.unit.unique()}
    for f in got:
        effects = [folds[u][f][0] for u in folds]
        assert jack[f]["folds"] == 10 and jack[f]["sign_share"] == pytest.approx(np.mean(np.sign(effects) == np.sign(got[f]["effect"])))
        assert jack[f]["iqr"] == pytest.approx(np.subtract(*np.percentile(effects, [75, 25])))
    assert jack["f00"]["stable"]


def test_ols_equals_numpy(arms):
    pdf, df = arms
    units = sorted(pdf.unit.unique())
    design = pd.DataFrame({"one": 1.0, "g": [1.0 if int(u[1:]) < 5 else 0.0 for u in units], "x": [math.sin(i) for i in range(10)]}, index=units)
    got = {r["feature"]: r for r in models.ols(df, design, "g").collect()}
    for f, x in pdf.groupby("feature"):
        y = x.set_index("unit").loc[units].value.to_numpy()
        b, rss, *_ = np.linalg.lstsq(design.to_numpy(), y, rcond=None)
        se = math.sqrt(rss[0] / 7 * np.linalg.inv(design.T @ design)[1, 1])
        assert got[f]["effect"] == pytest.approx(b[1]) and got[f]["t"] == pytest.approx(b[1] / se)
    with pytest.raises(ValueError):
        models.ols(df, design.assign(y=design["one"]), "g")


def test_planted_changes_are_found(spark):
    rows, meta, truth = sampling.simulate_counts(spark, 300, 40, 6)
    rows, truth = rows.cache(), truth.cache()
    for fit in (models.differential, models.negative_binomial):
        s = sampling.score_detection(fit(rows, meta, "group", "a", "b"), truth).first()
        assert s["recall"] > 0.8 and s["fdr"] < 0.2 and s["effect_r"] > 0.9, fit
    null = rows.join(truth.where("not changed").select("feature"), "feature", "left_semi")
    assert models.differential(null, meta, "group", "a", "b").where("significant").count() <= 5


def test_pseudobulk_rules(spark):
    cells = spark.createDataFrame([(f"c{i}", "t", f"r{i % 4}", "x" if i % 4 < 2 else "y") for i in range(48)] + [("z", "small", "r0", "x")], "cell string, group string, replicate string, condition string")
    values = cells.select("cell", F.lit("f1").alias("feature"), F.lit(2).alias("value")).union(cells.select("cell", F.lit("f0"), F.lit(0)))
    sums, samples = counts.pseudobulk(values, cells)
    assert sorted(tuple(r) for r in sums.collect()) == [("t", f"r{i}", "f1", 24) for i in range(4)]
    paired = cells.withColumn("condition", F.when(F.col("cell") < "c2", "x").otherwise(F.lit("y")))
    assert {r["sample"] for r in counts.pseudobulk(values, paired, min_cells=1)[1].collect()} >= {"r0__x", "r0__y"}
    units = spark.createDataFrame([("s1", "u", "x"), ("s2", "u", "y")], "sample string, unit string, cond string")
    m = spark.createDataFrame([("f", "s1", 1), ("f", "s2", 2)], "feature string, sample string, value int")
    with pytest.raises(counts.DesignError):
        counts.sum_replicates(m, units, "unit", ["cond"])
    assert counts.sum_replicates(m, units, "unit", ["cond"], "drop")[0].first()["value"] == 3


def test_gates(spark):
    df = spark.createDataFrame([(float(i), 100.0 + i % 5, i) for i in range(60)] + [(1e6, 1e6, 99)], "depth double, features double, id int")
    out = {r["id"]: r["doublet"] for r in counts.doublets(df.select("id", "depth", "features")).collect()}
    assert out[99] and sum(map(bool, out.values())) <= math.ceil(0.12 * 61)
    assert all(v is None for v in (r["doublet"] for r in counts.doublets(df.limit(10).select("id", "depth", "features")).collect()))
    q = spark.createDataFrame([(0.1, None), (0.9, 5.0), (None, None)], "frip double, tss double").select(counts.qc_failures({"frip": ("frip", 0.2, "min"), "tss": ("tss", 4.0, "min")}).alias("q")).collect()
    assert [r["q"] for r in q] == [["frip: beyond 0.2"], [], None]
    s = spark.createDataFrame([(0.01, 2.0), (0.01, float("nan")), (None, 3.0), (0.05, 3.0)], "p double, e double")
    assert [r[0] for r in s.select(counts.significant(F.col("p"), F.col("e"), least=1.0)).collect()] == [True, False, False, False]
    assert counts.hidden_batches(["condition", "seq_lane", "replicate", "age"], "condition", "replicate") == ["seq_lane"]
    sheet = spark.createDataFrame([("x", "r1", "b1", "m"), ("x", "r2", "b1", "f"), ("y", "r1", "b2", "m"), ("y", "r2", "b2", "f")], "condition string, replicate string, batch string, sex string")
    assert {r["factor"]: r["confounded"] for r in counts.confounded(sheet, ["batch", "sex"]).collect()} == {"batch": True, "sex": False}
    assert counts.pairing(sheet, test="y", ref="x") == "complete"


def test_design_ladder():
    ok = [{"c": c, "b": b} for c in "xy" for b in ("1", "1", "2", "2")]
    assert models.validate_design(ok, "c", ["b"])["status"] == "ok"
    assert models.validate_design([], "c")["status"] == "block"
    assert models.validate_design(ok[:4], "c")["status"] == "block"
    assert models.validate_design([{"c": "x"}, {"c": "y"}, {"c": "y"}], "c")["status"] == "block"
    assert models.validate_design(ok + [{"c": "NA", "b": "1"}], "c", ["b"])["status"] == "warn"
    assert models.validate_design([{"c": c, "b": c} for c in "xxyy"], "c", ["b"])["status"] == "block"


def test_enrichment_keeps_terms_without_overlap(spark):
    members = spark.createDataFrame([("t1", f"g{i}") for i in range(10)] + [("t2", f"g{i}") for i in range(10, 30)], "term string, gene string")
    query = spark.createDataFrame([(f"G{i}",) for i in range(6)], "gene string")
    rows = {r["term"]: r for r in sets.enrichment(query, members, all_terms=True).collect()}
    p = sp.hypergeometric_sf(6, 30, 10, 6)
    assert rows["t2"]["k"] == 0 and rows["t2"]["p"] == 1.0 and rows["t1"]["p"] == pytest.approx(p) and rows["t1"]["padj"] == pytest.approx(2 * p)
    assert [r["term"] for r in sets.enrichment(query, members).collect()] == ["t1"]


def test_agreement_measures(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (1, 0)], "a int, b int")
    r = sets.adjusted_rand(df, "a", "b").first()
    assert 0 < r["ari"] < 1 and 0 < r["nmi"] < 1
    assert sets.adjusted_rand(df, "a", "a").first()["ari"] == 1.0
    one = df.withColumn("a", F.lit(1))
    assert sets.adjusted_rand(one, "a", "a").first()["nmi"] == 1.0
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 3))
    y = x[:, [2, 0, 1]] * [1, -1, 1] + 0.01 * rng.normal(size=(30, 3))
    assert [(i, j) for i, j, _ in sets.match_factors(x, y)] == [(0, 1), (1, 2), (2, 0)]
    assert sets.subspace_concordance(x, y).min() > 0.99


def test_copula_and_permutations(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=200)
    good = [("p", float(5 + v), float(5 + v + 0.1 * rng.normal())) for v in s[:100]]
    bad = [("p", float(rng.normal()), float(rng.normal())) for _ in range(100)]
    out = models.copula_idr(spark.createDataFrame(good + bad, "pair string, score1 double, score2 double")).toPandas()
    assert out[out.score1 > 4].local_idr.mean() < 0.3 < out[out.score1 < 2].local_idr.mean()
    assert models.copula_idr(spark.createDataFrame(good[:5], "pair string, score1 double, score2 double")).count() == 0
    labels = {f"s{i}": "ab"[i % 2] for i in range(8)}
    perms = sampling.permutations(labels, 20, {s: "12"[int(s[1]) // 4] for s in labels}, 3)
    assert len(perms) == 20 and all(p != labels and sum(p[s] == "a" for s in ("s0", "s1", "s2", "s3")) == 2 for p in perms)
    with pytest.raises(ValueError):
        sampling.permutations({"x": "a", "y": "a"}, 1)


def test_stratified_sample(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 20, "rare").otherwise("common").alias("s"))
    got = sampling.stratified(df, "id", "s", 100, 10)
    n = {r["s"]: r["count"] for r in got.groupBy("s").count().collect()}
    assert sum(n.values()) == 100 and n["rare"] >= 10
    assert got.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in sampling.stratified(df.repartition(7), "id", "s", 100, 10).collect())


def test_all_pair_correlations_cover_the_matrix(spark, sf):
    m = core._matrix(spark, sf).toPandas().pivot(index="sample", columns="feature", values="value").astype(float)
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in core.QUERIES["m_all_pair_correlations"](spark, sf).collect()}
    known = m.notna().to_numpy()
    both = known.T.astype(int) @ known.astype(int)
    names = list(m.columns)
    want = {(a, b): both[i, j] for i, a in enumerate(names) for j, b in enumerate(names) if a < b and both[i, j]}
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 100
    r = m.corr(min_periods=3)
    for a, b in list(want)[::97]:
        if not math.isnan(r.loc[a, b]):
            assert got[a, b][1] == pytest.approx(r.loc[a, b], abs=1e-6)


def test_abundance_regression_and_cells(spark):
    n = {"a1": (4, 9, 2), "a2": (6, 7, 3), "a3": (5, 9, 1), "b1": (9, 3, 2), "b2": (8, 5, 5)}
    rows = [(s, k, s[0]) for s, x in n.items() for k, m in zip("xyz", x, strict=True) for _ in range(m)] + [("c1", "w", "c")]
    got = {r["kind"]: r for r in models.abundance(spark.createDataFrame(rows, "sample string, kind string, g string"), "sample", "kind", "g", "b", "a").collect()}
    assert sorted(got) == ["x", "y", "z"]
    counts = np.array(list(n.values()), float)
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    y = logs - logs.mean(1, keepdims=True)
    x = np.column_stack([np.ones(5), [0, 0, 0, 1, 1]])
    inv = np.linalg.inv(x.T @ x)
    for i, k in enumerate("xyz"):
        beta = inv @ x.T @ y[:, i]
        e = (y[:, i] - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))
        se = np.sqrt((inv @ x.T @ np.diag(e**2) @ x @ inv)[1, 1])
        assert got[k]["slope"] == pytest.approx(beta[1]) and got[k]["se"] == pytest.approx(se) and got[k]["model"] == "clr_hc3" and got[k]["padj"] >= got[k]["p"]
    assert (got["x"]["n_test"], got["x"]["n_ref"]) == (17, 15)
    same = [(s, k, s[0]) for s in ("a1", "a2", "b1", "b2") for k in "xxy"]
    for r in models.abundance(spark.createDataFrame(same, "sample string, kind string, g string"), "sample", "kind", "g", "b", "a").collect():
        assert (r["model"], r["fdr_included"], r["padj"], r["slope"], r["p"]) == ("fisher", False, None, None, pytest.approx(1.0))


def test_contrast_rows_and_thresholds(spark):
    df = spark.createDataFrame([("b_vs_a", 1, 0.01, 0.4), ("b_vs_a", 2, 0.01, 2.0), ("c_vs_a", 1, 0.2, 2.0), (None, 1, 0.2, 2.0)], "contrast string, group int, padj double, effect double")
    assert counts.of_contrast(df, "b_vs_a").count() == 2 and counts.of_contrast(df, "b_vs_a", "1").count() == 1 and counts.of_contrast(df.drop("contrast"), "b_vs_a").count() == 4
    t = counts.Thresholds.of({"global_padj": "0.3", "global_lfc": "none"}, "bulk", log2fc=1.0)
    assert (t.padj, t.log2fc, t.modality) == (0.3, 1.0, "bulk") and counts.Thresholds.of(None) == counts.Thresholds()
    assert df.where(t.significant(F.col("padj"), F.col("effect"))).count() == 3
