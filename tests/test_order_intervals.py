import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.functions import order as o
from veldt.operators import intervals as iv


def bh(p):
    ok = [x for x in p if x is not None and not math.isnan(x) and 0 <= x <= 1]
    n, out = len(ok), {}
    for x in ok:
        out[x] = min(min(1.0, y * n / sum(z <= y for z in ok)) for y in ok if y >= x)
    return out


@pytest.mark.parametrize("p", [[], [0.3], [0.01, 0.01, 0.2, float("nan"), None, 1.5, -0.1, 0.04, 1.0, 0.0], [round(random.Random(1).random(), 2) for _ in range(200)]])
def test_bh(spark, p):
    df = spark.createDataFrame([(i, x, "f") for i, x in enumerate(p)], "i int, p double, fam string")
    want = bh(p)
    for got in (o.bh_adjust(df, "p", "q", ["fam"]), o.bh_adjust(df, "p", "q")):
        rows = {r["i"]: r["q"] for r in got.collect()}
        assert len(rows) == len(p)
        for i, x in enumerate(p):
            y = want.get(x) if x is not None and x == x else None
            assert rows[i] == pytest.approx(y) if y is not None else rows[i] is None


def test_families_are_declared(spark):
    df = spark.createDataFrame([(0.01, "a"), (0.02, "b")], "p double, c string")
    assert o.preregistered_bh(df, "p", "q", "per_contrast", "c", "per_contrast").count() == 2
    for bad in (("pooled", "per_contrast"), ("other", None)):
        with pytest.raises(ValueError):
            o.preregistered_bh(df, "p", "q", bad[0], "c", bad[1])


def spans(n=60, seed=0, size=40):
    rng = random.Random(seed)
    return [(rng.choice("ab"), s, s + rng.randint(1, size), i) for i, s in enumerate(rng.randint(0, 300) for _ in range(n))]


@pytest.mark.parametrize("touch, gap", [(True, 0), (False, 0), (True, 7)])
def test_runs(spark, touch, gap):
    rows = spans()
    df = spark.createDataFrame(rows, "c string, s long, e long, i int")
    got = sorted(tuple(r) for r in o.merge_runs(df, ["c"], "s", "e", touch, gap).collect())
    want = []
    for c in "ab":
        run = None
        for _, s, e, _ in sorted(r for r in rows if r[0] == c):
            if run and (s - run[1] <= gap if touch else s - run[1] < gap):
                run[1] = max(run[1], e)
            else:
                run = [s, e]
                want.append((c, run))
    assert got == sorted((c, *r) for c, r in want)


def test_coverage(spark):
    rows = spans() + [("a", 5, 5, 99)]
    got = o.coverage(spark.createDataFrame(rows, "c string, s long, e long, i int"), ["c"], "s", "e").collect()
    depth = {("a", x): 0 for x in range(400)} | {("b", x): 0 for x in range(400)}
    for c, s, e, _ in rows:
        for x in range(s, e):
            depth[c, x] += 1
    seen = {(r["c"], x): r["depth"] for r in got for x in range(r["start"], r["end"])}
    assert seen == {k: v for k, v in depth.items() if v}


def test_signal_blocks(spark):
    rows = [("c", 0, 5, 1.0), ("c", 5, 8, 3.0), ("c", 8, 9, 3.0), ("c", 9, 12, 2.0), ("c", 12, 13, 3.0), ("c", 20, 22, 7.0)]
    got = sorted(tuple(r) for r in o.signal_blocks(spark.createDataFrame(rows, "chrom string, start long, end long, score double"), ["chrom"]).collect())
    assert got == [("c", 0, 13, 5 + 9 + 3 + 6 + 3, 3.0, 5, 9), ("c", 20, 22, 14.0, 7.0, 20, 22)]


def test_small_order_functions(spark):
    df = spark.createDataFrame([("k", 1, None, True), ("k", 2, "x", False), ("j", 3, None, False)], "k string, at int, v string, f boolean")
    assert {r["k"]: (r["v"], r["f"]) for r in o.first_values(df, ["k"], [F.col("at")], ["f"]).collect()} == {"k": ("x", True), "j": (None, False)}
    n = spark.range(10).select("id", o.quantile_bin([], [F.col("id")], 4).alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in n] == [3, 2, 3, 2]
    sig = o.signature(spark.createDataFrame([("a", 1.0), ("A", 2.0), ("b", float("inf")), ("c", None), ("d", -3.0)], "gene string, score double")).collect()
    assert sorted((r["gene"], r["rank"]) for r in sig) == [("A", 1), ("D", 2)]


OPS = {"half_open": (dict(closed=False), lambda a, b: b[1] < a[2] and b[2] > a[1]), "closed": (dict(closed=True), lambda a, b: b[1] <= a[2] and b[2] >= a[1]), "slack": (dict(closed=True, slack=9), lambda a, b: b[1] <= a[2] + 9 and b[2] >= a[1] - 9)}


@pytest.mark.parametrize("width", [3, 50, 10_000])
@pytest.mark.parametrize("kind", OPS)
def test_overlap_join_is_exact(spark, kind, width):
    more, meets = OPS[kind]
    a, b = spans(50, 1), spans(50, 2, 90) + [("a", 10, 10, 77)]
    x, y = (spark.createDataFrame(r, "chrom string, start long, end long, i int") for r in (a, b))
    want = sorted((p[3], q[3]) for p, q in itertools.product(a, b) if p[0] == q[0] and meets(p, q))
    got = iv.overlap_join(x, y, width=width, **more)
    assert sorted((r["i"], r["b_i"]) for r in got.collect()) == want
    hit = {p for p, _ in want}
    for how, keep in (("left_semi", lambda i: i in hit), ("left_anti", lambda i: i not in hit)):
        assert sorted(r["i"] for r in iv.overlap_join(x, y, width=width, how=how, **more).collect()) == sorted(p[3] for p in a if keep(p[3]))
    left = iv.overlap_join(x, y, width=width, how="left", **more).collect()
    assert sorted((r["i"], r["b_i"] if r["b_i"] is not None else -1) for r in left) == sorted(want + [(p[3], -1) for p in a if p[3] not in hit])


def test_nearest_and_as_of(spark):
    rng = random.Random(4)
    q = [("c", rng.randint(0, 100), i) for i in range(40)] + [("d", 5, 99)]
    p = [("c", rng.randint(0, 100), f"n{i}") for i in range(9)]
    x, y = spark.createDataFrame(q, "chrom string, at long, i int"), spark.createDataFrame(p, "chrom string, point long, name string")
    got = {r["i"]: (r["p_point"], r["p_name"]) for r in iv.nearest_point(x, y).collect()}
    for _, at, i in q[:-1]:
        best = min(p, key=lambda r: (abs(r[1] - at), r[1], r[2]))
        assert got[i] == (best[1], best[2])
    assert got[99] == (None, None)
    prev = {r["i"]: r["r_point"] for r in iv.as_of(x, y.dropDuplicates(["chrom", "point"]), ["chrom"], "at", "point").collect()}
    for _, at, i in q[:-1]:
        assert prev[i] == max((r[1] for r in p if r[1] <= at), default=None)


def test_points_sets_and_consensus(spark):
    ivs = spark.createDataFrame([("c", 0, 10, "x"), ("c", 20, 30, "y")], "chrom string, start long, end long, name string")
    pts = spark.createDataFrame([("c", x) for x in (0, 10, 11, 25, 40)], "chrom string, at long")
    assert [(r["at"], r["r_name"]) for r in iv.contains_point(pts, ivs).orderBy("at").collect()] == [(0, "x"), (10, "x"), (11, None), (25, "y"), (40, None)]
    reps = spark.createDataFrame([("c", 0, 10, "1"), ("c", 5, 15, "2"), ("c", 15, 20, "1"), ("c", 40, 50, "2"), ("c", 40, 50, "2")], "chrom string, start long, end long, replicate string")
    assert [tuple(r) for r in iv.consensus(reps).collect()] == [("c", 0, 15, 2, 1.0)]
    assert [tuple(r)[1:4] for r in iv.consensus(reps, touch=True).collect()] == [(0, 20, 2)]
    s = iv.set_overlap(ivs, reps.select("chrom", "start", "end")).first()
    assert (s["a_hit"], s["b_hit"]) == (2, 3)
    mapped = iv.union_map(reps).select("start", "u_start", "u_end").distinct().orderBy("start").collect()
    assert [tuple(r) for r in mapped] == [(0, 0, 15), (5, 0, 15), (15, 15, 20), (40, 40, 50)]


def test_annotation(spark):
    genes = spark.createDataFrame([("g1", "c", 1000, "+", 1000, 5000, [(1000, 1200), (4000, 5000)]), ("g2", "c", 20000, "-", 15000, 20000, [(15000, 20000)])], "gene string, chrom string, tss long, strand string, start long, end long, exons array<struct<start:long,end:long>>")
    peaks = spark.createDataFrame([("p", "c", 900, 950), ("e", "c", 4100, 4200), ("i", "c", 2500, 2600), ("n", "c", 9000, 9100), ("r", "c", 21000, 21500), ("z", "d", 1, 2)], "name string, chrom string, start long, end long")
    got = {r["name"]: (r["feature"], r["gene"]) for r in iv.annotate_intervals(peaks, genes).collect()}
    assert got == {"p": ("promoter", "g1"), "e": ("exonic", "g1"), "i": ("intronic", "g1"), "n": ("intergenic", "g1"), "r": ("promoter", "g2"), "z": ("intergenic", None)}
    loops = spark.createDataFrame([("c", 0, 100, "c", 19000, 19500), ("c", 8000, 8100, "c", 11000, 11500)], "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long")
    assert sorted(r["loop_class"] for r in iv.annotate_anchors(loops, genes).collect()) == ["distal_distal", "promoter_promoter"]


def test_enrichment_walk(spark):
    rng = np.random.default_rng(0)
    w = rng.random(50)
    sets = {"t1": set(rng.choice(50, 12, False)), "t2": {0, 1, 2}}
    ranked = spark.createDataFrame([(int(g), i + 1, float(w[g])) for i, g in enumerate(range(50))], "gene int, rank int, weight double")
    members = spark.createDataFrame([(t, int(g)) for t, gs in sets.items() for g in gs], "term string, gene int")
    got = {r["term"]: r["enrichment"] for r in o.running_enrichment(ranked, members).collect()}
    for t, gs in sets.items():
        total = sum(w[g] for g in gs)
        steps = np.cumsum([w[g] / total if g in gs else -1 / (50 - len(gs)) for g in range(50)])
        assert got[t] == pytest.approx(steps[np.abs(steps).argmax()])


@pytest.fixture(params=[1, 7, 1 << 20])
def stretch(request, monkeypatch):
    monkeypatch.setattr(o, "STRETCH", request.param)


def test_stretches_of_a_contig_give_what_the_whole_gives(spark, stretch):
    """Runs, depth, as-of and nearest points against loops over the whole contig, whatever the length of its stretches."""
    rng = np.random.default_rng(12)
    rows = [(None if rng.random() < 0.1 else "c", int(a), int(a + rng.integers(1, 30)), i) for i, a in enumerate(rng.integers(0, 400, 60))]
    df = spark.createDataFrame(rows, "c string, s long, e long, i int")
    want_runs, want_depth = [], []
    for c in ("c", None):
        mine = sorted((s, e) for k, s, e, _ in rows if k == c)
        merged = []
        for s, e in mine:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want_runs += [(c, *m) for m in merged]
        edges = sorted({x for m in mine for x in m})
        want_depth += [(c, a, b, d) for a, b in zip(edges, edges[1:]) if (d := sum(s <= a < e for s, e in mine))]
    assert sorted(map(tuple, o.merge_runs(df, ["c"], "s", "e", touch=False).collect()), key=repr) == sorted(want_runs, key=repr)
    assert sorted(map(tuple, o.coverage(df, ["c"], "s", "e").collect()), key=repr) == sorted(want_depth, key=repr)
    points = sorted({(c, int(p)) for c, p in zip(rng.choice(["c", "d"], 25), rng.integers(0, 400, 25), strict=True)})
    p = spark.createDataFrame([(c, x, f"p{x}") for c, x in points], "chrom string, point long, name string")
    q = spark.createDataFrame([("c", int(x), i) for i, x in enumerate(rng.integers(-50, 450, 40))], "chrom string, at long, i int")
    own = [x for c, x in points if c == "c"]
    near = {r["i"]: r["p_point"] for r in iv.nearest_point(q, p).collect()}
    last = {r["i"]: r["r_point"] for r in iv.as_of(q, p, ["chrom"], "at", "point").collect()}
    before = {r["i"]: r["r_point"] for r in iv.as_of(q, p, ["chrom"], "at", "point", strict=True).collect()}
    for r in q.collect():
        assert near[r["i"]] == min(own, key=lambda x: (abs(x - r["at"]), x))
        assert last[r["i"]] == max((x for x in own if x <= r["at"]), default=None)
        assert before[r["i"]] == max((x for x in own if x < r["at"]), default=None)
