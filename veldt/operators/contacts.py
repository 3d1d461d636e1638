"""Contact matrices (C1 to C10): pixels (chrom, i, j, count) with bin indices i <= j within a contig."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distance_decay(pixels: DataFrame, bins: DataFrame, resolution: int) -> DataFrame:
    """Per distance (in bins): contacts, possible pairs of valid bins (chrom, i), and their ratio."""
    n = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    span = n.select("chrom", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("d")).groupBy("d").agg(F.sum(F.col("n") - F.col("d")).alias("pairs"))
    seen = pixels.groupBy((F.col("j") - F.col("i")).cast("int").alias("d")).agg(F.sum("count").alias("contacts"))
    out = span.join(seen, "d", "left").fillna({"contacts": 0})
    return out.select("d", (F.col("d") * resolution).alias("distance"), "contacts", "pairs", (F.col("contacts") / F.col("pairs")).alias("p"))


def decay_slope(decay: DataFrame, resolution: int, far: int = 2_000_000) -> DataFrame:
    """The slope of log10 p on log10 distance from max(2 bins, 20 kb) to far."""
    ok = decay.where((F.col("distance") >= max(2 * resolution, 20_000)) & (F.col("distance") <= far) & (F.col("p") > 0))
    return ok.agg(F.regr_slope(F.log10("p"), F.log10("distance")).alias("slope"), F.count("*").alias("n"))


def ice_weights(pixels: DataFrame, rounds: int = 50, tol: float = 1e-5, least: float = 0) -> DataFrame:
    """Balancing weights by bin: marginal sums are divided out until they vary by less than tol. A round is one sum over pixels and a join; its result is written
    to the checkpoint folder."""
    spark = pixels.sparkSession
    both = pixels.where("count > 0").select("chrom", "i", "j", F.col("count").cast("double").alias("c")).unionByName(pixels.where("count > 0 and i <> j").select("chrom", F.col("j").alias("i"), F.col("i").alias("j"), F.col("count").cast("double").alias("c")))
    w = both.groupBy("chrom", "i").agg(F.sum("c").alias("s")).where(F.col("s") > least).select("chrom", "i", F.lit(1.0).alias("w"))
    for n in range(rounds):
        s = both.join(w, ["chrom", "i"]).join(w.withColumnsRenamed({"i": "j", "w": "wj"}), ["chrom", "j"]).groupBy("chrom", "i").agg(F.sum(F.col("c") * F.col("w") * F.col("wj")).alias("s"))
        m = s.agg(F.avg("s").alias("m"), F.var_pop("s").alias("v")).first()
        if not m["m"] or m["v"] / m["m"] ** 2 < tol:
            break
        w = w.join(s, ["chrom", "i"]).select("chrom", "i", (F.col("w") / F.sqrt(F.col("s") / m["m"])).alias("w"))
        if spark.sparkContext.getCheckpointDir() and n % 4 == 3:
            w = w.checkpoint()
    return w


def balanced(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    return pixels.join(weights, ["chrom", "i"]).join(weights.withColumnsRenamed({"i": "j", "w": "wj"}), ["chrom", "j"]).withColumn("balanced", F.col("count") * F.col("w") * F.col("wj")).drop("w", "wj")


def smoothed(pixels: DataFrame, h: int) -> DataFrame:
    """Each pixel's mean over the square of h bins around it, absent pixels counting 0 (an equi-join on shifted indices)."""
    shifts = F.explode(F.sequence(F.lit(-h), F.lit(h)))
    spread = pixels.select("chrom", "i", "j", "count", shifts.alias("a")).select("*", shifts.alias("b")).select("chrom", (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j"), "count").where("i >= 0 and j >= i")
    return spread.groupBy("chrom", "i", "j").agg((F.sum("count") / (2 * h + 1) ** 2).alias("count"))


def stratum_correlation(a: DataFrame, b: DataFrame, max_bins: int, h: int = 1) -> DataFrame:
    """One row: the stratum-adjusted correlation of two matrices: per-distance correlations weighted by n times the ranks' variances' root."""
    x, y = (smoothed(d, h).where(F.col("j") - F.col("i") <= max_bins).withColumnRenamed("count", c) for d, c in ((a, "x"), (b, "y")))
    j = x.join(y, ["chrom", "i", "j"], "full").fillna({"x": 0.0, "y": 0.0}).withColumn("d", F.col("j") - F.col("i"))
    s = j.groupBy("d").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), (F.count("*") * F.stddev_pop("x") * F.stddev_pop("y")).alias("w")).where("n > 2 and r is not null and not isnan(r)")
    return s.agg((F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("scc"), F.count("*").alias("strata"))


def insulation(pixels: DataFrame, window: int, value="count") -> DataFrame:
    """log2 of each bin's diamond mean (pixels from the window before to the window after) over the contig's mean, and whether it is a boundary (a local minimum below 0 with
    its whole diamond inside the contig)."""
    near = pixels.where((F.col("j") - F.col("i") <= 2 * window) & (F.col("j") > F.col("i")))
    # pixel (i, j) lies in the diamonds of the bins b with b - window <= i < b <= j < b + window
    at = near.withColumns({"lo": F.greatest(F.col("i") + 1, F.col("j") - window + 1), "hi": F.least(F.col("j"), F.col("i") + window)}).where("lo <= hi").select("chrom", value, F.explode(F.sequence("lo", "hi")).alias("bin"))
    score = at.groupBy("chrom", "bin").agg((F.sum(value) / window**2).alias("mean"))
    score = score.withColumn("score", F.log2(F.col("mean") / F.avg("mean").over(Window.partitionBy("chrom"))))
    w = Window.partitionBy("chrom").orderBy("bin")
    low = (F.col("score") < F.coalesce(F.lag("score").over(w), F.lit(float("inf")))) & (F.col("score") <= F.coalesce(F.lead("score").over(w), F.lit(float("inf"))))
    contig = Window.partitionBy("chrom")
    inside = (F.col("bin") >= F.min("bin").over(contig) - 1 + window) & (F.col("bin") <= F.max("bin").over(contig) - window + 1)
    return score.withColumn("boundary", low & inside & (F.col("score") < 0))


def domains(boundaries: DataFrame) -> DataFrame:
    """Spans between consecutive boundaries (chrom, bin, strength), with the mean of both strengths."""
    w = Window.partitionBy("chrom").orderBy("bin")
    return boundaries.select("chrom", F.col("bin").alias("start"), F.lead("bin").over(w).alias("end"), ((F.col("strength") + F.lead("strength").over(w)) / 2).alias("strength")).where("end is not null")


def observed_expected(pixels: DataFrame, value="count") -> DataFrame:
    """Pixels over the mean of their distance on the contig (of the pixels present)."""
    return pixels.withColumn("oe", F.col(value) / F.avg(value).over(Window.partitionBy("chrom", F.col("j") - F.col("i"))))


def compartments(pixels: DataFrame, phasing: DataFrame, value="count") -> DataFrame:
    """The first eigenvector of each contig's correlation matrix of observed over expected, its sign by a track (chrom, i, gc). A contig is one task: its bins squared must fit there."""
    oe = observed_expected(pixels, value).select("chrom", "i", "j", "oe")

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bins = np.union1d(left["i"], left["j"])
        if len(bins) < 3:
            return pd.DataFrame({"chrom": [], "i": [], "e1": [], "phased": []})
        at = {b: n for n, b in enumerate(bins)}
        m = np.ones((len(bins), len(bins)))
        a, b = left["i"].map(at).to_numpy(), left["j"].map(at).to_numpy()
        m[a, b] = m[b, a] = left["oe"].to_numpy()
        c = np.nan_to_num(np.corrcoef(m))
        e = np.linalg.eigh(c)[1][:, -1]
        gc = right.set_index("i")["gc"].reindex(bins).to_numpy(float) if len(right) else np.full(len(bins), np.nan)
        ok = np.isfinite(gc)
        phased = bool(ok.sum() > 2 and np.std(gc[ok]) > 0 and np.std(e[ok]) > 0)
        if phased and np.corrcoef(e[ok], gc[ok])[0, 1] < 0:
            e = -e
        return pd.DataFrame({"chrom": key[0], "i": bins, "e1": e, "phased": phased})

    kinds = dict(pixels.dtypes)
    return oe.groupBy("chrom").cogroup(phasing.groupBy("chrom")).applyInPandas(one, f"chrom string, i {kinds['i']}, e1 double, phased boolean")


def compartment_switch(a: DataFrame, b: DataFrame, quantitative: float = 0.5) -> DataFrame:
    """Per bin the change from a to b: B_to_A, A_to_B (phased contigs), unphased_sign_flip, quantitative_shift or unchanged."""
    j = a.select("chrom", "i", F.col("e1").alias("x"), F.col("phased").alias("px")).join(b.select("chrom", "i", F.col("e1").alias("y"), F.col("phased").alias("py")), ["chrom", "i"])
    flip, phased = F.signum("x") * F.signum("y") < 0, F.col("px") & F.col("py")
    kind = F.when(flip & phased, F.when(F.col("y") > 0, "B_to_A").otherwise("A_to_B")).when(flip, "unphased_sign_flip").when(F.abs(F.col("y") - F.col("x")) >= quantitative, "quantitative_shift").otherwise("unchanged")
    return j.select("chrom", "i", (F.col("y") - F.col("x")).alias("delta"), kind.alias("switch"))


def loops(pixels: DataFrame, inner: int = 1, outer: int = 4, fdr: float = 0.1, least: int = 5, value="count") -> DataFrame:
    """Pixels above a Poisson expectation from the ring between inner and outer bins around them (of the pixels present), corrected over all tested."""
    from veldt.functions.order import bh_adjust

    shifts = [(a, b) for a in range(-outer, outer + 1) for b in range(-outer, outer + 1) if max(abs(a), abs(b)) > inner]
    ring = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in shifts)))
    around = pixels.select("chrom", "i", "j", value, ring.alias("s")).select("chrom", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), value).groupBy("chrom", "i", "j").agg((F.sum(value) / len(shifts)).alias("expected"))
    t = pixels.where((F.col(value) >= least) & (F.col("j") - F.col("i") > outer)).join(around, ["chrom", "i", "j"], "left").fillna({"expected": 0.0}).withColumn("expected", F.greatest("expected", F.lit(0.5)))

    @F.pandas_udf("double")
    def tail(k: pd.Series, m: pd.Series) -> pd.Series:
        from math import exp, lgamma, log

        out = []
        for a, b in zip(k, m, strict=True):
            a = int(a)
            if a <= b:
                out.append(1.0)
                continue
            x, s, i = exp(a * log(b) - b - lgamma(a + 1)), 0.0, a
            while x > 0 and (s == 0 or x > s * 1e-16):
                s += x
                i += 1
                x *= b / i
            out.append(min(1.0, s))
        return pd.Series(out)

    return bh_adjust(t.withColumn("p", tail(F.col(value), F.col("expected"))), "p", "padj").where(F.col("padj") <= fdr)


def differential_bins(table: DataFrame, groups: DataFrame, a: str, b: str, alpha: float = 0.05, least: float = 0.0) -> DataFrame:
    """Moderated contrast of per-bin scores (feature, sample, value): padj <= alpha and |effect| >= least."""
    from veldt.functions.order import bh_adjust
    from veldt.operators.models import moderated

    out = bh_adjust(moderated(table.join(groups, "sample"), "group", a, b, floor=1e-6), "p", "padj")
    return out.withColumn("significant", F.coalesce((F.col("padj") <= alpha) & (F.abs("effect") >= least), F.lit(False)))
