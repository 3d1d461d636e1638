"""Tests and models per feature (M1 to M33). Long tables of feature, unit, value; moments are aggregated in Spark, tails come from a column UDF."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.order import bh_adjust, global_running
from veldt.functions.special import fisher_p, normal_p, t_p

MODERATION_DF = 4.0
MODERATED_FROM = 20


def moments(df: DataFrame, group: str, a: str, b: str, value="value", keys=("feature",)) -> DataFrame:
    """n, mean and sample variance of both arms by feature; values that are missing do not count."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    agg = []
    for i, g in ((1, a), (2, b)):
        v = F.when(F.col(group) == g, F.col(value))
        agg += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
    return rows.groupBy(*keys).agg(*agg)


def welch(df: DataFrame, group: str, a: str, b: str, value="value", keys=("feature",)) -> DataFrame:
    """Welch's t per feature: effect (a - b), t, df, p; null with fewer than two values an arm or without variance."""
    m = moments(df, group, a, b, value, keys)
    x, y = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (x + y > 0)
    m = m.withColumns({"effect": F.col("m1") - F.col("m2"), "t": F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(x + y)), "df": F.when(ok, (x + y) * (x + y) / (x * x / (F.col("n1") - 1) + y * y / (F.col("n2") - 1)))})
    return m.withColumn("p", t_p("t", "df"))


def paired(df: DataFrame, group: str, a: str, b: str, unit="unit", value="value", keys=("feature",)) -> DataFrame:
    """Paired t per feature over units with both arms."""
    wide = df.where(F.col(group).isin(a, b)).groupBy(*keys, unit).agg(F.avg(F.when(F.col(group) == a, F.col(value))).alias("x"), F.avg(F.when(F.col(group) == b, F.col(value))).alias("y")).where("x is not null and y is not null")
    d = wide.withColumn("d", F.col("x") - F.col("y")).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("effect"), F.stddev_samp("d").alias("sd"))
    ok = (F.col("n") > 1) & (F.col("sd") > 0)
    return d.withColumns({"t": F.when(ok, F.col("effect") / (F.col("sd") / F.sqrt("n"))), "df": F.when(ok, (F.col("n") - 1).cast("double"))}).withColumn("p", t_p("t", "df"))


def moderated(df: DataFrame, group: str, a: str, b: str, value="value", scope=(), floor: float = 1e-4, least_arm: int = 2, d0: float = MODERATION_DF) -> DataFrame:
    """Empirical-Bayes t per feature: pooled variances drawn to s0^2 (the median of the positive ones of the scope) with d0 prior degrees of freedom.
    With fewer than 20 features in the scope it is Welch's t."""
    keys = [*scope, "feature"]
    m = moments(df, group, a, b, value, keys).where((F.col("n1") >= least_arm) & (F.col("n2") >= least_arm))
    d = F.col("n1") + F.col("n2") - 2
    m = m.withColumn("s2", ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / d)
    prior = m.groupBy(*scope).agg(F.coalesce(F.median(F.when(F.col("s2") > 1e-12, F.col("s2"))), F.lit(floor)).alias("s0"), F.count("*").alias("features"))
    m = m.join(F.broadcast(prior), list(scope)) if scope else m.crossJoin(F.broadcast(prior))
    post = (d0 * F.col("s0") + d * F.col("s2")) / (d0 + d)
    se_m = F.sqrt(post * (1 / F.col("n1") + 1 / F.col("n2")))
    x, y = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    big = F.col("features") >= MODERATED_FROM
    dw = (x + y) * (x + y) / (x * x / (F.col("n1") - 1) + y * y / (F.col("n2") - 1))
    effect = F.col("m1") - F.col("m2")
    out = m.withColumns({"effect": effect, "t": F.when(big, effect / se_m).otherwise(F.when(x + y > 0, effect / F.sqrt(x + y))), "df": F.when(big, d0 + d).otherwise(F.when(x + y > 0, dw))})
    return out.withColumn("p", t_p("t", "df"))


def leave_one_out(df: DataFrame, group: str, a: str, b: str, unit="unit", value="value", alpha: float = 0.05) -> DataFrame:
    """The moderated contrast with each unit left out in turn, corrected over all features of a fold, against the whole: effect, padj, sign share, IQR of the effects, the most
    influential unit and the verdict stable. Every row is copied once per other unit: units are the few replicates of a design."""
    units = df.where(F.col(group).isin(a, b)).select(F.col(unit).alias("dropped")).distinct()
    whole = bh_adjust(moderated(df, group, a, b, value), "p", "padj").select("feature", "effect", "padj")
    folds = df.crossJoin(F.broadcast(units)).where(F.col(unit) != F.col("dropped"))
    each = bh_adjust(moderated(folds, group, a, b, value, ["dropped"]), "p", "fold_padj", ["dropped"]).select("feature", "dropped", F.col("effect").alias("e"), "fold_padj")
    rows = each.join(whole, "feature")
    n = units.agg(F.count("*").alias("units"))
    out = rows.groupBy("feature").agg(
        F.first("effect").alias("effect"), F.first("padj").alias("padj"), F.count("e").alias("folds"),
        F.avg((F.signum("e") == F.signum("effect")).cast("double")).alias("sign_share"),
        (F.percentile("e", 0.75) - F.percentile("e", 0.25)).alias("iqr"), F.min(F.abs("e")).alias("least"),
        F.max("fold_padj").alias("worst_padj"), F.max_by("dropped", F.struct(F.abs(F.col("e") - F.col("effect")), F.col("dropped"))).alias("most_influential"),
    ).crossJoin(F.broadcast(n))
    weak = (F.abs("effect") > 0.25) & (F.col("least") < 0.35 * F.abs("effect"))
    lost = (F.col("padj") < alpha) & F.coalesce(F.col("worst_padj") >= alpha, F.lit(True))
    return out.withColumn("stable", (F.col("folds") == F.col("units")) & (F.col("sign_share") == 1) & ~weak & ~lost)


def size_factors(counts: DataFrame, unit="unit") -> DataFrame:
    """Median of ratios to the features' geometric means, over features positive in every unit; all 1 if there are none."""
    n = counts.agg(F.count_distinct(unit).alias("units"))
    logs = counts.where("value > 0").withColumn("l", F.log("value"))
    means = logs.groupBy("feature").agg(F.avg("l").alias("g"), F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = units").select("feature", "g")
    f = logs.join(means, "feature").groupBy(unit).agg(F.exp(F.median(F.col("l") - F.col("g"))).alias("size_factor"))
    return counts.select(unit).distinct().join(f, unit, "left").fillna({"size_factor": 1.0})


def spike_in_factors(samples: DataFrame, unit="unit", exposure="exposure") -> DataFrame:
    """Exposures summed in units, over their geometric mean; a missing or non-positive one is an error."""
    if samples.where(F.col(exposure).isNull() | ~(F.col(exposure) > 0) | F.isnan(F.col(exposure).cast("double"))).limit(1).count():
        raise ValueError("an exposure is missing or not positive")
    s = samples.groupBy(unit).agg(F.sum(exposure).alias("x"))
    return s.crossJoin(F.broadcast(s.agg(F.exp(F.avg(F.log("x"))).alias("g")))).select(unit, (F.col("x") / F.col("g")).alias("size_factor"))


def log_normalised(counts: DataFrame, factors: DataFrame, unit="unit") -> DataFrame:
    return counts.join(factors, unit).withColumn("value", F.log2(F.col("value") / F.col("size_factor") + 1))


def differential(counts: DataFrame, units: DataFrame, group: str, a: str, b: str, unit="unit", alpha: float = 0.05) -> DataFrame:
    """Median-of-ratios factors, log2, moderated contrast, correction. This is a moderated log-linear test, not a negative-binomial fit."""
    norm = log_normalised(counts, size_factors(counts, unit), unit).join(units.select(unit, group), unit)
    out = bh_adjust(moderated(norm, group, a, b), "p", "padj")
    return out.select("feature", F.col("effect").alias("log2fc"), "t", "df", "p", "padj", F.coalesce(F.col("padj") < alpha, F.lit(False)).alias("significant"))


def negative_binomial(counts: DataFrame, units: DataFrame, group: str, a: str, b: str, unit="unit", rounds: int = 50) -> DataFrame:
    """A log-linear negative-binomial fit per feature (moment dispersion, then IRLS), with a Wald test of a against b: log2fc, se, p, padj, converged. Rows of a
    feature are few (one a unit), and features are fitted by batches of groups."""
    factors = size_factors(counts, unit)
    rows = counts.join(factors, unit).join(units.where(F.col(group).isin(a, b)).select(unit, F.col(group).alias("g")), unit).select("feature", "value", "size_factor", (F.col("g") == a).cast("double").alias("x"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, s, x = (pdf[c].to_numpy(float) for c in ("value", "size_factor", "x"))
        out = {"feature": pdf["feature"].iloc[0], "log2fc": None, "se": None, "z": None, "converged": False}
        if len(set(x)) < 2 or y.sum() == 0:
            return pd.DataFrame([out])
        design = np.column_stack([np.ones(len(y)), x])
        q = y / s
        inside = np.concatenate([q[x == v] - q[x == v].mean() for v in (0, 1)])
        m, v = max(q.mean(), 1e-8), (inside**2).sum() / max(len(y) - 2, 1)
        alpha_ = max((v - m * np.mean(1 / s)) / m**2, 1e-8)
        beta = np.array([np.log(m), 0.0])
        for _ in range(rounds):
            mu = np.maximum(s * np.exp(design @ beta), 1e-8)
            w = mu / (1 + alpha_ * mu)
            info = design.T @ (design * w[:, None]) + 1e-8 * np.eye(2)
            step = np.linalg.solve(info, design.T @ (w * (y - mu) / mu))
            beta = beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                out["converged"] = True
                break
        se = math.sqrt(np.linalg.inv(info)[1, 1])
        out |= {"log2fc": beta[1] / math.log(2), "se": se / math.log(2), "z": beta[1] / se}
        return pd.DataFrame([out])

    got = rows.groupBy("feature").applyInPandas(fit, f"feature {dict(counts.dtypes)['feature']}, log2fc double, se double, z double, converged boolean")
    return bh_adjust(got.withColumn("p", normal_p("z")), "p", "padj")


def ols(df: DataFrame, design: pd.DataFrame, test: str, unit="unit", value="value") -> DataFrame:
    """One design (rows: units, columns: numeric terms) for all features: the coefficient of the term test, t, df, p. The contraction with (X'X)^-1 X' is two
    sums per feature; features that lack a unit are left out."""
    x = design.to_numpy(float)
    n, rank = len(x), np.linalg.matrix_rank(x)
    if rank < x.shape[1] or n <= rank:
        raise ValueError("the design is rank deficient or has no residual degrees of freedom")
    names = list(design.columns)
    inv = np.linalg.inv(x.T @ x)
    pinv = inv @ x.T
    rows = [(u, [float(c) for c in pinv[:, i]], [float(c) for c in x[i]]) for i, u in enumerate(design.index)]
    spark = df.sparkSession
    table = spark.createDataFrame(rows, f"{unit} {dict(df.dtypes)[unit]}, w array<double>, x array<double>")
    joined = df.join(F.broadcast(table), unit)
    k = len(names)
    beta = joined.groupBy("feature").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("w")[i] * F.col(value)) for i in range(k))).alias("beta"), F.sum(F.col(value) * F.col(value)).alias("yy"), F.array(*(F.sum(F.col("x")[i] * F.col(value)) for i in range(k))).alias("xy")).where(F.col("n") == n)
    fitted = F.aggregate(F.zip_with("beta", "xy", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    j = names.index(test)
    s2 = F.greatest(F.col("yy") - fitted, F.lit(0.0)) / (n - rank)
    out = beta.select("feature", F.col("beta")[j].alias("effect"), F.sqrt(s2 * float(inv[j, j])).alias("se"), F.lit(float(n - rank)).alias("df"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("effect") / F.col("se"))).withColumn("p", t_p("t", "df"))


def ols_hc3(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Simple regression of y on x by key with HC3 standard errors: slope, se, t, p. Leverages come from sums over the key."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__n": F.count("*").over(w), "__mx": F.avg(x).over(w), "__my": F.avg(y).over(w)})
    rows = rows.withColumns({"__dx": F.col(x) - F.col("__mx"), "__dy": F.col(y) - F.col("__my")})
    rows = rows.withColumn("__sxx", F.sum(F.col("__dx") * F.col("__dx")).over(w)).where("__sxx > 0").withColumn("__b", F.sum(F.col("__dx") * F.col("__dy")).over(w) / F.col("__sxx"))
    h = 1 / F.col("__n") + F.col("__dx") * F.col("__dx") / F.col("__sxx")
    e = F.col("__dy") - F.col("__b") * F.col("__dx")
    term = F.col("__dx") * e / F.greatest(1 - h, F.lit(1e-12))
    out = rows.groupBy(*keys).agg(F.max("__n").alias("n"), F.max("__b").alias("slope"), (F.sqrt(F.sum(term * term)) / F.max("__sxx")).alias("se"))
    return out.withColumns({"t": F.when(F.col("se") > 0, F.col("slope") / F.col("se")), "df": (F.col("n") - 2).cast("double")}).withColumn("p", t_p("t", "df"))


def abundance(cells: DataFrame, sample: str, kind: str, condition: str, test: str, ref: str) -> DataFrame:
    """Kinds' log-ratio abundance between conditions: regression of CLR on the condition with HC3 errors, log2fc of mean shares. Where the regression gives no p, p is
    Fisher's on cells, a diagnostic (model "fisher", no slope); padj corrects over the regressions alone."""
    from veldt.functions.scalars import clr
    from veldt.operators.counts import contingency_long

    arms = cells.groupBy(sample).agg(F.min(condition).alias("g")).where(F.col("g").isin(test, ref))
    if arms.groupBy("g").agg(F.count("*").alias("k")).agg(F.min("k").alias("least"), F.count("*").alias("arms")).where("least < 2 or arms < 2").count():
        raise ValueError("two samples an arm are needed")
    n = contingency_long(cells.join(arms.select(sample), sample, "left_semi"), sample, kind).withColumnRenamed("n", "value")
    rows = clr(n, sample).join(arms, sample).withColumn("x", (F.col("g") == test).cast("double"))
    rows = rows.withColumn("total", F.sum("value").over(Window.partitionBy(sample)))
    in_arm = {"test": F.col("x") == 1, "ref": F.col("x") == 0}
    sums = [F.sum(F.when(arm, F.col(c))).alias(f"{name}_{k}") for k, arm in in_arm.items() for name, c in (("n", "value"), ("all", "total"))]
    shares = [F.avg(F.when(arm, F.col("value") / F.col("total"))).alias(f"share_{k}") for k, arm in in_arm.items()]
    out = rows.groupBy(kind).agg(*sums, *shares).withColumn("log2fc", F.log2((F.col("share_test") + 1e-9) / (F.col("share_ref") + 1e-9)))
    out = out.join(ols_hc3(rows, [kind], "x", "clr"), kind, "left")
    donor = F.col("p").isNotNull() & ~F.isnan("p")
    exact = fisher_p("n_test", F.col("all_test") - F.col("n_test"), "n_ref", F.col("all_ref") - F.col("n_ref"))
    out = out.withColumns({"fdr_included": donor, "q": F.when(donor, F.col("p")), "model": F.when(donor, F.lit("clr_hc3")).otherwise(F.lit("fisher")), "slope": F.when(donor, F.col("slope"))})
    out = bh_adjust(out, "q", "padj").withColumn("p", F.coalesce("q", exact)).drop("q", "all_test", "all_ref")
    return out.orderBy(F.col("padj").asc_nulls_last(), kind)


def rank_sum_markers(df: DataFrame, group="group", value="value") -> DataFrame:
    """Wilcoxon z and p of each group against the rest by feature, ties corrected."""
    f = Window.partitionBy("feature")
    ranked = df.withColumns({"r": F.rank().over(f.orderBy(value)) + (F.count("*").over(Window.partitionBy("feature", value)) - 1) / 2, "n": F.count("*").over(f)})
    ties = df.groupBy("feature", value).agg(F.count("*").cast("double").alias("t")).groupBy("feature").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = ranked.groupBy("feature", group).agg(F.sum("r").alias("rs"), F.count("*").cast("double").alias("k"), F.max("n").cast("double").alias("n"), F.avg(value).alias("mean")).join(ties, "feature")
    mean, var = F.col("k") * (F.col("n") + 1) / 2, F.col("k") * (F.col("n") - F.col("k")) / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    z = F.when((F.col("k") < F.col("n")) & (F.col("n") > 1), F.when(var > 0, (F.col("rs") - mean) / F.sqrt(var)).otherwise(0.0))
    return bh_adjust(g.withColumn("z", z).withColumn("p", normal_p("z")), "p", "padj", [group])


def collinear(df: DataFrame, x: str, indicator: str, most: float = 0.9) -> bool:
    """Whether a covariate follows the condition too closely to be in one model with it."""
    r = df.agg(F.corr(x, indicator).alias("r")).first()["r"]
    return r is not None and not math.isnan(r) and abs(r) > most


def power(n: int, mean: float, dispersion: float, log2fc: float, alpha: float = 0.05) -> float:
    """Two-sided Wald power of a count contrast with n units an arm."""
    se = math.sqrt(2 / n * (1 / mean + dispersion)) / math.log(2)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return NormalDist().cdf(abs(log2fc) / se - z) + NormalDist().cdf(-abs(log2fc) / se - z)


def detectable(n: int, mean: float, dispersion: float, alpha: float = 0.05, wanted: float = 0.8) -> float:
    """The least |log2fc| with the wanted power."""
    se = math.sqrt(2 / n * (1 / mean + dispersion)) / math.log(2)
    return (NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(wanted)) * se


def pair_correlations(pairs: DataFrame, a: DataFrame, b: DataFrame, sample="sample") -> DataFrame:
    """r over samples of each pair (a, b) of features; n and both values needed."""
    x, y = a.select(F.col("feature").alias("a"), sample, F.col("value").alias("x")), b.select(F.col("feature").alias("b"), sample, F.col("value").alias("y"))
    return pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", sample]).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def linked_features(links: DataFrame, a: DataFrame, b: DataFrame, background: DataFrame, sample="sample", min_r: float = 0.1, max_padj: float = 0.05) -> DataFrame:
    """Correlations of cis pairs (a, b, stratum of b) against the mean and deviation of a's correlations with background features (stratum, b): z, p, padj over all
    tested pairs, cutoffs after that."""
    r = pair_correlations(links, a, b, sample).join(links.select("a", "b", "stratum").distinct(), ["a", "b"])
    null = links.select("a", "stratum").distinct().join(background, "stratum")
    nr = pair_correlations(null, a, b, sample).join(null, ["a", "b"]).groupBy("a", "stratum").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    z = r.join(nr, ["a", "stratum"], "left").withColumn("z", F.when(F.col("s") > 0, (F.col("r") - F.col("m")) / F.col("s")))
    out = bh_adjust(z.withColumn("p", normal_p("z")), "p", "padj")
    return out.where((F.abs("r") >= min_r) & (F.col("padj") <= max_padj))


def permutation_p(observed: DataFrame, null: DataFrame, r="r") -> DataFrame:
    """(# pooled null |r| at or above |r| + 1) / (N + 1), by ranges over the distinct values; observed keeps its columns."""
    o = observed.select(*observed.columns, F.round(F.abs(r), 12).alias("__v"))
    both = o.groupBy("__v").agg(F.lit(0).alias("__k")).unionByName(null.groupBy(F.round(F.abs(r), 12).alias("__v")).agg(F.count("*").cast("int").alias("__k")))
    counts = both.groupBy("__v").agg(F.sum("__k").alias("__k"))
    above = global_running(counts, "__v", "__k", "__above", descending=True).select("__v", "__above")
    n = null.agg(F.count("*").alias("__n"))
    return o.join(above, "__v").crossJoin(F.broadcast(n)).withColumn("p", (F.col("__above") + 1) / (F.col("__n") + 1)).select(*observed.columns, "p")


def matched_correlation(pairs: DataFrame, a: DataFrame, b: DataFrame, permutations: list[dict], sample="sample") -> DataFrame:
    """Correlations over matched samples with a null pooled over permutations of a's samples (identity refused). log2(x + 1); features without variance go."""
    if any(all(k == v for k, v in m.items()) for m in permutations):
        raise ValueError("the identity is no permutation")
    log = lambda d: d.where(F.col("value").isNotNull() & (F.col("value") >= 0)).withColumn("value", F.log2(F.col("value") + 1))
    vary = lambda d: d.join(d.groupBy("feature").agg(F.var_samp("value").alias("v")).where("v > 0").select("feature"), "feature", "left_semi")
    a, b = vary(log(a)), vary(log(b))
    seen = pair_correlations(pairs, a, b, sample)
    moves = a.sparkSession.createDataFrame([(i, k, v) for i, m in enumerate(permutations) for k, v in m.items()], "draw int, from string, to string")
    x = a.join(moves, F.col(sample) == F.col("from")).select(F.col("feature").alias("a"), "draw", F.col("to").alias(sample), F.col("value").alias("x"))
    y = b.select(F.col("feature").alias("b"), sample, F.col("value").alias("y"))
    null = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", sample]).groupBy("a", "b", "draw").agg(F.corr("x", "y").alias("r")).where("r is not null")
    return bh_adjust(permutation_p(seen.where("r is not null"), null), "p", "padj")


def stratified_enrichment(hits: DataFrame, foreground: DataFrame, keys=("motif",)) -> DataFrame:
    """Cochran-Mantel-Haenszel of hit (motif, item) against foreground (item, stratum, foreground) over strata: z, p, common odds ratio."""
    size = foreground.groupBy("stratum").agg(F.count("*").cast("double").alias("n"), F.count_if("foreground").cast("double").alias("f"))
    t = hits.select(*keys, "item").distinct().join(foreground, "item").groupBy(*keys, "stratum").agg(F.count_if("foreground").cast("double").alias("a"), F.count("*").cast("double").alias("h")).join(F.broadcast(size), "stratum").where("n > 1")
    a, h, f, n = (F.col(c) for c in ("a", "h", "f", "n"))
    out = t.groupBy(*keys).agg(F.sum(a - h * f / n).alias("d"), F.sum(h * f * (n - h) * (n - f) / (n * n * (n - 1))).alias("v"), F.sum(a * (n - h - f + a) / n).alias("ad"), F.sum((h - a) * (f - a) / n).alias("bc"))
    return out.select(*keys, F.when(F.col("v") > 0, F.col("d") / F.sqrt("v")).alias("z"), F.when(F.col("bc") > 0, F.col("ad") / F.col("bc")).alias("odds_ratio")).withColumn("p", normal_p("z"))


def ranked_motifs(motifs: DataFrame, padj_max: float = 0.05, top: int = 25) -> DataFrame:
    """Finite positive enrichments by (padj, pvalue, -enrichment), missing p as 1; ranked within the top."""
    ok = F.col("log2_enrichment").isNotNull() & ~F.isnan("log2_enrichment") & (F.col("log2_enrichment") > 0) & (F.col("log2_enrichment") < float("inf"))
    rows = motifs.where(ok & (F.coalesce("padj", F.lit(1.0)) < padj_max))
    return rows.orderBy(F.coalesce("padj", F.lit(1.0)), F.coalesce("pvalue", F.lit(1.0)), F.desc("log2_enrichment"), "motif").limit(top)


def copula_idr(pairs: DataFrame, keys=("pair",), rounds: int = 100, tol: float = 1e-6, least: int = 20) -> DataFrame:
    """A two-component Gaussian copula on the ranks of score1 and score2 by EM, per pair of replicates (one task each): local and global irreproducible
    discovery rates. Pairs with fewer than least peaks give no rows."""
    inv = np.vectorize(NormalDist().inv_cdf)

    def ranks(x):
        return pd.Series(x).rank(method="average").to_numpy() / (len(x) + 1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pdf.assign(local_idr=np.nan, global_idr=np.nan).iloc[:0]
        z = np.column_stack([inv(ranks(pdf[c])) for c in ("score1", "score2")])
        mu, sd, rho, share, last = 1.0, 1.0, 0.8, 0.5, -math.inf
        for _ in range(rounds):
            d = (z - mu) / sd
            q = (d[:, 0] ** 2 - 2 * rho * d[:, 0] * d[:, 1] + d[:, 1] ** 2) / (1 - rho**2)
            one = share * np.exp(-q / 2) / (sd**2 * math.sqrt(1 - rho**2))
            zero = (1 - share) * np.exp(-(z**2).sum(1) / 2)
            r = one / np.maximum(one + zero, 1e-300)
            share = float(np.clip(r.mean(), 0.01, 0.99))
            w = r.sum()
            mu = float((r[:, None] * z).sum() / (2 * w))
            var = float((r[:, None] * (z - mu) ** 2).sum() / (2 * w))
            sd = math.sqrt(max(var, 1e-4))
            rho = float(np.clip((r * (z[:, 0] - mu) * (z[:, 1] - mu)).sum() / (w * max(var, 1e-4)), -0.99, 0.99))
            ll = float(np.log(np.maximum(one + zero, 1e-300)).sum())
            if abs(ll - last) < tol * max(1, abs(ll)):
                break
            last = ll
        local = 1 - r
        order = np.lexsort((-z.mean(1), local))
        total = np.empty(len(local))
        total[order] = np.cumsum(local[order]) / np.arange(1, len(local) + 1)
        return pdf.assign(local_idr=local, global_idr=total)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.groupBy(*keys).applyInPandas(fit, f"{schema}, local_idr double, global_idr double")


def signal_threshold(blocks: DataFrame, control: DataFrame, auc="auc", grid: int = 2000) -> tuple[float, float]:
    """(relaxed, stringent) thresholds on block signal from the empirical curves of target and control, over a bounded grid of the target's quantiles: relaxed has the
    greatest excess of target over control signal, stringent the greatest excess weighted by precision and control survival, at or above it."""
    qs = sorted(set(blocks.agg(F.percentile_approx(auc, [i / grid for i in range(grid + 1)], 100_000).alias("q")).first()["q"] or []))
    if not qs:
        return math.nan, math.nan
    edges = F.array(*map(F.lit, qs))

    def curve(d: DataFrame):
        at = F.size(F.filter(edges, lambda e: e <= F.col(auc)))
        got = {r["i"]: (r["n"], r["s"]) for r in d.groupBy(at.alias("i")).agg(F.count("*").alias("n"), F.sum(auc).alias("s")).collect()}
        n = np.array([got.get(i, (0, 0))[0] for i in range(len(qs) + 1)], float)
        s = np.array([got.get(i, (0, 0))[1] or 0 for i in range(len(qs) + 1)], float)
        return np.cumsum(n[::-1])[::-1][1:], np.cumsum(s[::-1])[::-1][1:], max(n.sum(), 1), max(s.sum(), 1e-300)

    tn, ts, tall, tsum = curve(blocks)
    cn, cs, call, csum = curve(control)
    excess = ts / tsum - cs / csum
    i = int(np.argmax(excess))
    precise = 0.5 * ts / np.maximum(ts + cs, 1e-300) + 0.5 * tn / np.maximum(tn + cn, 1)
    strict = excess * precise * (1 - cn / call)
    strict[:i] = -math.inf
    return float(qs[i]), float(qs[int(np.argmax(strict))])


def eta_squared(df: DataFrame, value: str, group: str, weight: str | None = None) -> DataFrame:
    """One row: the share of variance between groups, F and its degrees of freedom."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("x"), w.alias("w"))
    g = rows.groupBy("g").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("n"))
    t = g.agg(F.sum("xx").alias("xx"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("m")).alias("wm"), F.sum(F.col("w") * F.col("m") * F.col("m")).alias("b"), F.count("*").alias("k"), F.sum("n").alias("n"))
    base = F.col("wm") * F.col("wm") / F.col("w")
    between, total = F.col("b") - base, F.col("xx") - base
    return t.select(F.when(total > 0, between / total).alias("eta2"), F.when((total > between) & (F.col("k") > 1) & (F.col("n") > F.col("k")), between / (F.col("k") - 1) / ((total - between) / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def calibration_failures(gates: dict[str, tuple[str, float]], metrics: dict[str, float | None]) -> list[str]:
    """Gates {metric: ('min' or 'max', bound)} that fail; a missing metric fails."""
    return [m for m, (kind, x) in gates.items() if metrics.get(m) is None or (metrics[m] < x if kind == "min" else metrics[m] > x)]


def dose_response(df: DataFrame, dose: str, response: str, keys=()) -> DataFrame:
    """Slope, intercept and correlation of log2 response on log2 dose, and whether means by dose never fall."""
    rows = df.where((F.col(dose) > 0) & (F.col(response) > 0)).select(*keys, F.log2(dose).alias("x"), F.log2(response).alias("y"))
    fit = rows.groupBy(*keys).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("r"))
    means = rows.groupBy(*keys, "x").agg(F.avg("y").alias("m"))
    steps = means.withColumn("d", F.col("m") - F.lag("m").over(Window.partitionBy(*keys).orderBy("x"))).groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("d") >= 0, F.lit(True))).alias("monotone"))
    return fit.join(steps, list(keys)) if keys else fit.crossJoin(steps)


def effect_concordance(a: DataFrame, b: DataFrame, key="feature", effect="effect", flag="significant") -> DataFrame:
    """One row: shared features, r and sign agreement of effects, precision and Jaccard of the significant sets."""
    j = a.select(key, F.col(effect).alias("x"), F.col(flag).alias("fx")).join(b.select(key, F.col(effect).alias("y"), F.col(flag).alias("fy")), key)
    both, any_ = F.count_if(F.col("fx") & F.col("fy")), F.count_if(F.col("fx") | F.col("fy"))
    return j.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_agreement"), F.when(F.count_if("fx") > 0, both / F.count_if("fx")).alias("precision"), F.when(any_ > 0, both / any_).alias("jaccard"))


def suggest_contrasts(levels: list[str], controls=("control", "ctrl", "wt", "untreated", "vehicle", "healthy")) -> list[tuple[str, str]]:
    """Pairs (numerator, denominator) for display: everything against a control, if a level names one, else all pairs."""
    base = next((x for x in levels if x.lower() in controls), None)
    return [(x, base) for x in levels if x != base] if base else [(b, a) for i, a in enumerate(levels) for b in levels[i + 1 :]]


MISSING = ("", "NA", "nan", "NaN", "None")


def validate_design(rows: list[dict], condition: str, covariates=(), least: int = 2, least_cell: int = 2) -> dict:
    """A design's status (ok, warn or block), messages, rank and residual degrees of freedom. Samples are a design's few rows, on the driver."""
    warnings, blocks = [], []
    if not rows:
        return {"status": "block", "messages": ["no samples"], "rank": 0, "residual_df": 0}
    if gone := [c for c in (condition, *covariates) if c not in rows[0]]:
        return {"status": "block", "messages": [f"no columns {gone}"], "rank": 0, "residual_df": 0}
    kept = [r for r in rows if all(r[c] is not None and str(r[c]) not in MISSING for c in (condition, *covariates))]
    if len(kept) < len(rows):
        warnings.append(f"{len(rows) - len(kept)} samples lack a value")
    levels = sorted({str(r[condition]) for r in kept})
    if len(levels) < 2:
        blocks.append("one condition only")
    n = {x: sum(str(r[condition]) == x for r in kept) for x in levels}
    blocks += [f"{x}: a single replicate" for x, k in n.items() if k == 1]
    warnings += [f"{x}: fewer than {least} replicates" for x, k in n.items() if 1 < k < least]
    columns = [np.ones(len(kept))] + [np.array([str(r[condition]) == x for r in kept], float) for x in levels[1:]]
    for c in covariates:
        values = [str(r[c]) for r in kept]
        try:
            nums = [float(v) for v in values]
        except ValueError:
            nums = None
        if nums is not None and len(set(nums)) > 2:
            columns.append(np.array(nums) - np.mean(nums))
            continue
        names = sorted(set(values))
        columns += [np.array([v == x for v in values], float) for x in names[1:]]
        cells = {(str(r[condition]), v) for r, v in zip(kept, values, strict=True)}
        small = [cell for cell in cells if sum(str(r[condition]) == cell[0] and v == cell[1] for r, v in zip(kept, values, strict=True)) < least_cell]
        warnings += [f"{condition} x {c}: {cell} has fewer than {least_cell} samples" for cell in sorted(small)]
    x = np.column_stack(columns) if kept else np.zeros((0, 1))
    rank = int(np.linalg.matrix_rank(x)) if len(x) else 0
    if rank < x.shape[1]:
        blocks.append("the design is rank deficient")
    if len(x) - rank < 1:
        blocks.append("no residual degrees of freedom")
    return {"status": "block" if blocks else "warn" if warnings else "ok", "messages": blocks + warnings, "rank": rank, "residual_df": len(x) - rank}


def replicate_contrast(table: DataFrame, groups: DataFrame, a: str, b: str, batch: str | None = None, pairs: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Per feature: Welch, a paired t over pairs, or least squares with batch terms; then the correction and the direction."""
    rows = table.join(groups, "sample")
    if pairs:
        out = paired(rows.withColumnRenamed(pairs, "unit"), "group", a, b)
    elif batch:
        meta = groups.where(F.col("group").isin(a, b)).orderBy("sample").toPandas().set_index("sample")
        design = pd.concat([pd.Series(1.0, meta.index, name="one"), (meta["group"] == a).astype(float).rename("group"), pd.get_dummies(meta[batch], drop_first=True, dtype=float).add_prefix("batch_")], axis=1)
        out = ols(rows.where(F.col("group").isin(a, b)), design, "group", "sample")
    else:
        out = welch(rows, "group", a, b)
    out = bh_adjust(out, "p", "padj")
    return out.withColumn("direction", F.when(F.coalesce(F.col("padj") < alpha, F.lit(False)), F.when(F.col("effect") > 0, a).otherwise(F.lit(b))))


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)
