"""Samples, permutations and simulations that repeat exactly (X1 to X7)."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by the hash of key and seed: the same ones however the table is partitioned."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def stratified(df: DataFrame, key: str, stratum: str, n: int, least: int = 1, seed: int = 0) -> DataFrame:
    """About n rows: a floor for every stratum, then quotas in proportion, remainders to the largest fractions, picks by hash. weight is the inverse chance of being picked, at mean 1."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    rest = sizes.withColumns({"floor": F.least("size", F.lit(least)), "all": F.sum("size").over(Window.partitionBy())})
    rest = rest.withColumn("left", F.greatest(F.lit(n) - F.sum("floor").over(Window.partitionBy()), F.lit(0)))
    share = (F.col("size") - F.col("floor")) / F.greatest(F.sum(F.col("size") - F.col("floor")).over(Window.partitionBy()), F.lit(1)) * F.col("left")
    q = rest.withColumn("share", share).withColumn("base", F.floor("share"))
    extra = F.least(F.col("left"), F.sum(F.col("size") - F.col("floor")).over(Window.partitionBy())) - F.sum("base").over(Window.partitionBy())
    q = q.withColumn("extra", extra).withColumn("nth", F.row_number().over(Window.orderBy((F.col("share") - F.col("base")).desc(), stratum)))
    q = q.select(stratum, "size", F.least(F.col("size"), F.col("floor") + F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")).alias("quota"))
    picked = df.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key))).join(F.broadcast(q), stratum).where(F.col("__n") <= F.col("quota"))
    raw = picked.withColumn("weight", F.col("size") / F.col("quota"))
    return raw.withColumn("weight", F.col("weight") / F.avg("weight").over(Window.partitionBy())).drop("__n", "size", "quota")


def permutations(labels: dict[str, str], n: int, batch: dict[str, str] | None = None, seed: int = 0) -> list[dict[str, str]]:
    """n label permutations of a design's samples, within batches where given; none is the identity of labels."""
    rng, names = np.random.default_rng(seed), sorted(labels)
    groups: dict[str, list[str]] = {}
    for s in names:
        groups.setdefault(batch[s] if batch else "", []).append(s)
    if all(len({labels[s] for s in g}) == 1 for g in groups.values()):
        raise ValueError("every permutation would leave the labels as they are")
    out = []
    while len(out) < n:
        new = {}
        for g in groups.values():
            new |= dict(zip(g, (labels[g[i]] for i in rng.permutation(len(g))), strict=True))
        if new != labels:
            out.append(new)
    return out


def folds(df: DataFrame, key: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """Stratified folds 0 to k - 1 by the order of hashes."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)


def simulate_counts(spark: SparkSession, features: int, changed: int, units: int, seed: int = 11, dispersion: float = 0.1, least: float = 1.0, most: float = 3.0, base: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Negative-binomial counts (feature, unit, value) of two arms, the units (unit, group) and the planted truth (feature, log2fc, changed). Made by feature in parallel; the same for the same seed."""
    def make(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                fc = rng.uniform(least, most) * rng.choice([-1, 1]) if i < changed else 0.0
                mean = base * rng.lognormal(0, 1)
                for u in range(2 * units):
                    mu = mean * (2.0**fc if u >= units else 1.0)
                    out.append((f"f{i:05d}", f"u{u:02d}", int(rng.poisson(rng.gamma(1 / dispersion, mu * dispersion))), fc))
            yield pd.DataFrame(out, columns=["feature", "unit", "value", "log2fc"])

    rows = spark.range(features).mapInPandas(make, "feature string, unit string, value long, log2fc double")
    meta = spark.createDataFrame([(f"u{u:02d}", "a" if u >= units else "b") for u in range(2 * units)], "unit string, group string")
    truth = rows.select("feature", "log2fc").distinct().withColumn("changed", F.col("log2fc") != 0)
    return rows.select("feature", "unit", "value"), meta, truth


def score_detection(result: DataFrame, truth: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: recall, precision, false discovery and false positive rates, effect correlation on the changed features."""
    j = truth.join(result.select("feature", "padj", F.col("log2fc").alias("found")), "feature", "left").withColumn("hit", F.coalesce(F.col("padj") < alpha, F.lit(False)))
    hit, real = F.count_if("hit"), F.count_if("changed")
    both = F.count_if(F.col("hit") & F.col("changed"))
    return j.agg(F.when(real > 0, both / real).alias("recall"), F.when(hit > 0, both / hit).alias("precision"), F.when(hit > 0, 1 - both / hit).otherwise(0.0).alias("fdr"), F.when(F.count_if(~F.col("changed")) > 0, (hit - both) / F.count_if(~F.col("changed"))).alias("fpr"), F.corr(F.when(F.col("changed"), F.col("log2fc")), F.when(F.col("changed"), F.col("found"))).alias("effect_r"))


def mutations(report: dict) -> list[tuple[str, dict]]:
    """Variants of a claim report, each wrong in one way: inflated count, flipped direction, other unit, dropped denominator, unsupported cause, foreign node."""
    out = []
    for name, change in (("inflated_count", {"count": report.get("count", 0) * 10 + 1}), ("flipped_direction", {"direction": -report.get("direction", 1)}), ("other_unit", {"unit": "cell" if report.get("unit") != "cell" else "sample"}), ("no_denominator", {"denominator": None}), ("causal_wording", {"text": f"{report.get('text', '')} causes"}), ("foreign_node", {"node": "ledger://elsewhere"})):
        out.append((name, report | change))
    return out
