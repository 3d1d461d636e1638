"""Counts by unit and quality gates (G1 to G30, P1 to P21). Matrices are long tables: feature, sample or cell, value."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.order import top_rows


class DesignError(ValueError):
    """A design that cannot be aggregated or tested as asked."""


def pseudobulk(counts: DataFrame, cells: DataFrame, group="group", replicate="replicate", condition="condition", min_cells: int = 10, min_reps: int = 2) -> tuple[DataFrame, DataFrame]:
    """Sums per (group, sample, feature), and the samples: group, sample, replicate, condition, n_cells. Where any replicate spans conditions, samples
    are replicate__condition, for all. Samples below min_cells go, then groups below 2 min_reps samples, then features that sum to 0 in their group."""
    spans = cells.groupBy(replicate).agg(F.count_distinct(condition).alias("k")).where("k > 1").limit(1).count() > 0
    sample = F.concat_ws("__", replicate, condition) if spans else F.col(replicate).cast("string")
    keyed = cells.withColumn("sample", sample)
    samples = keyed.groupBy(group, "sample").agg(F.min(replicate).alias(replicate), F.min(condition).alias(condition), F.count("*").alias("n_cells"))
    big = cells.groupBy(group).agg(F.count("*").alias("all")).where(F.col("all") >= min_cells).select(group)
    samples = samples.where(F.col("n_cells") >= min_cells).join(big, group, "left_semi")
    enough = samples.groupBy(group).agg(F.count("*").alias("k")).where(F.col("k") >= 2 * min_reps).select(group)
    samples = samples.join(enough, group, "left_semi")
    sums = counts.join(keyed.select("cell", group, "sample"), "cell").groupBy(group, "sample", "feature").agg(F.sum("value").alias("value"))
    sums = sums.join(samples.select(group, "sample"), [group, "sample"], "left_semi")
    live = sums.groupBy(group, "feature").agg(F.sum("value").alias("t")).where("t <> 0").select(group, "feature")
    return sums.join(live, [group, "feature"], "left_semi").select(group, "sample", "feature", "value"), samples


def sum_replicates(counts: DataFrame, samples: DataFrame, unit: str, design: list[str], on_conflict: str = "error") -> tuple[DataFrame, DataFrame]:
    """Technical samples summed to units. A design column that varies inside a unit is an error, or (drop) is left out of the result."""
    seen = samples.groupBy(unit).agg(*(F.count_distinct(c).alias(c) for c in design))
    worst = seen.agg(*(F.max(c).alias(c) for c in design)).first()
    varying = [c for c in design if (worst[c] or 0) > 1]
    if varying and on_conflict == "error":
        raise DesignError(f"vary inside a unit: {varying}")
    constant = [c for c in design if c not in varying]
    units = samples.groupBy(unit).agg(*(F.min(c).alias(c) for c in constant)) if constant else samples.select(unit).distinct()
    return counts.join(samples.select("sample", unit), "sample").groupBy(unit, "feature").agg(F.sum("value").alias("value")), units


def group_means(counts: DataFrame, samples: DataFrame, group="group", value="value") -> DataFrame:
    return counts.join(samples.select("sample", group), "sample").groupBy("feature", group).agg(F.avg(value).alias("mean"))


def composition(cells: DataFrame, sample="sample", kind="kind") -> DataFrame:
    """log((n + 1) / (N + 1)) of each kind in each sample, kinds that a sample lacks included."""
    n = contingency_long(cells, sample, kind)
    return n.withColumn("log_share", F.log((F.col("n") + 1) / (F.sum("n").over(Window.partitionBy(sample)) + 1)))


def contingency_long(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs of a's and b's values, 0 included."""
    grid = rows.select(a).distinct().crossJoin(rows.select(b).distinct())
    return grid.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").fillna({"n": 0})


def contingency(rows: DataFrame, a: str, b: str, values=None) -> DataFrame:
    """A row per a, a column per value of b."""
    return rows.groupBy(a).pivot(b, values).count().na.fill(0)


def mad_bounds(df: DataFrame, column: str, n_mad: float = 3, log: bool = False, floor: float = 0.05, keys=()) -> DataFrame:
    """low and high: median -+ n MADs, a MAD being at least 5 % of the median; in log1p space they are turned back and rounded."""
    x = F.log1p(column) if log else F.col(column).cast("double")
    rows = df.where(F.col(column).isNotNull()).select(*keys, x.alias("x"))
    middle = rows.groupBy(*keys).agg(F.median("x").alias("m"))
    joined = rows.join(middle, list(keys)) if keys else rows.crossJoin(F.broadcast(middle))
    spread = joined.groupBy(*keys).agg(F.median(F.abs(F.col("x") - F.col("m"))).alias("d"), F.max("m").alias("m"))
    width = n_mad * F.greatest("d", floor * F.abs("m"))
    back = (lambda c: F.rint(F.expm1(c))) if log else (lambda c: c)
    return spread.select(*keys, back(F.col("m") - width).alias("low"), back(F.col("m") + width).alias("high"))


def cell_metrics(counts: DataFrame, mito: str = r"^(?i)mt-") -> DataFrame:
    """total_counts, n_genes and pct_mt per cell."""
    total = F.sum("value")
    return counts.groupBy("cell").agg(total.alias("total_counts"), F.count_if(F.col("value") > 0).alias("n_genes"), F.when(total > 0, 100 * F.sum(F.when(F.col("feature").rlike(mito), F.col("value")).otherwise(0)) / total).otherwise(0.0).alias("pct_mt"))


def cell_gate(metrics: DataFrame, max_mt: float = 25, n_mad: float = 3) -> DataFrame:
    """Cells whose genes and counts lie within their MAD bounds (log space) and whose mitochondrial share is at most the ceiling."""
    out = metrics.where(F.col("pct_mt") <= max_mt)
    for c in ("n_genes", "total_counts"):
        out = out.crossJoin(F.broadcast(mad_bounds(metrics, c, n_mad, log=True).withColumnsRenamed({"low": "__l", "high": "__h"}))).where(F.col(c).between(F.col("__l"), F.col("__h"))).drop("__l", "__h")
    return out


def joint_gate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cells that pass in both modalities."""
    return first.join(second.select("cell"), "cell", "left_semi")


def drop_empty(counts: DataFrame, min_genes: int = 200, min_cells: int = 3) -> DataFrame:
    """Cells with so many features first, then features in so many of those cells."""
    live = counts.where("value > 0")
    cells = live.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= min_genes).select("cell")
    counts, live = counts.join(cells, "cell", "left_semi"), live.join(cells, "cell", "left_semi")
    return counts.join(live.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).select("feature"), "feature", "left_semi")


def drop_zero_features(counts: DataFrame) -> DataFrame:
    return counts.join(counts.groupBy("feature").agg(F.sum("value").alias("t")).where("t <> 0").select("feature"), "feature", "left_semi")


def detected(counts: DataFrame, least: int) -> DataFrame:
    """Features detected in more than least cells, or in least at least where that is under 50."""
    n = F.count_if(F.col("value") > 0)
    keep = counts.groupBy("feature").agg(n.alias("n")).where(F.col("n") > least if least >= 50 else F.col("n") >= least).select("feature")
    return counts.join(keep, "feature", "left_semi")


def significant(padj: Column, effect: Column | None = None, alpha: float = 0.05, least: float | None = None) -> Column:
    """padj < alpha and, where asked for, |effect| > least; what is missing is not significant."""
    ok = F.coalesce(padj < alpha, F.lit(False)) & ~F.coalesce(F.isnan(padj), F.lit(True))
    if effect is not None:
        ok = ok & effect.isNotNull() & ~F.isnan(effect)
        ok = ok & (F.abs(effect) > least) if least is not None else ok
    return F.coalesce(ok, F.lit(False))


def of_contrast(df: DataFrame, contrast: str, group=None) -> DataFrame:
    """Rows of a contrast (columns comparison and contrast, those of them there are) and, where asked for and there is such a column, of a group. Compared as text;
    null matches nothing."""
    for column in {"comparison", "contrast"} & set(df.columns):
        df = df.where(F.col(column).cast("string") == contrast)
    return df.where(F.col("group").cast("string") == str(group)) if group is not None and "group" in df.columns else df


@dataclass(frozen=True)
class Thresholds:
    """What counts as significant and how much data a test needs. Confirmed values of the experiment (global_padj, global_lfc) go before defaults; one that is no
    number is the default."""

    padj: float = 0.05
    log2fc: float = 0.5
    min_cells: int = 10
    min_replicates: int = 3
    modality: str = "generic"

    @classmethod
    def of(cls, context: dict | None, modality: str = "generic", log2fc: float = 0.5, min_cells: int = 10, min_replicates: int = 3) -> "Thresholds":
        def number(key: str, default: float) -> float:
            try:
                return float((context or {}).get(key, default))
            except (TypeError, ValueError):
                return default

        return cls(number("global_padj", cls.padj), number("global_lfc", log2fc), int(min_cells), int(min_replicates), str(modality))

    def significant(self, padj: Column, effect: Column) -> Column:
        return significant(padj, effect, self.padj, self.log2fc)


def converged(df: DataFrame, flag="lfc_converged") -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


def pick(df: DataFrame, aliases) -> Column | None:
    """The first finite value among the columns that match an alias in any case; null columns if none does."""
    low = {a.lower() for a in aliases}
    found = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in df.columns if c.lower() in low]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def raw_count_report(counts: DataFrame, value="value") -> DataFrame:
    """One row: non-finite, negative, non-integer values, all values and whether they are raw counts."""
    v = F.col(value).cast("double")
    bad = F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))
    out = counts.agg(F.count("*").alias("n"), F.count_if(bad).alias("non_finite"), F.count_if(~bad & (v < 0)).alias("negative"), F.count_if(~bad & (v != F.rint(v))).alias("non_integer"))
    return out.withColumn("raw", F.expr("n > 0 and non_finite + negative + non_integer = 0"))


#: What each piece of evidence weighs.
EVIDENCE = {"integer": 0.34, "nonnegative": 0.22, "decimals": 0.16, "library": 0.12, "ids": 0.08, "source": 0.08}


def raw_count_score(counts: DataFrame, id_pattern: str = r"^(ENS[A-Z]*G\d+|[A-Z][A-Z0-9-]+)", source_hint: float = 0.5) -> DataFrame:
    """One row: the weighted evidence that values are raw counts."""
    v = F.col("value").cast("double")
    library = counts.groupBy("sample").agg(F.sum("value").alias("t")).agg(F.when(F.avg("t") > 0, F.least(F.lit(1.0), F.coalesce(F.stddev_samp("t"), F.lit(0.0)) / F.avg("t") * 10)).otherwise(0.0).alias("library"))
    shares = counts.agg(F.avg((v == F.rint(v)).cast("double")).alias("integer"), F.avg((v >= 0).cast("double")).alias("nonnegative"), F.avg((F.length(F.regexp_extract(v.cast("string"), r"\.(\d+)", 1)) <= 1).cast("double")).alias("decimals"), F.avg(F.col("feature").rlike(id_pattern).cast("double")).alias("ids"))
    return shares.crossJoin(library).withColumn("source", F.lit(source_hint)).withColumn("score", reduce(lambda a, b: a + b, (F.col(k) * w for k, w in EVIDENCE.items())))


def variable_features(matrix: DataFrame, n: int, keep: DataFrame | None = None, floor: int = 500, value="value") -> DataFrame:
    """The n features of highest sample variance, equals by name; only those in keep, unless it leaves fewer than floor."""
    if keep is not None:
        inside = matrix.join(keep.select("feature").distinct(), "feature", "left_semi")
        matrix = inside if inside.select("feature").distinct().limit(floor).count() >= floor else matrix
    return matrix.groupBy("feature").agg(F.var_samp(value).alias("variance")).orderBy(F.col("variance").desc_nulls_last(), "feature").limit(n)


def doublets(cells: DataFrame, depth="depth", features="features", z: float = 2.5, max_rate: float = 0.12, least: int = 50, keys=()) -> DataFrame:
    """Cells with both robust z scores (of logs) at z or more, the top ceil(rate n) by their sum at most; not run on fewer than
    least cells (null). A MAD of 0 gives way to the population deviation."""
    logs = cells.withColumns({"__d": F.log1p(depth), "__f": F.log1p(features)})
    w = list(keys)
    mid = logs.groupBy(*w).agg(*(F.median(c).alias(f"{c}m") for c in ("__d", "__f")), *(F.stddev_pop(c).alias(f"{c}s") for c in ("__d", "__f")), F.count("*").alias("__all"))
    rows = logs.join(mid, w) if w else logs.crossJoin(F.broadcast(mid))
    dev = rows.groupBy(*w).agg(*(F.median(F.abs(F.col(c) - F.col(f"{c}m"))).alias(f"{c}a") for c in ("__d", "__f")))
    rows = rows.join(dev, w) if w else rows.crossJoin(F.broadcast(dev))
    for c in ("__d", "__f"):
        scale = F.when(F.col(f"{c}a") > 0, 1.4826 * F.col(f"{c}a")).otherwise(F.col(f"{c}s"))
        rows = rows.withColumn(f"{c}z", F.when(scale > 0, (F.col(c) - F.col(f"{c}m")) / scale).otherwise(0.0))
    rows = rows.withColumn("score", F.col("__dz") + F.col("__fz"))
    candidate = (F.col("__dz") >= z) & (F.col("__fz") >= z)
    order = Window.partitionBy(*w).orderBy(F.col("score").desc(), *cells.columns[:1])
    rows = rows.withColumn("doublet", F.when(F.col("__all") >= least, candidate & (F.row_number().over(order) <= F.ceil(F.col("__all") * max_rate))))
    return rows.select(*cells.columns, "score", "doublet")


def qc_failures(checks: dict[str, tuple[str, float, str]]) -> Column:
    """Messages of failed checks {name: (column, threshold, 'min' or 'max')}; unmeasured is not failed. Null if nothing was measured."""
    out = [F.when(F.col(c) < t if kind == "min" else F.col(c) > t, F.lit(f"{name}: beyond {t}")) for name, (c, t, kind) in checks.items()]
    measured = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c, _, _ in checks.values()))
    return F.when(measured, F.array_compact(F.array(*out)))


#: Words in column names that speak of technical batches.
BATCH_WORDS = ("batch", "lane", "run", "plate", "flowcell", "library", "date", "chip", "pool", "sequencer")


def hidden_batches(columns, condition: str, replicate: str, declared=()) -> list[str]:
    """Columns that look technical and were not declared."""
    import re

    return [c for c in columns if c not in (condition, replicate, *declared) and set(re.split(r"[^a-z]+", c.lower())) & set(BATCH_WORDS)]


#: Labels of control samples.
CONTROLS = ("input", "igg", "control", "mock", "wce")


def is_control(label: Column) -> Column:
    return F.lower(F.trim(label)).isin(*CONTROLS)


def contact_stats(pixels: DataFrame, bins: DataFrame, near: int = 20_000) -> DataFrame:
    """One row: total, cis, trans, cis closer than near, and beyond. pixels: bin1, bin2, count; bins: bin, chrom, start."""
    a, b = (bins.select(F.col("bin").alias(f"bin{i}"), F.col("chrom").alias(f"c{i}"), F.col("start").alias(f"s{i}")) for i in (1, 2))
    rows = pixels.join(a, "bin1").join(b, "bin2")
    cis, far = F.col("c1") == F.col("c2"), F.abs(F.col("s2") - F.col("s1")) >= near
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    return rows.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), total(cis).alias("cis"), total(~cis).alias("trans"), total(cis & ~far).alias("cis_near"), total(cis & far).alias("cis_far"))


def frip(fragments: DataFrame, peaks: DataFrame, by=(), least: int = 0) -> DataFrame:
    """The share of fragments (chrom, start, end) that overlap a merged peak; by barcode only those with least fragments."""
    from veldt.functions.order import merge_runs
    from veldt.operators.intervals import overlap_join

    merged = merge_runs(peaks.select("chrom", "start", "end"), ["chrom"], "start", "end")
    rows = fragments.withColumn("__id", F.monotonically_increasing_id()) if "fragment" not in fragments.columns else fragments.withColumnRenamed("fragment", "__id")
    hit = overlap_join(rows, merged, how="left_semi").select(*by, F.lit(1).alias("hit"))
    n = rows.groupBy(*by).agg(F.count("*").alias("fragments"))
    h = hit.groupBy(*by).agg(F.count("*").alias("in_peaks"))
    out = (n.join(h, list(by), "left") if by else n.crossJoin(h)).fillna({"in_peaks": 0})
    return out.where(F.col("fragments") >= least).withColumn("frip", F.col("in_peaks") / F.col("fragments"))


def fragment_sizes(fragments: DataFrame, mito=("chrM", "MT", "M")) -> DataFrame:
    """One row: bands of length (under 100, 180 to 247, 315 to 473), barcodes, mitochondrial and duplicate shares."""
    size = F.col("end") - F.col("start")
    n = F.count("*")
    distinct = F.count_distinct("chrom", "start", "end", "barcode")
    return fragments.agg(n.alias("n"), (F.count_if(size < 100) / n).alias("nucleosome_free"), (F.count_if(size.between(180, 247)) / n).alias("mono"), (F.count_if(size.between(315, 473)) / n).alias("di"), F.count_distinct("barcode").alias("barcodes"), (F.count_if(F.col("chrom").isin(*mito)) / n).alias("mito"), (1 - distinct / n).alias("duplicates"))


def complexity(positions: DataFrame, keys) -> DataFrame:
    """One row: NRF, PBC1 and PBC2 of reads by position; null where nothing divides."""
    seen = positions.groupBy(*keys).agg(F.count("*").alias("n"))
    d, one, two, reads = F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.sum("n")
    return seen.agg(F.when(reads > 0, d / reads).alias("nrf"), F.when(d > 0, one / d).alias("pbc1"), F.when(two > 0, one / two).alias("pbc2"))


def js_distance(a: DataFrame, b: DataFrame, keys, n="n") -> DataFrame:
    """The Jensen-Shannon distance (base 2, rounded to 4) of two tables of counts by bin."""
    rows = a.groupBy(*keys).agg(F.sum(n).alias("p")).join(b.groupBy(*keys).agg(F.sum(n).alias("q")), list(keys), "full").fillna({"p": 0, "q": 0})
    totals = rows.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    rows = rows.crossJoin(F.broadcast(totals)).where("tp > 0 and tq > 0").select((F.col("p") / F.col("tp")).alias("p"), (F.col("q") / F.col("tq")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)
    return rows.agg(F.round(F.sqrt(F.greatest(F.lit(0.0), (F.sum(part("p")) + F.sum(part("q"))) / 2)), 4).alias("jsd"))


def any_significant(rows: DataFrame, key: str, flag: str) -> DataFrame:
    return rows.groupBy(key).agg(F.bool_or(flag).alias(flag))


def two_by_two(a: DataFrame, b: DataFrame, key: str, flag_a: str, flag_b: str) -> DataFrame:
    """One row of counts over the keys of both: both, a only, b only, neither."""
    rows = a.select(key, F.col(flag_a).alias("x")).join(b.select(key, F.col(flag_b).alias("y")), key)
    return rows.agg(*(F.count_if((F.col("x") == x) & (F.col("y") == y)).alias(n) for n, x, y in (("both", True, True), ("a_only", True, False), ("b_only", False, True), ("neither", False, False))))


def ubiquitous(markers: DataFrame, group="group", marker="marker", fraction: float = 0.5) -> DataFrame:
    """Markers of at least max(2, round-half-even(fraction x groups)) groups."""
    n = markers.agg(F.count_distinct(group).alias("groups"))
    counts = markers.groupBy(marker).agg(F.count_distinct(group).alias("n"))
    return counts.crossJoin(F.broadcast(n)).where(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("groups") * fraction))).select(marker, "n")


def confounded(samples: DataFrame, factors, condition="condition") -> DataFrame:
    """factor and whether it is confounded: each of its levels in one condition only, or each condition in one of its levels only
    (with more than one level)."""
    parts = []
    for f in factors:
        one = samples.groupBy(f).agg(F.count_distinct(condition).alias("k")).agg(F.max("k").alias("level"), F.count("*").alias("levels"))
        other = samples.groupBy(condition).agg(F.count_distinct(f).alias("k")).agg(F.max("k").alias("cond"))
        parts.append(one.crossJoin(other).select(F.lit(f).alias("factor"), ((F.col("levels") > 1) & (F.col("level") == 1) & (F.col("cond") >= 1)).alias("confounded")))
    return reduce(DataFrame.unionByName, parts)


def pairing(samples: DataFrame, replicate="replicate", condition="condition", test="test", ref="ref") -> str:
    """complete, partial, independent or insufficient."""
    rows = samples.where(F.col(condition).isin(test, ref))
    per = rows.groupBy(replicate).agg(F.count_distinct(condition).alias("k"))
    r = per.agg(F.count("*").alias("n"), F.count_if(F.col("k") == 2).alias("both")).first()
    arms = rows.groupBy(condition).agg(F.count_distinct(replicate).alias("n")).agg(F.min("n").alias("least"), F.count("*").alias("arms")).first()
    if arms["arms"] < 2 or arms["least"] < 2:
        return "insufficient"
    return "complete" if r["both"] == r["n"] else "partial" if r["both"] >= 2 else "independent"


def balance(samples: DataFrame, condition="condition", replicate="replicate") -> DataFrame:
    n = samples.groupBy(condition).agg(F.count_distinct(replicate).alias("n"))
    return n.agg(F.count("*").alias("arms"), F.min("n").alias("least"), (F.min("n") / F.max("n")).alias("ratio"))


def power_inputs(counts: DataFrame) -> DataFrame:
    """One row: mean of the features' means, median of their positive dispersions (variance - mean) / mean squared."""
    per = counts.groupBy("feature").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("m > 0")
    d = (F.col("v") - F.col("m")) / (F.col("m") * F.col("m"))
    return per.agg(F.avg("m").alias("mean"), F.median(F.when(d > 0, d)).alias("dispersion"))


def score_predictions(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row over all tasks (task_id, truth, should_abstain) and predictions (task_id, answer, abstained, verified): a missing prediction is
    neither wrong nor abstained; a correct but unverified answer counts as confidently wrong."""
    rows = tasks.join(predictions, "task_id", "left")
    given = F.col("abstained").isNotNull()
    said = given & ~F.coalesce("abstained", F.lit(False))
    right = said & ~F.col("should_abstain") & F.col("answer").eqNullSafe(F.col("truth"))
    good = (right & F.coalesce("verified", F.lit(False))) | (given & F.col("abstained") & F.col("should_abstain"))
    n = F.count("*")
    return rows.agg(n.alias("n"), F.count_if(good).alias("correct"), F.count_if(said & ~good).alias("confidently_wrong"), F.count_if(given & F.coalesce("abstained", F.lit(False))).alias("abstained"), F.count_if(~given).alias("missing"), (F.count_if(good) / n).alias("accuracy"))


def kappa(a: DataFrame, b: DataFrame, key: str, label="label") -> DataFrame:
    """Cohen's kappa; 1 if both only ever say the same single label."""
    both = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key)
    n = both.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("po"))
    margins = both.groupBy("x").agg(F.count("*").alias("a")).withColumnRenamed("x", "l").join(both.groupBy("y").agg(F.count("*").alias("b")).withColumnRenamed("y", "l"), "l")
    pe = margins.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    chance = F.col("ab") / (F.col("n") * F.col("n"))
    return n.crossJoin(pe).where("n > 0").select(F.when(chance == 1, F.lit(1.0)).otherwise((F.col("po") - chance) / (1 - chance)).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, unit="unit", label="label") -> DataFrame:
    """Nominal alpha over units with two ratings at least."""
    n = ratings.where(F.col(label).isNotNull()).groupBy(unit, label).agg(F.count("*").alias("k"))
    n = n.withColumn("m", F.sum("k").over(Window.partitionBy(unit))).where("m > 1")
    observed = n.agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("m") - F.col("k")) / (F.col("m") - 1)).alias("d"))
    expected = n.groupBy(label).agg(F.sum("k").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    e = (F.col("n") * F.col("n") - F.col("s")) / (F.col("n") - 1)
    return observed.crossJoin(expected).select(F.when(e == 0, 1.0).otherwise(1 - F.col("d") / e).alias("alpha"))


def usage(log: DataFrame, experiment: str | None, cutoff: str, grace: float = 0) -> DataFrame:
    """Calls and tokens by model since the cutoff."""
    from veldt.functions.scalars import since

    rows = log.where(since(F.col("timestamp"), cutoff, grace))
    rows = rows if experiment is None else rows.where(F.col("experiment_id") == experiment)
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def marker_summary(counts: DataFrame, cells: DataFrame, group="group", value="value") -> DataFrame:
    """Per group and feature: mean and share of expressing cells inside and outside (cells without a row count as 0)."""
    sizes = cells.groupBy(group).agg(F.count("*").alias("n_in")).withColumn("n_all", F.sum("n_in").over(Window.partitionBy()))
    inside = counts.where("value > 0").join(cells.select("cell", group), "cell").groupBy(group, "feature").agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    w = Window.partitionBy("feature")
    rows = inside.withColumns({"s_all": F.sum("s").over(w), "k_all": F.sum("k").over(w)}).join(sizes, group)
    out = F.col("n_all") - F.col("n_in")
    return rows.select(group, "feature", (F.col("s") / F.col("n_in")).alias("mean_in"), (F.col("k") / F.col("n_in")).alias("pct_in"), F.when(out > 0, (F.col("s_all") - F.col("s")) / out).alias("mean_out"), F.when(out > 0, (F.col("k_all") - F.col("k")) / out).alias("pct_out"))


def label_confidence(cells: DataFrame, cluster="cluster", label="label", score="score", top: int = 3) -> DataFrame:
    """Per cluster its most frequent labels with share and mean score."""
    n = cells.groupBy(cluster, label).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(cluster)))
    return top_rows(n, [cluster], [F.desc("n"), F.col(label)], top, "rank")


def majority(cells: DataFrame, cluster="cluster", label="label") -> DataFrame:
    return top_rows(cells.groupBy(cluster, label).agg(F.count("*").alias("n")), [cluster], [F.desc("n"), F.col(label)], 1)


def discordant_clusters(cells: DataFrame, joint="joint", single="single", purity: float = 0.5) -> DataFrame:
    """Joint clusters whose most frequent single label has less than the share."""
    n = cells.groupBy(joint, single).agg(F.count("*").alias("n"))
    return n.groupBy(joint).agg((F.max("n") / F.sum("n")).alias("purity")).where(F.col("purity") < purity)


def multiverse(results: DataFrame, claim="claim") -> DataFrame:
    """Per claim over its variants (supported, effect): share supported, sign agreement, and whether all agree."""
    return results.groupBy(claim).agg(F.count("*").alias("variants"), F.avg(F.col("supported").cast("double")).alias("supported"), F.greatest(F.avg((F.col("effect") > 0).cast("double")), F.avg((F.col("effect") < 0).cast("double"))).alias("sign_agreement"), F.bool_and("supported").alias("robust"))
