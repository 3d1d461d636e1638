"""Interval operators. Closure and slack are arguments: half-open [start, end) or closed [start, end].

Range joins are equi-joins on (contig, bin): every interval is dealt into the bins it touches, pairs are kept
in the first bin they share only, so nothing is joined twice and no cross join is planned. A bin should be
about as wide as the intervals (or the window); very long intervals take more rows, not more pairs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.order import carry, coverage, merge_runs, runs, stretched

BIN = 10_000


def _binned(df: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    first = F.floor(low / width)
    return df.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, F.floor(high / width))))


def overlap_join(a: DataFrame, b: DataFrame, keys=("chrom",), closed: bool = False, slack: float = 0, how: str = "inner", width: int = BIN, start="start", end="end") -> DataFrame:
    """Pairs of intervals that overlap (closed: or meet; slack: or lie so far apart). b's columns other than the keys get the prefix b_.
    how: inner, left, left_semi or left_anti."""
    b = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    touch = (F.col(start) - slack, F.col(end) + slack)
    meets = (F.col(f"b_{start}") <= touch[1]) & (F.col(f"b_{end}") >= touch[0]) if closed else (F.col(f"b_{start}") < touch[1]) & (F.col(f"b_{end}") > touch[0])
    left = _binned(a, touch[0], touch[1], width)
    right = _binned(b, F.col(f"b_{start}"), F.col(f"b_{end}"), width).withColumnRenamed("__first", "__bfirst")
    shared = F.col("__bin") == F.greatest("__first", "__bfirst")
    pairs = left.join(right, [*keys, "__bin"]).where(meets & shared).drop("__bin", "__first", "__bfirst")
    if how == "inner":
        return pairs
    row = F.struct(*a.columns).alias("__row")
    hit = pairs.select(row).distinct()
    if how == "left":
        return pairs.unionByName(a.withColumn("__row", row).join(hit, "__row", "left_anti").select(*a.columns), allowMissingColumns=True)
    return a.withColumn("__row", row).join(hit, "__row", how).select(*a.columns)


def count_overlaps(a: DataFrame, b: DataFrame, key: list[str], keys=("chrom",), weight: str | None = None, name: str = "n", **more) -> DataFrame:
    """Overlaps of each row of a (named by key), zero included; weight: a column of b that is summed instead."""
    pairs = overlap_join(a, b, keys, **more)
    n = F.count("*") if weight is None else F.sum(f"b_{weight}")
    return a.join(pairs.groupBy(*key).agg(n.alias(name)), key, "left").fillna({name: 0})


def window_pairs(points: DataFrame, intervals: DataFrame, window: int, point="tss", keys=("chrom",), least: int = 0) -> DataFrame:
    """Points and the intervals within window of them (closed at both ends), with distance: 0 inside, else to the nearer end. least <= distance."""
    around = points.withColumns({"__lo": F.col(point) - window, "__hi": F.col(point) + window})
    pairs = _window_join(around, intervals, keys, max(window, 1))
    distance = F.greatest(F.lit(0), F.col("b_start") - F.col(point), F.col(point) - F.col("b_end"))
    return pairs.withColumn("distance", distance).where((F.col("distance") <= window) & (F.col("distance") >= least)).drop("__lo", "__hi")


def _window_join(a: DataFrame, b: DataFrame, keys, width: int) -> DataFrame:
    b = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    left = _binned(a, F.col("__lo"), F.col("__hi"), width)
    right = _binned(b, F.col("b_start"), F.col("b_end"), width).withColumnRenamed("__first", "__bfirst")
    meets = (F.col("b_start") <= F.col("__hi")) & (F.col("b_end") >= F.col("__lo")) & (F.col("__bin") == F.greatest("__first", "__bfirst"))
    return left.join(right, [*keys, "__bin"]).where(meets).drop("__bin", "__first", "__bfirst")


def nearest_point(queries: DataFrame, points: DataFrame, at="at", point="point", keys=("chrom",), tie=("name",)) -> DataFrame:
    """Each query with the closest point of its contig: as-of from both sides, at equal distance the lower point, then the tie columns.
    One shuffle and sort by stretches of a contig, no range join. Points' columns come as p_<name>, with signed distance (point - at)."""
    extra = [c for c in points.columns if c not in keys and c != point]
    first = points.groupBy(*keys, point).agg(F.min(F.struct(*tie, *(c for c in extra if c not in tie))).alias("p")).select(*keys, F.col(point).alias("__at"), F.struct(F.col(point).alias("point"), "p").alias("__p"))
    marked = queries.select(*keys, F.col(at).alias("__at"), F.struct(*queries.columns).alias("__q")).unionByName(first, allowMissingColumns=True)
    last, next_ = (lambda c: F.last(c, ignorenulls=True)), (lambda c: F.first(c, ignorenulls=True))
    has = F.when(F.col("__p").isNotNull(), F.col("__at"))
    marked = carry(stretched(marked, keys, F.col("__at")), __before=(F.max_by("__p", has), last), __after=(F.min_by("__p", has), next_, "after"))
    order = Window.partitionBy("__k").orderBy("__at", F.col("__p").isNull())
    below = last("__p").over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = next_("__p").over(Window.partitionBy("__k").orderBy("__at", F.col("__p").isNotNull()).rowsBetween(0, Window.unboundedFollowing))
    rows = marked.withColumns({"__b": F.coalesce(below, "__before"), "__a": F.coalesce(above, "__after")}).where("__q is not null")
    lower = F.col("__at") - F.col("__b.point") <= F.col("__a.point") - F.col("__at")
    best = F.when(F.col("__a").isNull() | (F.col("__b").isNotNull() & lower), F.col("__b")).otherwise(F.col("__a"))
    return rows.withColumn("__best", best).select("__q.*", F.col("__best.point").alias(f"p_{point}"), *(F.col(f"__best.p.{c}").alias(f"p_{c}") for c in extra), (F.col("__best.point") - F.col("__at")).alias("distance"))


def as_of(left: DataFrame, right: DataFrame, keys, at: str, right_at: str, strict: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before it (strict: before). Right columns come as r_<name>."""
    rest = [c for c in right.columns if c not in keys]
    r = right.select(*keys, F.col(right_at).alias("__at"), F.struct(*rest).alias("__r"))
    l_ = left.select(*keys, F.col(at).alias("__at"), F.struct(*left.columns).alias("__l"))
    last = lambda c: F.last(c, ignorenulls=True)
    has = F.when(F.col("__r").isNotNull(), F.col("__at"))
    both = carry(stretched(l_.unionByName(r, allowMissingColumns=True), keys, F.col("__at")), __before=(F.max_by("__r", has), last))
    order = Window.partitionBy("__k").orderBy("__at", F.col("__l").isNull() if strict else F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("__got", F.coalesce(last("__r").over(order), "__before"))
    return both.where("__l is not null").select("__l.*", *(F.col(f"__got.{c}").alias(f"r_{c}") for c in rest))


def contains_point(points: DataFrame, intervals: DataFrame, at="at", keys=("chrom",), closed: bool = True) -> DataFrame:
    """Points with the interval that holds them (of disjoint intervals): the last start at or before, then a check of the end. Null if none."""
    got = as_of(points, intervals.select(*keys, "start", *(c for c in intervals.columns if c not in (*keys, "start"))), list(keys), at, "start")
    inside = F.col(at) <= F.col("r_end") if closed else F.col(at) < F.col("r_end")
    return got.withColumns({f"r_{c}": F.when(inside, F.col(f"r_{c}")) for c in intervals.columns if c not in keys})


def consensus(intervals: DataFrame, replicate="replicate", least: int = 2, keys=("chrom",), touch: bool = False) -> DataFrame:
    """Merged runs that at least so many replicates support: keys, start, end, support, fraction (rounded to 4)."""
    n = intervals.agg(F.count_distinct(replicate).alias("__all"))
    merged = merge_runs(intervals, list(keys), "start", "end", touch, more=[F.count_distinct(replicate).alias("support")])
    return merged.where(F.col("support") >= least).crossJoin(F.broadcast(n)).select(*keys, "start", "end", "support", F.round(F.col("support") / F.col("__all"), 4).alias("fraction"))


def union_map(intervals: DataFrame, keys=("chrom",), touch: bool = False) -> DataFrame:
    """Every interval with the run of the union that contains it (u_start, u_end), by windows and without a join."""
    r = runs(intervals, list(keys), "start", "end", "__run", touch)
    w = Window.partitionBy(*keys, "__run")
    return r.withColumns({"u_start": F.min("start").over(w), "u_end": F.max("end").over(w)}).drop("__run")


def replicate_pairs(a: DataFrame, b: DataFrame, keys=("chrom",), score="score") -> DataFrame:
    """Runs over two replicates' intervals with the best score of each; runs that lack one are left out."""
    both = a.select(*keys, "start", "end", score, F.lit(0).alias("rep")).unionByName(b.select(*keys, "start", "end", score, F.lit(1).alias("rep")))
    best = [F.max(F.when(F.col("rep") == i, F.col(score))).alias(f"score{i + 1}") for i in (0, 1)]
    return merge_runs(both, list(keys), "start", "end", False, more=best).where("score1 is not null and score2 is not null")


def reciprocal_overlap(a: DataFrame, b: DataFrame, fraction: float = 0.5, keys=("chrom",)) -> DataFrame:
    """Pairs whose overlap is positive and at least the fraction of both lengths."""
    pairs = overlap_join(a, b, keys)
    common = F.least("end", "b_end") - F.greatest("start", "b_start")
    return pairs.withColumn("overlap", common).where((F.col("overlap") > 0) & (F.col("overlap") >= fraction * (F.col("end") - F.col("start"))) & (F.col("overlap") >= fraction * (F.col("b_end") - F.col("b_start"))))


def set_overlap(a: DataFrame, b: DataFrame, keys=("chrom",), slack: float = 0, closed: bool = True) -> DataFrame:
    """One row: a, b, a_hit, b_hit, precision (a_hit / a), recall (b_hit / b)."""
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((a, "a"), (b, "b"), (overlap_join(a, b, keys, closed, slack, "left_semi"), "a_hit"), (overlap_join(b, a, keys, closed, slack, "left_semi"), "b_hit"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)
    return out.withColumns({"precision": F.when(F.col("a") > 0, F.col("a_hit") / F.col("a")), "recall": F.when(F.col("b") > 0, F.col("b_hit") / F.col("b"))})


def annotate_anchors(loops: DataFrame, genes: DataFrame, window: int = 5000) -> DataFrame:
    """Loops (chrom1, start1, end1, chrom2, start2, end2) with the genes (chrom, tss, gene) near each anchor, and their class."""
    loops = loops.withColumn("__loop", F.xxhash64(*loops.columns))
    at = genes.select("chrom", F.col("tss").alias("start"), F.col("tss").alias("end"), "gene")
    out = loops
    for i in (1, 2):
        anchor = loops.select("__loop", F.col(f"chrom{i}").alias("chrom"), (F.col(f"start{i}") - window).alias("start"), (F.col(f"end{i}") + window).alias("end")).distinct()
        near = overlap_join(anchor, at, closed=True).groupBy("__loop").agg(F.sort_array(F.collect_set("b_gene")).alias(f"genes{i}"))
        out = out.join(near, "__loop", "left").withColumn(f"genes{i}", F.coalesce(f"genes{i}", F.array().cast("array<string>")))
    n = (F.size("genes1") > 0).cast("int") + (F.size("genes2") > 0).cast("int")
    return out.withColumn("loop_class", F.when(n == 2, "promoter_promoter").when(n == 1, "promoter_enhancer").otherwise("distal_distal")).drop("__loop")


def annotate_intervals(intervals: DataFrame, genes: DataFrame, upstream: int = 2000, downstream: int = 500) -> DataFrame:
    """Intervals (chrom, start, end, name) by the nearest gene (gene, chrom, tss, strand, start, end, exons array<struct<start,end>>): promoter, exonic, intronic
    or intergenic, in this priority; ties by distance, tss, gene."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    q = intervals.withColumn("at", middle)
    forward = F.col("strand") != "-"
    promoters = genes.select("chrom", F.when(forward, F.col("tss") - upstream).otherwise(F.col("tss") - downstream).alias("start"), F.when(forward, F.col("tss") + downstream).otherwise(F.col("tss") + upstream).alias("end"), "gene", "tss", F.lit(0).alias("rank"))
    bodies = genes.select("chrom", "start", "end", "gene", "tss", F.lit(2).alias("rank"))
    exons = genes.select("chrom", F.explode("exons").alias("e"), "gene", "tss").select("chrom", "e.start", "e.end", "gene", "tss", F.lit(1).alias("rank"))
    hits = overlap_join(q, promoters.unionByName(bodies).unionByName(exons)).select("name", "chrom", "start", "end", "at", F.struct(F.col("b_rank").alias("rank"), F.abs(F.col("b_tss") - F.col("at")).alias("distance"), F.col("b_tss").alias("tss"), F.col("b_gene").alias("gene")).alias("g"))
    near = nearest_point(q, genes.select("chrom", F.col("tss").alias("point"), F.col("gene").alias("name")), "at", "point")
    far = near.where("p_point is not null").select("name", "chrom", "start", "end", "at", F.struct(F.lit(3).alias("rank"), F.abs("distance").alias("distance"), F.col("p_point").alias("tss"), F.col("p_name").alias("gene")).alias("g"))
    best = hits.unionByName(far).groupBy("name").agg(F.min("g").alias("g"))
    kind = F.element_at(F.array(*map(F.lit, ("promoter", "exonic", "intronic", "intergenic"))), F.col("g.rank") + 1)
    return intervals.join(best, "name", "left").select(*intervals.columns, F.col("g.gene").alias("gene"), F.col("g.distance").alias("distance"), F.coalesce(kind, F.lit("intergenic")).alias("feature"))


def fragment_coverage(alignments: DataFrame, longest: int = 1000, extend: int = 200, scale: float = 1.0) -> DataFrame:
    """bedGraph rows of an alignments table (chrom, pos, strand, proper, read1, tlen, mapq): proper pairs' first reads span their fragment,
    single reads are extended."""
    pair = F.col("proper") & F.col("read1") & (F.abs("tlen") > 0) & (F.abs("tlen") < longest)
    low = F.when(F.col("proper"), F.when(F.col("tlen") > 0, F.col("pos")).otherwise(F.col("pos") + F.col("tlen"))).otherwise(F.when(F.col("strand") == "-", F.col("pos") - extend).otherwise(F.col("pos")))
    size = F.when(F.col("proper"), F.abs("tlen")).otherwise(extend)
    spans = alignments.where(pair | ~F.col("proper")).select("chrom", F.greatest(low, F.lit(0)).alias("start"), (low + size).alias("end"))
    return coverage(spans, ["chrom"], "start", "end").withColumn("score", F.col("depth") * scale).drop("depth")


def broad_domains(bins: DataFrame, width: int, least_log2: float = 0.585, gap: int = 30_000, least: int = 20_000) -> DataFrame:
    """Runs of enriched bins (chrom, start, ip, control; both counts scaled alike), stitched over gaps, long enough."""
    rich = bins.withColumn("log2", F.log2((F.col("ip") + 0.5) / (F.col("control") + 0.5))).where(F.col("log2") >= least_log2).withColumn("end", F.col("start") + width)
    domains = merge_runs(rich, ["chrom"], "start", "end", True, gap, more=[F.avg("log2").alias("mean_log2"), F.count("*").alias("bins")])
    return domains.where(F.col("end") - F.col("start") >= least)
