"""Queries over the whole test tables, one or more for each group of operators, and the same in DuckDB's SQL where SQL can say it.

Names start with the group's letter in the operator inventory. Floating results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions import order as o
from veldt.functions import scalars as sc
from veldt.operators import contacts, counts, embedding, governance, intervals, joins, models, sampling, sets, verbs
from veldt.plans.execute import execute
from veldt.plans.model import Filter, GovernedTable, GroupSummary, Plan, Project, Rank, ValidatedJoin, parse_plan
from veldt.streaming import bus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(column, digits: int = 6):
    return F.round(column, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


# governed tables


def governed(spark: SparkSession, sf: str) -> dict[str, GovernedTable]:
    orders = t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customer = t(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    items = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    return {
        "orders": GovernedTable.of(orders, "orders", "order", "o_orderkey"),
        "customer": GovernedTable.of(customer, "customer", "customer", "c_custkey"),
        "nation": GovernedTable.of(t(spark, sf, "nation"), "nation", "nation", "n_nationkey"),
        "items": GovernedTable.of(items, "items", "order", "o_orderkey"),
        "part": GovernedTable.of(t(spark, sf, "part").withColumns({"size": F.expr("nullif(p_size, 7)"), "brand": F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))}), "part", "part", "p_partkey"),
    }


@query("""
SELECT c_mktsegment, sum(o_totalprice) AS o_totalprice, count(o_orderkey) AS o_orderkey FROM (
  SELECT c.c_mktsegment, o.o_totalprice, o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus <> 'P' AND n.n_regionkey IN (0, 1, 2))
GROUP BY c_mktsegment""".replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)"))
def q_plan_revenue_by_segment(spark, sf):
    """The flagship plan: filter, two validated joins, filter, group summary, rank."""
    plan = Plan("orders", (
        Filter("o_orderstatus", "!=", "P"), ValidatedJoin("customer", ("c_custkey",), "inner", "m:1", True), ValidatedJoin("nation", ("n_nationkey",), "inner", "m:1", True),
        Filter("n_regionkey", "in", [0, 1, 2]), GroupSummary(("c_mktsegment",), {"o_totalprice": "sum", "o_orderkey": "count"}), Rank(("o_totalprice",), (False,)),
    ))
    return execute(plan, governed(spark, sf)).df.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""
SELECT o_orderkey, o_totalprice, c_custkey FROM (SELECT o_orderkey, o_totalprice, o_custkey AS c_custkey FROM orders)
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def q_plan_top_orders(spark, sf):
    """A ranked limit, which is the feature; ties by the key."""
    plan = parse_plan({"base_table_id": "orders", "steps": [{"step": "rank", "by": "o_totalprice", "ascending": False, "limit": 25}, {"step": "project", "columns": ["o_orderkey", "o_totalprice", "c_custkey"]}]})
    return execute(plan, governed(spark, sf)).df


FILTER_CASES = (("==", 7.0), ("!=", 9), ("<", 10), ("<=", 10), (">", 40), (">=", 40), ("in", [1, 2, 3]), ("not_in", [1, 2, 3]), ("is_not_null", None))


@query("""
WITH p AS (SELECT p_partkey, nullif(p_size, 7) AS size FROM part)
SELECT '==' AS op, count(*) FILTER (size = 7) AS n FROM p UNION ALL SELECT '!=', count(*) FILTER (size IS NULL OR size <> 9) FROM p
UNION ALL SELECT '<', count(*) FILTER (size < 10) FROM p UNION ALL SELECT '<=', count(*) FILTER (size <= 10) FROM p
UNION ALL SELECT '>', count(*) FILTER (size > 40) FROM p UNION ALL SELECT '>=', count(*) FILTER (size >= 40) FROM p
UNION ALL SELECT 'in', count(*) FILTER (size IN (1, 2, 3)) FROM p UNION ALL SELECT 'not_in', count(*) FILTER (size IS NULL OR size NOT IN (1, 2, 3)) FROM p
UNION ALL SELECT 'is_not_null', count(size) FROM p""")
def q_filters_on_nulls(spark, sf):
    """All nine filters on a column with nulls."""
    tables = governed(spark, sf)
    parts = [execute(Plan("part", (Filter("size", op, v),)), tables, prove=False).df.agg(F.lit(op).alias("op"), F.count("*").alias("n")) for op, v in FILTER_CASES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""
WITH p AS (SELECT CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand, nullif(p_size, 7) AS size, p_retailprice, p_partkey, p_name, p_type FROM part)
SELECT brand, count(size) AS size, round(median(p_retailprice), 6) AS p_retailprice, min(p_partkey) AS p_partkey, max(p_name) AS p_name FROM p GROUP BY brand""")
def q_group_summary_with_null_groups(spark, sf):
    plan = Plan("part", (GroupSummary(("brand",), {"size": "count", "p_retailprice": "median", "p_partkey": "min", "p_name": "max"}),))
    return rounded(execute(plan, governed(spark, sf)).df)


@query("""
SELECT o.o_orderkey, o.o_custkey AS c_custkey, i.quantity, i.lines FROM orders o
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem GROUP BY 1) i ON o.o_orderkey = i.l_orderkey""")
def q_left_join_one_to_one(spark, sf):
    plan = Plan("orders", (ValidatedJoin("items", ("o_orderkey",), "left", "1:1"), Project(("o_orderkey", "c_custkey", "quantity", "lines"))))
    return execute(plan, governed(spark, sf)).df


@query("""
SELECT brand, count(*) AS pairs FROM (SELECT CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand FROM part) a
JOIN (SELECT DISTINCT CASE WHEN p_size % 5 <> 0 THEN p_brand END AS b FROM part) b ON a.brand IS NOT DISTINCT FROM b.b GROUP BY brand""")
def j_null_safe_join(spark, sf):
    """A null key meets a null key."""
    a = governed(spark, sf)["part"].df.select("brand")
    return joins.null_safe(a, a.distinct().withColumn("one", F.lit(1)), ["brand"]).groupBy("brand").agg(F.count("*").alias("pairs"))


# the statistics verb


@query("""
WITH x AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT "column", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median,
  round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max, round(kurtosis_pop(x), 6) AS excess_kurtosis,
  count(*) FILTER (x > 0) AS n_positive, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x = 0) AS n_zero FROM x GROUP BY "column" """)
def t_describe(spark, sf):
    return rounded(verbs.describe(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])).drop("skewness")


@query("SELECT coalesce(event_type, 'nan') AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 30")
def t_value_counts(spark, sf):
    return verbs.value_counts(t(spark, sf, "events"), "event_type")


@query("""
WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem),
q AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM p)
SELECT 'pearson' AS method, round(corr(x, y), 9) AS r, count(*) AS n FROM p UNION ALL SELECT 'spearman', round(corr(x, y), 9), count(*) FROM q""")
def t_corr(spark, sf):
    df = t(spark, sf, "lineitem")
    return spark.createDataFrame([(m, round(c["r"], 9), c["n"]) for m in ("pearson", "spearman") for c in [verbs.corr(df, "l_quantity", "l_extendedprice", m)]], "method string, r double, n long")


@query("""
WITH g AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
s AS (SELECT count(*) FILTER (g = 'BUILDING') AS n1, count(*) FILTER (g = 'MACHINERY') AS n2, avg(x) FILTER (g = 'BUILDING') AS m1, avg(x) FILTER (g = 'MACHINERY') AS m2,
  var_samp(x) FILTER (g = 'BUILDING') AS v1, var_samp(x) FILTER (g = 'MACHINERY') AS v2 FROM g)
SELECT n1 AS n_a, n2 AS n_b, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 9) AS statistic,
  round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 6) AS df FROM s""")
def t_ttest(spark, sf):
    x = verbs.ttest(t(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return spark.createDataFrame([(x["n_a"], x["n_b"], round(x["statistic"], 9), round(x["df"], 6))], "n_a long, n_b long, statistic double, df double")


@query("""
WITH g AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT sum(r) FILTER (g = 'BUILDING') - count(*) FILTER (g = 'BUILDING') * (count(*) FILTER (g = 'BUILDING') + 1) / 2 AS "statistic_U" FROM g""")
def t_rank_sum(spark, sf):
    x = verbs.rank_sum(t(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return spark.createDataFrame([(float(x["statistic_U"]),)], "statistic_U double")


@query("""
WITH g AS (SELECT c_mktsegment AS g, c_acctbal AS x, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m, avg(c_acctbal) OVER () AS a FROM customer),
s AS (SELECT sum((m - a) ^ 2) AS b, sum((x - m) ^ 2) AS w, count(DISTINCT g) AS k, count(*) AS n FROM g)
SELECT k AS groups, round(b / (k - 1) / (w / (n - k)), 6) AS f FROM s""")
def t_anova(spark, sf):
    x = verbs.anova(t(spark, sf, "customer"), "c_acctbal", "c_mktsegment")
    return spark.createDataFrame([(x["groups"], round(x["F"], 6))], "groups long, f double")


BH = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, {fam} AS fam, (round(l_extendedprice * 100)::BIGINT % 1000) / 1000.0 AS p FROM lineitem),
k AS (SELECT *, count(*) OVER (PARTITION BY fam) AS n, count(*) OVER (PARTITION BY fam ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM p),
a AS (SELECT *, min(least(p * n / rk, 1.0)) OVER (PARTITION BY fam ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS padj FROM k)
SELECT fam, p, round(padj, 9) AS padj, count(*) AS n FROM a GROUP BY ALL"""


def _p_values(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", (F.round(F.col("l_extendedprice") * 100).cast("long") % 1000 / 1000.0).alias("p"))


@query(BH.format(fam="l_returnflag"))
def w_bh_by_family(spark, sf):
    return o.bh_adjust(_p_values(spark, sf), "p", "padj", ["l_returnflag"]).groupBy(F.col("l_returnflag").alias("fam"), "p", r("padj", 9).alias("padj")).agg(F.count("*").alias("n"))


@query(BH.format(fam="1"))
def w_bh_pooled(spark, sf):
    """One family over all rows, ranked by ranges."""
    return o.pooled_bh(_p_values(spark, sf), "p", "padj").groupBy(F.lit(1).alias("fam"), "p", r("padj", 9).alias("padj")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(a, 6) AS mean, round(s, 6) AS std, m AS median FROM (SELECT o_orderkey,
  (o_totalprice + o_custkey + length(o_orderpriority)) / 3 AS a, list_aggregate([o_totalprice, o_custkey::DOUBLE, length(o_orderpriority)::DOUBLE], 'stddev_samp') AS s,
  list_aggregate([o_totalprice, o_custkey::DOUBLE, length(o_orderpriority)::DOUBLE], 'median') AS m FROM orders)""")
def t_row_aggregate(spark, sf):
    df = t(spark, sf, "orders").withColumn("len", F.length("o_orderpriority"))
    parts = [verbs.row_aggregate(df, "o_orderkey", ["o_totalprice", "o_custkey", "len"], f, f) for f in ("mean", "std", "median")]
    return rounded(parts[0].join(parts[1], "o_orderkey").join(parts[2], "o_orderkey").withColumn("median", F.col("median"))).select("o_orderkey", "mean", "std", "median")


@query("""SELECT 'orders' AS table_id, count(*) FILTER (o_orderkey > 100) AS n_matching, count(*) AS n_total FROM orders
UNION ALL SELECT 'items', count(*) FILTER (k > 100), count(*) FROM (SELECT l_orderkey AS k FROM lineitem GROUP BY 1)""")
def t_count_where(spark, sf):
    from veldt.plans.execute import Executor

    return verbs.count_where(Executor(governed(spark, sf)), ["orders", "items"], [Filter("o_orderkey", ">", 100)])


# order


@query("SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank, l_orderkey FROM lineitem")
def w_average_rank(spark, sf):
    return t(spark, sf, "lineitem").select("l_returnflag", "l_quantity", o.average_rank("l_quantity", ["l_returnflag"]).cast("double").alias("rank"), "l_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w_first_row(spark, sf):
    return o.first_row(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


SPANS = """SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 600 + (event_id % 7) * 1200 AS e FROM events"""


def _spans(spark, sf, *more):
    at = F.unix_timestamp("ts")
    return t(spark, sf, "events").select("event_id", "user_id", at.alias("start"), (at + 600 + F.col("event_id") % 7 * 1200).alias("end"), *more)


@query(f"""
WITH x AS ({SPANS}),
y AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM y)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM z GROUP BY user_id, run""")
def w_merge_runs(spark, sf):
    return o.merge_runs(_spans(spark, sf), ["user_id"], "start", "end", more=[F.count("*").alias("n")])


@query(f"""
WITH x AS ({SPANS}),
y AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s - max(e) OVER w > 86400 THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM y)
SELECT user_id, min(s) AS start, max(e) AS "end" FROM z GROUP BY user_id, run""")
def w_stitch_gaps(spark, sf):
    return o.merge_runs(_spans(spark, sf), ["user_id"], "start", "end", True, 86400)


@query(f"""
WITH x AS ({SPANS}), ev AS (SELECT user_id, s AS pos, 1 AS d FROM x UNION ALL SELECT user_id, e, -1 FROM x),
g AS (SELECT user_id, pos, sum(d) AS d FROM ev GROUP BY 1, 2),
c AS (SELECT user_id, pos AS start, lead(pos) OVER w AS "end", (sum(d) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM g WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT * FROM c WHERE "end" IS NOT NULL AND depth <> 0""")
def w_coverage(spark, sf):
    return o.coverage(_spans(spark, sf), ["user_id"], "start", "end")


@query("SELECT p_partkey, floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) * 7 / count(*) OVER (PARTITION BY p_brand))::INT AS bin FROM part".replace("* 7 /", "* 7.0 /"))
def w_quantile_bins(spark, sf):
    return t(spark, sf, "part").select("p_partkey", o.quantile_bin(["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")], 7).alias("bin"))


@query("""SELECT event_id, round(count(*) OVER w / count(*) OVER (PARTITION BY event_type), 9) AS rows_above, round(sum(value) OVER w / sum(value) OVER (PARTITION BY event_type), 6) AS share
FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY value DESC RANGE UNBOUNDED PRECEDING)""")
def w_survival(spark, sf):
    a, b = o.survival("value", ["event_type"])
    return t(spark, sf, "events").where("value is not null").select("event_id", r(a, 9).alias("rows_above"), r(b).alias("share"))


@query("""SELECT user_id, max(floor(epoch(ts))::BIGINT) AS "at", arg_max(event_type, (ts, event_id)) AS event_type, 1706659200 - max(floor(epoch(ts))::BIGINT) > 432000 AS stale FROM events GROUP BY 1""")
def w_latest(spark, sf):
    df = t(spark, sf, "events").select("user_id", F.unix_timestamp("ts").alias("at"), "ts", "event_id", "event_type")
    got = df.groupBy("user_id").agg(F.max("at").alias("at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return got.withColumn("stale", F.lit(1706659200) - F.col("at") > 432000)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) - 1 AS idx FROM f)
SELECT e.event_id, i.idx FROM events e JOIN i USING (user_id, event_type)""")
def w_first_seen_index(spark, sf):
    return o.first_seen_index(t(spark, sf, "events"), "event_type", "event_id", ["user_id"]).select("event_id", F.col("index").cast("long").alias("idx"))


@query("SELECT s_nationkey, s_suppkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3")
def w_top_per_group(spark, sf):
    return o.top_rows(t(spark, sf, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 3, "rank").select("s_nationkey", "s_suppkey", F.col("rank").cast("long").alias("rank"))


@query("""
WITH g AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, p_retailprice AS w, p_brand AS term FROM part),
tm AS (SELECT DISTINCT term FROM g),
x AS (SELECT tm.term, g.rank, CASE WHEN g.term = tm.term THEN g.w / sum(CASE WHEN g.term = tm.term THEN g.w END) OVER (PARTITION BY tm.term)
  ELSE -1.0 / count(CASE WHEN g.term <> tm.term THEN 1 END) OVER (PARTITION BY tm.term) END AS step FROM tm, g),
c AS (SELECT term, rank, sum(step) OVER (PARTITION BY term ORDER BY rank) AS es FROM x)
SELECT term, round(arg_max(es, abs(es)), 6) AS enrichment FROM c GROUP BY term""")
def w_running_enrichment(spark, sf):
    part = t(spark, sf, "part")
    ranked = part.select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("weight"))
    ranked = o.global_rank(ranked, "weight", ["gene"], "rank", descending=True)
    members = part.select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("gene"))
    return o.running_enrichment(ranked, members).select("term", r("enrichment").alias("enrichment"))


# joins and intervals


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, (SELECT 1) AS one FROM orders)
SELECT x.o_orderkey, max(y.o_orderdate) AS previous FROM orders x LEFT JOIN orders y ON x.o_custkey = y.o_custkey AND y.o_orderdate < x.o_orderdate GROUP BY 1""")
def j_as_of_previous(spark, sf):
    a = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    got = intervals.as_of(a, a.select("o_custkey", "o_orderdate").distinct(), ["o_custkey"], "o_orderdate", "o_orderdate", strict=True)
    return got.select("o_orderkey", F.col("r_o_orderdate").alias("previous"))


def _two_sides(spark, sf):
    s = _spans(spark, sf, "event_type").withColumn("chrom", F.col("user_id"))
    return tuple(s.where(F.col("event_type") == k).select("chrom", "start", "end", "event_id") for k in ("view", "purchase"))


SIDES = """WITH s AS (SELECT event_id, event_type, user_id AS chrom, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 600 + (event_id % 7) * 1200 AS e FROM events),
a AS (SELECT * FROM s WHERE event_type = 'view'), b AS (SELECT * FROM s WHERE event_type = 'purchase')"""


@query(f"""{SIDES} SELECT a.event_id, b.event_id AS b_event_id FROM a JOIN b ON a.chrom = b.chrom AND b.s < a.e AND b.e > a.s""")
def j_overlap_half_open(spark, sf):
    a, b = _two_sides(spark, sf)
    return intervals.overlap_join(a, b).select("event_id", "b_event_id")


@query(f"""{SIDES} SELECT a.event_id, b.event_id AS b_event_id FROM a JOIN b ON a.chrom = b.chrom AND b.s <= a.e + 3600 AND b.e >= a.s - 3600""")
def j_overlap_closed_with_slack(spark, sf):
    a, b = _two_sides(spark, sf)
    return intervals.overlap_join(a, b, closed=True, slack=3600).select("event_id", "b_event_id")


@query(f"""{SIDES} SELECT a.event_id, count(b.event_id) AS n FROM a LEFT JOIN b ON a.chrom = b.chrom AND b.s < a.e AND b.e > a.s GROUP BY 1""")
def j_count_overlaps(spark, sf):
    a, b = _two_sides(spark, sf)
    return intervals.count_overlaps(a, b, ["event_id"]).select("event_id", "n")


@query(f"""{SIDES} SELECT 'semi' AS kind, event_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND b.s < a.e AND b.e > a.s)
UNION ALL SELECT 'anti', event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND b.s < a.e AND b.e > a.s)""")
def j_overlap_semi_and_anti(spark, sf):
    a, b = _two_sides(spark, sf)
    parts = [intervals.overlap_join(a, b, how=f"left_{k}").select(F.lit(k).alias("kind"), "event_id") for k in ("semi", "anti")]
    return parts[0].union(parts[1])


@query(f"""{SIDES} SELECT a.event_id, min(abs(b.s - a.s)) AS distance FROM a JOIN b ON a.chrom = b.chrom GROUP BY 1""")
def j_nearest(spark, sf):
    a, b = _two_sides(spark, sf)
    near = intervals.nearest_point(a.select("chrom", F.col("start").alias("at"), "event_id"), b.select("chrom", F.col("start").alias("point"), F.col("event_id").alias("name")))
    return near.where("p_point is not null").select("event_id", F.abs("distance").alias("distance"))


@query(f"""{SIDES} SELECT a.event_id, b.event_id AS b_event_id, greatest(0, b.s - a.s, a.s - b.e) AS distance FROM a JOIN b ON a.chrom = b.chrom AND b.s <= a.s + 50000 AND b.e >= a.s - 50000""")
def j_window_pairs(spark, sf):
    a, b = _two_sides(spark, sf)
    return intervals.window_pairs(a.select("chrom", F.col("start").alias("tss"), "event_id"), b, 50_000).select("event_id", "b_event_id", "distance")


@query(f"""{SIDES} SELECT a.event_id, b.event_id AS b_event_id FROM a JOIN b ON a.chrom = b.chrom
WHERE least(a.e, b.e) - greatest(a.s, b.s) > 0 AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 * (a.e - a.s) AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 * (b.e - b.s)""")
def j_reciprocal_overlap(spark, sf):
    a, b = _two_sides(spark, sf)
    return intervals.reciprocal_overlap(a, b).select("event_id", "b_event_id")


@query(f"""{SIDES}, m AS (SELECT chrom, s, e, event_type FROM s),
y AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s >= max(e) OVER w THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM y)
SELECT chrom, min(s) AS start, max(e) AS "end", count(DISTINCT event_type) AS support, round(count(DISTINCT event_type) / (SELECT count(DISTINCT event_type) FROM m), 4) AS fraction FROM z GROUP BY chrom, run HAVING count(DISTINCT event_type) >= 2""")
def j_consensus_support(spark, sf):
    s = _spans(spark, sf, "event_type").select(F.col("user_id").alias("chrom"), "start", "end", F.col("event_type").alias("replicate"))
    return intervals.consensus(s)


@query("""
WITH x AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders), y AS (SELECT k, CASE WHEN k % 3 = 0 THEN p + 1 ELSE p END AS p, s FROM x WHERE k % 5 <> 0 UNION ALL SELECT -k, p, s FROM x WHERE k % 7 = 0)
SELECT coalesce(x.k, y.k) AS k, CASE WHEN x.k IS NULL THEN 'added' WHEN y.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM x FULL JOIN y ON x.k = y.k
WHERE x.k IS NULL OR y.k IS NULL OR x.p <> y.p""")
def j_full_outer_diff(spark, sf):
    x = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))
    y = x.where("k % 5 <> 0").withColumn("p", F.when(F.col("k") % 3 == 0, F.col("p") + 1).otherwise(F.col("p"))).union(x.where("k % 7 = 0").withColumn("k", -F.col("k")))
    return joins.diff(x, y, ["k"]).select("k", "change")


@query("""
WITH c AS (SELECT n_nationkey AS id, n_name AS a, n_regionkey::VARCHAR AS b FROM nation), d AS (SELECT n_nationkey + 100 AS id, n_regionkey::VARCHAR AS a, n_name AS b FROM nation)
SELECT c.id, d.id AS b_id, true AS flipped FROM c JOIN d ON c.a = d.b AND c.b = d.a""")
def j_align_reversed_contrasts(spark, sf):
    n = t(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("numerator"), F.col("n_regionkey").cast("string").alias("denominator"))
    b = n.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").cast("string").alias("numerator"), F.col("n_name").alias("denominator"))
    return joins.align_contrasts(a, b)


@query("""SELECT 'customer' AS level, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1
UNION ALL SELECT 'orders', count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1""")
def j_subtree(spark, sf):
    regions = t(spark, sf, "region").where("r_regionkey = 1").select("r_regionkey")
    got = joins.subtree([(t(spark, sf, "nation"), "n_regionkey", "n_nationkey"), (t(spark, sf, "customer"), "c_nationkey", "c_custkey"), (t(spark, sf, "orders"), "o_custkey", "o_orderkey")], regions)
    return got[1].agg(F.lit("customer").alias("level"), F.count("*").alias("n")).union(got[2].agg(F.lit("orders").alias("level"), F.count("*").alias("n")))


# counts


def _units(spark, sf):
    """Line items as cells: replicate is the supplier modulo 6, condition the flag, group the line status; features are parts modulo 50."""
    li = t(spark, sf, "lineitem").withColumn("cell", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    cells = li.groupBy("cell").agg(F.min("l_linestatus").alias("group"), (F.min("l_suppkey") % 6).alias("replicate"), F.min("l_returnflag").alias("condition"))
    values = li.groupBy("cell", F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return values, cells


UNITS = """WITH li AS (SELECT *, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS cell, 'f' || (l_partkey % 50) AS feature FROM lineitem),
cells AS (SELECT cell, min(l_linestatus) AS g, min(l_suppkey) % 6 AS rep, min(l_returnflag) AS cond FROM li GROUP BY 1),
vals AS (SELECT cell, feature, sum(l_quantity) AS v FROM li GROUP BY 1, 2)"""


@query(f"""{UNITS}, s AS (SELECT g AS "group", rep || '__' || cond AS sample, count(*) AS n FROM cells GROUP BY 1, 2 HAVING count(*) >= 10),
x AS (SELECT c.g AS "group", c.rep || '__' || c.cond AS sample, feature, sum(v) AS value FROM vals JOIN cells c USING (cell) GROUP BY 1, 2, 3)
SELECT x."group", x.sample, x.feature, x.value FROM x JOIN s USING ("group", sample) WHERE value <> 0""")
def g_pseudobulk(spark, sf):
    values, cells = _units(spark, sf)
    return counts.pseudobulk(values, cells)[0].select("group", "sample", "feature", "value")


def _matrix(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.concat(F.lit("f"), F.col("l_partkey") % 200).alias("feature"), F.concat(F.lit("s"), F.col("l_suppkey") % 8).alias("sample")).agg(F.sum("l_quantity").alias("value"))


MATRIX = "WITH m AS (SELECT 'f' || (l_partkey % 200) AS feature, 's' || (l_suppkey % 8) AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


@query(f"{MATRIX} SELECT feature, sample, round(value / (sum(value) OVER (PARTITION BY sample) / 1e6), 6) AS cpm FROM m")
def f_cpm(spark, sf):
    return rounded(sc.cpm(_matrix(spark, sf)).select("feature", "sample", "cpm"))


@query(f"""{MATRIX}, l AS (SELECT *, ln((value + 0.5) / sum(value + 0.5) OVER (PARTITION BY sample)) AS l FROM m)
SELECT feature, sample, round(l - avg(l) OVER (PARTITION BY sample), 6) AS clr FROM l""")
def f_clr(spark, sf):
    return rounded(sc.clr(_matrix(spark, sf)).select("feature", "sample", "clr"))


@query(f"""{MATRIX} SELECT feature, sample, round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY sample) * ln(1 + (SELECT count(DISTINCT sample) FROM m) / sum(value) OVER (PARTITION BY feature))), 6) AS tfidf,
  round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY sample)), 6) AS lognorm FROM m""")
def f_tf_idf_and_lognorm(spark, sf):
    df = sc.log1p_cp10k(sc.tf_idf(_matrix(spark, sf), "sample"))
    return rounded(df.select("feature", "sample", "tfidf", "lognorm"))


@query(f"""{MATRIX}, x AS (SELECT feature, p_size % 7 AS length, m.* EXCLUDE (feature) FROM m JOIN (SELECT 'f' || p_partkey AS pf, p_size FROM part) ON feature = pf WHERE p_size % 7 > 0),
q AS (SELECT *, value / (length / 1e3) AS rate FROM x)
SELECT feature, sample, round(rate / (sum(rate) OVER (PARTITION BY sample) / 1e6), 5) AS tpm FROM q""")
def f_tpm(spark, sf):
    lengths = t(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("feature"), (F.col("p_size") % 7).alias("length"))
    return rounded(sc.tpm(_matrix(spark, sf), lengths).select("feature", "sample", "tpm"), 5)


@query("""WITH m AS (SELECT median(ln(1 + l_extendedprice)) AS m FROM lineitem), d AS (SELECT greatest(median(abs(ln(1 + l_extendedprice) - m)), 0.05 * abs(max(m))) AS d, max(m) AS m FROM lineitem, m)
SELECT round_even(exp(m - 3 * d) - 1, 0) AS low, round_even(exp(m + 3 * d) - 1, 0) AS high FROM d""")
def p_mad_bounds(spark, sf):
    return counts.mad_bounds(t(spark, sf, "lineitem"), "l_extendedprice", log=True)


@query("""SELECT c_mktsegment, n_name, count(c_custkey) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer))
LEFT JOIN customer c USING (c_mktsegment) WHERE false GROUP BY ALL UNION ALL
SELECT s.c_mktsegment, n.n_name, count(c.c_custkey) FROM (SELECT DISTINCT c_mktsegment FROM customer) s CROSS JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)) n
LEFT JOIN customer c ON c.c_mktsegment = s.c_mktsegment AND c.c_nationkey = n.n_nationkey GROUP BY 1, 2""")
def g_contingency(spark, sf):
    rows = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return counts.contingency_long(rows, "c_mktsegment", "n_name")


@query("""
WITH a AS (SELECT l_partkey % 97 AS b, sum(l_quantity) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey % 97 AS b, sum(l_quantity) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
j AS (SELECT coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS q FROM a FULL JOIN b USING (b))
SELECT round(sqrt((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2), 4) AS jsd FROM j""")
def g_js_distance(spark, sf):
    a, b = (t(spark, sf, "lineitem").where(F.col("l_returnflag") == k).groupBy((F.col("l_partkey") % 97).alias("bin")).agg(F.sum("l_quantity").alias("n")) for k in "AN")
    return counts.js_distance(a, b, ["bin"])


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT round(count(*) / sum(n), 9) AS nrf, round(count(*) FILTER (n = 1) / count(*), 9) AS pbc1, round(count(*) FILTER (n = 1) / nullif(count(*) FILTER (n = 2), 0), 9) AS pbc2 FROM p""")
def g_complexity(spark, sf):
    return rounded(counts.complexity(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]), 9)


@query("""WITH j AS (SELECT q.doc_id, q.quality = 1 AS x, q.toxic = 1 AS y FROM labels q)
SELECT count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (NOT x AND y) AS b_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM j""")
def g_two_by_two(spark, sf):
    labels = t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y"))
    return counts.two_by_two(labels, labels, "doc_id", "x", "y")


@query("""WITH j AS (SELECT quality AS x, 1 - toxic AS y FROM labels), n AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM j),
m AS (SELECT (SELECT count(*) FROM j WHERE x = v) * (SELECT count(*) FROM j WHERE y = v) AS ab FROM (VALUES (0), (1)) t(v))
SELECT round((po - (SELECT sum(ab) FROM m) / (n * n)) / (1 - (SELECT sum(ab) FROM m) / (n * n)), 9) AS kappa FROM n""")
def g_kappa(spark, sf):
    labels = t(spark, sf, "labels")
    return rounded(counts.kappa(labels.select("doc_id", F.col("quality").alias("label")), labels.select("doc_id", (1 - F.col("toxic")).alias("label")), "doc_id"), 9)


@query("""WITH c AS (SELECT p_type AS marker, count(DISTINCT p_brand) AS n FROM part GROUP BY 1)
SELECT marker, n FROM c WHERE n >= greatest(2, round_even((SELECT count(DISTINCT p_brand) FROM part) * 0.5, 0))""")
def g_ubiquitous(spark, sf):
    return counts.ubiquitous(t(spark, sf, "part").select(F.col("p_brand").alias("group"), F.col("p_type").alias("marker")))


@query(f"""{UNITS}, sz AS (SELECT g, count(*) AS n FROM cells GROUP BY 1), al AS (SELECT count(*) AS n FROM cells),
i AS (SELECT g, feature, sum(v) AS s, count(*) AS k FROM vals JOIN cells USING (cell) WHERE v > 0 GROUP BY 1, 2),
a AS (SELECT *, sum(s) OVER (PARTITION BY feature) AS sa, sum(k) OVER (PARTITION BY feature) AS ka FROM i)
SELECT g AS "group", feature, round(s / sz.n, 6) AS mean_in, round(k / sz.n, 6) AS pct_in, round((sa - s) / (al.n - sz.n), 6) AS mean_out, round((ka - k) / (al.n - sz.n), 6) AS pct_out FROM a JOIN sz USING (g), al""")
def g_marker_summary(spark, sf):
    return rounded(counts.marker_summary(*_units(spark, sf)))


@query("""WITH n AS (SELECT event_type, user_id % 5 AS label, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) AS share, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, label) AS rank FROM n)
SELECT event_type, label, n, round(m, 6) AS mean_score, round(share, 6) AS share, rank FROM s WHERE rank <= 3""")
def g_label_confidence(spark, sf):
    df = t(spark, sf, "events").withColumn("label", F.col("user_id") % 5)
    return rounded(counts.label_confidence(df, "event_type", "label", "value")).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH n AS (SELECT n_regionkey AS joint, c_mktsegment AS single, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT joint, round(max(n) / sum(n), 9) AS purity FROM n GROUP BY 1 HAVING max(n) / sum(n) < 0.5""")
def g_discordant_clusters(spark, sf):
    rows = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("joint"), F.col("c_mktsegment").alias("single"))
    return rounded(counts.discordant_clusters(rows), 9)


@query(f"""{MATRIX}, p AS (SELECT feature, avg(value) AS m, var_samp(value) AS v FROM m GROUP BY 1)
SELECT round(avg(m), 6) AS mean, round(median(CASE WHEN (v - m) / (m * m) > 0 THEN (v - m) / (m * m) END), 6) AS dispersion FROM p WHERE m > 0""")
def g_power_inputs(spark, sf):
    return rounded(counts.power_inputs(_matrix(spark, sf)))


@query(f"{MATRIX} SELECT feature, round(var_samp(value), 4) AS variance FROM m GROUP BY 1 ORDER BY var_samp(value) DESC, feature LIMIT 50")
def p_variable_features(spark, sf):
    return rounded(counts.variable_features(_matrix(spark, sf), 50), 4)


@query("SELECT count(*) AS n, 0::BIGINT AS non_finite, count(*) FILTER (l_discount < 0) AS negative, count(*) FILTER (l_discount <> round(l_discount)) AS non_integer, false AS raw FROM lineitem")
def p_raw_count_report(spark, sf):
    return counts.raw_count_report(t(spark, sf, "lineitem"), "l_discount")


# sets


@query("""WITH m AS (SELECT DISTINCT l_returnflag || l_linestatus AS g, l_partkey AS i FROM lineitem), s AS (SELECT g, count(*) AS n FROM m GROUP BY 1)
SELECT x.g AS a, y.g AS b, count(*) AS shared, round(count(*) / (any_value(sx.n) + any_value(sy.n) - count(*)), 9) AS jaccard FROM m x JOIN m y ON x.i = y.i AND x.g < y.g JOIN s sx ON sx.g = x.g JOIN s sy ON sy.g = y.g GROUP BY 1, 2""")
def e_overlap_matrix(spark, sf):
    m = t(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("group"), F.col("l_partkey").alias("item"))
    return sets.overlap_matrix(m).select("a", "b", "shared", r("jaccard", 9).alias("jaccard"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_discount > 0.05),
n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (i)) AS shared)
SELECT n_a, n_b, shared, round(shared / n_a, 9) AS precision, round(shared / n_b, 9) AS recall, round(2 * shared / (n_a + n_b), 9) AS f1, round(shared / (n_a + n_b - shared), 9) AS jaccard, round(n_a * n_b / 200000, 9) AS expected FROM n""")
def e_set_summary(spark, sf):
    li = t(spark, sf, "lineitem")
    a, b = (li.where(c).select(F.col("l_partkey").alias("item")) for c in ("l_returnflag = 'A'", "l_discount > 0.05"))
    return rounded(sets.set_summary(a, b, universe=200_000), 9)


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), x AS (SELECT a, sum(n) AS m FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS m FROM c GROUP BY 1),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(m * (m - 1) / 2) FROM x) AS s1, (SELECT sum(m * (m - 1) / 2) FROM y) AS s2, (SELECT sum(n) FROM c) AS n,
  (SELECT sum(n * ln(n)) FROM c) AS e, (SELECT sum(m * ln(m)) FROM x) AS e1, (SELECT sum(m * ln(m)) FROM y) AS e2)
SELECT round((s - s1 * s2 / (n * (n - 1) / 2)) / ((s1 + s2) / 2 - s1 * s2 / (n * (n - 1) / 2)), 9) AS ari,
  round(2 * ((ln(n) - e1 / n) + (ln(n) - e2 / n) - (ln(n) - e / n)) / ((ln(n) - e1 / n) + (ln(n) - e2 / n)), 9) AS nmi FROM s""")
def e_ari_nmi(spark, sf):
    return rounded(sets.adjusted_rand(t(spark, sf, "labels"), "quality", "toxic"), 9)


@query("""WITH j AS (SELECT n_chars AS x, toxic = 1 AS y FROM documents JOIN labels USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM j),
s AS (SELECT count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg, sum(rk) FILTER (y) AS r FROM k) SELECT round((r - pos * (pos + 1) / 2) / pos / neg, 9) AS auc, pos, neg FROM s""")
def m_auc(spark, sf):
    j = t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id").withColumn("y", F.col("toxic") == 1)
    return rounded(sets.auc(j, "n_chars", "y"), 9)


@query("""WITH s AS (SELECT DISTINCT upper(p_brand) AS term, 'P' || p_partkey AS gene FROM part), q AS (SELECT DISTINCT 'P' || l_partkey AS gene FROM lineitem WHERE l_quantity >= 49),
u AS (SELECT gene FROM s UNION SELECT gene FROM q), m AS (SELECT term, count(*) AS marked FROM s GROUP BY 1), h AS (SELECT term, count(*) AS k FROM s JOIN q USING (gene) GROUP BY 1)
SELECT m.term, coalesce(k, 0) AS k, marked, (SELECT count(*) FROM q) AS drawn, (SELECT count(*) FROM u) AS population,
  round((coalesce(k, 0) + 0.5) * ((SELECT count(*) FROM u) - marked - (SELECT count(*) FROM q) + coalesce(k, 0) + 0.5) / (((SELECT count(*) FROM q) - coalesce(k, 0) + 0.5) * (marked - coalesce(k, 0) + 0.5)), 2) AS odds_ratio
FROM m LEFT JOIN h USING (term)""")
def m_enrichment_terms(spark, sf):
    s = t(spark, sf, "part").select(F.upper("p_brand").alias("term"), F.concat(F.lit("P"), "p_partkey").alias("gene"))
    q = t(spark, sf, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("P"), "l_partkey").alias("gene"))
    return sets.enrichment(q, s, all_terms=True).select("term", "k", "marked", "drawn", "population", "odds_ratio")


@query()
def m_enrichment_ranked(spark, sf):
    """With tails and the correction, which SQL lacks; the tests hold them against sums of binomials."""
    s = t(spark, sf, "part").select("p_brand", F.concat(F.lit("P"), "p_partkey").alias("gene")).withColumnRenamed("p_brand", "term")
    q = t(spark, sf, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("P"), "l_partkey").alias("gene"))
    return sets.enrichment(q, s, padj_max=1.1)


@query("""WITH a AS (SELECT p_partkey AS i, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), b AS (SELECT p_partkey AS i, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS k FROM part),
s AS (SELECT greatest(a.k, b.k) AS pos FROM a JOIN b USING (i) WHERE a.k <= 50 AND b.k <= 50), d AS (SELECT unnest(range(1, 51)) AS d)
SELECT round(sum(0.1 * 0.9 ^ (d - 1) * (SELECT count(*) FROM s WHERE pos <= d) / d), 9) AS rbo, (SELECT count(*) FROM s) AS shared FROM d""")
def l_rank_biased_overlap(spark, sf):
    part = t(spark, sf, "part")
    a, b = (o.global_rank(part.select(F.col("p_partkey").alias("item"), F.col(c).alias("x")), "x", ["item"], "rank", descending=True) for c in ("p_retailprice", "p_size"))
    return sets.rank_overlap(a, b).select(r("rbo", 9).alias("rbo"), "shared")


# models


def _arms(spark, sf):
    return t(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey") % 40).alias("feature"), F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 12).alias("unit"), F.col("l_extendedprice").alias("value"))


ARMS = "WITH d AS (SELECT 'f' || (l_partkey % 40) AS feature, l_returnflag AS g, l_suppkey % 12 AS unit, l_extendedprice AS x FROM lineitem WHERE l_returnflag IN ('A', 'R'))"
ARM_MOMENTS = f"""{ARMS}, m AS (SELECT feature, count(*) FILTER (g = 'A') AS n1, count(*) FILTER (g = 'R') AS n2, avg(x) FILTER (g = 'A') AS m1, avg(x) FILTER (g = 'R') AS m2, var_samp(x) FILTER (g = 'A') AS v1, var_samp(x) FILTER (g = 'R') AS v2 FROM d GROUP BY 1)"""


@query(f"""{ARM_MOMENTS} SELECT feature, round(m1 - m2, 4) AS effect, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 4) AS df FROM m""")
def m_welch(spark, sf):
    return models.welch(_arms(spark, sf), "g", "A", "R").select("feature", r("effect", 4).alias("effect"), r("t").alias("t"), r("df", 4).alias("df"))


@query(f"""{ARMS}, w AS (SELECT feature, unit, avg(x) FILTER (g = 'A') - avg(x) FILTER (g = 'R') AS d FROM d GROUP BY 1, 2)
SELECT feature, count(d) AS n, round(avg(d), 4) AS effect, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM w WHERE d IS NOT NULL GROUP BY 1""")
def m_paired(spark, sf):
    return models.paired(_arms(spark, sf), "g", "A", "R").select("feature", "n", r("effect", 4).alias("effect"), r("t").alias("t"))


@query(f"""{ARM_MOMENTS}, s AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS s2 FROM m), p AS (SELECT *, (SELECT median(s2) FROM s WHERE s2 > 1e-12) AS s0 FROM s)
SELECT feature, round((m1 - m2) / sqrt((4 * s0 + (n1 + n2 - 2) * s2) / (4 + n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, (n1 + n2 + 2)::DOUBLE AS df FROM p""")
def m_moderated(spark, sf):
    return models.moderated(_arms(spark, sf), "g", "A", "R").select("feature", r("t").alias("t"), "df")


@query()
def m_leave_one_out(spark, sf):
    """The jackknife over units of monthly means by feature; held against numpy in the tests."""
    df = _arms(spark, sf).where("g in ('A', 'R')").withColumn("unit", F.concat_ws("-", "g", F.col("unit") % 4)).groupBy("feature", "g", "unit").agg(F.avg("value").alias("value"))
    return models.leave_one_out(df, "g", "A", "R")


@query(f"""{MATRIX}, n AS (SELECT count(DISTINCT sample) AS n FROM m), g AS (SELECT feature, avg(ln(value)) AS g FROM m WHERE value > 0 GROUP BY 1 HAVING count(*) = (SELECT n FROM n))
SELECT sample, round(exp(median(ln(value) - g)), 9) AS size_factor FROM m JOIN g USING (feature) WHERE value > 0 GROUP BY 1""")
def m_size_factors(spark, sf):
    return rounded(models.size_factors(_matrix(spark, sf), "sample"), 9)


@query("""WITH g AS (SELECT c_acctbal AS x, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS m, avg(c_acctbal) OVER () AS a, c_nationkey AS g FROM customer),
s AS (SELECT sum((m - a) ^ 2) AS b, sum((x - a) ^ 2) AS t, count(DISTINCT g) AS k, count(*) AS n FROM g) SELECT round(b / t, 9) AS eta2, round(b / (k - 1) / ((t - b) / (n - k)), 6) AS f, k - 1 AS df1, n - k AS df2 FROM s""")
def m_eta_squared(spark, sf):
    return models.eta_squared(t(spark, sf, "customer"), "c_acctbal", "c_nationkey").select(r("eta2", 9).alias("eta2"), r("f").alias("f"), "df1", "df2")


@query("""SELECT l_returnflag, round(regr_slope(log2(l_extendedprice), log2(l_quantity)), 9) AS slope, round(regr_intercept(log2(l_extendedprice), log2(l_quantity)), 9) AS intercept, round(corr(log2(l_quantity), log2(l_extendedprice)), 9) AS r
FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1""")
def m_dose_response(spark, sf):
    return rounded(models.dose_response(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("monotone"), 9)


@query("""WITH d AS (SELECT 'f' || (l_partkey % 40) AS feature, l_returnflag AS g, l_extendedprice AS x FROM lineitem),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature) AS n FROM d),
ti AS (SELECT feature, sum(t ^ 3 - t) AS ties FROM (SELECT feature, x, count(*)::DOUBLE AS t FROM d GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT feature, g, sum(r) AS rs, count(*)::DOUBLE AS k, max(n)::DOUBLE AS n FROM k GROUP BY 1, 2)
SELECT feature, g AS "group", round((rs - k * (n + 1) / 2) / sqrt(k * (n - k) / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM s JOIN ti USING (feature)""")
def m_rank_sum_markers(spark, sf):
    return models.rank_sum_markers(_arms(spark, sf).withColumnRenamed("g", "group")).select("feature", "group", r("z").alias("z"))


@query("""WITH h AS (SELECT DISTINCT l_shipmode_x AS motif, item FROM (SELECT l_linestatus AS l_shipmode_x, l_partkey AS item FROM lineitem WHERE l_quantity > 45)),
f AS (SELECT p_partkey AS item, p_size % 4 AS stratum, p_retailprice > 1300 AS fg FROM part), sz AS (SELECT stratum, count(*)::DOUBLE AS n, count(*) FILTER (fg)::DOUBLE AS f FROM f GROUP BY 1),
t AS (SELECT motif, stratum, count(*) FILTER (fg)::DOUBLE AS a, count(*)::DOUBLE AS h FROM h JOIN f USING (item) GROUP BY 1, 2)
SELECT motif, round(sum(a - h * f / n) / sqrt(sum(h * f * (n - h) * (n - f) / (n * n * (n - 1)))), 6) AS z, round(sum(a * (n - h - f + a) / n) / sum((h - a) * (f - a) / n), 6) AS odds_ratio FROM t JOIN sz USING (stratum) WHERE n > 1 GROUP BY 1""")
def m_stratified_enrichment(spark, sf):
    hits = t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_linestatus").alias("motif"), F.col("l_partkey").alias("item"))
    fg = t(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 4).alias("stratum"), (F.col("p_retailprice") > 1300).alias("foreground"))
    return models.stratified_enrichment(hits, fg).select("motif", r("z").alias("z"), r("odds_ratio").alias("odds_ratio"))


@query(f"""{MATRIX} SELECT x.feature AS a, y.feature AS b, count(*) AS n, round(corr(x.value, y.value), 6) AS r FROM m x JOIN m y USING (sample) WHERE x.feature LIKE 'f1_' AND y.feature LIKE 'f2_' GROUP BY 1, 2""")
def m_pair_correlations(spark, sf):
    m = _matrix(spark, sf)
    names = m.select("feature").distinct()
    pairs = names.where("feature like 'f1_'").select(F.col("feature").alias("a")).crossJoin(names.where("feature like 'f2_'").select(F.col("feature").alias("b")))
    return rounded(models.pair_correlations(pairs, m, m))


@query(f"""{MATRIX} SELECT x.feature AS a, y.feature AS b, count(*) AS n, round(corr(x.value, y.value), 6) AS r FROM m x JOIN m y USING (sample) WHERE x.feature < y.feature GROUP BY 1, 2""")
def m_all_pair_correlations(spark, sf):
    """Of every two features that share a sample; m_pair_correlations has 100 of these pairs."""
    m = _matrix(spark, sf)
    seen = m.select("feature", "sample")
    pairs = seen.withColumnRenamed("feature", "a").join(seen.withColumnRenamed("feature", "b"), "sample").where("a < b").select("a", "b").distinct()
    return rounded(models.pair_correlations(pairs, m, m))


# vectors and graphs


def _neighbours(spark, sf, k=5):
    e = t(spark, sf, "embeddings")
    return embedding.nearest(e, e, k, "vec_id", "embedding").withColumnRenamed("vec_id", "id"), e.select(F.col("vec_id").alias("id"), "label")


KNN = """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS s, a.label AS la, b.label AS lb FROM e a, e b WHERE a.id <> b.id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, neighbour) <= 5)"""


@query(f"{KNN} SELECT id, neighbour, round(s, 6) AS similarity FROM k")
def v_nearest(spark, sf):
    return _neighbours(spark, sf)[0].select("id", "neighbour", r("similarity").alias("similarity"))


@query(f"{KNN}, m AS (SELECT id, lb, count(*) AS c FROM k GROUP BY 1, 2) SELECT id, round(sum(c) * sum(c) / sum(c * c), 6) AS lisi FROM m GROUP BY 1")
def v_lisi(spark, sf):
    edges, labels = _neighbours(spark, sf)
    return rounded(embedding.lisi(edges, labels))


@query(f"{KNN} SELECT la AS label, count(*) AS edges, round(avg((la = lb)::INT), 9) AS purity FROM k GROUP BY 1")
def v_neighbour_purity(spark, sf):
    edges, labels = _neighbours(spark, sf)
    return rounded(embedding.neighbour_purity(edges, labels), 9)


@query("""WITH e AS (SELECT DISTINCT least(o_custkey % 300, o_orderkey % 300) AS id, greatest(o_custkey % 300, o_orderkey % 300) AS neighbour FROM orders WHERE o_custkey % 300 <> o_orderkey % 300),
m AS (SELECT count(*)::DOUBLE AS m FROM e), d AS (SELECT l, count(*)::DOUBLE AS d FROM (SELECT id % 3 AS l FROM e UNION ALL SELECT neighbour % 3 FROM e) GROUP BY 1)
SELECT round((SELECT count(*) FROM e WHERE id % 3 = neighbour % 3) / m - (SELECT sum(d * d) FROM d) / (4 * m * m), 9) AS modularity FROM m""")
def v_modularity(spark, sf):
    od = t(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("x"), (F.col("o_orderkey") % 300).alias("y")).where("x <> y")
    e = od.select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("neighbour")).distinct().withColumn("weight", F.lit(1.0))
    labels = spark.range(300).select("id", (F.col("id") % 3).alias("label"))
    return rounded(embedding.modularity(e, labels), 9)


# contact matrices


def _pixels(spark, sf):
    od = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("x"), (F.col("l_partkey") % 40).alias("y"), F.concat(F.lit("c"), F.col("l_orderkey") % 2).alias("chrom"))
    return od.select("chrom", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).groupBy("chrom", "i", "j").agg(F.count("*").alias("count"))


PIXELS = "WITH p AS (SELECT 'c' || (l_orderkey % 2) AS chrom, least(l_suppkey % 40, l_partkey % 40) AS i, greatest(l_suppkey % 40, l_partkey % 40) AS j, count(*) AS c FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""{PIXELS}, d AS (SELECT unnest(range(0, 40)) AS d)
SELECT d::INT AS d, d * 1000 AS distance, coalesce((SELECT sum(c) FROM p WHERE j - i = d), 0)::BIGINT AS contacts, 2 * (40 - d) AS pairs, round(coalesce((SELECT sum(c) FROM p WHERE j - i = d), 0) / (2 * (40 - d)), 6) AS p FROM d""")
def c_distance_decay(spark, sf):
    bins = spark.range(40).withColumn("chrom", F.explode(F.array(F.lit("c0"), F.lit("c1")))).withColumnRenamed("id", "i")
    return rounded(contacts.distance_decay(_pixels(spark, sf), bins, 1000)).select("d", F.col("distance").cast("long").alias("distance"), "contacts", "pairs", "p")


@query(f"""{PIXELS}, b AS (SELECT unnest(range(0, 40)) AS b), s AS (SELECT p.chrom, b.b AS bin, sum(c) / 25.0 AS mean FROM p JOIN b ON p.i < b.b AND p.i >= b.b - 5 AND p.j >= b.b AND p.j < b.b + 5 GROUP BY 1, 2)
SELECT chrom, bin, round(log2(mean / avg(mean) OVER (PARTITION BY chrom)), 6) AS score FROM s""")
def c_insulation(spark, sf):
    return contacts.insulation(_pixels(spark, sf), 5).select("chrom", "bin", r("score").alias("score"))


@query(f"""{PIXELS}, x AS (SELECT chrom, i, j, c / avg(c) OVER (PARTITION BY chrom, j - i) AS oe FROM p) SELECT chrom, i, j, round(oe, 9) AS oe FROM x""")
def c_observed_expected(spark, sf):
    return contacts.observed_expected(_pixels(spark, sf)).select("chrom", "i", "j", r("oe", 9).alias("oe"))


@query(f"""{PIXELS}, q AS (SELECT *, i * 1000 AS s1, j * 1000 AS s2 FROM p)
SELECT sum(c)::BIGINT AS total, sum(c)::BIGINT AS cis, 0::BIGINT AS trans, (sum(c) FILTER (s2 - s1 < 20000))::BIGINT AS cis_near, (sum(c) FILTER (s2 - s1 >= 20000))::BIGINT AS cis_far FROM q""")
def g_contact_stats(spark, sf):
    p = _pixels(spark, sf)
    named = p.select(F.concat_ws(":", "chrom", "i").alias("bin1"), F.concat_ws(":", "chrom", "j").alias("bin2"), "count")
    bins = spark.range(40).withColumn("chrom", F.explode(F.array(F.lit("c0"), F.lit("c1")))).select(F.concat_ws(":", "chrom", "id").alias("bin"), "chrom", (F.col("id") * 1000).alias("start"))
    return counts.contact_stats(named, bins)


# scalars on text


@query("""SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])(license|copyright|rights)($|[^a-z0-9])') AS legal, len(regexp_extract_all(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+')) AS mails FROM documents""")
def f_keywords(spark, sf):
    d = t(spark, sf, "documents")
    return d.select("doc_id", sc.has_keyword(F.col("text"), ["license", "copyright", "rights"]).alias("legal"), F.regexp_count("text", F.lit(r"[\w.+-]+@[\w-]+\.[\w.]+")).cast("long").alias("mails"))


@query("""SELECT s_suppkey, 'chr' || (s_nationkey % 23) AS chrom, least(s_suppkey * 100, s_suppkey * 90 + 777) AS start, greatest(s_suppkey * 100, s_suppkey * 90 + 777) AS "end", (s_nationkey % 23)::VARCHAR AS contig FROM supplier""")
def f_parse_interval(spark, sf):
    name = F.concat(F.lit("chr"), F.col("s_nationkey") % 23, F.lit(":"), F.col("s_suppkey") * 100, F.lit("-"), F.col("s_suppkey") * 90 + 777)
    p = sc.parse_interval(name)
    return t(spark, sf, "supplier").select("s_suppkey", p["chrom"].alias("chrom"), p["start"].alias("start"), p["end"].alias("end"), sc.canonical_contig(p["chrom"]).alias("contig"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<a ')) AS links, sha256(coalesce(html, '')) AS digest FROM pages""")
def f_pages(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))


# governance


@query("""WITH p AS (SELECT DISTINCT o_orderkey AS node FROM orders WHERE o_orderkey % 3 <> 0), e AS (SELECT l_orderkey AS node, max(CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 2 ELSE 1 END) AS s FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(p.node, e.node) AS node, p.node IS NOT NULL AS planned, e.node IS NOT NULL AS reported, coalesce(CASE e.s WHEN 4 THEN 'ran' WHEN 2 THEN 'skipped' ELSE 'not_run' END, 'not_run') AS status FROM p FULL JOIN e USING (node))
SELECT *, CASE WHEN planned AND status <> 'ran' THEN 'planned_not_run' WHEN NOT planned AND status = 'ran' THEN 'ran_not_planned' END AS divergence FROM j""")
def y_reconcile(spark, sf):
    planned = t(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("node"))
    executed = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "skipped").otherwise("odd").alias("status"), F.lit(True).alias("ran"))
    return governance.reconcile(planned, executed).select("node", "planned", "reported", "status", "divergence")


@query("""WITH s AS (SELECT l_partkey AS entity, l_suppkey AS lineage, min(l_linestatus) AS modality, arg_max(d, abs(d)) AS d FROM (SELECT *, l_discount - 0.05 AS d FROM lineitem) GROUP BY 1, 2)
SELECT entity, count(*) AS lineages, count(DISTINCT modality) AS modalities FROM s GROUP BY 1""")
def y_triangulate(spark, sf):
    s = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("lineage"), F.col("l_linestatus").alias("modality"), (F.col("l_discount") - 0.05).alias("direction"))
    return governance.triangulate(s).select("entity", "lineages", "modalities")


@query("""WITH e AS (SELECT c_custkey AS subject, o_orderpriority AS cat, o_orderstatus = 'F' AS mech FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT subject, count(DISTINCT cat) AS categories, count(DISTINCT CASE WHEN mech THEN cat END) AS lines FROM e GROUP BY 1)
SELECT c_custkey AS claim, CASE WHEN c_acctbal <= 0 THEN 'descriptive' WHEN c_custkey % 10 = 0 AND coalesce(lines, 0) >= 1 THEN 'causal' WHEN lines >= 2 THEN 'strong_mechanistic' WHEN lines = 1 THEN 'weak_mechanistic' ELSE 'associative' END AS tier
FROM customer LEFT JOIN l ON c_custkey = subject""")
def y_classify_claims(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("claim"), F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("n_significant"), F.lit(None).cast("double").alias("power"), F.lit(False).alias("low_power"), F.lit(False).alias("recovered"), (F.col("c_custkey") % 10 == 0).alias("licensed"))
    e = t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("mechanistic"))
    return governance.classify_claims(c, e).select("claim", "tier")


# sampling


@query()
def x_stratified_sample(spark, sf):
    """A stratified sample, which is the feature: the same rows every time."""
    return sampling.stratified(t(spark, sf, "customer"), "c_custkey", "c_mktsegment", 100, 5)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def x_folds_cover_all(spark, sf):
    return sampling.folds(t(spark, sf, "customer"), "c_custkey", "c_mktsegment", 5).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


# event views


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def d_tumbling_windows(spark, sf):
    return rounded(bus.tumbling(t(spark, sf, "events"), "ts", "1 day", ["event_type"], "value"), 4)


@query("""WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""".replace("> INTERVAL", ">= INTERVAL"))
def d_sessions(spark, sf):
    return bus.sessions(t(spark, sf, "events"), "ts", "2 hours", ["user_id"]).select("user_id", "start", "end", "n")


@query("""WITH m AS (SELECT event_id, event_type IN ('error') AS ask, CASE WHEN event_type = 'click' THEN event_id - 1 END AS resolves FROM events)
SELECT event_id::VARCHAR AS id FROM m WHERE ask AND event_id NOT IN (SELECT resolves FROM m WHERE resolves IS NOT NULL)""")
def d_pending_checkpoints(spark, sf):
    e = t(spark, sf, "events")
    log = e.select(F.col("event_id").cast("string").alias("id"), (F.col("event_type") == "error").alias("checkpoint"), F.when(F.col("event_type") == "click", (F.col("event_id") - 1).cast("string")).alias("resolves"))
    return bus.pending(log).select("id")
