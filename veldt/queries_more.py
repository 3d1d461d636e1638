"""More queries over the whole test tables, with their SQL (registered beside those of queries.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import order as o
from veldt.functions import scalars as sc
from veldt.operators import contacts, counts, embedding, governance, joins, models, sequencing, sets, state
from veldt.queries import KNN, MATRIX, UNITS, _matrix, _neighbours, _pixels, _units, query, r, rounded, t

# quality gates and aggregations


@query(f"""{UNITS} SELECT cell, sum(v) AS total_counts, count(*) FILTER (v > 0) AS n_genes, round(CASE WHEN sum(v) > 0 THEN 100 * coalesce(sum(v) FILTER (feature LIKE 'f1%'), 0) / sum(v) ELSE 0 END, 6) AS pct_mt FROM vals GROUP BY 1""")
def p_cell_metrics(spark, sf):
    return rounded(counts.cell_metrics(_units(spark, sf)[0], "^f1"))


@query(f"""{UNITS}, o AS (SELECT l_orderkey AS cell, 'f' || (l_partkey % 50) AS feature, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT cell FROM o WHERE v > 0 GROUP BY 1 HAVING count(*) >= 4), x AS (SELECT * FROM o WHERE cell IN (SELECT cell FROM c)), f AS (SELECT feature FROM x WHERE v > 0 GROUP BY 1 HAVING count(*) >= 30)
SELECT cell, feature, v AS value FROM x WHERE feature IN (SELECT feature FROM f)""")
def p_drop_empty(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return counts.drop_empty(rows, 4, 30).select("cell", "feature", "value")


@query("""WITH m AS (SELECT median(ln(1 + l_extendedprice)) AS dm, median(ln(1 + l_quantity)) AS fm, stddev_pop(ln(1 + l_extendedprice)) AS ds, stddev_pop(ln(1 + l_quantity)) AS fs, count(*) AS n FROM lineitem),
a AS (SELECT median(abs(ln(1 + l_extendedprice) - dm)) AS da, median(abs(ln(1 + l_quantity) - fm)) AS fa FROM lineitem, m),
z AS (SELECT l_orderkey, (ln(1 + l_extendedprice) - dm) / CASE WHEN da > 0 THEN 1.4826 * da ELSE ds END + (ln(1 + l_quantity) - fm) / CASE WHEN fa > 0 THEN 1.4826 * fa ELSE fs END AS s FROM lineitem, m, a)
SELECT l_orderkey, round(s, 6) AS score FROM z""")
def p_doublet_scores(spark, sf):
    df = t(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("depth"), F.col("l_quantity").alias("features"))
    return counts.doublets(df).select("l_orderkey", r("score").alias("score"))


@query("""SELECT feature, n FROM (SELECT 'f' || (l_partkey % 200) AS feature, count(*) FILTER (l_discount > 0) AS n FROM lineitem GROUP BY 1) WHERE n > 250""")
def p_detected(spark, sf):
    df = t(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey") % 200).alias("feature"), F.col("l_discount").alias("value"))
    return counts.detected(df, 250).groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("n"))


@query(f"""{MATRIX} SELECT CASE WHEN sample IN ('s0', 's1', 's2') THEN 'u1' ELSE 'u2' END AS unit, feature, sum(value) AS value FROM m GROUP BY 1, 2""")
def g_sum_replicates(spark, sf):
    m = _matrix(spark, sf)
    samples = m.select("sample").distinct().withColumn("unit", F.when(F.col("sample").isin("s0", "s1", "s2"), "u1").otherwise("u2")).withColumn("arm", F.col("unit"))
    return counts.sum_replicates(m, samples, "unit", ["arm"])[0]


@query(f"""{MATRIX} SELECT feature, sample < 's4' AS "group", round(avg(value), 6) AS mean FROM m GROUP BY 1, 2""")
def g_group_means(spark, sf):
    m = _matrix(spark, sf)
    return rounded(counts.group_means(m, m.select("sample").distinct().withColumn("group", F.col("sample") < "s4")))


@query("""WITH n AS (SELECT s.user_id AS sample, k.event_type AS kind, (SELECT count(*) FROM events e WHERE e.user_id = s.user_id AND e.event_type = k.event_type) AS n FROM (SELECT DISTINCT user_id FROM events) s, (SELECT DISTINCT event_type FROM events) k)
SELECT sample, kind, n, round(ln((n + 1) / (sum(n) OVER (PARTITION BY sample) + 1)), 6) AS log_share FROM n""")
def g_composition(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("kind"))
    return rounded(counts.composition(e))


@query("""SELECT 'l_linestatus' AS factor, max(a) = 1 AND (SELECT count(DISTINCT l_linestatus) > 1 FROM lineitem) AS confounded FROM (SELECT count(DISTINCT l_returnflag) AS a FROM lineitem GROUP BY l_linestatus)
UNION ALL SELECT 'own', max(a) = 1 FROM (SELECT count(DISTINCT l_returnflag) AS a FROM lineitem GROUP BY l_returnflag || 'x')""")
def g_confounded(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("own", F.concat("l_returnflag", F.lit("x")))
    return counts.confounded(li, ["l_linestatus", "own"], "l_returnflag")


@query("""WITH n AS (SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1) SELECT count(*) AS arms, min(n) AS least, round(min(n) / max(n), 9) AS ratio FROM n""")
def g_balance(spark, sf):
    return rounded(counts.balance(t(spark, sf, "customer"), "c_mktsegment", "c_nationkey"), 9)


@query("""WITH j AS (SELECT o_orderkey, o_orderstatus AS truth, o_orderkey % 4 = 0 AS ab, x.a AS answer, x.o IS NOT NULL AS given, coalesce(x.o % 5 = 0, false) AS abst, coalesce(x.o % 2 = 0, false) AS ver
  FROM orders LEFT JOIN (SELECT l_orderkey AS o, max(l_linestatus) AS a FROM lineitem WHERE l_quantity > 25 GROUP BY 1) x ON o_orderkey = x.o),
s AS (SELECT *, given AND NOT abst AS said FROM j), g AS (SELECT *, (said AND NOT ab AND answer = truth AND ver) OR (given AND abst AND ab) AS good FROM s)
SELECT count(*) AS n, count(*) FILTER (good) AS correct, count(*) FILTER (said AND NOT good) AS confidently_wrong, count(*) FILTER (given AND abst) AS abstained, count(*) FILTER (NOT given) AS missing, round(count(*) FILTER (good) / count(*), 9) AS accuracy FROM g""")
def g_score_predictions(spark, sf):
    tasks = t(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("truth"), (F.col("o_orderkey") % 4 == 0).alias("should_abstain"))
    p = t(spark, sf, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.max("l_linestatus").alias("answer")).withColumns({"abstained": F.col("task_id") % 5 == 0, "verified": F.col("task_id") % 2 == 0})
    return rounded(counts.score_predictions(tasks, p), 9)


@query("""WITH n AS (SELECT l_orderkey AS unit, l_returnflag AS label, count(*) AS k FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(k) OVER (PARTITION BY unit) AS m FROM n), f AS (SELECT * FROM m WHERE m > 1),
o AS (SELECT sum(k) AS n, sum(k * (m - k) / (m - 1)) AS d FROM f), e AS (SELECT sum(c * c) AS s FROM (SELECT label, sum(k) AS c FROM f GROUP BY 1)) SELECT round(1 - d / ((n * n - s) / (n - 1)), 9) AS alpha FROM o, e""")
def g_krippendorff(spark, sf):
    return rounded(counts.krippendorff_alpha(t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag"), 9)


@query("""SELECT event_type, u AS label, n FROM (SELECT event_type, user_id % 7 AS u, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, u) = 1""")
def g_majority(spark, sf):
    return counts.majority(t(spark, sf, "events").withColumn("label", F.col("user_id") % 7), "event_type", "label").select("event_type", "label", "n")


@query("""SELECT l_suppkey AS claim, count(*) AS variants, round(avg((l_discount > 0.02)::INT), 9) AS supported, round(greatest(avg((l_tax > 0.04)::INT), avg((l_tax < 0.04)::INT)), 9) AS sign_agreement, bool_and(l_discount > 0.02) AS robust FROM lineitem GROUP BY 1""")
def g_multiverse(spark, sf):
    df = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("claim"), (F.col("l_discount") > 0.02).alias("supported"), F.when(F.col("l_tax") > 0.04, 1).when(F.col("l_tax") < 0.04, -1).otherwise(0).alias("effect"))
    return rounded(counts.multiverse(df), 9)


FRAGMENTS = "WITH f AS (SELECT 'c' || (l_suppkey % 3) AS chrom, l_partkey * 10 AS s, l_partkey * 10 + 40 + (l_linenumber * 60) AS e, 'b' || (l_orderkey % 20) AS barcode FROM lineitem)"


def _fragments(spark, sf):
    return t(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("chrom"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + 40 + F.col("l_linenumber") * 60).alias("end"), F.concat(F.lit("b"), F.col("l_orderkey") % 20).alias("barcode"))


@query(f"""{FRAGMENTS} SELECT count(*) AS n, round(count(*) FILTER (e - s < 100) / count(*), 9) AS nucleosome_free, round(count(*) FILTER (e - s BETWEEN 180 AND 247) / count(*), 9) AS mono, round(count(*) FILTER (e - s BETWEEN 315 AND 473) / count(*), 9) AS di,
  count(DISTINCT barcode) AS barcodes, round(count(*) FILTER (chrom = 'c0') / count(*), 9) AS mito, round(1 - count(DISTINCT (chrom, s, e, barcode)) / count(*), 9) AS duplicates FROM f""")
def g_fragment_sizes(spark, sf):
    return rounded(counts.fragment_sizes(_fragments(spark, sf), ("c0",)), 9)


@query(f"""{FRAGMENTS}, p AS (SELECT 'c' || (p_partkey % 3) AS chrom, p_partkey * 10 + 5 AS s, p_partkey * 10 + 9 AS e FROM part WHERE p_size < 5)
SELECT barcode, count(*) AS fragments, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.chrom = f.chrom AND p.s < f.e AND p.e > f.s)) AS in_peaks, round(count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.chrom = f.chrom AND p.s < f.e AND p.e > f.s)) / count(*), 9) AS frip
FROM f GROUP BY 1 HAVING count(*) >= 20""")
def g_frip_by_barcode(spark, sf):
    peaks = t(spark, sf, "part").where("p_size < 5").select(F.concat(F.lit("c"), F.col("p_partkey") % 3).alias("chrom"), (F.col("p_partkey") * 10 + 5).alias("start"), (F.col("p_partkey") * 10 + 9).alias("end"))
    return rounded(counts.frip(_fragments(spark, sf), peaks, ["barcode"], 20), 9).select("barcode", "fragments", "in_peaks", "frip")


# order


@query("""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderpriority IS NOT NULL) AS o_orderpriority, min(o_orderkey) AS o_orderkey, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY 1""")
def w_first_values(spark, sf):
    df = t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", (F.col("o_orderstatus") == "P").alias("open"))
    return o.first_values(df, ["o_custkey"], [F.col("o_orderkey")], ["open"])


@query("""SELECT o_orderkey, round(avg(o_totalprice) OVER w * count(*) OVER w * 100)::BIGINT AS cents FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def w_running_mean(spark, sf):
    """The running mean times the rows so far, in whole cents: no last digit to round."""
    n = F.count("*").over(o.Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(o.FIRST, 0))
    return t(spark, sf, "orders").select("o_orderkey", F.round(o.running_mean("o_totalprice", ["o_custkey"], [F.col("o_orderkey")]) * n * 100).cast("long").alias("cents"))


@query("""WITH b AS (SELECT l_suppkey AS c, l_partkey % 100 AS s, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), k AS (SELECT *, s - row_number() OVER (PARTITION BY c ORDER BY s) AS grp FROM b)
SELECT c AS chrom, min(s) AS start, max(s) + 1 AS "end", sum(score) AS auc, max(score) AS max_score FROM k GROUP BY c, grp""")
def w_signal_blocks(spark, sf):
    b = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("chrom"), (F.col("l_partkey") % 100).alias("start")).agg(F.max("l_quantity").alias("score")).withColumn("end", F.col("start") + 1)
    return o.signal_blocks(b, ["chrom"]).select("chrom", "start", "end", "auc", "max_score")


@query("""WITH s AS (SELECT upper(p_name) AS gene, max(p_retailprice) AS score FROM part GROUP BY 1) SELECT gene, score, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM s""")
def w_signature(spark, sf):
    return o.signature(t(spark, sf, "part").select(F.col("p_name").alias("gene"), F.col("p_retailprice").alias("score")))


# joins


@query("""WITH c AS (SELECT DISTINCT l_suppkey % 30 AS s FROM lineitem) SELECT f.f AS feature, s.s AS sample, coalesce(sum(l_quantity), 0) AS value FROM (SELECT DISTINCT l_partkey % 40 AS f FROM lineitem WHERE l_returnflag = 'R') f CROSS JOIN (SELECT DISTINCT l_suppkey % 30 AS s FROM lineitem WHERE l_returnflag = 'R') s
LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l.l_partkey % 40 = f.f AND l.l_suppkey % 30 = s.s GROUP BY 1, 2""")
def j_outer_counts(spark, sf):
    li = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_partkey") % 40).alias("feature"), (F.col("l_suppkey") % 30).alias("sample"), F.col("l_quantity").alias("value"))
    return joins.outer_counts([li.where("sample < 15"), li.where("sample >= 15")])


@query("""SELECT p_partkey AS barcode, CASE WHEN p_size % 4 = 0 THEN 'unassigned' ELSE p_brand END AS label FROM part""")
def j_join_labels(spark, sf):
    part = t(spark, sf, "part")
    q = part.select(F.concat(F.col("p_partkey"), F.lit("-1")).alias("barcode"))
    ref = part.select(F.col("p_partkey").cast("string").alias("barcode"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_brand")).alias("label"))
    out = joins.join_labels(q, ref, [lambda x: x, lambda x: F.regexp_replace(x, r"-\d+$", "")])
    return out.select(F.regexp_replace("barcode", r"-\d+$", "").cast("long").alias("barcode"), "label")


@query("""WITH a AS (SELECT 'orders' AS c, o_custkey AS v FROM orders UNION SELECT 'part', p_partkey FROM part), b AS (SELECT 'customer' AS b, c_custkey AS v FROM customer UNION SELECT 'supplier', s_suppkey FROM supplier),
n AS (SELECT c, b, count(*) AS shared FROM (SELECT DISTINCT * FROM a) JOIN (SELECT DISTINCT * FROM b) USING (v) GROUP BY 1, 2), z AS (SELECT c, count(DISTINCT v) AS n FROM a GROUP BY 1)
SELECT n.c AS "column", b AS b_column, shared, z.n AS n FROM n JOIN z ON n.c = z.c WHERE shared >= 2 AND shared >= 0.5 * z.n QUALIFY row_number() OVER (PARTITION BY n.c ORDER BY shared DESC, b) = 1""")
def j_best_name_match(spark, sf):
    side = lambda name, tb, c: t(spark, sf, tb).select(F.lit(name).alias("column"), F.col(c).alias("value"))
    a = side("orders", "orders", "o_custkey").union(side("part", "part", "p_partkey"))
    b = side("customer", "customer", "c_custkey").union(side("supplier", "supplier", "s_suppkey"))
    return joins.best_name_match(a, b)


@query("""WITH a AS (SELECT l_partkey AS key, max(l_discount) AS e, count(*) FILTER (l_tax < 0.02) > 0 AS ok FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS key, max(l_discount) AS e, count(*) FILTER (l_tax < 0.02) > 0 AS ok FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT a.key, a.e AS effect, b.e AS b_effect FROM a JOIN b USING (key) WHERE a.ok AND b.ok""")
def j_matched_effects(spark, sf):
    def side(flag):
        return t(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_discount").alias("effect"), F.max(F.when(F.col("l_tax") < 0.02, 0.01)).alias("padj")).withColumn("known", F.lit(False))

    return joins.matched_effects(side("A"), side("R")).select("key", "effect", "b_effect")


@query("""SELECT DISTINCT trim(regexp_replace(lower(a.p_type), '[^a-z0-9]+', ' ', 'g')) AS key FROM part a JOIN part b ON trim(regexp_replace(lower(a.p_type), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(replace(b.p_type, ' ', '_')), '[^a-z0-9]+', ' ', 'g')) WHERE a.p_size < 5 AND b.p_size > 45""")
def j_shared_terms(spark, sf):
    p = t(spark, sf, "part")
    a, b = p.where("p_size < 5").select(F.col("p_type").alias("term")), p.where("p_size > 45").select(F.replace("p_type", F.lit(" "), F.lit("_")).alias("term"))
    return joins.shared_terms(a, b).select("key")


# sets and order of results


@query(f"""{KNN}, l AS (SELECT id, list(neighbour) AS n FROM k GROUP BY 1), m AS (SELECT (id * 7) % (SELECT count(*) FROM embeddings) AS id, n FROM l)
SELECT a.id AS cell, round(len(list_intersect(a.n, b.n)) / len(list_distinct(a.n || b.n)), 9) AS jaccard, round(len(list_intersect(a.n, b.n)) / len(b.n), 9) AS recall FROM l a JOIN m b USING (id)""")
def e_neighbour_overlap(spark, sf):
    edges, labels = _neighbours(spark, sf)
    n = labels.count()
    a = edges.groupBy(F.col("id").alias("cell")).agg(F.collect_list("neighbour").alias("neighbours"))
    b = a.withColumn("cell", F.col("cell") * 7 % n)
    return rounded(sets.neighbour_overlap(a, b), 9)


@query("""SELECT p_brand, 'removed' AS change, count(*) AS n FROM (SELECT p_brand, p_type FROM part WHERE p_size < 30 EXCEPT ALL SELECT p_brand, p_type FROM part WHERE p_size > 20) GROUP BY 1
UNION ALL SELECT p_brand, 'added', count(*) FROM (SELECT p_brand, p_type FROM part WHERE p_size > 20 EXCEPT ALL SELECT p_brand, p_type FROM part WHERE p_size < 30) GROUP BY 1""")
def e_changed_rows(spark, sf):
    p = t(spark, sf, "part")
    return sets.changed_rows(p.where("p_size < 30").select("p_brand", "p_type"), p.where("p_size > 20").select("p_brand", "p_type")).groupBy("p_brand", "change").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS name FROM nation UNION SELECT r_name FROM region""")
def e_term_universe(spark, sf):
    return sets.term_universe(t(spark, sf, "nation").select(F.col("n_name").alias("name")), t(spark, sf, "region").select(F.col("r_name").alias("name")), "name")


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def e_orphans(spark, sf):
    return sets.orphans(t(spark, sf, "customer"), t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH g AS (SELECT l_returnflag AS contrast, 'f' || l_partkey AS gene, min(l_tax) AS padj, max(l_discount) AS log2fc FROM lineitem GROUP BY 1, 2)
SELECT contrast, gene, rank FROM (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY padj, abs(log2fc) DESC, gene) AS rank FROM g) WHERE rank <= 30""")
def l_top_genes(spark, sf):
    g = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("contrast"), F.concat(F.lit("f"), "l_partkey").alias("gene")).agg(F.min("l_tax").alias("padj"), F.max("l_discount").alias("log2fc"))
    return sets.top_genes(g).select("contrast", "gene", F.col("rank").cast("long").alias("rank"))


# scalars


@query("""SELECT o_orderkey, sha256(concat_ws(chr(31), '=' || o_orderkey, coalesce('=' || nullif(o_orderstatus, 'P'), '-'))) AS digest FROM orders""")
def f_digest(spark, sf):
    return t(spark, sf, "orders").withColumn("s", F.expr("nullif(o_orderstatus, 'P')")).select("o_orderkey", sc.digest("o_orderkey", "s").alias("digest"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, ts >= TIMESTAMP '2024-01-15' - INTERVAL 90 SECOND AS recent FROM events""")
def f_json_and_since(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), sc.since(F.col("ts").cast("string"), "2024-01-15 00:00:00", 90).alias("recent"))


@query("""SELECT p_partkey, reverse(translate(p_name, 'ACGTacgt', 'TGCAtgca')) AS rc, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def f_text_transforms(spark, sf):
    return t(spark, sf, "part").select("p_partkey", sc.reverse_complement(F.col("p_name")).alias("rc"), sc.slug(F.col("p_type")).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN abs(length(p_name) - length(p_brand)) = 0 THEN hamming(p_name, p_brand) <= 1 ELSE false END AS close FROM part""")
def f_within_one_mismatch(spark, sf):
    return t(spark, sf, "part").select("p_partkey", sc.within_one_mismatch(F.col("p_name"), F.col("p_brand")).alias("close"))


# models


@query("""WITH d AS (SELECT l_partkey % 40 AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT *, avg(x) OVER (PARTITION BY k) AS mx, avg(y) OVER (PARTITION BY k) AS my, count(*) OVER (PARTITION BY k) AS n FROM d),
s AS (SELECT *, sum((x - mx) ^ 2) OVER (PARTITION BY k) AS sxx, sum((x - mx) * (y - my)) OVER (PARTITION BY k) AS sxy FROM m),
e AS (SELECT *, (x - mx) * ((y - my) - sxy / sxx * (x - mx)) / (1 - (1.0 / n + (x - mx) ^ 2 / sxx)) AS u FROM s)
SELECT k, max(n) AS n, round(max(sxy / sxx), 4) AS slope, round(sqrt(sum(u * u)) / max(sxx), 4) AS se FROM e GROUP BY 1""")
def m_ols_hc3(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("k", F.col("l_partkey") % 40)
    return models.ols_hc3(d, ["k"], "l_quantity", "l_extendedprice").select("k", "n", r("slope", 4).alias("slope"), r("se", 4).alias("se"))


@query("""WITH a AS (SELECT l_partkey AS f, avg(l_extendedprice) AS x, max(l_tax) > 0.07 AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS f, avg(l_extendedprice) AS x, max(l_tax) > 0.07 AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT count(*) AS n, round(corr(a.x, b.x), 9) AS r, round(avg((sign(a.x) = sign(b.x))::INT), 9) AS sign_agreement, round(count(*) FILTER (a.s AND b.s) / count(*) FILTER (a.s), 9) AS precision, round(count(*) FILTER (a.s AND b.s) / count(*) FILTER (a.s OR b.s), 9) AS jaccard FROM a JOIN b USING (f)""")
def m_effect_concordance(spark, sf):
    a, b = (t(spark, sf, "lineitem").where(F.col("l_returnflag") == k).groupBy(F.col("l_partkey").alias("feature")).agg(F.avg("l_extendedprice").alias("effect"), (F.max("l_tax") > 0.07).alias("significant")) for k in "AR")
    return rounded(models.effect_concordance(a, b), 9)


@query("""WITH s AS (SELECT s_suppkey % 9 AS unit, sum(s_acctbal + 10000) AS x FROM supplier GROUP BY 1) SELECT unit, round(x / exp((SELECT avg(ln(x)) FROM s)), 9) AS size_factor FROM s""")
def m_spike_in_factors(spark, sf):
    s = t(spark, sf, "supplier").select((F.col("s_suppkey") % 9).alias("unit"), (F.col("s_acctbal") + 10000).alias("exposure"))
    return rounded(models.spike_in_factors(s), 9)


# vectors, reads, contacts


@query(f"""{KNN}, v AS (SELECT id, lb AS label, count(*) AS n FROM k GROUP BY 1, 2) SELECT id, label, round(n / 5, 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""")
def v_transfer_labels(spark, sf):
    edges, labels = _neighbours(spark, sf)
    return rounded(embedding.transfer_labels(edges, labels))


@query(f"""{KNN}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), pr AS (SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS e FROM k GROUP BY 1, 2), t AS (SELECT count(*) AS t FROM k), s AS (SELECT count(*) AS s FROM embeddings)
SELECT a, b, e AS edges, round(e / (2.0 * t * x.n * y.n / (s * s)), 6) AS connectivity FROM pr JOIN n x ON x.label = a JOIN n y ON y.label = b, t, s WHERE a <> b""")
def v_cluster_connectivity(spark, sf):
    edges, labels = _neighbours(spark, sf)
    return rounded(embedding.cluster_connectivity(edges, labels))


@query(f"""{MATRIX} SELECT feature, sample, round(CASE WHEN stddev_samp(value) OVER (PARTITION BY feature) > 0 THEN (value - avg(value) OVER (PARTITION BY feature)) / stddev_samp(value) OVER (PARTITION BY feature) ELSE 0 END, 6) AS scaled FROM m""")
def v_scaled(spark, sf):
    return rounded(embedding.scaled(_matrix(spark, sf)).select("feature", "sample", "scaled"))


@query(f"""{MATRIX}, b AS (SELECT DISTINCT feature, p_brand AS motif FROM m JOIN part ON feature = 'f' || p_partkey), d AS (SELECT sample AS cell, sum(value) AS d FROM m GROUP BY 1), tt AS (SELECT sum(value) AS t FROM m),
p AS (SELECT motif, sum(value) / (SELECT t FROM tt) AS share FROM m JOIN b USING (feature) GROUP BY 1), o AS (SELECT sample AS cell, motif, sum(value) AS o FROM m JOIN b USING (feature) GROUP BY 1, 2)
SELECT d.cell, p.motif, round((coalesce(o.o, 0) - d * share) / (d * share), 6) AS deviation FROM d CROSS JOIN p LEFT JOIN o ON o.cell = d.cell AND o.motif = p.motif""")
def v_deviations(spark, sf):
    members = t(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey").alias("feature"), F.col("p_brand").alias("motif")).distinct()
    return rounded(embedding.deviations(_matrix(spark, sf).withColumnRenamed("sample", "cell"), members))


@query(f"""{FRAGMENTS}, p AS (SELECT DISTINCT 'c' || (p_partkey % 3) AS chrom, p_partkey * 10 + 5 AS s, p_partkey * 10 + 9 AS e FROM part WHERE p_size < 5)
SELECT barcode AS cell, p.chrom || ':' || p.s || '-' || p.e AS peak, count(*) AS value FROM f JOIN p ON p.chrom = f.chrom AND p.s < f.e AND p.e > f.s GROUP BY 1, 2""")
def h_fragments_to_matrix(spark, sf):
    peaks = t(spark, sf, "part").where("p_size < 5").select(F.concat(F.lit("c"), F.col("p_partkey") % 3).alias("chrom"), (F.col("p_partkey") * 10 + 5).alias("start"), (F.col("p_partkey") * 10 + 9).alias("end"))
    return sequencing.fragments_to_matrix(_fragments(spark, sf), peaks)[0].select("cell", "peak", F.col("value").cast("long").alias("value"))


@query("""SELECT o_orderkey, round(len(regexp_replace(upper(c), '[^GC]', '', 'g')) / len(regexp_replace(upper(c), '[^ACGT]', '', 'g')), 9) AS gc FROM (SELECT o_orderkey, o_orderpriority || 'ACG' AS c FROM orders)""")
def h_gc_share(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("ACG")).alias("sequence"))
    return rounded(sequencing.gc_share(df).select("o_orderkey", "gc"), 9)


@query("""SELECT 's' || (s_suppkey % 4) AS sample, 'f' || (l_partkey % 9) AS feature, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def h_demultiplex(spark, sf):
    c = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("barcode"), F.concat(F.lit("f"), F.col("l_partkey") % 9).alias("feature"), F.col("l_quantity").alias("value"))
    return sequencing.demultiplex(c, t(spark, sf, "supplier").select(F.col("s_suppkey").alias("barcode"), F.concat(F.lit("s"), F.col("s_suppkey") % 4).alias("sample")))


@query()
def h_umi_dedup(spark, sf):
    """A directional collapse, whose graph SQL lacks; the tests hold it against cases worked by hand."""
    li = t(spark, sf, "lineitem")
    umi = F.translate(F.lpad(F.conv((F.col("l_suppkey") % 64).cast("string"), 10, 4), 3, "0"), "0123", "ACGT")
    reads = li.select(F.lit("c").alias("chrom"), F.col("l_returnflag").alias("strand"), (F.col("l_partkey") % 50).alias("anchor"), umi.alias("umi"), F.col("l_orderkey").cast("string").alias("name"), F.col("l_quantity").cast("int").alias("mapq"), F.col("l_linenumber").alias("quality"))
    return sequencing.umi_dedup(reads)


@query()
def c_ice_weights(spark, sf):
    """Balancing by rounds; the tests check that the balanced marginals agree."""
    return rounded(contacts.ice_weights(_pixels(spark, sf), 20), 6)


# governance and state


@query("""WITH s AS (SELECT l_returnflag AS c, l_partkey % 300 AS g, sign(avg(l_discount) - 0.05) AS s FROM lineitem GROUP BY 1, 2 HAVING min(l_tax) < 0.005)
SELECT a.c AS a, b.c AS b, count(*) AS shared, count(*) FILTER (a.s = b.s) AS same, count(*) FILTER (a.s <> b.s) AS opposite FROM s a JOIN s b USING (g) WHERE a.c < b.c GROUP BY 1, 2""")
def y_contrast_patterns(spark, sf):
    g = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("contrast"), (F.col("l_partkey") % 300).alias("gene")).agg((F.avg("l_discount") - 0.05).alias("log2fc"), F.min("l_tax").alias("padj"))
    return governance.contrast_patterns(g, 0.005)


@query("""SELECT o_orderkey AS claim, CASE WHEN o_orderstatus = 'P' THEN 'no_claim' WHEN l.k IS NOT NULL AND l.ok THEN 'published' ELSE 'withheld' END AS state,
  CASE WHEN o_orderstatus <> 'P' AND NOT coalesce(l.ok, false) THEN CASE WHEN l.k IS NOT NULL THEN 'weak' ELSE 'not verified' END END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_quantity) > 30 AS ok FROM lineitem GROUP BY 1) l ON o_orderkey = l.k""")
def y_publish(spark, sf):
    claims = t(spark, sf, "orders").select(F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderstatus") == "P", "").otherwise("text").alias("text"))
    v = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg((F.max("l_quantity") > 30).alias("supported"), F.lit("weak").alias("reason"))
    return governance.publish(claims, v).select("claim", "state", "reason")


@query("""SELECT count(o_custkey) AS n_a, count(DISTINCT o_custkey) AS d_a, (SELECT count(c_custkey) FROM customer) AS n_b, (SELECT count(DISTINCT c_custkey) FROM customer) AS d_b,
  (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey) AS shared, false AS holds FROM orders""")
def y_same_cells(spark, sf):
    return governance.same_cells(t(spark, sf, "orders").select(F.col("o_custkey").alias("cell")), t(spark, sf, "customer").select(F.col("c_custkey").alias("cell")))


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first, o_orderpriority) - 1 AS idx FROM f)
SELECT o.o_orderkey AS seq, i.idx AS index, o.o_orderkey <> i.first AS replay, CASE WHEN o.o_orderkey <> i.first THEN 'replay' WHEN i.idx = 0 THEN 'primary' ELSE 'post_hoc_fork' END AS kind FROM orders o JOIN i USING (o_custkey, o_orderpriority)""")
def r_fork_index(spark, sf):
    log = t(spark, sf, "orders").select(F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("spec"))
    return state.fork_index(log).select("seq", F.col("index").cast("long").alias("index"), "replay", "kind")
