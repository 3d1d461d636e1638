"""Queries that reach single operators over the whole test tables, with their SQL: plans and their refusals, scalars, gates, joins, order, governance, state, files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from veldt.functions import order as o
from veldt.functions import scalars as sc
from veldt.functions.special import hypergeometric_p
from veldt.operators import counts, governance, intervals, joins, models, sampling, sets, state
from veldt.plans.execute import execute
from veldt.plans.model import GovernedTable, PlanViolation, TableContract, hash_params, parse_plan
from veldt.plans.registry import Registry
from veldt.queries import query, r, rounded, t
from veldt.sources import readers, writers


def _folder(spark) -> str:
    """A new folder that driver and executors share; only a local master may do without spark.checkpoint.dir."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veldt-files-")
    return f"{base}/files-{uuid.uuid4().hex}"


def _refused(run) -> bool:
    try:
        run()
    except PlanViolation:
        return True
    return False


# plans


@query("""SELECT o_orderkey FROM orders WHERE false""")
def q_filter_in_nothing(spark, sf):
    plan = parse_plan({"base_table_id": "orders", "steps": [{"step": "filter", "column": "o_orderstatus", "operator": "in", "value": []}, {"step": "project", "columns": ["o_orderkey"]}]})
    return execute(plan, {"orders": GovernedTable.of(t(spark, sf, "orders"), "orders", "order", "o_orderkey")}).df


@query("""SELECT * FROM (VALUES ('1:1', false), ('m:1', false), ('1:1 of many', true), ('1:m', false), ('left key repeats', true), ('right key repeats', true), ('unknown column', true), ('no ledger node', true), ('no key', true), ('unknown step', true)) v("case", refused)""")
def q_refusals(spark, sf):
    """Joins over the whole tables whose cardinality holds or not, tables whose keys do, contracts and steps: which are refused."""
    orders = GovernedTable.of(t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "orders", "order", "o_orderkey")
    customers = GovernedTable.of(t(spark, sf, "customer"), "customers", "order", "c_custkey")
    totals = GovernedTable.of(t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total")), "totals", "order", "c_custkey")
    lines = GovernedTable.of(t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "lines", "order", "o_orderkey")
    tables = {x.contract.table_id: x for x in (orders, customers, totals, lines)}

    def join(left, right, on, kind, how="inner"):
        plan = parse_plan({"base_table_id": left, "steps": [{"step": "validated_join", "right_table_id": right, "on": on, "how": how, "expected_cardinality": kind}]})
        return _refused(lambda: execute(plan, tables).df.schema)

    rows = [
        ("1:1", join("totals", "customers", "c_custkey", "1:1")), ("m:1", join("orders", "customers", "c_custkey", "m:1")), ("1:1 of many", join("orders", "customers", "c_custkey", "1:1")), ("1:m", join("customers", "orders", "c_custkey", "1:m")),
        ("left key repeats", join("lines", "orders", "o_orderkey", "m:1")), ("right key repeats", join("orders", "lines", "o_orderkey", "1:1")),
        ("unknown column", _refused(lambda: execute(parse_plan({"base_table_id": "orders", "steps": [{"step": "project", "columns": ["nowhere"]}]}), tables).df.schema)),
        ("no ledger node", _refused(lambda: TableContract("x", "order", ("k",), "elsewhere"))), ("no key", _refused(lambda: TableContract("x", "order", (), "ledger://x"))),
        ("unknown step", _refused(lambda: parse_plan({"base_table_id": "orders", "steps": [{"step": "explode"}]}))),
    ]
    return spark.createDataFrame(rows, "case string, refused boolean")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000""")
def q_text_literal_on_a_number(spark, sf):
    reg = Registry(spark)
    reg.register("orders", t(spark, sf, "orders"), "order", ["o_custkey", "o_orderkey"])
    return reg.run({"base_table_id": "orders", "steps": [{"step": "filter", "column": "o_totalprice", "operator": ">=", "value": "300000"}, {"step": "project", "columns": ["o_orderkey", "o_totalprice"]}]}).df


@query("""SELECT 'o_orderkey' AS key, 50 AS shown, (SELECT count(*) > 50 FROM orders WHERE o_orderstatus = 'O') AS truncated, 'derived_open' AS registered, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n, (SELECT sum(o_custkey) FROM orders WHERE o_orderstatus = 'O')::BIGINT AS custkeys""")
def q_registered_result(spark, sf):
    """A key found among candidates (the first repeats), a receipt cut at 50 rows, and the whole result as a table of its own."""
    reg = Registry(spark)
    key = reg.register("orders", t(spark, sf, "orders"), "order", ["o_custkey", "o_orderkey"]).contract.primary_key[0]
    got = reg.query({"base_table_id": "orders", "steps": [{"step": "filter", "column": "o_orderstatus", "operator": "==", "value": "O"}]}, 900, "open")
    new = got["registered_table_id"]
    return reg.tables[new].df.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys")).select(F.lit(key).alias("key"), F.lit(len(got["rows_shown"])).alias("shown"), F.lit(got["rows_truncated"]).alias("truncated"), F.lit(new).alias("registered"), "n", "custkeys")


@query("""SELECT sha256('{"a":{"b":[1,"x"],"c":null},"z":2.5}') AS digest, true AS same""")
def q_parameter_digest(spark, sf):
    one, two = hash_params({"z": 2.5, "a": {"c": None, "b": [1, "x"]}}), hash_params({"a": {"b": [1, "x"], "c": None}, "z": 2.5})
    return spark.createDataFrame([(one, one == two)], "digest string, same boolean")


# scalars


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(regexp_replace(n, '\\(.*?\\)', '', 'g'), '::'), lambda e: upper(trim(e))), lambda e: e <> ''), '|') AS members, regexp_replace(upper(replace(p_brand, '#', '')), '[-_]?\\d+[A-Z]?$', '') AS stem
FROM (SELECT *, p_brand || '::' || p_type || '(var.2):: ' AS n FROM part)""")
def f_subunits(spark, sf):
    name = F.concat("p_brand", F.lit("::"), "p_type", F.lit("(var.2):: "))
    return t(spark, sf, "part").select("p_partkey", F.array_join(sc.subunits(name), "|").alias("members"), sc.family_stem(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("stem"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS numerator, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS denominator FROM orders""")
def f_contrast_arms(spark, sf):
    arms = sc.contrast_arms(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, "_vs_").otherwise(" "), "o_orderpriority"))
    return t(spark, sf, "orders").select("o_orderkey", arms["numerator"].alias("numerator"), arms["denominator"].alias("denominator"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 4 THEN -1.5e3 END AS x FROM orders""")
def f_finite(spark, sf):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, "NaN").when(k == 2, "Infinity").when(k == 3, "n/a").otherwise("-1.5e3")
    return t(spark, sf, "orders").select("o_orderkey", sc.finite(text).alias("x"))


@query("""SELECT c_custkey, regexp_replace(lower(c_name || '_Rep-' || (c_custkey % 4)), '[^a-z0-9]', '', 'g') AS key, c_mktsegment AS "group" FROM customer""")
def f_sample_names(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", sc.sample_key(F.concat("c_name", F.lit("_Rep-"), F.col("c_custkey") % 4)).alias("key"), sc.sample_group(F.concat("c_mktsegment", F.lit("_rep"), F.col("c_custkey") % 4 + 1)).alias("group"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ACG' || (event_id % 7) END AS umi FROM events""")
def f_umi(spark, sf):
    read = F.concat(F.lit("read"), "event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("_x_ACG"), F.col("event_id") % 7)).otherwise(""))
    return t(spark, sf, "events").select("event_id", sc.umi_of(read).alias("umi"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'causes' WHEN 1 THEN '' WHEN 2 THEN 'causes,drives' ELSE 'drives' END AS hits, CASE event_id % 4 WHEN 0 THEN 'STAT-3' WHEN 1 THEN '' WHEN 2 THEN 'TP53' ELSE 'MYC' END AS names FROM events""")
def f_causal_phrases(spark, sf):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "It causes STAT-3 loss.").when(k == 1, "This never really causes harm.").when(k == 2, "TP53 causes it and drives it").otherwise("MYC drives; it is not what causes it")
    return t(spark, sf, "events").select("event_id", F.array_join(sc.unnegated(text, ["causes", "drives"]), ",").alias("hits"), F.array_join(sc.entities(text), ",").alias("names"))


@query("""SELECT event_id, 3::INTEGER AS sentences, round(round(value, 2) + event_id, 2) AS total FROM (SELECT event_id, value FROM events WHERE value IS NOT NULL)""")
def f_sentences_and_numbers(spark, sf):
    e = t(spark, sf, "events").where("value is not null")
    text = F.concat(F.lit("Seen "), F.round("value", 2).cast("string"), F.lit(" of it. Why? Case "), "event_id", F.lit(", not x9!"))
    return e.select("event_id", F.size(sc.sentences(text)).alias("sentences"), F.round(F.aggregate(sc.numbers(text), F.lit(0.0), lambda s, x: s + x), 2).alias("total")).withColumn("total", r("total", 2))


@query("""SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'identifying' WHEN 1 THEN 'quasi' ELSE 'none' END AS kind FROM events""")
def f_sensitive_fields(spark, sf):
    k = F.col("user_id") % 3
    return t(spark, sf, "events").select("event_id", sc.sensitivity(F.concat("event_type", F.when(k == 0, "PatientName").when(k == 1, "_age").otherwise("Count"))).alias("kind"))


@query("""SELECT event_id, 'at <path> by <email> with token=<redacted> on ' || event_type AS text FROM events""")
def f_redacted(spark, sf):
    text = F.concat(F.lit("at /home/u"), "user_id", F.lit("/x by a.b"), "user_id", F.lit("@mail.org with token=k"), "event_id", F.lit(" on "), "event_type")
    return t(spark, sf, "events").select("event_id", sc.redact_text(text).alias("text"))


@query("""SELECT p_partkey, 'G' || p_partkey AS gene_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS gene_name, 'GSE' || (10000 + p_partkey) AS accession, 'GSE' || ((10000 + p_partkey) // 1000) || 'nnn' AS folder FROM part""")
def f_attributes_and_accessions(spark, sf):
    text = F.concat(F.lit('gene_id "G'), "p_partkey", F.lit('"; level 2;'), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' gene_name "'), "p_brand", F.lit('";'))).otherwise(""))
    gse = F.concat(F.lit("GSE"), F.col("p_partkey") + 10000)
    found = sc.accessions(F.concat(F.lit("see "), gse, F.lit(", again "), gse, F.lit(" not GSX1")))
    return t(spark, sf, "part").select("p_partkey", sc.gtf_attribute(text, "gene_id").alias("gene_id"), sc.gtf_attribute(text, "gene_name").alias("gene_name"), F.array_join(found, ",").alias("accession"), sc.accession_folder(gse).alias("folder"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS count FROM lineitem""")
def f_undo_lognorm(spark, sf):
    library = F.lit(5000.0)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sc.undo_lognorm(F.log1p(F.col("l_quantity") / library * 1e4), library).alias("count"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events""")
def f_json_safe(spark, sf):
    bad = F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return sc.json_safe(t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, bad).otherwise(F.col("value")).alias("value")))


@query("""SELECT event_id, (json_extract(props, '$.k')::BIGINT + i) AS k FROM events, (SELECT unnest([0, 1]) AS i) WHERE props IS NOT NULL""")
def f_nested_rows(spark, sf):
    e = t(spark, sf, "events").where("props is not null")
    more = F.concat(F.lit('[{"k": '), F.get_json_object("props", "$.k"), F.lit('}, {"k": '), F.get_json_object("props", "$.k").cast("long") + 1, F.lit("}]"))
    return sc.nested_rows(e.withColumn("found", more), "found", "struct<k:bigint>", "event_id")


@query("""SELECT l_orderkey, l_linenumber, round(-log10(greatest(l_discount, m / 10)), 6) AS x FROM lineitem, (SELECT min(l_discount) FILTER (l_discount > 0) AS m FROM lineitem)""")
def f_neg_log10(spark, sf):
    return t(spark, sf, "lineitem").withColumn("one", F.lit(1)).select("l_orderkey", "l_linenumber", r(sc.neg_log10(F.col("l_discount"), ["one"])).alias("x"))


# gates


def _cells(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("feature")).agg(F.sum("l_quantity").alias("value"))


@query("""SELECT cell, n FROM (SELECT l_orderkey AS cell, count(*) AS n FROM lineitem GROUP BY 1) WHERE cell IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def p_joint_gate(spark, sf):
    first = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.count("*").alias("n"))
    return counts.joint_gate(first, t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cell")))


@query("""SELECT l_partkey AS feature, count(*) AS n FROM lineitem GROUP BY 1 HAVING sum(l_discount) <> 0""")
def p_drop_zero(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_discount").alias("value"))
    return counts.drop_zero_features(rows).groupBy("feature").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 3 > 0 AND l_discount < 0.05 AND abs(l_tax - 0.04) > 0.015 AS hit, l_linenumber % 3 > 0 AND l_discount < 0.05 AS plain FROM lineitem""")
def p_significant(spark, sf):
    k = F.col("l_linenumber") % 3
    padj = F.when(k == 0, F.when(F.col("l_orderkey") % 2 == 0, F.lit(float("nan")))).otherwise(F.col("l_discount"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", counts.significant(padj, F.col("l_tax") - 0.04, 0.05, 0.015).alias("hit"), counts.significant(padj).alias("plain"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_custkey END::DOUBLE AS x FROM orders WHERE o_orderstatus = 'F'""")
def p_converged_and_picked(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("lfc_converged"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("LogFC"), F.col("o_custkey").alias("effect"))
    df = counts.converged(df)
    return df.select("o_orderkey", counts.pick(df, ["logfc", "Effect"]).alias("x"))


@query("""SELECT count(*) AS n, count(*) FILTER (l_linenumber = 1) AS non_finite, count(*) FILTER (l_linenumber = 2) AS negative, count(*) FILTER (l_linenumber > 2 AND l_tax <> round(l_tax)) AS non_integer, false AS raw FROM lineitem""")
def p_raw_count_report(spark, sf):
    k = F.col("l_linenumber")
    return counts.raw_count_report(t(spark, sf, "lineitem").select(F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(-1.0)).otherwise(F.col("l_tax")).alias("value")))


@query("""WITH c AS (SELECT l_suppkey AS s, sum(l_quantity) AS x FROM lineitem GROUP BY 1), l AS (SELECT least(1, stddev_samp(x) / avg(x) * 10) AS l FROM c)
SELECT round(0.34 + 0.22 + 0.16 + 0.12 * l + 0.08 + 0.08 * 0.5, 6) AS score FROM l""")
def p_raw_count_score(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.concat(F.lit("GENE"), "l_partkey").alias("feature"), F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("value"))
    return counts.raw_count_score(rows).select(r("score").alias("score"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 AND s_suppkey % 2 = 0 THEN NULL ELSE (CASE WHEN s_suppkey % 2 > 0 AND s_acctbal < 1000 THEN 'frip: beyond 1000|' ELSE '' END) || (CASE WHEN s_nationkey % 5 > 0 AND s_nationkey > 20 THEN 'nrf: beyond 20|' ELSE '' END) END AS failed, lower(trim(s_name)) IN ('input', 'igg') AS control FROM supplier""")
def p_qc_failures(spark, sf):
    df = t(spark, sf, "supplier").withColumns({"a": F.when(F.col("s_suppkey") % 2 > 0, F.col("s_acctbal")), "b": F.when(F.col("s_nationkey") % 5 > 0, F.col("s_nationkey"))})
    found = counts.qc_failures({"frip": ("a", 1000, "min"), "nrf": ("b", 20, "max")})
    return df.select("s_suppkey", F.array_join(F.transform(found, lambda x: F.concat(x, F.lit("|"))), "").alias("failed"), counts.is_control(F.col("s_name")).alias("control"))


@query("""SELECT * FROM (VALUES ('run_date'), ('seqLane'), ('Plate')) v("column") WHERE "column" <> 'seqLane'""")
def p_hidden_batches(spark, sf):
    found = counts.hidden_batches(["condition", "replicate", "run_date", "Plate", "age", "seqLane", "library"], "condition", "replicate", ["library"])
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("""SELECT 'orders' AS design, 'complete' AS pairing UNION ALL SELECT 'one arm', 'insufficient' UNION ALL SELECT 'apart', 'independent'""")
def g_pairing(spark, sf):
    c = t(spark, sf, "customer")
    both = c.select((F.col("c_custkey") % 8).alias("replicate"), F.when(F.col("c_custkey") % 16 < 8, "test").otherwise("ref").alias("condition"))
    apart = c.select((F.col("c_custkey") % 16).alias("replicate"), F.when(F.col("c_custkey") % 16 < 8, "test").otherwise("ref").alias("condition"))
    return spark.createDataFrame([("orders", counts.pairing(both)), ("one arm", counts.pairing(both.where("condition = 'test'"))), ("apart", counts.pairing(apart))], "design string, pairing string")


@query("""SELECT event_type AS model, count(*) AS calls, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 7)::BIGINT AS completion_tokens FROM events WHERE user_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-14 23:59:50' GROUP BY 1""")
def g_usage(spark, sf):
    log = t(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 3).cast("string").alias("experiment_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))
    return counts.usage(log, "1", "2024-01-15T00:00:00", 10)


# joins and intervals


@query("""SELECT s.n_name AS sample, count(*) AS n FROM customer c JOIN nation s ON c.c_nationkey = s.n_nationkey GROUP BY 1""")
def j_correspondence(spark, sf):
    names = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("sample"))
    c = t(spark, sf, "customer").join(F.broadcast(names), F.col("c_nationkey") == F.col("k")).select("sample", F.lit(1).alias("value"))
    strangers = c.unionByName(spark.createDataFrame([("nowhere", 1)], "sample string, value int"))
    meta = c.select("sample").distinct()
    if not _refused(lambda: joins.enforce_correspondence(strangers, meta)) or not _refused(lambda: joins.enforce_correspondence(c, meta, ["nowhere"])):
        raise AssertionError("an orphan went through")
    return joins.enforce_correspondence(strangers, meta, ["nowhere"]).groupBy("sample").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS sample, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def j_map_samples(spark, sf):
    mapping = t(spark, sf, "nation").select(F.col("n_nationkey").alias("sample"), F.col("n_name").alias("target"))
    if not _refused(lambda: joins.map_samples(t(spark, sf, "customer"), mapping.union(mapping))):
        raise AssertionError("a mapping that repeats went through")
    return joins.map_samples(t(spark, sf, "customer").select(F.col("c_nationkey").alias("sample")), mapping).groupBy("sample").agg(F.count("*").alias("n"))


def _barcode(key):
    return F.translate(F.lpad(F.conv(key.cast("string"), 10, 4), 12, "0"), "0123", "ACGT")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unassigned' ELSE c_mktsegment END AS label FROM customer""")
def j_barcode_labels(spark, sf):
    """Labels under a suffix and the reverse complement: the first transform that matches anything is used."""
    c = t(spark, sf, "customer").withColumn("barcode", _barcode(F.col("c_custkey") + 7_000_000))
    labels = c.where("c_custkey % 2 > 0 or c_custkey % 4 = 2").select(F.concat(sc.reverse_complement(F.col("barcode")), F.lit("-1")).alias("barcode"), F.col("c_mktsegment").alias("label"))
    forms = [lambda b: b, lambda b: F.when(b.endswith("-1"), sc.reverse_complement(F.substring_index(b, "-", 1))).otherwise(b)]
    return joins.join_labels(c.select("c_custkey", "barcode"), labels, forms).select("c_custkey", "label")


@query("""SELECT o_orderkey AS p, CASE WHEN o_orderkey % 100 < 60 THEN (o_orderkey // 100) * 100 END AS r_start FROM orders""")
def j_contains_point(spark, sf):
    points = t(spark, sf, "orders").select(F.lit("c").alias("chrom"), F.col("o_orderkey").alias("p"))
    boxes = points.select("chrom", (F.floor(F.col("p") / 100) * 100).alias("start")).distinct().withColumn("end", F.col("start") + 60)
    return intervals.contains_point(points, boxes, "p", closed=False).select("p", "r_start")


_SPANS = "SELECT 'c' || (l_suppkey % 40) AS chrom, l_partkey * 37 AS \"start\", l_partkey * 37 + l_quantity::BIGINT AS \"end\", l_linenumber % 3 AS rep, l_tax AS score FROM lineitem"


def _spans(spark, sf):
    start = F.col("l_partkey") * 37
    size = F.rint("l_quantity").cast("long")  # the SQL's cast rounds, half to even
    return t(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 40).alias("chrom"), start.alias("start"), (start + size).alias("end"), (F.col("l_linenumber") % 3).alias("rep"), F.col("l_tax").alias("score"))


_RUNS = f"""WITH s AS ({_SPANS}), m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m)"""


@query(f"""{_RUNS} SELECT chrom, "start", "end", min("start") OVER w AS u_start, max("end") OVER w AS u_end FROM g WINDOW w AS (PARTITION BY chrom, g)""")
def j_union_map(spark, sf):
    return intervals.union_map(_spans(spark, sf)).select("chrom", "start", "end", "u_start", "u_end")


@query(f"""{_RUNS.replace('FROM lineitem', 'FROM lineitem WHERE l_linenumber % 3 < 2')} SELECT chrom, min("start") AS "start", max("end") AS "end", max(score) FILTER (rep = 0) AS score1, max(score) FILTER (rep = 1) AS score2 FROM g GROUP BY chrom, g HAVING max(score) FILTER (rep = 0) IS NOT NULL AND max(score) FILTER (rep = 1) IS NOT NULL""")
def j_replicate_pairs(spark, sf):
    s = _spans(spark, sf)
    return intervals.replicate_pairs(s.where("rep = 0"), s.where("rep = 1")).select("chrom", "start", "end", "score1", "score2")


@query(f"""WITH s AS ({_SPANS}), a AS (SELECT * FROM s WHERE rep = 0), b AS (SELECT * FROM s WHERE rep = 1),
ah AS (SELECT count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end")),
bh AS (SELECT count(*) AS n FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end"))
SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, ah.n AS a_hit, bh.n AS b_hit, round(ah.n / (SELECT count(*) FROM a), 6) AS "precision", round(bh.n / (SELECT count(*) FROM b), 6) AS recall FROM ah, bh""")
def e_set_overlap(spark, sf):
    s = _spans(spark, sf).drop("score")
    return rounded(intervals.set_overlap(s.where("rep = 0").drop("rep"), s.where("rep = 1").drop("rep")))


@query("""SELECT 'same' AS pair, true AS equal UNION ALL SELECT 'one row more', false UNION ALL SELECT 'another row', false""")
def j_grids_equal(spark, sf):
    a = _spans(spark, sf).select("chrom", "start", "end")
    other = a.withColumn("end", F.when((F.col("start") == 37) & (F.col("chrom") == "c1"), F.col("end") + 1).otherwise(F.col("end") + F.when(F.col("chrom") == "c2", 1).otherwise(0)))
    return spark.createDataFrame([("same", joins.grids_equal(a, a.repartition(5))), ("one row more", joins.grids_equal(a, a.union(a.limit(1)))), ("another row", joins.grids_equal(a, other))], "pair string, equal boolean")


@query("""SELECT c_mktsegment AS "group", count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def j_barcode_groups(spark, sf):
    fragments = t(spark, sf, "orders").select(_barcode(F.col("o_custkey")).alias("barcode"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    groups = t(spark, sf, "customer").select(_barcode(F.col("c_custkey")).alias("barcode"), F.col("c_mktsegment").alias("group"))
    return joins.barcode_groups(fragments, groups).groupBy("group").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


@query("""WITH g AS (SELECT upper(p_brand) AS s, p_brand AS gene, count(*) AS cells FROM part GROUP BY 1, 2), m AS (SELECT DISTINCT p_brand || '::Brand#1' || (p_size % 9) AS motif, upper(p_brand) AS a, 'BRAND#1' || (p_size % 9) AS b FROM part)
SELECT motif, array_to_string(list_sort(list_distinct([x.gene, y.gene])), ',') AS genes FROM m JOIN g x ON x.s = a AND x.cells >= 10 JOIN g y ON y.s = b AND y.cells >= 10""")
def j_motifs_to_factors(spark, sf):
    p = t(spark, sf, "part")
    motifs = p.select(F.concat("p_brand", F.lit("::Brand#1"), F.col("p_size") % 9).alias("motif")).distinct()
    genes = p.groupBy(F.col("p_brand").alias("gene")).agg(F.count("*").alias("cells"))
    return joins.motifs_to_factors(motifs, genes).select("motif", F.array_join("genes", ",").alias("genes"))


@query("""SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 5 = 0 THEN 'claim names no analysis' WHEN o_orderkey % 7 > 3 THEN 'no such node' WHEN o_orderkey % 7 = 2 THEN 'node did not run' END AS reason, o_orderkey % 5 > 0 AND o_orderkey % 7 <= 3 AND o_orderkey % 7 <> 2 AS linked FROM orders""")
def j_link_claims(spark, sf):
    claims = t(spark, sf, "orders").select(F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderkey") % 5 > 0, "rna").alias("modality"), F.concat(F.lit("a"), F.col("o_orderkey") % 7).alias("analysis"))
    nodes = spark.createDataFrame([("rna", "a0", "n0", "ran"), ("rna", "a1", "n1", "executed"), ("rna", "a2", "n2", "error"), ("rna", "a3", "n3", "ran")], "modality string, analysis string, node string, status string")
    return joins.link_claims(claims, nodes).select("claim", "reason", "linked")


@query("""WITH e AS (SELECT p_partkey, p_retailprice - 1400 AS effect, p_size / 100.0 AS padj FROM part WHERE p_partkey % 3 > 0)
SELECT 'P' || q.p_partkey || '::q' AS factor, CASE g WHEN 1 THEN 'Q' ELSE 'P' || q.p_partkey END AS gene, CASE WHEN g = 1 OR e.effect IS NULL THEN 'unmeasured' WHEN e.padj < 0.05 THEN CASE WHEN sign(e.effect) = 1 THEN 'concordant' ELSE 'discordant' END ELSE 'expressed_only' END AS support
FROM part q CROSS JOIN (SELECT unnest([0, 1]) AS g) LEFT JOIN e ON e.p_partkey = q.p_partkey""")
def j_factor_support(spark, sf):
    p = t(spark, sf, "part")
    factors = p.select(F.concat(F.lit("P"), "p_partkey", F.lit("::q")).alias("factor"), F.lit(1.0).alias("direction"))
    expression = p.where("p_partkey % 3 > 0").select(F.concat(F.lit("p"), "p_partkey").alias("gene"), (F.col("p_retailprice") - 1400).alias("effect"), (F.col("p_size") / 100.0).alias("padj"))
    return joins.factor_support(factors, expression).select("factor", "gene", "support")


# order


@query("""WITH c AS (SELECT l_returnflag AS contrast, l_linenumber AS k, min(l_tax + l_discount + 0.001) AS p FROM lineitem GROUP BY 1, 2),
x AS (SELECT *, p * count(*) OVER (PARTITION BY contrast) / rank() OVER (PARTITION BY contrast ORDER BY p) AS raw, count(*) OVER (PARTITION BY contrast) AS m FROM c),
y AS (SELECT contrast, k, p, p * m / (SELECT count(*) FROM c d WHERE d.contrast = x.contrast AND d.p <= x.p) AS q FROM x)
SELECT contrast, k, round(least(1, (SELECT min(z.q) FROM y z WHERE z.contrast = y.contrast AND z.p >= y.p)), 6) AS padj, true AS refused FROM y""")
def w_preregistered(spark, sf):
    p = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("contrast"), F.col("l_linenumber").alias("k")).agg(F.min(F.col("l_tax") + F.col("l_discount") + 0.001).alias("p"))
    try:
        o.preregistered_bh(p, "p", "padj", "pooled", "contrast", "per_contrast")
        refused = False
    except ValueError:
        refused = True
    return o.preregistered_bh(p, "p", "padj", "per_contrast", "contrast", "per_contrast").select("contrast", "k", r("padj").alias("padj"), F.lit(refused).alias("refused"))


@query("""SELECT user_id, max(ts) AS ts, TIMESTAMP '2024-01-30 00:00:00' - max(ts) > INTERVAL 1 DAY AS stale FROM events GROUP BY 1""")
def w_heartbeat(spark, sf):
    e = t(spark, sf, "events").select("user_id", "ts", "event_id")
    return o.latest(e, ["user_id"], "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"), 86400).select("user_id", "ts", "stale")


@query("""WITH b AS (SELECT o_orderstatus AS k, o_orderkey // 100 + 1 AS x, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2)
SELECT k, x, round((ln(lead(y) OVER w) - ln(lag(y) OVER w)) / (ln(lead(x) OVER w) - ln(lag(x) OVER w)), 5) AS slope FROM b WINDOW w AS (PARTITION BY k ORDER BY x)""")
def w_log_slope(spark, sf):
    b = t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k"), (F.floor(F.col("o_orderkey") / 100) + 1).alias("x")).agg(F.sum("o_totalprice").alias("y"))
    return b.select("k", "x", r(o.log_slope(F.col("x"), F.col("y"), ["k"], [F.col("x")]), 5).alias("slope"))


@query("""SELECT row_number() OVER (ORDER BY abs(l_tax - 0.04) DESC, abs(l_discount) DESC, gene, peak) AS n, gene, peak FROM (SELECT any_value(l_tax) AS l_tax, any_value(l_discount) AS l_discount, gene, peak FROM (SELECT min(l_tax) OVER w AS l_tax, min(l_discount) OVER w AS l_discount, l_partkey AS gene, l_suppkey AS peak FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey)) GROUP BY gene, peak)""")
def l_links(spark, sf):
    links = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("peak")).agg((F.min("l_tax") - 0.04).alias("r"), F.min("l_discount").alias("z"))
    return _numbered(sets.ordered_links(links), "gene", "peak")


def _numbered(ordered, *columns):
    """Rows of an ordered table with their number."""
    schema = ", ".join(["n bigint", *(f"`{c}` {ordered.schema[c].dataType.simpleString()}" for c in columns)])
    rows = ordered.select(*columns)
    return rows.rdd.zipWithIndex().map(lambda x: (x[1] + 1, *x[0])).toDF(schema)


# governance


@query("""SELECT o_orderkey, o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 AS licensed FROM orders""")
def y_causal_licence(spark, sf):
    k = F.col("o_orderkey")
    block = F.struct(F.lit("ate").alias("estimand"), F.lit("dose").alias("intervention"), F.when(k % 5 == 0, "randomized").when(k % 5 == 1, "observed").alias("assignment"), F.lit("all").alias("population"), F.when(k % 2 == 0, "true").alias("identified"))
    return t(spark, sf, "orders").select("o_orderkey", governance.causal_licence(block).alias("licensed"))


@query("""SELECT event_id AS block, CASE WHEN event_id % 3 = 1 THEN '7.5' ELSE '' END AS numbers, CASE WHEN event_id % 3 = 2 THEN 'OTHER' ELSE '' END AS entities, event_id % 3 = 0 AS supported FROM events""")
def y_evidence_card(spark, sf):
    e, k = t(spark, sf, "events"), F.col("event_id") % 3
    blocks = e.select(F.col("event_id").alias("block"), F.concat(F.lit("STAT3 rises by "), F.when(k == 1, "7.5").otherwise("2.0"), F.when(k == 2, " with OTHER").otherwise("")).alias("text"))
    facts = e.select(F.col("event_id").alias("block"), F.lit(2.001).alias("value"), F.lit("stat3").alias("entity"))
    return governance.evidence_card(blocks, facts).select("block", F.array_join(F.col("unsupported_numbers").cast("array<string>"), ",").alias("numbers"), F.array_join("unsupported_entities", ",").alias("entities"), "supported")


@query("""SELECT event_id AS block, CASE event_id % 4 WHEN 0 THEN 'no text' WHEN 1 THEN 'no source' WHEN 2 THEN 'causal wording' ELSE '' END AS errors, event_id % 4 = 3 AS valid FROM events""")
def y_validate_blocks(spark, sf):
    k = F.col("event_id") % 4
    blocks = t(spark, sf, "events").select(F.col("event_id").alias("block"), F.when(k == 0, " ").when(k == 2, "it causes that").otherwise("it goes with that").alias("text"), F.lit("descriptive").alias("tier"), F.when(k != 1, "s").alias("source"))
    return governance.validate_blocks(blocks).select("block", F.array_join("errors", ",").alias("errors"), "valid")


@query("""SELECT o_orderkey AS block, o_orderkey % 4 IN (1, 2) AS verified FROM orders""")
def y_verify_blocks(spark, sf):
    blocks = t(spark, sf, "orders").select(F.col("o_orderkey").alias("block"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("n"), F.col("o_orderkey") % 4)).alias("node"))
    ledger = governance.reconcile(spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string"), spark.createDataFrame([("n1", "ran", True), ("n2", "success", True), ("n3", "ran", False)], "node string, status string, ran boolean"))
    return governance.verify_blocks(blocks, ledger).select("block", "verified")


@query("""SELECT c_custkey AS claim, CASE c_custkey % 3 WHEN 0 THEN 'untested' WHEN 1 THEN 'survived' ELSE 'broken' END AS certificate FROM customer""")
def y_falsification(spark, sf):
    c = t(spark, sf, "customer")
    tested = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("feature"), (F.col("c_custkey") % 3 == 1).alias("stable"), F.lit("u1").alias("most_influential"))
    return governance.falsification(c.select(F.col("c_custkey").alias("claim"), F.col("c_custkey").alias("feature")), tested).select("claim", "certificate")


@query("""SELECT c_custkey AS id, c_custkey % 2 = 0 AS falsifiable, c_custkey % 3 = 0 AS grounded, NOT (c_custkey % 6 = 0) AS quarantined FROM customer""")
def y_hypothesis_gates(spark, sf):
    k = F.col("c_custkey")
    h = t(spark, sf, "customer").select(k.alias("id"), F.lit("it rises").alias("prediction"), F.when(k % 2 == 0, "it falls").when(k % 4 == 1, "IT RISES").alias("refuted_by"), F.array(F.lit("a"), F.when(k % 3 == 0, "b").otherwise("z")).alias("entities"), F.array(F.lit("a"), F.lit("b")).alias("known"))
    return governance.hypothesis_gates(h).select("id", "falsifiable", "grounded", "quarantined")


@query("""WITH s AS (SELECT user_id % 20 AS id, event_type AS lineage, max(abs(value)) AS e FROM events WHERE value IS NOT NULL GROUP BY 1, 2), l AS (SELECT id, count(*) AS lines, avg(tanh(e / 1000)) AS strength FROM s GROUP BY 1)
SELECT id, lines, row_number() OVER (ORDER BY lines DESC, strength DESC, id % 3, id) AS rank FROM l""")
def l_rank_hypotheses(spark, sf):
    e = t(spark, sf, "events").where("value is not null")
    h = e.select((F.col("user_id") % 20).alias("id")).distinct().withColumns({"caveats": F.col("id") % 3, "position": F.col("id")})
    signals = e.select((F.col("user_id") % 20).alias("id"), F.col("event_type").alias("lineage"), (F.col("value") / 1000).alias("effect"))
    return governance.rank_hypotheses(h, signals).select("id", "lines", "rank")


@query("""SELECT 'rna' AS modality, o_orderkey AS lineage, l_partkey AS entity, round(l_tax - 0.04, 2) AS effect, CASE WHEN round(l_tax - 0.04, 2) > 0 THEN 1.0 WHEN round(l_tax - 0.04, 2) < 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS direction FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def y_flatten_signals(spark, sf):
    items = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("gene"), F.round(F.col("l_tax") - 0.04, 2).alias("lfc"))).alias("items"))
    findings = t(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("lineage"), "items")
    return governance.flatten_signals(findings, "rna", "gene", "lfc")


@query("""WITH m AS (SELECT p_brand AS cluster, p_type AS label, p_name AS marker, bool_or(p_size > 25) AS verified FROM part GROUP BY 1, 2, 3), u AS (SELECT marker, count(DISTINCT label) AS labels FROM m GROUP BY 1)
SELECT cluster, label, count(*) FILTER (verified) AS verified, count(*) FILTER (labels > 1) AS reused, (CASE WHEN count(*) FILTER (verified) < 3 THEN 'few verified markers' ELSE '' END) || (CASE WHEN count(*) FILTER (labels > 1) > 0 THEN '+markers reused' ELSE '' END) AS flags FROM m JOIN u USING (marker) GROUP BY 1, 2""")
def y_annotation_coherence(spark, sf):
    m = t(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_type").alias("label"), F.col("p_name").alias("marker")).agg(F.bool_or(F.col("p_size") > 25).alias("verified"))
    out = governance.annotation_coherence(m, m.select("cluster").distinct())
    flags = F.array_join(F.transform("flags", lambda x: F.when(x == "markers reused", F.concat(F.lit("+"), x)).otherwise(x)), "")
    return out.select("cluster", "label", "verified", "reused", flags.alias("flags"))


@query("""WITH c AS (SELECT n_name AS modality, c_mktsegment AS chk, min(c_acctbal) > -900 AS passed, c_mktsegment < 'D' AS required FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT modality, CASE WHEN count(*) FILTER (required AND NOT passed) > 0 THEN 'blocked' WHEN count(*) FILTER (NOT passed) > 0 THEN 'partial' ELSE 'ready' END AS state, coalesce(string_agg(chk, ',' ORDER BY chk) FILTER (NOT passed), '') AS failed FROM c GROUP BY 1""")
def y_readiness(spark, sf):
    names = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("modality"))
    c = t(spark, sf, "customer").join(F.broadcast(names), "c_nationkey").groupBy("modality", F.col("c_mktsegment").alias("check")).agg((F.min("c_acctbal") > -900).alias("passed")).withColumn("required", F.col("check") < "D")
    return governance.readiness(c).select("modality", "state", F.array_join("failed", ",").alias("failed"))


@query("""WITH m AS (SELECT 's' || (l_suppkey % 6) AS sample, l_partkey % 40 AS feature, log2(sum(l_quantity) + 1) AS v FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN a.sample < 's3' THEN 'x' ELSE 'y' END AS "group", a.sample AS a, b.sample AS b, round(corr(a.v, b.v), 5) AS r FROM m a JOIN m b ON a.feature = b.feature AND a.sample < b.sample AND (a.sample < 's3') = (b.sample < 's3') GROUP BY 1, 2, 3 HAVING corr(a.v, b.v) < 0.8""")
def y_replicate_correlations(spark, sf):
    m = t(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey") % 6).alias("sample"), (F.col("l_partkey") % 40).alias("feature")).agg(F.sum("l_quantity").alias("value"))
    samples = m.select("sample").distinct().withColumn("group", F.when(F.col("sample") < "s3", "x").otherwise("y"))
    return rounded(governance.replicate_correlations(m, samples), 5)


@query("""WITH e AS (SELECT p_brand AS gene, p_size % 2 AS g, avg(p_retailprice) AS m FROM part GROUP BY 1, 2), w AS (SELECT gene, max(m) FILTER (g = 0) - max(m) FILTER (g = 1) AS d FROM e GROUP BY 1)
SELECT lower(gene) AS factor, round(d, 4) AS expression_change, CASE WHEN d IS NULL THEN 'unmeasured' WHEN sign(d) = 1 THEN 'concordant' ELSE 'discordant' END AS state FROM w""")
def y_factor_concordance(spark, sf):
    p = t(spark, sf, "part")
    e = p.groupBy(F.col("p_brand").alias("gene"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("group")).agg(F.avg("p_retailprice").alias("mean"))
    factors = p.select(F.lower("p_brand").alias("factor"), F.lit(1.5).alias("change")).distinct()
    return governance.factor_concordance(factors, e, "a", "b").select("factor", r("expression_change", 4).alias("expression_change"), "state")


# sampling, tails, state


@query("""WITH j AS (SELECT l_partkey % 5 = 0 AS changed, l_discount < 0.05 AS hit, l_tax AS f, l_tax * 2 + l_discount AS g FROM lineitem)
SELECT round(count(*) FILTER (hit AND changed) / count(*) FILTER (changed), 6) AS recall, round(count(*) FILTER (hit AND changed) / count(*) FILTER (hit), 6) AS "precision", round(1 - count(*) FILTER (hit AND changed) / count(*) FILTER (hit), 6) AS fdr, round(count(*) FILTER (hit AND NOT changed) / count(*) FILTER (NOT changed), 6) AS fpr, round(corr(f, g) FILTER (changed), 6) AS effect_r FROM j""")
def x_detection_scores(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("feature", F.monotonically_increasing_id())
    truth = rows.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias("feature"), (F.col("l_partkey") % 5 == 0).alias("changed"), F.col("l_tax").alias("log2fc"), F.col("l_discount").alias("padj"), (F.col("l_tax") * 2 + F.col("l_discount")).alias("found"))
    return rounded(sampling.score_detection(truth.select("feature", "padj", F.col("found").alias("log2fc")), truth.select("feature", "changed", "log2fc")))


@query("""SELECT name FROM (VALUES ('inflated_count'), ('flipped_direction'), ('other_unit'), ('no_denominator'), ('causal_wording'), ('foreign_node')) v(name)""")
def x_mutations(spark, sf):
    report = {"count": 3, "direction": 1, "unit": "sample", "denominator": 10, "text": "x", "node": "ledger://x"}
    return spark.createDataFrame([(n,) for n, m in sampling.mutations(report) if sum(m.get(k) != v for k, v in report.items()) == 1], "name string")


@query("""WITH x AS (SELECT DISTINCT p_size % 12 AS k, 20 + p_size % 7 AS marked, 30 + p_size % 5 AS drawn FROM part), c AS (SELECT x.*, unnest(range(0, 60)) AS i FROM x),
f AS (SELECT k, marked, drawn, i, CASE WHEN i >= k AND i <= least(marked, drawn) THEN exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(200 - marked + 1) - lgamma(drawn - i + 1) - lgamma(200 - marked - drawn + i + 1) - lgamma(201) + lgamma(drawn + 1) + lgamma(200 - drawn + 1)) ELSE 0 END AS p FROM c WHERE i <= least(marked, drawn))
SELECT k, marked, drawn, round(least(1, sum(p)), 8) AS p FROM f GROUP BY 1, 2, 3""")
def m_hypergeometric_tail(spark, sf):
    x = t(spark, sf, "part").select((F.col("p_size") % 12).alias("k"), (F.col("p_size") % 7 + 20).alias("marked"), (F.col("p_size") % 5 + 30).alias("drawn")).distinct().withColumn("population", F.lit(200))
    return x.withColumn("p", r(hypergeometric_p("k", "population", "marked", "drawn"), 8)).drop("population")


def _store(spark):
    return state.Store(spark, _folder(spark))


@query("""SELECT * FROM (VALUES ('active', 'f2'), ('active', 'f3'), ('room r1', 'f2'), ('tunnel', 't1'), ('wing', 'w2'), ('wing', 'w1'), ('snapshot', 'f1'), ('snapshot', 'f2'), ('dangling', 'f3'), ('decision', 'd1'), ('decision', 'd2'), ('similar', 'd1')) v(what, id)""")
def b_store(spark, sf):
    """Rows written, written over and invalidated, and what each reader of the store finds."""
    s = _store(spark)
    s.upsert("wings", {"id": "w1", "name": "old", "created_at": "2024-01-01"}, {"id": "w2", "name": "two", "created_at": "2024-01-02"})
    s.upsert("wings", {"id": "w1", "name": "one", "created_at": "2024-01-01"})
    s.upsert("halls", {"id": "h1", "wing_id": "w1"})
    s.upsert("rooms", {"id": "r1", "hall_id": "h1"})
    s.upsert("findings", {"id": "f1", "room_id": "r1"}, {"id": "f2", "room_id": "r1"}, {"id": "f3", "room_id": "gone"})
    s.invalidate("f1", "2024-02-01")
    s.upsert("tunnels", {"id": "t1", "wing_id": "w1", "entity": "STAT3"})
    s.upsert("decisions", {"id": "d1", "wing_id": "w1", "question": "Use batch correction?", "decision": "approved", "made_at": "2024-01-01"}, {"id": "d2", "wing_id": "w1", "question": "Drop batch?", "decision": "rejected", "made_at": "2024-01-03"})
    named = lambda what, df: df.select(F.lit(what).alias("what"), "id")
    parts = [named("active", s.active_findings()), named("room r1", s.active_findings("r1")), named("tunnel", s.tunnels_of("stat3")), named("wing", s.startup_context()), named("snapshot", s.snapshot("w1")["findings"]), named("dangling", s.dangling()), named("decision", s.decisions_of("w1")), named("similar", s.similar_decisions(["batch"]))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# files, written and read back


@query(f"""WITH s AS ({_SPANS}) SELECT chrom, "start", "end", rep::DOUBLE AS score FROM s WHERE "end" > "start" """)
def s_peaks(spark, sf):
    path = _folder(spark)
    writers.delimited(_spans(spark, sf).select("chrom", "start", "end", F.lit("p").alias("name"), "rep"), path, header=False)
    return readers.peaks(spark, path)


@query("""SELECT DISTINCT p_type AS term, upper(p_brand) AS gene FROM part""")
def s_gene_sets(spark, sf):
    path = _folder(spark)
    lines = t(spark, sf, "part").groupBy("p_type").agg(F.concat_ws("\t", F.collect_set("p_brand")).alias("genes"))
    lines.select(F.concat_ws("\t", "p_type", F.lit("about"), "genes").alias("value")).write.text(path)
    return readers.gmt(spark, path)


@query("""SELECT 'G' || p_partkey AS gene_id, p_brand AS gene, 'c' || (p_size % 5) AS chrom, p_partkey * 100 - 1 AS "start", p_partkey * 100 + p_size AS "end", CASE WHEN p_size % 2 = 0 THEN '-' ELSE '+' END AS strand,
CASE WHEN p_size % 2 = 0 THEN p_partkey * 100 + p_size - 1 ELSE p_partkey * 100 - 1 END AS tss, 1::INTEGER AS exons, p_size + 1 AS length FROM part""")
def s_gene_models(spark, sf):
    """A GTF with a gene, a transcript and an exon for each part: gene models, canonical starts and exon lengths."""
    path, p = _folder(spark), t(spark, sf, "part")
    at = F.concat(F.lit('gene_id "G'), "p_partkey", F.lit('.3"; gene_name "'), "p_brand", F.lit('_'), "p_partkey", F.lit('"; transcript_id "T'), "p_partkey", F.lit('"; gene_type "protein_coding";'))
    row = lambda kind: p.select(F.concat(F.lit("c"), F.col("p_size") % 5), F.lit("x"), F.lit(kind), F.col("p_partkey") * 100, F.col("p_partkey") * 100 + F.col("p_size"), F.lit("."), F.when(F.col("p_size") % 2 == 0, "-").otherwise("+"), F.lit("."), at)
    lines = row("gene").union(row("transcript")).union(row("exon"))
    names = [f"k{i}" for i in range(9)]
    lines.toDF(*names).select(F.concat_ws("\t", *names).alias("value")).write.text(path)
    rows = readers.gtf(spark, path)
    starts, lengths = readers.canonical_tss(rows), readers.gene_symbols(rows)
    models = readers.gene_models(rows).withColumn("gene_id", sc.strip_version(F.col("gene_id")))
    out = models.join(starts.select("gene_id", F.col("tss").alias("canonical")), "gene_id").where("tss = canonical").join(lengths.select("gene_id", "length"), "gene_id")
    return out.select("gene_id", F.substring_index("gene", "_", 1).alias("gene"), "chrom", "start", "end", "strand", "tss", F.size("exons").alias("exons"), "length")


@query("""SELECT 'f' || (l_partkey % 200) AS feature, 's' || (l_suppkey % 8) AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2""")
def s_count_matrix(spark, sf):
    path = _folder(spark)
    long = t(spark, sf, "lineitem").groupBy(F.concat(F.lit("f"), F.col("l_partkey") % 200).alias("feature"), F.concat(F.lit("s"), F.col("l_suppkey") % 8).alias("sample")).agg(F.sum("l_quantity").alias("value"))
    writers.count_matrix(long, path)
    return readers.count_matrix(spark, [path]).where("value > 0")


@query("""SELECT 'f' || (l_partkey % 200) AS gene, 's' || (l_suppkey % 8) AS sample, sum(l_quantity) AS cpm FROM lineitem GROUP BY 1, 2""")
def s_cpm_matrix(spark, sf):
    path = _folder(spark)
    long = t(spark, sf, "lineitem").groupBy(F.concat(F.lit("f"), F.col("l_partkey") % 200).alias("gene"), F.concat(F.lit("s"), F.col("l_suppkey") % 8).alias("sample_id")).agg(F.sum("l_quantity").alias("cpm"))
    writers.delimited(long, path, ",")
    return readers.cpm_matrix(spark, path)


@query("""SELECT 'c' || (l_suppkey % 40) AS chrom, l_partkey AS "start", l_partkey + 100 AS "end", 'b' || (l_orderkey % 100) AS barcode, l_linenumber::BIGINT AS n FROM lineitem""")
def s_fragments(spark, sf):
    path = _folder(spark)
    writers.delimited(t(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 40), "l_partkey", F.col("l_partkey") + 100, F.concat(F.lit("b"), F.col("l_orderkey") % 100), "l_linenumber"), path, header=False)
    return readers.fragments(spark, path)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS sample, c_mktsegment AS condition, c_name AS name FROM customer""")
def s_sample_sheet(spark, sf):
    path = _folder(spark)
    writers.delimited(t(spark, sf, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("condition"), F.col("c_name").alias("name")), path)
    return readers.sample_sheet(spark, path)


@query(f"""WITH s AS ({_SPANS}) SELECT chrom, "start", "end", round(score * 2.5, 6) AS score FROM s""")
def k_bedgraph(spark, sf):
    path = _folder(spark)
    writers.bedgraph(_spans(spark, sf), path, 2.5)
    return rounded(readers.bedgraph(spark, path))


@query("""SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS feature, l_discount AS padj FROM lineitem WHERE l_discount < 0.05""")
def k_differential(spark, sf):
    path = _folder(spark)
    de = t(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("feature"), F.when(F.col("l_linenumber") >= 0, F.col("l_discount")).alias("padj"))
    writers.differential(de, path)
    return readers.delimited(spark, path).select("feature", F.col("padj").cast("double").alias("padj"))


@query("""SELECT event_id, event_type, n FROM (SELECT event_id, event_type, unnest([1, 2]) AS n FROM events)""")
def k_append_json(spark, sf):
    path, e = _folder(spark), t(spark, sf, "events").select("event_id", "event_type")
    for n in (1, 2):
        writers.append_json(e.withColumn("n", F.lit(n)), path)
    return spark.read.schema("event_id bigint, event_type string, n int").json(path)


@query("""SELECT 'links' AS what, true AS told, false AS claimed""")
def k_failure_is_told(spark, sf):
    warnings: list[str] = []

    def fail(path):
        raise OSError("no space")

    got = writers.persist(fail, "links", "x", warnings)
    return spark.createDataFrame([("links", len(warnings) == 1, got is not None)], "what string, told boolean, claimed boolean")


@query("""SELECT * FROM (VALUES ('fragments'), ('differential'), ('sample_sheet'), ('count_matrix'), ('unknown')) v(kind)""")
def s_detected_types(spark, sf):
    cases = (["chrom", "start", "end", "barcode"], ["gene", "log2FoldChange", "padj"], ["sample_id", "condition"], ["gene_id", "s1", "s2"], ["a"])
    return spark.createDataFrame([(readers.detect_assay(c),) for c in cases], "kind string")


# abundance, contrasts


@query("""WITH c AS (SELECT o_custkey AS sample, o_orderpriority AS kind, c_acctbal >= 4500 AS rich FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT sample, CASE WHEN bool_and(rich) THEN 1 ELSE 0 END AS x FROM c GROUP BY 1), k AS (SELECT DISTINCT kind FROM c), m AS (SELECT sample, kind, count(*) AS v FROM c GROUP BY 1, 2),
n AS (SELECT sample, x, kind, coalesce(v, 0) AS v FROM g CROSS JOIN k LEFT JOIN m USING (sample, kind)),
l AS (SELECT *, ln((v + 0.5) / sum(v + 0.5) OVER (PARTITION BY sample)) AS l, v / sum(v) OVER (PARTITION BY sample) AS share FROM n),
y AS (SELECT *, l - avg(l) OVER (PARTITION BY sample) AS y FROM l),
d AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, 1 / count(*) OVER w AS i FROM y WINDOW w AS (PARTITION BY kind)),
b AS (SELECT *, sum(dx * dx) OVER w AS sxx, sum(dx * dy) OVER w / sum(dx * dx) OVER w AS b FROM d WINDOW w AS (PARTITION BY kind))
SELECT kind, 'clr_hc3' AS model, CAST(sum(v) FILTER (x = 1) AS BIGINT) AS n_test, CAST(sum(v) FILTER (x = 0) AS BIGINT) AS n_ref, round(max(b), 6) AS slope,
round(sqrt(sum(pow(dx * (dy - b * dx) / (1 - i - dx * dx / sxx), 2))) / max(sxx), 6) AS se,
round(log2((avg(share) FILTER (x = 1) + 1e-9) / (avg(share) FILTER (x = 0) + 1e-9)), 6) AS log2fc FROM b GROUP BY kind""")
def m_abundance(spark, sf):
    """Shares of order priorities among a customer's orders, customers of a high balance against the others."""
    rich = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 4500, F.lit("rich")).otherwise(F.lit("poor")).alias("arm"))
    cells = t(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("kind")).join(rich, "o_custkey")
    return rounded(models.abundance(cells, "o_custkey", "kind", "arm", "rich", "poor").select("kind", "model", "n_test", "n_ref", "slope", "se", "log2fc"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag || '_vs_' || l_linestatus = 'R_vs_F' AND l_linenumber = 2""")
def p_of_contrast(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("group"), F.concat("l_returnflag", F.lit("_vs_"), "l_linestatus").alias("contrast"))
    return counts.of_contrast(rows, "R_vs_F", 2).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax < 0.04 AND abs(l_discount) > 0.05""")
def p_thresholds(spark, sf):
    limits = counts.Thresholds.of({"global_padj": "0.04", "global_lfc": None}, "bulk", log2fc=0.05)
    return t(spark, sf, "lineitem").where(limits.significant(F.col("l_tax"), F.col("l_discount"))).select("l_orderkey", "l_linenumber")
