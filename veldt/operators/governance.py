"""Rules over claims, evidence and run ledgers (Y1 to Y17), by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import entities, numbers, unnegated

#: Claim tiers from weakest to strongest, and words that claim a cause.
TIERS = ("descriptive", "associative", "weak_mechanistic", "strong_mechanistic", "causal")
CAUSAL = ("causes", "caused by", "drives", "leads to", "results in", "induces", "is responsible for")


def statistics_gate(n: Column, power: Column, low_power: Column, recovered: Column, least_power: float = 0.8) -> Column:
    """Whether statistics may carry an association: significant results, enough power, no low-power flag, counts not recovered from logs."""
    ok = F.coalesce(n > 0, F.lit(False)) & ~F.coalesce(F.isnan(n.cast("double")), F.lit(False)) & F.coalesce(power >= least_power, F.lit(True))
    return ok & ~F.coalesce(low_power, F.lit(False)) & ~F.coalesce(recovered, F.lit(False))


def classify_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (claim, subject, n_significant, power, low_power, recovered, licensed) with a tier from their subject's evidence (subject, category, mechanistic): an association that passes the gate, then one line of
    mechanism, then two or more from different categories, then a licence. Failing the gate makes any claim descriptive."""
    lines = evidence.groupBy("subject").agg(F.count_distinct("category").alias("categories"), F.count_distinct(F.when(F.col("mechanistic"), F.col("category"))).alias("lines"))
    j = claims.join(lines, "subject", "left").fillna({"categories": 0, "lines": 0})
    gate = statistics_gate(F.col("n_significant"), F.col("power"), F.col("low_power"), F.col("recovered"))
    tier = F.when(~gate, TIERS[0]).when(F.coalesce("licensed", F.lit(False)) & (F.col("lines") >= 1), TIERS[4]).when(F.col("lines") >= 2, TIERS[3]).when(F.col("lines") == 1, TIERS[2]).otherwise(TIERS[1])
    return j.withColumn("tier", tier)


LICENCE = ("estimand", "intervention", "assignment", "population", "identified")


def causal_licence(block: Column) -> Column:
    """Whether a struct has every part of a causal licence, and is identified by design; anything missing refuses."""
    parts = [block[p].isNotNull() & (F.trim(block[p].cast("string")) != "") for p in LICENCE]
    ok = F.lit(True)
    for p in parts:
        ok = ok & p
    return F.coalesce(ok & (F.lower(block["identified"].cast("string")) == "true") & F.lower(block["assignment"].cast("string")).isin("randomized", "randomised", "instrument"), F.lit(False))


def publish(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """Claims with a state: published, withheld with a reason, or passed on without a claim. A claim nobody verified is withheld."""
    j = claims.join(verified.select("claim", "supported", F.col("reason").alias("why")), "claim", "left")
    no_text = F.trim(F.coalesce("text", F.lit(""))) == ""
    state = F.when(no_text, "no_claim").when(F.coalesce("supported", F.lit(False)), "published").otherwise("withheld")
    return j.withColumn("state", state).withColumn("reason", F.when(F.col("state") == "withheld", F.coalesce("why", F.lit("not verified")))).drop("why", "supported")


def evidence_card(blocks: DataFrame, facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Blocks (block, text) against facts (block, value, entity): numbers and names in the text that no fact carries, and whether the block is supported."""
    n = blocks.select("block", F.explode(numbers(F.col("text"))).alias("x"))
    e = blocks.select("block", F.explode(entities(F.col("text"))).alias("x"))
    values = facts.where("value is not null").groupBy("block").agg(F.collect_set("value").alias("values"))
    names = facts.where("entity is not null").groupBy("block").agg(F.collect_set(F.upper("entity")).alias("names"))
    bad_n = n.join(values, "block", "left").where(~F.coalesce(F.exists("values", lambda v: F.abs(v - F.col("x")) <= tolerance * F.greatest(F.abs(v), F.lit(1e-12))), F.lit(False))).groupBy("block").agg(F.sort_array(F.collect_set("x")).alias("unsupported_numbers"))
    bad_e = e.join(names, "block", "left").where(~F.coalesce(F.array_contains("names", F.col("x")), F.lit(False))).groupBy("block").agg(F.sort_array(F.collect_set("x")).alias("unsupported_entities"))
    out = blocks.join(bad_n, "block", "left").join(bad_e, "block", "left")
    out = out.withColumns({"unsupported_numbers": F.coalesce("unsupported_numbers", F.array().cast("array<double>")), "unsupported_entities": F.coalesce("unsupported_entities", F.array().cast("array<string>"))})
    return out.withColumn("supported", (F.size("unsupported_numbers") == 0) & (F.size("unsupported_entities") == 0))


def direction_supported(text: Column, effect: Column) -> Column:
    """Whether words of rise or fall agree with the sign of an effect; null without such words."""
    up, down = text.rlike(r"(?i)\b(up-?regulated|increas\w+|higher|gain\w*)\b"), text.rlike(r"(?i)\b(down-?regulated|decreas\w+|lower|los[st]\w*)\b")
    return F.when(up & ~down, effect > 0).when(down & ~up, effect < 0)


def validate_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (block, text, tier, source) with what is wrong: no text, no source, causal words without a causal tier."""
    wrong = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.lit("no text")), F.when(F.col("source").isNull(), F.lit("no source")),
        F.when((F.size(unnegated(F.col("text"), CAUSAL)) > 0) & (F.col("tier") != "causal"), F.lit("causal wording"))))
    return blocks.withColumn("errors", wrong).withColumn("valid", F.size("errors") == 0)


#: What statuses are worth where several are reported.
PRIORITY = {"ran": 4, "executed": 4, "error": 3, "skipped": 2, "not_run": 1}


def reconcile(planned: DataFrame, executed: DataFrame) -> DataFrame:
    """Planned (node) against executed (node, status, ran): the best status of a node, ran = false beating any success, unknown statuses as not_run; diverged is
    planned and not ran, or ran and not planned."""
    status = F.when(F.col("ran").eqNullSafe(F.lit(False)) & F.col("status").isin("ran", "executed", "success"), "not_run").when(F.col("status") == "success", "ran").when(F.col("status").isin(*PRIORITY), F.col("status")).otherwise("not_run")
    rank = F.element_at(F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v)))), F.col("status"))
    best = executed.withColumn("status", status).groupBy("node").agg(F.max_by("status", F.struct(rank, F.col("status"))).alias("status"), F.lit(True).alias("reported"))
    j = planned.select("node").distinct().withColumn("planned", F.lit(True)).join(best, "node", "full").fillna({"planned": False, "reported": False, "status": "not_run"})
    ran = F.col("status").isin("ran", "executed")
    return j.withColumn("divergence", F.when(F.col("planned") & ~ran, "planned_not_run").when(~F.col("planned") & ran, "ran_not_planned"))


def verify_blocks(blocks: DataFrame, ledger: DataFrame, strict: bool = True) -> DataFrame:
    """Blocks by node against the reconciled ledger; strict: a block without a node fails too."""
    j = blocks.join(ledger.select("node", "status", F.col("divergence").alias("ledger_divergence")), "node", "left")
    ok = F.col("status").isin("ran", "executed")
    return j.withColumn("verified", F.coalesce(ok, F.lit(False)) | (F.col("node").isNull() & F.lit(not strict)))


def triangulate(signals: DataFrame, least: int = 2) -> DataFrame:
    """Entities with independent support (entity, modality, lineage, direction): a lineage counts once, whatever modalities report it; conflict is support in both directions."""
    one = signals.groupBy("entity", "lineage").agg(F.min("modality").alias("modality"), F.max_by("direction", F.abs("direction")).alias("direction"))
    return one.groupBy("entity").agg(F.count("*").alias("lineages"), F.count_distinct("modality").alias("modalities"), (F.count_distinct(F.signum("direction")) > 1).alias("conflict")).withColumn("converging", (F.col("lineages") >= least) & ~F.col("conflict"))


def evidence_graph(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (src, dst, modality) from modalities' lineages to entities."""
    nodes = signals.select(F.col("entity").alias("id"), F.lit("entity").alias("kind")).union(signals.select("lineage", F.lit("lineage"))).distinct()
    return nodes, signals.select(F.col("lineage").alias("src"), F.col("entity").alias("dst"), "modality").distinct()


def contrast_patterns(de: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairs of contrasts: genes significant in both, and how many go the same way."""
    s = de.where(F.coalesce(F.col("padj") < alpha, F.lit(False))).select("contrast", "gene", F.signum("log2fc").alias("s"))
    j = s.withColumnsRenamed({"contrast": "a", "s": "x"}).join(s.withColumnsRenamed({"contrast": "b", "s": "y"}), "gene").where("a < b")
    return j.groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("x") == F.col("y")).alias("same"), F.count_if(F.col("x") != F.col("y")).alias("opposite"))


def falsification(claims: DataFrame, jackknife: DataFrame) -> DataFrame:
    """Claims (claim, feature) with the outcome of leaving units out: survived, broken, or untested."""
    j = claims.join(jackknife.select("feature", "stable", "most_influential"), "feature", "left")
    return j.withColumn("certificate", F.when(F.col("stable").isNull(), "untested").when(F.col("stable"), "survived").otherwise("broken"))


def hypothesis_gates(h: DataFrame) -> DataFrame:
    """Hypotheses (id, prediction, refuted_by, entities array, known array): falsifiable names both sides, grounded has all its entities known; the rest is quarantined."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    out = h.withColumn("falsifiable", has(F.col("prediction")) & has(F.col("refuted_by")) & ~F.lower(F.col("prediction")).eqNullSafe(F.lower("refuted_by")))
    out = out.withColumn("grounded", (F.size("entities") > 0) & (F.size(F.array_except("entities", "known")) == 0))
    return out.withColumn("quarantined", ~(F.col("falsifiable") & F.col("grounded")))


def rank_hypotheses(h: DataFrame, signals: DataFrame) -> DataFrame:
    """By independent lines (descending), mean tanh of effects (descending), caveats, then input order; signals that share a lineage count once, with the largest effect."""
    lines = signals.groupBy("id", "lineage").agg(F.max(F.abs("effect")).alias("e")).groupBy("id").agg(F.count("*").alias("lines"), F.avg(F.tanh("e")).alias("strength"))
    j = h.join(lines, "id", "left").fillna({"lines": 0, "strength": 0.0})
    order = Window.orderBy(F.desc("lines"), F.desc("strength"), F.col("caveats"), F.col("position"))
    return j.withColumn("rank", F.row_number().over(order))


def flatten_signals(findings: DataFrame, modality: str, entity: str, effect: str, items="items") -> DataFrame:
    """Signals of one modality's findings, whose items are an array of structs."""
    return findings.select("lineage", F.explode(items).alias("i")).select(F.lit(modality).alias("modality"), "lineage", F.col(f"i.{entity}").alias("entity"), F.col(f"i.{effect}").cast("double").alias("effect")).withColumn("direction", F.signum("effect"))


def annotation_coherence(markers: DataFrame, sizes: DataFrame, least: int = 3) -> DataFrame:
    """Clusters (cluster, label) with few verified markers or markers that another label claims too."""
    reuse = markers.groupBy("marker").agg(F.count_distinct("label").alias("labels"))
    j = markers.join(reuse, "marker").groupBy("cluster", "label").agg(F.count_if("verified").alias("verified"), F.count_if(F.col("labels") > 1).alias("reused"))
    return sizes.join(j, "cluster", "left").withColumn("flags", F.array_compact(F.array(F.when(F.coalesce("verified", F.lit(0)) < least, F.lit("few verified markers")), F.when(F.col("reused") > 0, F.lit("markers reused")))))


def readiness(checks: DataFrame) -> DataFrame:
    """Per modality (modality, check, passed, required): ready, partial or blocked, and what failed."""
    return checks.groupBy("modality").agg(F.when(F.count_if(F.col("required") & ~F.col("passed")) > 0, "blocked").when(F.count_if(~F.col("passed")) > 0, "partial").otherwise("ready").alias("state"), F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("failed"))


def replicate_correlations(matrix: DataFrame, samples: DataFrame, low: float = 0.8) -> DataFrame:
    """Pairs of samples of one group whose correlation of log2(x + 1) is below low."""
    log = matrix.select("feature", "sample", F.log2(F.col("value") + 1).alias("v")).join(samples.select("sample", "group"), "sample")
    j = log.withColumnsRenamed({"sample": "a", "v": "x"}).join(log.withColumnsRenamed({"sample": "b", "v": "y"}), ["feature", "group"]).where("a < b")
    return j.groupBy("group", "a", "b").agg(F.corr("x", "y").alias("r")).where(F.col("r") < low)


def factor_concordance(factors: DataFrame, expression: DataFrame, a: str, b: str) -> DataFrame:
    """Factors (factor, change between a and b) against the difference of their expression's means by group (gene, group, mean)."""
    wide = expression.groupBy("gene").agg(F.avg(F.when(F.col("group") == a, F.col("mean"))).alias("x"), F.avg(F.when(F.col("group") == b, F.col("mean"))).alias("y"))
    j = factors.join(wide, F.upper(factors["factor"]) == F.upper(wide["gene"]), "left")
    return j.select("factor", "change", (F.col("x") - F.col("y")).alias("expression_change"), F.when(F.col("x").isNull() | F.col("y").isNull(), "unmeasured").when(F.signum("change") == F.signum(F.col("x") - F.col("y")), "concordant").otherwise("discordant").alias("state"))


def same_cells(a: DataFrame, b: DataFrame, cell="cell", least: float = 0.5) -> DataFrame:
    """One row: cells of both modalities, shared ones, repeated barcodes, and whether the same-cell contract holds."""
    x, y = a.agg(F.count(cell).alias("n_a"), F.count_distinct(cell).alias("d_a")), b.agg(F.count(cell).alias("n_b"), F.count_distinct(cell).alias("d_b"))
    s = a.select(cell).distinct().join(b.select(cell).distinct(), cell).agg(F.count("*").alias("shared"))
    j = x.crossJoin(y).crossJoin(s)
    return j.withColumn("holds", (F.col("n_a") == F.col("d_a")) & (F.col("n_b") == F.col("d_b")) & (F.col("shared") >= least * F.least("d_a", "d_b")) & (F.col("shared") > 0))
