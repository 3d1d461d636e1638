"""Joins with rules of their own (J2 to J9, J20 to J29): correspondence, reversed contrasts, bijections, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.plans.execute import has_repeats
from veldt.plans.model import PlanViolation


def null_safe(a: DataFrame, b: DataFrame, keys, how: str = "inner", suffix: str = "__right") -> DataFrame:
    """An equi-join in which a null key meets a null key; b's other columns that clash get the suffix."""
    renamed = b.select(*(F.col(f"`{c}`").alias(f"__k_{c}" if c in keys else (c if c not in a.columns else f"{c}{suffix}")) for c in b.columns))
    on = reduce(lambda x, y: x & y, (a[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys))
    return a.join(renamed, on, how).drop(*(f"__k_{k}" for k in keys))


def matched_effects(a: DataFrame, b: DataFrame, key="key", known="known") -> DataFrame:
    """Rows of both sides by key, where each has a padj or is known to be significant."""
    ok = F.col("padj").isNotNull() | F.coalesce(F.col(known), F.lit(False))
    right = b.where(ok).select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in b.columns if c != key))
    return a.where(ok).join(right, key)


def outer_counts(parts: list[DataFrame]) -> DataFrame:
    """Samples' counts in long form, a feature that a sample lacks counting 0."""
    rows = reduce(DataFrame.unionByName, parts).groupBy("feature", "sample").agg(F.sum("value").alias("value"))
    grid = rows.select("feature").distinct().crossJoin(rows.select("sample").distinct())
    return grid.join(rows, ["feature", "sample"], "left").fillna({"value": 0})


def enforce_correspondence(counts: DataFrame, metadata: DataFrame, excluded=()) -> DataFrame:
    """The counts of samples with metadata. An orphan on either side that is not excluded is an error, and so is an excluded sample that is no orphan."""
    c, m = counts.select("sample").distinct(), metadata.select("sample").distinct()
    # names of samples are listed for the error: 21 are enough to see
    orphans = c.join(m, "sample", "left_anti").withColumn("side", F.lit("counts")).union(m.join(c, "sample", "left_anti").withColumn("side", F.lit("metadata")))
    left = orphans.where(~F.col("sample").isin(list(excluded))) if excluded else orphans
    if found := left.orderBy("sample").limit(21).collect():
        raise PlanViolation(f"samples without a counterpart: {[tuple(r) for r in found]}")
    if excluded:
        known = {r["sample"] for r in orphans.where(F.col("sample").isin(list(excluded))).collect()}
        if wrong := sorted(set(excluded) - known):
            raise PlanViolation(f"excluded, but not orphans: {wrong}")
    return counts.join(m, "sample", "left_semi")


def align_contrasts(a: DataFrame, b: DataFrame, group: str | None = None) -> DataFrame:
    """Contrasts (id, numerator, denominator) with equal or reversed arms, and whether they are flipped: two equi-joins, no theta join."""
    b = b.select(F.col("id").alias("b_id"), F.col("numerator").alias("bn"), F.col("denominator").alias("bd"), *([F.col(group).alias("bg")] if group else []))
    same = (F.col("bg") == F.col(group)) if group else F.lit(True)
    parts = [a.join(b, (F.col("numerator") == F.col(x)) & (F.col("denominator") == F.col(y)) & same).select(F.col("id"), "b_id", F.lit(f).alias("flipped")) for x, y, f in (("bn", "bd", False), ("bd", "bn", True))]
    return parts[0].union(parts[1]).distinct()


def map_samples(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """sample renamed by a one-to-one mapping (sample, target)."""
    for side in ("sample", "target"):
        if has_repeats(mapping, [side]):
            raise PlanViolation(f"the mapping repeats {side}")
    return df.join(mapping, "sample").drop("sample").withColumnRenamed("target", "sample")


def join_labels(queries: DataFrame, labels: DataFrame, transforms: list, unassigned: str = "unassigned") -> DataFrame:
    """Barcodes with the labels of a reference (barcode, label). Key transforms are tried in order; the first with any match is used, and
    must be one to one. Null or blank labels, and barcodes without one, are unassigned."""
    for f in transforms:
        q = queries.withColumn("__key", f(F.col("barcode")))
        r = labels.select(f(F.col("barcode")).alias("__key"), F.col("label"))
        if q.join(r.select("__key"), "__key", "left_semi").limit(1).count():
            if has_repeats(r.where("__key is not null"), ["__key"]) or has_repeats(q.where("__key is not null"), ["__key"]):
                raise PlanViolation("barcodes are not unique under the transform")
            blank = F.trim(F.coalesce("label", F.lit(""))) == ""
            return q.join(r, "__key", "left").withColumn("label", F.when(blank, unassigned).otherwise(F.col("label"))).drop("__key")
    return queries.withColumn("label", F.lit(unassigned))


def translate_barcodes(a: DataFrame, b: DataFrame, a_key: Column, b_key: Column) -> DataFrame:
    """a_barcode and b_barcode under derived keys, one to one."""
    x, y = a.select(a_key.alias("k"), F.col("barcode").alias("a_barcode")), b.select(b_key.alias("k"), F.col("barcode").alias("b_barcode"))
    if has_repeats(x, ["k"]) or has_repeats(y, ["k"]):
        raise PlanViolation("not one to one")
    return x.join(y, "k").drop("k")


def subtree(tables: list[tuple[DataFrame, str, str]], root: DataFrame) -> list[DataFrame]:
    """A chain of semi joins: tables as (table, its parent column, its id column), from the root's ids down."""
    out, parents = [], root
    for df, parent, own in tables:
        kept = df.join(parents.select(F.col(parents.columns[0]).alias(parent)), parent, "left_semi")
        out.append(kept)
        parents = kept.select(own)
    return out


def grids_equal(a: DataFrame, b: DataFrame, keys=("chrom", "start", "end")) -> bool:
    """Whether two tables of bins hold the same rows, repeats counted."""
    side = lambda d, n: d.groupBy(*keys).agg(F.count("*").alias(n))
    return null_safe(side(a, "x"), side(b, "y"), list(keys), "full").where("not (x <=> y)").limit(1).count() == 0


def barcode_groups(fragments: DataFrame, groups: DataFrame) -> DataFrame:
    return fragments.join(groups, "barcode")


def best_name_match(a: DataFrame, b: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """For each column of a (long: column, value) the column of b that shares most distinct values: least of them and the share of its own."""
    x, y = a.select("column", "value").distinct(), b.select(F.col("column").alias("b_column"), "value").distinct()
    size = x.groupBy("column").agg(F.count("*").alias("n"))
    n = x.join(y, "value").groupBy("column", "b_column").agg(F.count("*").alias("shared")).join(size, "column").where((F.col("shared") >= least) & (F.col("shared") >= share * F.col("n")))
    from veldt.functions.order import first_row

    return first_row(n, ["column"], [F.desc("shared"), F.col("b_column")])


def motifs_to_factors(motifs: DataFrame, genes: DataFrame, least_cells: int = 10) -> DataFrame:
    """Motifs (motif) with the expressed genes (gene, cells) that their subunits name; all subunits must be expressed."""
    from veldt.functions.scalars import subunits

    parts = motifs.select("motif", F.explode(subunits(F.col("motif"))).alias("subunit"))
    known = genes.where(F.col("cells") >= least_cells).select(F.upper("gene").alias("subunit"), "gene")
    found = parts.join(known, "subunit", "left").groupBy("motif").agg(F.count("*").alias("n"), F.count("gene").alias("k"), F.sort_array(F.collect_set("gene")).alias("genes"))
    return found.where("n = k").select("motif", "genes")


def link_claims(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims with their ledger node by (modality, analysis), and the first reason why one is not linked."""
    n = nodes.select("modality", "analysis", "node", F.col("status").alias("node_status"))
    out = claims.join(n, ["modality", "analysis"], "left")
    reason = F.when(F.col("modality").isNull() | F.col("analysis").isNull(), "claim names no analysis").when(F.col("node").isNull(), "no such node").when(~F.col("node_status").isin("ran", "executed"), "node did not run")
    return out.withColumn("reason", reason).withColumn("linked", F.col("reason").isNull())


def factor_support(factors: DataFrame, expression: DataFrame, flipped: Column | None = None, alpha: float = 0.05) -> DataFrame:
    """Evidence on transcription factors (factor, direction) against the expression (gene, effect, padj) of their subunits: concordant, discordant,
    expressed only or unmeasured."""
    from veldt.functions.scalars import subunits

    parts = factors.select("factor", "direction", F.explode(subunits(F.col("factor"))).alias("gene"))
    sign = F.signum("effect") * (F.when(flipped, -1).otherwise(1) if flipped is not None else 1)
    got = parts.join(expression.select(F.upper("gene").alias("gene"), "effect", "padj"), "gene", "left")
    kind = F.when(F.col("effect").isNull(), "unmeasured").when(F.coalesce(F.col("padj") < alpha, F.lit(False)), F.when(sign == F.col("direction"), "concordant").otherwise("discordant")).otherwise("expressed_only")
    return got.withColumn("support", kind)


def term_key(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(term), r"[^a-z0-9]+", " "))


def shared_terms(a: DataFrame, b: DataFrame, term="term") -> DataFrame:
    x = a.select(term_key(F.col(term)).alias("key"), *(F.col(c).alias(f"a_{c}") for c in a.columns)).dropDuplicates(["key"])
    return x.join(b.select(term_key(F.col(term)).alias("key"), *(F.col(c).alias(f"b_{c}") for c in b.columns)).dropDuplicates(["key"]), "key")


def diff(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Keys that were added, removed or changed from a to b, with both rows."""
    key = list(key)
    rest = [c for c in a.columns if c not in key]
    x = a.select(*key, F.struct(*rest).alias("before"), F.lit(True).alias("__a"))
    y = b.select(*key, F.struct(*rest).alias("after"), F.lit(True).alias("__b"))
    both = x.join(y, key, "full")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", kind).where("change is not null").select(*key, "change", "before", "after")
