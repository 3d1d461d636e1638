"""Sequencing operators that are table-shaped (H1 to H18): reads are rows of an alignments table."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.scalars import reverse_complement
from veldt.operators.intervals import overlap_join


def umi_dedup(reads: DataFrame, locus=("chrom", "strand", "anchor")) -> DataFrame:
    """Directional UMI collapse at a locus: a UMI is absorbed by one that differs in one base and has at least 2 n - 1 of its reads; of each cluster the best read stays, by
    mapq, quality and name. UMIs are counted before the graph is built, so a locus is as large as its distinct UMIs."""
    counts = reads.groupBy(*locus, "umi").agg(F.count("*").alias("n"))
    kind = {f.name: f.dataType.simpleString() for f in counts.schema.fields}

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["n", "umi"], ascending=[False, True])
        n = dict(zip(order["umi"], order["n"], strict=True))
        root: dict[str, str] = {}
        for u in n:
            if u in root:
                continue
            root[u], queue = u, [u]
            while queue:
                x = queue.pop()
                for i in range(len(x)):
                    for c in "ACGTN":
                        y = x[:i] + c + x[i + 1 :]
                        if y in n and y not in root and n[x] >= 2 * n[y] - 1:
                            root[y] = u
                            queue.append(y)
        return pdf.assign(cluster=[root[u] for u in pdf["umi"]])

    roots = counts.groupBy(*locus).applyInPandas(collapse, ", ".join(f"`{c}` {kind[c]}" for c in counts.columns) + ", cluster string")
    keyed = reads.join(roots.select(*locus, "umi", "cluster"), [*locus, "umi"])
    rest = [c for c in reads.columns if c not in locus]
    best = keyed.groupBy(*locus, "cluster").agg(F.min(F.struct((-F.col("mapq")).alias("a"), (-F.col("quality")).alias("b"), F.col("name").alias("c"), F.struct(*rest).alias("r"))).alias("m"), F.count("*").alias("reads"))
    return best.select(*locus, "m.r.*", "cluster", "reads")


def demultiplex(counts: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Counts (barcode, feature, value) summed by the sample of their barcode."""
    return counts.join(barcodes, "barcode").groupBy("sample", "feature").agg(F.sum("value").alias("value"))


def strandedness(reads: DataFrame, genes: DataFrame, least: int = 200) -> DataFrame:
    """One row: informative reads (inside genes of one strand only), shares of sense and antisense, and the call."""
    hit = overlap_join(reads, genes).groupBy("name", "strand").agg(F.min("b_strand").alias("g"), F.max("b_strand").alias("h")).where("g = h")
    n, s = F.count("*"), F.avg((F.col("strand") == F.col("g")).cast("double"))
    call = F.when(n < least, "undetermined").when(s >= 0.8, "forward").when(s <= 0.2, "reverse").when(s.between(0.4, 0.6), "unstranded").otherwise("ambiguous")
    return hit.agg(n.alias("informative"), s.alias("sense"), (1 - s).alias("antisense"), call.alias("strandedness"))


def clean_matrix(wide: DataFrame, id_column="Geneid", drop=("Chr", "Start", "End", "Strand", "Length")) -> DataFrame:
    """A wide counts table in long form; sample names without path and .bam."""
    samples = [c for c in wide.columns if c not in (id_column, *drop)]
    long = wide.unpivot([id_column], samples, "sample", "value") if samples else wide.limit(0)
    return long.select(F.col(f"`{id_column}`").alias("feature"), F.regexp_replace(F.regexp_replace("sample", r"^.*/", ""), r"\.bam$", "").alias("sample"), F.col("value").cast("long").alias("value"))


FASTQ = re.compile(r"^(?P<sample>.+?)(?:_S\d+)?(?:_L(?P<lane>\d{3}))?[_.](?:R|read)?(?P<read>[12])(?:_\d{3})?\.(?:fastq|fq)(?:\.gz)?$")


def fastq_manifest(names: list[str]) -> list[dict]:
    """Files by sample and lane, paired; names that fit no pattern come with an error."""
    found: dict[tuple, dict] = {}
    for n in sorted(names):
        m = FASTQ.match(n.rpartition("/")[2])
        key = (m["sample"], m["lane"] or "001") if m else (n, None)
        row = found.setdefault(key, {"sample": key[0], "lane": key[1], "r1": None, "r2": None, "error": None if m else "unknown name"})
        if m:
            row[f"r{m['read']}"] = n
    return [r | {"paired": bool(r["r1"] and r["r2"])} for r in found.values()]


def whitelist_orientation(barcodes: DataFrame, whitelist: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: match rates of barcodes as they are and reverse complemented, and the orientation (null below least)."""
    n = barcodes.agg(F.count("*").alias("n"))
    one = lambda c, name: barcodes.select(c.alias("barcode")).join(whitelist.select("barcode").distinct(), "barcode", "left_semi").agg(F.count("*").alias(name))
    rows = n.crossJoin(one(F.col("barcode"), "d")).crossJoin(one(reverse_complement(F.col("barcode")), "r")).select("n", (F.col("d") / F.col("n")).alias("direct"), (F.col("r") / F.col("n")).alias("reverse"))
    return rows.withColumn("orientation", F.when(F.greatest("direct", "reverse") >= least, F.when(F.col("direct") >= F.col("reverse"), "direct").otherwise("reverse_complement")))


def merge_libraries(parts: dict[str, DataFrame]) -> DataFrame:
    """Fragments of all libraries, barcodes prefixed by their library."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (d.withColumn("barcode", F.concat_ws("#", F.lit(n), "barcode")) for n, d in parts.items()))


def fragments_to_matrix(fragments: DataFrame, peaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, peak, value) with the fragments' multiplicity (column n, or 1) summed over every peak they overlap, and all cells, those off peaks too. Repeated peaks are an error."""
    from veldt.plans.execute import has_repeats

    if has_repeats(peaks, ["chrom", "start", "end"]):
        raise ValueError("repeated peaks")
    f = fragments if "n" in fragments.columns else fragments.withColumn("n", F.lit(1))
    name = F.concat(F.col("chrom"), F.lit(":"), F.col("b_start"), F.lit("-"), F.col("b_end"))
    hits = overlap_join(f, peaks.select("chrom", "start", "end"))
    return hits.groupBy(F.col("barcode").alias("cell"), name.alias("peak")).agg(F.sum("n").alias("value")), fragments.select(F.col("barcode").alias("cell")).distinct()


def motif_threshold(pwm: np.ndarray, background=(0.25,) * 4, p: float = 1e-4, step: float = 0.01) -> float:
    """The least score whose chance of being reached is at most p: the distribution of discretised scores, by convolution over columns."""
    cells = np.rint(np.asarray(pwm) / step).astype(int)
    low = cells.min(1)
    dist = np.ones(1)
    for col, base in zip(cells, low, strict=True):
        new = np.zeros(len(dist) + int((col - base).max()))
        for x, q in zip(col - base, background, strict=True):
            new[x : x + len(dist)] += q * dist
        dist = new
    tail = np.cumsum(dist[::-1])[::-1]
    i = int(np.argmax(tail <= p)) if (tail <= p).any() else len(tail)
    return (i + low.sum()) * step


def scan_motifs(sequences: DataFrame, motifs: dict[str, list[list[float]]], p: float = 1e-4) -> DataFrame:
    """Hits (id, motif, start, strand, score) of log-odds matrices (rows A C G T) over sequences (id, sequence), both strands; other letters end a window."""
    table = {n: (np.asarray(m, float), motif_threshold(np.asarray(m, float), p=p)) for n, m in motifs.items()}
    kind = dict(sequences.dtypes)["id"]
    code = np.full(256, 4)
    for i, c in enumerate("ACGT"):
        code[ord(c)] = code[ord(c.lower())] = i

    def run(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["id"], pdf["sequence"], strict=True):
                x = code[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
                for name, (m, t) in table.items():
                    w = len(m)
                    if len(x) < w:
                        continue
                    for strand, mat in (("+", m), ("-", m[::-1, ::-1])):
                        padded = np.column_stack([mat, np.full(w, -math.inf)])
                        score = sum(padded[j][x[j : len(x) - w + 1 + j]] for j in range(w))
                        out += [(i, name, int(k), strand, float(score[k])) for k in np.flatnonzero(score >= t - 1e-9)]
            yield pd.DataFrame(out, columns=["id", "motif", "start", "strand", "score"])

    return sequences.select("id", "sequence").mapInPandas(run, f"id {kind}, motif string, start long, strand string, score double")


def gc_share(sequences: DataFrame, sequence="sequence") -> DataFrame:
    known = F.length(F.regexp_replace(sequence, "(?i)[^acgt]", ""))
    return sequences.withColumn("gc", F.when(known > 0, F.length(F.regexp_replace(sequence, "(?i)[^gc]", "")) / known))


def strand_correlation(reads: DataFrame, lags: list[int]) -> DataFrame:
    """Cross-correlation of 5' ends by lag: r of plus-strand counts with minus-strand counts shifted, over the positions' span of each contig."""
    n = reads.groupBy("chrom", "pos", "strand").agg(F.count("*").alias("n"))
    plus, minus = (n.where(F.col("strand") == s).select("chrom", "pos", F.col("n").alias(c)) for s, c in (("+", "x"), ("-", "y")))
    span = n.groupBy("chrom").agg((F.max("pos") - F.min("pos") + 1).alias("l")).agg(F.sum("l").alias("l"))
    sx = plus.agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    sy = minus.agg(F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    lag = reads.sparkSession.createDataFrame([(int(x),) for x in lags], "lag long")
    xy = plus.crossJoin(F.broadcast(lag)).withColumn("pos", F.col("pos") + F.col("lag")).join(minus, ["chrom", "pos"]).groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    r = lag.join(xy, "lag", "left").fillna({"xy": 0}).crossJoin(F.broadcast(sx)).crossJoin(F.broadcast(sy)).crossJoin(F.broadcast(span))
    top = F.col("xy") - F.col("sx") * F.col("sy") / F.col("l")
    return r.select("lag", (top / F.sqrt((F.col("xx") - F.col("sx") * F.col("sx") / F.col("l")) * (F.col("yy") - F.col("sy") * F.col("sy") / F.col("l")))).alias("r"))


def strand_scores(cc: dict[int, float], fragment: int, read_length: int) -> tuple[float | None, float | None]:
    """NSC and RSC from correlations by lag: the fragment peak over the least, and over the phantom peak."""
    least = min(cc.values())
    nsc = cc[fragment] / least if least > 0 else None
    phantom = cc[read_length] - least
    return nsc, ((cc[fragment] - least) / phantom if phantom > 0 else None)


def outlier_samples(matrix: DataFrame, z: float = 3.0) -> list[str]:
    """Samples beyond z robust deviations on the first component."""
    from veldt.operators.embedding import sample_pca

    scores, _ = sample_pca(matrix, 1)
    if scores.empty:
        return []
    x = scores["pc1"]
    mad = 1.4826 * (x - x.median()).abs().median()
    return sorted(x.index[(x - x.median()).abs() > z * mad]) if mad > 0 else []


def inject_condition(cells: DataFrame, sheet: DataFrame, sample="sample") -> DataFrame:
    """Cells with their sample's condition; a sample that the sheet lacks is an error."""
    if missing := [r[0] for r in cells.select(sample).distinct().join(sheet, sample, "left_anti").orderBy(sample).limit(21).collect()]:
        raise ValueError(f"samples without a condition: {missing}")
    return cells.join(sheet, sample)


def apply_labels(cells: DataFrame, labels: dict[str, str], cluster="cluster") -> DataFrame:
    table = cells.sparkSession.createDataFrame([(str(k), v) for k, v in labels.items()], f"{cluster} string, label string")
    return cells.join(table, cells[cluster].cast("string") == table[cluster], "left").drop(table[cluster])


def infer_design(metadata: list[dict]) -> dict:
    """The column that best looks like the condition (2 to n/2 levels, each repeated), and what else varies."""
    if not metadata:
        return {"condition": None, "factors": []}
    levels = {c: Counter(str(r[c]) for r in metadata if r[c] is not None) for c in metadata[0]}
    able = [c for c, n in levels.items() if 2 <= len(n) <= len(metadata) / 2 and min(n.values()) >= 2]
    hint = [c for c in able if re.search(r"condition|treatment|group|genotype|disease|status", c, re.I)]
    pick = (hint or sorted(able, key=lambda c: len(levels[c])) or [None])[0]
    return {"condition": pick, "levels": dict(levels.get(pick, {})), "factors": [c for c in able if c != pick]}
