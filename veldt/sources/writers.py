"""Sinks (K1 to K11). Tables go through Spark's commit protocol; text files with a fixed layout are written as one part where they are small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.scalars import json_safe
from veldt.operators.state import write_json

__all__ = ["append_json", "bedgraph", "consensus_bed", "count_matrix", "delimited", "differential", "links", "persist", "write_json"]


def delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, nullValue="", emptyValue="")


def differential(df: DataFrame, path: str, symbols: DataFrame | None = None, padj: float = 0.05) -> None:
    """Significant rows with symbols, ordered by padj."""
    out = df.where(F.coalesce(F.col("padj") < padj, F.lit(False)))
    out = out.join(symbols, "feature", "left") if symbols is not None else out
    delimited(json_safe(out.orderBy(F.col("padj").asc_nulls_last(), "feature")), path)


def count_matrix(long: DataFrame, path: str, samples: list[str] | None = None) -> None:
    """feature x sample, absent pairs 0; samples in their own order, so Spark need not look for them."""
    names = samples or [r[0] for r in long.select("sample").distinct().orderBy("sample").collect()]
    delimited(long.groupBy("feature").pivot("sample", names).agg(F.sum("value")).na.fill(0), path)


def consensus_bed(df: DataFrame, path: str, name: str = "consensus") -> None:
    """BED rows in order of position, the support as score."""
    rows = df.orderBy("chrom", "start", "end").select("chrom", "start", "end", F.concat(F.lit(name + "_"), "chrom", F.lit("_"), "start").alias("name"), *(c for c in df.columns if c not in ("chrom", "start", "end")))
    delimited(rows, path, header=False)


def bedgraph(df: DataFrame, path: str, scale: float = 1.0) -> None:
    delimited(df.select("chrom", "start", "end", (F.col("score") * scale).alias("score")).orderBy("chrom", "start"), path, header=False)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def links(df: DataFrame, path: str) -> None:
    from veldt.operators.sets import ordered_links

    delimited(ordered_links(df), path, sep=",")


def persist(write, label: str, path: str, warnings: list) -> str | None:
    """Runs a write; a failure is told, not raised, and no path is claimed."""
    try:
        write(path)
        return path
    except Exception as e:
        warnings.append(f"{label}: {type(e).__name__}: {e}")
        return None
