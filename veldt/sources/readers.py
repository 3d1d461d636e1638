"""Readers (S1 to S18). Text formats are parsed in Spark; ids stay text; headers are looked at on the driver, in a few lines. External binaries' formats
(BAM, HDF5) enter as tables that their own tools have written."""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import gtf_attribute, strip_version

ANNOTATION = ("Chr", "Start", "End", "Strand", "Length")


def _first_lines(spark: SparkSession, path: str, n: int = 15) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def _separator(path: str, lines: list[str]) -> str:
    if re.search(r"\.tsv|\.txt|\.tab", path):
        return "\t"
    return max("\t,;", key=lambda s: lines[0].count(s)) if lines else ","


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file, all columns as text: the header is the first of the leading lines with the most fields, comment lines before it are skipped, names that are
    blank or repeated get a number."""
    lines = _first_lines(spark, path)
    sep = _separator(path, lines)
    rows = [next(csv.reader(io.StringIO(x), delimiter=sep), []) for x in lines]
    widths = [0 if x.startswith("#") and not x.startswith("#chrom") else len(r) for x, r in zip(lines, rows, strict=True)]
    if not widths or max(widths) == 0:
        return spark.createDataFrame([], "value string")
    at = widths.index(max(widths))
    names: list[str] = []
    for i, name in enumerate(rows[at]):
        name = name.strip().lstrip("#") or f"column_{i}"
        names.append(name if name not in names else f"{name}_{i}")
    skip = set(lines[: at + 1])
    schema = ", ".join(f"`{n}` string" for n in names)
    text = spark.read.text(path).where(~F.col("value").isin(list(skip)) & ~F.col("value").startswith("#"))
    return text.select(F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def table(spark: SparkSession, path: str, warnings: list | None = None) -> DataFrame:
    """By suffix: parquet, JSON lines or delimited; what cannot be read is a warning and an empty table."""
    try:
        if path.endswith(".parquet"):
            return spark.read.parquet(path)
        if re.search(r"\.jsonl?(\.gz)?$", path):
            return spark.read.json(path)
        df = delimited(spark, path)
        df.schema  # noqa: B018
        return df
    except Exception as e:
        if warnings is not None:
            warnings.append(f"{path}: {type(e).__name__}")
        return spark.createDataFrame([], "value string")


def count_matrix(spark: SparkSession, paths: list[str], allow_nonraw: bool = False) -> DataFrame:
    """Count matrices as feature, sample, value: one wide file, or a file for each sample (two columns), annotation columns dropped, absent pairs 0. Matrices with more columns than rows are
    turned. What is not raw counts is refused."""
    from veldt.operators.counts import raw_count_report

    parts = []
    for p in paths:
        df = delimited(spark, p)
        key, rest = df.columns[0], [c for c in df.columns[1:] if c not in ANNOTATION]
        if len(rest) == 1 and len(paths) > 1:
            name = re.sub(r"\.(tsv|csv|txt|counts)(\.gz)?$", "", p.rpartition("/")[2])
            long = df.where(~F.col(f"`{key}`").startswith("__")).select(F.col(f"`{key}`").alias("feature"), F.lit(name).alias("sample"), F.col(f"`{rest[0]}`").try_cast("double").alias("value"))
        else:
            long = df.unpivot([f"`{key}`"], [f"`{c}`" for c in rest], "sample", "value").select(F.col(f"`{key}`").alias("feature"), "sample", F.col("value").try_cast("double").alias("value"))
            if df.limit(len(rest) + 1).count() < len(rest):
                long = long.select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value")
        parts.append(long)
    rows = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        from veldt.operators.joins import outer_counts

        rows = outer_counts(parts)
    if not allow_nonraw and not raw_count_report(rows).first()["raw"]:
        raise ValueError("not raw counts")
    return rows


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path)


def cpm_matrix(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """gene, sample, cpm from a wide or a long (sample_id, cpm) file; repeated pairs are an error; genes that an alias unites are summed, null only if all are."""
    df = delimited(spark, path)
    low = {c.lower(): c for c in df.columns}
    if "sample_id" in low and "cpm" in low:
        long = df.select(F.col(f"`{df.columns[0]}`").alias("gene"), F.col(f"`{low['sample_id']}`").alias("sample"), F.col(f"`{low['cpm']}`").try_cast("double").alias("cpm"))
    else:
        key = df.columns[0]
        long = df.unpivot([f"`{key}`"], [f"`{c}`" for c in df.columns[1:]], "sample", "cpm").select(F.col(f"`{key}`").alias("gene"), "sample", F.col("cpm").try_cast("double").alias("cpm"))
    if long.groupBy("gene", "sample").count().where("count > 1").limit(1).count():
        raise ValueError("repeated rows or columns")
    if aliases:
        names = spark.createDataFrame(list(aliases.items()), "gene string, alias string")
        long = long.join(names, "gene", "left").select(F.coalesce("alias", "gene").alias("gene"), "sample", "cpm")
    return long.groupBy("gene", "sample").agg(F.sum("cpm").alias("cpm"))


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """term, gene (upper case) of a gene-set file."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) > 2).select(f[0].alias("term"), F.explode(F.slice(f, 3, F.size(f))).alias("gene")).select("term", F.upper(F.trim("gene")).alias("gene")).where("gene <> ''").distinct()


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a GTF with the attributes that are used: chrom, feature, start (0-based), end, strand and names."""
    df = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string")
    a = F.col("attributes")
    return df.select("chrom", "feature", (F.col("start") - 1).alias("start"), "end", "strand", *(gtf_attribute(a, n).alias(n) for n in ("gene_id", "gene_name", "transcript_id")), F.coalesce(gtf_attribute(a, "gene_type"), gtf_attribute(a, "gene_biotype")).alias("biotype"), a.alias("attributes"))


def gene_models(rows: DataFrame) -> DataFrame:
    """Genes with tss, strand, span and exons array<struct<start,end>>."""
    genes = rows.where(F.col("feature") == "gene").select("gene_id", F.coalesce("gene_name", "gene_id").alias("gene"), "chrom", "start", "end", "strand", F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start")).alias("tss"), "biotype")
    exons = rows.where(F.col("feature") == "exon").groupBy("gene_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("exons"))
    return genes.join(exons, "gene_id", "left").withColumn("exons", F.coalesce("exons", F.array().cast("array<struct<start:bigint,end:bigint>>")))


def canonical_tss(rows: DataFrame) -> DataFrame:
    """One transcription start per gene: not PAR_Y, then canonical tags, protein coding, basic, longest, least id."""
    a = F.col("attributes")
    t = rows.where(F.col("feature") == "transcript").withColumn("gene", F.coalesce("gene_name", "gene_id"))
    flags = [F.col("gene_id").contains("PAR_Y"), ~a.rlike(r"MANE_Select|Ensembl_canonical"), ~(F.col("biotype") == "protein_coding"), ~a.rlike(r'tag "?basic"?')]
    order = [F.coalesce(f, F.lit(True)).cast("int") for f in flags] + [F.col("start") - F.col("end"), F.col("transcript_id")]
    w = Window.partitionBy("gene").orderBy(*order)
    return t.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("gene", strip_version(F.col("gene_id")).alias("gene_id"), "chrom", "strand", F.when(F.col("strand") == "-", F.col("end") - 1).otherwise(F.col("start")).alias("tss"))


def gene_symbols(rows: DataFrame) -> DataFrame:
    """gene_id (without version), symbol, biotype and the length of the union of exons."""
    from veldt.functions.order import merge_runs

    names = rows.where("gene_id is not null").groupBy(strip_version(F.col("gene_id")).alias("gene_id")).agg(F.min("gene_name").alias("symbol"), F.min("biotype").alias("biotype"))
    exons = rows.where(F.col("feature") == "exon").select(strip_version(F.col("gene_id")).alias("gene_id"), "start", "end")
    length = merge_runs(exons, ["gene_id"], "start", "end").groupBy("gene_id").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    return names.join(length, "gene_id", "left")


def peaks(spark: SparkSession, path: str) -> DataFrame:
    """Scored intervals of BED-like files: the score column by the number of fields (narrowPeak and broadPeak 7, six-column 5, SEACR 4); rows without finite numbers are left out."""
    f = F.split("value", "\t")
    n = F.size(f)
    score = F.when(n >= 9, f[6]).when(n == 6, F.when(f[5].rlike(r"^.+:\d+-\d+$"), f[3]).otherwise(f[4])).when(n >= 5, f[4]).when(n == 4, f[3])
    df = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (n >= 3)).select(f[0].alias("chrom"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end"), score.try_cast("double").alias("score"))
    return df.where("start is not null and end > start and (score is null or not isnan(score) and abs(score) < double('infinity'))")


def fragments(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """chrom, start, end, barcode, n. A limit takes the first by position, not by file order."""
    df = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, barcode string, n long").fillna({"n": 1})
    return df if limit is None else df.orderBy("chrom", "start", "end", "barcode").limit(limit)


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, score double").where("start is not null")


def mex(spark: SparkSession, folder: str) -> DataFrame:
    """cell, feature, value of a sparse matrix in three text files (indices from 1)."""
    def names(file):
        lines = spark.read.text(f"{folder}/{file}").withColumn("__f", F.lit(0))
        # line numbers follow the file: one small text file is one split
        w = Window.partitionBy("__f").orderBy("__i")
        return lines.coalesce(1).withColumn("__i", F.monotonically_increasing_id()).withColumn("i", F.row_number().over(w)).select("i", F.split("value", "\t")[0].alias("name"))

    m = F.split("value", " ")
    body = spark.read.text(f"{folder}/matrix.mtx").where(~F.col("value").startswith("%") & (F.size(m) == 3))
    head = next(x for x in _first_lines(spark, f"{folder}/matrix.mtx", 10) if not x.startswith("%"))
    body = body.where(F.col("value") != head).select(m[0].cast("int").alias("f"), m[1].cast("int").alias("c"), m[2].cast("double").alias("value"))
    return body.join(names("barcodes.tsv").withColumnsRenamed({"i": "c", "name": "cell"}), "c").join(names("features.tsv").withColumnsRenamed({"i": "f", "name": "feature"}), "f").select("cell", "feature", "value")


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (i, j, count) dumped as text."""
    return spark.read.csv(path, sep="\t", comment="#", schema="i long, j long, count double").where("i is not null")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence of records (split at > by the reader)."""
    df = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    return df.select(F.regexp_extract(text, r"^(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s", "").alias("sequence")).where("id <> ''")


def motifs_meme(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    """Probability matrices of a MEME file, a motif's few rows each, on the driver."""
    out: dict[str, list[list[float]]] = {}
    name = None
    for r in spark.read.text(path).collect():
        x = r["value"].split()
        if x[:1] == ["MOTIF"]:
            name = x[2] if len(x) > 2 else x[1]
            out[name] = []
        elif name and len(x) == 4 and all(re.fullmatch(r"[\d.eE+-]+", v) for v in x):
            out[name].append([float(v) for v in x])
    return {k: v for k, v in out.items() if v}


def json_document(spark: SparkSession, path: str) -> dict:
    """A small JSON file, through Spark's file systems."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def excel(spark: SparkSession, path: str, max_sheets: int = 40) -> dict[str, DataFrame]:
    """Sheets of a workbook, where a reader for it is installed."""
    import pandas as pd

    book = pd.read_excel(path, sheet_name=None, dtype=str)
    return {n: spark.createDataFrame(d.where(d.notna(), None)) for n, d in list(book.items())[:max_sheets] if len(d)}


def detect_assay(columns: list[str], name: str = "") -> str:
    """What an untyped table looks like, from its columns."""
    low = {c.lower() for c in columns}
    if {"chrom", "start", "end"} <= low or {"chr", "start", "end"} <= low:
        return "fragments" if "barcode" in low else "intervals"
    if low & {"log2foldchange", "log2fc", "logfc"} and low & {"padj", "fdr", "adj.p.val"}:
        return "differential"
    if low & {"condition", "group", "treatment"} and low & {"sample", "sample_id"}:
        return "sample_sheet"
    return "count_matrix" if len(columns) > 2 and re.search("count|matrix|gene|peak", name + columns[0], re.I) else "unknown"


#: The prefixes of public sequence accessions.
ACCESSION = r"\b((?:SRP|ERP|DRP|PRJNA|PRJEB|PRJDB|SRX|ERX|DRX|SRR|ERR|DRR)\d+)\b"


def _soft_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a key: file, place, tag, value, and the number of the sample block they stand in (0 before the first). A file is one row while it is read, so files
    are read side by side."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "line"))
    lines = files.withColumn("line", F.trim("line")).where(F.col("line").rlike(r"^(\^SAMPLE|!Series_|!Sample_)"))
    value = F.when(F.instr("line", " = ") > 0, F.trim(F.expr("substring(line, instr(line, ' = ') + 3)"))).otherwise("")
    block = F.sum(F.col("line").startswith("^SAMPLE").cast("int")).over(Window.partitionBy("file").orderBy("at"))
    return lines.select("file", "at", F.regexp_extract("line", r"^\S+", 0).alias("tag"), value.alias("value"), block.alias("block"))


def _last(tag: str):
    return F.coalesce(F.max_by("value", F.when(F.col("tag").startswith(tag), F.col("at"))), F.lit(""))


def soft_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of SOFT family files in their order: file, block, sample, title, organism, library_strategy, characteristics (keys in lower case). Of a field or key
    given again the last counts; fields before the first sample belong to none."""
    lines = _soft_lines(spark, path).where("block > 0")
    pair = F.struct(F.lower(F.trim(F.substring_index("value", ":", 1))).alias("k"), "at", F.trim(F.expr("substring(value, instr(value, ':') + 1)")).alias("v"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("tag").startswith("!Sample_characteristics_ch1") & F.contains("value", F.lit(":")), pair)))
    later = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i + 1)["k"] != x["k"], F.lit(True)))
    named = F.map_from_entries(F.transform(later, lambda x: F.struct(x["k"], x["v"])))
    return lines.groupBy("file", "block").agg(
        _last("^SAMPLE").alias("sample"), _last("!Sample_title").alias("title"), _last("!Sample_organism_ch1").alias("organism"),
        _last("!Sample_library_strategy").alias("library_strategy"), named.alias("characteristics"),
    )


def soft_series(spark: SparkSession, path: str) -> DataFrame:
    """A row per SOFT file: title, the samples' first organism and library strategy that are not empty, supplementary files (without NONE), public accessions in the
    order of their first mention."""
    lines = _soft_lines(spark, path)

    def first(tag: str):
        return F.coalesce(F.min_by("value", F.when(F.col("tag").startswith(tag) & (F.col("block") > 0) & (F.col("value") != ""), F.col("at"))), F.lit(""))

    def listed(wanted, what):
        found = F.array_sort(F.collect_list(F.when(wanted, F.struct("at", what.alias("v")))))
        return F.transform(found, lambda x: x["v"])

    related = F.col("tag").startswith("!Series_relation") | (F.col("tag").startswith("!Sample_relation") & (F.col("block") > 0))
    extra = F.col("tag").startswith("!Series_supplementary_file") & ~F.col("value").isin("", "NONE")
    return lines.groupBy("file").agg(
        _last("!Series_title").alias("title"), first("!Sample_organism_ch1").alias("organism"), first("!Sample_library_strategy").alias("library_strategy"),
        listed(extra, F.col("value")).alias("files"), F.array_distinct(F.flatten(listed(related, F.regexp_extract_all(F.upper("value"), F.lit(ACCESSION), 1)))).alias("accessions"),
    )


def scan_directory(spark: SparkSession, folder: str, pattern: str = ".", max_files: int = 5000, max_entries: int = 20000, max_depth: int = 8, max_seconds: float = 10.0, max_bytes: int | None = None) -> tuple[list[str], dict]:
    """Files below a folder whose name matches, in any file system Spark reads, and a report: what was seen and left out, and which bound ended the scan. Symbolic
    links are not followed; a folder that cannot be listed is an error in the report."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    report = {"entries_seen": 0, "files_seen": 0, "skipped_links": 0, "skipped_large": 0, "skipped_deep": 0, "errors": [], "ended_by": None}
    found, folders, end = [], [(root, 0)], time.monotonic() + max_seconds
    while folders and not report["ended_by"]:
        here, depth = folders.pop()
        try:
            entries = fs.listStatusIterator(here)
            while entries.hasNext() and not report["ended_by"]:
                entry = entries.next()
                path = entry.getPath()
                if time.monotonic() >= end:
                    report["ended_by"] = "max_seconds"
                elif report["entries_seen"] >= max_entries:
                    report["ended_by"] = "max_entries"
                else:
                    report["entries_seen"] += 1
                    # the local file system knows a link only by a path without scheme
                    if fs.getFileLinkStatus(jvm.org.apache.hadoop.fs.Path(path.toUri().getPath())).isSymlink():
                        report["skipped_links"] += 1
                    elif entry.isDirectory():
                        if depth < max_depth:
                            folders.append((path, depth + 1))
                        else:
                            report["skipped_deep"] += 1
                    else:
                        report["files_seen"] += 1
                        if max_bytes is not None and entry.getLen() > max_bytes:
                            report["skipped_large"] += 1
                        elif re.search(pattern, path.getName()):
                            found.append(path.toString())
                            report["ended_by"] = "max_files" if len(found) >= max_files else None
        except Exception as e:
            report["errors"].append(f"{here.toString()}: {str(e).splitlines()[0]}")
    return found, report


def sqlite(spark: SparkSession, path: str, sql: str, schema: str, params=(), max_rows: int = 100_000) -> DataFrame:
    """Rows of a query on a SQLite file of the driver, opened read-only. The file is one machine's, so the rows are bounded: more than max_rows is an error."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute(sql, params).fetchmany(max_rows + 1)
    db.close()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return spark.createDataFrame(rows, schema)
