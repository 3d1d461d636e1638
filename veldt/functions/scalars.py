"""Scalar functions on columns (F1 to F30): names, intervals, text, numbers and transforms. All stay in the JVM."""

import hashlib
import json
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVAL = r"^(.+?)[:_\-](\d+)[-_:](\d+)$"


def parse_interval(name: Column, swap: bool = True) -> Column:
    """struct<chrom,start,end> of chrom:start-end, chrom-start-end or chrom_start_end; null otherwise. swap: ends in order."""
    chrom = F.regexp_extract(name, INTERVAL, 1)
    a, b = (F.regexp_extract(name, INTERVAL, i).try_cast("long") for i in (2, 3))
    low, high = (F.least(a, b), F.greatest(a, b)) if swap else (a, b)
    return F.when(chrom != "", F.struct(chrom.alias("chrom"), low.alias("start"), high.alias("end")))


def canonical_contig(chrom: Column) -> Column:
    """Without chr in any case; M is MT."""
    bare = F.upper(F.regexp_replace(F.trim(chrom), r"(?i)^chr", ""))
    return F.when(bare == "M", "MT").otherwise(bare)


def prefixed_contig(chrom: Column) -> Column:
    """Only contigs that carry a literal chr; others are null."""
    return F.when(chrom.startswith("chr"), chrom)


def strip_version(gene: Column) -> Column:
    return F.regexp_replace(gene, r"\.\d+$", "")


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), F.lit("_"))


def drop_accession(label: Column) -> Column:
    """A term's label without its accession, such as (GO:0001234) or R-HSA-123."""
    return F.trim(F.regexp_replace(label, r"\s*\(?\b(GO:\d+|R-[A-Z]{3}-\d+|WP\d+|hsa\d+)\)?", ""))


def subunits(name: Column) -> Column:
    """The upper-case members of A::B(variant)."""
    return F.filter(F.transform(F.split(F.regexp_replace(name, r"\(.*?\)", ""), "::"), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def family_stem(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), r"[-_]?\d+[A-Z]?$", "")


def contrast_arms(name: Column) -> Column:
    """struct<numerator,denominator> of X_vs_Y; null without both."""
    parts = F.split(name, "_vs_", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("numerator"), parts[1].alias("denominator")))


def finite(x: Column) -> Column:
    """A number that is neither null, NaN nor infinite; text is tried, other texts and flags are null."""
    d = x.try_cast("string").try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != math.inf), d)


def sample_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def sample_group(name: Column) -> Column:
    """The group a sample's name implies: without its trailing replicate number."""
    return F.regexp_replace(name, r"(?i)[ _.-]*(rep(licate)?|r|s)?[ _.-]*\d+$", "")


def within_one_mismatch(a: Column, b: Column) -> Column:
    """Equal length and at most one differing character."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.length(a) == F.length(b)) & (differ <= 1)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def umi_of(read: Column, separator: str = "_") -> Column:
    return F.when(F.locate(separator, read) > 0, F.substring_index(read, separator, -1))


def has_keyword(text: Column, keywords) -> Column:
    """Whether a keyword stands between characters that are neither letters nor digits."""
    return text.rlike("(?i)(^|[^a-z0-9])(" + "|".join(map(re.escape, keywords)) + ")($|[^a-z0-9])")


def unnegated(text: Column, phrases, negations=("not", "no", "never", "without", "cannot", "neither"), window: int = 3) -> Column:
    """The phrases that occur with no negation among the few words before, as an array."""
    before = rf"(?i)\b(?:{'|'.join(negations)})\b(?:\W+\w+){{0,{window}}}?\W+"
    hits = [F.when(F.regexp_replace(text, rf"{before}{re.escape(p)}\b", " ").rlike(rf"(?i)\b{re.escape(p)}\b"), F.lit(p)) for p in phrases]
    return F.array_compact(F.array(*hits))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def numbers(text: Column) -> Column:
    """The numbers of a text, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w])"), 1), lambda x: x.cast("double"))


def entities(text: Column) -> Column:
    """Tokens that look like names of genes or the like: upper-case letters, then letters, digits or hyphens, three at least."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9][A-Z0-9-]+)\b"), 1))


#: Words of field names that identify persons.
SENSITIVE = ("name", "patient", "mrn", "ssn", "dob", "birth", "address", "phone", "email", "zip", "postcode")
QUASI = ("age", "sex", "gender", "race", "ethnicity", "site", "hospital", "date")


def sensitivity(field: Column) -> Column:
    """identifying, quasi or none, by the words of a field's name."""
    words = F.filter(F.split(F.lower(F.regexp_replace(field, r"([a-z])([A-Z])", "$1_$2")), r"[^a-z]+"), lambda w: w != "")
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    return F.when(has(SENSITIVE), "identifying").when(has(QUASI), "quasi").otherwise("none")


def redact_text(text: Column) -> Column:
    """Home paths, e-mail addresses and key-like assignments masked."""
    out = F.regexp_replace(text, r"(/home|/Users|/root)(/[^\s:]*)?", "<path>")
    out = F.regexp_replace(out, r"[\w.+-]+@[\w-]+\.[\w.]+", "<email>")
    return F.regexp_replace(out, r"(?i)((?:api_?key|token|secret|password)\s*[=:]\s*)\S+", "$1<redacted>")


def redact_params(value, key: str = ""):
    """The same for nested driver-side values: what a sensitive key holds is masked whole."""
    if re.search(r"(?i)(api_?key|token|secret|password|credential)", key):
        return "<redacted>"
    if isinstance(value, dict):
        return {k: redact_params(v, str(k)) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact_params(v, key) for v in value]
    return re.sub(r"(/home|/Users|/root)(/[^\s:]*)?", "<path>", value) if isinstance(value, str) else value


def gtf_attribute(attributes: Column, name: str) -> Column:
    found = F.regexp_extract(attributes, rf'(?:^|;)\s*{name} "?([^";]+)"?', 1)
    return F.when(found != "", found)


def accessions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:GSE|GSM|SRR|SRP|PRJNA|ENCSR)\d+)\b"), 1))


def accession_folder(gse: Column) -> Column:
    """GSE12345 lies under GSE12nnn, a short number under GSEnnn."""
    return F.concat(F.regexp_extract(gse, r"^(GSE\d*?)\d{1,3}$", 1), F.lit("nnn"))


def since(at: Column, cutoff: str, grace_seconds: float = 0) -> Column:
    """Whether an ISO timestamp is at or after the cutoff, less the grace; one that cannot be read is not."""
    return F.coalesce(F.try_to_timestamp(at) >= F.lit(cutoff).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(grace_seconds))), F.lit(False))


# transforms of long counts: feature, sample, value


def clr(df: DataFrame, sample="sample", value="value", name="clr", pseudo: float = 0.5) -> DataFrame:
    """log of (x + .5) / sum, less its mean over the sample."""
    w = Window.partitionBy(sample)
    logs = F.log((F.col(value) + pseudo) / F.sum(F.col(value) + pseudo).over(w))
    return df.withColumn("__l", logs).withColumn(name, F.col("__l") - F.avg("__l").over(w)).drop("__l")


def cpm(df: DataFrame, sample="sample", value="value", name="cpm", digits: int | None = None) -> DataFrame:
    """Counts per million of the sample's sum; an empty library gives 0."""
    total = F.sum(value).over(Window.partitionBy(sample))
    x = F.when(total > 0, F.col(value) / (total / 1e6)).otherwise(0.0)
    return df.withColumn(name, x if digits is None else F.bround(x, digits))


def tpm(df: DataFrame, lengths: DataFrame, feature="feature", sample="sample", value="value", length="length", name="tpm") -> DataFrame:
    """Transcripts per million; features without a positive length are left out."""
    rows = df.join(lengths.where(F.col(length) > 0).select(feature, length), feature)
    rate = F.col(value) / (F.col(length) / 1e3)
    total = F.sum(rate).over(Window.partitionBy(sample))
    return rows.withColumn(name, F.when(total > 0, rate / (total / 1e6)).otherwise(0.0))


def log1p_cp10k(df: DataFrame, sample="sample", value="value", name="lognorm", scale: float = 1e4) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(sample))
    return df.withColumn(name, F.when(total > 0, F.log1p(scale * F.col(value) / total)).otherwise(0.0))


def tf_idf(df: DataFrame, cell="cell", feature="feature", value="value", name="tfidf", form: str = "log_idf") -> DataFrame:
    """log1p(1e4 tf log1p(n / total of the feature)), or with n / total itself (form ratio). n counts the cells with any row."""
    total = F.sum(value).over(Window.partitionBy(cell))
    peak = F.sum(value).over(Window.partitionBy(feature))
    n = df.agg(F.count_distinct(cell).alias("__cells"))
    rows = df.crossJoin(F.broadcast(n))
    idf = F.col("__cells") / peak
    return rows.withColumn(name, F.log1p(1e4 * F.col(value) / total * (F.log1p(idf) if form == "log_idf" else idf))).drop("__cells")


def undo_lognorm(value: Column, library: Column, scale: float = 1e4) -> Column:
    """The count that log1p normalisation came from, rounded; null where it is not finite."""
    x = F.expm1(value) * library / scale
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), F.rint(x).cast("long"))


def l2_unit(v: Column) -> Column:
    """A vector at length 1; one of length 0 stays."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinity as null in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != math.inf), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def json_safe_value(x):
    if isinstance(x, dict):
        return {k: json_safe_value(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe_value(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def unwrap(value):
    """What lies inside nested {"result": ...} or {"data": ...} wrappers."""
    while isinstance(value, dict) and len(value) == 1 and next(iter(value)) in ("result", "data", "findings", "value"):
        value = next(iter(value.values()))
    return value


def nested_rows(df: DataFrame, column: str, schema: str, *keep: str) -> DataFrame:
    """Rows of a JSON text column that holds an array of objects."""
    return df.select(*keep, F.explode(F.from_json(column, f"array<{schema}>")).alias("r")).select(*keep, "r.*")


def digest(*columns: str) -> Column:
    """SHA-256 of the columns' texts, null and empty told apart."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns)), 256)


def digest_params(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def neg_log10(p: Column, keys=()) -> Column:
    """-log10 p; p = 0 counts as a tenth of the smallest positive one, 1e-300 at least."""
    least = F.min(F.when(p > 0, p)).over(Window.partitionBy(*keys))
    return -F.log10(F.greatest(p, F.coalesce(least / 10, F.lit(1e-300)), F.lit(1e-300)))


def odds_ratio(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """With one half added to each cell, rounded to 2."""
    a, b, c = k + 0.5, drawn - k + 0.5, marked - k + 0.5
    return F.round(a * (population - marked - drawn + k + 0.5) / (b * c), 2)
