"""What the operators share: reading tables, the shared work folder and cutting lineage."""

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that were made where none was named, by application.
_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local master gets a temporary folder; a cluster is refused, since a
    folder of one machine would lose rows there.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="veldt-")
        _own[spark.sparkContext.applicationId] = base
    return base


#: Removes the shuffle files of a query as it ends; a written table needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A table that cut() writes has so many files a core, or an eighth of the shuffle partitions, at most. On a local file system Hadoop starts three
#: processes (chmod) for each file, and until such a process runs chmod it is seen with all of its executor's memory.
FILES = 4
#: Folders that cut() wrote and nobody removed yet, in the order of writing.
_written: list[str] = []


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and it is computed once.

    The shuffle files that made it go at once, the table itself by discard(), within scratch(), or when the application ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    files = max(FILES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    try:
        # partitions of one file are worked on one after the other
        df.coalesce(files).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    place, store = _hadoop(spark, path)
    store.deleteOnExit(place)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that cut() wrote, once nothing will read it again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)
        name = folder.rpartition("/")[2]
        _written[:] = [p for p in _written if p.rpartition("/")[2] != name]


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove what cut() writes within. What is returned from inside must have been written elsewhere, or be kept by keep()."""
    known = len(_written)
    kept: list[DataFrame] = []
    yield kept.append
    names = {f.rpartition("/")[0].rpartition("/")[2] for df in kept for f in df.inputFiles()}
    for path in _written[known:]:
        if path.rpartition("/")[2] not in names:
            _remove(spark, path)
            _written.remove(path)


#: Bytes of an Arrow batch between Spark and Python: texts vary in length, rows alone would not bound a batch.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that the session's Python stages get, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def hide(df: DataFrame, text: str = "text") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with every column but the text under a private name, and a function that selects the columns under their own names
    again: whatever an operator adds in between clashes with none of them."""
    names = [c if c == text else f"__c{i}" for i, c in enumerate(df.columns)]
    hidden = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)))
    return hidden, lambda out: out.select(*(F.col(n).alias(c) for c, n in zip(df.columns, names, strict=True)))


#: Places among which salted() deals the rows of a key.
SALTS = 16


def salted(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key), where a few keys may hold most rows: a key's rows are dealt among SALTS places by the hash of
    the columns of spread, and its group is repeated in each."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    repeated = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")


def place_of(doc_id, text):
    """16 bytes that only rows with equal id and text share; a null id is like another null id only."""
    return F.unhex(F.md5(F.concat(F.md5(text), F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-")))))


def same_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; one that is missing is null. Other columns cannot clash with what an operator adds."""
    have = set(df.columns)
    return df.select(*(F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names))


def lower_ascii(col):
    """A-Z in lower case, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
