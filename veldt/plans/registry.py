"""The registry of governed tables: key inference, plans by table id, derived tables and the bounded query verb."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions.order import range_number
from veldt.plans.execute import Executor, Result, _c
from veldt.plans.model import GovernedTable, PlanViolation, TableContract, ValidatedJoin, coerce_literals, nan_to_null, parse_plan

ROW_ID = "__row_id"


class Registry:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def unique_id(self, name: str) -> str:
        new, n = name, 2
        while new in self.tables:
            new, n = f"{name}_{n}", n + 1
        return new

    def register(self, table_id: str, df: DataFrame, unit: str, candidates=(), **more) -> GovernedTable:
        """The key is the first candidate column without nulls or repeats, or else a row number in a reproducible order."""
        df = nan_to_null(df)
        here = [c for c in candidates if c in df.columns]
        key = None
        if here:
            stats = df.agg(F.count("*").alias("__n"), *(F.count(_c(c)).alias(f"n{i}") for i, c in enumerate(here)), *(F.count_distinct(_c(c)).alias(f"d{i}") for i, c in enumerate(here))).first()
            key = next((c for i, c in enumerate(here) if stats[f"n{i}"] == stats["__n"] == stats[f"d{i}"]), None)
        if key is None:
            df, key = with_row_id(df), ROW_ID
        table = GovernedTable(TableContract(table_id, unit, (key,), more.pop("ledger_node", f"ledger://{table_id}"), **more), df)
        self.tables[table_id] = table
        return table

    def run(self, plan: dict) -> Result:
        """A JSON plan over the tables it names only."""
        parsed = parse_plan(plan)
        needed = {parsed.base_table_id, *(s.right_table_id for s in parsed.steps if isinstance(s, ValidatedJoin))}
        if missing := needed - self.tables.keys():
            raise PlanViolation(f"unknown tables {sorted(missing)}")
        parsed = coerce_literals(parsed, self.tables[parsed.base_table_id].df.schema)
        return Executor({k: self.tables[k] for k in needed}).run(parsed)

    def query(self, plan: dict, max_rows: int | None = None, register_as: str | None = None) -> dict:
        """The query verb: a receipt with 1 to 50 rows; the whole result may be registered as a table."""
        shown = max(1, min(int(max_rows or 25), 50))
        result = self.run(plan)
        out = result.receipt()
        rows = result.df.limit(shown + 1).collect()
        out["rows_shown"], out["rows_truncated"] = [r.asDict() for r in rows[:shown]], len(rows) > shown
        if register_as:
            new = self.unique_id(f"derived_{register_as}")
            self.register(new, result.df, result.unit, result.df.columns[:3])
            self.tables[new].df.createOrReplaceTempView(new)
            out["registered_table_id"] = new
        return out


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """0 to n - 1 in the order of the rows' hashes, then of all columns: the same however the table is partitioned. Ranked by ranges of the hash, not in one task."""
    order = [F.col("__hash"), *(_c(c).asc_nulls_first() for c in df.columns)]
    hashed = df.withColumn("__hash", F.xxhash64(*map(_c, df.columns)))
    ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 256)
    dealt = hashed.withColumn("__part", range_number(hashed, "__hash", ranges))
    dealt = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    first, total = {}, 0
    for part, n in sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        first[part], total = total, total + n
    if not first:
        return df.withColumn(name, F.lit(0).cast("long"))
    base = F.element_at(F.create_map(*(x for k, v in first.items() for x in (F.lit(k), F.lit(v).cast("long")))), F.col("__part"))
    return dealt.select(*map(_c, df.columns), (base + F.col("__n")).alias(name))
