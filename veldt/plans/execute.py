"""Plans become one lazy DataFrame, after static checks against the schemas and probes of keys and cardinality.

The static pass walks all steps before any job runs. Probes are aggregations that stop at the first repeated key:
the base table's and each joined table's primary key, and the join's cardinality on the plan as far as written (a later
filter does not help an earlier join). Key probes are made once per table and key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.plans.model import CARDINALITIES, COMPARISONS, FILTERS, SCHEMA, SUMMARIES, Filter, GovernedTable, GroupSummary, Plan, PlanViolation, Project, Rank, ValidatedJoin, hash_file, hash_params


def predicate(column: Column, kind: T.DataType, op: str, value) -> Column:
    """A filter's condition: never null. A null is unequal to every value, and not in every list."""
    if op == "is_not_null":
        return column.isNotNull()
    if op in ("in", "not_in"):
        values = list(value or [])
        listed = [v for v in values if v is not None and v == v]
        found = F.coalesce(column.isin(listed), F.lit(False)) if listed else F.lit(False)
        if any(v is None for v in values) and isinstance(kind, T.StringType):
            found = found | column.isNull()
        return found if op == "in" else ~found
    if op == "==":
        return F.coalesce(column == F.lit(value), F.lit(False)) if value is not None else F.lit(False)
    if op == "!=":
        return ~F.coalesce(column == F.lit(value), F.lit(False)) if value is not None else F.lit(True)
    compared = {"<": column < F.lit(value), "<=": column <= F.lit(value), ">": column > F.lit(value), ">=": column >= F.lit(value)}[op]
    return F.coalesce(compared, F.lit(False))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def has_repeats(df: DataFrame, keys) -> bool:
    """Whether two rows agree on the keys (two nulls agree)."""
    return bool(df.groupBy(*map(_c, keys)).agg(F.count("*").alias("__n")).where("__n > 1").limit(1).count())


@dataclass
class Result:
    """A checked plan: the lazy result, and what its receipt says."""

    df: DataFrame
    plan: Plan
    unit: str
    key: list[str]
    ledger_nodes: list[str]
    digests: dict[str, str]
    base: DataFrame
    order: list[Column] = field(default_factory=list)

    def receipt(self, schema: str = SCHEMA, with_rows: bool = False) -> dict:
        """Counts cost a job each; rows are collected only where asked for."""
        out = {
            "schema_version": schema, "plan_sha256": self.plan.digest(schema), "source_tables_sha256": self.digests, "ledger_node_ids": self.ledger_nodes, "unit": self.unit,
            "input_denominator": self.base.count(), "output_row_count": self.df.count(), "columns": self.df.columns,
        }
        if with_rows:
            out["rows"] = [r.asDict() for r in self.df.collect()]
        return out


class Executor:
    def __init__(self, tables: dict[str, GovernedTable], prove: bool = True):
        self.tables, self.prove, self._proven = tables, prove, set()

    def table(self, name: str) -> GovernedTable:
        if name not in self.tables:
            raise PlanViolation(f"unknown table {name!r}")
        return self.tables[name]

    def _prove_key(self, t: GovernedTable) -> None:
        c = t.contract
        if missing := [k for k in c.primary_key if k not in t.df.columns]:
            raise PlanViolation(f"{c.table_id} lacks key columns {missing}")
        if self.prove and (c.table_id, c.primary_key) not in self._proven:
            if has_repeats(t.df, c.primary_key):
                raise PlanViolation(f"{c.table_id} repeats its key {c.primary_key}")
            self._proven.add((c.table_id, c.primary_key))

    def _digest(self, t: GovernedTable) -> str:
        c = t.contract
        if c.source_sha256 or c.source_path:
            return c.source_sha256 or hash_file(c.source_path)
        return hash_params({"cols": t.df.columns, "unit": c.unit, "table": c.table_id})

    def check(self, plan: Plan) -> None:
        """All that schemas can tell, without a job."""
        base = self.table(plan.base_table_id)
        columns, unit, joined = list(base.df.columns), base.contract.unit, []

        def need(names, what: str) -> None:
            if not names or (missing := [n for n in names if n not in columns]):
                raise PlanViolation(f"{what}: no columns {missing if names else names} in {columns}")

        for s in plan.steps:
            match s:
                case Filter():
                    need([s.column], "filter")
                    if s.op not in FILTERS:
                        raise PlanViolation(f"no such filter: {s.op!r}")
                case Project():
                    need(s.columns, "project")
                    if len(set(s.columns)) < len(s.columns):
                        raise PlanViolation("project names a column twice")
                    columns = list(s.columns)
                case Rank():
                    need(s.by, "rank")
                    if len(s.by) != len(s.ascending):
                        raise PlanViolation("rank needs a direction for each column")
                    if s.limit is not None and s.limit < 0:
                        raise PlanViolation("rank's limit is negative")
                case GroupSummary():
                    need(s.by, "group_summary")
                    need(list(s.aggregations), "group_summary")
                    if both := set(s.by) & set(s.aggregations):
                        raise PlanViolation(f"both grouped by and summarised: {sorted(both)}")
                    if odd := set(s.aggregations.values()) - set(SUMMARIES):
                        raise PlanViolation(f"no such summary: {sorted(odd)}")
                    columns, unit = [*s.by, *s.aggregations], f"grouped:{','.join(s.by)}"
                case ValidatedJoin():
                    right = self.table(s.right_table_id)
                    need(s.on, "validated_join")
                    if missing := [k for k in s.on if k not in right.df.columns]:
                        raise PlanViolation(f"{s.right_table_id} lacks join keys {missing}")
                    if s.how not in ("inner", "left"):
                        raise PlanViolation(f"no such join: {s.how!r}")
                    if s.expected_cardinality not in CARDINALITIES:
                        raise PlanViolation(f"a join may not be {s.expected_cardinality!r}")
                    if right.contract.unit != unit:
                        if not s.allow_unit_projection:
                            raise PlanViolation(f"units differ: {unit!r} and {right.contract.unit!r}")
                        unit = f"{unit}_x_{right.contract.unit}"
                    new = [c if c not in columns else f"{c}__{s.right_table_id}" for c in right.df.columns if c not in s.on]
                    if twice := [c for i, c in enumerate(new) if c in columns or c in new[:i]]:
                        raise PlanViolation(f"the join would repeat columns {twice}")
                    columns += new
                    joined.append(s.right_table_id)
                case _:
                    raise PlanViolation(f"no such step: {s!r}")

    def run(self, plan: Plan) -> Result:
        self.check(plan)
        base = self.table(plan.base_table_id)
        self._prove_key(base)
        out = Result(base.df, plan, base.contract.unit, list(base.contract.primary_key), [base.contract.ledger_node], {base.contract.table_id: self._digest(base)}, base.df)
        for s in plan.steps:
            match s:
                case Filter():
                    value = s.value
                    if s.op in COMPARISONS and isinstance(value, bool) and not isinstance(out.df.schema[s.column].dataType, T.BooleanType):
                        raise PlanViolation("a flag is not a number")
                    out.df = out.df.where(predicate(_c(s.column), out.df.schema[s.column].dataType, s.op, value))
                case Project():
                    out.df = out.df.select(*map(_c, s.columns))
                    out.key = [k for k in out.key if k in s.columns]
                case Rank():
                    ties = [k for k in out.key if k not in s.by]
                    order = [_c(c).asc_nulls_last() if up else _c(c).desc_nulls_last() for c, up in zip((*s.by, *ties), (*s.ascending, *[True] * len(ties)), strict=True)]
                    out.df = out.df.orderBy(*order)
                    out.df = out.df if s.limit is None else out.df.limit(s.limit)
                case GroupSummary():
                    out.df = out.df.groupBy(*map(_c, s.by)).agg(*(summary(c, f).alias(c) for c, f in s.aggregations.items())).orderBy(*(_c(c).asc_nulls_last() for c in s.by))
                    out.unit, out.key = f"grouped:{','.join(s.by)}", list(s.by)
                case ValidatedJoin():
                    self._join(out, s)
        return out

    def _join(self, out: Result, s: ValidatedJoin) -> None:
        right = self.table(s.right_table_id)
        c = right.contract
        self._prove_key(right)
        if self.prove:
            unique_right = set(c.primary_key) <= set(s.on) or not has_repeats(right.df, s.on)
            if s.expected_cardinality in ("1:1", "m:1") and not unique_right:
                raise PlanViolation(f"not {s.expected_cardinality}: {c.table_id} repeats {s.on}")
            if s.expected_cardinality in ("1:1", "1:m") and has_repeats(out.df, s.on):
                raise PlanViolation(f"not {s.expected_cardinality}: the left side repeats {s.on}")
        right_names = {k: f"__right_{k}" for k in s.on}
        renamed = right.df.select(*(_c(n).alias(right_names.get(n) or (n if n not in out.df.columns else f"{n}__{c.table_id}")) for n in right.df.columns))
        condition = F.lit(True)
        for k in s.on:  # a null key meets a null key
            condition = condition & out.df[k].eqNullSafe(renamed[right_names[k]])
        out.df = out.df.join(renamed, condition, s.how).drop(*right_names.values())
        if c.unit != out.unit:
            out.unit = f"{out.unit}_x_{c.unit}"
        if s.expected_cardinality == "1:m":  # the left key alone no longer orders the rows
            out.key += [k if k in s.on or f"{k}__{c.table_id}" not in out.df.columns else f"{k}__{c.table_id}" for k in c.primary_key if k not in out.key]
        if c.ledger_node not in out.ledger_nodes:
            out.ledger_nodes.append(c.ledger_node)
        out.digests[c.table_id] = self._digest(right)


def summary(column: str, name: str) -> Column:
    """A group's summary, nulls left out; the sum of nothing is 0."""
    c = _c(column)
    return {"count": lambda: F.count(c), "sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "mean": lambda: F.avg(c), "median": lambda: F.median(c), "min": lambda: F.min(c), "max": lambda: F.max(c)}[name]()


def execute(plan: Plan, tables: dict[str, GovernedTable], prove: bool = True) -> Result:
    return Executor(tables, prove).run(plan)
