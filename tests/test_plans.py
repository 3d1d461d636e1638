import pytest

from veldt.plans.execute import Executor, execute
from veldt.plans.model import Filter, GovernedTable, GroupSummary, Plan, PlanViolation, Project, Rank, TableContract, ValidatedJoin, coerce_literals, hash_params, parse_plan, parse_step
from veldt.plans.registry import ROW_ID, Registry, with_row_id


@pytest.fixture(scope="module")
def tables(spark):
    base = spark.createDataFrame([("g1", "p1", 2.0, 0.01), ("g2", "p1", None, 0.2), ("g3", None, float("nan"), 0.03), (None, "p2", 1.0, None)], "gene string, pathway string, lfc double, padj double")
    ann = spark.createDataFrame([("g1", "x"), ("g2", "y"), (None, "z")], "gene string, lfc string")
    cells = spark.createDataFrame([("c1", "g1"), ("c2", "g1")], "cell string, gene string")
    return {"de": GovernedTable.of(base, "de", "gene", "gene"), "ann": GovernedTable.of(ann, "ann", "gene", "gene"), "cells": GovernedTable.of(cells, "cells", "cell", "cell")}


def run(tables, *steps):
    return [tuple(r) for r in execute(Plan("de", steps), tables).df.collect()]


@pytest.mark.parametrize("op, value, genes", [
    ("==", 2.0, {"g1"}), ("!=", 2.0, {"g2", "g3", None}), ("<", 2.0, {None}), (">=", 1.0, {"g1", None}), ("in", [1.0], {None}), ("in", [], set()),
    ("not_in", [1.0], {"g1", "g2", "g3"}), ("not_in", [], {"g1", "g2", "g3", None}), ("is_not_null", None, {"g1", None}),
])
def test_filters_and_missing_values(tables, op, value, genes):
    assert {r[0] for r in run(tables, Filter("lfc", op, value))} == genes


def test_join_null_keys_suffix_and_unit(tables):
    out = execute(Plan("de", (ValidatedJoin("ann", ("gene",), "inner", "1:1"),)), tables)
    assert out.df.columns == ["gene", "pathway", "lfc", "padj", "lfc__ann"]
    assert {(r["gene"], r["lfc__ann"]) for r in out.df.collect()} == {("g1", "x"), ("g2", "y"), (None, "z")}
    crossed = execute(Plan("de", (ValidatedJoin("cells", ("gene",), "left", "1:m", True),)), tables)
    assert crossed.unit == "gene_x_cell" and crossed.df.count() == 5 and crossed.key == ["gene", "cell"]
    assert crossed.ledger_nodes == ["ledger://de", "ledger://cells"]


@pytest.mark.parametrize("steps", [
    (Filter("nope", "==", 1),), (Filter("lfc", "like", 1),), (Project(()),), (Project(("nope",)),), (Rank(("lfc",), ()),), (Rank(("lfc",), (True,), -1),), (GroupSummary((), {"lfc": "sum"}),),
    (GroupSummary(("pathway",), {"lfc": "mode"}),), (GroupSummary(("pathway",), {"pathway": "count"}),), (ValidatedJoin("nope", ("gene",)),), (ValidatedJoin("ann", ("nope",)),), (ValidatedJoin("ann", ("gene",), "inner", "m:m"),),
    (ValidatedJoin("cells", ("gene",), "left", "1:m"),), (ValidatedJoin("cells", ("gene",), "left", "1:1", True),), (ValidatedJoin("cells", ("gene",), "left", "m:1", True),), (ValidatedJoin("ann", ("gene",), "right"),),
    (ValidatedJoin("ann", ("gene",)), ValidatedJoin("ann", ("gene",))), (GroupSummary(("pathway",), {"lfc": "sum"}), ValidatedJoin("ann", ("pathway",))),
])
def test_violations(tables, steps):
    with pytest.raises(PlanViolation):
        execute(Plan("de", steps), tables)


def test_cardinality_is_proven_on_the_plan_as_written(tables, spark):
    twice = GovernedTable.of(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, gene string"), "many", "gene", "id")
    ts = tables | {"many": twice, "one": GovernedTable.of(spark.createDataFrame([("a", 1), ("b", 2)], "gene string, w int"), "one", "gene", "gene")}
    join = ValidatedJoin("one", ("gene",), "inner", "1:1")
    with pytest.raises(PlanViolation):
        execute(Plan("many", (join, Filter("id", ">", 1))), ts)
    assert execute(Plan("many", (Filter("id", ">", 1), join)), ts).df.count() == 2


def test_repeated_key_is_refused(spark):
    df = spark.createDataFrame([(None,), (None,)], "k string")
    with pytest.raises(PlanViolation):
        execute(Plan("t"), {"t": GovernedTable.of(df, "t", "u", "k")})


def test_groups_and_rank(tables):
    out = execute(Plan("de", (GroupSummary(("pathway",), {"lfc": "sum", "padj": "count"}),)), tables)
    assert [tuple(r) for r in out.df.collect()] == [("p1", 2.0, 2), ("p2", 1.0, 0), (None, 0.0, 1)]
    assert out.unit == "grouped:pathway" and out.key == ["pathway"]
    for up in (True, False):
        assert run(tables, Rank(("lfc",), (up,)))[-1][0] in ("g2", "g3")
    assert run(tables, Rank(("lfc",), (False,), 0)) == []
    assert [r[0] for r in run(tables, Rank(("lfc",), (True,)), Project(("gene",)))] == [None, "g1", "g2", "g3"]


def test_receipt_and_digest(tables):
    plan = Plan("de", (Filter("padj", "<", 0.1), Rank(("padj",), (True,), 5)))
    got = execute(plan, tables).receipt(with_rows=True)
    assert got["input_denominator"] == 4 and got["output_row_count"] == 2 and len(got["rows"]) == 2
    same = parse_plan({"steps": [{"type": "filter", "column": "padj", "operator": "<", "value": 0.1}, {"op": "rank", "by": "padj", "limit": 5}], "base_table_id": "de"})
    assert same == plan and same.digest() == plan.digest() == got["plan_sha256"]
    assert Plan("de").digest() != plan.digest()
    assert hash_params({"b": 1, "a": [2]}) == hash_params({"a": [2], "b": 1})


def test_json_steps(tables):
    assert parse_step({"step": "rank", "by": ["a", "b"], "ascending": False}) == Rank(("a", "b"), (False, False))
    assert parse_step({"op": "group_summary", "by": "a", "aggregations": {"x": "sum"}}) == GroupSummary(("a",), {"x": "sum"})
    for bad in ({}, {"step": "sort"}, {"step": "filter", "op": "=="}):
        with pytest.raises(PlanViolation):
            parse_step(bad)
    plan = coerce_literals(Plan("de", (Filter("lfc", ">", "1.5"), Filter("gene", "==", "7"), Filter("lfc", "==", "x"))), tables["de"].df.schema)
    assert [s.value for s in plan.steps] == [1.5, "7", "x"]


def test_contract():
    for bad in (("", "u", ("k",), "ledger://x"), ("t", "", ("k",), "ledger://x"), ("t", "u", (), "ledger://x"), ("t", "u", ("k",), "http://x")):
        with pytest.raises(PlanViolation):
            TableContract(*bad)


def test_registry(spark):
    reg = Registry(spark)
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 6.0), (2, "c", None)], "x int, y string, z double")
    assert reg.register("t", df, "row", ["x", "z", "y"]).contract.primary_key == ("y",)
    assert reg.register("u", df, "row", ["x"]).contract.primary_key == (ROW_ID,)
    got = reg.query({"base_table_id": "t", "steps": [{"step": "filter", "column": "z", "op": ">", "value": "5.5"}]}, 1, "big")
    assert got["rows_shown"] == [{"x": 1, "y": "b", "z": 6.0}] and not got["rows_truncated"] and got["registered_table_id"] == "derived_big"
    assert reg.query({"base_table_id": "t", "steps": []}, 0)["rows_truncated"] is False
    with pytest.raises(PlanViolation):
        reg.run({"base_table_id": "none"})
    ids = sorted(r[ROW_ID] for r in with_row_id(df.repartition(3)).collect())
    assert ids == [0, 1, 2]
    assert sorted([tuple(r) for r in with_row_id(df.repartition(2)).collect()], key=repr) == sorted([tuple(r) for r in with_row_id(df).collect()], key=repr)


def test_probes_are_shared(tables, monkeypatch):
    from veldt.plans import execute as module

    calls = []
    real = module.has_repeats
    monkeypatch.setattr(module, "has_repeats", lambda df, keys: calls.append(tuple(keys)) or real(df, keys))
    ex = Executor(tables)
    ex.run(Plan("de"))
    ex.run(Plan("de"))
    assert calls == [("gene",)]
