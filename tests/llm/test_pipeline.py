import corpus_pipeline as p
from veldt.llm import decontaminate, secrets
from veldt.llm.common import cut, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    made = []
    for name, stage in p.STAGES:
        new = cut(stage(spark, docs, sf), name)
        if name != "mixing":
            assert new.columns == docs.columns
        before, after = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in new.select("doc_id").collect()}
        assert after <= before and new.count() == len(after)
        made.append(new)
        docs = new
    assert decontaminate.scan(made[2], table(spark, sf, "benchmark"), ["doc_id"]).where("n_hit > 0").count() == 0
    left = secrets.scan_table(made[3], ["doc_id"]).selectExpr("explode(spans) as s").where("s.kind in ('assign', 'access', 'hex', 'markov')").count()
    assert left == 0 and made[3].count() == made[2].count()


def test_hard_rows_pass_every_stage(spark, docs, tmp_path):
    folder = str(tmp_path)
    clash = [f"'x' as `{c}`" for c in ("rejected", "p_toxic", "p_low_quality", "hits", "n_hit", "items", "spans", "n_tokens", "place", "key", "node", "size", "taken", "s", "block")]
    docs = docs.selectExpr("*", "'en' as lang", "length(text) as n_chars", *clash)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "word " * 20)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    # the null, empty and blank texts are one class, 5 and 6 are copies, and two labels are too few to reject by
    assert {r["doc_id"] for r in p.run(spark, folder).collect()} == {1, 4, 5, 7, 8, None}
    for name in ("documents", "benchmark", "labels"):
        table(spark, folder, name).limit(0).write.parquet(f"{folder}/none/{name}.parquet")
    assert p.run(spark, f"{folder}/none").count() == 0


def test_small_work_tables_have_few_files(spark):
    parts, most = 40 * spark.sparkContext.defaultParallelism, 4 * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", most)
    try:
        out = cut(spark.range(0, 10_000, 1, parts), "few")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 1 < len(out.inputFiles()) <= most
    assert sorted(r.id for r in out.collect()) == list(range(10_000))


def test_work_tables_go_with_their_stage(spark, sf, tmp_path):
    import os

    from veldt.llm.common import work_dir

    folder = work_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = p.run(spark, sf)
    assert [f.rpartition("-")[0] for f in set(os.listdir(folder)) - before] == ["mixing"] or out.count() == 0
