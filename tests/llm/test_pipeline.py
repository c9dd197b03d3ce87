import corpus_pipeline as cp
from lexisift.llm.quality_knn import fit_neighbours, held_out, score_quality
from lexisift.llm.quality_rules import judge_quality

from .test_near import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in score_quality(docs, fit_neighbours(docs, labels, ~held_out())).collect() if r.predicted}
    one = cp.quality_classifier(spark, docs, SF)
    assert {r.doc_id: r for r in one.collect()} == {i: given[i] for i in good} and one.columns == docs.columns
    one = docs.where(docs.doc_id.isin(*good))
    kept = {r.doc_id for r in judge_quality(one, labels).collect() if r.kept}
    two = cp.quality_rules(spark, one, SF)
    assert {r.doc_id: r for r in two.collect()} == {i: given[i] for i in kept}
    two = docs.where(docs.doc_id.isin(*kept))
    classes = brute({i: given[i].text for i in kept})
    three = cp.near_dedup(spark, two, SF)
    assert {r.doc_id: r for r in three.collect()} == {i: given[i] for i in set(classes.values())} and three.columns == docs.columns
    packed = {r.doc_id for r in cp.packing(spark, docs.where(docs.doc_id.isin(*set(classes.values()))), SF).collect()}
    assert packed == set(classes.values()) == {r.doc_id for r in cp.run(spark, SF).collect()}


def test_odd_rows_pass_every_stage(spark):
    good = " ".join(f"word{i % 97}x{i}" for i in range(120))
    long = " ".join(f"long{i % 5003}y{i}" for i in range(60_000))
    rows = [(1, good, "row"), (1, good, "row"), (None, good + " y", "b"), (None, None, None), (2, None, "c"), (3, "", "d"), (4, "### $$$ " * 80, "e"), (5, long, "f"), (6, long + " end", "g"), (7, "x" * 200_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for name, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "row"], name
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == [(0, good + " y"), (1, good), (5, long)]
    packed = cp.packing(spark, docs, SF).where("doc_id = 5").collect()
    assert sum(r.length for r in packed) == packed[0].doc_tokens > 60_000
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_a_text_goes_to_a_task_once(spark, monkeypatch):
    from lexisift.llm import common
    from lexisift.llm.quality_rules import text_statistics

    given, shipped = [], common.shipped
    monkeypatch.setattr(common, "shipped", lambda frame: (given.append(frame.columns), shipped(frame))[1])
    rows = [(1, "One two", "a"), (None, None, "b"), (3, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, `a.b` string")
    got = text_statistics(docs, keep=True).select("doc_id", "n_words", "row.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len((t or "").split()), i, t, x) for i, t, x in rows), key=str) and given == [["row"]]
    other = text_statistics(docs.withColumn("doc_id", docs.doc_id.cast("int")), keep=True).select("doc_id", "n_words", "row.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, other), key=str) and given[1] == ["doc_id", "text", "row"]
