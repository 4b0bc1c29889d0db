"""Readers, writers, feeds, streaming and the frame."""

import json

import pytest
from pyspark.sql import functions as F

from scoreweave import schema
from scoreweave.frame import ScoreFrame
from scoreweave.operators import cells as C
from scoreweave.operators.rank import CompositeMetric
from scoreweave.sources import documents as S
from scoreweave.sources import feeds, sinks
from scoreweave.streaming import running


def model(name, *entries, company="Z.ai Labs"):
    return {"name": name, "company": company, "url": "u", "release_date": "2024-07-01", "capabilities": {"input": ["text"], "output": ["text"]}, "benchmarks": [{"name": m, "score": s, "source": "s"} for m, s in entries]}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"models": [model("m2", ("B1", 4), ("B3", 5))]}))
    (tmp_path / "a.json").write_text(json.dumps({"models": [model("m1", ("B1", 1), ("B2", 2.5)), model("m1", ("B1", 3), company="")]}))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "notes.txt").write_text("not a document")
    return tmp_path


def test_read_models(spark, folder):
    entities, obs = S.read_models(spark, str(folder))
    assert [r.entity for r in entities.orderBy("ord").collect()] == ["m1", "m1", "m2"]
    assert [(r.entity, r.metric, r.score) for r in obs.orderBy("ord").collect()] == [("m1", "B1", 1.0), ("m1", "B2", 2.5), ("m1", "B1", 3.0), ("m2", "B1", 4.0), ("m2", "B3", 5.0)]
    assert {r.metric: r.n for r in C.metric_counts(obs).collect()} == {"B1": 3, "B2": 1, "B3": 1}


def test_corrupt_files(spark, folder):
    (folder / "d.json").write_text('{"models": [')
    with pytest.raises(Exception, match="(?i)read_file|malformed|An error occurred"):
        S.read_models(spark, str(folder))[1].collect()
    assert S.read_models(spark, str(folder), strict=False)[1].count() == 5


def test_frame(spark, folder, tmp_path):
    frame = ScoreFrame.read(spark, str(folder)).merge().impute("mean")
    cells = {(r.entity, r.metric): r for r in frame.cells.collect()}
    assert cells[("m1", "B1")].score == 2.0 and cells[("m1", "B1")].source == "Multiple: Score 1 at s; Score 3 at s"
    assert cells[("m2", "B2")].score == 2.5 and cells[("m2", "B2")].source == "Mean prediction"
    ranked = frame.rank(CompositeMetric("c", {"B1": 1.0}).frame(spark)).collect()
    assert [r.entity for r in sorted(ranked, key=lambda r: r.rank)] == ["m2", "m1"]
    out = frame.document()
    sinks.write_by_company(out, str(tmp_path / "out"))
    assert (tmp_path / "out" / "company_slug=zailabs").exists()
    sinks.write_document(out, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).count() == out.count()


def test_derived_observations_come_after_those_read(spark, tmp_path):
    from scoreweave.operators import derive, upsert

    (tmp_path / "a.json").write_text(json.dumps({"models": [model("m", ("B", 75), (derive.SIZE, 10), (derive.SIZE, 20))]}))
    rules = spark.createDataFrame([("B", 25.0, (["image"], []))], "metric string, random_score double, capabilities struct<input: array<string>, output: array<string>>")
    frame = ScoreFrame.read(spark, str(tmp_path))
    told = {r.metric: r for r in frame.derive(rules).merge().cells.collect()}
    assert told["B"].source == "Multiple: Score 75 at s; Score 25 at Missing capability: input:image"
    assert told[derive.RELEASE_SIZE].score == pytest.approx(2024.4972677595628 * 2.302585092994046)  # the first size
    alone = {r.metric: r for r in frame.derive(rules, floor_replaces=True).merge().cells.collect()}
    assert (alone["B"].score, alone["B"].source) == (25.0, "Missing capability: input:image")
    # What a feed adds stands between what was read and what is derived.
    new = spark.createDataFrame([("m", "B", 5.0, "feed", 0)], "entity string, metric string, score double, source string, ord long")
    fed = upsert.upsert_by_source(frame.observations, new).drop("action")
    told = {r.metric: r for r in ScoreFrame(fed, frame.entities).derive(rules).merge().cells.collect()}
    assert told["B"].source == "Multiple: Score 75 at s; Score 5 at feed; Score 25 at Missing capability: input:image"


def test_orders_that_don_t_fit_stop_the_read(spark, folder, monkeypatch):
    monkeypatch.setattr(schema, "ENTRY_BITS", 0)
    with pytest.raises(Exception, match="more than 2"):
        S.read_models(spark, str(folder))[1].collect()


def test_filters_leave_statistics(spark):
    obs = spark.createDataFrame([("a", "x", 1.0, None, "s", 0), ("b", "x", 2.0, None, "s", 1), ("c", "x", 9.0, None, "s", 2)], schema.OBSERVATIONS)
    entities = spark.createDataFrame([(e, "c", "u", "2024-01-01", None, i) for i, e in enumerate("abc")], schema.ENTITIES)
    criteria = CompositeMetric("t", {"x": 1.0}).frame(spark)
    frame = ScoreFrame(obs, entities).merge()
    every = {r.entity: r.composite for r in frame.composite(criteria).collect()}
    some = frame.filter("x", 5.0)
    assert {r.entity: r.composite for r in some.composite(criteria).collect()} == {e: every[e] for e in "ab"}
    assert every["a"] == pytest.approx(-0.8429272, abs=1e-6) and every["b"] == pytest.approx(-0.5619515, abs=1e-6)
    assert [r.entity for r in some.rank(criteria).orderBy("rank").collect()] == ["b", "a"]
    assert [r.entity for r in some.filter("x", 1.5, below=False).rank(criteria).collect()] == ["b"]


def test_lists(spark, tmp_path):
    (tmp_path / "names.txt").write_text("MMLU\n\n  GPQA \n \n")
    assert [(r.name) for r in S.read_names(spark, str(tmp_path / "names.txt")).orderBy("ord").collect()] == ["MMLU", "  GPQA "]
    (tmp_path / "new.json").write_text(json.dumps({"benchmarks": [{"name": "X"}, {"name": "Y"}]}))
    assert [r.name for r in S.read_candidate_names(spark, str(tmp_path / "new.json")).orderBy("ord").collect()] == ["X", "Y"]
    (tmp_path / "req.json").write_text(json.dumps({"benchmarks": [{"name": "X", "url": "u", "capabilities": {"input": ["image"], "output": []}, "random_score": 25}]}))
    assert S.read_requirements(spark, str(tmp_path / "req.json")).first().random_score == 25.0


def test_feed_a(spark, tmp_path):
    data = [{"name": "M", "evaluations": {"gpqa": 0.12345, "mmlu_pro": 0, "artificial_analysis_math_index": 40.125, "unheard": 1}, "pricing": {"price_1m_input_tokens": 2}, "median_output_tokens_per_second": 80.5}, {"name": "N", "evaluations": None, "pricing": {}}]
    (tmp_path / "a.json").write_text(json.dumps({"status": 200, "data": data}))
    got = {(r.name, r.metric): r.score for r in feeds.flatten_feed_a(S.read_feed_a(spark, str(tmp_path / "a.json"))).collect()}
    assert got == {("M", "GPQA Diamond"): 12.35, ("M", "ArtificialAnalysis Math Index"): 40.13, ("M", "Output speed"): 80.5}


def test_feed_b(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"text": {"m": {"rating": 1200.5, "modelOrganization": "O"}}, "webDev": {"m": {"rating": 3}}}))
    got = {(r.metric, r.score) for r in feeds.flatten_feed_b(S.read_feed_b(spark, str(tmp_path / "b.json"))).collect()}
    assert got == {("LMArena Text", 1201.0), ("LMArena WebDev", 3.0)}
    page = '... "arena": {"id": 1, "slug": "vision"} ... "leaderboard": {"x": 2, "entries": [{"modelDisplayName": "m", "rating": 10.5, "license": "l",}, {"rating": 4}, {"modelDisplayName": "n"},] }'
    got = S.parse_feed_b_page(spark.createDataFrame([(page,)], "value string")).collect()
    assert [(r.arena, r.name, r.rating, r.license) for r in got] == [("vision", "m", 11.0, "l")]
    none = S.parse_feed_b_page(spark.createDataFrame([('"leaderboard": {"entries": [{"modelDisplayName": "m", "rating": 1}]}',)], "value string")).collect()
    assert [r.arena for r in none] == ["text"]
    # Brackets in texts and lists in entries don't end the list; fields that a page may carry come along; a saved page stands in.
    deep = '"leaderboard": {"data": {"entries": [{"modelDisplayName": "a ] \\" }", "rating": 1, "tags": [1, [2]], "modelId": "7"}, {"modelDisplayName": "b", "rating": 2}]}}'
    page = spark.createDataFrame([(deep,)], "value string")
    assert [(r.name, r.rating, r.modelId) for r in S.parse_feed_b_page(page).collect()] == [('a ] " }', 1.0, "7"), ("b", 2.0, None)]
    for empty in ("nothing", '"leaderboard": {"entries": []}', '"leaderboard": {"entries": [{"modelDisplayName": "x", "rating": 1}', None):
        told = spark.createDataFrame([(empty,)], "value string")
        assert S.parse_feed_b_page(told).count() == 0
        assert [r.name for r in S.parse_feed_b_page(told, saved=page).collect()] == ['a ] " }', "b"]
    assert [r.rating for r in S.parse_feed_b_page(page, saved=spark.createDataFrame([('"leaderboard": {"entries": [{"modelDisplayName": "m", "rating": 9}]}',)], "value string")).collect()] == [1.0, 2.0]


def test_composites(spark, tmp_path):
    stored = [{"name": "mine", "criteria": [{"bench": "x", "weight": 2}]}, {"name": "broken", "criteria": [{"bench": "x"}]}, {"criteria": []}]
    (tmp_path / "c.json").write_text(json.dumps(stored))
    rows = S.read_composites(spark, str(tmp_path / "c.json"))
    assert [(r.metric_name, r.bench, r.weight) for r in rows.collect()] == [("mine", "x", 2.0)]
    (tmp_path / "bad.json").write_text("{]")
    assert S.read_composites(spark, str(tmp_path / "bad.json")).count() == 0
    sinks.write_composites(rows.drop("ord").unionByName(spark.createDataFrame([("default", "y", 1.0)], "metric_name string, bench string, weight double")), str(tmp_path / "out"), ["default"])
    assert [r.name for r in spark.read.json(str(tmp_path / "out")).collect()] == ["mine"]
    info = sinks.composites_info(spark, str(tmp_path / "out")).first()
    assert info.is_there and info.size > 20 and info.metrics == 1
    assert sinks.clear_composites(spark, str(tmp_path / "out")) and not sinks.clear_composites(spark, str(tmp_path / "out"))
    assert tuple(sinks.composites_info(spark, str(tmp_path / "out")).first()) == (False, 0, 0)


def test_dictionaries_and_ignore_lists(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"Their Name": "Our Name", "none": None}))
    told = S.read_dictionary(spark, str(tmp_path / "d.json"))
    assert [tuple(r) for r in told.collect()] == [("Their Name", "Our Name")]
    told.write.parquet(str(tmp_path / "d.parquet"))
    assert S.read_dictionary(spark, str(tmp_path / "d.parquet")).collect() == told.collect()
    (tmp_path / "i.json").write_text('["a", "b"]')
    (tmp_path / "i.txt").write_text("a\n\nb\n")
    for name in ("i.json", "i.txt"):
        assert sorted(r.prefix for r in S.read_ignored(spark, str(tmp_path / name), "prefix").collect()) == ["a", "b"]


def test_nested_has_no_odd_numbers(spark):
    cells = spark.createDataFrame([("e", "m", float("nan"), 0.0, "s", True)], schema.CELLS)
    entities = spark.createDataFrame([("e", "c", "u", None, None, 0)], schema.ENTITIES)
    assert sinks.nested(cells, entities).first().benchmarks[0].score is None


def test_text_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 1)], "metric string, n long")
    sinks.write_counts(counts, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a\t1", "b\t2"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("c", "2024-01-01 00:00:01", 1.0), ("c", "2024-01-01 00:00:02", 0.5), ("c", "2024-01-01 00:00:03", 2.0), ("d", "2024-01-01 00:00:01", -1.0)], "company string, ts string, composite double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = running.running_best(stream).writeStream.format("memory").queryName("best").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.company, r.composite) for r in spark.table("best").collect()) == [("c", 1.0), ("c", 2.0), ("d", -1.0)]
    stats = running.windowed_stats(stream.select("ts", F.col("company").alias("metric"), F.col("composite").alias("score")))
    query = stats.writeStream.format("memory").queryName("stats").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.metric, r.n) for r in spark.table("stats").collect()} == {("c", 3), ("d", 1)}
