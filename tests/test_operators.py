"""Derivations, resolution, upserts, rankings and hold-outs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from scoreweave.functions import names as N
from scoreweave.functions import numbers as M
from scoreweave.operators import cells as C
from scoreweave.operators import derive as D
from scoreweave.operators import evaluate as E
from scoreweave.operators import impute as I
from scoreweave.operators import rank as R
from scoreweave.operators import resolve as S
from scoreweave.operators import upsert as U
from scoreweave.plans.categories import default_criteria, with_stored

OBS = "entity string, metric string, score double, std_dev double, source string, ord long"
ENT = "entity string, company string, url string, release_date string, capabilities struct<input: array<string>, output: array<string>>, ord long"


def obs(spark, *rows):
    return spark.createDataFrame([(e, m, None if s is None else float(s), None, "src", i) for i, (e, m, s) in enumerate(rows)], OBS)


def scores(df):
    return {(r.entity, r.metric): r.score for r in df.collect()}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_release_date(spark):
    rows = spark.createDataFrame([("a", "c", "u", "2024-07-01", None, 0), ("b", "c", "u", "soon", None, 1)], ENT)
    got = scores(D.release_dates(rows))
    assert got[("a", D.RELEASE)] == pytest.approx(2024.4972677595628)
    assert got[("b", D.RELEASE)] is None


def test_latency_and_speed(spark):
    got = scores(D.latency(obs(spark, ("a", D.TOKENS, 7.3), ("a", D.SPEED, 119), ("b", D.TOKENS, 7.3), ("b", D.ACTIVE, 1.675), ("c", D.SPEED, 5))))
    assert got == {("a", D.LATENCY): pytest.approx(1.0), ("b", D.SPEED): pytest.approx(1000.0), ("b", D.LATENCY): pytest.approx(0.119)}


def test_prices(spark):
    got = scores(D.prices(obs(spark, ("a", D.ACTIVE, 100), ("b", D.ACTIVE, 100), ("b", D.SPEED, 100), ("c", D.ACTIVE, 1), ("c", D.INPUT, 2), ("c", D.OUTPUT, 3))))
    assert got[("a", D.INPUT)] == pytest.approx(0.948) and got[("a", D.OUTPUT)] == pytest.approx(3.176)
    assert got[("b", D.INPUT)] == pytest.approx(0.637) and got[("b", D.OUTPUT)] == pytest.approx(1.629)
    assert not any(e == "c" for e, _ in got)


def test_cost(spark):
    got = scores(D.cost_of_1k(obs(spark, ("a", D.TOKENS, 7.3), ("a", D.INPUT, 1), ("a", D.OUTPUT, 1), ("b", D.TOKENS, 1))))
    assert got == {("a", D.COST): pytest.approx(0.13), ("b", D.COST): None}


def test_capability_floor_is_averaged(spark):
    ent = spark.createDataFrame([("a", "c", "u", None, (["text"], []), 0), ("b", "c", "u", None, None, 1)], ENT)
    rules = spark.createDataFrame([("m", 25.0, (["text", "image"], []))], "metric string, random_score double, capabilities struct<input: array<string>, output: array<string>>")
    floor = D.capability_floor(ent, rules)
    assert [(r.entity, r.source) for r in floor.collect()] == [("a", "Missing capability: input:image")]
    got = C.merge_cells(obs(spark, ("a", "m", 75)).unionByName(floor)).first()
    assert (got.score, got.std_dev) == (50.0, pytest.approx(35.35533905932738))
    assert got.source == "Multiple: Score 75 at src; Score 25 at Missing capability: input:image"


def test_derive_all_sees_earlier_steps(spark):
    ent = spark.createDataFrame([("a", "c", "u", "2024-01-01", (["text"], ["text"]), 0)], ENT)
    rules = spark.createDataFrame([("m", 0.0, (["text"], []))], "metric string, random_score double, capabilities struct<input: array<string>, output: array<string>>")
    got = scores(D.derive_all(obs(spark, ("a", D.SIZE, 10), ("a", D.TOKENS, 7.3), ("a", D.ACTIVE, 1.675)), ent, rules))
    assert got[("a", D.RELEASE_SIZE)] == pytest.approx(2024 * 2.302585092994046)
    assert got[("a", D.INPUT)] == pytest.approx(0.370 - 0.00471 * 1.675 + 0.738 * 1.675 / 1000)


@pytest.mark.parametrize(("name", "norm"), [("Custom-Model", "custom model"), ("model_v2.0", "model v2 0"), ("model-20240115", "model"), ("ai-model_v3.1-beta", "ai model v3 1 beta"), ("a12345678b87654321", "ab87654321"), ("", "")])
def test_normalize(spark, name, norm):
    assert one(spark, N.normalize_name(F.col("n")), n=name) == norm


@pytest.mark.parametrize(("name", "entity", "told", "sure"), [("my-ai-model", "My AI Model", False, True), ("model-1.0", "Model 2.0", False, False), ("ai-model", "AI Model Pro", False, False), ("", "", False, True), ("model-café", "Model Café", False, True), ("gpt-4", "GPT-4", True, True), ("x", "y", True, True)])
def test_unambiguous(spark, name, entity, told, sure):
    assert one(spark, S.is_unambiguous(F.col("n"), F.col("e"), F.col("t")), n=name, e=entity, t=told) is sure


def test_pairing_once(spark):
    ext = spark.createDataFrame([("a-b", 0), ("A_B", 1)], "name string, ord long")
    ours = spark.createDataFrame([("A B", 0), ("other", 1)], "entity string, ord long")
    none = spark.createDataFrame([], "name string, entity string")
    got = {r.name: (r.entity, r.kind) for r in S.match(ext, ours, none, once=True).collect()}
    assert got == {"a-b": ("A B", "exact"), "A_B": ("other", "nearest")}
    got = {r.name: r.kind for r in S.match(ext, ours, none).collect()}
    assert got == {"a-b": "exact", "A_B": "exact"}


def test_match_without_entities(spark):
    ext = spark.createDataFrame([("a", 0)], "name string, ord long")
    ours = spark.createDataFrame([], "entity string, ord long")
    matches = S.match(ext, ours, spark.createDataFrame([], "name string, entity string"))
    assert [r.kind for r in matches.collect()] == ["none"]
    assert S.summary(matches).first().asDict() == {"total": 1, "unambiguous": 0, "ambiguous": 1, "unmatched": 1}


def test_suggestions(spark):
    names = spark.createDataFrame([("MMLU", 0), ("MMLU Pro", 1), ("zzzzzz", 2)], "name string, ord long")
    known = spark.createDataFrame([("MMLU", 0), ("MMLU-Pro", 1)], "name string, ord long")
    assert [(r.name, r.closest, r.distance) for r in S.suggestions(names, known).collect()] == [("MMLU Pro", "MMLU-Pro", 1), ("zzzzzz", "MMLU", 6)]
    got = S.suggestions(names, known.where("false")).collect()
    assert {(r.closest, r.distance) for r in got} == {("", None)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_nearest_names_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    ours = sorted({word(rng.randint(0, 14)) for _ in range(60)})
    names = {word(rng.randint(0, 16)) for _ in range(60)} | {"", "zzzzzzzzzzzzzzzzzzzz"}
    for x in rng.sample(ours, 20):  # near ones
        y = list(x)
        for _ in range(rng.randint(1, 7)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z", "c"])
        names.add("".join(y))
    rng.shuffle(ours)
    ext = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(names))], "name string, ord long")
    ent = spark.createDataFrame([(n, i) for i, n in enumerate(ours)], "entity string, ord long")
    got = {r.name: (r.distance, r.entity) for r in S.nearest(ext, ent, normalized=False).collect()}
    want = {n: min((edits(n, o), i, o) for i, o in enumerate(ours)) for n in names}
    assert got == {n: (d, o) for n, (d, _, o) in want.items()}
    for bound in (1, 2, 3, 6):
        rows = S.within(ext.withColumn("norm", F.col("name")), ent.select(F.col("entity").alias("other"), F.col("entity").alias("first")), bound).distinct().collect()
        assert {(r.name, r.first): r.distance for r in rows} == {(n, o): d for n in names for o in ours if (d := edits(n, o)) <= bound}


def test_upserts(spark):
    old = spark.createDataFrame([("a", "m", 1.0, 0.5, "s", 0), ("a", "m", 2.0, None, "t", 1), ("a", "n", 3.0, None, "s", 2)], OBS)
    new = spark.createDataFrame([("a", "m", 9.0, "t", 0), ("a", "n", 3.0, "s", 1), ("b", "m", 4.0, "t", 2)], "entity string, metric string, score double, source string, ord long")
    got = sorted((r.entity, r.metric, r.source, r.score, r.action) for r in U.upsert_by_source(old, new).collect())
    assert got == [("a", "m", "s", 1.0, "kept"), ("a", "m", "t", 9.0, "replaced"), ("a", "n", "s", 3.0, "kept"), ("b", "m", "t", 4.0, "appended")]
    got = sorted((r.entity, r.metric, r.source, r.score, r.action) for r in U.upsert_by_metric(old, new).collect())
    assert got == [("a", "m", "t", 2.0, "kept"), ("a", "m", "t", 9.0, "replaced"), ("a", "n", "s", 3.0, "kept"), ("b", "m", "t", 4.0, "appended")]


def test_composite(spark):
    cells = obs(spark, ("a", "x", 3), ("b", "x", 1), ("a", "y", 1), ("b", "y", 3), ("c", "z", 5))
    metric = R.CompositeMetric("t").put("x", 3).put("y", 1).put("absent", 2)
    got = {r.entity: r.composite for r in R.composite_scores(cells, metric.frame(spark)).collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(-0.5), "c": 0.0}
    assert metric.columns() == ["x", "absent", "y"]
    assert metric.drop("x").criteria == {"y": 1.0, "absent": 2.0}
    with pytest.raises(ValueError, match="above 0"):
        metric.put("x", 0)
    flat = obs(spark, ("a", "x", 7), ("b", "x", 7))
    assert {r.composite for r in R.composite_scores(flat, R.CompositeMetric("t", {"x": 1.0}).frame(spark)).collect()} == {7.0}


def test_running_best(spark):
    ent = spark.createDataFrame([("a", "c", "u", "2024-01-01", None, 0), ("b", "c", "u", "2024-02-01", None, 1), ("d", "c", "u", "2024-03-01", None, 2), ("e", "c", "u", None, None, 3)], ENT)
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("d", 2.0), ("e", 9.0)], "entity string, composite double")
    assert sorted(r.entity for r in R.running_best(rows, ent).collect()) == ["a", "d"]


def test_filters_and_texts(spark):
    cells = obs(spark, ("a", "x", 3), ("b", "x", 1), ("c", "y", 1))
    assert {r.entity for r in R.passing(cells, "x", 3.0).collect()} == {"b"}
    assert {r.entity for r in R.passing(cells, None, 3.0).collect()} == {"a", "b", "c"}
    assert {r.entity for r in R.passing(cells, "x", None).collect()} == {"a", "b", "c"}
    text = M.score_text(F.col("s"), F.col("d"))
    assert one(spark, text, s=12.125, d=1.0) == "12.13 ±2.57"
    assert one(spark, text, s=12.0, d=0.0) == "12"
    assert one(spark, M.half_up(F.col("s")), s=-2.5) == -2.0
    assert one(spark, M.inverse_erf(F.col("s")), s=0.5) == pytest.approx(0.4769, abs=2e-3)
    assert "3±2" in R.text_table(cells.withColumn("std_dev", F.lit(1.0)), ["x", "y"]).where("line like 'a%'").first()["line"]


def test_labels(spark):
    assert one(spark, N.axis_label(F.col("s")), s="Size") == "Size (Billion Parameters)"
    assert one(spark, N.hue(F.col("s")), s="ab") == 97 * 31 + 98 - (97 * 31 + 98) // 360 * 360
    assert one(spark, N.slug(F.col("s")), s="Z.ai Labs") == "zailabs"
    assert one(spark, N.capitalize(F.col("s")), s="textToText") == "TextToText"
    assert one(spark, N.age_alpha(F.col("a"), F.col("b")), a=dt.date(2024, 1, 1), b=dt.date(2024, 12, 31)) == 0.0


def test_categories(spark):
    rows = default_criteria(spark)
    assert rows.select("metric_name").distinct().count() == 8 and rows.where("weight < 0").count() == 3
    own = spark.createDataFrame([("mine", "x", 1.0, 0)], "metric_name string, bench string, weight double, ord long")
    last = with_stored(rows, own).orderBy(F.desc("ord")).first()
    assert last.metric_name == "mine" and last.ord == 8
    assert one(spark, N.company_color(F.col("s")), s="Liquid") == "hsl(251, 69%, 59%)"
    assert one(spark, N.company_color(F.col("s")), s="ab") == "hsl(225, 70%, 60%)"
    assert E.moving_average([]) is None and E.moving_average([32.0, 0.0]) == 31.0


def test_hold_outs(spark):
    rows = obs(spark, *[(f"e{i}", m, i * k + k) for i in range(6) for k, m in enumerate("ABC", 1)])
    sample = E.holdout_sample(rows, 4)
    assert sample.count() == 4 and E.holdout_sample(rows, 4).collect() == sample.collect()
    errors = E.evaluate(rows, sample)
    got = E.mean_squared_error(errors).first()
    assert got.tests == 4 and got.mse < 1e-6  # the metrics are exact lines of each other
    worse = E.mean_squared_error(E.evaluate(rows, sample, I.impute_mean)).first()
    assert worse.mse > got.mse


@pytest.mark.parametrize("whole", [True, False])
def test_one_fit_serves_all_hold_outs(spark, whole):
    rng = random.Random(3)
    rows = [(f"e{i}", m, rng.gauss(0, 1) + k * i * 0.1) for i in range(12) for k, m in enumerate("ABCDE") if rng.random() < 0.7]
    rows += [(e, m, s + 1) for e, m, s in rng.sample(rows, 8)] + [("alone", "A", 1.0), ("e1", "rare", 2.0), ("e2", "rare", 3.0), ("e3", "flat", 1.0), ("e4", "flat", 1.0)]
    table = obs(spark, *rows)
    sample = E.holdout_sample(table, 60)
    key = lambda df: {r.holdout: (r.predicted, r.error) for r in df.collect()}
    for quick, impute in ((E.evaluate_mean, I.impute_mean), (E.evaluate_bivariate, I.impute_bivariate)):
        got, want = key(quick(table, sample, whole)), key(E.evaluate(table, sample, impute, whole))
        assert set(got) == set(want) and len(want) > 30
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-9)


@pytest.mark.parametrize(("whole", "odd"), [(True, []), (False, []), (True, ["spoilt", "rare"])])
def test_refits_match_evaluate(spark, whole, odd, monkeypatch):
    from scoreweave.operators import refit

    rng = random.Random(5)
    rows = [(f"e{i}", m, rng.gauss(0, 1) + k * i * 0.1) for i in range(12) for k, m in enumerate("ABCD") if rng.random() < 0.7]
    rows += [(e, m, s + 1) for e, m, s in rng.sample(rows, 8)] + [(f"e{i}", "const", 0.1) for i in range(9)] + [("e3", None, 3.0), (None, "A", 3.0), ("e9", "A", None)]
    rows += [("alone", "A", 1.0), ("n1", "A", None), ("n1", "B", 3.0), ("n2", "lone", 4.0), ("n2", "A", 1.5), ("e1", "rare", 2.0), ("e2", "rare", 3.0), *[("e7", m, math.nan) for m in odd]]
    table = obs(spark, *rows)
    sample = E.holdout_sample(table.where("entity is not null and metric is not null"), 90)
    key = lambda df: {r.holdout: (r.predicted, r.error) for r in df.collect()}
    want = key(E.evaluate(table, sample, I.impute_bivariate, whole))
    for most in (refit.MOST_PAIRS, 700, 7):  # one turn, several, and more metrics than fit
        monkeypatch.setattr(refit, "MOST_PAIRS", most)
        got = key(refit.refit_bivariate(table, sample, whole))
        assert set(got) == set(want) and len(want) > 30
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-9, nan_ok=True)


def test_reports_and_lists(spark, tmp_path):
    from scoreweave.sources import sinks

    ours = spark.createDataFrame([("A B", "c", "u", "2024", 0), ("other", "d", "v", "2023", 1)], "entity string, company string, url string, release_date string, ord long")
    ext = spark.createDataFrame([("a-b", 0), ("othr", 1)], "name string, ord long")
    matches = S.match(ext, ours.select("entity", "ord"), spark.createDataFrame([], "name string, entity string"))
    report = S.ambiguous_report(matches, ours)
    assert [(r.name, r.entity, r.company) for r in report.collect()] == [("othr", "other", "d")]
    sinks.write_report(report, str(tmp_path / "r"))
    assert [r.url for r in spark.read.json(str(tmp_path / "r")).collect()] == ["v"]
    caps = spark.createDataFrame([("x", (["a"], []), 0), ("x", (["b"], []), 1), ("x", None, 2)], "entity string, capabilities struct<input: array<string>, output: array<string>>, ord long")
    assert D.with_capabilities(spark.createDataFrame([("x", 1), ("y", 2)], "entity string, capabilities int"), caps).orderBy("entity").collect()[0].capabilities.input == ["b"]
    assert [r.entity for r in R.by_name(spark.createDataFrame([("b",), ("A",), ("a",)], "entity string")).collect()] == ["a", "A", "b"]
    points = spark.createDataFrame([("a", "x"), ("b", "y")], "entity string, company string")
    assert [r.entity for r in R.visible(points, hidden=["x"]).collect()] == ["b"] and [r.entity for r in R.visible(points, isolated="x").collect()] == ["a"]
    assert R.visible(points).count() == 2
