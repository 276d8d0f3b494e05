"""Configuration, selection, reports and the model fit against plain loops and worked values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators import model, rank, selection
from plumbline.plans import config, sweep
from plumbline.plans.rules import SHIPPED, TYPESCRIPT, Rule, merge_rules, rule_views
from plumbline.sinks import report
from plumbline.sources import store


def test_conditions():
    assert config.parse_condition(" sloc >  1e2 ") == ("sloc", 100.0)
    for bad in ("sloc", "a b > 1", "sloc >= 1", "> 3", "sloc > nan", "sloc > inf", "sloc > x"):
        with pytest.raises(config.ConfigError):
            config.parse_condition(bad)


def test_configuration_round_trip():
    data = {"version": "v1", "rules": [{"metric": "sloc", "kind": "capacity", "max": 10, "when": "files > 3"}], "languages": {"ts": [{"metric": "sloc", "kind": "capacity", "max": 20}]}, "exclude": ["gen/**"], "exemptions": [{"package": "p", "metric": "sloc", "reason": "r"}]}
    c = config.parse(data)
    assert c.rules[0].when_metric == "files" and c.for_language("ts")[0].max == 20 and c.for_language("go") == c.rules
    assert config.load(config.dump(c)) == c
    with pytest.raises(config.ConfigError) as bad:
        config.parse({"rules": [{"metric": "sloc", "kind": "capacity", "odd": 1}], "exclude": ["a/[b"], "exemptions": [{"package": "p"}], "what": 1})
    for part in ("version is required", "unknown key 'what'", "unknown key 'odd'", "needs max", "exclude[0]", "reason is required"):
        assert part in str(bad.value)
    assert [r.severity for r in config.suggested(c, ["sloc"]).rules] == ["warn"]
    assert config.candidate(c, "v2", {"sloc": {"max": 7}}).rules[0].max == 7 and config.language_override(c, "go", {"sloc": {"max": 3}}).for_language("go")[0].max == 3


def test_overrides_stand_where_the_first_rule_stood():
    top = (Rule("a", "capacity", max=1), Rule("h", "requirement", require=True, roles=("main",)), Rule("b", "capacity", max=1), Rule("h", "requirement", require=True))
    got = merge_rules(top, (Rule("h", "requirement", require=False), Rule("h", "requirement", require=False, roles=("main",)), Rule("b", "capacity", disabled=True), Rule("z", "capacity", max=3)))
    assert [(r.metric, r.require) for r in got] == [("a", None), ("h", False), ("h", False), ("z", None)]
    found, views = rule_views(SHIPPED, {"typescript": TYPESCRIPT})
    assert len(found) == len(SHIPPED) + len(TYPESCRIPT) and [v for v in views if v[0] is None] == [(None, i, i) for i in range(len(SHIPPED))]


def test_slots_are_filled_as_a_loop_would(spark, tiny):
    from plumbline.queries import chosen

    rows = [r.asDict() for r in selection.strata(selection.recomputed(chosen._eligible(spark, tiny), chosen.P)).collect()]
    slots, tried, per, want = (("ONE_PASS/tested", 4), ("ONE_PASS/untested", 3), ("FEW_PASSES/tested", 4), ("FEW_PASSES/untested", 2)), set(), {}, []
    for name, n in slots:
        mine = sorted((r for r in rows if r["stratum"] == name), key=lambda r: r["place"])
        for k in range(n):
            for r in mine[k * len(mine) // n :]:
                if r["package"] in tried or per.get(r["module"], 0) >= 1:
                    continue
                tried.add(r["package"])
                want.append((name, k, r["package"], r["ord"] % 5 != 0))
                if want[-1][3]:
                    per[r["module"]] = 1
                break
    got = [(r.stratum, r.slot, r.package, r.ok) for r in entry.queries()["w11_selected"](spark, tiny).orderBy("ord").collect()]
    assert got == want and len(want) > 3


def test_places_of_one_order(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") * 37 % 11).alias("v")).repartition(7)
    got = {r.id: r.place for r in rank.placed(df, [F.col("v").desc(), F.col("id")], "place").collect()}
    want = {i: n + 1 for n, i in enumerate(sorted(range(200), key=lambda i: (-(i * 37 % 11), i)))}
    assert got == want and rank.placed(df.limit(0), ["id"], "place").count() == 0


def test_texts_of_a_check(spark):
    rows = [("p", 1, "sloc", "violation", 10.0, 20.5, True, "max 15", None), ("q", 2, "has_tests", "warning", None, 0.0, False, "require true", None), ("p", 3, "globals", "violation", 0.0, 1.0, True, "max_delta +0", "known")]
    df = spark.createDataFrame(rows, "package string, ord int, metric string, kind string, base double, head double, has_base boolean, label string, reason string")
    lines = report.lines_of(df)
    text = report.check_text(lines, spark.createDataFrame([("p", "p: 1 violation")], "package string, line string"))
    assert text == "violations:\n  p\n    sloc: 10 -> 20.5, max 15.\nwarnings:\n  q\n    has_tests: false (no baseline), require true.\nexempted:\n  p\n    globals: 0 -> 1, max_delta +0. Exempted: known\np: 1 violation\n"
    assert json.loads(report.hook(lines))["decision"] == "block" and report.hook(lines.where("section = 'warnings'")) == "{}\n"
    placed = df.withColumn("file", F.when(F.col("ord") == 1, "a:b,c.go")).withColumn("line", F.lit(7))
    got = {r.ord: r.command for r in report.annotations(placed).collect()}
    assert got == {1: "::error file=a%3Ab%2Cc.go,line=7::sloc: 10 -> 20.5, max 15.", 2: "::warning file=q::has_tests: false (no baseline), require true.", 3: "::notice file=p::globals: 0 -> 1, max_delta +0. Exempted: known"}
    many = df.where("ord = 1").withColumn("ord", F.explode(F.sequence(F.lit(1), F.lit(23))))
    assert report.annotations(many.withColumn("file", F.lit(None).cast("string")).withColumn("line", F.lit(1))).count() == 10
    assert [tuple(r) for r in report.omitted(many).collect()] == [("error", 10, 13)]


def test_fit_recovers_planted_parameters():
    truth = model.Form(overhead=9000, scale=1.4, per_export=120, per_untested=400, per_hidden=250, exponent=1.5)
    x, y = model.planted(120, truth, 0.0, 3)
    fit = model.fit_form(x, y, model.Form())
    for name in ("overhead", "scale", "per_export", "per_untested", "per_hidden", "exponent"):
        assert getattr(fit.form, name) == pytest.approx(getattr(truth, name), rel=1e-3)
    assert fit.r2 > 0.999 and not fit.fixed
    few = model.fit_form(x[:40][truth.ratio(x[:40]) < 0.5], y[:40][truth.ratio(x[:40]) < 0.5], model.Form())
    assert "exponent" in few.fixed and few.form.exponent == 1.0
    assert np.allclose(model.linearized(truth, y), truth.overhead + truth.scale * truth.tokens(x))
    x, y = model.planted(200, truth, 0.05, 4)
    fits = model.profile(x, y, model.Form(), [20_000.0, 37_500.0, 90_000.0])
    best, sure = model.best_budget(fits, 90_000.0)
    assert best == 37_500.0 and sure and model.best_budget(fits, 37_500.0) == (37_500.0, False) and model.best_budget({}, 1.0) == (0.0, False)


def test_contributions():
    truth = model.Form(overhead=5000, scale=1.2, per_export=300, per_untested=400)
    x, y = model.planted(150, truth, 0.02, 5)
    rng = np.random.default_rng(1)
    got = {c.name: c for c in model.contributions(x, y, {"noise": rng.normal(size=150), "flat": np.ones(150), "cheap": x[:, 1] * 0 - rng.random(150)})}
    assert got["volume"].verdict == got["exports"].verdict == "cost" and got["flat"].verdict == "no variation" and got["noise"].verdict in ("none", "help", "cost")
    assert model.verdict(True, None, False, True) == "pass only" and model.verdict(True, None, False, False) == "untested" and model.verdict(True, -1.0, True, False) == "help"
    with pytest.raises(model.TooFew):
        model.fit_form(x[:4], y[:4], model.Form())


def test_observations_are_medians_of_passing_runs(spark):
    rows = [("a", True, 10.0, 1.0), ("a", True, 30.0, 1.0), ("a", False, 99.0, 1.0), ("a", True, None, 1.0), ("b", False, 5.0, 2.0)]
    got = model.observations(spark.createDataFrame(rows, "package string, passed boolean, tokens double, volume double"), ["volume"]).collect()
    assert [(r.package, r.volume, r.tokens) for r in got] == [("a", 1.0, 20.0)]


def test_torn_and_bad_lines(spark, tmp_path):
    path = tmp_path / "commits.jsonl"
    read = lambda: sorted(r.commit for r in store.read_lines(spark, str(path), "commit string, n bigint", "commit").collect())
    path.write_text('{"commit":"a","n":1}\n\n{"commit":"b"}\n{"commit":"c"}')
    assert read() == ["a", "b"]  # what an interrupted write left goes
    path.write_text('{"commit":"a"}\n{"commit":"c"}\n')
    assert read() == ["a", "c"]
    path.write_text('{"commit":"a"}\nnot json\n{"commit":"c"}\n')
    with pytest.raises(store.BadLine):
        read()


def test_settings_of_a_sweep():
    r = Rule("sloc", "capacity", max=1000, over_max_delta=150)
    assert sweep.limits(r) == ["max", "over_max_delta"] and str(sweep.shipped(r, "max")) == "max 1000"
    assert [s.value for s in sweep.grid(r, "max")] == [500, 750, 1000, 1250, 1500, 2000, 3000, 5000]
    assert sweep.grid(r, "over_max_delta")[0].value == 0 and sweep.grid(r, "over_max_delta")[-1].value == 500
    d = Rule("dup", "density", max_delta=6, max=40, floor=10)
    assert sweep.grid(d, "max")[-1] == sweep.Setting("max", None) and sweep.applied(d, sweep.Setting("max", None)).max is None
    g = Rule("has_tests", "requirement", require=True, when_metric="sloc", when_value=100)
    assert str(sweep.grid(g, "when")[-1]) == "no guard" and sweep.applied(g, sweep.Setting("when", None)).when_metric is None and sweep.applied(g, sweep.Setting("when", 5.0)).when_value == 5.0
