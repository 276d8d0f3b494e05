"""Operators by themselves: worked examples, brute force, planted parameters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import duplication as D
from plumbline.operators import gate, rank
from plumbline.operators import matching as M
from plumbline.operators import regress as R
from plumbline.plans.rules import SHIPPED, Rule, merge_rules, rules_table
from plumbline.sources import readers, store

BASE = dict(files=1, sloc=39, tokens_est=131, tokens_est_with_tests=186, exported_symbols=4, untested_exports=3, globals=0, init_funcs=0, cognitive_p90=3, func_count=4, dup_blocks=0, duplication_pct=0.0, documented_exports=None, coverage_pct=None)


def frame(spark, **over):
    row = {**BASE, **over}
    kinds = {k: "double" if k.endswith("pct") else "bigint" for k in row}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row))


def test_worked_example(spark):
    """A package of 28,400 tokens under the uncalibrated parameters: 1.136 budgets, 1.1803 passes."""
    p = S.RebuildParams(context_budget=25000, exponent=1.3)
    r = spark.range(1).select(S.agent_passes(F.lit(28400.0), p)).first()[0]
    assert round(28400 / 25000, 4) == 1.136 and round(r, 4) == 1.1803


def test_terms(spark):
    r = rank.estimates(frame(spark, duplication_pct=25.0, coverage_pct=50.0)).first()
    assert (r.t_volume, r.t_spec, r.t_unspecified) == (131 * 0.75, 55.0, 450.0)
    assert r.tier == "ONE_PASS"


def test_coverage_never_raises_days(spark):
    days = [rank.estimates(frame(spark, coverage_pct=c)).first().days_ii for c in (None, 0.0, 80.0)]
    assert days[0] == days[1] == days[2]


def test_parameters_are_checked():
    with pytest.raises(ValueError, match="context_budget"):
        S.RebuildParams(context_budget=0).validate()
    with pytest.raises(ValueError, match="unknown sort key"):
        rank.sort_order("size")
    assert Rule("x", "capacity").validate() and Rule("x", "odd").validate()


def test_rounding(spark):
    r = spark.range(1).select(S.round_to(F.lit(1.005), 2), S.round_to(F.lit(2.5), 0), S.round_to(F.lit(-2.5), 0), S.share(F.lit(1), F.lit(0)), S.readable(F.lit(443.0)), S.delta_from_iqr(F.lit(8.0))).first()
    assert tuple(r) == (1.0, 3.0, -3.0, 0.0, 450.0, 2.0)


def findings(spark, rules, heads, bases):
    metrics = ["sloc", "tokens_est", "max_nesting", "dup_blocks", "has_tests"]
    cols = "package string, role string, " + ", ".join(f"{m} bigint" for m in metrics)
    pairs = gate.pair_rows(spark.createDataFrame(heads, cols), spark.createDataFrame(bases, cols), metrics)
    return gate.evaluate(pairs, rules_table(spark, rules), metrics)


def test_identical_snapshots_never_violate(spark):
    rng = random.Random(20260927)
    rows = [(f"p{i}", "library", rng.randint(0, 3000), rng.randint(0, 40000), rng.randint(0, 9), rng.randint(0, 5), rng.randint(0, 1)) for i in range(200)]
    got = gate.merge_findings(findings(spark, SHIPPED, rows, rows))
    assert got.where("kind = 'violation'").count() == 0


def test_capacity_cases(spark):
    rule = (Rule("sloc", "capacity", max=1000, over_max_delta=150),)
    row = lambda p, s: (p, "library", s, 0, 0, 0, 1)
    heads = [row("new", 1001), row("crossed", 1001), row("same", 1200), row("some", 1300), row("much", 1400), row("near", 750), row("low", 749)]
    bases = [row("crossed", 900), row("same", 1200), row("some", 1200), row("much", 1200), row("near", 1), row("low", 1)]
    got = {r.package: (r.warning, r.label) for r in findings(spark, rule, heads, bases).collect()}
    assert got == {"new": (False, "max 1000"), "crossed": (False, "max 1000"), "same": (True, "max 1000"), "some": (True, "over max by 300, allowed 150"), "much": (False, "over max by 400, allowed 150"), "near": (True, "max 1000")}


def test_same_cause_findings_merge(spark):
    rules = (Rule("sloc", "capacity", max=100), Rule("tokens_est", "capacity", max=100), Rule("max_nesting", "density", max_delta=0, max=5))
    got = {r.metric: r for r in gate.merge_findings(findings(spark, rules, [("p", "main", 200, 300, 7, 0, 1)], [("p", "main", 50, 60, 3, 0, 1)])).collect()}
    assert set(got) == {"sloc", "max_nesting"}
    assert list(got["sloc"].also) == ["tokens_est"] and got["sloc"].label == "max 100; tokens_est 60 -> 300, max 100"
    assert got["max_nesting"].label == "max_delta +0 and max 5"


def test_rules_merge_in_place():
    out = merge_rules((Rule("a", "capacity", max=1), Rule("b", "capacity", max=1)), (Rule("a", "capacity", max=2), Rule("b", "capacity", disabled=True), Rule("c", "capacity", max=3)))
    assert [(r.metric, r.max) for r in out] == [("a", 2), ("c", 3)]


def naive(codes, least):
    """Positions in any run of `least` tokens that occurs twice."""
    seen, out = {}, set()
    for i in range(len(codes) - least + 1):
        seen.setdefault(tuple(codes[i : i + least]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            out |= {q for p in places for q in range(p, p + least)}
    return out


def test_repeats_cover_what_is_repeated():
    rng = random.Random(4)
    for _ in range(200):
        codes = np.array([rng.randint(0, 2) for _ in range(rng.randint(2, 60))])
        found = D.repeats(codes, 4)
        assert {q for r in found for p in r.places for q in range(p, p + r.length)} == naive(codes.tolist(), 4)
        for r in found:
            assert len({tuple(codes[p : p + r.length]) for p in r.places}) == 1 and len(r.places) > 1


def test_periodic_run():
    assert D.repeats(np.zeros(3000, np.int64), 60)[0].length == 2999


def test_smaller_neighbours():
    rng = random.Random(2)
    for _ in range(200):
        v = [rng.randint(0, 5) for _ in range(rng.randint(1, 40))]
        before, after = D.smaller_neighbours(np.array(v))
        for i, x in enumerate(v):
            assert before[i] == max((j for j in range(i) if v[j] < x), default=-1)
            assert after[i] == min((j for j in range(i + 1, len(v)) if v[j] < x), default=len(v))


def test_literal_tables_are_cut_out():
    lit = np.array([False, False, True, True, True, False, False] * 2)
    assert D.without_literals([D.Repeat(3, (2, 9))], lit, 2) == []
    assert {(r.length, r.places) for r in D.without_literals([D.Repeat(7, (0, 7))], lit, 2)} == {(2, (0, 7)), (2, (5, 12))}
    assert D.without_literals([D.Repeat(7, (0, 7))], lit, 4) == [D.Repeat(7, (0, 7))]  # a table of three divides nothing at four
    assert D.without_literals([D.Repeat(7, (0, 7))], np.zeros(14, bool), 4) == [D.Repeat(7, (0, 7))]
    assert D.fnv(np.array([], np.int64)) == 14695981039346656037
    code, decl, idiom = (np.array([i]) for i in range(3))
    assert [D.kind_of(s, o) for s, o in ((code, False), (code, True), (decl, True), (np.array([1, 2]), False), (idiom, False))] == ["code", "self-overlap", "declarative", "idiom", "idiom"]


def whole_repeats(text, least):
    """Surviving maximal repeats by comparing every pair of places."""
    n = len(text)
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and j + k < n and text[i + k] == text[j + k] and isinstance(text[i + k], int):
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    out, reach = set(), 0
    for q in range(n):
        if longest[q] >= least and q + longest[q] > reach:
            run = text[q : q + longest[q]]
            out.add((longest[q], tuple(p for p in range(n - longest[q] + 1) if text[p : p + longest[q]] == run)))
        reach = max(reach, q + longest[q])
    return out


def test_file_blocks_are_brute_force(spark):
    """Blocks over connected groups are the blocks of the whole stream, file by file."""
    rng = random.Random(11)
    files = []
    for f in range(14):
        codes = [rng.randint(0, 4) for _ in range(rng.randint(0, 25))]
        if f % 3 == 1:
            codes += files[0][2] + [rng.randint(50, 60)]
        files.append(("s", f, codes))
    rows = [(s, f, c, [i // 4 for i in range(len(c))], [x == 4 for x in c], [0] * len(c)) for s, f, c in files]
    df = spark.createDataFrame(rows, "stream string, file long, codes array<long>, lines array<int>, literal array<boolean>, shape array<int>")
    got = {}
    for r in D.file_blocks(df, 6).collect():
        got.setdefault((r.grp, r.block), (r.tokens, set()))[1].add((r.file, r.pos))
    line, where = [], []
    for _, f, c in files:
        line += [*c, f"end{f}"]
        where += [(f, i) for i in range(len(c) + 1)]
    want = {(n, frozenset(where[p] for p in places)) for n, places in whole_repeats(line, 6)}
    assert {(n, frozenset(p)) for n, p in got.values()} == want and len(want) >= 3
    for r in D.file_blocks(df, 6, ignore_literals=True).collect():
        assert r.tokens >= 6 and (r.first_line, r.last_line) == (r.pos // 4, (r.pos + r.tokens - 1) // 4)


def test_groups_hold_forks_and_not_tokens(spark):
    """A group is as many rows as its files fork, however long the copies are; survivors alone cover what all places do."""
    rng = random.Random(5)
    long = [rng.randint(0, 1 << 40) for _ in range(5000)]
    files = [(f, long[: 4000 + 100 * f] + [-f - 1] * 7) for f in range(9)] + [(20, long[100:200]), (21, long[150:1000]), (22, [])]
    rows = [("s", f, c, [i // 4 for i in range(len(c))], [False] * len(c), [0] * len(c)) for f, c in files]
    df = spark.createDataFrame(rows, "stream string, file long, codes array<long>, lines array<int>, literal array<boolean>, shape array<int>")
    per_file = [r["n"] for r in D.grouped_forks(df, 6).groupBy("grp", "file").agg(F.count("*").alias("n")).collect()]
    assert max(per_file) < 40
    cover = lambda every: {(r.file, p) for r in D.block_places(df, 6, every).collect() for p in range(r.pos, r.pos + r.tokens)}
    line = [(f, p, x) for f, c in files for p, x in enumerate([*c, f"end{f}"])]
    assert cover(False) == cover(True) == {line[i][:2] for i in naive([x for _, _, x in line], 6)}
    places = D.file_blocks(df, 6)
    one = places.groupBy("grp", "block").agg(F.first("kind").alias("kind"), F.count("*").alias("n"))
    got = D.block_counts(df, 6).first()
    assert (got.blocks, got.code, got.occurrences) == (one.count(), one.where("kind = 'code'").count(), places.count())


def test_grams_are_hashed_in_slices(monkeypatch):
    """What a worker hashes at once is bounded by tokens, not by a batch's rows; the k-grams are the same."""
    import pyarrow as pa

    codes = [[(i * 7 + j) % 5 for j in range(i % 13)] for i in range(300)]
    rb = pa.RecordBatch.from_arrays([pa.array(["s"] * 300), pa.array(range(300), pa.int64()), pa.array(codes, pa.list_(pa.int64())), pa.array([[0] * len(c) for c in codes], pa.list_(pa.int32())), pa.array([1] * 300, pa.int64())], names=["stream", "file", "codes", "lines", "seed"])
    whole = {give: pa.Table.from_batches(D._gram_rows(iter([rb]), 5, give)) for give in ("hash", "sides", "forks", "lines")}
    monkeypatch.setattr(D, "SLICE", 20)
    for give, want in whole.items():
        parts = list(D._gram_rows(iter([rb]), 5, give))
        assert max(p.num_rows for p in parts) <= 20
        lines = {"first_line", "last_line"} & set(want.column_names)  # counted from anywhere, but one file's from the same
        assert pa.Table.from_batches(parts).drop_columns([*lines]).to_pylist() == want.drop_columns([*lines]).to_pylist()
    grams = {}
    for r in whole["forks"].to_pylist():
        grams.setdefault(r["g"], set()).add(tuple(codes[r["file"]][r["pos"] : r["pos"] + 5]))
    assert all(len(x) == 1 for x in grams.values()) and len(grams) == len(set.union(*grams.values()))


def test_ols_against_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=300) * (1 + np.abs(x[:, 0]))
    fit = R.ols(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), "y", ["a", "b"])
    d = np.column_stack([np.ones(300), x])
    inv = np.linalg.inv(d.T @ d)
    coef = inv @ d.T @ y
    h = np.einsum("ij,jk,ik->i", d, inv, d)
    w = ((y - d @ coef) / (1 - h)) ** 2
    assert np.allclose(fit.coef, coef) and np.allclose(fit.cov, inv @ (d.T * w) @ d @ inv)


def test_numerics():
    with pytest.raises(R.SingularColumn, match="c"):
        R.invert(np.array([[1.0, 1, 2], [1, 2, 3], [2, 3, 5]]), ["a", "b", "c"])
    x = np.linspace(0, 4, 40)
    b = R.levenberg_marquardt(lambda p: p[0] * np.exp(p[1] * x), np.array([1.0, 0.1]), 2 * np.exp(0.5 * x))
    assert np.allclose(b, [2, 0.5], atol=1e-6)
    assert round(R.t_critical_95(10), 3) == 2.228 and round(R.t_critical_95(1), 2) == 12.71
    assert R.significant(0.9, 10) and not R.significant(0.1, 10) and R.two_figures(1234.0) == 1200.0


def test_multiset_diff(spark):
    cols = "package string, name string, fingerprint int, ord int, value int"
    head = spark.createDataFrame([("p", "f", 1, 1, 10), ("p", "f", 1, 2, 11), ("p", "f", 2, 3, 12), ("p", "g", 9, 4, 13)], cols)
    base = spark.createDataFrame([("p", "f", 1, 1, 5), ("p", "f", 7, 2, 6)], cols)
    got = {r.ord: r.base_value for r in M.changed_functions(head, base, ["package", "name"]).collect()}
    assert got == {2: 6, 3: None, 4: None}


def test_globs():
    import re

    ok = lambda g, p: bool(re.search(S.glob_regex(g), p))
    assert ok("gen/[ab].go", "gen/b.go") and not ok("gen/[ab].go", "gen/c.go") and ok("gen/[^a-c].go", "gen/z.go") and ok(r"a/\*", "a/*")
    for bad in ("", " ", "/abs/x", "a//b", "a/../b", "./a", "a/b**", "**x/a", "a/[b", "a/[]"):
        with pytest.raises(S.BadPattern):
            S.glob_regex(bad)
    assert ok("internal/**", "internal/a/b") and ok("**/gen", "a/b/gen/c.go") and ok("a/*", "a/b/c") and ok("**/x", "x")
    assert not ok("a/*", "b/a") and not ok("*/docs", "docs") and not ok("a?", "abc")


def test_go_facts(spark):
    text = 'package a\n\n// one\nimport "fmt"\nimport (\n\t"os"\n\tx "net/http"\n)\n/* two\nlines */\nfunc f() {} // end\n'
    df = spark.createDataFrame([(text,), ("// Code generated by x. DO NOT EDIT.\npackage a\n",), ("package a\n// Code generated by x. DO NOT EDIT.\n",)], "t string")
    got = df.select(readers.source_lines(F.col("t")), readers.go_imports(F.col("t")), S.is_generated(F.col("t"))).collect()
    assert got[0][0] == 7 and list(got[0][1]) == ["fmt", "net/http", "os"]
    assert [r[2] for r in got] == [False, True, False]


def test_store_drops_orphans(spark, tmp_path):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "commit string, package string")
    store.record(p, spark.createDataFrame([("a",)], "commit string"), str(tmp_path), 0)
    assert [r.package for r in store.read(spark, str(tmp_path))[0].collect()] == ["x"]


def test_language_needs_one_marker(spark):
    files = spark.createDataFrame([("a/go.mod",), ("b/package.json",)], "path string")
    marks = {"go": "go.mod", "typescript": "package.json"}
    assert readers.detect_language(files.limit(1).where("path like '%go.mod'"), marks) == "go"
    with pytest.raises(ValueError):
        readers.detect_language(files, marks)


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_reaching_by_broadcast_and_by_shuffle(spark, monkeypatch, most):
    """The same packages whether what a round adds is broadcast or not; repeats, cycles and targets without edges."""
    monkeypatch.setattr(M, "BROADCAST_PACKAGES", most)
    rng = random.Random(8)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(70)] * 2 + [(100 + i, 101 + i) for i in range(6)] + [(106, 3)]
    want = {3, 500}
    while more := {a for a, b in edges if b in want} - want:
        want |= more
    got = M.reaching(spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(3,), (3,), (500,)], "package long"))
    assert sorted(r.package for r in got.collect()) == sorted(want) and len(want) > 8
