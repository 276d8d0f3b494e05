"""Scoring the gate against labelled commits: which rule judges a row, what fired, and how rates move.

Rules (ord, warns) are configuration and are broadcast. commits: commit, block (the label). fired: commit, rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import share
from plumbline.operators.history import rates

MODULE = "<module>"


class CorpusError(ValueError):
    """A replay and its labels don't fit together."""


def load_corpus(commits: DataFrame, labels: DataFrame, rows: DataFrame, agent_only: bool = False) -> DataFrame:
    """hash, block, passed, kept, set_aside of the commits scored: labels met with what was replayed.

    commits: hash, version, loaded, passed. labels: hash, verdict, agent. rows: hash, package, violations (count),
    unavailable. Commits that weren't loaded go, with agent_only also those labelled agent = false (unknown stays).
    Rows whose package was unavailable at the parent are set aside and the verdict is that of the others. A replay
    of two configuration versions, or a recorded verdict that its rows deny, is refused."""
    versions = [r[0] for r in commits.select("version").distinct().limit(2).collect()]
    if len(versions) > 1:
        raise CorpusError(f"commits were gated under {versions[0]} and {versions[1]}")
    met = commits.join(labels, "hash").where("loaded")
    if agent_only:
        met = met.where(F.coalesce("agent", F.lit(True)))
    per = rows.groupBy("hash").agg(
        F.sum("violations").alias("recorded"),
        F.count_if(~F.col("unavailable")).alias("kept"),
        F.count_if("unavailable").alias("set_aside"),
        F.sum(F.when(~F.col("unavailable"), F.col("violations")).otherwise(0)).alias("left"),
    )
    out = met.join(per, "hash", "left").fillna(0, ["recorded", "kept", "set_aside", "left"])
    wrong = out.where(F.coalesce("passed", F.lit(False)) == (F.col("recorded") > 0)).select("hash").first()
    if wrong is not None:
        raise CorpusError(f"commit {wrong[0]}: its verdict and its rows disagree")
    return out.select("hash", (F.col("verdict") == "block").alias("block"), (F.col("left") == 0).alias("passed"), "kept", "set_aside")


def relabelled(commits: DataFrame, second: DataFrame) -> DataFrame:
    """The same commits under a second set of labels (hash, verdict); a commit without one is refused."""
    missing = commits.join(second, "hash", "left_anti").select("hash").first()
    if missing is not None:
        raise CorpusError(f"commit {missing[0]} has no label in the second set")
    return commits.drop("block").join(second.select("hash", (F.col("verdict") == "block").alias("block")), "hash")


def judged_by(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (row, package, language, role, metric) with `rule`: the first of the language's rules on the metric that
    takes the role and the kind of row. A language with rules of its own is judged by those alone.

    rules: rule, language (null: all others), place, metric, roles, module_wide."""
    own = rules.where("language is not null").select(F.col("language").alias("use")).distinct()
    asked = rows.join(F.broadcast(own), F.col("language") == F.col("use"), "left")
    r = rules.select("rule", F.col("language").alias("use2"), "place", F.col("metric").alias("m"), "roles", "module_wide")
    met = asked.join(F.broadcast(r), (F.col("metric") == F.col("m")) & F.col("use").eqNullSafe(F.col("use2")))
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("library"))
    ok = (F.col("module_wide") == (F.col("package") == MODULE)) & ((F.size("roles") == 0) | F.array_contains("roles", role))
    return met.where(ok).groupBy(*rows.columns).agg(F.min_by("rule", "place").alias("rule"))


def gate_rates(fired: DataFrame, commits: DataFrame, rules: DataFrame, dropped: list[int] = []) -> DataFrame:
    """The gate's rates: a commit fails when a rule that doesn't warn fired on it. fired: commit, rule (distinct
    pairs are enough). `dropped` rules don't count."""
    failing = rules.where(~F.col("warns") & ~F.col("ord").isin(*dropped)).select(F.col("ord").alias("rule"))
    failed = fired.join(F.broadcast(failing), "rule", "left_semi").select("commit").distinct().withColumn("failed", F.lit(True))
    met = commits.join(failed, "commit", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    return rates(met.withColumn("view", F.lit("gate")), ["view"])


def swapped_rates(fired: DataFrame, refired: DataFrame, commits: DataFrame, rules: DataFrame) -> DataFrame:
    """For each replaced rule of refired (commit, rule: where it fires as replaced) the gate's rates with that rule
    replaced and all others as recorded, in one pass.

    What the others fail is counted once for each commit: a commit fails under a swap of rule r when another
    failing rule fired on it, or r fires as replaced."""
    failing = rules.where("not warns").select(F.col("ord").alias("rule"))
    f = fired.join(F.broadcast(failing), "rule", "left_semi").select("commit", "rule").distinct()
    per = f.groupBy("commit").agg(F.count("*").alias("n"))
    swaps = refired.select("rule").distinct()
    grid = commits.join(F.broadcast(swaps), F.lit(True))  # as many rows a commit as rules are replaced
    out = grid.join(per, "commit", "left").join(f.withColumn("own", F.lit(1)), ["commit", "rule"], "left").join(refired.select("commit", "rule").distinct().withColumn("again", F.lit(True)), ["commit", "rule"], "left")
    stays = rules.select(F.col("ord").alias("rule"), "warns")
    out = out.join(F.broadcast(stays), "rule")
    others = F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))
    return rates(out.withColumn("failed", (others > 0) | (F.coalesce("again", F.lit(False)) & ~F.col("warns"))), ["rule"])


def alone(fired: DataFrame, commits: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule's rates on the commits no other failing rule fired on."""
    f = fired.select("commit", "rule").distinct().join(F.broadcast(rules.select(F.col("ord").alias("rule"), "warns")), "rule")
    per = f.groupBy("commit").agg(F.count_if(~F.col("warns")).alias("n"))
    only = f.join(per, "commit").where(F.col("n") - F.when(F.col("warns"), 0).otherwise(1) == 0).select("commit", "rule", F.lit(True).alias("failed"))
    grid = commits.join(F.broadcast(rules.select(F.col("ord").alias("rule"))), F.lit(True)).join(only, ["commit", "rule"], "left")
    return rates(grid.withColumn("failed", F.coalesce("failed", F.lit(False))), ["rule"])


def judged(rows: DataFrame) -> DataFrame:
    """rule, commits: how many commits have a row that the rule judges. rows: commit, rule."""
    return rows.groupBy("rule").agg(F.count_distinct("commit").alias("commits"))


def missed(fired: DataFrame, commits: DataFrame, rules: DataFrame) -> DataFrame:
    """Blocked commits on which no failing rule fired."""
    failing = rules.where("not warns").select(F.col("ord").alias("rule"))
    return commits.where("block").join(fired.join(F.broadcast(failing), "rule", "left_semi"), "commit", "left_anti").select("commit")


def legacy(breaches: DataFrame, commits: DataFrame) -> DataFrame:
    """rule, fired and over by label: commits each rule with a max fired on, and those where every row it fired on
    was over the max at the parent already. breaches: commit, rule, max, base."""
    per = breaches.where("max is not null").groupBy("commit", "rule").agg(F.bool_and(F.coalesce(F.col("base") > F.col("max"), F.lit(False))).alias("over"))
    met = per.join(commits.select("commit", "block"), "commit")
    return met.groupBy("rule").agg(F.count_if("block").alias("block_fired"), F.count_if(~F.col("block")).alias("allow_fired"), F.count_if(F.col("block") & F.col("over")).alias("block_over"), F.count_if(~F.col("block") & F.col("over")).alias("allow_over"))


def size_rates(rows: DataFrame, commits: DataFrame, settings: list[int]) -> DataFrame:
    """Rates of the rule that fails a commit when a package row grows by more than a setting, for each setting: only
    a commit's largest growth matters. rows: commit, package, sloc_delta."""
    most = rows.where(F.col("package") != MODULE).groupBy("commit").agg(F.max("sloc_delta").alias("most"))
    met = commits.join(most, "commit", "left").select("block", "most", F.explode(F.array(*map(F.lit, settings))).alias("setting"))
    return rates(met.withColumn("failed", F.coalesce(F.col("most") > F.col("setting"), F.lit(False))), ["setting"])


def recheck(pairs: DataFrame) -> DataFrame:
    """checked, mismatched of (row, rule) pairs: recorded and refired, candidates and re-evaluated rules left out."""
    p = pairs.where("not candidate and not reevaluated")
    return p.agg(F.count("*").alias("checked"), F.count_if(F.col("recorded") != F.col("refired")).alias("mismatched"))


def pooled_counts(corpora: DataFrame) -> DataFrame:
    """name, block, allow, set_aside of each corpus and of all together (null name), in one pass."""
    return corpora.rollup("name").agg(F.count_if("block").alias("block"), F.count_if(~F.col("block")).alias("allow"), F.sum("set_aside").alias("set_aside"))


def youden(rows: DataFrame) -> Column:
    return share("block_failed", "blocks") - share("allow_failed", "allows")


def best_settings(points: DataFrame) -> DataFrame:
    """Each rule's setting with the highest J, then the fewest allows failed, then the least value."""
    w = Window.partitionBy("rule").orderBy(F.col("j").desc(), "allow_failed", "setting")
    return points.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
