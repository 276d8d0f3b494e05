"""Labels from a replay's facts: fix-ups, reverts, splits and extractions, and what a labels table must satisfy.

Look-aheads are equality joins on the thing touched and on slots of the window's length; latest-earlier lookups are
sorts; nothing compares all commits with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.matching import as_of

#: What makes a subject a fix, a message or subject a revert.
FIX = r"^\s*(fix|revert)(s|es|ed|ing|up)?([^a-z]|$)"
REVERTS = r"this reverts commit ([0-9a-f]{7,})"
REVERT_SUBJECT = r'(?s)^Revert "(.*)"'


def is_fix(subject: Column) -> Column:
    return F.lower(F.trim(subject)).rlike(FIX)


def reverted_hashes(body: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(REVERTS), F.lit(1))


def reverted_subject(subject: Column) -> Column:
    return F.when(subject.rlike(REVERT_SUBJECT), F.regexp_extract(subject, REVERT_SUBJECT, 1))


def functions_of(touched: DataFrame) -> DataFrame:
    """seq, functions: what each commit touched, each once."""
    return touched.groupBy("seq").agg(F.collect_set("function").alias("functions"))


def fixups(commits: DataFrame, touched: DataFrame, window: int) -> DataFrame:
    """seq, next, functions: for each commit the first of the next `window` whose subject is a fix or revert and
    that touched a function it touched, with the shared functions in order.

    commits: seq, subject. touched: seq, function. A fix stands in its own slot and the one before. The functions of a
    commit are one row, so that one shuffle both counts each once and finds the fixes."""
    known = functions_of(touched).join(commits.select("seq", is_fix(F.col("subject")).alias("fix")), "seq", "left")
    each = known.select("seq", "fix", F.explode("functions").alias("function"), F.floor(F.col("seq") / window).alias("slot"))
    early = each.select("seq", "function", "slot")
    late = each.where("fix").select("function", F.col("seq").alias("next"), F.explode(F.array("slot", F.col("slot") - 1)).alias("slot"))
    met = early.join(late, ["function", "slot"]).where((F.col("next") > F.col("seq")) & (F.col("next") <= F.col("seq") + window))
    pairs = met.groupBy("seq", "next").agg(F.array_sort(F.collect_set("function")).alias("functions"))
    return pairs.groupBy("seq").agg(F.min_by(F.struct("next", "functions"), "next").alias("m")).select("seq", "m.*")


def reverts(commits: DataFrame, messages: DataFrame) -> DataFrame:
    """seq, reverter: each reverted commit with the first message that reverted it.

    commits: seq, hash, subject, the first-parent commits in order. messages: place, hash, subject, body, every
    commit parents first. A named hash is the commit of that hash, or the first that begins with it; a quoted
    subject is the latest commit with it whose own message comes before. A commit doesn't revert itself."""
    named = messages.select("place", F.col("hash").alias("reverter"), F.explode(reverted_hashes(F.col("body"))).alias("named"))
    near = named.join(commits.select("seq", "hash", F.substring("hash", 1, 7).alias("head7")), F.substring("named", 1, 7) == F.col("head7")).where(F.col("hash").startswith(F.col("named")))
    by_hash = near.groupBy("place", "reverter", "named").agg(F.min_by(F.struct("seq", "hash"), F.struct(F.col("hash") != F.col("named"), F.col("seq"))).alias("c")).select("place", "reverter", "c.seq", "c.hash")
    # a commit's subject is known from its own message on
    known = commits.select("seq", F.col("hash"), "subject").join(messages.select("hash", "place"), "hash")
    facts = known.select("subject", F.col("place").alias("at"), F.struct("seq", "hash").alias("c"))
    asked = messages.select("place", F.col("hash").alias("reverter"), reverted_subject(F.col("subject")).alias("subject")).where("subject is not null")
    met = as_of(asked.withColumnRenamed("place", "seq"), facts.withColumnRenamed("at", "seq"), ["subject"], "c").where("c is not null")
    by_subject = met.select(F.col("seq").alias("place"), "reverter", "c.seq", "c.hash")
    every = by_hash.unionByName(by_subject).where("hash <> reverter")
    return every.groupBy("seq").agg(F.min_by("reverter", "place").alias("reverter"))


def decided(commits: DataFrame, touched: DataFrame, messages: DataFrame, window: int) -> DataFrame:
    """hash, verdict, parts, reason of every commit under the rule: block when a later commit reverts it or fixes a
    function it touched, otherwise allow."""
    f = fixups(commits, touched, window).join(commits.select(F.col("seq").alias("next"), F.col("hash").alias("fix_hash"), F.col("subject").alias("fix_subject")), "next")
    r = reverts(commits, messages).join(messages.select(F.col("hash").alias("reverter"), F.col("subject").alias("reverter_subject")), "reverter")
    n = functions_of(touched).select("seq", F.size("functions").alias("n"))
    last = commits.agg(F.max("seq").alias("last"))
    met = commits.join(f, "seq", "left").join(r, "seq", "left").join(n, "seq", "left").join(F.broadcast(last), F.lit(True))  # one row
    reverted = F.when(F.col("reverter").isNotNull(), F.concat(F.lit("reverted by "), F.substring("reverter", 1, 12), F.lit(' ("'), F.col("reverter_subject"), F.lit('")')))
    fixed = F.when(F.col("next").isNotNull(), F.concat(F.array_join("functions", ", "), F.lit(" changed again "), (F.col("next") - F.col("seq")).cast("string"), F.lit(" commits later by "), F.substring("fix_hash", 1, 12), F.lit(' ("'), F.col("fix_subject"), F.lit('")')))
    later = F.col("last") - F.col("seq")
    cut = F.when(later < window, F.concat(F.lit(" (window cut short by the end of the range: "), later.cast("string"), F.lit(f" of {window} commits)"))).otherwise("")
    allowed = F.when(F.col("n").isNull(), F.lit("not reverted; it changed no function, so no fix-up is looked for")).otherwise(
        F.concat(F.lit(f"not reverted; no fix or revert within the next {window} commits changed a function it changed ("), F.col("n").cast("string"), F.lit(")"), cut)
    )
    parts = F.array_compact(F.array(F.when(F.col("reverter").isNotNull(), F.lit("revert")), F.when(F.col("next").isNotNull(), F.lit("fixup"))))
    block = F.size(parts) > 0
    return met.select("seq", "hash", F.when(block, "block").otherwise("allow").alias("verdict"), parts.alias("parts"), F.when(block, F.concat_ws("; ", reverted, fixed)).otherwise(allowed).alias("reason"))


def touched_functions(hunks: DataFrame, declarations: DataFrame) -> DataFrame:
    """seq, function: functions of which a diff hunk touches a line, on either side.

    hunks: seq, file, side, first, last (inclusive; last < first touches nothing). declarations: seq, file, side,
    function, from_line, to_line. A hunk meets the declarations of its own file in its own commit and no others, so both
    sides are shuffled once as they are, and declarations that lie by these columns already aren't."""
    h = hunks.where("last >= first").select("seq", "file", "side", "first", "last")
    d = declarations.where("to_line >= from_line").select("seq", "file", "side", "function", "from_line", "to_line")
    return h.join(d.hint("merge"), ["seq", "file", "side"]).where("first <= to_line and last >= from_line").select("seq", "function").distinct()


def timeline(rows: DataFrame, deletions: DataFrame) -> DataFrame:
    """module, package, seq, base, head, deleted: a package's rows and deletions (head 0), in one table."""
    r = rows.select("module", "package", "seq", "base", "head", F.lit(False).alias("deleted"))
    gone = deletions.select("module", "package", "seq", F.lit(None).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("head"), F.lit(True).alias("deleted"))
    return r.unionByName(gone)


def sloc_before(events: DataFrame) -> DataFrame:
    """Adds `before` to a timeline: a row's own base (0 if new); for a deletion the head of the event before it, or 0."""
    w = Window.partitionBy("module", "package").orderBy("seq")
    return events.withColumn("before", F.when(~F.col("deleted"), F.coalesce("base", F.lit(0))).otherwise(F.coalesce(F.lag("head").over(w), F.lit(0))))


def module_totals(events: DataFrame, commits: DataFrame) -> DataFrame:
    """module, seq, total, fall: the sum over all packages of their sloc before the commit, each carried from its
    nearest row, and how much of it the commit removed.

    Each event changes the running sum at its commit and after it, so one sort by commit does it: no package is
    expanded over commits. A module's commits are one window partition: one row for each commit."""
    w = Window.partitionBy("module", "package").orderBy("seq")
    rows = sloc_before(events).withColumn("earlier", F.lag("head").over(w))
    start = rows.where("earlier is null").groupBy("module").agg(F.sum("before").alias("start"))
    # before its first event a package counts as that event's `before`
    at = rows.select("module", "seq", (F.col("before") - F.coalesce("earlier", F.col("before"))).alias("now"), (F.col("head") - F.col("before")).alias("then"), (F.col("before") - F.col("head")).alias("fall"))
    steps = at.groupBy("module", "seq").agg(F.sum("now").alias("now"), F.sum("then").alias("then"), F.sum("fall").alias("fall"))
    every = commits.select("module", "seq").distinct().join(steps, ["module", "seq"], "left").join(F.broadcast(start), "module", "left").fillna(0, ["now", "then", "fall", "start"])
    order = Window.partitionBy("module").orderBy("seq")
    past = F.coalesce(F.sum(F.col("now") + F.col("then")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return every.select("module", "seq", (F.col("start") + past + F.col("now")).alias("total"), "fall")


def below(fall: Column, total: Column, share: float) -> Column:
    """Less than a share of the total fell; of nothing, nothing falls."""
    return (total <= 0) | (fall < total * share)


def splits(events: DataFrame, totals: DataFrame, cut: float = 0.25, moved: float = 0.05) -> DataFrame:
    """module, package, seq where a commit cut a package by `cut` or more while the module fell by less than `moved`.
    A new row (no base) is no split."""
    rows = sloc_before(events).where("(deleted or base is not null) and before > 0 and before - head >= %s * before" % cut)
    met = rows.drop("base").join(totals, ["module", "seq"])
    return met.where(below(F.col("fall"), F.col("total"), moved)).select("module", "package", "seq", "before", "head")


def first_undone(grown: DataFrame, undone: DataFrame, window: int) -> DataFrame:
    """module, seq, package, by: for each commit that grew packages (module, seq, ord, package) the first of the next
    `window` that undid one (module, package, seq), and of that commit's the first by ord."""
    g = grown.withColumn("slot", F.explode(F.array(F.floor(F.col("seq") / window), F.floor(F.col("seq") / window) + 1)))
    u = undone.select("module", "package", F.col("seq").alias("by"), F.floor(F.col("seq") / window).alias("slot"))
    met = g.join(u, ["module", "package", "slot"]).where((F.col("by") > F.col("seq")) & (F.col("by") <= F.col("seq") + window))
    return met.groupBy("module", "seq").agg(F.min_by("package", F.struct("by", "ord")).alias("package"), F.min("by").alias("by"))


def extractions(added: DataFrame, rows: DataFrame, window: int, keep: float = 0.25) -> DataFrame:
    """module, seq, package, by: the first later commit within the window that touched the package, removed as many
    duplicate blocks there as the commit added, and kept all but `keep` of its code.

    added: module, seq, ord, package, n. rows: module, seq, package, removed, before, fall, touched."""
    g = added.withColumn("slot", F.explode(F.array(F.floor(F.col("seq") / window), F.floor(F.col("seq") / window) + 1)))
    u = rows.where(F.col("touched") & below(F.col("fall"), F.col("before"), keep)).select("module", "package", F.col("seq").alias("by"), "removed", F.floor(F.col("seq") / window).alias("slot"))
    met = g.join(u, ["module", "package", "slot"]).where((F.col("by") > F.col("seq")) & (F.col("by") <= F.col("seq") + window) & (F.col("removed") >= F.col("n")))
    return met.groupBy("module", "seq").agg(F.min_by("package", F.struct("by", "ord")).alias("package"), F.min("by").alias("by"))


def grown_packages(rows: DataFrame, limit: float, grow_over: int = 100) -> DataFrame:
    """module, seq, package, crossed of rows (base, head, value, base_value, ...) that crossed the limit of a
    capacity metric, or grew by `grow_over` while over it at the parent."""
    over = F.col("base").isNotNull() & (F.coalesce("base_value", F.lit(0.0)) > limit)
    crossed = ~over & (F.col("value") > limit)
    grew = over & (F.col("head") - F.coalesce("base", F.lit(0)) >= grow_over)
    return rows.where(crossed | grew).select("module", "seq", "package", crossed.alias("crossed"))


VERDICTS, PROVENANCES, PARTS = ("block", "allow"), ("proposed", "confirmed", "rule"), ("revert", "fixup", "split", "extract")


def label_problems(labels: DataFrame, replayed: DataFrame) -> DataFrame:
    """hash, problem of every way labels fail to label exactly the replayed commits.

    labels: hash, ord, verdict, reason, provenance, fired (array of struct part, by). replayed: hash."""
    twice = labels.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", F.lit("labelled twice").alias("problem"))
    unknown = labels.select("hash").distinct().join(replayed.select("hash").distinct(), "hash", "left_anti").select("hash", F.lit("not replayed").alias("problem"))
    missing = replayed.select("hash").distinct().join(labels.select("hash"), "hash", "left_anti").select("hash", F.lit("no label").alias("problem"))
    bad_part = F.exists(F.coalesce("fired", F.array().cast(labels.schema["fired"].dataType)), lambda e: ~e["part"].isin(*PARTS) | (F.coalesce(e["by"], F.lit("")) == ""))
    tests = [
        (~F.col("verdict").isin(*VERDICTS), "verdict is not block or allow"),
        (F.coalesce("reason", F.lit("")) == "", "no reason"),
        (~F.col("provenance").isin(*PROVENANCES), "unknown provenance"),
        ((F.size("fired") > 0) & (F.col("verdict") != "block"), "evidence on a label that doesn't block"),
        (bad_part, "evidence of an unknown part or without its commit"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(m)) for t, m in tests]))
    return labels.select("hash", F.explode(found).alias("problem")).unionByName(twice).unionByName(unknown).unionByName(missing)
