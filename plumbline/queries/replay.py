"""Labels from a replay: orders are commits, line items what they touched."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import labels as L
from plumbline.queries.registry import registry
from plumbline.sources.host import table

QUERIES, SQL, query = registry()
WINDOW = 20

_COMMIT = ["o_orderkey AS seq", "md5(CAST(o_orderkey AS {string})) AS hash", "CASE WHEN o_orderkey % 9 = 0 THEN ' Fixes #' || o_orderkey WHEN o_orderkey % 9 = 4 THEN 'Revert \"S' || (o_custkey % 80) || '\" (#3)' WHEN o_orderkey % 9 = 5 THEN 'fixture' ELSE 'S' || (o_orderkey % 80) END AS subject", "CASE WHEN o_orderkey % 13 = 5 THEN 'x. This reverts commit ' || substr(md5(CAST(o_custkey AS {string})), 1, 10) || ', and this reverts commit abc' END AS body"]
_TOUCH = ["l_orderkey AS seq", "'f' || (l_partkey % 300) AS function"]
_C = f"""WITH c AS (SELECT {', '.join(x.replace('{string}', 'VARCHAR') for x in _COMMIT)} FROM orders),
t AS (SELECT DISTINCT {', '.join(_TOUCH)} FROM lineitem),
fx AS (SELECT t.* FROM t JOIN c USING (seq) WHERE regexp_matches(lower(trim(subject)), '^\\s*(fix|revert)(s|es|ed|ing|up)?([^a-z]|$)')),
p AS (SELECT a.seq, b.seq AS next, string_agg(a.function, ', ' ORDER BY a.function) AS functions FROM t a JOIN fx b ON a.function = b.function AND b.seq > a.seq AND b.seq <= a.seq + {WINDOW} GROUP BY ALL),
fix AS (SELECT seq, min(next) AS next, arg_min(functions, next) AS functions FROM p GROUP BY seq),
n AS (SELECT seq AS place, hash AS reverter, unnest(regexp_extract_all(lower(coalesce(body, '')), 'this reverts commit ([0-9a-f]{{7,}})', 1)) AS named FROM c),
bh AS (SELECT place, reverter, named, arg_min(c.seq, (c.hash <> named, c.seq)) AS seq FROM n JOIN c ON substr(named, 1, 7) = substr(c.hash, 1, 7) AND starts_with(c.hash, named) GROUP BY ALL),
bs AS (SELECT a.seq AS place, a.hash AS reverter, max(b.seq) AS seq FROM (SELECT *, regexp_extract(subject, '^Revert "(.*)"', 1) AS inner_subject FROM c WHERE subject LIKE 'Revert "%') a JOIN c b ON b.subject = a.inner_subject AND b.seq < a.seq GROUP BY ALL),
rv AS (SELECT x.seq, arg_min(reverter, place) AS reverter FROM (SELECT place, reverter, seq FROM bh UNION ALL SELECT place, reverter, seq FROM bs) x JOIN c USING (seq) WHERE c.hash <> x.reverter GROUP BY x.seq)
"""


def _commits(spark, d):
    return table(spark, d, "orders").selectExpr(*[x.replace("{string}", "STRING") for x in _COMMIT])


def _touched(spark, d):
    return table(spark, d, "lineitem").selectExpr(*_TOUCH)


@query(_C + "SELECT * FROM fix")
def j20_fixups(spark, d):
    """The first later fix that touched a function the commit touched."""
    return L.fixups(_commits(spark, d), _touched(spark, d), WINDOW).select("seq", "next", F.array_join("functions", ", ").alias("functions"))


@query(_C + "SELECT * FROM rv")
def j21_reverts(spark, d):
    """What each revert undoes: by hash or its beginning, else the latest commit with the subject."""
    c = _commits(spark, d)
    return L.reverts(c.select("seq", "hash", "subject"), c.select(F.col("seq").alias("place"), "hash", "subject", "body"))


@query(
    _C
    + f"""SELECT c.seq, CASE WHEN rv.reverter IS NULL AND fix.next IS NULL THEN 'allow' ELSE 'block' END AS verdict,
concat_ws(',', CASE WHEN rv.reverter IS NOT NULL THEN 'revert' END, CASE WHEN fix.next IS NOT NULL THEN 'fixup' END) AS parts,
CASE WHEN rv.reverter IS NOT NULL OR fix.next IS NOT NULL THEN concat_ws('; ', CASE WHEN rv.reverter IS NOT NULL THEN 'reverted by ' || substr(rv.reverter, 1, 12) || ' ("' || rc.subject || '")' END, CASE WHEN fix.next IS NOT NULL THEN fix.functions || ' changed again ' || (fix.next - c.seq) || ' commits later by ' || substr(fc.hash, 1, 12) || ' ("' || fc.subject || '")' END)
WHEN k.n IS NULL THEN 'not reverted; it changed no function, so no fix-up is looked for'
ELSE 'not reverted; no fix or revert within the next {WINDOW} commits changed a function it changed (' || k.n || ')' || CASE WHEN (SELECT max(seq) FROM c) - c.seq < {WINDOW} THEN ' (window cut short by the end of the range: ' || ((SELECT max(seq) FROM c) - c.seq) || ' of {WINDOW} commits)' ELSE '' END END AS reason
FROM c LEFT JOIN rv ON rv.seq = c.seq LEFT JOIN c rc ON rc.hash = rv.reverter LEFT JOIN fix ON fix.seq = c.seq LEFT JOIN c fc ON fc.seq = fix.next LEFT JOIN (SELECT seq, count(*) AS n FROM t GROUP BY seq) k ON k.seq = c.seq"""
)
def c11_decided(spark, d):
    """C11: the verdict of every commit, with its evidence and reason."""
    c = _commits(spark, d)
    out = L.decided(c.select("seq", "hash", "subject"), _touched(spark, d), c.select(F.col("seq").alias("place"), "hash", "subject", "body"), WINDOW)
    return out.select("seq", "verdict", F.array_join("parts", ",").alias("parts"), "reason")


_EV = ["l_linenumber % 3 AS module", "l_suppkey AS package", "l_orderkey AS seq", "CAST(sum(l_quantity) AS BIGINT) * 10 AS head", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(sum(l_partkey % 500) AS BIGINT) END AS base", "count(*) FILTER (WHERE l_returnflag = 'R') AS dup_head", "CAST(sum(l_linenumber) AS BIGINT) % 4 AS dup_base"]
_S = f"""WITH g AS (SELECT {', '.join(_EV)} FROM lineitem GROUP BY l_linenumber % 3, l_suppkey, l_orderkey),
e AS (SELECT module, package, seq, CASE WHEN seq % 17 = 3 THEN NULL ELSE base END AS base, CASE WHEN seq % 17 = 3 THEN 0 ELSE head END AS head, seq % 17 = 3 AS deleted FROM g),
b AS (SELECT *, CASE WHEN NOT deleted THEN coalesce(base, 0) ELSE coalesce(lag(head) OVER (PARTITION BY module, package ORDER BY seq), 0) END AS before FROM e),
cm AS (SELECT DISTINCT module, seq FROM e),
f1 AS (SELECT module, package, arg_min(before, seq) AS first FROM b GROUP BY ALL),
grid AS (SELECT cm.module, cm.seq, f1.package, f1.first FROM cm JOIN f1 USING (module)),
st AS (SELECT grid.*, p.head AS past FROM grid ASOF LEFT JOIN b p ON p.module = grid.module AND p.package = grid.package AND grid.seq > p.seq),
tot AS (SELECT st.module, st.seq, CAST(sum(coalesce(o.before, st.past, st.first)) AS BIGINT) AS total, CAST(coalesce(sum(o.before - o.head), 0) AS BIGINT) AS fall FROM st LEFT JOIN b o ON o.module = st.module AND o.package = st.package AND o.seq = st.seq GROUP BY ALL),
sp AS (SELECT b.module, b.package, b.seq, b.before, b.head FROM b JOIN tot USING (module, seq) WHERE (deleted OR base IS NOT NULL) AND before > 0 AND before - b.head >= 0.25 * before AND (total <= 0 OR tot.fall < 0.05 * total)),
gr AS (SELECT module, seq, package, NOT coalesce(base > 900, false) AND head > 900 AS crossed FROM e WHERE NOT deleted AND ((NOT coalesce(base > 900, false) AND head > 900) OR (coalesce(base > 900, false) AND head - base >= 100)))
"""


def _events(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.expr("l_linenumber % 3").alias("module"), F.col("l_suppkey").alias("package"), F.col("l_orderkey").alias("seq")).agg(*[F.expr(x) for x in _EV[3:4]], F.expr("CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(sum(l_partkey % 500) AS BIGINT) END AS base"), *[F.expr(x) for x in _EV[5:]])
    gone = "seq % 17 = 3"
    return g, L.timeline(g.where(f"not ({gone})"), g.where(gone))


@query(_S + "SELECT * FROM tot")
def r15_module_totals(spark, d):
    """The module's total before each commit, every package carried from its nearest row."""
    _, events = _events(spark, d)
    return L.module_totals(events, events)


@query(_S + "SELECT * FROM sp")
def j22_splits(spark, d):
    """Commits that cut a package by a quarter while the module kept its code."""
    _, events = _events(spark, d)
    return L.splits(events, L.module_totals(events, events))


@query(_S + f"SELECT gr.module, gr.seq, arg_min(gr.package, (sp.seq, gr.package)) AS package, min(sp.seq) AS by FROM gr JOIN sp ON sp.module = gr.module AND sp.package = gr.package AND sp.seq > gr.seq AND sp.seq <= gr.seq + 3000 GROUP BY ALL")
def c11_split_labels(spark, d):
    """The first later commit that split a package which this one grew past its ceiling."""
    _, events = _events(spark, d)
    rows = events.where("not deleted").withColumn("value", F.col("head").cast("double")).withColumn("base_value", F.col("base").cast("double"))
    grown = L.grown_packages(rows, 900.0).withColumn("ord", F.col("package"))
    return L.first_undone(grown, L.splits(events, L.module_totals(events, events)), 3000)


@query(_S + "SELECT a.module, a.seq, arg_min(a.package, (r.seq, a.package)) AS package, min(r.seq) AS by FROM (SELECT *, dup_head - dup_base AS n FROM g WHERE dup_head > dup_base) a JOIN (SELECT *, dup_base - dup_head AS removed FROM g WHERE seq % 2 = 0 AND base IS NOT NULL AND (base <= 0 OR base - head < 0.25 * base)) r ON r.module = a.module AND r.package = a.package AND r.seq > a.seq AND r.seq <= a.seq + 3000 AND r.removed >= a.n GROUP BY ALL")
def c11_extract_labels(spark, d):
    """The first later commit that removed as many duplicate blocks as this one added."""
    g, _ = _events(spark, d)
    added = g.where("dup_head > dup_base").select("module", "seq", F.col("package").alias("ord"), "package", (F.col("dup_head") - F.col("dup_base")).alias("n"))
    rows = g.where("base is not null").select("module", "seq", "package", (F.col("dup_base") - F.col("dup_head")).alias("removed"), F.col("base").alias("before"), (F.col("base") - F.col("head")).alias("fall"), (F.col("seq") % 2 == 0).alias("touched"))
    return L.extractions(added, rows, 3000)


_H = ["l_orderkey AS seq", "'x' || (l_suppkey % 5) AS file", "CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'old' END AS side", "CAST(l_partkey % 400 AS BIGINT) AS first", "CAST(l_partkey % 400 + CAST(l_quantity AS BIGINT) - 3 AS BIGINT) AS last"]
_D = ["p_partkey % 400 * 30 AS lo", "'g' || p_partkey AS function", "p_size + 2 AS size"]


@query(
    f"""WITH h AS (SELECT {', '.join(_H)} FROM lineitem), dl AS (SELECT seq, file, side, 'g' || k AS function, k * 37 AS a, k * 37 + 20 AS b FROM (SELECT DISTINCT seq, file, side FROM h), range(12) r(k))
SELECT DISTINCT h.seq, function FROM h JOIN dl USING (seq, file, side) WHERE last >= first AND first <= b AND last >= a"""
)
def r5_touched_functions(spark, d):
    """The declarations that hold a line of a commit's diff, on either side."""
    h = table(spark, d, "lineitem").selectExpr(*_H)
    k = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")
    decl = h.select("seq", "file", "side").distinct().select("*", k).selectExpr("seq", "file", "side", "'g' || k AS function", "k * 37 AS from_line", "k * 37 + 20 AS to_line")
    return L.touched_functions(h, decl)


_LAB = ["CASE WHEN doc_id % 50 = 7 THEN doc_id - 1 ELSE doc_id END AS hash", "doc_id AS ord", "CASE WHEN toxic = 1 THEN 'block' WHEN doc_id % 31 = 0 THEN 'maybe' ELSE 'allow' END AS verdict", "CASE WHEN doc_id % 29 = 0 THEN '' ELSE 'why' END AS reason", "CASE WHEN doc_id % 37 = 0 THEN 'guessed' ELSE 'rule' END AS provenance"]


@query(
    f"""WITH l AS (SELECT {', '.join(_LAB)}, CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 22 = 0 THEN 'revert' ELSE 'other' END END AS part FROM labels), r AS (SELECT doc_id AS hash FROM documents WHERE doc_id % 3 <> 1)
SELECT hash, problem FROM (SELECT hash, 'verdict is not block or allow' AS problem FROM l WHERE verdict NOT IN ('block', 'allow') UNION ALL SELECT hash, 'no reason' FROM l WHERE reason = '' UNION ALL SELECT hash, 'unknown provenance' FROM l WHERE provenance <> 'rule'
UNION ALL SELECT hash, 'evidence on a label that doesn''t block' FROM l WHERE part IS NOT NULL AND verdict <> 'block' UNION ALL SELECT hash, 'evidence of an unknown part or without its commit' FROM l WHERE part = 'other'
UNION ALL SELECT hash, 'labelled twice' FROM l GROUP BY hash HAVING count(*) > 1 UNION ALL SELECT DISTINCT hash, 'not replayed' FROM l WHERE hash NOT IN (SELECT hash FROM r) UNION ALL SELECT hash, 'no label' FROM r WHERE hash NOT IN (SELECT hash FROM l))"""
)
def r16_label_problems(spark, d):
    """Every way a labels table fails to label exactly what was replayed."""
    part = F.expr("CASE WHEN doc_id % 11 = 0 THEN array(struct(CASE WHEN doc_id % 22 = 0 THEN 'revert' ELSE 'other' END AS part, 'c' AS by)) ELSE array() END").cast("array<struct<part: string, by: string>>")
    labels = table(spark, d, "labels").select(*[F.expr(x) for x in _LAB], part.alias("fired"))
    return L.label_problems(labels, table(spark, d, "documents").where("doc_id % 3 <> 1").selectExpr("doc_id AS hash"))
