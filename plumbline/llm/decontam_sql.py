"""Decontamination as DuckDB SQL, for tables whose ids don't repeat."""

from __future__ import annotations

from .decontam import NAME, NUM, UNIT, UNITS, LeakParams


def leaks_sql(p: LeakParams = LeakParams()) -> str:
    def words(column: str) -> str:
        return f"(' ' || regexp_replace(coalesce({column}, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}%$€£]+', '  ', 'g') || ' ')"

    def template(w: str) -> str:
        numbers = f"regexp_replace({w}, ' [%$€£]*\\p{{N}}[^ ]*', ' {NUM}', 'g')"
        names = f"regexp_replace({numbers}, ' \\p{{Lu}}\\p{{Ll}}[^ ]*', ' {NAME}', 'g')"
        return f"regexp_replace(lower({names}), ' ({'|'.join(UNITS.split())}) ', ' {UNIT} ', 'g')"

    def parts(w: str) -> str:
        return f"list_filter(regexp_split_to_array({w}, ' +'), lambda x: x <> '')"

    k = p.width
    return f"""
WITH d0 AS (SELECT doc_id, {words('text')} AS w FROM documents),
d AS (SELECT doc_id, {parts('w')} AS own, {parts(template('w'))} AS tpl FROM d0),
i0 AS (SELECT item_id, {words('text')} AS w FROM benchmark),
i AS (SELECT item_id, {parts('w')} AS own, {parts(template('w'))} AS tpl FROM i0),
wd AS (SELECT DISTINCT least(len(tpl), {k}) AS wd FROM i WHERE len(tpl) > 0 UNION SELECT {k}),
dp AS (SELECT doc_id, tpl, list_transform(own, lambda x: lower(x)) AS low, wd, unnest(range(1, greatest(len(tpl) - wd + 1, 1) + 1)) AS pt FROM d, wd WHERE len(tpl) > 0),
dw AS (SELECT DISTINCT doc_id, pt, win FROM (SELECT doc_id, pt, array_to_string(list_slice(tpl, pt, pt + wd - 1), ' ') AS win FROM dp UNION ALL SELECT doc_id, pt, array_to_string(list_slice(low, pt, pt + wd - 1), ' ') FROM dp)),
ip AS (SELECT item_id, tpl, list_transform(own, lambda x: lower(x)) AS low, least(len(tpl), {k}) AS wd, unnest(range(1, len(tpl) - least(len(tpl), {k}) + 2)) AS pt FROM i WHERE len(tpl) > 0),
iw AS (SELECT DISTINCT item_id, pt, win, n FROM (SELECT item_id, pt, array_to_string(list_slice(tpl, pt, pt + wd - 1), ' ') AS win, len(tpl) - wd + 1 AS n FROM ip WHERE wd < {k} OR len(list_filter(list_slice(tpl, pt, pt + wd - 1), lambda x: NOT starts_with(x, chr(1)))) >= {p.literal}
  UNION ALL SELECT item_id, pt, array_to_string(list_slice(low, pt, pt + wd - 1), ' '), len(tpl) - wd + 1 FROM ip)),
l AS (SELECT doc_id, item_id, dw.pt - iw.pt AS shift, list(DISTINCT iw.pt) AS ats, max(n) AS n FROM dw JOIN iw USING (win) GROUP BY ALL HAVING len(list(DISTINCT iw.pt)) >= least({p.least_windows}, max(n))),
s AS (SELECT DISTINCT doc_id, item_id, shift, len(ats) AS n_windows, unnest(list_distinct(flatten(list_transform(ats, lambda a: range(a, least(a + {k - 1}, len(i.tpl)) + 1))))) AS pos FROM l JOIN i USING (item_id)),
v AS (SELECT s.doc_id, s.item_id, s.shift, n_windows, lower(i.own[pos]) AS mine, lower(d.own[pos + shift]) AS yours, count(*) AS c FROM s JOIN i USING (item_id) JOIN d USING (doc_id) WHERE starts_with(i.tpl[pos], chr(1)) GROUP BY ALL),
a AS (SELECT doc_id, item_id, shift, sum(t) AS n_slots, sum(m) AS n_consistent FROM (SELECT doc_id, item_id, shift, mine, sum(c) AS t, max(c) AS m FROM v GROUP BY ALL) GROUP BY ALL),
r AS (SELECT l.doc_id, l.item_id, l.shift, len(ats) AS n_windows, coalesce(n_slots, 0) AS n_slots, coalesce(n_consistent, 0) AS n_consistent FROM l LEFT JOIN a USING (doc_id, item_id, shift))
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_slots AS BIGINT) AS n_slots, CAST(n_consistent AS BIGINT) AS n_consistent
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, shift) AS k FROM r WHERE n_consistent >= n_slots * {p.consistent}) WHERE k = 1
"""
