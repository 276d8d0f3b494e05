"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become templates: numbers, names (capitalised words) and units of measure are replaced by typed
placeholders, all else is lower-cased and stripped of punctuation. Windows of `width` template tokens with
at least `literal` literal ones are hash-joined with those of the benchmark items. Beside them the windows of the
plain words in lower case are joined, however few are literal, so that a verbatim copy is caught in any case. Items
shorter than the width are looked for at their own length. Of the windows that meet,
the values behind the placeholders are compared: along one alignment of a document with an item each item
value must always stand for the same document value (the slots are consistent), so a re-parameterised
question is caught, while windows that only look alike in their literals are told apart.

The benchmark side is broadcast only up to `broadcast_rows` windows (counted first); beyond, the join is a
shuffle join. Nulls: a null or empty text has no windows. Repeated rows give equal rows; of alignments with as many
windows the earliest counts. Texts of any length are windowed whole. Columns besides doc_id, item_id and text are
ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class LeakParams:
    width: int = 8
    #: Literal tokens a window needs; windows of placeholders alone say nothing.
    literal: int = 5
    #: Share of consistent slots, and windows, for a document and an item to count as a leak.
    consistent: float = 0.8
    least_windows: int = 2
    broadcast_rows: int = 200_000


#: Units of measure that are no ordinary words, lower-case.
UNITS = "mm cm km mg kg ml px kb mb gb tb hz khz mhz ghz kw kj cal kcal mph kmh usd eur inch inches feet yard yards mile miles pound pounds ounce ounces meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees"
#: Placeholders; U+0001 can't come from a text, whose words hold letters, marks, digits and currency signs only.
NUM, NAME, UNIT = "\u0001n", "\u0001p", "\u0001u"


def spaced(text: Column) -> Column:
    """The words of a text, each after one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}%$€£]+", " ")))


def templated(words: Column) -> Column:
    """The spaced words with typed placeholders for numbers and names, the rest in lower case."""
    numbers = F.regexp_replace(words, r" [%$€£]*\p{N}[^ ]*", " " + NUM)
    return F.lower(F.regexp_replace(numbers, r" \p{Lu}\p{Ll}[^ ]*", " " + NAME))


def listed(words: Column) -> Column:
    return F.filter(F.split(F.substring(words, 2, 1 << 30), " "), lambda w: w != "")


def unit_or(token: Column) -> Column:
    """Units among a template's tokens become their placeholder."""
    return F.when(token.isin(*UNITS.split()), F.lit(UNIT)).otherwise(token)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later steps read instead of working it out again inside their lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def tokenized(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, own (the words) and tpl (the template's tokens) of each text."""
    out = _held(df.select(*keep, spaced(F.col(text)).alias("w")), "tpl", F.transform(listed(templated(F.col("w"))), unit_or))
    return out.select(*keep, listed(F.col("w")).alias("own"), "tpl")


def run_hashes(df: DataFrame, column: str, width: int, name: str) -> DataFrame:
    """Adds the hashes of every run of `width` of the column's hashes. A run is hashed from the hashes of two shorter
    ones, twice as long each time, so no run is ever copied out."""
    out, made, n = df.withColumn(f"{name}1", F.col(column)), f"{name}1", 1
    while n < width:
        step = min(n, width - n)
        pair = lambda h, i: F.xxhash64(h, F.get(F.col(made), i + step))  # noqa: B023,E731
        runs = F.transform(F.slice(F.col(made), F.lit(1), F.greatest(F.size(made) - step, F.lit(0))), pair)
        n += step
        out, made = _held(out, f"{name}{n}", runs), f"{name}{n}"
    return out.withColumn(name, F.col(made))


def windows(df: DataFrame, text: str, widths: list[int], keep: list[str]) -> DataFrame:
    """keep, at (from 1), window (hash) and plain of every window of the template, and of every window of the plain
    words in lower case that isn't the template's too. plain: it has no placeholder. Texts shorter than a width have
    none of it."""
    rows = _held(df.select(*keep, spaced(F.col(text)).alias("w")), "th", F.transform(listed(templated(F.col("w"))), lambda t: F.xxhash64(unit_or(t))))
    rows = _held(rows, "ph", F.transform(listed(F.lower("w")), lambda t: F.xxhash64(t))).select(*keep, "th", "ph")
    out = None
    for width in widths:
        made = run_hashes(run_hashes(rows.where(F.size("th") >= width), "th", width, "t"), "ph", width, "p").select(*keep, "t", "p")
        spot = lambda h, i, plain: F.struct((i + 1).alias("at"), h.alias("window"), plain.alias("plain"))
        first = F.transform("t", lambda h, i: spot(h, i, h == F.get("p", i)))
        other = F.filter(F.transform("p", lambda h, i: F.when(h != F.get("t", i), spot(h, i, F.lit(True)))), lambda x: x.isNotNull())
        part = made.select(*keep, F.explode(F.concat(first, other)).alias("x")).select(*keep, "x.at", "x.window", "x.plain")
        out = part if out is None else out.unionAll(part)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots, n_consistent of every document that holds an item's template.

    One row for each document and item, for the alignment with most windows (then the earliest).
    """
    p = params
    bench = tokenized(items.select("item_id", "text"), "text", ["item_id"])
    n = F.size("tpl")
    # items shorter than the width are looked for at their own length
    short = [r[0] for r in bench.where((n > 0) & (n < p.width)).select(n).distinct().collect()]  # fewer than the width
    sides = []
    for width in sorted({p.width, *short}):
        met = windows(items, "text", [width], ["item_id"]).join(bench.select("item_id", "tpl"), "item_id")
        literal = F.size(F.filter(F.slice("tpl", F.col("at"), width), lambda t: ~t.startswith("\u0001")))
        met = met.where((F.col("plain") | (literal >= p.literal)) & (n >= width) if width == p.width else n == width)
        sides.append(met.select("item_id", F.col("at").alias("item_at"), "window", (n - width + 1).alias("item_windows")))
    sides = reduce(DataFrame.unionAll, sides).distinct()
    few = sides.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    rows = windows(keyed, "text", sorted({p.width, *short}), ["doc_id", "k"]).drop("plain")
    hits = rows.join(F.broadcast(sides) if few else sides, "window")
    # a document's windows on one alignment with an item: no more than the item has
    lines = hits.groupBy("doc_id", "k", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("ats"), F.max("item_windows").alias("item_windows"))
    lines = lines.where(F.size("ats") >= F.least(F.lit(p.least_windows), F.col("item_windows")))
    # only the texts that met an item go on; their keys are broadcast while they are few
    lines = written(lines, "lines")
    named = lines.select(F.col("doc_id").alias("__i"), F.col("k").alias("__j")).distinct()
    named = F.broadcast(named) if lines.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows else named
    texts = keyed.select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), "text").join(named, (F.col("__k") == F.col("__j")) & F.col("__id").eqNullSafe(F.col("__i")), "left_semi").dropDuplicates(["__id", "__k"])
    met = lines.join(texts, (F.col("k") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id"))).join(bench, "item_id")
    met = _held(met.select("doc_id", "k", "item_id", "shift", "ats", "own", "tpl", spaced(F.col("text")).alias("w")), "theirs", listed(F.col("w")))
    met = met.withColumn("covered", F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, F.least(a + p.width - 1, F.size("tpl")))))))
    slots = F.filter("covered", lambda i: F.element_at("tpl", i.cast("int")).startswith("\u0001"))
    pairs = F.transform(slots, lambda i: F.struct(F.lower(F.element_at("own", i.cast("int"))).alias("mine"), F.lower(F.element_at("theirs", (i + F.col("shift")).cast("int"))).alias("yours")))
    met = _held(met.select("doc_id", "k", "item_id", "shift", F.size("ats").alias("n_windows"), pairs.alias("pairs")), "mine", F.array_distinct(F.transform("pairs", lambda x: x["mine"])))

    def agreed(v):
        """Most slots of item value v that stand for one document value."""
        theirs = F.transform(F.filter("pairs", lambda x: x["mine"] == v), lambda x: x["yours"])
        return F.array_max(F.transform(F.array_distinct(theirs), lambda y: F.size(F.filter(theirs, lambda z: z == y))))

    met = met.select("doc_id", "k", "item_id", "shift", "n_windows", F.size("pairs").alias("n_slots"), F.aggregate(F.transform("mine", agreed), F.lit(0), lambda a, x: a + x).alias("n_consistent"))
    met = met.where(F.col("n_consistent") >= F.col("n_slots") * p.consistent)
    best = met.groupBy("doc_id", "k", "item_id").agg(F.max(F.struct("n_windows", (-F.col("shift")).alias("early"), "n_slots", "n_consistent")).alias("m"))
    return best.groupBy("doc_id", "item_id").agg(F.max("m").alias("m")).select("doc_id", "item_id", F.col("m.n_windows").cast("long").alias("n_windows"), F.col("m.n_slots").cast("long").alias("n_slots"), F.col("m.n_consistent").cast("long").alias("n_consistent"))
