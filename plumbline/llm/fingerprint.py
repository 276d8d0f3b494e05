"""Canonical exact fingerprints, in DataFrame operations only.

Canonical form: Unicode NFKC, full case folding, every run of white space one space, ends trimmed. The fingerprint
is four seeded 64-bit xxhashes of it in hex. Documents whose hashes are equal are compared byte by byte
inside their bucket; where bytes differ after all, the bucket's fingerprints get the SHA-256 of the canonical
form appended, so equal fingerprints always mean equal canonical text.

Nulls: a null text is empty; a null doc_id sorts last. Repeated rows have equal fingerprints. A single
document is its own next document. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SEEDS = (11, 23, 37, 53)
#: Buckets of equal hashes are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_BUCKETS = 300_000


def canonical(text: Column) -> Column:
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), canon)), 16, "0") for s in SEEDS]))


def _with_hash(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the wide hash; the canonical form is worked out once for its four parts."""
    return df.withColumn("__c", F.explode(F.array(canonical(F.col(text))))).withColumn(name, wide_hash(F.col("__c"))).drop("__c")


def collided(docs: DataFrame, text: str = "text") -> DataFrame:
    """Wide hashes under which documents with different canonical bytes stand (none are expected)."""
    hashes = _with_hash(docs.select(text), text, "h").select("h")
    twice = written(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("h2")), "buckets")
    few = twice.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    canon = docs.select(F.explode(F.array(canonical(F.col(text)))).alias("c")).withColumn("h", wide_hash(F.col("c")))
    same = canon.join(F.broadcast(twice) if few else twice, F.col("h") == F.col("h2"))
    return same.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")


def with_next(keyed: DataFrame) -> DataFrame:
    """For rows (doc_id, k, n): the row after each in descending doc_id (after the last the first).

    Returns doc_id, k, place, and to_id, to_k, to_n, to_place of the row before it, which takes its text. The order comes from
    a distributed sort; only each partition's first and last place come to the driver.
    """
    spark = keyed.sparkSession
    ranked = written(keyed.orderBy(F.col("doc_id").desc_nulls_last(), "k").withColumn("place", F.monotonically_increasing_id()), "order")
    ends = sorted((r[0], r[1]) for r in ranked.groupBy(F.shiftright("place", 33).alias("part")).agg(F.min("place"), F.max("place")).select("min(place)", "max(place)").collect())
    jump = [(ends[i][1], ends[(i + 1) % len(ends)][0]) for i in range(len(ends))]
    jumps = F.broadcast(spark.createDataFrame(jump, "last long, first long"))
    stepped = ranked.join(jumps, F.col("place") == F.col("last"), "left").select(F.col("doc_id").alias("to_id"), F.col("k").alias("to_k"), F.col("n").alias("to_n"), F.col("place").alias("to_place"), F.coalesce("first", F.col("place") + 1).alias("place"))
    return ranked.join(stepped, "place").select("doc_id", "k", "place", "to_id", "to_k", "to_n", "to_place")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    order = written(with_next(base.select("doc_id", "k", F.length("text").cast("long").alias("n"))), "next")
    hashed = _with_hash(base, "text", "fp")
    # rows that repeat id and text: one text for them all, and each by its place
    again = not order.groupBy("doc_id", "k").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    one = hashed.dropDuplicates(["doc_id", "k"]) if again else hashed
    key = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    order = order.select(F.col("doc_id").alias("id2"), F.col("k").alias("k2"), "place", "to_id", "to_k", "to_n", "to_place")
    met = one.join(order, key("k", "k2") & key("doc_id", "id2"))
    n, half = F.length("text").cast("long"), lambda c: F.floor(c / 2).cast("int")
    own = met.select("doc_id", "k", "place", "fp", n.alias("n_chars"), F.substr("text", F.lit(1), (n - half(n)).cast("int")).alias("kept"))
    given = met.select("to_id", "to_k", "to_place", F.col("doc_id").alias("next_id"), F.col("k").alias("next_k"), F.col("fp").alias("next_fp"), F.substr("text", F.lit(1), half(F.col("to_n"))).alias("given"))
    # without repeats the texts already lie by their key, which spares a shuffle
    same = F.col("place") == F.col("to_place") if again else key("k", "to_k") & key("doc_id", "to_id")
    both = own.join(given, same).select("doc_id", "k", "n_chars", "fp", "next_id", "next_k", "next_fp", F.concat("kept", "given").alias("edited"))
    out = _with_hash(both, "edited", "efp")
    clash = collided(base)
    if not clash.isEmpty():
        out = _told_apart(out, base, clash)
    columns = ["doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint")]
    return out.select(*columns, F.when(F.col("fp") == F.col("efp"), 1.0).otherwise(0.0).alias("near_edited"), F.when(F.col("fp") == F.col("next_fp"), 1.0).otherwise(0.0).alias("near_next"))


def _told_apart(out: DataFrame, base: DataFrame, clash: DataFrame) -> DataFrame:
    """Appends the SHA-256 of the canonical form to the fingerprints of buckets with different bytes in them."""
    clash = clash.select(F.col("h").alias("ch"))
    hit = _with_hash(base, "text", "fp").join(clash, F.col("fp") == F.col("ch"), "left_semi")
    longer = hit.select("doc_id", "k", F.concat("fp", F.lit("-"), F.sha2(canonical(F.col("text")), 256)).alias("long")).dropDuplicates(["doc_id", "k"])
    own = longer.select(F.col("doc_id").alias("i1"), F.col("k").alias("k1"), F.col("long").alias("own_long"))
    out = out.join(own, (F.col("k") == F.col("k1")) & F.col("doc_id").eqNullSafe(F.col("i1")), "left")
    ahead = longer.select(F.col("doc_id").alias("i2"), F.col("k").alias("k3"), F.col("long").alias("next_long"))
    out = out.join(ahead, (F.col("next_k") == F.col("k3")) & F.col("next_id").eqNullSafe(F.col("i2")), "left")
    out = out.join(clash, F.col("efp") == F.col("ch"), "left")
    edited = F.when(F.col("ch").isNotNull(), F.concat("efp", F.lit("-"), F.sha2(canonical(F.col("edited")), 256))).otherwise(F.col("efp"))
    return out.withColumn("efp", edited).withColumn("fp", F.coalesce("own_long", "fp")).withColumn("next_fp", F.coalesce("next_long", "next_fp"))
