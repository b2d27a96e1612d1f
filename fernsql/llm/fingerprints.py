"""Canonical exact document fingerprints, in DataFrame and SQL functions only.

Canonical form: Unicode normalisation form C, then Unicode case folding, then form C again, then runs of
white space to one space, ends trimmed. The fingerprint is two XXH64 digests under different seeds, 128 bits.
Texts whose digests meet are compared byte for byte within their bucket; where canonical texts differ under one
digest, all but the first get a suffix with their rank, so equal fingerprints mean equal canonical texts.

Null texts count as empty. Repeated rows have equal fingerprints. Null ids come last in descending order; rows of
one id are ordered by text. Likeness is 1 for equal fingerprints, else 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: White space: Unicode's White_Space property.
SPACE = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: Ranges of ids at most; their first rows and bounds are all that the driver sees.
MOST_RANGES = 10_000


def canonical(text: Column) -> Column:
    """The canonical form. Spark's ``reflect`` function calls ICU's composer and case folder."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(False))
    return F.trim(F.regexp_replace(again, SPACE, " "))


def wide(canon: Column) -> Column:
    """128 bits in hex: XXH64 with seed 42, and XXH64 seeded by a constant's digest."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0")))


def marks(canon: Column, digest: Callable[[Column], Column] = wide) -> Column:
    """The digest, and a third XXH64 that tells texts of one bucket apart."""
    return F.struct(digest(canon).alias("bucket"), F.xxhash64(F.lit("third"), canon).alias("third"))


def _key(text: str, doc_id: str = "doc_id") -> list[Column]:
    """By what rows with equal texts meet in spite of null and repeated ids; ids spread the copies of one text."""
    return [F.xxhash64(text).alias("h"), F.pmod(F.xxhash64(doc_id), F.lit(4096)).alias("salt")]


def fingerprint(docs: DataFrame, digest: Callable[[Column], Column] = wide) -> DataFrame:
    """(doc_id, fingerprint) of each row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession, "fingerprint")
    rows = scratch.save(texts.select("doc_id", F.struct(*_key("text")).alias("own_key"), marks(canonical(F.col("text")), digest).alias("own")), "rows")
    ranks = _ranks([_repeated(texts, rows, ["own"], "own")], digest, scratch)
    return _named(rows, ["own"], ranks).select("doc_id", F.col("own").alias("fingerprint"))


def _repeated(texts: DataFrame, rows: DataFrame, columns: list[str], column: str) -> DataFrame:
    """The canonical form of those texts (doc_id, text) whose digest, in a column, is found more than once in all columns.

    The digest table says which; only their texts are canonicalised again.
    """
    every = rows.select(F.col(columns[0]).bucket.alias("bucket"))
    for c in columns[1:]:
        every = every.unionAll(rows.select(F.col(c).bucket))
    often = every.groupBy("bucket").count().filter("count > 1").select("bucket")
    wanted = rows.select(F.col(column).bucket.alias("bucket"), f"{column}_key.*").join(often, "bucket", "left_semi").select("h", "salt").distinct()
    return texts.select("text", *_key("text")).join(wanted, ["h", "salt"], "left_semi").select(canonical(F.col("text")).alias("canon"))


def _ranks(parts: list[DataFrame], digest: Callable[[Column], Column], scratch: Scratch) -> DataFrame | None:
    """(bucket, third, rank) of buckets in which byte comparison finds different texts; None if there are none.

    Partial aggregation keeps each bucket's least and greatest text, so a group of copies sends one row a task.
    """
    texts = [p.select("canon").withColumn("bucket", digest(F.col("canon"))) for p in parts]
    ends = None
    for i, t in enumerate(texts):
        # One part after the other, so that the shuffle files of one are gone before the next.
        kept = scratch.save(t.groupBy("bucket").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")), f"ends{i}")
        scratch.collect_garbage()
        ends = kept if ends is None else ends.unionAll(kept)
    clash = scratch.save(ends.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("bucket"), "clash")
    if not clash.limit(1).count():
        return None
    apart = reduce(DataFrame.unionAll, (t.join(clash, "bucket", "left_semi") for t in texts)).distinct()
    order = Window.partitionBy("bucket").orderBy("canon")
    return scratch.save(apart.select("bucket", F.xxhash64(F.lit("third"), F.col("canon")).alias("third"), F.row_number().over(order).alias("rank")), "ranks")


def _named(rows: DataFrame, columns: list[str], ranks: DataFrame | None) -> DataFrame:
    """Digest columns turned into fingerprints."""
    for c in columns:
        name = F.col(c).bucket
        if ranks is not None:
            r = ranks.select(F.struct("bucket", "third").alias("mark"), "rank")
            rows = rows.join(r, rows[c] == r.mark, "left").drop("mark")
            name = F.concat(name, F.when(F.col("rank") > 1, F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise(""))
        rows = rows.withColumn(c, name).drop("rank")
    return rows


def _place(column: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the column; bounds in two levels, so that a row meets few of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at = lambda a: F.size(F.filter(a, lambda b: b <= column))
    head = F.greatest(F.lit(1), at(F.array(*(F.lit(f[0]) for f in fine))))
    rest = F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in fine)), head)
    return (head - 1) * step + at(rest)


def following(docs: DataFrame, carried: dict[str, Column], rows_each: int = 2000) -> DataFrame:
    """doc_id, text, carried columns, and each as ``next_`` from the row after, in descending doc_id, circular.

    Rows go to ranges of doc_id of about rows_each rows. A range's last row needs the first row of the range
    below, so those first rows, one a range, are copied to the range above. Range bounds come from quantiles of
    doc_id; any bounds give the same result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"))
    light = docs.select("doc_id")
    ranges = max(1, min(MOST_RANGES, math.ceil(light.count() / rows_each)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted({int(x) for x in light.approxQuantile("doc_id", shares, 0.1 / ranges)}) if shares else []
    place = _place(F.col("o"), bounds)
    firsts = light.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o")).groupBy(place.alias("part")).agg(F.max("o").alias("o")).orderBy("part").collect()
    if not firsts:
        firsts = [{"part": 0, "o": 0}]
    above = spark.createDataFrame([(r["o"], firsts[(i + 1) % len(firsts)]["part"]) for i, r in enumerate(firsts)], "o long, part int")  # MOST_RANGES rows at most
    # Of a head's equal ids the first by text is the one that the row above meets.
    heads = rows.join(F.broadcast(above), "o").groupBy("o", "part").agg(F.min("text").alias("text"))
    ghosts = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "o", "part", F.lit(True).alias("ghost"))
    both = rows.select("doc_id", "text", "o", place.cast("int").alias("part"), F.lit(False).alias("ghost")).unionByName(ghosts).withColumns(carried)
    order = Window.partitionBy("part").orderBy("ghost", F.col("o").desc(), "text")
    names = ["text", *carried]
    led = both.select("doc_id", "ghost", *names, *(F.lead(c).over(order).alias(f"next_{c}") for c in names))
    return led.filter("not ghost").drop("ghost")


EDITED = "concat(left(text, char_length(text) - cast(floor(char_length(text) / 2) as int)), left(next_text, cast(floor(char_length(text) / 2) as int)))"


def edited_fingerprints(spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = wide) -> DataFrame:
    """Per row: fingerprints of its text and of its edited text, and their likeness and that of the next row's.

    Edited: the last half of the code points, rounded down, replaced by the first as many of the next row's text.
    """
    scratch = Scratch(spark, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chain = following(docs, {"own": marks(canonical(F.col("text")), digest)})
    rows = chain.withColumn("edited", F.expr(EDITED)).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "own", marks(canonical(F.col("edited")), digest).alias("changed"), F.col("next_own").alias("after"),
        F.struct(*_key("text")).alias("own_key"), F.struct(*_key("edited")).alias("changed_key"),
    )
    rows = scratch.save(rows, "digests")
    scratch.collect_garbage()
    both = ["own", "changed"]
    found = [_repeated(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rows, both, "own")]
    often = rows.select("own.bucket").unionAll(rows.select("changed.bucket")).groupBy("bucket").count().filter("count > 1")
    if rows.select("changed.bucket").join(often, "bucket", "left_semi").limit(1).count():
        found.append(_repeated(following(docs, {}).select("doc_id", F.expr(EDITED).alias("text")), rows, both, "changed"))
    ranks = _ranks(found, digest, scratch)
    named = _named(rows, ["own", "changed", "after"], ranks)
    return named.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("changed").alias("edited_fingerprint"),
        (F.col("own") == F.col("changed")).cast("double").alias("near_edited"), (F.col("own") == F.col("after")).cast("double").alias("near_next"),
    )
