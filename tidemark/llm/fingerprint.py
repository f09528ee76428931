"""Document fingerprints by canonical exact digest, with DataFrame functions only.

A text is made canonical (Unicode compatibility composition, full case folding, runs of white space
as one space, none at the ends) and digested by two independent 64-bit xxHashes. Where a digest
occurs more than once, the canonical bytes are compared: texts that share a digest but differ get
their place among them appended, so fingerprints are equal exactly when canonical texts are.

Null text is empty text. Rows with equal texts, and repeated rows, have equal fingerprints. For the comparison
with the next document ids are whole numbers, null ids sort last, and rows of one id are one group's, which is
sorted on disk where it does not fit. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, narrow, table

#: Documents that one group of neighbours holds, about, and the most groups; the bounds between
#: groups are ids, kept on the driver.
GROUP, GROUPS = 48, 65_536
#: Most repeated digests that are broadcast; beyond it they are joined by shuffle.
BROADCAST_DIGESTS = 500_000


def canonical(text: Column) -> Column:
    compose = lambda t: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def wide(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    parts = [F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)]
    return F.lower(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))


def collisions(texts: DataFrame) -> DataFrame:
    """(digest, canon, place): every canonical text beyond the first by byte order that shares a
    digest with a different one. Only texts whose digest occurs more than once are compared; equal
    texts collapse before they are shuffled."""
    digests = texts.select(wide(canonical(F.col("text"))).alias("digest"))
    repeated = cut(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_DIGESTS else repeated
    canon = texts.select(canonical(F.col("text")).alias("canon")).withColumn("digest", wide(F.col("canon")))
    distinct = canon.join(side, "digest", "left_semi").groupBy("digest", "canon").agg(F.lit(1).alias("one"))
    met = cut(distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if met.isEmpty():
        return met.select("digest", F.lit("").alias("canon"), F.lit(0).alias("place"))
    order = Window.partitionBy("digest").orderBy("canon")
    return cut(distinct.join(met, "digest", "left_semi").select("digest", "canon", (F.row_number().over(order) - 1).alias("place")))


def fingerprinted(df: DataFrame, clashes: DataFrame, some: bool, canon: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of its canonical column: the digest, and the place where texts clash."""
    df = df.withColumn(out, wide(F.col(canon)))
    if not some:
        return df
    side = clashes.select(F.col("digest").alias(out), F.col("canon").alias(canon), "place")
    joined = df.join(side, [out, canon], "left")
    return joined.withColumn(out, F.when(F.col("place") > 0, F.concat(out, F.lit("-"), "place")).otherwise(F.col(out))).drop("place")


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""
    docs = narrow(df, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    clashes = collisions(docs)
    out = docs.select("doc_id", canonical(F.col("text")).alias("canon"))
    return fingerprinted(out, clashes, not clashes.isEmpty(), "canon", "fingerprint").select("doc_id", "fingerprint")


def neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``: the next document's, by descending id; after the last, the first's.

    Ids are cut into groups at bounds that are ids themselves. A document at a bound goes to its own
    group and, as a guest behind the last, to the group that follows, so every text is shuffled once
    and no window holds more than a group.
    """
    n = docs.count()
    groups = max(1, min(GROUPS, n // GROUP))
    at = [(i + 1) / groups for i in range(groups)]
    bounds = docs.agg(F.percentile_approx("doc_id", at, 10 * groups).alias("b")).first()["b"] or []
    highest = docs.agg(F.max("doc_id")).first()[0] if bounds else None
    bounds = sorted(set(bounds) | {highest}) if bounds else []
    table_of = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    low = F.lit(0)
    for step in reversed(range(max(1, len(bounds).bit_length()))):
        middle = low + (1 << step)
        low = F.when((middle <= len(bounds)) & (F.element_at(table_of, F.least(middle, F.lit(max(1, len(bounds))))) < F.col("doc_id")), middle).otherwise(low)
        docs = docs.withColumn("_low", low)
        low = F.col("_low")
    group = F.when(F.col("doc_id").isNull(), 0).otherwise(low) if bounds else F.lit(0)
    docs = docs.withColumn("group", group)
    is_bound = F.coalesce(F.element_at(table_of, F.col("group") + 1) == F.col("doc_id"), F.lit(False)) if bounds else F.lit(True)
    after = (F.col("group") + 1) % max(1, len(bounds))
    places = F.when(is_bound, F.array(F.struct(F.col("group").alias("g"), F.lit(False).alias("guest")), F.struct(after.alias("g"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("group").alias("g"), F.lit(False).alias("guest")))
    )
    placed = docs.select("doc_id", "text", F.inline(places))
    order = Window.partitionBy("g").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest")).drop("g", "guest")


def compared(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and that of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the next document's
    first as many, or all. Likeness is 1 for equal canonical texts and 0 otherwise.
    """
    docs = narrow(df, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    clashes = collisions(docs)
    some = not clashes.isEmpty()
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = neighbours(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    rows = rows.select(
        "doc_id", "n_chars", edited.alias("edited"), canonical(F.col("text")).alias("canon"), canonical(edited).alias("edited_canon"), canonical(F.col("next_text")).alias("next_canon")
    )
    rows = fingerprinted(rows, clashes, some, "canon", "fingerprint")
    rows = fingerprinted(rows, clashes, some, "edited_canon", "edited_fingerprint")
    like = lambda other: F.when(F.col("canon") == F.col(other), 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like("edited_canon").alias("near_edited"), like("next_canon").alias("near_next")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all ``documents`` beside their edited texts."""
    return compared(table(spark, sf_dir, "documents"))
