"""SimHash near-duplicates: multi-index hashing with small Hamming balls within each segment.

A fingerprint's 64 bits are cut into two segments. By the pigeonhole principle fingerprints that differ
in DISTANCE bits or fewer agree in the second segment, or differ in one bit at most in the first. So the
table is keyed by (segment, value of the segment); lookups are the value itself in both segments and, in
the first, the ball of radius 1 about it. Of two values that differ in one bit one has a zero there, so
setting zeros enumerates the ball. Matches are verified by their complete distance.

Groups of near copies crowd few keys, where looking at all pairs would grow with the square of a group.
The fingerprints that meet at crowded keys are split further: each goes to the 65 keys of its radius-1
ball over all bits, where any two of DISTANCE 2 or less meet half-way, and is joined to the least
fingerprint there. A key is met by at most 65 different fingerprints, all within DISTANCE of each other,
so no link between components is lost. Copies are collapsed before the index, by fingerprint.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, narrow, parts_for, table, texts_mapped
from tidemark.llm.components import components

BITS, SEGMENTS, DISTANCE, SHINGLE, SEED = 64, 2, 2, 3, 42
WIDTH = BITS // SEGMENTS
#: A key with more fingerprints, or more lookups, counts as crowded.
CROWDED, LOOKED_UP = 32, 1024
#: Fingerprints in one partition of the index; shingles whose bits are counted at once.
EACH, AT_ONCE = 20_000, 20_000


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of the ASCII-lower-cased words, repeats included."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return []
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return [digest(s, SEED) for s in shingles]


def bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        some = np.array(hashes[at : at + AT_ONCE], dtype=np.uint64).astype(">u8").view(np.uint8)
        counts += np.unpackbits(some.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str) -> int:
    """A bit is set where it is set in over half of the shingles' hashes; signed; no words: 0."""
    hashes = shingle_hashes(text)
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes)).view(">i8")[0]) if hashes else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the signed long ``fp`` in place of ``text``."""
    return texts_mapped(docs, "text", "fp bigint", lambda texts: [list(map(fingerprint, texts))])


def mask(bit: int) -> Column:
    return F.lit((1 << bit) - (1 << 64) if bit == 63 else 1 << bit).cast("long")


def segment(fp: Column, k: int) -> Column:
    """The bits of the k-th segment, counted from the lowest."""
    return F.shiftrightunsigned(fp, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def index_rows(prints: DataFrame) -> DataFrame:
    """(segment, value, fp, stored): the rows of the table, and the lookups (not stored) of the first segment's balls."""
    own = [F.struct(F.lit(k).alias("segment"), segment(F.col("fp"), k).alias("value"), F.lit(True).alias("stored")) for k in range(SEGMENTS)]
    zeros = F.filter(F.array(*[mask(b) for b in range(WIDTH)]), lambda m: F.col("fp").bitwiseAND(m) == 0)
    ball = F.transform(zeros, lambda m: F.struct(F.lit(0).alias("segment"), segment(F.col("fp"), 0).bitwiseOR(m).alias("value"), F.lit(False).alias("stored")))
    return prints.select("fp", F.inline(F.concat(F.array(*own), ball)))


def half_way(prints: DataFrame) -> DataFrame:
    """Links (u, v) of fingerprints to the least one at each key of their radius-1 balls."""
    keys = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(mask(b)) for b in range(BITS)])
    index = prints.select("fp", F.explode(keys).alias("key"))
    low = cut(index.groupBy("key").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("key", "u"))
    return index.join(low, "key").select("u", F.col("fp").alias("v"))


def near_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between different fingerprints (column fp, distinct) at DISTANCE or fewer bits: all of
    them, but at crowded keys only as many as keep what they connect connected."""
    prints = cut(prints.repartition(parts_for(prints, prints.count(), EACH), "fp"))
    rows = index_rows(prints)
    sizes = rows.groupBy("segment", "value").agg(F.count_if("stored").alias("held"), F.count("*").alias("n")).where("held > 0 and n > 1")
    crowded = (F.col("held") > CROWDED) | (F.col("n") > LOOKED_UP)
    met = cut(rows.join(sizes.select("segment", "value", crowded.alias("crowded")), ["segment", "value"]))
    few = met.where("not crowded")
    found = few.where("stored").select("segment", "value", F.col("fp").alias("u"))
    asking = few.select("segment", "value", F.col("fp").alias("v"), F.col("stored").alias("same"))
    pairs = found.join(asking, ["segment", "value"]).where(F.col("u") != F.col("v")).where("not same or u < v")
    met_twice = met.where("crowded").select("fp").distinct()
    links = pairs.select("u", "v").unionByName(half_way(cut(met_twice)))
    return links.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))


def grouped(docs: DataFrame, lowest: Column) -> DataFrame:
    """``docs`` (some columns and fp) with ``least``: the least ``lowest`` of all rows that links connect with a row."""
    prints = cut(docs.groupBy("fp").agg(F.min(lowest).alias("lowest")))
    linked = components(near_links(prints.select("fp"))).withColumnRenamed("node", "fp")
    linked = cut(linked.join(prints, "fp"))
    tops = linked.groupBy("component").agg(F.min("lowest").alias("least"))
    members = linked.select("fp", "component").join(tops, "component").select("fp", "least")
    named = cut(prints.join(members, "fp", "left").select("fp", F.coalesce("least", "lowest").alias("least")))
    return docs.join(named, "fp")


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id reachable over links, the row's own included. Null text is
    empty text; texts without words have fingerprint zero and link like any other. Repeated rows
    stay rows. A null doc_id is no smallest id: a component of nulls only has a null id. An empty
    table gives an empty table; other columns are not read.
    """
    docs = cut(fingerprints(narrow(df, doc_id=doc_id, text=text)))
    out = grouped(docs, F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component one row, with all its columns: that of the least doc_id, nulls last; of rows that
    share the id, that of the least digest of the text; of rows alike in both, the least by the other columns."""
    digest = [F.xxhash64(text).alias("_one"), F.xxhash64(F.lit("second"), text).alias("_two")]
    slim = narrow(df, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("one"), F.xxhash64(F.lit("second"), "text").alias("two"), "text")
    docs = cut(fingerprints(slim))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "one", "two")
    chosen = cut(grouped(docs, key).where(F.col("least") == key).select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "one", "two")]))
    stay = cut(chosen.distinct())
    n = stay.count()
    same = (F.col(f"`{doc_id}`").eqNullSafe(F.col("_stay_doc_id"))) & (F.col("_one") == F.col("_stay_one")) & (F.col("_two") == F.col("_stay_two"))
    side = stay.select([F.col(c).alias(f"_stay{c}") for c in stay.columns])
    kept = df.select("*", *digest).join(side, same, "left_semi")
    if chosen.count() > n:  # rows that repeat both id and text
        rest = [c for c in df.columns if c not in (doc_id, text)]
        least = F.min(F.struct(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in rest])).alias("_row")
        kept = kept.groupBy(F.col(f"`{doc_id}`"), "_one", "_two").agg(least).select(doc_id, "_row.*")
    return kept.select([F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: near-duplicates among all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
