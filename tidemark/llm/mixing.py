"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, packed into blocks of a fixed number of words. Output shards
draw a source for each of their slots, so a shard's source counts are multinomial; the slots of a
source, numbered across shards, go through a pseudorandom permutation of its blocks, a new one for
each pass, and blocks are joined by index. What random draws leave over or short of a source's
share is settled at the end, so totals meet the targets to within a block.

Null sources form one source, last in order. Null text has size 0; a document of size 0 takes 0.
A repeated row is a document of its own. A null doc_id stays. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, narrow, parts_for, shared_folder, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Words in a block; slots in an output shard; documents that one chunk of a source's stream holds, about.
BLOCK, SLOTS, CHUNK = 64, 16384, 1024
ROUNDS = 12
#: Slots that one task makes, about.
EACH = 50_000
#: Most source rows that are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size): words of each document, with a row number that stays, or the one it has."""
    docs = narrow(df, doc_id=doc_id, text=text, source=source, **({"row": row} if row else {}))
    docs = docs if row else docs.withColumn("row", F.monotonically_increasing_id())
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select("row", "doc_id", "source", size.alias("size")))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: sid (its place), source, docs, source_size, target, blocks, draws.

    Sources are rows of one small table. Sorted by how soon they reach their limit, all before some
    place stop there and the rest share what is left by weight; the place is the first whose share
    stays within its limit.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    named = sums.withColumn("sid", F.row_number().over(ordered)).withColumn("weight", weight.cast("long"))
    limit, all_rows = MOST * F.col("source_size"), Window.partitionBy()
    filling = Window.orderBy(limit / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    steps = named.select(
        "*",
        (SHARE * F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(filling), F.lit(0))).alias("left"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(filling), F.lit(0))).alias("weights_left"),
    )
    level = F.col("left") / F.col("weights_left")
    within = F.when(level * F.col("weight") <= limit, level)
    leveled = steps.select("*", F.max(within).over(all_rows).alias("level"))
    target = F.least(limit.cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    out = leveled.select("sid", "source", "docs", "source_size", target.alias("target"), blocks.alias("blocks"))
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    return cut(out.withColumn("draws", F.least(draws.cast("long"), MOST * F.col("blocks"))))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its source's figures and the place ``start`` of its first word in the source's stream.

    The stream is ordered by chunk, a hash of the id, and within it by id: sums run within chunks
    and over the small table of chunk totals, never over a whole source.
    """
    side = small(sources.withColumnRenamed("source", "_source"), BROADCAST_SOURCES)
    docs = sizes.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    chunks = F.ceil(F.col("docs") / CHUNK)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), chunks))
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", "row")
    docs = docs.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    totals = docs.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("sid").orderBy("chunk")
    bases = totals.select("sid", "chunk", (F.sum("words").over(along) - F.col("words")).alias("base"))
    joined = docs.join(bases, ["sid", "chunk"])
    return joined.select("row", "doc_id", "size", "sid", "source_size", "target", (F.col("base") + F.col("before")).alias("start"))


def shuffled(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, chosen by ``key``: in every round the index and its
    mirror about a random point swap places or not, by a hash bit of the larger of both."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("point"), r, *key), n) - x + n, n)
        coin = F.xxhash64(F.lit("coin"), r, F.greatest(x, mirror), *key).bitwiseAND(F.lit(1).cast("long"))
        return F.when(coin == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def shard_slots(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(shard, sid, slot, blocks): every slot of every shard with the running number within its source."""
    wanted = sources.agg(F.coalesce(F.sum("draws"), F.lit(0)).alias("n")).first()["n"]
    shards = -(-wanted // SLOTS)
    running = F.sum("draws").over(Window.orderBy("sid"))
    ladder = sources.where("draws > 0").select("sid", running.alias("upto"))
    ends = ladder.agg(F.array_sort(F.collect_list("upto")).alias("ends")).select("ends")
    sids = ladder.agg(F.transform(F.array_sort(F.collect_list(F.struct("upto", "sid"))), lambda x: x["sid"]).alias("sids")).select("sids")
    steps = F.sequence(F.lit(1), F.lit(max(1, (max(2, sources.count()) - 1).bit_length())))
    point = F.pmod(F.xxhash64(F.lit("slot"), "id"), F.lit(max(1, wanted)))
    slots = spark.range(0, wanted).select((F.col("id") / SLOTS).cast("long").alias("shard"), point.alias("point"), ends.scalar().alias("ends"), sids.scalar().alias("sids"))

    def halve(span: Column, _: Column) -> Column:
        middle = ((span["low"] + span["high"]) / 2).cast("int")
        after = F.element_at(F.col("ends"), middle + 1) <= F.col("point")
        return F.when(span["low"] >= span["high"], span).when(after, F.struct((middle + 1).alias("low"), span["high"].alias("high"))).otherwise(F.struct(span["low"].alias("low"), middle.alias("high")))

    first = F.struct(F.lit(0).alias("low"), (F.size("ends") - 1).alias("high"))
    place = F.aggregate(F.concat(steps, F.array(F.lit(0))), first, halve)["low"]
    drawn = slots.select("shard", F.element_at("sids", place + 1).alias("sid")).groupBy("shard", "sid").agg(F.count("*").alias("n"))
    along = Window.partitionBy("sid").orderBy("shard")
    drawn = cut(drawn.select("shard", "sid", "n", (F.sum("n").over(along) - F.col("n")).alias("first")))
    totals = drawn.groupBy("sid").agg(F.sum("n").alias("got"))
    share = sources.select("sid", "blocks", "draws")
    kept = drawn.join(small(share, BROADCAST_SOURCES), "sid").select("shard", "sid", "blocks", "first", F.least(F.col("first") + F.col("n"), "draws").alias("end"))
    short = share.join(totals, "sid", "left").select(F.lit(shards).cast("long").alias("shard"), "sid", "blocks", F.coalesce("got", F.lit(0)).alias("first"), F.col("draws").alias("end"))
    # few rows that make many: dealt out by their number, which adaptive execution leaves alone
    runs = kept.unionByName(short).where("first < end").repartition(parts_for(sources, wanted, EACH), "sid", "shard")
    return runs.select("shard", "sid", "blocks", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("slot"))


def block_draws(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(sid, block, drawn): how often the mix takes each block that it takes at all."""
    slots = shard_slots(spark, sources)
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    block = shuffled(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("sid"), turn)
    return slots.select("sid", block.alias("block")).groupBy("sid", "block").agg(F.count("*").alias("drawn"))


def pieces(docs: DataFrame) -> DataFrame:
    """The blocks that every document of some size overlaps: row, sid, block, words of the overlap."""
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    spans = docs.where("size > 0").select("row", "sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)
    return spans.select("row", "sid", "block", words.alias("words"))


def mix(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    spark = df.sparkSession
    sizes = sized(df, doc_id, text, source)
    sources = targets(sizes)
    docs = cut(placed(sizes, sources))
    hits = pieces(docs).join(block_draws(spark, sources), ["sid", "block"])
    taken = hits.groupBy("row").agg(F.sum(F.col("words") * F.col("drawn")).alias("taken"))
    return docs.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The mix itself, with all columns of ``df``: a row for each time that some of a document is taken.

    A row's text is the words of the document's blocks that are taken so often, the text itself where
    those are all. Rows are numbered and written to the shared folder first, so null and repeated ids do
    no harm: each row is a document.
    """
    spark, columns, row = df.sparkSession, df.columns, "_row"
    while row in columns:
        row += "_"
    folder = shared_folder(spark)
    df.withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
    df = spark.read.parquet(folder)
    sizes = sized(df, doc_id, text, source, row)
    sources = targets(sizes)
    docs = cut(placed(sizes, sources))
    hits = pieces(docs).join(block_draws(spark, sources), ["sid", "block"], "left").select("row", "block", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    lists = hits.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "drawn"))), lambda x: x["drawn"]).alias("_drawn"))
    plan = docs.join(lists, "row").where("array_max(_drawn) > 0").select(F.col("row").alias("_id"), (F.col("start") % BLOCK).alias("_skip"), "_drawn")
    taken = df.join(plan, F.col(row) == F.col("_id")).withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max("_drawn"))))
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    some = F.filter(words, lambda w, i: F.get("_drawn", F.floor((i + F.col("_skip")) / BLOCK).cast("int")) >= F.col("_turn"))
    chosen = F.when(F.array_min("_drawn") >= F.col("_turn"), F.col(f"`{text}`")).otherwise(F.array_join(some, " "))
    out = taken.withColumn("_text", chosen)
    pick = {text: F.col("_text"), n_chars: F.char_length("_text").cast("bigint")}
    return out.select([(pick[c] if c in pick else F.col(f"`{c}`")).alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the mix of all ``documents``."""
    return mix(table(spark, sf_dir, "documents"))
