"""Ranked lexical search by blocked sparse matrix products.

The items are a stated query set. Their terms form a sparse matrix, items by terms, of how often each item
holds a term; items are dealt by a hash into blocks of about ENTRIES of its entries, so that what tasks are
sent has a bound however many items there are. Documents become sparse blocks of at most BLOCK documents
and POSTINGS counts, terms by documents, of the terms that some item of the block holds. From these come
the corpus figures (documents, words, documents of each term) over all documents, and with them the
whole-number weight of every entry. Each block of documents is multiplied by the item matrix row by row,
merging the rows of the documents' matrix that an item's terms name into one accumulator; the BEST
documents of the item in the block meet those found before in the task, and a task gives its best, which
meet those of other tasks item by item.

Documents without a term take no part. Null text has none. Every row of the documents is a document of its
own; a null doc_id comes last among equal scores. Items of one item_id are one item with the terms of all
its rows; an item without terms has no result. An empty table on either side gives an empty table. Other
columns are not read. Whole numbers are exact: where 64 bits might not hold a product Python's integers do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import cut, kept_bytes, narrow, ship, sliced, split_words, table

BEST = 20
#: Entries of the item matrix in one block of items; documents and counts in one block of documents.
ENTRIES, BLOCK, POSTINGS = 1_000_000, 8192, 2_000_000
WORDS = kept_bytes(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))
#: The same terms for Spark's own expressions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_entries(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of (item_id, text)."""
    terms = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def sparse_blocks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of (doc_id, text): ids and sizes of documents with terms, and term, place and count of what the vocabulary has."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType()))]
        + [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("terms", "places")]
        + [T.StructField("counts", T.ArrayType(T.LongType()))]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = shared.value.get
        ids: list = []
        sizes: list[int] = []
        terms: list[int] = []
        places: list[int] = []
        counts: list[int] = []

        def let_go() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([list(x)], f.type) for x, f in zip((ids, sizes, terms, places, counts), arrow)], schema=arrow)
            for x in (ids, sizes, terms, places, counts):
                x.clear()
            return out

        for batch in batches:
            for part in sliced([batch], "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    held: Counter = Counter()
                    for words in split_words(text, WORDS):
                        held.update(words)
                    if not held:
                        continue
                    for word, n in held.items():
                        term = place_of(word)
                        if term is not None:
                            terms.append(term)
                            places.append(len(ids))
                            counts.append(n)
                    ids.append(doc)
                    sizes.append(held.total())
                    if len(ids) >= BLOCK or len(terms) >= POSTINGS:
                        yield let_go()
        if ids:
            yield let_go()

    return docs.mapInArrow(block, schema)


def document_counts(blocks: DataFrame) -> dict[int, int]:
    """The number of documents that hold each term: at most one count for each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=len(total))
            found[: len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    return {r["term"]: r["n"] for r in blocks.select("terms").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The part of a term's value that its count and the document's size give."""
    most = int(sizes.max(initial=0))
    if 25 * most * documents >= 1 << 63 or int(counts.max(initial=0)) * 1_000_000_000 >= 1 << 63:
        counts, sizes = counts.astype(object), sizes.astype(object)
    norm = 75 + (25 * sizes * documents) // words
    return ((1_000_000_000 * counts) // (1000 * counts + 12 * norm)).astype(np.int64)


def merged_rows(entries: list[tuple[int, int]], starts: np.ndarray, places: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """One row of the product: the rows of the documents' matrix that ``entries`` (term, times) name, merged into one accumulator."""
    row = np.zeros(width, np.int64)
    for term, times in entries:
        low, high = starts[term], starts[term + 1]
        row[places[low:high]] += times * values[low:high]  # a document stands once in a term's row
    return row


def order_of(found: tuple) -> tuple:
    """Higher scores first, then smaller ids, null last."""
    score, doc = found
    return (-score, doc is None, doc) if doc is not None else (-score, True)


def block_scores(blocks: DataFrame, matrix: list[tuple[object, list[tuple[int, int]]]], weights: np.ndarray, documents: int, words: int, item_type: T.DataType, best: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best documents of every item."""
    doc_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    shared = blocks.sparkSession.sparkContext.broadcast((matrix, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, weights = shared.value
        found: list[list[tuple]] = [[] for _ in matrix]
        for batch in batches:
            for at in range(len(batch)):
                ids = batch.column("ids")[at].values
                sizes, terms, places, counts = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("sizes", "terms", "places", "counts"))
                order = np.argsort(terms, kind="stable")
                terms, places, counts = terms[order], places[order], counts[order]
                starts = np.searchsorted(terms, np.arange(len(weights) + 1))
                values = weights[terms] * impacts(counts, sizes[places], documents, words)
                for item, (_, entries) in enumerate(matrix):
                    row, mine = merged_rows(entries, starts, places, values, len(ids)), found[item]
                    least = max(1, mine[-1][0]) if len(mine) == best else 1
                    high = np.flatnonzero(row >= least)
                    if len(high) > best:
                        high = high[row[high] >= np.partition(row[high], -best)[-best]]
                    if len(high):
                        mine += zip(row[high].tolist(), ids.take(pa.array(high)).to_pylist())
                        mine.sort(key=order_of)
                        del mine[best:]
        rows = [(name, doc, n) for (name, _), mine in zip(matrix, found) for n, doc in mine]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    return blocks.mapInArrow(score, schema)


def search(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", best: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``best`` documents of every item with a score above 0."""
    docs = narrow(documents, doc_id=doc_id, text=text)
    asked = cut(item_entries(narrow(items, item_id=item_id, text=item_text)))
    spark, item_type = documents.sparkSession, items.schema[item_id].dataType
    dealt = max(1, -(-asked.count() // ENTRIES))
    found = []
    for part in range(dealt):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(dealt)) == part).collect()  # a block of about ENTRIES
        vocabulary = {term: k for k, term in enumerate(sorted({r["term"] for r in rows}))}
        entries: dict = {}
        for r in rows:
            entries.setdefault(r["item_id"], []).append((vocabulary[r["term"]], r["times"]))
        blocks = cut(sparse_blocks(docs, {term.encode(): k for term, k in vocabulary.items()}))
        size = blocks.agg(F.sum(F.size("ids").cast("long")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
        if not size["n"]:
            break
        held = document_counts(blocks)
        weights = np.array([floor(1000 * log((2 * size["n"] + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(vocabulary))], dtype=np.int64)
        found.append(block_scores(blocks, sorted(entries.items(), key=lambda e: str(e[0])), weights, size["n"], size["words"], item_type, best))
    if not found:
        empty = T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the documents that answer each item of ``benchmark`` best."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)
), tf AS (SELECT doc, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT doc, sum(tf)::BIGINT AS n FROM tf GROUP BY doc),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, docs
), asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, doc, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc), corpus
  GROUP BY item_id, doc, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {BEST}
"""
