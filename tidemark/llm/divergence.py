"""How far the sources of a language differ in the words they use: smoothed shares and their divergence.

Terms are maximal runs of ASCII letters and characters from U+0080 on, only A-Z lower-cased. A language
keeps the terms that at least LEAST of its documents hold. Tasks count terms by (lang, source) before
anything is shuffled; the counts meet by (lang, term), so no word, source or language is one task's.
Kept terms are dealt to blocks of about BLOCK terms, and each (lang, block) becomes one dense int64 tile,
groups by terms, with zeros where a group lacks a term. In a tile the shares of all pairs of groups are
broadcast against each other, CELLS at a time, into a partial pair matrix; partial matrices are summed.
Each tile also gives every group's TOP terms against its language; a group's lists merge to one.

All arithmetic is exact in 64 bits while a group has under 9e15 words and a language under 2e9 kept terms.
Null lang, source and text count as ''. Every occurring group takes part, even without terms; a language
without kept terms has pairs of value 0. Repeated rows are documents of their own. An empty table gives
an empty table. Only the named columns are read. The number of sources of a language bounds a tile's
height; a language's pairs are the result's own size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, kept_bytes, narrow, ship, sliced, split_words, table

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms of a tile, cells of one broadcast, distinct (group, term) counts that a task holds, languages that are broadcast.
BLOCK, CELLS, HELD, FEW = 4096, 1 << 21, 400_000, 10_000
LETTERS = kept_bytes(bytes(range(97, 123)) + bytes(range(128, 256)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n) as far as each task got before it let go; a null term stands for the group itself."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, str], Counter] = {}
        holders: dict[tuple[str, str], Counter] = {}

        def let_go() -> Iterator[pa.RecordBatch]:
            for group, tally in words.items():
                terms, held = list(tally), holders[group]
                columns = [[None, *terms], [0, *(held[t] for t in terms)], [0, *tally.values()]]
                size = len(terms) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0]] * size), pa.array([group[1]] * size), pa.array(columns[0], pa.binary()).cast(pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                    names=["lang", "source", "term", "docs", "n"],
                )
            words.clear()
            holders.clear()

        size = 0
        for batch in batches:
            for part in sliced([batch], "text"):
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    tally, held = words.setdefault((lang, source), Counter()), holders.setdefault((lang, source), Counter())
                    before, mine = len(tally), set()
                    for piece in split_words(text, LETTERS):
                        tally.update(piece)
                        mine.update(piece)
                    held.update(mine)
                    size += len(tally) - before
                    if size > HELD:
                        yield from let_go()
                        size = 0
        yield from let_go()

    return docs.mapInArrow(count, "lang string, source string, term string, docs bigint, n bigint")


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, first): counts of kept terms, ``first`` once for each term of a language; and rows with null terms for groups."""
    # partial counts go out by (lang, term) at once, which serves the sums and the count of documents alike
    summed = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    of_term = Window.partitionBy("lang", "term")
    seen = summed.withColumn("held", F.sum("docs").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    return cut(seen.where(F.col("term").isNull() | (F.col("held") >= least)).select("lang", "source", "term", "n", "first"))


def by_language(rows: DataFrame, few: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``few``, one row a language; languages are counted before they are broadcast."""
    if few.count() <= FEW:
        return rows.join(F.broadcast(few), "lang")
    dealt = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(dealt, ["lang", "_salt"]).drop("_salt")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division so that no product leaves 64 bits."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_matrix(p: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """[i, j]: the sum over terms of the squared difference of groups i and j over j's share."""
    groups, terms = p.shape
    out = np.zeros((groups, groups), dtype=np.int64)
    high = max(1, min(groups, cells // max(1, groups)))
    wide = max(1, cells // (high * max(1, groups)))
    for top in range(0, groups, high):
        for left in range(0, terms, wide):
            part = p[:, left : left + wide]
            out[top : top + high] += squares(part[top : top + high, None, :], part[None, :, :]).sum(axis=2)
    return out


def best_terms(counts: np.ndarray, p: np.ndarray, q: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each group (place, places of terms, values): the ``top`` terms used more than in the language; terms come sorted."""
    values = squares(p, q[None, :])
    for group in range(len(p)):
        at = np.flatnonzero((counts[group] > 0) & (p[group] > q))
        if len(at) > top:
            at = at[values[group, at] >= np.partition(values[group, at], -top)[-top]]
        at = at[np.argsort(-values[group, at], kind="stable")][:top]
        yield group, at, values[group, at]


def tile(rows: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Partial pairs and top terms of one block of one language."""
    columns = ["lang", "source", "part", "item", "value"]
    if not len(rows):
        return pd.DataFrame([], columns=columns).astype({"value": "int64"})
    members = members.sort_values("source", ignore_index=True)
    sources = members["source"].tolist()
    terms, column = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True)
    counts = np.zeros((len(sources), len(terms)), dtype=np.int64)
    counts[rows["source"].map({s: k for k, s in enumerate(sources)}).to_numpy(), column] = rows["n"].to_numpy()
    kept, whole = int(members["kept"].iloc[0]), int(members["whole"].iloc[0])
    p = shares(counts, members["total"].to_numpy(dtype=np.int64)[:, None] + kept)
    q = shares(counts.sum(axis=0), np.int64(whole + kept))
    pairs, names = pair_matrix(p), np.array(sources, dtype=object)
    out = [pd.DataFrame({"source": names[k], "part": "pair", "item": np.delete(names, k), "value": np.delete(pairs[k], k)}) for k in range(len(names))]
    out += [pd.DataFrame({"source": names[g], "part": "term", "item": terms[at], "value": values}) for g, at, values in best_terms(counts, p, q, TOP)]
    return pd.concat(out, ignore_index=True).assign(lang=members["lang"].iloc[0])[columns]


def audit(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group is from the others of its language (part ``pair``, item
    the other source) and which terms set it apart from the language (part ``term``, at most ``top`` of them)."""
    if top > TOP:
        raise ValueError(f"tiles give {TOP} terms at most")
    named = narrow(df, text=text, lang=lang, source=source).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_counts(named, least)
    terms = kept.where("term is not null")
    members = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = Window.partitionBy("lang")
    vocabulary = terms.groupBy("lang").agg(F.count_if("first").alias("kept"))
    members = cut(members.withColumn("whole", F.sum("total").over(of_lang)).join(vocabulary, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0))))
    blocks = vocabulary.select("lang", F.ceil(F.col("kept") / BLOCK).cast("int").alias("blocks"))

    dealt = by_language(terms.select("lang", "source", "term", "n"), blocks).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    spread = members.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys, height, width = ["lang", "block"], ["source", "total", "whole", "kept"], ["source", "term", "n"]
    schema = "lang string, source string, part string, item string, value bigint"
    # both sides stem from the same counts: renaming tells their columns apart
    left, right = (side.select(*keys, *rest).toDF(*keys, *rest).groupBy(*keys) for side, rest in ((spread, height), (dealt, width)))
    tiles = cut(left.cogroup(right).applyInPandas(lambda m, r: tile(r, m), schema))

    others = members.select("lang", F.col("source").alias("item"))
    zeros = members.select("lang", "source").join(others, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    pairs = tiles.where("part = 'pair'").unionByName(zeros).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        order: list[Column] = [F.desc("value"), F.asc("item")]
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    best = ranked(tiles.where("part = 'term'")).where(F.col("rank") <= top)
    return ranked(pairs).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: divergence of the sources of ``documents``, language by language."""
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST}),
counted AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
         sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS own,
         sum(coalesce(n, 0)) OVER (PARTITION BY g.lang) AS whole,
         sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, kept.term) AS all_n, v
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN counted USING (lang, source, term)
), s AS (
  SELECT lang, source, term, n,
         CAST(1 + ({SCALE}::HUGEINT * (n + 1)) // (own + v) AS HUGEINT) AS p,
         CAST(1 + ({SCALE}::HUGEINT * (all_n + 1)) // (whole + v) AS HUGEINT) AS q
  FROM cell
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP}
"""
