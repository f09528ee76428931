"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into whole numbers and grouped by length into buckets, which are cut into pieces of
bounded size. A sample gives every query a first k-th best score. That score over the product of the
query's length and a bucket's greatest length is the cosine that a member needs at least, the local
threshold: above 1 the bucket is left out. From it follows how many of the query's greatest coordinates,
the focus, have to be looked at until what is left of the query is short against it. If these are at most
a WIDEST share of all, the bucket is pruned by coordinates: the cosine over the focus, plus the product of
what is left of both vectors, has to reach the member's own threshold. Else it is pruned by length: members
shorter than the score allows are cut off. Products of what is left are computed in full, in whole numbers.

A piece's vectors are shuffled once and held by one task at a time; the queries that have to look in it come
to it, in batches, behind them. Within a piece a query's k-th best so far raises its threshold. The k best of
each query and piece go on to a merge. Bounds are taken in single precision and moved towards keeping by more
than its error, so no true result is dropped.

Products are exact: where lengths show that 53 bits might not do, Python's integers are used. A score
beyond a long counts as the nearest long. Vectors that are null or hold null or non-finite components
take no part, nor do null ids. Vectors of different lengths meet as if the shorter one went on with
zeros; an empty vector has product 0 with all. A repeated row is a candidate of its own, but no row with
the query's own id is. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, narrow, ship, table

SCALE, EVERY, BEST = 256, 50, 5
#: Width of a length bucket as a ratio; rows that give first scores.
RATIO, FIRST = 1.05, 4096
#: Least and most rows of a piece, its most bytes, rows that are looked at before thresholds rise, queries at a time.
LEAST, PIECE, BYTES, STEP, AT_ONCE = 512, 32768, 1 << 26, 2048, 128
#: What is left of a query beside its focus is at most this share of the local threshold; widest focus, as a share of all coordinates.
LEFT, WIDEST = 0.9, 0.75
SLACK = 1e-9
LOWEST = -2_000
MOST_LONG = (1 << 63) - 1


def integers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, length): floor(SCALE * x), whole numbers held exactly as doubles, and the length, about."""
    ship(df.sparkSession)
    rows = narrow(df, vec_id=vec_id, embedding=embedding).where("vec_id is not null and embedding is not null")
    doubles = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False)  # null components become NaN
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("v")).to_numpy())])
            rejected = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            of_row, most = np.repeat(np.arange(len(batch)), np.diff(ends)), np.ones(len(batch))
            with np.errstate(all="ignore"):
                v = np.floor(x * SCALE) + 0.0
                np.maximum.at(most, of_row, np.abs(v))
                squares = np.bincount(of_row, weights=(v / most[of_row]) ** 2, minlength=len(batch))
                length = most * np.sqrt(squares)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v))
            made = pa.RecordBatch.from_arrays([batch.column("vec_id"), lists, pa.array(length)], names=["vec_id", "v", "length"])
            yield made.filter(pa.array(np.diff(rejected[ends]) == 0))

    kind = doubles.schema["vec_id"].dataType.simpleString()
    return doubles.mapInArrow(whole, f"vec_id {kind}, v array<double>, length double")


def bucket_of(length: Column) -> Column:
    """The bucket of a length; those under 1, and of no bound, go to the lowest."""
    return F.when(length >= 1, F.floor(F.ln(length) / float(np.log(RATIO))).cast("int")).otherwise(LOWEST)


def matrix(column, width: int = 0) -> np.ndarray:
    """Rows of doubles, filled up with zeros to the longest row or ``width``."""
    column = column if isinstance(column, pa.Array) else pa.array(list(column), pa.list_(pa.float64()))
    sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    longest = max(width, int(sizes.max(initial=0)))
    if (sizes == longest).all():
        return flat.reshape(len(sizes), longest)
    out = np.zeros((len(sizes), longest))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact(questions: np.ndarray, members: np.ndarray, reach: float) -> np.ndarray:
    """All products, as longs; ``reach`` is a bound on their size by lengths."""
    if reach < float(1 << 52):
        return (questions @ members.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    scores = whole(questions) @ whole(members).T
    return np.array([[max(-MOST_LONG - 1, min(MOST_LONG, int(s))) for s in row] for row in scores], dtype=np.int64).reshape(len(questions), len(members))


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, of rows that have not the id ``own``."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at].astype(object)))][:k] if len(at) else at


def focus(units: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Of each query which coordinates are in its focus: its greatest ones, until the rest is short against the threshold."""
    order = np.argsort(-np.abs(units), axis=1, kind="stable")
    taken = np.cumsum(np.take_along_axis(units, order, 1) ** 2, axis=1)
    rest = np.sqrt(np.maximum(0.0, 1.0 - taken))
    size = 1 + (rest > LEFT * thresholds[:, None]).sum(axis=1)
    inside = np.zeros(units.shape, dtype=bool)
    np.put_along_axis(inside, order, np.arange(units.shape[1])[None, :] < size[:, None], 1)
    return inside


class Piece:
    """Vectors of one piece of a bucket, the longest first, with what bounds need."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.rows, self.lengths = ids[order], rows[order], lengths[order]
        self.units = (self.rows / np.maximum(self.lengths, 1e-300)[:, None]).astype(np.float32)
        self.squares = self.units * self.units
        self.computed = self.possible = 0

    def open_to(self, at: slice, units: np.ndarray, lengths: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """[query, member]: whether a member may reach the query's score."""
        members, width = self.lengths[at], max(1, units.shape[1])
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            least = np.where(floors > 0, floors / lengths, -np.inf)  # a member's length times its cosine reaches it
            needed = least[:, None] / members[None, :]
            needed[~np.isfinite(floors)] = -np.inf
            by_length = needed <= 1 + SLACK
            local = np.where(np.isfinite(floors), least / members[0], -np.inf)
        by_length |= (floors <= 0)[:, None]
        picky = np.flatnonzero((local > 0) & (local <= 1))
        if len(picky):
            inside = focus(units[picky], local[picky])
            narrow_ = inside.sum(axis=1) <= WIDEST * width
            picky, inside = picky[narrow_], inside[narrow_]
        if len(picky):
            part = np.where(inside, units[picky], 0.0)
            rest = np.sqrt(np.maximum(0.0, 1.0 - (part * part).sum(axis=1)))
            near = part.astype(np.float32) @ self.units[at].T
            far = np.sqrt(np.maximum(np.float32(0), 1 - inside.astype(np.float32) @ self.squares[at].T + np.float32(width * 2**-22)))
            error = (width + 8) * 2.0**-22
            by_length[picky] &= near + rest.astype(np.float32)[:, None] * far + np.float32(error) >= needed[picky]
        return by_length

    def best(self, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, member, score): the k best members of every query that reach its floor."""
        width = max(rows.shape[1], self.rows.shape[1])
        if self.rows.shape[1] < width:
            self.rows, self.units, self.squares = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.rows, self.units, self.squares))
        if rows.shape[1] < width:
            rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
        units, floors = rows / np.maximum(lengths, 1e-300)[:, None], floors.copy()
        found: list[tuple[list, list]] = [([], []) for _ in ids]
        for start in range(0, len(self.ids), STEP):
            at = slice(start, start + STEP)
            for first in range(0, len(ids), AT_ONCE):
                asked = slice(first, first + AT_ONCE)
                open_to = self.open_to(at, units[asked], lengths[asked], floors[asked])
                self.possible += open_to.size
                self.computed += int(open_to.sum())
                for query in np.flatnonzero(open_to.any(axis=1)):
                    here = start + np.flatnonzero(open_to[query])
                    query += first
                    scores = exact(rows[query][None, :], self.rows[here], lengths[query] * self.lengths[here[0]] * (1 + SLACK))[0]
                    old_ids, old = found[query]
                    every = np.concatenate([np.array(old_ids, np.int64), self.ids[here]]), np.concatenate([np.array(old, np.int64), scores])
                    kept = best_of(every[1], every[0], ids[query], k)
                    found[query] = every[0][kept].tolist(), every[1][kept].tolist()
                    if len(kept) == k:
                        floors[query] = max(floors[query], float(found[query][1][-1]) * (1 - SLACK) - 1)
        return [(query, member, score) for query, (members, scores) in zip(ids.tolist(), found) for member, score in zip(members, scores)]


def meet(k: int):
    """Pieces come one after the other, first their vectors, then the queries that look in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, piece = None, [], None
        for batch in batches:
            part, asked = batch.column("part").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (asked[1:] != asked[:-1])) + 1
            for start, end in zip([0, *edges], [*edges, len(part)]):
                some = batch.slice(start, end - start)
                if part[start] != own:
                    own, held, piece = part[start], [], None
                if not asked[start]:
                    held.append(some)
                elif held or piece:
                    if piece is None:
                        width = max(int(pc.max(pc.list_value_length(h.column("v"))).as_py()) for h in held)
                        piece = Piece(*(np.concatenate(x) for x in zip(*((h.column("id").to_numpy(), matrix(h.column("v"), width), h.column("length").to_numpy()) for h in held))))
                        held = []
                    columns = [some.column(c).to_numpy(zero_copy_only=False) for c in ("id", "length", "floor")]
                    found = piece.best(columns[0], matrix(some.column("v")), columns[1], columns[2], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ((), (), ()))], names=["query_id", "vec_id", "score"])

    return run


def top_products(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, k: int = BEST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each id divisible by ``every`` the k highest products."""
    spark = df.sparkSession
    ship(spark)
    vectors = cut(integers(df, vec_id, embedding).withColumns({"bucket": bucket_of(F.col("length")), "row": F.monotonically_increasing_id()}))

    # first scores: a sample of bounded size, half of it of the longest tenth; a first score only prunes
    size = vectors.agg(F.count("*").alias("n"), F.percentile_approx("length", 0.9).alias("long"), F.max("bucket").alias("top"), F.max(F.size("v")).alias("width")).first()
    one_in = lambda n: F.pmod(F.xxhash64(F.lit("first"), "row"), F.lit(max(1, n))) == 0
    some = vectors.where(((F.col("length") >= F.lit(size["long"])) & one_in(size["n"] // (5 * FIRST))) | one_in(2 * size["n"] // FIRST))
    sample = some.select("vec_id", "v", "length").limit(2 * FIRST).collect()
    first = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in sample], dtype=np.int64), matrix([r["v"] for r in sample]), max((r["length"] for r in sample), default=0.0)))

    def with_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, most = first.value
        for batch in batches:
            floors = np.full(len(batch), -np.inf)
            for at in range(0, len(batch) if len(ids) >= k else 0, 64):
                part = batch.iloc[at : at + 64]
                asked = matrix(part["v"], rows.shape[1])
                scores = asked @ (rows if asked.shape[1] == rows.shape[1] else np.pad(rows, ((0, 0), (0, asked.shape[1] - rows.shape[1])))).T
                for row, (mine, length) in enumerate(zip(part["query_id"], part["length"])):
                    others = scores[row][ids != mine]
                    if len(others) >= k:
                        floors[at + row] = min(np.partition(others, -k)[-k], float(1 << 62)) - SLACK * length * most - 1
            yield batch.assign(floor=floors)

    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asked.select(F.col("vec_id").alias("query_id"), "v", "length").mapInPandas(with_first, "query_id bigint, v array<double>, length double, floor double")
    need = F.when((F.col("floor") > 0) & (F.col("length") > 0), F.col("floor") / F.col("length") * (1 - SLACK)).otherwise(0.0)
    queries = queries.withColumn("least", F.least(bucket_of(need), F.lit(size["top"])))

    # a bucket is one of a few thousand ratios between doubles, so there are few; parts are numbered through all buckets
    each = max(LEAST, min(PIECE, size["n"] // (4 * spark.sparkContext.defaultParallelism), BYTES // (8 * max(1, size["width"] or 1))))
    sizes = [(r["bucket"], -(-r["n"] // each)) for r in vectors.groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect()]
    ends = np.cumsum([n for _, n in sizes]).tolist()
    buckets = spark.createDataFrame([(b, end - n, n) for (b, n), end in zip(sizes, ends)], "bucket int, low int, pieces int")
    placed = vectors.join(F.broadcast(buckets), "bucket").withColumn("part", F.col("low") + F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int"))
    lows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(end - n).alias("low")) for (b, n), end in zip(sizes, ends)])
    from_ = F.array_min(F.transform(F.filter(lows, lambda x: x["bucket"] >= F.col("least")), lambda x: x["low"]))
    wanted = queries.withColumn("part", F.explode(F.sequence(from_, F.lit(ends[-1] - 1)))) if sizes else queries.withColumn("part", F.lit(0))

    columns = ["part", "asked", "id", "v", "length", "floor"]
    kept = placed.select("part", F.lit(False).alias("asked"), F.col("vec_id").cast("bigint").alias("id"), "v", "length", F.lit(None).cast("double").alias("floor"))
    sent = kept.toDF(*columns).unionByName(wanted.select("part", F.lit(True).alias("asked"), F.col("query_id").alias("id"), "v", "length", "floor").toDF(*columns))
    parts = max(1, min(10_000, ends[-1] if ends else 1))
    found = sent.repartition(parts, "part").sortWithinPartitions("part", "asked").mapInArrow(meet(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the best products of every 50th vector of ``embeddings``."""
    return top_products(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {BEST}
"""
