"""Repeated passages: paragraph MinHash banding, and anchored windows for passages inside paragraphs.

Paragraphs (lines) of five words or more get a MinHash signature over five-word shingles, cut
into BANDS bands of ROWS rows (recall 0.9998 at a similarity of 0.8). Paragraphs that share a band
are joined to the band's representative, a different one in each band, exact Jaccard is verified on
their texts, and links form components. Bands whose other members are not yet in one component are
then gone through in blocks, and crowded ones in pairs of blocks, until each pair in a band is verified
or joined through verified links. Equal paragraphs collapse before that, so copies cost no pairs; they are
told by a 64-bit hash, under which the bytes of repeated ones are compared: should two unlike lines share
a hash, all are hashed anew with another seed.

A passage pasted into a longer paragraph is no paragraph of its own, so texts are also cut into
windows of WINDOW words that start at content-defined anchors (the least shingle hash among SPREAD
neighbours): whatever is repeated over WINDOW + SPREAD - 1 words or more shares a window. Of a window
that occurs in different documents the first occurrence is kept, and every other one is removable.
Windows repeated at one distance from the kept ones are runs; the words beside a run at the end of a
stretch are compared with those beside the kept occurrence, as far as an anchor may be away. What is removable, and what is kept for
others, is merged into passages; those that share a run are a cluster. A kept passage may overlap a
removable one of its document: such words are kept in a still earlier place, so every word stays once.

The result has one row for each removable or kept stretch, not for documents without any: doc_id,
kind (paragraph or passage), start and end (code points), words, cluster_id (smallest doc_id of the
cluster) and keep (for paragraphs true for the cluster's first stretch, for passages true where others
are removable because of it). Words are runs of anything but the six
ASCII white spaces; A-Z are lower-cased. Null text is empty text; null ids take no part; rows that
repeat an id count as one document. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, narrow, release, shared_folder, ship, sifted, sliced, table
from tidemark.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, BANDS_AT_ONCE = 12, 3, 4
WINDOW, SPREAD = 32, 16
#: Seed of a line's hash at first; about the bytes of texts that are cut into units together, which a core's cache holds.
SEED, AT_ONCE = 42, 1 << 17
#: Most keys that are broadcast; beyond it they are joined by shuffle.
BROADCAST_IDS = 20_000
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SEEDS = np.random.default_rng(3).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: One of so many ids is sampled to find crowded keys; a key with so many sampled rows counts as crowded.
SAMPLED, CROWDED = 64, 32
#: Parts that the windows of a crowded key are dealt out to.
SALTS = 1024
#: Most paragraphs of a band that are compared in one place, and about how many characters these may have.
BLOCK, BLOCK_SIZE = 4096, 32_000_000
UNITS = "doc_id bigint, start int, end int, words int, key bigint, keys array<bigint>, kind string"
BESIDE = "doc_id bigint, place int, key bigint, left boolean, hashes array<bigint>, points array<int>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, n.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def spans_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of values[first:last] for each pair, whatever its place."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return mixed((sums[last] - sums[first]) * down[first])


class Words:
    """Places and hashes of the words of texts, and the text and the line each is in; places are code points of its text."""

    def __init__(self, texts: list[str]):
        self.raw = "\n".join(texts).encode()
        low = np.frombuffer(self.raw.lower(), dtype=np.uint8)
        white = np.concatenate([[True], (low == 32) | ((low >= 9) & (low <= 13)), [True]])
        edges = np.flatnonzero(white[1:] != white[:-1])
        first, last = edges[::2], edges[1::2]
        points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(begins, points[first], side="right") - 1
        self.start, self.end = points[first] - begins[self.text], points[last] - begins[self.text]
        self.hash = spans_hash(low.astype(np.uint64) + np.uint64(1), first, last) if len(first) else np.zeros(0, np.uint64)
        breaks = np.flatnonzero(low == 10)
        self.line = np.searchsorted(breaks, first)
        self.line_first, self.line_last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(low)]])
        self.shingles = spans_hash(self.hash, at := np.arange(max(0, len(self.hash) - SHINGLE + 1)), at + SHINGLE) if len(self.hash) >= SHINGLE else np.zeros(0, np.uint64)


def signatures(shingles: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Band keys (spans, BANDS) of the shingles of each span."""
    at = np.stack([first, last], 1).ravel()
    padded = np.append(shingles, np.uint64(0))
    each, least = np.empty_like(padded), np.empty((len(SEEDS), len(first)), np.uint64)
    for row, seed in enumerate(SEEDS):
        np.bitwise_xor(padded, seed, out=each)
        np.multiply(each, np.uint64(0xD6E8FEB86659FD93), out=each)
        least[row] = np.minimum.reduceat(each, at)[::2]
    keys = np.zeros((BANDS, len(first)), np.uint64)
    for row in range(ROWS):
        keys = mixed(keys * np.uint64(BASE) + least[row::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
    return np.ascontiguousarray(keys.T).view(np.int64)


def first_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The place of the first least value in every ``wide`` neighbours."""
    at, size = np.arange(len(values)), 1
    while size < wide:
        step = min(size, wide - size)
        one, other = at[:-step], at[step:]
        at, size = np.where(values[other] < values[one], other, one), size + step
    return at


def anchors(words: Words) -> np.ndarray:
    """Words with the least shingle hash among SPREAD neighbours of their text, where a window of it begins."""
    at = first_least(words.shingles, SPREAD)
    at = at[words.text[: len(at)] == words.text[SPREAD + SHINGLE - 2 :]]
    at = at[np.diff(at, prepend=-1) > 0]
    at = at[at <= len(words.hash) - WINDOW]
    return at[words.text[at] == words.text[at + WINDOW - 1]]


def paragraph_rows(words: Words, seed: int) -> tuple:
    """Of each line that is long enough the text, the first and the last word, the id and the bands."""
    cuts = np.flatnonzero(np.diff(words.line)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(words.line)]])
    long = last - first >= SHINGLE
    first, last = first[long], last[long]
    line = words.line[first]
    uid = [xxhash.xxh64_intdigest(words.raw[a:b], seed) for a, b in zip(words.line_first[line].tolist(), words.line_last[line].tolist())]
    keys = signatures(words.shingles, first, last - SHINGLE + 1) if len(first) else np.zeros((0, BANDS), np.int64)
    return words.text[first], first, last - 1, np.array(uid, dtype=np.uint64).view(np.int64), keys


def unit_batch(kind: str, doc_id: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, key: np.ndarray, keys: np.ndarray | None) -> pa.RecordBatch:
    many = pa.list_(pa.int64())
    lists = pa.nulls(len(key), many) if keys is None else pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())
    columns = [pa.array(doc_id), *(pa.array(c.astype(np.int32)) for c in (start, end, words)), pa.array(key), lists, pa.repeat(kind, len(key))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "words", "key", "keys", "kind"])


def unit_rows(seed: int):
    """Paragraphs (words: their number, key: their id, keys: their bands) and windows (words: the place
    of the first word, key: the hash of all), of AT_ONCE bytes of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", AT_ONCE):
            doc_id, words = part.column("doc_id").to_numpy(), Words(part.column("text").to_pylist())
            text, first, last, uid, keys = paragraph_rows(words, seed)
            if len(uid):
                yield unit_batch("paragraph", doc_id[text], words.start[first], words.end[last], last - first + 1, uid, keys)
            at = anchors(words)
            if len(at):
                key = spans_hash(words.hash, at, at + WINDOW).view(np.int64)
                place = at - np.searchsorted(words.text, words.text[at])
                yield unit_batch("passage", doc_id[words.text[at]], words.start[at], words.end[at + WINDOW - 1], place, key, None)

    return run


def lines_of(docs: DataFrame, seed: int) -> DataFrame:
    """(uid, line): the lines of all texts with their ids; Spark's xxhash64 has the seed SEED."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select((F.xxhash64("line") if seed == SEED else reseeded(F.col("line"), seed)).alias("uid"), "line")


def reseeded(line: Column, seed: int) -> Column:
    @F.pandas_udf("bigint")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series(np.array([xxhash.xxh64_intdigest(v.encode(), seed) for v in values], dtype=np.uint64).view(np.int64))

    return hashed(line)


def clash(docs: DataFrame, units: DataFrame, seed: int) -> bool:
    """Whether unlike lines share an id: the bytes of lines whose id repeats are compared, by their extremes. Other lines
    that pass the sieve are compared as well."""
    repeated = cut(units.groupBy(F.col("key").alias("uid")).agg(F.count("*").alias("n")).where("n > 1").select("uid"))
    both = sifted(lines_of(docs, seed), repeated, "uid").groupBy("uid").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    unlike = not both.where("low <> high").isEmpty()
    release(docs.sparkSession)
    return unlike


def crowded(rows: DataFrame, id_: str) -> DataFrame:
    """(key, low, high, head): keys that a sample by id shows to hold very many rows of different ids, and one of these ids,
    another in each key."""
    some = rows.where(F.pmod(F.xxhash64(F.lit("crowded"), id_), F.lit(SAMPLED)) == 0)
    counts = some.groupBy("key").agg(F.count("*").alias("n"), F.min(id_).alias("low"), F.max(id_).alias("high"), F.min(F.struct(F.xxhash64(id_, "key"), id_))[id_].alias("head"))
    return cut(counts.where((F.col("n") >= CROWDED) & (F.col("low") < F.col("high"))).select("key", "low", "high", "head"))


def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of paragraphs whose exact Jaccard similarity over shingles is SIMILAR or more."""

    def shingles(text: str) -> set:
        words = text.encode().lower().split()
        return set(zip(*(words[i:] for i in range(SHINGLE))))

    for batch in batches:
        kept = []
        for a, b in zip(batch["one"], batch["other"]):
            a, b = shingles(a), shingles(b)
            kept.append(len(a & b) >= SIMILAR * len(a | b))
        yield batch.loc[kept, ["u", "v"]]


def clustered(rows: DataFrame, kind: str) -> DataFrame:
    """Stretches with their cluster's first document and whether they are its first stretch; clusters
    of one document only are left out. ``rows``: doc_id, start, end, words, component."""
    first = F.min(F.struct("doc_id", "start", "end")).alias("head")
    heads = cut(rows.groupBy("component").agg(first, F.max("doc_id").alias("most")).where("head.doc_id < most").select("component", "head"))
    out = rows.join(heads, "component")
    keep = (F.col("doc_id") == F.col("head.doc_id")) & (F.col("start") == F.col("head.start")) & (F.col("end") == F.col("head.end"))
    return out.select("doc_id", F.lit(kind).alias("kind"), "start", "end", "words", F.col("head.doc_id").alias("cluster_id"), keep.alias("keep"))


def block_links(uids: list[int], labels: list[int], lines: list[str]) -> list[tuple[int, int]]:
    """Links that join all paragraphs of a block which pairs of SIMILAR or more connect, labels being joined already."""
    if len(set(labels)) < 2:
        return []
    ids: dict[tuple, int] = {}
    sets = []
    for line in lines:
        words = line.encode().lower().split()
        sets.append(np.array(list({ids.setdefault(t, len(ids)) for t in zip(*(words[i:] for i in range(SHINGLE)))}), dtype=np.int64))
    sizes = np.array([len(x) for x in sets])
    flat, first = np.concatenate(sets), np.cumsum(sizes) - sizes
    label, waiting, has, out = np.array(labels), np.ones(len(uids), bool), np.zeros(len(ids), np.int64), []
    for one, mine in enumerate(sets):
        waiting[one] = False
        others = waiting & (label != label[one])
        if not others.any():
            continue
        has[mine] = 1
        both = np.add.reduceat(has[flat], first)
        has[mine] = 0
        for other in np.flatnonzero(others & (both >= SIMILAR * (sizes + sizes[one] - both))):
            if label[other] != label[one]:
                out.append((uids[one], uids[other]))
                label[label == label[other]] = label[one]
    return out


def blockwise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``block_links`` of each block of rows sorted by block; a block may go over several batches."""
    block, rows = None, []
    for batch in batches:
        out = []
        for *of, uid, label, line in zip(*(batch[c] for c in ("key", "i", "j", "uid", "label", "line"))):
            if of != block:
                out += block_links(*map(list, zip(*rows))) if rows else []
                block, rows = of, []
            rows.append((uid, label, line))
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    yield pd.DataFrame(block_links(*map(list, zip(*rows))) if rows else [], columns=["u", "v"], dtype="int64")


def joined(rest: DataFrame, named: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) with all pairs in a band of ``rest`` (key, uid) looked at: first inside
    blocks of a band, then in bands still apart for every two blocks."""
    for crossed in (False, True):
        known = named.withColumnRenamed("node", "uid")
        sizes = texts.select("uid", F.char_length("line").alias("size"))
        labelled = cut(rest.join(known, "uid", "left").join(sizes, "uid").select("key", "uid", "size", F.coalesce("component", "uid").alias("label")))
        release(rest.sparkSession)
        bands = labelled.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SIZE)).cast("int").alias("blocks")
        live = bands.where("low < high").select("key", blocks)
        live = cut(live.where("blocks > 1") if crossed else live)
        if not (n := live.count()):
            break
        block = F.pmod(F.xxhash64("uid", "key"), F.col("blocks")).cast("int")
        met = (labelled.join(F.broadcast(live), "key") if n <= BROADCAST_IDS else sifted(labelled, live, "key").join(live, "key")).withColumn("i", block)
        met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if crossed else F.col("i"))
        met = met.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "uid", "label").join(texts, "uid")
        new = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(blockwise, "u bigint, v bigint")
        named = cut(components(cut(new).unionByName(named.select(F.col("node").alias("u"), F.col("component").alias("v")))))
        release(rest.sparkSession)
    return named


def paragraphs(docs: DataFrame, units: DataFrame, seed: int) -> DataFrame:
    """Near-equal paragraphs. Copies collapse before bands are dealt out, and each band is dealt out
    once, BANDS_AT_ONCE of a paragraph's at a time, so that the disk holds the shuffle of these only; the few
    crowded bands get their representative by a small join instead."""
    distinct = cut(units.groupBy(F.col("key").alias("uid")).agg(F.any_value("keys").alias("keys")))
    release(units.sparkSession)
    bands_of = lambda first, n: distinct.select("uid", F.explode(F.slice("keys", first + 1, n)).alias("key"))
    order = F.struct(F.xxhash64("uid", "key"), "uid")
    many = crowded(bands_of(0, BANDS), "uid").select("key", F.col("head").alias("v"))
    side = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    w = Window.partitionBy("key")
    parts = []
    for first in range(0, BANDS, BANDS_AT_ONCE):
        bands = bands_of(first, BANDS_AT_ONCE)
        usual = bands.join(side, "key", "left_anti").select("key", "uid", F.min(order).over(w)["uid"].alias("v"))
        full = bands.join(side, "key").select("key", "uid", "v")
        parts.append(cut(usual.unionByName(full).where("uid <> v")))
        release(units.sparkSession)
    rest = reduce(DataFrame.unionByName, parts)
    pairs = cut(rest.select(F.greatest("uid", "v").alias("u"), F.least("uid", "v").alias("v")).distinct())
    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("uid")).distinct())
    release(docs.sparkSession)
    texts = sifted(lines_of(docs, seed), wanted, "uid").groupBy("uid").agg(F.min("line").alias("line"))
    texts = cut(texts.join(wanted.hint("merge"), "uid", "left_semi"))
    one, other = (texts.select(F.col("uid").alias(k), F.col("line").alias(n)) for k, n in (("u", "one"), ("v", "other")))
    links = pairs.join(one, "u").join(other, "v").select("u", "v", "one", "other").mapInPandas(similar, "u bigint, v bigint")
    named = joined(rest.select("key", "uid"), cut(components(links)), texts).withColumnRenamed("node", "key")
    rows = units.select("doc_id", "start", "end", "words", "key").join(named, "key", "left").select("doc_id", "start", "end", "words", F.coalesce("component", "key").alias("component"))
    rows = cut(rows)
    release(docs.sparkSession)
    return clustered(rows, "paragraph")


def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the asked windows of each text the hashes of the words beside them, nearest first, and the code
    points where these words begin (before a window) or end (after it)."""
    for batch in batches:
        rows = []
        for _, some in batch.groupby((batch["text"].str.len() + 64).cumsum() // AT_ONCE):
            words = Words(some["text"].tolist())
            text = np.repeat(np.arange(len(some)), some["places"].map(len))
            at, keys, lefts = (np.concatenate([np.asarray(x, dtype=kind) for x in some[c]]) for c, kind in (("places", np.int64), ("keys", np.int64), ("lefts", bool)))
            low, high = (np.searchsorted(words.text, text, side=side) for side in ("left", "right"))
            at += low
            fits = at <= high - WINDOW
            fits[fits] = spans_hash(words.hash, at[fits], at[fits] + WINDOW).view(np.int64) == keys[fits]
            hashes, doc_id = words.hash.view(np.int64), some["doc_id"].to_numpy()[text]
            for doc, begin, stop, place, key, left in zip(*(x[fits].tolist() for x in (doc_id, low, high, at, keys, lefts))):
                near = slice(max(begin, place - SPREAD + 1), place) if left else slice(place + WINDOW, min(stop, place + WINDOW + SPREAD - 1))
                turn = -1 if left else 1
                rows.append((doc, place - begin, key, left, hashes[near][::turn], (words.start if left else words.end)[near][::turn]))
        yield pd.DataFrame(rows, columns=["doc_id", "place", "key", "left", "hashes", "points"])


def common(one: str, other: str) -> Column:
    """How many elements two arrays have in common from their first on."""
    differs = F.array_position(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(one)).cast("int")


def widened(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, of, shift, low, high, point, kept_point): words beside the runs at the ends of removable
    stretches that equal those beside the kept occurrence, and the code points where they begin or end."""
    along = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.withColumn("opens", F.when(F.col("first") > before + WINDOW, 1).otherwise(0)).withColumn("part", F.sum("opens").over(along))
    part = Window.partitionBy("doc_id", "part")
    left, right = F.col("first") - F.min("first").over(part) < SPREAD, F.max("last").over(part) - F.col("last") < SPREAD
    side = lambda at, place, key, is_left: F.when(at, F.struct(F.col(place).alias("place"), F.col(key).alias("key"), F.lit(is_left).alias("left")))
    sides = numbered.withColumns({"l": side(left, "first", "first_key", True), "r": side(right, "last", "last_key", False)})
    edges = cut(sides.select("doc_id", "of", "shift", F.explode(F.array_compact(F.array("l", "r"))).alias("edge")).select("doc_id", "of", "shift", "edge.*"))
    kept = edges.select(F.col("of").alias("doc_id"), (F.col("place") + F.col("shift")).alias("place"), "key", "left")
    asked = edges.select("doc_id", "place", "key", "left").unionByName(kept).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("place", "key", "left")).alias("asked"))
    asked = cut(asked.select("doc_id", F.col("asked.place").alias("places"), F.col("asked.key").alias("keys"), F.col("asked.left").alias("lefts")))
    found = sifted(docs, asked, "doc_id").join(asked, "doc_id").select("doc_id", "text", "places", "keys", "lefts").mapInPandas(beside, BESIDE)
    found = cut(found.dropDuplicates(["doc_id", "place", "key", "left"]))
    release(docs.sparkSession)
    tops = found.select(F.col("doc_id").alias("of"), F.col("place").alias("_at"), "key", "left", F.col("hashes").alias("kept_hashes"), F.col("points").alias("kept_points"))
    met = edges.withColumn("_at", F.col("place") + F.col("shift")).join(found, ["doc_id", "place", "key", "left"]).join(tops, ["of", "_at", "key", "left"])
    met = met.withColumn("n", common("hashes", "kept_hashes")).where("n > 0")
    low = F.when(F.col("left"), F.col("place") - F.col("n")).otherwise(F.col("place") + WINDOW)
    points = [F.get(c, F.col("n") - 1).alias(n) for c, n in (("points", "point"), ("kept_points", "kept_point"))]
    return cut(met.select("doc_id", "of", "shift", low.alias("low"), (low + F.col("n")).alias("high"), *points))


def passages(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Stretches of exactly repeated words inside texts. Windows are read and dealt out by key once;
    those of the few crowded keys are known to repeat, so each such key is spread over SALTS parts."""
    windows = windows.select("doc_id", F.col("words").alias("place"), "start", "end", "key")
    many = crowded(windows, "doc_id").select("key", F.lit(True).alias("many"))
    few = many.count() <= BROADCAST_IDS
    place = F.struct("doc_id", "place", "start", "end")
    # windows of all other keys are one group, which shrinks to a row where it is read
    marked = windows.join(F.broadcast(many) if few else many, "key", "left").withColumn("key", F.when(F.col("many"), F.col("key")))
    tops = cut(marked.groupBy("key").agg(F.min(F.when(F.col("many"), place)).alias("top"))).where("key is not null")
    salt = F.when(F.col("top").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    w = Window.partitionBy("key", "salt")
    dealt = windows.join(F.broadcast(tops) if few else tops, "key", "left").withColumn("salt", salt)
    seen = dealt.withColumns({"_low": F.min(place).over(w), "_high": F.max("doc_id").over(w)})
    found = seen.where("_low.doc_id < _high or top is not null").select("doc_id", "place", "start", "end", "key", F.coalesce("top", "_low").alias("top"))
    others = found.where("doc_id <> top.doc_id or place <> top.place").select("doc_id", "place", "start", "end", "key", F.col("top.doc_id").alias("of"), (F.col("top.place") - F.col("place")).alias("shift"), F.col("top.start").alias("kept_start"), F.col("top.end").alias("kept_end"))
    along = Window.partitionBy("doc_id", "of", "shift").orderBy("place")
    opens = F.when(F.col("place") > F.lag("place").over(along) + WINDOW, 1).otherwise(0)
    numbered = others.withColumn("opens", opens).withColumn("part", F.sum("opens").over(along))
    ends = [F.min("place").alias("first"), F.max("place").alias("last"), F.min_by("key", "place").alias("first_key"), F.max_by("key", "place").alias("last_key")]
    ends += [F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept_start").alias("kept_start"), F.max("kept_end").alias("kept_end")]
    runs = cut(numbered.groupBy("doc_id", "of", "shift", "part").agg(*ends).drop("part"))
    release(docs.sparkSession)

    link = F.xxhash64("of", F.col("first") + F.col("shift"), F.col("last") + F.col("shift")).alias("link")
    places = ["doc_id", "of", "shift", F.col("first").alias("low"), (F.col("last") + WINDOW).alias("high")]
    more = widened(docs, runs.select("doc_id", "of", "shift", "first", "last", "first_key", "last_key"))
    point = [F.col("point").alias(c) for c in ("start", "end")] + [F.col("kept_point").alias(c) for c in ("kept_start", "kept_end")]
    both = runs.select(*places, "start", "end", "kept_start", "kept_end", link).unionByName(more.select("doc_id", "of", "shift", "low", "high", *point, F.lit(None).cast("bigint").alias("link")))
    kept = [F.col("of").alias("doc_id"), *[(F.col(c) + F.col("shift")).alias(c) for c in ("low", "high")], F.col("kept_start").alias("start"), F.col("kept_end").alias("end"), "link"]
    spans = both.select("doc_id", "low", "high", "start", "end", "link", F.lit(False).alias("keep")).unionByName(both.select(*kept, F.lit(True).alias("keep")).distinct())
    inside = Window.partitionBy("doc_id", "keep").orderBy("low", "high")
    before = F.max("high").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("low") > before, 1).otherwise(0)
    parts = spans.withColumn("opens", apart).withColumn("part", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = cut(parts.withColumn("node", F.xxhash64("doc_id", "keep", "part")).drop("opens", "part"))
    release(docs.sparkSession)
    names = merged.where("keep").select("link", F.col("node").alias("v"))
    links = merged.where("not keep").select("link", F.col("node").alias("u")).join(names, "link").select("u", "v").distinct()
    named = cut(components(links))
    whole = merged.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keep").alias("keep"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("high") - F.min("low")).alias("words"))
    rows = cut(whole.join(named, "node"))
    release(docs.sparkSession)
    first = rows.groupBy("component").agg(F.min("doc_id").alias("cluster_id"))
    return rows.join(first, "component").select("doc_id", F.lit("passage").alias("kind"), "start", "end", "words", "cluster_id", "keep")


def repeated_passages(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts are read once; their paragraphs and windows are written to the shared folder."""
    spark = df.sparkSession
    ship(spark)
    docs = narrow(df, doc_id=doc_id, text=text).where("doc_id is not null and length(text) > 0")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for seed in range(SEED, SEED + 8):
        folder = shared_folder(spark)
        docs.mapInArrow(unit_rows(seed), UNITS).write.partitionBy("kind").option("compression", "zstd").parquet(folder)
        units = spark.read.schema(UNITS).parquet(folder)
        of_kind = lambda kind: units.where(F.col("kind") == kind)  # noqa: B023, E731
        if not clash(docs, of_kind("paragraph"), seed):
            break
    else:
        raise ValueError("unlike lines share an id under every seed")
    near = paragraphs(docs, of_kind("paragraph"), seed)
    release(spark)
    return near.unionByName(passages(docs, of_kind("passage")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: repeated passages of all ``documents``."""
    return repeated_passages(table(spark, sf_dir, "documents"))
