"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text, about, that a Python task holds at a time.
SLICE = 1 << 20
#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of one row of a sieve, and its most rows: 4 MB, however many ids it is made of.
SIEVE_BITS, SIEVE_ROWS = 1 << 15, 1 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Where that is unset and
    all run in one process on one machine, a temporary folder; a cluster without it is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="tidemark-")).as_uri()
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark removes them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(df: DataFrame, rows: int, each: int) -> int:
    """A number of partitions for ``rows`` rows, about ``each`` of them in one, that keeps every core busy."""
    return min(100_000, max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def sifted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids``, and a few others, before an exact join or where others do no harm.

    A hash of each id sets a bit, and the bits are broadcast instead of the ids: 16 for each, SIEVE_BITS * SIEVE_ROWS at
    most, so that the driver's memory does not grow with the ids. Past 2 million ids more of the others pass.
    """
    bits = SIEVE_BITS * min(SIEVE_ROWS, max(1, -(-16 * ids.count() // SIEVE_BITS)))
    at = F.pmod(F.xxhash64(F.lit("sieve"), key), F.lit(bits))
    row, place = F.floor(at / SIEVE_BITS), F.pmod(at, F.lit(SIEVE_BITS)).cast("int")
    dealt = ids.select(row.alias("_row"), place.alias("_place")).repartition("_row")
    sieve = dealt.groupBy("_row").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.pmod(place, F.lit(8))) == 1
    return rows.join(F.broadcast(sieve), (row == F.col("_row")) & is_set, "left_semi")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_bucket(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under private names, so extra columns of the input cannot clash."""
    return df.select([F.col(f"`{have}`").alias(want) for want, have in columns.items()])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the place that driver and executors share."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows where about ``most`` bytes of ``text`` are full."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(size + 64) // most, append=-1)) + 1
        for start, end in zip([0, *ends[:-1]], ends):
            yield batch.slice(start, end - start)


def kept_bytes(kept: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z to a-z, ``kept`` as they are, everything else to a space."""
    lower = {65 + i: 97 + i for i in range(26)}
    return bytes(lower.get(b, b if b in kept else 32) for b in range(256))


def split_words(text: bytes | None, table: bytes, piece: int = SLICE) -> Iterator[list[bytes]]:
    """The words that ``table`` leaves of a UTF-8 text (null: none), in lists of about ``piece`` bytes of text at a time."""
    rest, at = (text or b"").translate(table), 0
    while at < len(rest):
        end = rest.find(b" ", at + piece)
        end = len(rest) if end < 0 else end
        yield rest[at:end].split()
        at = end


def texts_mapped(df: DataFrame, text: str, added: str, work: Callable[[list[str]], list], *, keep_text: bool = False) -> DataFrame:
    """``df`` with the columns ``added`` (a schema) that ``work`` makes of a list of texts, null read as empty.

    Every other column passes as it is, in Arrow form: ids beside nulls keep their type and value.
    ``text`` itself goes unless it is to be kept.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(added).fields
    names = [c for c in df.columns if keep_text or c != text]
    kinds = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in new]
    schema = T.StructType([df.schema[c] for c in names] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text):
            made = work([t or "" for t in part.column(text).to_pylist()])
            columns = [part.column(c) for c in names] + [pa.array(m, k) for m, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)
