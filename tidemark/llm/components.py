"""Connected components of a link table by alternating large and small stars.

Both steps are joins of the links with each node's lowest neighbour, so nothing is gathered by
node; a hub's links are split by the adaptive skew join. Each round is written to the checkpoint
folder, every second one as a table of its own: a checkpoint goes on with the size that Spark guesses
for it, a join multiplies the sizes of its sides, and so over many rounds the digits of that size would
outgrow the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, parts_for, release, shared_folder

#: About the links of one partition: rounds over few links run in few tasks, however many partitions a shuffle has.
LINKS_EACH = 200_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, whose size Spark reads off its files."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _signature(links: DataFrame):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()


def components(links: DataFrame) -> DataFrame:
    """From links (u, v), bigint and in any direction, to (node, component): the smallest reachable node.

    Self links and repeats do no harm; only nodes with a link to another node are returned; an empty
    table gives an empty table.
    """
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, rounds = _signature(links), 0
    few = lambda df, keep=cut: keep(df.coalesce(parts_for(df, before[0], LINKS_EACH)))
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        links = few(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = few(links.groupBy("u").agg(F.min("v").alias("m")))
        moved = links.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rounds += 1
        links = few(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), written if rounds % 2 == 0 else cut)
        after = _signature(links)
        if after == before:
            break
        before = after
        # small as they are, each round has files for every partition, and its steps leave garbage on the driver
        del both, moved, lowest
        release(links.sparkSession)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
