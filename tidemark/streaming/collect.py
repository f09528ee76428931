"""From landed responses to stored bars, actions, directories, issues and manifests, in one restartable stream.

A collector lands one row for each request it was asked for: its parameters, and the response if it fetched one.
Each micro-batch goes through the chain as one set of joins: public parameters and request id, the latest stored
success of the request, the response's category, its normalisation by source, the checks of its bars, and a
manifest that says what became of it. Nothing is raised on data: a request that fails has a manifest with its
reason, and the others go on.

A batch goes to several sinks. Every sink keeps a batch in partitions of its own, which writing the batch again
replaces, and the batch's row in the ledger is written last. What readers see (``committed``) is what the ledger
has, so a run that is killed between two sinks neither loses nor doubles anything when it goes on.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.values import digest, first_reason
from tidemark.operators import bars as quality
from tidemark.operators.imports import REJECTING, public_parameters
from tidemark.sources import providers
from tidemark.sources.store import BUCKET, Conflict, bucket_of, found, of_buckets, stored

#: What a collector lands. A row without status, error and body is a request that may be served from what is stored.
LANDED = "parameters map<string,string>, http_status int, error string, fetched_at timestamp, recorded_at timestamp, body string"
SINKS = ("raw", "bars", "actions", "directory", "issues", "manifests")
BARS = ("open", "high", "low", "close", "adjusted_close", "volume", "price_semantics", "observation_status")
#: Batches in a ledger that are broadcast to those who read its sinks.
BROADCAST_BATCHES = 100_000


def request_id(parameters: Column) -> Column:
    """The digest of a request's public parameters, whatever their order."""
    pairs = F.transform(F.array_sort(F.map_entries(parameters)), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return F.sha2(F.array_join(pairs, "&"), 256)


def public_url(url: Column) -> Column:
    """An address without user, port, fragment and any parameter but ``id``."""
    plain = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
    id_ = F.parse_url(url, F.lit("QUERY"), F.lit("id"))
    return F.concat(plain, F.when(id_.isNotNull(), F.concat(F.lit("?id="), id_)).otherwise(F.lit("")))


def committed(spark: SparkSession, root: str, sink: str) -> DataFrame | None:
    """The rows of a sink that whole batches wrote."""
    rows, ledger = found(spark, f"{root}/{sink}"), found(spark, f"{root}/ledger")
    if rows is None or ledger is None:
        return None
    return of_ledger(rows, ledger).drop("run", "batch", BUCKET)


def of_ledger(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    whole = ledger.select(F.col("run").cast("string"), F.col("batch").cast("bigint"))
    keys = F.broadcast(whole) if ledger.count() <= BROADCAST_BATCHES else whole
    return rows.withColumns({"run": F.col("run").cast("string"), "batch": F.col("batch").cast("bigint")}).join(keys, ["run", "batch"], "left_semi")


def latest_success(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame | None:
    """Of the asked requests (request_id, bucket) the latest stored manifest that succeeded: only their buckets are read."""
    rows, ledger = of_buckets(asked, f"{root}/manifests"), found(spark, f"{root}/ledger")
    if rows is None or ledger is None:
        return None
    good = of_ledger(rows, ledger).where("status in ('success', 'reprocessed')").join(asked.select(BUCKET, "request_id").distinct(), [BUCKET, "request_id"], "left_semi")
    last = F.max_by(F.struct("receipt_id", "raw_sha256", "code_version", "fetched_at"), F.struct("recorded_at", "receipt_id"))
    return good.groupBy("request_id").agg(last.alias("cached"))


def received(landed: DataFrame, root: str, code_version: str) -> DataFrame:
    """Landed rows with their public parameters, request id, the body to normalise, and the fate known before that.

    A request that was not fetched is served from its latest success: as it is if the same code made it, else by
    reprocessing the stored body. Rows of one request, time and content that were landed before are left out.
    """
    spark = landed.sparkSession
    public = public_parameters("parameters")
    url = F.try_element_at(public, F.lit("document_url"))
    unsafe = url.isNotNull() & ~F.coalesce(public_url(url) == url, F.lit(False))
    given = landed.select(
        F.when(unsafe, F.map_concat(F.map_filter(public, lambda k, _: k != "document_url"), F.create_map(F.lit("document_url"), F.coalesce(public_url(url), F.lit(""))))).otherwise(public).alias("request_parameters"),
        "http_status", "error", "fetched_at", "recorded_at", "body", unsafe.alias("unsafe"),
    )
    fetched = F.col("http_status").isNotNull() | F.col("error").isNotNull() | F.col("body").isNotNull()
    rows = given.withColumns({"request_id": request_id(F.col("request_parameters")), "network_performed": fetched, "source": F.try_element_at("request_parameters", F.lit("source"))})
    rows = rows.withColumn("raw_sha256", F.when(F.length("body") > 0, F.sha2(F.col("body").cast("binary"), 256)))
    rows = rows.withColumn("receipt_id", digest(F.col("request_id"), F.col("fetched_at"), F.col("raw_sha256"), F.col("http_status"), F.col("error")))
    rows = stored(rows.withColumn(BUCKET, bucket_of(["request_id"])).dropDuplicates(["receipt_id"]))
    known = of_buckets(rows, f"{root}/manifests")
    ledger = found(spark, f"{root}/ledger")
    cached = latest_success(spark, root, rows)
    if known is None or ledger is None or cached is None:
        return rows.withColumns({"cached": F.lit(None).cast("struct<receipt_id:string,raw_sha256:string,code_version:string,fetched_at:timestamp>"), "stored_body": F.lit(None).cast("string")})
    seen = of_ledger(known, ledger).where("network_performed").select(BUCKET, "receipt_id")
    rows = rows.join(seen, [BUCKET, "receipt_id"], "left_anti").join(cached, "request_id", "left")
    bodies = of_ledger(of_buckets(rows, f"{root}/raw"), ledger).select("request_id", F.col("raw_sha256").alias("_sha"), F.col("body").alias("stored_body")).dropDuplicates(["request_id", "_sha"])
    again = ~F.col("network_performed") & (F.col("cached.code_version") != code_version)
    return rows.withColumn("_sha", F.when(again, F.col("cached.raw_sha256"))).join(bodies, ["request_id", "_sha"], "left").drop("_sha")


def normalised(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """bars, actions and directory of (receipt, source, start, end, body), every one with its issue; sources without a normaliser give none."""
    of = lambda source: rows.where(F.col("source") == source).select(F.col("receipt").alias("request_id"), "body", "start", "end")
    inside = F.col("issue").isNotNull() | F.col("trading_date").isNull() | (F.coalesce(F.col("trading_date") >= F.col("start").try_cast("date"), F.lit(True)) & F.coalesce(F.col("trading_date") <= F.col("end").try_cast("date"), F.lit(True)))
    chart = providers.chart_json(of("chart_json")).join(of("chart_json").select("request_id", "start", "end"), "request_id").where(inside).drop("start", "end")
    array = providers.array_json(of("array_json"), F.coalesce("start", F.lit("0001-01-01")), F.coalesce("end", F.lit("9999-12-31")))
    bars = chart.unionByName(array).unionByName(providers.keyed_json(of("keyed_json"))).unionByName(providers.csv_text(of("csv")))
    return bars.withColumnRenamed("request_id", "receipt"), providers.chart_actions(of("chart_json")).withColumnRenamed("request_id", "receipt"), providers.directory_text(of("directory")).withColumnRenamed("request_id", "receipt")


def fates(rows: DataFrame, bars: DataFrame, actions: DataFrame, directory: DataFrame, code_version: str) -> DataFrame:
    """The manifest of every request: status, counts, period and the digest of what it was normalised to."""
    codes = bars.where("issue is null").select("receipt", F.explode(quality.issue_codes()).alias("code")).where(F.col("code").isin(*REJECTING))
    twice = quality.duplicates(bars.where("issue is null"), ["receipt", "trading_date"], list(BARS[:6]), list(BARS[:6])).select("receipt", "code")
    faults = bars.where("issue is not null").select("receipt", F.col("issue").alias("fault"), F.lit(0).alias("rank"))
    faults = faults.unionByName(codes.unionByName(twice).select("receipt", F.lit("normalization_validation_failure").alias("fault"), F.lit(1).alias("rank")))
    worst = faults.groupBy("receipt").agg(F.min(F.struct("rank", "fault"))["fault"].alias("fault"))
    mark = lambda df, name, *of: df.select("receipt", F.lit(name).alias("family"), digest(*[F.col(c) for c in of]).alias("row"), F.col("trading_date") if name == "bars" else F.lit(None).cast("date").alias("trading_date"))
    every = mark(bars.where("issue is null"), "bars", "trading_date", *BARS).unionByName(mark(actions, "actions", "event_type", "event_date", "numerator", "denominator", "amount")).unionByName(mark(directory, "directory", "symbol", "security_name", "test_issue"))
    counts = every.groupBy("receipt").agg(
        F.count("*").alias("row_count"), *[F.count_if(F.col("family") == f).alias(f"n_{f}") for f in ("bars", "actions", "directory")], F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("family", "row"))), ""), 256).alias("normalized_sha256"),  # a response's own rows
    )
    rows = rows.join(worst, "receipt", "left").join(counts, "receipt", "left")
    category = F.coalesce(F.col("error"), providers.http_category(F.col("http_status")))
    known = F.col("source").isin("chart_json", "array_json", "keyed_json", "csv", "directory")
    status = F.when(F.col("unsafe"), "unsafe_document_url").when(~F.col("network_performed") & F.col("cached").isNull(), "not_fetched").when(~F.col("network_performed") & (F.col("cached.code_version") == code_version), "cached")
    status = status.when(F.col("network_performed") & (category != "success"), category).when(F.trim(F.coalesce("body", F.lit(""))) == "", "empty_response").when(~F.coalesce(known, F.lit(False)), "unknown_provider")
    status = status.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("row_count").isNull(), "empty_response").when(F.col("network_performed"), "success").otherwise("reprocessed")
    return rows.withColumn("status", status).drop("fault")


def chain(landed: DataFrame, root: str, code_version: str) -> dict[str, DataFrame]:
    """What one batch of landed rows gives to each sink."""
    rows = stored(received(landed, root, code_version))
    own = F.col("network_performed")
    again = rows.withColumns({
        "body": F.when(own, F.col("body")).otherwise(F.col("stored_body")), "receipt": F.col("receipt_id"), "raw_sha256": F.when(own, F.col("raw_sha256")).otherwise(F.col("cached.raw_sha256")),
        "start": F.try_element_at("request_parameters", F.lit("start")), "end": F.try_element_at("request_parameters", F.lit("end")), "fetched_at": F.when(own, F.col("fetched_at")).otherwise(F.col("cached.fetched_at")),
    })
    usable = again.where(~F.col("unsafe") & (~own | F.col("error").isNull() & F.col("http_status").between(200, 299)) & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    bars, actions, directory = (stored(x) for x in normalised(usable))
    judged = stored(fates(again, bars, actions, directory, code_version))
    good = judged.where("status in ('success', 'reprocessed')").select("receipt", "request_id", "source", "raw_sha256", "fetched_at")
    names = ["receipt_id", "request_id", "source", "request_parameters", "http_status", "fetched_at", "recorded_at", "network_performed", "status", "raw_sha256", "row_count", "n_bars", "n_actions", "n_directory", "first_date", "last_date"]
    manifests = judged.select(*names, F.when(F.col("row_count").isNotNull(), F.col("normalized_sha256")).alias("normalized_sha256"), F.when(~own, F.col("cached.receipt_id")).alias("origin_receipt_id"), F.lit(code_version).alias("code_version"))
    broken = bars.where("issue is not null").select("receipt", "trading_date", F.col("issue").alias("code")).unionByName(bars.where("issue is null").select("receipt", "trading_date", F.explode(quality.issue_codes()).alias("code")))
    kept = lambda df: df.join(good, "receipt").withColumnRenamed("receipt", "receipt_id")
    return {
        "raw": rows.where("raw_sha256 is not null").select("request_id", "raw_sha256", "body").distinct(),
        "bars": kept(bars.where("issue is null").drop("issue")),
        "actions": kept(actions),
        "directory": kept(directory),
        "issues": broken.join(judged.select("receipt", "request_id"), "receipt").withColumnRenamed("receipt", "receipt_id"),
        "manifests": manifests,
    }


def write_batch(landed: DataFrame, batch: int, root: str, run: str, code_version: str) -> None:
    """One batch into all sinks, then into the ledger; a batch that the ledger has is left alone."""
    spark = landed.sparkSession
    landed = stored(landed)
    mark = landed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json("parameters"), "fetched_at", "body", "http_status", "error").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content")).first()
    ledger = found(spark, f"{root}/ledger")
    done = None if ledger is None else ledger.where((F.col("run").cast("string") == run) & (F.col("batch") == batch)).first()
    if done is not None:
        if (done["n"], done["content"]) != (mark["n"], mark["content"]):
            raise Conflict(f"batch {batch} of {run} was written with other rows: a new checkpoint needs a new run")
        return
    for sink, rows in chain(landed, root, code_version).items():
        looked_up = sink in ("raw", "manifests")
        by = [BUCKET, "run", "batch"] if looked_up else ["run", "batch"]
        marked = rows.withColumns({"run": F.lit(run), "batch": F.lit(batch)})
        marked = marked.withColumn(BUCKET, bucket_of(["request_id"])).repartition(BUCKET) if looked_up else marked
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{sink}")
    row = spark.createDataFrame([(mark["n"], mark["content"], run, batch)], "n bigint, content string, run string, batch bigint")
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(f"{root}/ledger")


def collect(stream: DataFrame, root: str, checkpoint: str, *, code_version: str = "1", run: str | None = None) -> StreamingQuery:
    """Take a stream of landed responses (LANDED) through the chain. ``run`` names the checkpoint in the ledger."""
    name = "r-" + (run or sha256(checkpoint.encode()).hexdigest()[:16])  # no folder name that reads as a number

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, root, name, code_version)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health(manifests: DataFrame) -> DataFrame:
    """status, n, n_requests and the last time of it: what became of requests."""
    last = Window.partitionBy("request_id").orderBy(F.desc("recorded_at"), F.desc("receipt_id"))
    marked = manifests.withColumn("_last", F.row_number().over(last) == 1)
    return marked.groupBy("status").agg(F.count("*").alias("n"), F.count_if("_last").alias("n_latest"), F.max("recorded_at").alias("last_at"))
