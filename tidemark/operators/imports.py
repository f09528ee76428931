"""Import of landed artifacts: manifest and content checks, receipts, valid versions and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import digest, first_reason
from tidemark.operators import ingest
from tidemark.sources import store

SCHEMA = "1.0.0"
#: Request parameters that a manifest may hold; anything else could be a credential.
PUBLIC = ("source", "kind", "symbol", "start", "end", "outputsize", "auth_mode", "document_url")
#: Codes of bar checks that reject a whole artifact.
REJECTING = ("missing_column", "wrong_type", "invalid_date", "negative_volume", "inconsistent_ohlc", "duplicate_key", "conflicting_duplicate", "negative_price", "nonfinite_price")
#: Published beginnings of access tokens, each followed by the token itself.
TOKEN_STARTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")
CREDENTIAL = f"(?:{'|'.join(TOKEN_STARTS)})[0-9A-Za-z_]"
#: What a manifest may say beside what it has to, with the type that is taken where a batch has no such column.
OPTIONAL = {"input_domain": "string", "network_performed": "boolean", "http_status": "int", "origin_receipt_id": "string", "code_sha256": "string", "normalized_sha256": "string", "found_normalized_sha256": "string", "provenance": "map<string,string>", "processing_completed_at": "timestamp_ntz"}
#: What a receipt is; a receipt id that comes again with anything else is another event.
EVENT = ("source", "request_id", "fetched_at", "network_performed", "http_status", "status", "sha256", "file_size")


def public_parameters(parameters: str) -> Column:
    """The allowed part of a map of request parameters."""
    return F.map_filter(parameters, lambda k, _: k.isin(*PUBLIC))


def manifest_fault(now: Column) -> Column:
    """Why a manifest (request_parameters: map) is not taken, by the first fault."""
    given = F.col("request_parameters")
    return first_reason(
        (~F.coalesce(F.col("schema_version") == SCHEMA, F.lit(False)), "unsupported_manifest_schema"),
        (F.col("source").isNull() | F.col("request_id").isNull() | F.col("status").isNull() | F.col("fetched_at").isNull() | given.isNull(), "missing_manifest_column"),
        (F.size(public_parameters("request_parameters")) < F.size(given), "unsafe_manifest_parameters"),
        (~F.coalesce(F.col("source") == given["source"], F.lit(False)), "manifest_source_mismatch"),
        (F.exists(F.map_values(given), lambda v: F.coalesce(F.rlike(v, F.lit(CREDENTIAL)), F.lit(False))), "unsafe_manifest_credentials"),
        (F.col("fetched_at") > now, "receipt_in_the_future"),
    )


def raw_fault() -> Column:
    """Why the raw bytes of a manifest (found_sha256, found_size: what is there) do not fit it."""
    has = F.col("raw_path").isNotNull()
    wrong = ~F.coalesce((F.col("found_sha256") == F.col("sha256")) & (F.col("found_size") == F.col("file_size")), F.lit(False))
    return first_reason((has & wrong, "raw_hash_or_size_mismatch"), (~has & (F.col("sha256").isNotNull() | (F.col("status") == "success")), "missing_raw_file"))


def content_faults(manifests: DataFrame, rows: DataFrame, issues: DataFrame) -> DataFrame:
    """manifest_sha256 and fault of normalised rows: bars that fail a check (issues: artifact_id, code), or rows whose
    provenance or receipt time is not their manifest's."""
    facts = manifests.select("manifest_sha256", "artifact_id", F.col("sha256").alias("_sha"), F.col("source").alias("_source"), F.col("fetched_at").alias("_at"))
    bad = issues.where(F.col("code").isin(*REJECTING)).select("artifact_id").distinct().join(facts, "artifact_id").select("manifest_sha256", F.lit("normalized_price_validation_failure").alias("fault"), F.lit(0).alias("_order"))
    fault = first_reason((~(F.col("raw_sha256").eqNullSafe(F.col("_sha")) & F.col("source").eqNullSafe(F.col("_source"))), "row_provenance_mismatch"), (~F.col("row_fetched_at").eqNullSafe(F.col("_at")), "row_receipt_time_mismatch"))
    other = rows.select("artifact_id", "raw_sha256", "source", "row_fetched_at").distinct().join(facts, "artifact_id").withColumn("fault", fault).where("fault is not null").select("manifest_sha256", "fault", F.when(F.col("fault") == "row_provenance_mismatch", 1).otherwise(2).alias("_order"))
    return bad.unionByName(other).groupBy("manifest_sha256").agg(F.min_by("fault", "_order").alias("fault"))


def normalized_fault() -> Column:
    """Why a successful manifest's normalised artifact is not taken: its response, digest, provenance or clocks do not fit."""
    said = F.col("provenance")
    claims = {"raw_sha256": F.col("sha256"), "request_id": F.col("request_id"), "code_sha256": F.col("code_sha256"), "schema_version": F.lit(SCHEMA)}
    torn = F.lit(False)
    for name, value in claims.items():
        torn = torn | ~F.try_element_at(said, F.lit(name)).eqNullSafe(value)
    return F.when(
        F.col("status") == "success",
        first_reason(
            (F.col("http_status").isNotNull() & ~F.col("http_status").between(200, 299), "successful_artifact_with_failed_http"),
            (F.col("normalized_sha256").isNotNull() & ~F.col("normalized_sha256").eqNullSafe(F.col("found_normalized_sha256")), "normalized_hash_mismatch"),
            (said.isNotNull() & torn, "normalized_provenance_mismatch"),
            (F.col("fault").isNotNull(), "fault"),
            (F.col("processing_completed_at") < F.col("fetched_at"), "processing_before_receipt"),
        ),
    )


def manifest_digest(manifests: DataFrame) -> Column:
    """The digest of all that a manifest says, maps by key; ``found_`` columns are what is there, not what it says."""
    said = [c for c in sorted(manifests.columns) if not c.startswith("found_")]
    maps = {f.name for f in manifests.schema if f.dataType.typeName() == "map"}
    return digest(*[F.to_json(F.array_sort(F.map_entries(c))) if c in maps else F.col(c) for c in said])


def batch_of(manifests: DataFrame, domain: str | None) -> DataFrame:
    """A batch with all columns that checks read, the digest of each manifest, and its receipt id; equal manifests once."""
    out = manifests.withColumn("manifest_sha256", manifest_digest(manifests))
    for name, kind in OPTIONAL.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(domain if name == "input_domain" else None).cast(kind))
    if "network_performed" not in manifests.columns:
        out = out.withColumn("network_performed", F.when(F.col("reprocessed"), False))
    return out.dropDuplicates(["manifest_sha256"]).withColumn("receipt_id", ingest.receipt_id(F.col("given_receipt_id"), F.col("manifest_sha256")))


def origin_of(again: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds origin_receipt and origin_issue to reprocessed manifests.

    Candidates (receipt_id, request_id, sha256, fetched_at, network_performed, passed) are the originals of the same
    request, content and fetch time: the named one if one is named, else those that say they came over the network, else
    all. It has to be one receipt, and one that passed its own checks.
    """
    key = ["request_id", "sha256", "fetched_at"]
    one = candidates.groupBy(*key, "receipt_id").agg(F.max(F.coalesce("network_performed", F.lit(False))).alias("said"), F.max("passed").alias("passed"))
    met = again.select("manifest_sha256", "origin_receipt_id", *key).join(one, key).where("origin_receipt_id is null or origin_receipt_id = receipt_id")
    told = F.max(F.when(F.col("origin_receipt_id").isNull(), F.col("said"))).over(Window.partitionBy("manifest_sha256"))
    met = met.withColumn("_told", told).where("said or not coalesce(_told, false)")
    found = met.groupBy("manifest_sha256").agg(F.count_distinct("receipt_id").alias("_n"), F.min("receipt_id").alias("origin_receipt"), F.max("passed").alias("_passed"))
    issue = first_reason((F.col("_n").isNull(), "reprocess_without_origin_receipt"), (F.col("_n") > 1, "ambiguous_reprocess_origin_receipt"), (~F.col("_passed"), "origin_receipt_quarantined"))
    return again.join(found, "manifest_sha256", "left").withColumn("origin_issue", issue).drop("_n", "_passed")


def imported(manifests: DataFrame, rows: DataFrame, issues: DataFrame, now: Column, *, domain: str | None = None, known: DataFrame | None = None, receipts: DataFrame | None = None, refused: DataFrame | None = None, artifacts: DataFrame | None = None) -> dict[str, DataFrame]:
    """receipts, refused, links, versions, quarantine and repeated of a batch of manifests.

    A manifest whose digest is known already (``known``: manifest_sha256) or occurs twice counts once; only its raw bytes
    are checked again. Originals are judged before reprocesses, whichever comes first. A reprocess takes the receipt of
    its original, one of this batch or of ``receipts``, the stored ones (receipt_id and EVENT); ``refused`` are those that
    were quarantined. A receipt id stands for one event. Artifacts that several manifests name, or that are stored (``artifacts``), give their versions once. Whatever
    fails is quarantined whole, by its first reason; the other manifests go on. ``manifests`` may have gone through batch_of.
    """
    batch = manifests if "manifest_sha256" in manifests.columns else batch_of(manifests, domain)
    if known is not None:
        seen = known.select("manifest_sha256").distinct().withColumn("_known", F.lit(True))
        batch = batch.join(seen, "manifest_sha256", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    else:
        batch = batch.withColumn("_known", F.lit(False))
    other_domain = F.when(~F.coalesce(F.col("input_domain") == domain, F.lit(False)), "input_domain_mismatch") if domain else F.lit(None).cast("string")
    judged = batch.join(content_faults(batch, rows, issues), "manifest_sha256", "left")
    content = normalized_fault()
    judged = store.stored(judged.withColumns({"_first": F.coalesce(manifest_fault(now), other_domain), "_raw": raw_fault(), "_content": F.when(content == "fault", F.col("fault")).otherwise(content)}).drop("fault"))
    event = digest(*[F.col(c) for c in EVENT])

    originals = judged.where("not reprocessed").withColumn("_reason", F.when(F.col("_known"), F.coalesce("_first", "_raw")).otherwise(F.coalesce("_first", "_raw", "_content")))
    stored_receipts = None if receipts is None else receipts.select("receipt_id", *[F.col(c) for c in EVENT])
    rank = Window.partitionBy("receipt_id").orderBy("_stored", "fetched_at", "manifest_sha256")
    fit = originals.where("_reason is null").select("receipt_id", "fetched_at", "manifest_sha256", event.alias("_event"), F.lit(1).alias("_stored"))
    if stored_receipts is not None:
        fit = fit.unionByName(stored_receipts.select("receipt_id", "fetched_at", F.lit("").alias("manifest_sha256"), event.alias("_event"), F.lit(0).alias("_stored")))
    reused = fit.withColumn("_reused", F.first("_event").over(rank) != F.col("_event")).where("_reused and _stored = 1").select("manifest_sha256", "_reused")
    originals = originals.join(reused, "manifest_sha256", "left").withColumn("_reason", F.coalesce("_reason", F.when(F.col("_reused"), "receipt_id_reused_with_different_event"))).drop("_reused")

    pool = originals.where("_first is null or _first = 'input_domain_mismatch'").select("receipt_id", "request_id", "sha256", "fetched_at", "network_performed", F.col("_reason").isNull().alias("passed"))
    if stored_receipts is not None:
        pool = pool.unionByName(stored_receipts.select("receipt_id", "request_id", "sha256", "fetched_at", "network_performed", F.lit(True).alias("passed")))
    if refused is not None:
        pool = pool.unionByName(refused.select("receipt_id", "request_id", "sha256", "fetched_at", "network_performed", F.lit(False).alias("passed")))
    again = origin_of(judged.where("reprocessed"), pool)
    again = again.withColumn("_reason", F.when(F.col("_known"), F.coalesce("_first", "_raw")).otherwise(F.coalesce("_first", "origin_issue", "_raw", "_content"))).withColumn("receipt_id", F.col("origin_receipt"))
    both = store.stored(originals.unionByName(again.drop("origin_receipt", "origin_issue")))
    good, bad = ingest.quarantined(both, F.col("_reason"))
    fresh = good.where("not _known")
    links = fresh.select("manifest_sha256", "artifact_id", "receipt_id", "request_id", "source", "status", "fetched_at", "reprocessed")
    kept = fresh.where("not reprocessed").select("receipt_id", *EVENT).dropDuplicates(["receipt_id"])
    first = fresh.groupBy("artifact_id").agg(F.min(F.struct("reprocessed", "fetched_at", "manifest_sha256", "receipt_id")).alias("_m")).select("artifact_id", "_m.receipt_id", "_m.manifest_sha256")
    if artifacts is not None:
        first = first.join(artifacts.select("artifact_id").distinct(), "artifact_id", "left_anti")
    return {
        "receipts": kept,
        "refused": both.where("not reprocessed and _reason is not null and (_first is null or _first = 'input_domain_mismatch')").select("receipt_id", *EVENT).dropDuplicates(["receipt_id"]),
        "links": links,
        "versions": rows.join(first, "artifact_id"),
        "quarantine": bad.select("artifact_id", "request_id", "manifest_sha256", "reason"),
        "repeated": good.where("_known").select("artifact_id", "manifest_sha256"),
    }


def import_into(root: str, manifests: DataFrame, rows: DataFrame, issues: DataFrame, now: Column, *, domain: str = "market", row_key: list[str] | None = None, buckets: int = store.BUCKETS) -> dict[str, DataFrame]:
    """Import a batch into the tables under ``root`` (receipts, links, versions, quarantine), which batches share.

    Only the buckets of the batch's own manifests, requests, receipts and artifacts are read. Links are written last: a
    batch that was cut off is taken again, and what it had written by then is known by its key.
    """
    batch = store.stored(batch_of(manifests, domain))
    of = lambda table, key: store.lookup(batch, f"{root}/{table}", [key], buckets=buckets)
    by_request, by_id = of("receipts", "request_id"), of("receipt_ids", "receipt_id")
    receipts = by_request if by_id is None else by_id if by_request is None else by_request.unionByName(by_id).dropDuplicates(["receipt_id"])
    found = imported(batch, rows, issues, now, domain=domain, known=of("links", "manifest_sha256"), receipts=receipts, refused=of("refused", "request_id"), artifacts=of("artifacts", "artifact_id"))
    names = ["artifact_id", *(row_key or [c for c in rows.columns if c != "artifact_id"])]
    versions = found["versions"].withColumn("row_sha256", digest(*[F.col(c) for c in names]))
    tables = {
        "versions": (versions, ["artifact_id", "row_sha256"], ["artifact_id"]),
        "artifacts": (found["links"].select("artifact_id").distinct(), ["artifact_id"], None),
        "receipts": (found["receipts"], ["request_id", "receipt_id"], ["request_id"]),
        "receipt_ids": (found["receipts"], ["receipt_id"], None),
        "refused": (found["refused"], ["request_id", "receipt_id"], ["request_id"]),
        "quarantine": (found["quarantine"], ["manifest_sha256", "reason"], None),
        "links": (found["links"], ["manifest_sha256"], None),
    }
    for table, (new, key, by) in tables.items():
        store.append(new, f"{root}/{table}", key, by=by, of=found["links"] if table == "versions" else None, buckets=buckets, digests=("manifest_sha256", "row_sha256"))
    return found


def calendar_rows(sessions: DataFrame, *, exchange: str, source: str, known_at: Column) -> DataFrame:
    """Sessions (trading_date, open_utc, close_utc) as calendar rows under the digest of the whole calendar.

    Days whose clocks are missing or out of order are left with a reason instead of a version.
    """
    reason = first_reason((F.col("trading_date").isNull(), "date_required"), (F.col("open_utc").isNull() | F.col("close_utc").isNull(), "timestamp_required"), (F.col("open_utc") >= F.col("close_utc"), "session_clock_order"))
    marked = sessions.dropDuplicates(["trading_date"]).withColumn("reason", reason)
    # a digest of each year's days in order, then one of the years in order
    each = F.struct("trading_date", digest(F.col("trading_date"), F.col("open_utc"), F.col("close_utc")).alias("d"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["d"]), ""), 256)
    years = marked.where("reason is null").groupBy(F.year("trading_date").alias("year")).agg(joined(each).alias("d"))
    version = years.agg(joined(F.struct("year", "d")).alias("calendar_version"))
    return marked.crossJoin(F.broadcast(version)).withColumns({"exchange": F.lit(exchange), "calendar_source": F.lit(source), "known_at": known_at})  # one row
