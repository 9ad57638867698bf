"""Traces as they come from a telemetry store: resources, scopes and spans, nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Services that are shown, stages and outcomes that are passed on, and how many spans a trace shows.
SERVICES = ("rag-go-api", "rag-python-server", "rag-python-worker", "rag-python-outbox")
STAGES = (
    "route", "model", "tool", "assess", "rewrite", "finalize", "complete", "object_read", "parse", "chunk", "embedding", "index",
    "dense", "sparse", "visibility", "rerank", "evidence", "publish", "rpc", "grpc",
)
OUTCOMES = ("succeeded", "failed", "cancelled", "retry", "skipped")
FAILED = ("STATUS_CODE_ERROR", "2")
MOST_SPANS = 200
ATTRIBUTES = "array<struct<key:string,value:string>>"
SPANS = f"array<struct<span_id:string,parent_id:string,start_ns:string,end_ns:string,status:string,attributes:{ATTRIBUTES}>>"
TRACE = f"array<struct<attributes:{ATTRIBUTES},scopes:array<struct<spans:{SPANS}>>>>"


def attribute(attributes: Column, key: str) -> Column:
    """The first value of ``key``; empty if there is none."""
    return F.coalesce(F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"], F.lit(""))


def hex_id(value: Column, size: int) -> Column:
    """An id of ``size`` bytes, given as hex or base64, as lower-case hex; empty if it is neither."""
    is_hex = value.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$")
    raw = F.when(value.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(value) % 4 == 0), F.try_to_binary(value, F.lit("base64")))
    return F.when(is_hex, F.lower(value)).when(F.length(raw) == size, F.lower(F.hex(raw))).otherwise("")


def flattened(traces: DataFrame, most: int = MOST_SPANS) -> DataFrame:
    """``(trace_id, nth, service, span_id, parent_id, stage, outcome, error_code, run_id, duration_ms, truncated)``.

    ``traces`` are (trace_id, resources) of the type ``TRACE``. Spans of other services are left out, as are those
    without a valid id; of the others the first ``most`` of a trace stay, in their order. ``truncated`` says that spans
    of a shown service come after these. Stages and outcomes that are not known become ``rpc`` and ``succeeded``, an
    error status is ``failed``, and ids and codes of other letters are dropped. A span that ends before it begins, or
    whose times are no numbers, takes no time.
    """
    rows = traces.select("trace_id", F.posexplode("resources").alias("_r", "_resource"))
    rows = rows.withColumn("service", attribute(F.col("_resource.attributes"), "service.name")).where(F.col("service").isin(*SERVICES))
    rows = rows.select("trace_id", "_r", "service", F.posexplode("_resource.scopes").alias("_s", "_scope"))
    rows = rows.select("trace_id", "_r", "_s", "service", F.posexplode("_scope.spans").alias("_n", "span"))
    rows = rows.withColumn("span_id", hex_id(F.coalesce("span.span_id", F.lit("")), 8))
    own = W.partitionBy("trace_id")
    valid = (F.col("span_id") != "").cast("int")
    before = F.coalesce(F.sum(valid).over(own.orderBy("_r", "_s", "_n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).withColumn("truncated", F.max(F.col("_before") >= most).over(own))
    rows = rows.where((F.col("_before") < most) & (F.col("span_id") != ""))
    value = lambda key: attribute(F.col("span.attributes"), key)
    safe = lambda c, letters: F.when(c.rlike(f"^[{letters}]{{1,64}}$"), c).otherwise("")
    stage = F.when(value("stage").isin(*STAGES), value("stage")).otherwise("rpc")
    outcome = F.when(F.col("span.status").isin(*FAILED), "failed").when(value("outcome").isin(*OUTCOMES), value("outcome")).otherwise("succeeded")
    start, end = (F.coalesce(F.col(f"span.{c}").try_cast("decimal(20,0)"), F.lit(0)) for c in ("start_ns", "end_ns"))
    return rows.select(
        "trace_id", (F.col("_before") + 1).cast("long").alias("nth"), "service", "span_id", hex_id(F.coalesce("span.parent_id", F.lit("")), 8).alias("parent_id"), stage.alias("stage"), outcome.alias("outcome"),
        safe(value("error.code"), "0-9a-zA-Z_").alias("error_code"), safe(value("run.id"), "0-9a-zA-Z-").alias("run_id"),
        F.when(end >= start, (end - start).cast("double") / 1e6).otherwise(0.0).alias("duration_ms"), "truncated",
    )
