"""Trace and metrics files as spans and telemetry rows.

Formats are told apart by their keys; OTLP, Jaeger and Zipkin JSON become
span rows of ``graphloom.model.SPANS``.  Nested documents are taken apart with
variant access and explodes, one row per span, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = ("INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
_LIST = "array<variant>"


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def span_kind(kind: Column) -> Column:
    """SERVER, CLIENT, PRODUCER, CONSUMER, INTERNAL or UNKNOWN of a number or text."""
    up = F.upper(F.coalesce(kind, F.lit("")))
    out = F.lit("UNKNOWN")
    for i, name in reversed(list(enumerate(_KINDS, 1))):
        out = F.when((up == str(i)) | up.contains(name), name).otherwise(out)
    return out


def any_value(v: Column) -> Column:
    """Text of an OTLP AnyValue; lists and key-value lists as JSON."""
    simple = [_get(v, f"$.{k}") for k in ("stringValue", "intValue", "boolValue", "doubleValue")]
    return F.coalesce(*simple, F.to_json(_get(v, "$.arrayValue", "variant")), F.to_json(_get(v, "$.kvlistValue", "variant")))


def detect_format(doc: Column) -> Column:
    """otlp, jaeger, zipkin, pyspy, metrics or unknown of a parsed document."""
    has = lambda p: _get(doc, p, "variant").isNotNull()
    return F.when(has("$.resourceSpans"), "otlp").when(has("$.data[0].spans"), "jaeger").when(has("$[0].traceId") & has("$[0].id"), "zipkin").when(has("$.frames") | has("$.shared.frames"), "pyspy").when(has("$.metrics"), "metrics").otherwise("unknown")


def read_documents(df: DataFrame, column: str = "value") -> DataFrame:
    """(doc, format) of a table with one JSON document per row."""
    parsed = df.select(F.try_parse_json(F.col(column)).alias("doc"))
    return parsed.withColumn("format", detect_format(F.col("doc")))


def _finish(spans: DataFrame) -> DataFrame:
    a = lambda *keys: F.coalesce(*(F.try_element_at("attributes", F.lit(k)) for k in keys))
    return spans.select(
        "trace_id", "span_id", F.when(F.col("parent_span_id") != "", F.col("parent_span_id")).alias("parent_span_id"), F.coalesce("service_name", F.lit("unknown")).alias("service_name"), "name", "kind", F.greatest(F.lit(0.0), "duration_ms").alias("duration_ms"), "is_error",
        a("http.method", "http.request.method").alias("http_method"), a("http.route", "http.target", "url.path").alias("http_route"), a("http.status_code", "http.response.status_code").cast("int").alias("http_status"),
        a("rpc.service").alias("rpc_service"), a("rpc.method").alias("rpc_method"), a("db.system").alias("db_system"), a("db.statement").alias("db_statement"), F.coalesce("peer", a("peer.service", "net.peer.name", "server.address")).alias("peer_service"), "attributes",
    )


def _attributes(items: Column) -> Column:
    pairs = F.transform(F.coalesce(items, F.array().cast(_LIST)), lambda x: F.struct(_get(x, "$.key").alias("k"), F.coalesce(any_value(_get(x, "$.value", "variant")), _get(x, "$.value")).alias("v")))
    return F.map_from_entries(F.array_distinct(F.filter(pairs, lambda p: p["k"].isNotNull())))


def otlp_spans(docs: DataFrame) -> DataFrame:
    """Spans of OTLP documents: resources, scopes and spans exploded in turn."""
    r = docs.filter("format = 'otlp'").select(F.explode(_get("doc", "$.resourceSpans", _LIST)).alias("r"))
    r = r.withColumn("ra", _attributes(_get("r", "$.resource.attributes", _LIST)))
    s = r.select("ra", F.explode(_get("r", "$.scopeSpans", _LIST)).alias("s")).select("ra", F.explode(_get("s", "$.spans", _LIST)).alias("x"))
    code = F.upper(F.coalesce(_get("x", "$.status.code"), F.lit("")))
    nanos = _get("x", "$.endTimeUnixNano", "long") - _get("x", "$.startTimeUnixNano", "long")
    return _finish(s.select(
        _get("x", "$.traceId").alias("trace_id"), _get("x", "$.spanId").alias("span_id"), F.coalesce(_get("x", "$.parentSpanId"), F.lit("")).alias("parent_span_id"), F.try_element_at("ra", F.lit("service.name")).alias("service_name"), _get("x", "$.name").alias("name"),
        span_kind(_get("x", "$.kind")).alias("kind"), (nanos / 1e6).alias("duration_ms"), code.isin("2", "ERROR", "STATUS_CODE_ERROR").alias("is_error"), F.lit(None).cast("string").alias("peer"), _attributes(_get("x", "$.attributes", _LIST)).alias("attributes"),
    ))


def jaeger_spans(docs: DataFrame) -> DataFrame:
    """Spans of Jaeger documents; durations are microseconds."""
    t = docs.filter("format = 'jaeger'").select(F.explode(_get("doc", "$.data", _LIST)).alias("t"))
    x = t.select(F.try_variant_get("t", "$.processes", "map<string,variant>").alias("p"), F.explode(_get("t", "$.spans", _LIST)).alias("x"))
    tags = F.transform(F.coalesce(_get("x", "$.tags", _LIST), F.array().cast(_LIST)), lambda v: F.struct(_get(v, "$.key").alias("k"), _get(v, "$.value").alias("v")))
    x = x.withColumn("attributes", F.map_from_entries(F.array_distinct(tags)))
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    parent = F.filter(F.coalesce(_get("x", "$.references", _LIST), F.array().cast(_LIST)), lambda v: F.coalesce(_get(v, "$.refType"), F.lit("CHILD_OF")) == "CHILD_OF")
    return _finish(x.select(
        _get("x", "$.traceID").alias("trace_id"), _get("x", "$.spanID").alias("span_id"), F.coalesce(_get(F.get(parent, F.lit(0)), "$.spanID"), F.lit("")).alias("parent_span_id"), _get(F.try_element_at("p", _get("x", "$.processID")), "$.serviceName").alias("service_name"), _get("x", "$.operationName").alias("name"),
        span_kind(a("span.kind")).alias("kind"), (_get("x", "$.duration", "double") / 1000).alias("duration_ms"), F.coalesce(F.lower(a("error")) == "true", F.lit(False)).alias("is_error"), F.lit(None).cast("string").alias("peer"), "attributes",
    ))


def zipkin_spans(docs: DataFrame) -> DataFrame:
    """Spans of Zipkin documents; an error tag marks an error, whatever its value."""
    x = docs.filter("format = 'zipkin'").select(F.explode(_get("doc", "$", _LIST)).alias("x")).withColumn("attributes", F.coalesce(F.try_variant_get("x", "$.tags", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return _finish(x.select(
        _get("x", "$.traceId").alias("trace_id"), _get("x", "$.id").alias("span_id"), F.coalesce(_get("x", "$.parentId"), F.lit("")).alias("parent_span_id"), _get("x", "$.localEndpoint.serviceName").alias("service_name"), _get("x", "$.name").alias("name"),
        span_kind(_get("x", "$.kind")).alias("kind"), (_get("x", "$.duration", "double") / 1000).alias("duration_ms"), F.map_contains_key("attributes", "error").alias("is_error"), _get("x", "$.remoteEndpoint.serviceName").alias("peer"), "attributes",
    ))


def spans(df: DataFrame, column: str = "value") -> DataFrame:
    """Spans of JSON documents of any of the formats."""
    docs = read_documents(df, column)
    return otlp_spans(docs).unionByName(jaeger_spans(docs)).unionByName(zipkin_spans(docs))


def metrics(df: DataFrame, column: str = "value") -> DataFrame:
    """Telemetry rows (target, call_count, total_duration_ms, error_count) of
    generic metrics and sampling profiles."""
    docs = read_documents(df, column)
    m = docs.filter("format = 'metrics'").select(F.explode(_get("doc", "$.metrics", _LIST)).alias("m"))
    m = m.select(_get("m", "$.target").alias("target"), F.coalesce(_get("m", "$.calls", "long"), F.lit(1)).alias("call_count"), F.coalesce(_get("m", "$.duration_ms", "double"), F.lit(0.0)).alias("total_duration_ms"), F.coalesce(_get("m", "$.errors", "long"), F.lit(0)).alias("error_count"))
    p = docs.filter("format = 'pyspy'").select(F.explode(F.coalesce(_get("doc", "$.frames", _LIST), _get("doc", "$.shared.frames", _LIST))).alias("m"))
    p = p.select(_get("m", "$.name").alias("target"), F.coalesce(_get("m", "$.hits", "long"), F.lit(1)).alias("call_count"), F.coalesce(_get("m", "$.selfTime", "double"), F.lit(0.0)).alias("total_duration_ms"), F.lit(0).cast("long").alias("error_count"))
    return m.unionByName(p)
