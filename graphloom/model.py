"""Data model: a typed property graph and its telemetry as DataFrames."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType(), "f[]": T.ArrayType(T.FloatType()), "m": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


#: Version of the tables' layout, as exports state it.
SCHEMA_VERSION = 1
NODES = _struct("id:s name:s node_type:s path:s start_line:i end_line:i docstring:s metadata_json:s")
EDGES = _struct("source_id:s target_id:s edge_type:s provenance:s metadata_json:s")
FINGERPRINTS = _struct("path:s content_hash:s mtime:d")
EMBEDDINGS = _struct("node_id:s dimension:i vector:f[] updated_at:t")
REPOSITORIES = _struct("name:s uri:s local_path:s repo_type:s schema_path:s synced_at:t metadata_json:s")
TELEMETRY = _struct("node_id:s call_count:l total_duration_ms:d avg_duration_ms:d p95_duration_ms:d error_count:l error_rate:d last_seen:t metadata_json:s")
SNAPSHOTS = _struct("id:s created_at:t status:s node_count:l edge_count:l source_hash:s")
SPANS = _struct(
    "trace_id:s span_id:s parent_span_id:s service_name:s name:s kind:s duration_ms:d is_error:b http_method:s http_route:s http_status:i rpc_service:s rpc_method:s db_system:s db_statement:s peer_service:s attributes:m"
)

# Fixed vocabularies; unknown strings are tolerated everywhere.
NODE_TYPES = "file module class function variable import endpoint table topic service epic story criterion task test evidence adr doc concept".split()
EDGE_TYPES = "contains calls imports defines inherits implements verifies evidenced_by depends_on type_depends_on references routes_to injects maps_to publishes subscribes network_calls".split()
#: Edge types that make the dependency graph of cycles.
DEPENDENCY_TYPES = "calls imports depends_on routes_to inherits".split()
#: Node types and edge types that survive a rebuild, as people made them.
MANUAL_NODE_TYPES = "story criterion task adr doc evidence".split()
MANUAL_EDGE_TYPES = "implements verifies evidenced_by".split()
