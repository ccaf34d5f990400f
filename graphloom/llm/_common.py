"""Shared pieces of the corpus operators: shared storage, Arrow columns, ids."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, discard, map_arrow, send_package, shared_dir  # noqa: F401


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a step to shared storage and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    running the step again, and repeated uses read the table.
    """
    return cut(df, name)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds = fold; a null id counts as ''."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % F.lit(folds) == F.lit(fold)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null gives b''."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def sample_below(key: Column, share: float) -> Column:
    """True for about that share of the keys, the same ones in every run."""
    top = int(min(max(share, 0.0), 1.0) * (1 << 62))
    return F.shiftrightunsigned(F.xxhash64(key), 2) < F.lit(top)


def keep_rows(docs: DataFrame, text: str, decide) -> DataFrame:
    """The rows, with all their columns, for whose text decide(texts) says True.

    decide gets the UTF-8 texts of an Arrow batch and runs in the task that
    reads them; nothing is moved.
    """
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(decide(utf8(batch.column(place))), pa.bool_()))

    return map_arrow(docs, run, docs.schema)
