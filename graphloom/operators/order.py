"""Places, running sums and exact percentiles over rows of any number.

Rows are range-partitioned by their order and written once; a partition's
rows are numbered where they are, and only sums by partition are added up in
one place.  No task sees all rows, and none sees all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def _names(order: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def running(rows: DataFrame, order: list[Column | str], amount: Column, name: str, keys: list[str] | None = None, many: bool = False) -> DataFrame:
    """rows with name: the sum of amount over all rows up to theirs (of their
    keys).  The order, after the keys, must be total for reruns to agree.
    many: there are about as many keys as rows, so their sums are not broadcast."""
    keys = keys or []
    by = [F.col(k) for k in keys] + _names(order)
    laid = cut(rows.withColumn("__amount", amount).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = laid.groupBy("__part", *keys).agg(F.sum("__amount").alias("__own"))
    before = F.sum("__own").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__before", F.coalesce(before, F.lit(0))).select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k_{k}") for k in keys), "__before")
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    own = F.sum("__amount").over(Window.partitionBy("__part", *keys).orderBy(*_names(order)).rowsBetween(Window.unboundedPreceding, 0))
    out = laid.withColumn(name, own).join(sums.hint("merge") if many else sums, same).withColumn(name, F.col(name) + F.col("__before"))
    return out.select(*rows.columns, name)


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their 0-based place in the order."""
    return running(rows, order, F.lit(1).cast("long"), name).withColumn(name, (F.col(name) - 1).cast("long"))


def chunks(rows: DataFrame, order: list[Column | str], size: int = 1000, name: str = "chunk") -> DataFrame:
    """rows with the number of their chunk of size rows in the order."""
    return placed(rows, order, "__place").withColumn(name, F.floor(F.col("__place") / size).cast("long")).drop("__place")


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles of value by keys; nulls do not count.

    wanted: name -> (kind, p).  Kinds: ``linear`` interpolates at (n - 1) p,
    ``index`` takes the 0-based place floor(p n), ``nearest`` the place
    ceil(p n) - 1, both kept within the values.  Equal values are counted
    first, so the rows that are laid out are the distinct ones of each key.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    laid = running(counts, ["__v"], F.col("__c"), "__end", keys)
    total = laid.groupBy(*keys).agg(F.sum("__c").alias("__n")).select(*(F.col(k).alias(f"__n_{k}") for k in keys), "__n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__n_{k}"))
    laid = laid.join(total, same)
    n = F.col("__n")
    at = lambda place: F.max(F.when((place < F.col("__end")) & (place >= F.col("__end") - F.col("__c")), F.col("__v")))
    parts, out = [], []
    for name, (kind, p) in wanted.items():
        if kind == "linear":
            k = (n - 1) * F.lit(p)
            parts += [at(F.floor(k)).alias(f"__{name}_a"), at(F.ceil(k)).alias(f"__{name}_b"), F.first(k - F.floor(k)).alias(f"__{name}_w")]
            a, b, w = (F.col(f"__{name}_{x}") for x in "abw")
            out.append((a + (b - a) * w).alias(name))
        else:
            place = F.floor(F.lit(p) * n) if kind == "index" else F.ceil(F.lit(p) * n) - 1
            parts.append(at(F.greatest(F.lit(0), F.least(place, n - 1))).alias(name))
            out.append(F.col(name))
    return laid.groupBy(*keys).agg(*parts).select(*keys, *out)
