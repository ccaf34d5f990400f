"""A stored inverted index with block maxima, added to batch by batch.

Below its folder each batch has

  postings  one row a term and block: the documents of the block that hold the
            term, with their counts and lengths, and the largest count and
            smallest length among them; in buckets, which are ranges of
            (term, block), so a term's rows are side by side
  terms     term, first and last bucket, number of documents; sorted
  docs      id, length
  gone      ids of earlier batches that this one replaces, with their lengths
  size      one row of totals

and ``commits`` names the batches that count, a row a commit, so a batch is
seen whole or not at all.

A block is a class of document lengths and a slice of the ids, so all of a
document's postings are in blocks of one number and a block's best possible
score is known from its maxima.  A search looks the words up in ``terms``,
opens the buckets they name, reads the blocks' maxima without their documents,
scores the documents of the most promising blocks, and then of those blocks
only that could still reach a place.  The rows are those of a full scan.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut
from .retrieval import K1, B, parse_query, tokens

#: Documents of a block, about; classes of lengths; postings rows of a bucket,
#: about; blocks that are read first.
BLOCK_DOCS, CLASSES, BUCKET_ROWS, FIRST_BLOCKS = 4_096, 16, 200_000, 8


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class TextIndex:
    """The index below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- commits ---------------------------------------------------------

    def batches(self) -> list[str]:
        """The batches that count, oldest first."""
        if not _exists(self.spark, f"{self.folder}/commits"):
            return []
        return list(self.spark.read.parquet(f"{self.folder}/commits").orderBy(F.desc("number")).first()["batches"])

    def _commit(self, batches: list[str]) -> None:
        number = 0
        if _exists(self.spark, f"{self.folder}/commits"):
            number = self.spark.read.parquet(f"{self.folder}/commits").agg(F.max("number")).first()[0] + 1
        self.spark.createDataFrame([(number, batches)], "number long, batches array<string>").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _read(self, batch: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{batch}/{table}")

    # --- writing ---------------------------------------------------------

    def add(self, docs: DataFrame, columns: list[str], id_col: str = "id") -> str:
        """Index a batch of documents; one whose id is known replaces the old
        one.  Ids must be unique in the batch.  Null texts have no tokens.
        Returns the batch's name."""
        if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
            raise ValueError("ids of a batch must be unique")
        # texts are dealt by id, so no token is moved to be counted
        bag = docs.select(id_col, *dict.fromkeys(c for c in columns if c != id_col)).repartition(id_col).select(F.col(id_col).alias("id"), F.flatten(F.array(*(tokens(F.col(c)) for c in columns))).alias("t"))
        flat = bag.select("id", F.size("t").cast("long").alias("length"), F.explode_outer("t").alias("term"))
        counted = cut(flat.groupBy("id", "length", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")), "counted")
        return self._write(counted, self.batches())

    def _write(self, counted: DataFrame, known: list[str], replace: bool = False) -> str:
        """A batch of (id, length, term, tf), a null term for a document without any."""
        batch = f"batch-{len(known):06d}-{uuid.uuid4().hex[:12]}"
        root = f"{self.folder}/{batch}"
        counted.select("id", "length").distinct().write.parquet(f"{root}/docs")
        docs = self._read(batch, "docs")
        n = docs.count()
        cuts = sorted(set(docs.agg(F.percentile_approx("length", [i / CLASSES for i in range(1, CLASSES)], 10_000)).first()[0] or [])) if n else []
        slices = max(1, -(-n // (BLOCK_DOCS * (len(cuts) + 1))))
        kind = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c < F.col("length")))
        block = (kind * slices + F.pmod(F.xxhash64("id"), F.lit(slices))).cast("long")
        posting = F.struct("id", "tf", "length")
        rows = counted.filter("term IS NOT NULL").withColumn("block", block)
        # rows go to their bucket once, and are put together there
        buckets = max(1, -(-rows.agg(F.approx_count_distinct(F.struct("term", "block"))).first()[0] // BUCKET_ROWS))
        rows = rows.repartitionByRange(buckets, "term", "block").groupBy("term", "block")
        rows = rows.agg(F.sort_array(F.collect_list(posting)).alias("postings"), F.max("tf").alias("most"), F.min("length").alias("least"), F.count(F.lit(1)).alias("n"))
        laid = rows.withColumn("bucket", F.spark_partition_id()).sortWithinPartitions("term", "block")
        laid.write.partitionBy("bucket").parquet(f"{root}/postings") if n else rows.withColumn("bucket", F.lit(0)).write.parquet(f"{root}/postings")
        terms = self._read(batch, "postings").groupBy("term").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.sum("n").alias("n"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/terms")
        old = [self._read(b, "docs").withColumn("batch", F.lit(b)) for b in known if not replace]
        gone = docs.select("id").withColumns({"length": F.lit(None).cast("long"), "batch": F.lit(None).cast("string")}).limit(0)
        for b, d in zip(known, old):
            again = [self._read(c, "gone").filter(F.col("batch") == b).select("id") for c in known]
            live = d.join(docs.select("id"), d["id"].eqNullSafe(docs["id"]), "left_semi")
            for g in again:
                live = live.join(g, live["id"].eqNullSafe(g["id"]), "left_anti")
            gone = gone.unionByName(live.select("id", "length", "batch"))
        gone.write.parquet(f"{root}/gone")
        totals = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        lost = self._read(batch, "gone").agg(F.count(F.lit(1)).alias("gone"), F.coalesce(F.sum("length"), F.lit(0)).alias("gone_length"))
        totals.crossJoin(F.broadcast(lost)).write.parquet(f"{root}/size")
        self._commit([batch] if replace else [*known, batch])
        return batch

    def compact(self) -> None:
        """All batches as one, without what was replaced."""
        known = self.batches()
        if len(known) < 2:
            return
        parts = []
        for b in known:
            flat = self._alive(self._read(b, "postings").select("term", F.explode("postings").alias("p")).select("p.id", "p.length", "term", "p.tf"), b, known)
            empty = self._alive(self._read(b, "docs"), b, known).filter("length = 0").select("id", "length", F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"))
            parts += [flat, empty]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        self._write(cut(whole, "counted"), known, replace=True)

    def _alive(self, rows: DataFrame, batch: str, known: list[str]) -> DataFrame:
        """rows (id, ...) of a batch whose documents no later batch replaces."""
        for later in known[known.index(batch) + 1 :]:
            gone = self._read(later, "gone").filter(F.col("batch") == batch).select(F.col("id").alias("__gone"))
            rows = rows.join(gone, F.col("id").eqNullSafe(F.col("__gone")), "left_anti")
        return rows

    # --- reading ---------------------------------------------------------

    def postings(self, word: str, prefix: bool) -> DataFrame | None:
        """batch, term, block, postings, most, least, n of a word's terms: of
        the buckets that hold them.  None if no batch has one."""
        found = None
        test = F.col("term").startswith(word) if prefix else F.col("term") == word
        for batch in self.batches():
            near = self._read(batch, "terms").filter(test & (F.col("term") >= word)).agg(F.min("first"), F.max("last")).first()
            if near[0] is not None:
                rows = self._read(batch, "postings").filter(F.col("bucket").between(near[0], near[1]) & (F.col("term") >= word) & test)
                rows = rows.select(F.lit(batch).alias("batch"), "term", "block", "postings", "most", "least", "n")
                found = rows if found is None else found.unionByName(rows)
        return found

    def size(self) -> tuple[int, int]:
        """(documents, tokens) that count."""
        n = length = 0
        for b in self.batches():
            r = self._read(b, "size").first()
            n, length = n + r["n"] - r["gone"], length + r["length"] - r["gone_length"]
        return n, length

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """id, score (BM25, higher is better) and rank of the best matches; ties
        by id; the query's language is that of retrieval.search()."""
        spark, known = self.spark, self.batches()
        groups = parse_query(query)
        words = sorted({w for g in groups for w in g})
        read = {w: self.postings(w[0].removeprefix("-"), w[1]) for w in words}
        n, length = self.size()
        kind = self._read(known[0], "docs").schema["id"].dataType.simpleString() if known else "string"
        held = None
        for i, w in enumerate(words):
            if read[w] is not None:
                part = read[w].withColumn("word", F.lit(i))
                held = part if held is None else held.unionByName(part)
        if held is None or not n:
            return spark.createDataFrame([], f"id {kind}, score double, rank int")
        replaced = any(self._read(b, "size").first()["gone"] for b in known)

        def documents(rows: DataFrame) -> DataFrame:
            """batch, block, word, id, tf, length; a row for each term."""
            flat = rows.select("batch", "block", "word", F.explode("postings").alias("p")).select("batch", "block", "word", "p.id", "p.tf", "p.length")
            if not replaced:
                return flat
            parts = [self._alive(flat.filter(F.col("batch") == b), b, known) for b in known]
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            return whole

        heads = cut(held.groupBy("batch", "block", "word").agg(F.sum("most").alias("most"), F.min("least").alias("least"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms")), "heads")
        totals = {r["word"]: r for r in heads.groupBy("word").agg(F.sum("n").alias("n"), F.max("terms").alias("terms")).collect()}
        df = {}
        for i in range(len(words)):
            df[i] = totals[i]["n"] if i in totals else 0
            if i in totals and (replaced or totals[i]["terms"] > 1):
                # a document may hold several of a prefix's terms
                df[i] = documents(held.filter(F.col("word") == i)).select("batch", "id").distinct().count()
        average = max(length / n, 1e-9)
        idf = {i: math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)) for i in range(len(words))}

        def score(tf, long: Column) -> Column:
            total = F.lit(0.0)
            for i, (word, _) in enumerate(words):
                if not word.startswith("-"):
                    total = total + F.lit(idf[i]) * tf(i) * (K1 + 1) / (tf(i) + K1 * (1 - B + B * long / F.lit(average)))
            return total

        def wanted(has, negative: bool) -> Column:
            ok = F.lit(False)
            for g in groups:
                each, some = F.lit(True), F.lit(False)
                for w in g:
                    here = has(words.index(w))
                    if w[0].startswith("-"):
                        each = each & ~here if negative else each
                    else:
                        each, some = each & here, some | here
                ok = ok | (each & some)
            return ok

        each = heads.groupBy("batch", "block").agg(F.min("least").alias("least"), *(F.coalesce(F.max(F.when(F.col("word") == i, F.col("most"))), F.lit(0)).alias(f"tf{i}") for i in range(len(words))))
        bound = score(lambda i: F.col(f"tf{i}"), F.col("least"))
        blocks = cut(each.filter(wanted(lambda i: F.col(f"tf{i}") > 0, False)).select("batch", "block", bound.alias("bound")), "blocks")

        def best(chosen: DataFrame) -> DataFrame:
            rows = held.join(chosen.select("batch", "block"), ["batch", "block"], "left_semi")
            per = documents(rows).groupBy("batch", "block", "id").agg(F.first("length").alias("length"), *(F.coalesce(F.sum(F.when(F.col("word") == i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in range(len(words))))
            hit = per.filter(wanted(lambda i: F.col(f"tf{i}") > 0, True))
            return cut(hit.select("id", F.round(score(lambda i: F.col(f"tf{i}"), F.col("length")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit), "best")

        first = cut(blocks.orderBy(F.desc("bound"), "batch", "block").limit(FIRST_BLOCKS), "first")
        found = best(first)
        least = found.agg(F.count(F.lit(1)), F.min("score")).first()
        rest = blocks.join(first.select("batch", "block"), ["batch", "block"], "left_anti")
        if least[0] >= limit:
            # scores are rounded, so is what decides
            rest = rest.filter(F.col("bound") >= least[1] - 1e-6)
        if not rest.isEmpty():
            found = found.unionByName(best(rest))
        found = found.orderBy(F.desc("score"), "id").limit(limit)
        return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
