"""A stored, versioned index of knowledge chunks and their vectors (IDX1-IDX4, J10, X2).

An index is a folder of three Parquet tables that only ever grow by whole commits:

* ``chunks``  (by bucket of the document id): doc_id, chunk_index, content, commit, ...;
* ``blocks``  (by bucket): packed vectors with bounds, see ``vectors``;
* ``log``     one row per document and commit: status, chunk count, times, error, and the running
  number of the commit.

A commit writes its chunks, then its blocks, then its log rows.  Rows of a commit that never reached
the log are invisible, so a failed or repeated write changes nothing.  The state of a document is its
newest log row; replacing or deleting a document appends to the log and leaves its old rows where
they are, out of force.  Every commit is a version: ``at(seq)`` reads the index as it was then.

Only documents that a commit adds are chunked, tokenised and hashed; everything else is read.
One writer at a time; readers need no lock.  doc_id is the key of a document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdesk.functions import lexicon as LX
from opsdesk.functions.text import round_half_up
from opsdesk.functions.time import as_timestamp
from opsdesk.operators import vectors as V

NO_TEXT = "The selected document does not contain readable text."
NOT_FOUND = "Document or extracted text could not be found."
BUCKETS = 256                # folders of a table
GROUP_DOCS = 512             # expected documents whose chunks are packed together

LOG_SCHEMA = (
    "doc_id long, filename string, document_type string, status string, chunk_count long, "
    "indexed_at timestamp_ntz, error string, commit string, seq long, grp long")
CHUNK_SCHEMA = (
    "doc_id long, chunk_index int, content string, filename string, document_type string, commit string, grp long, bucket int")
BLOCK_SCHEMA = V.BLOCK_SCHEMA + ", bucket int"


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, seq: int | None = None):
        self.spark, self.path, self.seq = spark, path.rstrip("/"), seq

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> VectorIndex:
        index = cls(spark, path)
        for name, schema, by in (("log", LOG_SCHEMA, []), ("chunks", CHUNK_SCHEMA, ["bucket"]), ("blocks", BLOCK_SCHEMA, ["bucket"])):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(f"{index.path}/{name}")
        return index

    def at(self, seq: int) -> VectorIndex:
        """The index as it was after commit number ``seq``."""
        return VectorIndex(self.spark, self.path, seq)

    # ------------------------------------------------------------------ reading
    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        rows = self._read("log", LOG_SCHEMA)
        return rows if self.seq is None else rows.where(F.col("seq") <= self.seq)

    def last_seq(self) -> int:
        return self.log().agg(F.max("seq")).first()[0] or 0

    def _newest(self) -> DataFrame:
        return self.log().groupBy("doc_id").agg(F.max("seq").alias("seq"))

    def documents(self) -> DataFrame:
        """The newest log row of every document that was not deleted."""
        return self.log().join(self._newest(), ["doc_id", "seq"]).where("status <> 'Deleted'").drop("seq", "grp", "commit")

    def _out_of_force(self) -> DataFrame:
        """(commit, doc_id, grp) of indexed rows that a later commit replaced or deleted."""
        newest = self._newest().withColumnRenamed("seq", "newest")
        return self.log().where("status = 'Indexed'").join(newest, "doc_id").where("seq < newest").select("commit", "doc_id", "grp")

    def _committed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.log().select("commit").distinct(), "commit", "left_semi")

    def chunks(self) -> DataFrame:
        rows = self._committed(self._read("chunks", CHUNK_SCHEMA))
        return rows.join(self._out_of_force().select("commit", "doc_id"), ["commit", "doc_id"], "left_anti")

    def blocks(self) -> DataFrame:
        """Packed vectors; ``dead`` lists a block's documents that are out of force (at most the
        documents of its group)."""
        dead = self._out_of_force().groupBy("commit", "grp").agg(F.collect_list("doc_id").alias("dead"))
        return self._committed(self._read("blocks", BLOCK_SCHEMA)).join(dead, ["commit", "grp"], "left")

    def vector_stats(self) -> DataFrame:
        """(doc_id, chunk_index, nnz, norm2) of all vectors in force, from the stored blocks."""
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    b = V._Block(batch, i)
                    keep = np.ones(len(b.doc), bool) if b.alive is None else b.alive
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.doc[keep]), pa.array(b.chunk[keep]), pa.array((b.dense != 0).sum(1)[keep]), pa.array(b.norm2[keep])],
                        names=["doc_id", "chunk_index", "nnz", "norm2"])
        return self.blocks().mapInArrow(run, "doc_id long, chunk_index int, nnz long, norm2 long")

    def missing(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` whose document is not in the index (J10, X2): nothing of them is chunked
        or hashed here, and nothing of the others ever."""
        return docs.join(self.documents().select("doc_id"), "doc_id", "left_anti")

    # ------------------------------------------------------------------ writing
    def _stamped(self, docs: DataFrame, as_of) -> DataFrame:
        stamp = as_of if isinstance(as_of, Column) else as_timestamp(as_of)
        return docs.select("doc_id", "filename", "document_type", "text", stamp.alias("indexed_at"))

    def add(self, docs: DataFrame, as_of) -> int:
        """IDX1: chunk, embed and register documents (doc_id, filename, document_type, text); those
        without readable text are registered as rejected.  A document that is already there is
        replaced.  ``as_of`` is a time or a column of ``docs``.  Returns the commit's number."""
        from opsdesk.operators.retrieve import chunk_documents

        commit, seq = uuid.uuid4().hex, self.last_seq() + 1
        rows = V.stored(self._stamped(docs, as_of), "index-input")
        groups = -(-rows.count() // GROUP_DOCS)
        rows = V.grouped(rows, groups).withColumn("commit", F.lit(commit))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        # dealt by bucket first: a folder is one file, and a task sorts its own folders only
        dealt = rows.withColumn("bucket", bucket).repartition(max(1, min(BUCKETS, groups)), "bucket")
        chunks = chunk_documents(dealt, keep=["filename", "document_type", "commit", "grp", "bucket"])
        self._write(chunks.select(*names(CHUNK_SCHEMA)), "chunks")
        made = self._read("chunks", CHUNK_SCHEMA).where(F.col("commit") == commit)
        self._write(V.blocks_of(made).withColumn("bucket", F.pmod("grp", F.lit(BUCKETS)).cast("int")), "blocks")
        counts = made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        n = F.coalesce("n", F.lit(0))
        self._log(rows.join(counts, "doc_id", "left").select(
            "doc_id", "filename", "document_type", F.when(n > 0, "Indexed").otherwise("Rejected").alias("status"),
            n.alias("chunk_count"), F.when(n > 0, F.col("indexed_at")).alias("indexed_at"),
            F.when(n == 0, F.lit(NO_TEXT)).alias("error"), "commit", "grp"), seq)
        return seq

    def sync(self, docs: DataFrame, as_of) -> int:
        """IDX2: add the documents that are missing."""
        return self.add(self.missing(docs), as_of)

    def reindex(self, docs: DataFrame, as_of) -> int:
        """IDX3: new chunks and vectors for documents of the index, their old ones out of force;
        documents that are not in it are left out (see ``unknown``)."""
        return self.add(docs.join(self.documents().select("doc_id"), "doc_id", "left_semi"), as_of)

    def unknown(self, requests: DataFrame) -> DataFrame:
        """Requested ids that the index does not hold, with the error."""
        return requests.select("doc_id").distinct().join(self.documents().select("doc_id"), "doc_id", "left_anti") \
            .select("doc_id", F.lit(NOT_FOUND).alias("error"))

    def delete(self, requests: DataFrame) -> int:
        """IDX4: documents out of force, with all their chunks and vectors."""
        seq = self.last_seq() + 1
        held = self.documents().join(requests.select("doc_id").distinct(), "doc_id", "left_semi")
        self._log(held.select("doc_id", "filename", "document_type", F.lit("Deleted").alias("status"),
                              F.lit(0).cast("long").alias("chunk_count"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"),
                              F.lit(None).cast("string").alias("error"), F.lit(uuid.uuid4().hex).alias("commit"),
                              F.lit(0).cast("long").alias("grp")), seq)
        return seq

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _log(self, rows: DataFrame, seq: int) -> None:
        """The commit point: one append of all log rows."""
        rows.withColumn("seq", F.lit(seq).cast("long")).select(*names(LOG_SCHEMA)).write.mode("append").parquet(f"{self.path}/log")

    # ------------------------------------------------------------------ queries
    def search(self, queries: DataFrame, k: int, qid: str = "qid", text: str = "text", slab_bytes: int = V.SLAB_BYTES) -> DataFrame:
        return V.search_blocks(self.blocks(), queries, k, qid, text, slab_bytes)

    def skipped(self, queries: DataFrame, k: int, qid: str = "qid", text: str = "text") -> DataFrame:
        """(pairs, skipped): (query, block) pairs of a search and how many the bounds left out."""
        return V.search_blocks(self.blocks(), queries, k, qid, text, report=True)

    def retrieve(self, queries: DataFrame, k: int, qid: str = "qid", text: str = "text",
                 slab_bytes: int = V.SLAB_BYTES) -> DataFrame:
        """RET1: the k best chunks of every query that is not blank, with content, source and type."""
        best = self.search(queries, k, qid, text, slab_bytes)
        rows = self._read("chunks", CHUNK_SCHEMA).select("commit", "doc_id", "chunk_index", "filename", "document_type", "content")
        return with_content(best, rows, ["commit", "doc_id", "chunk_index"], qid)


def with_content(best: DataFrame, rows: DataFrame, keys: list[str], qid: str) -> DataFrame:
    return rows.join(best, keys).select(
        F.col("qid").alias(qid), "rank", "doc_id", "chunk_index", "filename", "document_type", "content",
        round_half_up(F.greatest(F.lit(0.0), F.col("cosine")), 3).alias("score"))
