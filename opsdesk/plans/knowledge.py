"""The stored knowledge index that the registered queries read.

Built once per application and data folder, in the shared checkpoint folder, by two successive
commits: the documents that the knowledge view calls indexed, then a sync that embeds the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from opsdesk.operators.index import VectorIndex
from opsdesk.session import scratch_path
from opsdesk.sources.views import AS_OF

FIRST_RUN, AFTER_SYNC = 1, 2

_BUILT: dict[tuple, str] = {}


def _stored_index(v, kind: str, build) -> VectorIndex:
    app = v.spark.sparkContext.applicationId
    key = (app, v.sf_dir.rstrip("/"), kind)
    if key not in _BUILT:
        name = hashlib.sha1(key[1].encode()).hexdigest()[:12]
        index = VectorIndex.create(v.spark, scratch_path(v.spark, f"index-{kind}-{name}-{app}"))
        build(index)
        _BUILT[key] = index.path
    return VectorIndex(v.spark, _BUILT[key])


def knowledge_index(v) -> VectorIndex:
    """All knowledge documents; ``at(FIRST_RUN)`` holds those indexed before."""
    def build(index):
        index.add(v.knowledge.where("indexed_at IS NOT NULL"), F.col("indexed_at"))
        index.sync(v.knowledge, AS_OF)
    return _stored_index(v, "knowledge", build)


def draft_index(v) -> VectorIndex:
    """All knowledge documents as they were when never-indexed ones still had a shorter draft as
    their text, indexed at their upload."""
    def build(index):
        draft = F.concat(F.lit("Draft: "), F.expr("substring(text, 1, cast(length(text) / 2 AS int))"))
        old = v.knowledge.withColumn("text", F.when(F.col("indexed_at").isNull(), draft).otherwise(F.col("text")))
        index.add(old, F.coalesce("indexed_at", "uploaded_at"))
    return _stored_index(v, "drafts", build)
