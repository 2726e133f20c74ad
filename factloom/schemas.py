"""Schemas of the graph's tables and of what flows between stages."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind() if isinstance(kind, type) else kind, True) for name, kind in columns.items()])


ENTITIES = _schema(entity_id=LongType, kind=StringType, name=StringType, repo=StringType, path=StringType, meta=StringType, first_seen=TimestampType, last_seen=TimestampType)
#: A row is one version of a fact; ``object_id`` and ``object_lit`` exclude each other, ``valid_to`` is null while the fact holds.
FACTS = _schema(fact_id=LongType, subject_id=LongType, predicate=StringType, object_id=LongType, object_lit=StringType, confidence=DoubleType, extractor=StringType, created_at=TimestampType, valid_from=TimestampType, valid_to=TimestampType, superseded_by=LongType)
PROVENANCE = _schema(prov_id=LongType, fact_id=LongType, source_kind=StringType, source_ref=StringType, excerpt=StringType, created_at=TimestampType)
#: What extractors and derivations give, in the order of ``seq``.
CANDIDATES = _schema(seq=LongType, subject_kind=StringType, subject_name=StringType, subject_repo=StringType, subject_path=StringType, predicate=StringType, object_kind=StringType, object_name=StringType, object_lit=StringType, confidence=DoubleType, extractor=StringType, origin=StringType, excerpt=StringType)

#: Predicates of which a subject has one current value on the write path, and those watched for contradictions.
SINGLE_VALUED = ("supersedes",)
WATCHED = ("convention-applies-to", "corrected", "decided", "defined-in", "prefers", "supersedes")
INVERSES = {"calls": "called-by", "imports": "imported-by", "defined-in": "defines", "raises": "raised-by"}
