"""Table schemas, their evolution and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _T, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


AUTHORS_CORE = _table(author_id=_L, author_name=_S, aozora_author_url=_S, birth_year=_I, death_year=_I, wikipedia_url=_S, created_at=_T, updated_at=_T)
AUTHORS_ADDED = _table(author_name_kana=_S, period=_S, description=_S, portrait_url=_S, copyright_status=_S, aozora_works_count=_I, alias_info=_S, section=_S, works_count=_I, total_sentences=_I, source_system=_S, verification_status=_S)
WORKS = _table(work_id=_L, title=_S, author_id=_L, aozora_work_url=_S, card_id=_S, publication_year=_I, content_length=_I, sentence_count=_I, processed_at=_T, created_at=_T, updated_at=_T)
SENTENCES = _table(sentence_id=_L, work_id=_L, sentence_order=_I, sentence_text=_S, char_count=_I, created_at=_T)
PLACE_MASTERS = _table(
    master_id=_L, normalized_name=_S, display_name=_S, canonical_name=_S, latitude=_D, longitude=_D, geocoding_source=_S, geocoding_confidence=_D, geocoding_timestamp=_T,
    place_type=_S, prefecture=_S, municipality=_S, district=_S, usage_count=_L, first_used_at=_T, last_used_at=_T, validation_status=_S, created_at=_T, updated_at=_T,
)
PLACE_ALIASES = _table(alias_id=_L, master_id=_L, alias_name=_S, alias_type=_S, confidence=_D, created_at=_T)
SENTENCE_PLACES = _table(relation_id=_L, sentence_id=_L, master_id=_L, matched_text=_S, start_position=_I, end_position=_I, extraction_confidence=_D, extraction_method=_S, ai_verified=_B, ai_confidence=_D, ai_verification_date=_T, created_at=_T)
DEFAULTS = {"copyright_status": "expired", "aozora_works_count": 0, "works_count": 0, "total_sentences": 0, "source_system": "v4.0", "verification_status": "pending"}


def evolve(df: DataFrame, added: T.StructType = AUTHORS_ADDED, defaults: dict = DEFAULTS) -> DataFrame:
    """``df`` with the columns it lacks, and defaults for their nulls."""
    for field in added.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(defaults.get(field.name)).cast(field.dataType))
    return df.fillna({k: v for k, v in defaults.items() if k in added.names})


def schema_diff(df: DataFrame, expected: T.StructType) -> DataFrame:
    """``side, column_name``: columns that are missing or extra."""
    rows = [("missing", c) for c in expected.names if c not in df.columns] + [("extra", c) for c in df.columns if c not in expected.names]
    return df.sparkSession.createDataFrame(rows, "side string, column_name string")
