"""Schemas of the quads table and of the narrow link tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUADS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("harvester", "g", "s", "p", "o", "o_kind", "o_datatype", "o_lang")
    ]
)
QUAD_COLUMNS = QUADS.names
PLACE = ["harvester", "p", "g", "s"]  # what quads are kept in the order of

# Key and payload columns of every link table. Multi-valued properties have one row per value, as
# joins over them must keep bag semantics. A row may be repeated; no operator relies on it being
# there once.
LINK_TABLES = {
    "session": ("harvester", "session_uri", "held_by", "planned_start", "has_start"),
    "session_item": ("harvester", "session_uri", "item_uri"),
    "item": ("harvester", "item_uri"),
    "item_title": ("harvester", "item_uri", "title", "title_datatype", "title_lang"),
    "item_description": ("harvester", "item_uri", "description"),
    "item_doc": ("harvester", "item_uri", "doc_uri"),
    "handling_subject": ("harvester", "handling_uri", "item_uri"),
    "handling_resolution": ("harvester", "handling_uri", "resolution_uri"),
    "handling_vote": ("harvester", "handling_uri", "vote_uri"),
    "resolution": ("harvester", "resolution_uri"),
    "publication": ("harvester", "session_uri", "kind", "url"),
    "publication_source": ("harvester", "url", "derived_from"),
    "harvest_run": ("harvester", "scheduled_job", "title", "status", "modified"),
    "harvest_title": ("harvester", "title"),
    "admin_unit": ("unit_uri", "unit_id", "label", "classification", "dirty"),
    "unit_body": ("unit_uri", "body_uri", "class_label", "kind"),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` in order with their types; an absent column is an error."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def once(quads: DataFrame) -> DataFrame:
    """Each quad once, in the order of ``PLACE``. Quads that are dealt by ``PLACE`` or a part of it are sorted where they are: a row that equals
    the one before it is left out, and nothing but the sort holds rows."""
    rest = F.struct(*[F.col(c) for c in QUAD_COLUMNS if c not in PLACE])
    within = Window.partitionBy(*PLACE).orderBy(*[c for c in QUAD_COLUMNS if c not in PLACE])
    before = quads.withColumn("before", F.lag(rest).over(within))
    return before.filter(~F.col("before").eqNullSafe(rest)).select(*QUAD_COLUMNS)


def require(df: DataFrame, table: str) -> DataFrame:
    """``df`` narrowed to the columns of link table ``table``; an absent column is an error."""
    return df.select(*LINK_TABLES[table])
