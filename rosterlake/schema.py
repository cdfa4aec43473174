"""Schemas of the entity record, the list document, list metadata and the index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "name string, aliases array<string>, country string, address string, status string, effective_date string, federal_register string, notes string"
DOCUMENT = f"list_id string, source_file string, extracted string, count long, entities array<struct<{', '.join(p.replace(' ', ': ', 1) for p in ENTITY.split(', '))}>>"
META = "generated string, dcl_url string, lists array<struct<" + ", ".join(f"{c}: string" for c in ("id", "short_name", "official_name", "agency", "agency_short", "authority", "official_url", "official_url_label", "snapshot", "update_cadence", "description", "researcher_note")) + ">>"
FIELDS = [p.split()[0] for p in ENTITY.split(", ")]


def entity(**given: Column) -> list[Column]:
    """The eight fields in order: what is given, an empty array for aliases and null for the rest where it is not."""
    out = []
    for name in FIELDS:
        if name == "aliases":
            got = F.coalesce(given.get(name, F.lit(None)).cast("array<string>"), F.array().cast("array<string>"))
        else:
            got = given.get(name, F.lit(None)).cast("string")
        out.append(got.alias(name))
    return out
