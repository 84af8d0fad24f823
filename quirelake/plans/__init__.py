"""Named queries over the tables, each with SQL that says the same."""

from __future__ import annotations


def queries() -> dict:
    from quirelake.plans import catalogue, documents, events, facts, forms, grids, records, reports, slots

    return slots.QUERIES | records.QUERIES | documents.QUERIES | facts.QUERIES | forms.QUERIES | catalogue.QUERIES | grids.QUERIES | events.QUERIES | reports.QUERIES


def oracle_sql() -> dict[str, str]:
    from quirelake.plans import catalogue, documents, events, facts, forms, grids, records, reports, slots

    return slots.SQL | records.SQL | documents.SQL | facts.SQL | forms.SQL | catalogue.SQL | grids.SQL | events.SQL | reports.SQL
