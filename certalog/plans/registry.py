"""Every query of the engine with the SQL that states the same result."""

from certalog.plans import backfill, entities, ingest, matching, more, products, reads, records, reports, scores, upkeep

_ALL = {**scores.QUERIES, **reports.QUERIES, **records.QUERIES, **more.QUERIES, **ingest.QUERIES, **reads.QUERIES, **upkeep.QUERIES, **matching.QUERIES, **products.QUERIES, **entities.QUERIES, **backfill.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
