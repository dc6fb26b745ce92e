"""The subpackage's queries and the SQL of those that SQL expresses."""

from . import codebooks, decontamination, html, imatch, jaccard, licenses, mixing, quality, records, sharding, toxicity, warc, whitening

MODULES = (sharding, licenses, html, jaccard, toxicity, decontamination, mixing, records, quality, warc, codebooks, imatch, whitening)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
