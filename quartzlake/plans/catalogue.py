"""Names of the queries, what they run, and the SQL that must give the same rows."""

from . import analytics, bars, domain, records

PARTS = (bars, domain, records, analytics)
QUERIES: dict = {name: run for part in PARTS for name, run in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = "full_day_scan"
