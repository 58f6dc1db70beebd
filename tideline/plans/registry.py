"""All queries of the library outside the optional subpackage, and their SQL."""

from . import model, prepare, study, suggest, work

MODULES = [prepare, work, study, model, suggest]
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
