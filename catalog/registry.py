"""All registered queries and checks."""

from catalog import annotation, cleaning, features, modelling, neardup

_PARTS = (cleaning, neardup, features, modelling, annotation)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
