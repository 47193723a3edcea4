"""The registered queries: operators over the given tables, with the SQL each
result is checked against."""

from . import expressions, feeds, grids, insight, regions, selections, transforms

MODULES = (grids, transforms, insight, selections, regions, expressions, feeds)


def queries():
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
