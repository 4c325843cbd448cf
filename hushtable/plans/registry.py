"""Queries of the release pipeline and the SQL that states the same results."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query function of (spark, sf_dir) under a name, with its SQL where SQL can state it."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep
