"""Registry of named queries and of the SQL that must give the same rows."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame``; ``sql`` runs on the same tables elsewhere."""
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add
