"""Registry of the checked queries: each has a Spark plan and, where plain SQL
can say the same, the SQL that checks it."""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        assert name not in QUERIES, name
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
