"""Plain DuckDB SQL for every job, written without the operators of the package.

Each query is a statement over the logical tables (``$name``); ``statement`` puts
the definitions of the tables it uses in front of it.
"""

from __future__ import annotations

from oracle import ads, attribution, blocks, email, experiments, leads, referrals, traffic
from touchline.sources import testdata

QUERIES: dict[str, str] = {
    **traffic.QUERIES,
    **experiments.QUERIES,
    **attribution.QUERIES,
    **email.QUERIES,
    **leads.QUERIES,
    **ads.QUERIES,
    **referrals.QUERIES,
    **blocks.QUERIES,
}


def statement(query: str) -> str:
    """One DuckDB statement over the base tables."""
    definitions = testdata.definitions(testdata.DUCKDB)
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in definitions and name not in ordered:
            for dependency in testdata.references(definitions[name]):
                need(dependency)
            ordered.append(name)

    for name in testdata.references(query):
        need(name)
    tables = ",\n".join(f"{n} AS ({testdata.render(definitions[n])})" for n in ordered)
    return f"WITH {tables}\nSELECT * FROM ({testdata.render(query)}) AS result"


def oracle_sql() -> dict[str, str]:
    return {name: statement(query) for name, query in QUERIES.items()}
