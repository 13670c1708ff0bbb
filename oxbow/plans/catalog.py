"""Every registered query of the engine with its oracle."""

from __future__ import annotations

FLAGSHIP = "tar_gz_listing"
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from oxbow.plans import q_containers, q_misc, q_names, q_planning, q_transfer  # noqa: F401
