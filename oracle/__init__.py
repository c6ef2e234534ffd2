"""DuckDB SQL that says the same as the Spark queries, as an independent check."""

from oracle import jobs, metrics, shop
from oracle.adapter import with_tables

_MODULES = [metrics, jobs, shop]


def all_sql() -> dict[str, str]:
    extra: dict[str, str] = {}
    for module in _MODULES:
        extra.update(getattr(module, "SHARED", {}))
    return {name: with_tables(text, extra) for module in _MODULES for name, text in module.SQL.items()}
