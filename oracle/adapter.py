"""Turns a query over the shop tables into one over the parquet views."""

from __future__ import annotations

import re

from tillwork.sources.starschema import BASE_TABLES, TABLES, sql_text

_PLAIN = {name: name for name in (*BASE_TABLES, *TABLES)}


def _uses(text: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_]+", text))
    return [name for name in TABLES if name in words]


def with_tables(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` behind the common table expressions it needs.

    ``extra`` holds relations shared between oracle queries, in dependency order.
    """
    extra = extra or {}
    words = re.findall(r"[A-Za-z_0-9]+", query)
    chosen_extra: list[str] = []

    def pull(name: str) -> None:
        if name in chosen_extra:
            return
        for word in re.findall(r"[A-Za-z_0-9]+", extra[name]):
            if word in extra and word != name:
                pull(word)
        chosen_extra.append(name)

    for word in words:
        if word in extra:
            pull(word)

    chosen: list[str] = []

    def pull_table(name: str) -> None:
        if name in chosen:
            return
        for other in _uses(sql_text(name, "duckdb")):
            if other != name and "{" + other + "}" in TABLES[name]:
                pull_table(other)
        chosen.append(name)

    for text in [query, *(extra[e] for e in chosen_extra)]:
        for name in _uses(text):
            pull_table(name)

    parts = [f"{name} AS ({sql_text(name, 'duckdb').format(**_PLAIN).strip()})" for name in chosen]
    parts += [f"{name} AS ({extra[name].strip()})" for name in chosen_extra]
    if not parts:
        return query.strip()
    body = query.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
