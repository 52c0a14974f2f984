"""Queries by name, their SQL, and pieces of SQL that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_end(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def sql_sanitized(x: str) -> str:
    return sql_trim(rf"""regexp_replace(regexp_replace({x}, '[<>:"/\\|?*\x00-\x1f]', '', 'g'), '\.+$', '')""")


def sql_key(x: str) -> str:
    return rf"regexp_replace(lower({sql_sanitized(x)}), '[\s_-]+', '', 'g')"


def sql_page_text(x: str) -> str:
    return sql_trim(rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '([A-Za-z])-\s+([A-Za-z])', '\1\2', 'g')")


def sql_escaped(x: str) -> str:
    return rf"regexp_replace({x}, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g')"


def sql_linked(text: str, name: str) -> str:
    """Each place of name, whatever its case, made a link; for texts that have no links yet."""
    return f"regexp_replace({text}, '(?i)' || {sql_escaped(name)}, '[[' || {name} || ']]', 'g')"


def sql_ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def sql_at_sentence(text: str, most: str) -> str:
    part = f"substring({text}, 1, {most})"
    whole = f"regexp_extract({part}, '(?s)^(.*[.?!]) ', 1)"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN length({whole}) - 1 > 0.6 * {most} THEN {sql_trim(whole)} ELSE {sql_trim(part)} END"
