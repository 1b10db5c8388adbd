"""Adapter views: the shapes the operators read, derived from the driver's tables by Spark, and the same in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TEXT = open(__file__.replace("views.py", "views.sql"), encoding="utf-8").read()
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _parse() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for name, engine, body in re.findall(r"-- view: (\w+) (\w+)\n(.*?)(?=\n-- view:|\Z)", _TEXT, re.S):
        for one in ("spark", "duckdb") if engine == "both" else (engine,):
            out.setdefault(name, {})[one] = body.strip()
    return out


VIEWS = _parse()


def needs(sql: str) -> list[str]:
    """Views that a statement reads, those they read first."""
    out: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in out:
            out = list(dict.fromkeys([*out, *(x for x in needs(VIEWS[name]["duckdb"]) if x != name), name]))
    return out


def duckdb(sql: str) -> str:
    """A statement with the views that it reads as common table expressions; its own WITH list may follow."""
    ctes = ", ".join(f"{v} AS (\n{VIEWS[v]['duckdb']}\n)" for v in needs(sql))
    recursive = bool(re.match(r"\s*WITH\s+RECURSIVE\b", sql, re.I))
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I) if re.match(r"\s*WITH\b", sql, re.I) else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not ctes:
        return sql.strip()
    return f"{head}{ctes}, {body}".strip() if body else f"{head}{ctes}\n{sql.strip()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or an adapter view over one folder of tables."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]["spark"]
    args = {}
    for own in dict.fromkeys(re.findall(r"\bv_\w+", sql)):
        if own in VIEWS and own != name:
            args[own] = table(spark, sf_dir, own)
    for own in _TABLES:
        if re.search(rf"\b(FROM|JOIN)\s+{own}\b", sql):
            args[own] = table(spark, sf_dir, own)
    for own in sorted(args, key=len, reverse=True):
        sql = re.sub(rf"\b(FROM|JOIN)\s+{own}\b", rf"\1 {{{own}}} AS {own}" if not re.search(rf"\b(FROM|JOIN)\s+{own}\s+(?!LATERAL|WHERE|JOIN|GROUP|LEFT|UNION|SELECT)\w", sql) else rf"\1 {{{own}}}", sql)
    return spark.sql(_brace_safe(sql, args), **args)


def _brace_safe(sql: str, args: dict) -> str:
    """spark.sql formats braces; keep those of the view names alone."""
    for k in args:
        sql = sql.replace("{" + k + "}", f"\x00{k}\x01")
    return sql.replace("{", "{{").replace("}", "}}").replace("\x00", "{").replace("\x01", "}")
