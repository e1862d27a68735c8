"""Stored parameterised queries (TPL1-3, FLT4).

Templates live in a DataFrame ``(ID, Name, Body)``.  A body uses ``{key}``
placeholders; they are rewritten to named parameter markers and bound by
``spark.sql(body, args=...)``, so values are never spliced into SQL text
(a quoted ``'{key}'`` becomes one string parameter, placeholders inside a longer
literal a concatenation of its parts, and one before ``(`` a function name).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE_SCHEMA = "ID string, Name string, Body string"
_LITERAL = re.compile(r"'(?:[^'\\]|''|\\.)*'|\{(\w+)\}(?=(\s*\())?", re.S)
_KEY = re.compile(r"\{(\w+)\}")


def template_table(spark: SparkSession, rows) -> DataFrame:
    """Templates from ``(name, body)`` pairs or ``(id, name, body)`` triples."""
    full = [r if len(r) == 3 else (str(uuid.uuid5(uuid.NAMESPACE_URL, r[0])), r[0], r[1]) for r in rows]
    return spark.createDataFrame(full, TEMPLATE_SCHEMA)


def template_list(templates: DataFrame, prefix: str = "") -> DataFrame:
    """TPL2/FLT4: templates whose name starts with ``prefix`` (``Name, Body``)."""
    like = (prefix or "").replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return templates.filter(F.col("Name").like(like)).select("Name", "Body")


def to_bound_sql(body: str, identifiers=()) -> tuple[str, list[str]]:
    """``{key}`` / ``'{key}'`` -> ``:key``; returns the SQL and the keys used.

    Keys listed in ``identifiers`` name a table or column, keys before ``(`` a
    function; they become ``IDENTIFIER(:key)``, still bound, never spliced."""
    keys: list[str] = []
    idents = set(identifiers)

    def repl(m):
        k = m.group(1)
        if k:
            keys.append(k)
            return f"IDENTIFIER(:{k})" if k in idents or m.group(2) else f":{k}"
        inner = m.group(0)[1:-1]
        own = _KEY.findall(inner)
        if not own:
            return m.group(0)
        keys.extend(own)
        if inner == "{" + own[0] + "}":
            return f":{own[0]}"
        pieces = _KEY.split(inner)      # text, key, text, key, ..., text
        parts = [f"cast(:{p} as string)" if j % 2 else f"'{p}'" for j, p in enumerate(pieces) if j % 2 or p]
        return f"concat({', '.join(parts)})"
    return _LITERAL.sub(repl, body), keys


def template_body(templates: DataFrame, name: str) -> str:
    """The body of one template (a single small row fetched to the driver)."""
    rows = templates.filter(F.col("Name") == name).select("Body").limit(2).collect()
    if not rows:
        raise KeyError(f"template {name!r} not found")
    return rows[0][0]


def template_exec(spark: SparkSession, templates: DataFrame, name: str, params: dict | None = None,
                  identifiers=()) -> DataFrame:
    """TPL1: run a stored template with bound parameters; a lazy DataFrame."""
    sql, keys = to_bound_sql(template_body(templates, name), identifiers)
    params = dict(params or {})
    missing = [k for k in keys if k not in params]
    if missing:
        raise KeyError(f"template {name!r} needs parameters {missing}")
    return spark.sql(sql, args={k: params[k] for k in set(keys)}) if keys else spark.sql(sql)


def exec_query(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """TPL3: ad hoc SQL over the registered views."""
    return spark.sql(query, args=args) if args else spark.sql(query)
