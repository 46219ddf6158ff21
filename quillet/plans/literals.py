"""Small literal tables, written once and given to Spark and to SQL alike."""

from __future__ import annotations

import ast
import datetime
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T


def frame(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]::VARCHAR[]" if not value or isinstance(value[0], str) else "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    return "'" + value.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """`name(columns) AS (VALUES ...)`, for a WITH clause."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def in_list(items) -> str:
    return "(" + ", ".join(literal(x) for x in items) + ")"


def judged_sql(rate: float, burst: int, source: str, key: str = "user_id") -> str:
    """key, event_id and s of every row of source: the tokens that its key's bucket holds when the row comes; it passes from 1 on."""
    t = f"least({burst}.0, a.tokens + (x.last - a.last) / 1e6 * {rate!r})"
    return (
        f"SELECT {key}, unnest(ids) AS event_id, unnest(f.states) AS s FROM (SELECT {key}, ids, list_reduce(list_transform(us, lambda u: {{'tokens': 0.0::DOUBLE, 'last': u::DOUBLE, 'states': []::DOUBLE[]}}), "
        f"lambda a, x: {{'tokens': CASE WHEN {t} >= 1 THEN {t} - 1 ELSE {t} END, 'last': x.last, 'states': list_append(a.states, {t})}}, {{'tokens': {burst}.0::DOUBLE, 'last': us[1]::DOUBLE, 'states': []::DOUBLE[]}}) AS f "
        f"FROM (SELECT {key}, list(epoch_us(ts) ORDER BY ts, event_id) AS us, list(event_id ORDER BY ts, event_id) AS ids FROM {source} GROUP BY {key}))"
    )


# Written-out cases, of every page: the rows are the cases once for each page of the table, and what they name is the page's
# own: in texts the page's number stands before `.org` and in place of {n}, and whole numbers called id, site or page_id
# grow by a thousand for each page. So keys, groups and orders span as many rows as the table gives.

OWN_NUMBERS = ("id", "site", "page_id")
_PAGES = "(SELECT DISTINCT page_id AS page_number FROM pages)"


def each(spark, d: str, schema: str, rows: list[tuple]):
    """The cases of every page, as a table."""
    numbers = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("page_number")).distinct()
    fields = spark.createDataFrame([], schema).schema.fields

    def written(value, kind):
        if isinstance(kind, T.ArrayType):
            return F.array(*map(F.lit, value)).cast(kind) if value is not None else F.lit(None).cast(kind)
        return F.lit(value).cast(kind)

    cases = F.array(*[F.struct(*[written(v, f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows])
    spread = numbers.select("page_number", F.inline(cases))
    number = F.col("page_number").cast("string")
    own = lambda c: F.replace(F.replace(c, F.lit(".org"), F.concat(F.lit("-"), number, F.lit(".org"))), F.lit("{n}"), number)
    columns = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = own(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.transform(c, own)
        elif f.name in OWN_NUMBERS:
            c = c + 1000 * F.col("page_number")
        columns.append(c.alias(f.name))
    return spread.select(*columns)


def each_values(name: str, columns: str, rows: list[tuple]) -> str:
    """The same table for a WITH clause."""
    own = lambda c: f"replace(replace({c}, '.org', '-' || page_number || '.org'), '{{n}}', page_number::VARCHAR)"
    out = []
    for i, c in enumerate(columns.split(", ")):
        seen = [r[i] for r in rows if r[i] is not None]
        if any(isinstance(v, str) for v in seen):
            out.append(f"{own(c)} AS {c}")
        elif any(isinstance(v, (list, tuple)) for v in seen):
            out.append(f"list_transform({c}, lambda x: {own('x')}) AS {c}")
        else:
            out.append(f"{c} + 1000 * page_number AS {c}" if c in OWN_NUMBERS else c)
    return f"{name} AS (SELECT {', '.join(out)} FROM (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns})), {_PAGES})"


def each_result(sql: str) -> str:
    """`SELECT * FROM (VALUES ...) AS t(...)`, the written-out result of one page, as the result of all."""
    body, columns, rest = re.fullmatch(r"SELECT \* FROM \(VALUES (.*)\) AS t\(([^()]*)\)(.*)", sql, re.DOTALL).groups()
    parts = re.split(r"('(?:[^']|'')*')", body)  # texts are the odd ones
    python = "".join(repr(p[1:-1].replace("''", "'")) if i % 2 else re.sub("TRUE", "True", re.sub("FALSE", "False", re.sub("NULL", "None", p.replace("::DOUBLE", ""))))  for i, p in enumerate(parts))
    rows = ast.literal_eval(f"[{python}]")
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    return f"WITH {each_values('t', columns, rows)} SELECT * FROM t{rest}"
