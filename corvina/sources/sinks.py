"""Sinks: tables, partition-wise replacement, dumps, and small reports as JSON, markdown or HTML."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report is read by people; more rows than this are refused rather than collected.
MAX_REPORT_ROWS = 10_000


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Writes ``df`` partitioned by ``keys``; partitions that it holds are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes ``df`` in place of all that is at ``path``."""
    df.write.mode("overwrite").parquet(path)


def dump_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each table whole, as a folder of its own in the given format (parquet, json, csv, orc)."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(f"{path}/{name}")


def as_json(df: DataFrame, id_column: str, *keep: str) -> DataFrame:
    """(id, the columns ``keep``, row): each row as a JSON object without its nulls."""
    return df.select(id_column, *keep, F.to_json(F.struct(*df.columns)).alias("row"))


def write_report(df: DataFrame, path: str, kind: str = "json", title: str = "") -> int:
    """A small result as one file; returns its rows. Larger results are refused, as they belong in a table."""
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError(f"more than {MAX_REPORT_ROWS} rows")
    cells = [["" if v is None else str(v) for v in r] for r in rows]
    if kind == "json":
        text = json.dumps([r.asDict(recursive=True) for r in rows], default=str, ensure_ascii=False, indent=1)
    elif kind == "markdown":
        lines = [df.columns, ["-"] * len(df.columns), *cells]
        text = (f"# {title}\n\n" if title else "") + "".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |\n" for line in lines)
    elif kind == "html":
        row = lambda tag, line: "<tr>" + "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in line) + "</tr>\n"
        text = f"<h1>{html.escape(title)}</h1>\n<table>\n{row('th', df.columns)}{''.join(row('td', c) for c in cells)}</table>\n"
    else:
        raise ValueError(f"unknown kind {kind}")
    Path(path).write_text(text, encoding="utf-8")
    return len(rows)
