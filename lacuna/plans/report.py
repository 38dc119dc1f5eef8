"""An HTML report of small results: one table each, with a bar where a column is a percentage."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def table(name: str, df: DataFrame, rows: int = 200) -> str:
    found = df.limit(rows).collect()  # a report shows so many rows at most
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(_cell(c, r[c]) for c in df.columns) + "</tr>" for r in found)
    return f"<h2>{html.escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def _cell(column: str, value) -> str:
    text = "" if value is None else f"{value:.6g}" if isinstance(value, float) else html.escape(str(value))
    bar = f'<svg width="60" height="8"><rect width="{0.6 * max(0.0, min(100.0, value)):.1f}" height="8" fill="#4477aa"/></svg>' if column.endswith("_pct") and isinstance(value, (int, float)) else ""
    return f"<td>{bar}{text}</td>"


def report(title: str, results: dict[str, DataFrame], rows: int = 200) -> str:
    style = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{''.join(table(k, v, rows) for k, v in results.items())}</body></html>"
