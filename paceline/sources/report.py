"""Small results as text: Markdown tables and aligned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _cells(df: DataFrame, limit: int) -> list[list[str]]:
    """Header and at most ``limit`` rows as text; more is an error, as a report is small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    text = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    return [df.columns, *([text(x) for x in r] for r in rows)]


def markdown(df: DataFrame, limit: int = 1000) -> list[str]:
    """The lines of a Markdown table."""
    head, *rows = _cells(df, limit)
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(head), line(["---"] * len(head)), *map(line, rows)]


def console(df: DataFrame, limit: int = 1000) -> list[str]:
    """Lines of aligned columns."""
    table = _cells(df, limit)
    widths = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
    return ["  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in table]
