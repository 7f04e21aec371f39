"""Reports: small tables as JSON lines, appended or new, and as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(report: DataFrame, folder: str, append: bool = False) -> None:
    """One JSON object a row; null fields are left out. ``append`` adds to the runs that are there."""
    report.write.mode("append" if append else "overwrite").json(folder)


def markdown(report: DataFrame, most_rows: int = 1000) -> str:
    """A report as a Markdown table, rows in the order of its columns. More than ``most_rows`` rows are no report and are refused."""
    rows = report.orderBy(*report.columns).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report of more than {most_rows} rows")
    shown = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [report.columns, ["---"] * len(report.columns), *([shown(x) for x in r] for r in rows)]
    return "".join(f"| {' | '.join(cells)} |\n" for cells in lines)
