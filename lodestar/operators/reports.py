"""Sinks for findings: JSON, Markdown and a text table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import place, truncate
from .rules import ordered

#: The title and the table's header.
TITLE = "# Findings Report"
HEADER = "SEV  CODE    LOCATION                         MESSAGE\n---- ------- -------------------------------  ------------------------------\n"


def markdown_line() -> Column:
    at = F.format_string("(`%s`:%d:%d)", F.col("location.path"), F.coalesce("location.line", F.lit(0)), F.coalesce("location.column", F.lit(0)))
    return F.format_string("- **%s %s**: %s %s", "severity", "code", "message", at)


def table_line() -> Column:
    return F.format_string("%-4s %-7s %-31s  %s", F.col("severity"), F.col("code"), truncate(place(F.col("location")), 31), F.col("message"))


def lines(findings: DataFrame, line: Column) -> DataFrame:
    """One line a finding, with its place in the order: a distributed form of the reports."""
    return findings.select("rule_ord", "part", "file_ord", "ord", line.alias("line"))


def _text(findings: DataFrame, line: Column) -> str:
    rows = ordered(lines(findings, line)).select("line").toLocalIterator()
    return "".join(r["line"] + "\n" for r in rows)


def to_markdown(findings: DataFrame) -> str:
    return f"{TITLE}\n\n" + _text(findings, markdown_line())


def to_table(findings: DataFrame) -> str:
    return HEADER + _text(findings, table_line())


def to_json(findings: DataFrame) -> str:
    """A pretty-printed array; rows pass one by one."""
    out = []
    for r in ordered(findings).toLocalIterator():
        out.append({"severity": r["severity"], "code": r["code"], "message": r["message"], "location": r["location"].asDict(), "extra": json.loads(r["extra"])})
    return json.dumps(out, indent=2, ensure_ascii=False)


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object a finding, with its place in the order."""
    shown = F.struct("severity", "code", "message", "location", F.parse_json("extra").alias("extra"))
    return lines(findings, F.to_json(shown, {"ignoreNullFields": "false"}))


def write_json(findings: DataFrame, path: str) -> None:
    """One JSON object a line, written by the executors."""
    json_lines(findings).select("line").write.text(path)


def write_markdown(findings: DataFrame, path: str) -> None:
    """The report's lines in order over the part files, written by the executors."""
    ordered(lines(findings, markdown_line())).select("line").write.text(path)
