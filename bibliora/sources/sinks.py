"""Writers and incremental updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    """Quoted CSV with a header; lists become JSON."""
    lists = {c: F.to_json(c) for c, kind in rows.dtypes if kind.startswith(("array", "map", "struct"))}
    rows.withColumns(lists).write.mode("append" if append else "overwrite").csv(path, header=True, quoteAll=True, escape='"')


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def not_yet_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run has not written: how a stopped run goes on."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def without_finished(sections: DataFrame, finished: DataFrame, key: str = "title") -> DataFrame:
    """Sections that still need work; keys are compared without case and outer blanks."""
    fold = lambda c: F.lower(F.trim(c))
    return sections.join(finished.select(fold(key).alias("_key")).distinct(), fold(key) == F.col("_key"), "left_anti")


def coverage_text(report: DataFrame) -> str:
    """A coverage row (papers, full_papers, partial_papers, null_slots) as a short text."""
    r = report.first()
    return f"Total papers: {r.papers}\nFully filled papers: {r.full_papers}\nPartially filled papers: {r.partial_papers}\nUnknown slots: {r.null_slots}\n"
