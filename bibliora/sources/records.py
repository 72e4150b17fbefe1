"""Files of records that span lines: read in byte ranges, however large one file is.

A record begins on a line that starts with a marker. Spark's text source takes a separator of any length and finds the
next one after the start of a byte range by itself, so a file is split as one of lines is: a record belongs to the range
in which its separator begins, and is read whole there. What the source cannot tell is whether the first text of a file
had a marker before it; a pass over Arrow batches does, as the first text of the range at 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How harvested section files mark a paper, a failed download, the start of its lines, and a ruler.
PAPER, FAILED, SECTION, RULER = "PAPER: ", "ERROR: Failed to download LaTeX sources", "AFFILIATION SECTION:", "-" * 10
_BYTE_ORDER_MARK = "﻿"


def split_records(spark: SparkSession, path: str | list[str], marker: str) -> DataFrame:
    """(file, block, row, record) of each record of text files: what follows the marker, up to the next line that starts
    with it, without the end of its last line.

    (block, row) order a file's records. Lines before the first record are left out; lines end with LF or CRLF, and come
    with LF; a byte order mark at a file's start is no text; a file without a record has no rows.
    """
    rows = spark.read.option("lineSep", "\n" + marker).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_now, row = None, 0
        for batch in batches:
            files, blocks, records = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            places, kept, heads = [], [], {}
            for n, own in enumerate(zip(files, blocks, strict=True)):
                if own != range_now:
                    range_now, row = own, 0
                    if own[1] == 0:
                        heads[n] = records[n].as_py().removeprefix(_BYTE_ORDER_MARK)
                places.append(row)
                row += 1
                if n not in heads or heads[n].startswith(marker):
                    kept.append(n)
            if any(n in heads for n in kept):
                records = pa.array([heads[n].removeprefix(marker) if n in heads else t for n, t in enumerate(records.to_pylist())], pa.string())
            records = pc.replace_substring(records, "\r\n", "\n")
            records = pc.replace_substring_regex(records, r"[\r\n]\z", "")
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), records], names=["file", "block", "row", "record"])
            yield found.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, "file string, block long, row long, record string")


def section_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, row, title, body) of section files: a paper's title, and what stands below it without long rulers."""
    parts = split_records(spark, path, PAPER)
    title, rest = F.trim(F.substring_index("record", "\n", 1)), F.regexp_replace("record", r"^[^\n]*\n?", "")
    body = F.regexp_replace(F.regexp_replace(rest, r"(?m)^-{70,}\s*$\n?", ""), rf"(?m)^{SECTION}\s*", "")
    return parts.select("file", "block", "row", title.alias("title"), F.btrim(body, F.lit(" \n\t")).alias("body")).filter("title <> ''")


def affiliation_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(title, lines, failures) of the papers of section files, once for each title.

    Lines count from the first line that opens the section on; rulers, blank lines and notices of failed downloads do
    not, but the notices are counted wherever they stand. Of papers with one title the last, by file and place, gives the
    lines, and all of them the failures.
    """
    parts = split_records(spark, path, PAPER)
    every = F.slice(F.split("record", "\n"), 2, F.size(F.split("record", "\n")))
    opened = F.array_position(F.transform(every, lambda x: F.startswith(x, F.lit(SECTION))), F.lit(True))
    after = F.when(opened > 0, F.slice(every, (opened + 1).cast("int"), F.size(every))).otherwise(F.array().cast("array<string>"))
    starts = lambda x: F.startswith(x, F.lit(FAILED)) | F.startswith(x, F.lit(SECTION)) | F.startswith(x, F.lit(RULER))
    kept = F.filter(after, lambda x: ~starts(x) & (F.trim(F.regexp_replace(x, r"\s", " ")) != ""))
    failed = F.size(F.filter(every, lambda x: F.startswith(x, F.lit(FAILED))))
    papers = parts.select(F.struct("file", "block", "row").alias("_at"), F.trim(F.substring_index("record", "\n", 1)).alias("title"), kept.alias("lines"), failed.alias("failures"))
    return papers.groupBy("title").agg(F.max_by("lines", "_at").alias("lines"), F.sum("failures").alias("failures"))

