"""Record sinks and the preview."""

from __future__ import annotations

import csv
import io
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW_FIELDS, PREVIEW_ROWS, PREVIEW_CHARS = 6, 25, 40


def save_json(records: DataFrame, path: str) -> None:
    """JSON lines, one record per line, written in parallel."""
    records.select(F.col("rec_json").alias("value")).write.mode("overwrite").text(path)


def field_order(records: DataFrame) -> DataFrame:
    """Every key of the records with the place it is first seen at.

    The minimum combines before the shuffle: each task sends a row per distinct key.
    """
    keys = records.select(
        "page_id", "rec_ord", F.posexplode(F.map_keys("rec")).alias("pos", "field")
    )
    return keys.groupBy("field").agg(
        F.min(F.struct("page_id", "rec_ord", "pos")).alias("first_seen")
    )


def _lines(batches, names: list[str], most: int = 4_000_000):
    """Records of one task as CSV lines, in batches of about ``most`` characters."""
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")

    def line(cells) -> str:
        buffer.seek(0)
        buffer.truncate()
        writer.writerow(cells)
        return buffer.getvalue()[:-1]

    out, size, top = [], 0, line(names) + "\n"
    for rows in batches:
        for entries in rows.column(0):
            rec = dict(entries.as_py() or ())
            out.append(top + line(map(rec.get, names)))
            top, size = "", size + len(out[-1])
            if size >= most:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def csv_lines(records: DataFrame) -> DataFrame | None:
    """Each record as one CSV line (column ``value``), the header before the first line of every task.

    All keys in first-seen order. They are one list that every task goes over with a
    record's keys in a dictionary, so neither the plan nor the work for a line grows with the product
    of both. A missing key or a null is empty, like an empty text; quotes inside
    quoted texts are doubled (read with ``escape='"'``). Only the list of keys comes to the
    driver, which a header needs. None when no record has a key.
    """
    names = [r["field"] for r in field_order(records).orderBy("first_seen").collect()]
    if not names:
        return None
    return records.select("rec").mapInArrow(partial(_lines, names=names), "value string")


def save_csv(records: DataFrame, path: str) -> bool:
    """CSV with a header line per part file; nothing is written without records.

    A task writes one file, so its first line is the file's.
    """
    lines = csv_lines(records)
    if lines is None:
        return False
    lines.write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)
    return True


def preview(records: DataFrame, schema: dict) -> DataFrame:
    """The first records as a table: six fields, 25 rows, 40 characters a cell."""
    shown = list(schema)[:PREVIEW_FIELDS]
    cells = [
        F.coalesce(
            F.substring(
                F.when(
                    F.map_contains_key("rec", f), F.coalesce(F.col("rec")[f], F.lit("None"))
                ),
                1,
                PREVIEW_CHARS,
            ),
            F.lit(""),
        ).alias(f)
        for f in shown
    ]
    return (
        records.orderBy("page_id", "rec_ord").limit(PREVIEW_ROWS).select("page_id", "rec_ord", *cells)
    )
