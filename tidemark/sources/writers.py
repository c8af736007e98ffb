"""Sinks. With a path, Spark's writers make a directory of part files; the text
forms for small frames, and workbooks, go through the driver row by row."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import functions as F

from ..types import family, is_integral
from . import xlsx


#: Rows of a text form, which the driver builds; more are an error.
TEXT_ROWS = 1_000_000


def _text_rows(sdf):
    for i, row in enumerate(sdf.toLocalIterator()):
        if i == TEXT_ROWS:
            raise ValueError(f"over {TEXT_ROWS} rows; give a path")
        yield row


def _ordered(frame):
    sdf = frame.sdf.orderBy(*frame._order_columns()) if frame.order else frame.sdf
    return sdf.select(*[F.col(f"`{c}`") for c in frame.columns])


def to_csv(frame, path: str = "", sep: str = ",") -> str | None:
    """Header and rows, cells quoted where needed, null as an empty cell."""
    if path:
        frame.to_spark().write.mode("overwrite").options(header=True, sep=sep, nullValue="", emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        return None
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")
    writer.writerow(frame.columns)
    show = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else v
    for row in _text_rows(_ordered(frame)):
        writer.writerow([show(v) for v in row])
    return out.getvalue()


def to_json(frame, path: str = "") -> str | None:
    """Records with their columns in order and null kept; lines in files, one
    array as text."""
    if path:
        frame.to_spark().write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return None
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), {"ignoreNullFields": "false"})
    return json.dumps([json.loads(r[0]) for r in _text_rows(_ordered(frame).select(record))], ensure_ascii=False)


def to_parquet(frame, path: str, null_mode: str = "keep") -> None:
    """``zero`` writes nulls as 0, "" or false, and the columns in text order."""
    if not frame.columns:
        raise ValueError("no columns")
    if null_mode not in ("keep", "zero"):
        raise ValueError("null_mode must be keep or zero")
    out = frame.to_spark()
    if null_mode == "zero":
        zero = {"number": 0, "bool": False}
        cells = []
        for c in sorted(frame.columns):
            kind = frame.schema[c].dataType
            x = F.col(f"`{c}`")
            cells.append(F.coalesce(x.cast("bigint" if is_integral(kind) else "double") if family(kind) == "number" else x if family(kind) == "bool" else x.cast("string"), F.lit(zero.get(family(kind), ""))).alias(c))
        out = out.select(*cells)
    out.write.mode("overwrite").parquet(path)


def to_excel(frame, path: str, sheet: str = "Sheet1") -> None:
    xlsx.write(path, sheet, frame.columns, _ordered(frame).toLocalIterator())
