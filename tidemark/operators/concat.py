"""Concatenation along rows (by column name) or columns (by row label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..types import common


def concat(frames: list, axis: int = 0, join: str = "outer", ignore_index: bool = False, sort: bool = False, verify_integrity: bool = False):
    """Nones are skipped. Rows: all columns (outer) or the common ones (inner),
    types that clash become strings. Columns: rows of equal labels side by side,
    the last row of a label counting."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("nothing to concatenate")
    if axis not in (0, 1) or join not in ("outer", "inner"):
        raise ValueError("axis must be 0 or 1, join outer or inner")
    if len(frames) == 1:
        return frames[0]
    return _rows(frames, join, ignore_index, sort, verify_integrity) if axis == 0 else _columns(frames, join, sort)


def _rows(frames: list, join: str, ignore_index: bool, sort: bool, verify_integrity: bool):
    from ..frame import INDEX, Frame

    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    if join == "inner":
        names = [c for c in names if all(c in f.columns for f in frames)]
        if not names:
            raise ValueError("no common column")
    names = sorted(names) if sort else names
    kind = {c: common([f.schema[c].dataType for f in frames if c in f.columns]) for c in names}
    # Default labels are numbered by part on demand; only others are carried.
    labels = not ignore_index and (verify_integrity or any(f._labels or f._origin for f in frames))
    parts = []
    for i, f in enumerate(frames):
        f, rank = _ranked((f.with_labels() if labels else f)._own_order())
        parts.append(f.sdf.select(
            F.lit(i).alias("__part"), rank.alias("__rank"), *([F.col(INDEX)] if labels else []),
            *[(F.col(f"`{c}`").cast(kind[c]) if c in f.columns else F.lit(None).cast(kind[c])).alias(c) for c in names],
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if verify_integrity and labels and not out.groupBy(INDEX).count().where("count > 1").isEmpty():
        raise ValueError("labels repeat")
    return Frame(out, ["__part", "__rank"], labels, parts=None if ignore_index else "__part")


def _ranked(frame):
    """The frame and a long that orders its rows: its only integral key as it
    is, or else the position."""
    from ..types import is_integral

    if len(frame.order) == 1 and is_integral(frame.sdf.schema[frame.order[0]].dataType):
        return frame, F.col(frame.order[0]).cast("bigint")
    if not frame.order:
        return frame, F.monotonically_increasing_id()
    frame, pos = frame.with_positions()
    return frame, F.col(pos)


def _columns(frames: list, join: str, sort: bool):
    from ..frame import INDEX, Frame

    seen: set[str] = set()
    for f in frames:
        if clash := seen & set(f.columns):
            raise ValueError(f"columns on both sides: {sorted(clash)}")
        seen |= set(f.columns)
    out = None
    for i, f in enumerate(frames):
        f = f._own_order().with_labels()
        row = F.struct(*[F.col(f"`{c}`") for c in f.columns])
        last = f.sdf.groupBy(INDEX).agg(F.max_by(row, f._order_struct()).alias(f"__r{i}"))
        out = last if out is None else out.join(last, INDEX, "full" if join == "outer" else "inner")
    out = out.select(INDEX, *[F.col(f"__r{i}.`{c}`").alias(c) for i, f in enumerate(frames) for c in f.columns])
    return Frame(out.withColumn("__label", F.col(INDEX)), ["__label"], True)
