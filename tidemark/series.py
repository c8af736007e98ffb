"""One column of a frame with the random-access surface of a vector. Reads are
small queries; "writes" give a new series, as plans are immutable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frame import Frame
from .types import check, dtype_name


class Series:
    def __init__(self, frame: Frame, name: str):
        frame._need(name)
        self.frame, self.name = frame.select(name), name

    @property
    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def __len__(self) -> int:
        return len(self.frame)

    def dtype(self) -> str:
        return dtype_name(self.frame.schema[self.name].dataType)

    def at(self, i: int):
        return self.frame.iloc.at(i, 0)

    def is_null(self, i: int) -> bool:
        return self.at(i) is None

    def null_count(self) -> int:
        return self.frame.null_count()[self.name]

    def values(self) -> list:
        return [r[0] for r in self.frame.collect()]

    def mask(self) -> list[bool]:
        return [v is None for v in self.values()]

    def slice(self, start: int, end: int) -> Series:
        return Series(self.frame.iloc.range(start, end), self.name)

    def _put(self, i: int, value) -> Series:
        f, pos = self.frame.with_positions()
        if not 0 <= i < len(f):
            raise IndexError(f"no row at {i}")
        kind = f.schema[self.name].dataType
        return Series(f.assign(self.name, F.when(F.col(pos) == i, F.lit(value).cast(kind)).otherwise(self.column)), self.name)

    def set(self, i: int, value) -> Series:
        return self._put(i, check(value, self.frame.schema[self.name].dataType, self.name))

    def set_null(self, i: int) -> Series:
        return self._put(i, None)

    def append(self, value) -> Series:
        kind = self.frame.schema[self.name].dataType
        one = Frame.from_rows(self.frame.sdf.sparkSession, [self.name], [[check(value, kind, self.name)]], {self.name: kind})
        return Series(self.frame.concat([one]), self.name)

    def append_null(self) -> Series:
        return self.append(None)
