"""Scalar functions on string and date-time columns. Null in, null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class StrAccessor:
    """String functions of one column; every method gives a Column."""

    def __init__(self, column: Column):
        self._c = column

    def lower(self) -> Column:
        return F.lower(self._c)

    def upper(self) -> Column:
        return F.upper(self._c)

    def strip(self) -> Column:
        """Without white space (Unicode's) at both ends."""
        return F.regexp_replace(self._c, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")

    def title(self) -> Column:
        """First letter of each word upper-cased, the rest left as it is."""
        parts = F.regexp_extract_all(self._c, F.lit(r"(?U)[\w']+|[^\w']+"), F.lit(0))
        return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")

    def replace(self, old: str, new: str) -> Column:
        return F.replace(self._c, F.lit(old), F.lit(new)) if old else F.regexp_replace(self._c, "", re.sub(r"([\\$])", r"\\\1", new))

    def contains(self, part: str) -> Column:
        return self._c.contains(part)

    def startswith(self, prefix: str) -> Column:
        return self._c.startswith(prefix)

    def endswith(self, suffix: str) -> Column:
        return self._c.endswith(suffix)

    def len(self) -> Column:
        """Number of code points."""
        return F.length(self._c).cast("bigint")

    def split(self, sep: str) -> Column:
        """Parts between literal separators, as an array."""
        return F.split(self._c, r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E" if sep else "", -1)


class DtAccessor:
    """Parts of one date-time column."""

    def __init__(self, column: Column):
        self._c = column

    def _part(self, f) -> Column:
        return f(self._c).cast("bigint")

    def year(self) -> Column:
        return self._part(F.year)

    def month(self) -> Column:
        return self._part(F.month)

    def day(self) -> Column:
        return self._part(F.dayofmonth)

    def hour(self) -> Column:
        return self._part(F.hour)

    def minute(self) -> Column:
        return self._part(F.minute)

    def second(self) -> Column:
        return self._part(F.second)

    def weekday(self) -> Column:
        """0 is Sunday."""
        return self._part(F.dayofweek) - 1

    def date(self) -> Column:
        return F.date_format(self._c, "yyyy-MM-dd")


#: Layouts tried in turn where none is named.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")
#: Reference-time tokens of layouts, longest first, and Spark's pattern letters.
TOKENS = (
    ("January", "MMMM"), ("Monday", "EEEE"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("2006", "yyyy"), (".000000", ".SSSSSS"), (".000", ".SSS"),
    ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "zzz"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"),
)


def spark_layout(layout: str) -> str:
    """A reference-time layout (``2006-01-02 15:04:05``) as a Spark pattern;
    anything that holds pattern letters already is taken as it is."""
    if re.search(r"yy|MM|dd|HH", layout):
        return layout
    known, out = dict(TOKENS), []
    for token in re.split("(" + "|".join(re.escape(t) for t, _ in TOKENS) + ")", layout):
        out.append(known.get(token) or re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", token))
    return "".join(out)


def parse_datetime(c: Column, layout: str = "") -> Column:
    """Timestamps without zone (those with an offset in UTC); other text raises."""
    s = F.trim(c)
    if layout:
        tried = [_stamp(s, spark_layout(layout))]
    else:
        tried = [_stamp(s, p) for p in LAYOUTS]
    found = F.coalesce(*tried)
    unread = F.raise_error(F.concat(F.lit("not a date-time: "), c)).cast("timestamp_ntz")
    return F.when(c.isNull(), F.lit(None).cast("timestamp_ntz")).when(found.isNotNull(), found).otherwise(unread)


def _stamp(s: Column, pattern: str) -> Column:
    if re.search("XXX|xxx|zzz", pattern):
        return F.to_utc_timestamp(F.try_to_timestamp(s, F.lit(pattern)), F.current_timezone()).cast("timestamp_ntz")
    return F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")
