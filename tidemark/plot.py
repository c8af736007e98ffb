"""Charts as self-contained HTML with inline SVG. Binning and statistics run in
Spark; what is drawn point by point is bounded by ``max_points``, beyond which
the caller must aggregate (or sample) first."""

from __future__ import annotations

from dataclasses import dataclass
from html import escape
from math import cos, isfinite, pi, sin
from pathlib import Path

from pyspark.sql import functions as F

from .operators import statistics
from .types import family, is_numeric

#: Colours of series, in order.
COLOURS = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5", "#9c6b4e", "#9498a0")


@dataclass
class ChartOptions:
    output_path: str = ""
    title: str = ""
    width: int = 900
    height: int = 500
    theme: str = "light"
    max_points: int = 10_000


def _options(given: dict) -> ChartOptions:
    o = ChartOptions(**given)
    if not o.output_path:
        raise ValueError("output_path is needed")
    if o.width <= 0 or o.height <= 0:
        o.width, o.height = o.width if o.width > 0 else 900, o.height if o.height > 0 else 500
    return o


def _numbers(frame, *columns: str) -> None:
    frame._need(*columns)
    if bad := [c for c in columns if not is_numeric(frame.schema[c].dataType)]:
        raise TypeError(f"columns {bad} aren't numeric")


def _points(frame, columns: list[str], o: ChartOptions, known: list[str]) -> list[tuple]:
    """Rows where all of ``known`` are there, in row order."""
    f = frame.select(*columns).dropna("any", known) if known else frame.select(*columns)
    rows = (f.sdf.orderBy(*f._order_columns()) if f.order else f.sdf).select(*[F.col(f"`{c}`") for c in columns]).limit(o.max_points + 1).collect()
    if len(rows) > o.max_points:
        raise ValueError(f"over {o.max_points} points; aggregate first")
    if not rows:
        raise ValueError("nothing to draw")
    return [tuple(r) for r in rows]


def _page(o: ChartOptions, body: str) -> None:
    dark = o.theme == "dark"
    page = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(o.title)}</title></head><body style="background:{"#1b1e23" if dark else "#ffffff"};color:{"#e8e8e8" if dark else "#222222"};font-family:sans-serif"><h2>{escape(o.title)}</h2><svg width="{o.width}" height="{o.height}" viewBox="0 0 {o.width} {o.height}" fill="currentColor" font-size="11">{body}</svg></body></html>'
    Path(o.output_path).write_text(page, encoding="utf-8")


class _Axes:
    """Linear scales into the drawing area, with ticks."""

    def __init__(self, o: ChartOptions, xs: list[float], ys: list[float]):
        xs, ys = [x for x in xs if isfinite(x)] or [0.0], [y for y in ys if isfinite(y)] or [0.0]
        self.o, self.x, self.y = o, (min(xs), max(xs)), (min(ys), max(ys))

    def px(self, v: float) -> float:
        lo, hi = self.x
        return 60 + (v - lo) / ((hi - lo) or 1) * (self.o.width - 80)

    def py(self, v: float) -> float:
        lo, hi = self.y
        return self.o.height - 40 - (v - lo) / ((hi - lo) or 1) * (self.o.height - 60)

    def ticks(self) -> str:
        out = [f'<path d="M60 20V{self.o.height - 40}H{self.o.width - 20}" fill="none" stroke="currentColor"/>']
        for i in range(6):
            v = self.y[0] + (self.y[1] - self.y[0]) * i / 5
            out.append(f'<text x="55" y="{self.py(v):.1f}" text-anchor="end">{v:.6g}</text>')
        return "".join(out)


def _labels(names: list[str], centre) -> str:
    step = max(1, len(names) // 25)
    return "".join(f'<text x="{centre(i):.1f}" y="98%" text-anchor="middle">{escape(str(n))[:24]}</text>' for i, n in enumerate(names) if i % step == 0)


def _bars(o: ChartOptions, names: list[str], values: list[float]) -> None:
    a = _Axes(o, [0, len(values)], [0, *values])
    w = a.px(1) - a.px(0)
    body = "".join(f'<rect x="{a.px(i) + w * 0.1:.1f}" y="{min(a.py(v), a.py(0)):.1f}" width="{w * 0.8:.1f}" height="{abs(a.py(v) - a.py(0)):.1f}" fill="{COLOURS[0]}"><title>{escape(str(n))}: {v}</title></rect>' for i, (n, v) in enumerate(zip(names, values, strict=True)) if isfinite(v))
    _page(o, a.ticks() + body + _labels(names, lambda i: a.px(i + 0.5)))


def bar(frame, x: str, y: str, **options) -> None:
    o = _options(options)
    _numbers(frame, y)
    rows = _points(frame, [x, y], o, [x, y])
    _bars(o, [str(r[0]) for r in rows], [float(r[1]) for r in rows])


def pie(frame, label: str, value: str, **options) -> None:
    o = _options(options)
    _numbers(frame, value)
    rows = [(str(a), float(b)) for a, b in _points(frame, [label, value], o, [label, value])]
    total = sum(v for _, v in rows if v > 0) or 1.0
    cx, cy, r, at, body = o.width / 2, o.height / 2, min(o.width, o.height) / 2 - 40, -pi / 2, ""
    for i, (n, v) in enumerate(rows):
        if v <= 0:
            continue
        turn = min(v / total, 0.99999) * 2 * pi
        x0, y0, x1, y1 = cx + r * cos(at), cy + r * sin(at), cx + r * cos(at + turn), cy + r * sin(at + turn)
        mid = at + turn / 2
        body += f'<path d="M{cx:.1f} {cy:.1f}L{x0:.2f} {y0:.2f}A{r:.1f} {r:.1f} 0 {int(turn > pi)} 1 {x1:.2f} {y1:.2f}Z" fill="{COLOURS[i % len(COLOURS)]}"><title>{escape(n)}: {v}</title></path><text x="{cx + (r + 15) * cos(mid):.1f}" y="{cy + (r + 15) * sin(mid):.1f}" text-anchor="middle">{escape(n)}</text>'
        at += turn
    _page(o, body)


def line(frame, x: str, ys: list[str], **options) -> None:
    o = _options(options)
    if not ys:
        raise ValueError("no series")
    _numbers(frame, *ys)
    rows = _points(frame, [x, *ys], o, [x])
    numeric = family(frame.schema[x].dataType) == "number"
    at = [float(r[0]) if numeric else float(i) for i, r in enumerate(rows)]
    a = _Axes(o, at, [float(v) for r in rows for v in r[1:] if v is not None])
    body = ""
    for k, name in enumerate(ys):
        d, pen = "", "M"
        for p, r in zip(at, rows, strict=True):
            v = r[k + 1]
            if v is None or not isfinite(v):
                pen = "M"
                continue
            d, pen = d + f"{pen}{a.px(p):.1f} {a.py(float(v)):.1f}", "L"
        colour = COLOURS[k % len(COLOURS)]
        body += f'<path d="{d}" fill="none" stroke="{colour}" stroke-width="2"/><text x="70" y="{20 + 14 * k}" fill="{colour}">{escape(name)}</text>'
    _page(o, a.ticks() + body + _labels([str(r[0]) for r in rows], lambda i: a.px(at[i])))


def scatter(frame, x: str, y: str, **options) -> None:
    o = _options(options)
    _numbers(frame, x, y)
    rows = _points(frame, [x, y], o, [x, y])
    a = _Axes(o, [float(r[0]) for r in rows], [float(r[1]) for r in rows])
    body = "".join(f'<circle cx="{a.px(float(u)):.1f}" cy="{a.py(float(v)):.1f}" r="3" fill="{COLOURS[0]}"/>' for u, v in rows if isfinite(u) and isfinite(v))
    _page(o, a.ticks() + body + "".join(f'<text x="{a.px(v):.1f}" y="98%" text-anchor="middle">{v:.6g}</text>' for v in a.x))


def histogram_bins(frame, column: str, bins: int = 10):
    """(bin, lo, hi, count) of equal widths, as a DataFrame; the largest value is
    in the last bin, constant data make one. Two narrow passes, no rows moved."""
    _numbers(frame, column)
    bins = bins if bins > 0 else 10
    v = F.col(f"`{column}`").cast("double")
    data = frame._data().where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    lo, hi = data.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        raise ValueError("nothing to draw")
    bins = 1 if lo == hi else bins
    width = (hi - lo) / bins
    at = F.lit(0) if lo == hi else F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    return data.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "count")


def histogram(frame, column: str, bins: int = 10, **options) -> None:
    o = _options(options)
    rows = histogram_bins(frame, column, bins).orderBy("bin").collect()
    got = {r["bin"]: r for r in rows}
    last = max(got)
    width, lo = rows[0]["hi"] - rows[0]["lo"], rows[0]["lo"] - rows[0]["bin"] * (rows[0]["hi"] - rows[0]["lo"])
    names = [f"{lo + i * width:.4g}" for i in range(last + 1)]
    _bars(o, names, [float(got[i]["count"]) if i in got else 0.0 for i in range(last + 1)])


def heatmap(frame, **options) -> None:
    """Numeric columns by row labels; null cells are left out."""
    o = _options(options)
    columns = statistics.numeric(frame)
    if not columns:
        raise ValueError("no numeric column")
    f = frame.select(*columns).with_labels()
    rows = f.sdf.orderBy(*f._order_columns()).select("__index", *[F.col(f"`{c}`") for c in columns]).limit(o.max_points + 1).collect()
    if not rows or len(rows) > o.max_points:
        raise ValueError(f"{len(rows)} rows to draw")
    known = [float(v) for r in rows for v in r[1:] if v is not None and isfinite(v)] or [0.0]
    lo, span = min(known), (max(known) - min(known)) or 1.0
    w, h, body = (o.width - 120) / len(columns), (o.height - 60) / len(rows), ""
    for j, r in enumerate(rows):
        body += f'<text x="95" y="{20 + h * (j + 0.6):.1f}" text-anchor="end">{escape(str(r[0]))}</text>'
        for i, v in enumerate(r[1:]):
            if v is not None and isfinite(v):
                t = (v - lo) / span
                body += f'<rect x="{100 + w * i:.1f}" y="{20 + h * j:.1f}" width="{w:.1f}" height="{h:.1f}" fill="rgb({int(247 - 180 * t)},{int(251 - 130 * t)},{int(255 - 60 * t)})"><title>{escape(columns[i])}: {v}</title></rect>'
    body += "".join(f'<text x="{100 + w * (i + 0.5):.1f}" y="{o.height - 20}" text-anchor="middle">{escape(c)}</text>' for i, c in enumerate(columns))
    _page(o, body)
