"""Equi-joins by name. Null keys match nothing and are kept by outer joins."""

from __future__ import annotations

from pyspark.sql import functions as F

HOW = ("inner", "left", "right", "full")


def merge(left, right, on: list[str], how: str, suffixes: tuple[str, str] | None = None):
    """Left's columns, then right's without the keys. Rows keep the left order, and
    matches of one row the right order; a right join goes by the right order first,
    and a full join has the right's unmatched rows last. Both orders ride along as
    hidden columns, which Catalyst prunes where no one asks; a frame without an
    order gives a result without one. Catalyst and adaptive execution pick the
    strategy by size; nothing is hinted."""
    from ..frame import Frame

    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    if not on:
        raise ValueError("no key columns")
    left._need(*on)
    right._need(*on)
    for k in on:
        a, b = left.schema[k].dataType, right.schema[k].dataType
        if a != b:
            raise TypeError(f"key {k!r} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    l_rest, r_rest = ([c for c in f.columns if c not in on] for f in (left, right))
    clash = set(l_rest) & set(r_rest)
    if clash and not suffixes:
        raise ValueError(f"columns on both sides: {sorted(clash)}; pass suffixes")
    name = lambda c, k: c + suffixes[k] if c in clash else c
    places = [f"__jl{i}" for i in range(len(left.order))], [f"__jr{i}" for i in range(len(right.order))]
    a, b = (f.sdf.select(*[F.col(f"`{c}`") for c in f.columns], F.lit(0).alias(side), *[F.col(f"`{k}`").alias(n) for k, n in zip(f.order, names, strict=True)]) for f, side, names in zip((left, right), ("__jside", "__other"), places, strict=True))
    a, b = a.alias("l"), b.drop("__other").alias("r")
    joined = a.join(b, [F.col(f"l.`{k}`") == F.col(f"r.`{k}`") for k in on], how)
    key = {"right": lambda k: F.col(f"r.`{k}`"), "full": lambda k: F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`"))}.get(how, lambda k: F.col(f"l.`{k}`"))
    out = joined.select(
        F.coalesce("__jside", F.lit(1)).alias("__jside"), *places[0], *places[1],
        *[key(c).alias(c) if c in on else F.col(f"l.`{c}`").alias(name(c, 0)) for c in left.columns], *[F.col(f"r.`{c}`").alias(name(c, 1)) for c in r_rest],
    )
    if not (left.order and right.order):
        return Frame(out)
    return Frame(out, {"right": [*places[1], *places[0]], "full": ["__jside", *places[0], *places[1]]}.get(how, [*places[0], *places[1]]))
