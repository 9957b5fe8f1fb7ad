"""The functions on serialised sketches, as Arrow UDFs. Bytes that aren't a sketch give null, never an error."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from tessera.functions.codec import Sketch, encode, gamma_of, read
from tessera.functions.native import PERCENTILES

NAN = float("nan")
BIN = pa.struct([("i", pa.int32()), ("c", pa.float64())])
STRUCT = pa.struct([("gamma", pa.float64()), ("index_offset", pa.float64()), ("zero_count", pa.float64()), ("pos", pa.list_(BIN)), ("neg", pa.list_(BIN)), *((x, pa.float64()) for x in ("n", "total", "low", "high"))])
STATS = pa.struct([("count", pa.int64()), *((x, pa.float64()) for x in ("sum", "min", "max", "avg"))])
FULL = pa.struct([("sketch", pa.binary()), ("count", pa.int64()), *((x, pa.float64()) for x in ("sum", "avg", "min", "max", *PERCENTILES))])


def _rows(f: Callable[..., Any], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of each row; null where an argument is null."""
    return pa.array([None if any(x is None for x in row) else f(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], type=kind)


def _of(f: Callable[[Sketch], Any]) -> Callable[..., Any]:
    return lambda data, *rest: None if (s := read(data)) is None else f(s, *rest)


def empty(accuracy: float = 0.01) -> bytes:
    return encode(Sketch(gamma=gamma_of(accuracy)))


def _added(s: Sketch, value: float) -> bytes:
    s.add(value)
    return encode(s)


def _added_floor(s: Sketch, value: float) -> bytes:
    s.add(value, rule="floor")
    return encode(s)


def _merged(a: bytes, b: bytes) -> bytes | None:
    x, y = read(a), read(b)
    return encode(x) if x is not None and y is not None and x.merge(y) else None


def _stats(s: Sketch) -> dict[str, Any]:
    n, *rest = s.summary()
    return {"count": n} | {k: NAN if v is None else v for k, v in zip(("sum", "min", "max", "avg"), rest, strict=True)}


def _full(s: Sketch) -> dict[str, Any]:
    at = {k: s.quantile(q) for k, q in PERCENTILES.items()}
    return {"sketch": encode(s)} | _stats(s) | {k: NAN if v is None else v for k, v in at.items()}


def _struct(s: Sketch) -> dict[str, Any]:
    bins = lambda b: [{"i": i, "c": c} for i, c in b]
    return {"gamma": s.gamma, "index_offset": s.offset, "zero_count": s.zeros, "pos": bins(s.positive), "neg": bins(s.negative), "n": s.count, "total": s.total, "low": s.low, "high": s.high}


def _from_struct(x: dict[str, Any]) -> bytes:
    bins = lambda b: [(y["i"], y["c"]) for y in b or []]
    return encode(Sketch(x["gamma"], x["index_offset"], bins(x["pos"]), bins(x["neg"]), x["zero_count"] or 0.0))


@arrow_udf(from_arrow_type(pa.binary()))
def add(sketch: pa.Array, value: pa.Array) -> pa.Array:
    return _rows(_of(_added), pa.binary(), sketch, value.cast(pa.float64()))


@arrow_udf(from_arrow_type(pa.binary()))
def add_floor(sketch: pa.Array, value: pa.Array) -> pa.Array:
    return _rows(_of(_added_floor), pa.binary(), sketch, value.cast(pa.float64()))


@arrow_udf(from_arrow_type(pa.binary()))
def merge(a: pa.Array, b: pa.Array) -> pa.Array:
    return _rows(_merged, pa.binary(), a, b)


@arrow_udf(from_arrow_type(pa.float64()))
def quantile(sketch: pa.Array, q: pa.Array) -> pa.Array:
    return _rows(_of(Sketch.quantile), pa.float64(), sketch, q.cast(pa.float64()))


@arrow_udf(from_arrow_type(pa.int64()))
def count(sketch: pa.Array) -> pa.Array:
    return _rows(_of(lambda s: s.summary()[0]), pa.int64(), sketch)


@arrow_udf(from_arrow_type(pa.float64()))
def total(sketch: pa.Array) -> pa.Array:
    return _rows(_of(lambda s: s.summary()[1]), pa.float64(), sketch)


@arrow_udf(from_arrow_type(pa.float64()))
def minimum(sketch: pa.Array) -> pa.Array:
    return _rows(_of(lambda s: s.summary()[2]), pa.float64(), sketch)


@arrow_udf(from_arrow_type(pa.float64()))
def maximum(sketch: pa.Array) -> pa.Array:
    return _rows(_of(lambda s: s.summary()[3]), pa.float64(), sketch)


@arrow_udf(from_arrow_type(pa.float64()))
def average(sketch: pa.Array) -> pa.Array:
    return _rows(_of(lambda s: s.summary()[4]), pa.float64(), sketch)


@arrow_udf(from_arrow_type(STATS))
def stats(sketch: pa.Array) -> pa.Array:
    return _rows(_of(_stats), STATS, sketch)


@arrow_udf(from_arrow_type(STRUCT))
def to_struct(sketch: pa.Array) -> pa.Array:
    """The decoded sketch, for the native accessors."""
    return _rows(_of(_struct), STRUCT, sketch)


@arrow_udf(from_arrow_type(pa.binary()))
def from_struct(sketch: pa.Array) -> pa.Array:
    return _rows(_from_struct, pa.binary(), sketch)


def _merge_all(column: pa.Array) -> Sketch | None:
    """Merges what is usable under the finest mapping; null, no bytes and bytes that aren't a sketch are skipped."""
    finest: Sketch | None = None
    for data in column.to_pylist():
        if not data or (s := read(data)) is None:
            continue
        if finest is None or (round(s.gamma, 10), round(s.offset, 10)) < (round(finest.gamma, 10), round(finest.offset, 10)):
            finest = s
        elif s is not finest:
            finest.merge(s)
    return finest


@arrow_udf(from_arrow_type(pa.binary()))
def agg(sketch: pa.Array) -> bytes:
    return None if (s := _merge_all(sketch)) is None else encode(s)


@arrow_udf(from_arrow_type(FULL))
def stats_agg(sketch: pa.Array) -> dict:
    return None if (s := _merge_all(sketch)) is None else _full(s)
