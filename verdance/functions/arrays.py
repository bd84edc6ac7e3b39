"""Expressions over spectra held as ``ARRAY<DOUBLE>``.

The functions of this package take and return Spark SQL expression text, for
``selectExpr`` and ``expr``. A plan of this size is several thousand ``Column``
calls otherwise, each a round trip to the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def num(value: float) -> str:
    """Double literal."""
    return f"{float(value)!r}D"


def bind(values: Mapping[str, str], name: str, body: str) -> str:
    """Evaluate ``values`` once and use them in ``body`` as ``name.field``.

    An expression inside an array lambda is evaluated once per element;
    binding it first keeps per-file scalars out of the per-pixel loop.
    """
    return f"get(transform(array({record(values)}), {name} -> {body}), 0)"


def record(values: Mapping[str, str]) -> str:
    """Struct with explicit field names."""
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in values.items()) + ")"


def pixels(arr: str, first: int, last: int) -> str:
    """Inclusive 1-based pixel range."""
    return f"slice({arr}, {first}, {last - first + 1})"


def pick(arr: str, ranges: Iterable[tuple[int, int]]) -> str:
    """Some pixel ranges, joined end to end."""
    parts = [pixels(arr, lo, hi) for lo, hi in ranges]
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def strict_sum(arr: str) -> str:
    """Sum that is NULL as soon as one element is NULL."""
    return f"aggregate({arr}, 0D, (acc, v) -> acc + v)"


def strict_mean(arr: str) -> str:
    return bind({"a": arr}, "mean_of", f"try_divide({strict_sum('mean_of.a')}, double(size(mean_of.a)))")


def median(arr: str) -> str:
    """Exact median; NULL when an element is NULL or the array is empty."""
    # NULLs sort first, so one look at the front finds them
    middle = """CASE WHEN size(s.v) = 0 OR get(s.v, 0) IS NULL THEN NULL
                     WHEN size(s.v) % 2 = 1 THEN get(s.v, size(s.v) div 2)
                     ELSE (get(s.v, size(s.v) div 2 - 1) + get(s.v, size(s.v) div 2)) / 2D END"""
    return bind({"v": f"sort_array({arr})"}, "s", middle)


def lower_bound(arr: str, value: str, longest: int) -> str:
    """How many elements of a rising array are below ``value``, by halving; ``longest`` bounds the array's length."""
    middle = "int((b.lo + b.hi) div 2)"
    step = f"""if(b.lo >= b.hi, b, if(get({arr}, {middle}) < {value},
        named_struct('lo', {middle} + 1, 'hi', b.hi), named_struct('lo', b.lo, 'hi', {middle})))"""
    return (
        f"if({arr} IS NULL, NULL, aggregate(sequence(1, {longest.bit_length()}),"
        f" named_struct('lo', 0, 'hi', size({arr})), (b, k) -> {step}, b -> b.lo))"
    )


def forward_difference(arr: str) -> str:
    """Step to the next element; the last element repeats the step before it."""
    return bind(
        {"w": arr},
        "axis",
        "transform(axis.w, (v, i) -> if(i + 1 < size(axis.w), get(axis.w, i + 1) - v,"
        " v - get(axis.w, i - 1)))",
    )


def finite(value: str) -> str:
    """NULL is the only missing marker: NaN and infinite values become NULL."""
    return f"if(abs({value}) < double('Infinity'), {value}, NULL)"
