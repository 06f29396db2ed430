"""Exact NTILE by distributed selection, for several scores at once.

``NTILE(k) OVER (ORDER BY value, grain)`` over N rows is decided by the rows
at k - 1 known positions of the order. These boundary rows are searched
for instead of sorting: every round counts, in one scan for all scores and
boundaries, how many rows lie in each of ``BINS`` bins between the bounds
known so far, and goes on in the bin that holds the position, with its
smallest and largest value as new bounds. When a bin holds one value only,
the next column of the order decides; when at most ``FEW`` rows are left,
they are fetched and the boundary is read off. A row's tile is then the
number of boundaries that it lies behind: a comparison with constants.

The input is written once, and its row count and the bounds of all columns
are observed in that write. Nothing is sorted, and nothing is stored per
score. The driver receives bins x boundaries counts a round and at most
``FEW`` rows a boundary, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.materialize import materialize
from ledgerlens.operators.ranking import Key

BINS = 1024
FEW = 4096
_CHARS = 3  # characters behind a common prefix that tell texts apart in a round
_BASE = 0x110000 + 1


@dataclass(frozen=True)
class Part:
    """A column of an order, turned so that it ascends, as SQL text: a decimal
    or binary-compared text. Nulls come first, or else last."""
    value: str
    text: bool
    nulls_first: bool
    scale: int = 0


def _part(df: DataFrame, key: Key) -> Part:
    kind, column = df.schema[key.name].dataType, f"`{key.name}`"
    if isinstance(kind, T.StringType):
        if not key.ascending:
            raise TypeError(f"{key.name}: text can be selected in ascending order only")
        if not kind.isUTF8BinaryCollation():  # UTF8_LCASE orders by lower-cased code points
            column = f"lower(collate({column}, 'UTF8_BINARY'))"
        return Part(column, True, True)
    if isinstance(kind, T.DateType):
        column = f"unix_date({column})"
    elif not isinstance(kind, (T.IntegralType, T.DecimalType)):
        raise TypeError(f"{key.name}: cannot select by {kind.simpleString()}")
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    sign = "" if key.ascending else "-"
    return Part(f"({sign}CAST({column} AS DECIMAL(38,{scale})))", False, key.ascending, scale)


@dataclass
class _Boundary:
    """A position of an order, and what is known of the row there: values of
    the leading columns, and bounds of the next one. ``place`` counts from 1
    among the rows that fit."""
    score: str
    place: int
    rows: int
    fixed: list = field(default_factory=list)
    low: object = None
    high: object = None
    # whether rows with a null in the next column fit as well
    with_null: bool = True

    def state(self) -> tuple:
        return self.score, tuple(self.fixed), self.low, self.high, self.with_null


def _literal(value, part: Part) -> str:
    if part.text:  # as bytes: nothing in it can be taken for SQL
        return f"CAST(X'{value.encode('utf-8', 'surrogatepass').hex()}' AS STRING)"
    return f"CAST('{value:f}' AS DECIMAL(38,{part.scale}))"


def _same(part: Part, value) -> str:
    return f"{part.value} IS NULL" if value is None else f"{part.value} <=> {_literal(value, part)}"


def _fits(b: _Boundary, parts: Sequence[Part]) -> str:
    """Whether a row can be the one at the boundary."""
    out = ["TRUE"] + [_same(part, value) for part, value in zip(parts, b.fixed)]
    if len(b.fixed) < len(parts):
        part = parts[len(b.fixed)]
        inside = "FALSE" if b.low is None else (
            f"coalesce({part.value} BETWEEN {_literal(b.low, part)} AND {_literal(b.high, part)}, FALSE)")
        out.append(f"({inside} OR {part.value} IS NULL)" if b.with_null else inside)
    return " AND ".join(out)


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _text_number(text: str, skip: int) -> int:
    out = 0
    for i in range(skip, skip + _CHARS):
        out = out * _BASE + (ord(text[i]) + 1 if i < len(text) else 0)
    return out


def _bin(b: _Boundary, part: Part) -> str:
    """The bin of a fitting row: it never falls where the value rises, and
    the two bounds have different ones. Nulls come before or after all."""
    if b.low is None or b.low == b.high:
        at = "0"
    else:
        if part.text:
            skip = _common(b.low, b.high)
            number = "0L"
            for i in range(skip + 1, skip + 1 + _CHARS):
                one = f"substring({part.value}, {i}, 1)"
                number = f"({number} * {_BASE}L + IF({one} = '', 0, ascii({one}) + 1))"
            low = _text_number(b.low, skip)
            share, width = f"({number} - {low}L)", _text_number(b.high, skip) - low
        else:
            share, width = f"({part.value} - {_literal(b.low, part)})", b.high - b.low
        at = f"least(floor(CAST({share} AS DOUBLE) / {float(width)!r}D * {BINS}), {BINS - 1})"
    return f"CAST(IF({part.value} IS NULL, {-1 if part.nulls_first else BINS}, {at}) AS INT)"


def _advance(b: _Boundary, bins: list, bounds: dict, parts: Sequence[Part]) -> None:
    """Go on in the bin that holds the place; ``bins`` are ``(bin, rows, low,
    high)`` in order, ``bounds`` those of the columns over all rows."""
    for at, rows, low, high in bins:
        if b.place <= rows:
            break
        b.place -= rows
    b.rows, b.low, b.high, b.with_null = rows, low, high, False
    null = at in (-1, BINS)
    if null or b.low == b.high:
        b.fixed.append(None if null else b.low)
        if len(b.fixed) < len(parts):
            # bounds over all rows: those that fit now have narrower ones, found by counting
            b.low, b.high = bounds[b.score][len(b.fixed)]
            b.with_null = True


def _count(df: DataFrame, open_: list[_Boundary], parts: dict[str, list[Part]]) -> dict:
    """Bins of every state of the open boundaries, from one scan."""
    states = list({b.state(): b for b in open_}.values())
    number = f"DECIMAL(38,{max(p.scale for b in states for p in parts[b.score])})"
    cells = []
    for i, b in enumerate(states):
        part = parts[b.score][len(b.fixed)]
        n, t = ("NULL", part.value) if part.text else (part.value, "NULL")
        cells.append(f"IF({_fits(b, parts[b.score])}, named_struct('s', {i}, 'bin', {_bin(b, part)}, "
                     f"'n', CAST({n} AS {number}), 't', CAST({t} AS STRING)), NULL)")
    rows = df.select(F.expr(_exploded(cells)).alias("c"))
    found = rows.groupBy("c.s", "c.bin").agg(
        F.count(F.lit(1)).alias("rows"), F.min("c.n").alias("n0"), F.max("c.n").alias("n1"),
        F.min("c.t").alias("t0"), F.max("c.t").alias("t1")).collect()
    out: dict = {b.state(): [] for b in states}
    for r in sorted(found, key=lambda r: (r["s"], r["bin"])):
        b = states[r["s"]]
        text = parts[b.score][len(b.fixed)].text
        out[b.state()].append((r["bin"], r["rows"], r["t0"] if text else r["n0"],
                               r["t1"] if text else r["n1"]))
    return out


def _read_off(df: DataFrame, near: list[_Boundary], parts: dict[str, list[Part]]) -> None:
    """Fetch the few rows that fit each boundary, and fix its values."""
    states = list({b.state(): b for b in near}.values())
    cells = []
    for i, b in enumerate(states):
        values = ", ".join(f"CAST({p.value} AS STRING)" for p in parts[b.score])
        cells.append(f"IF({_fits(b, parts[b.score])}, named_struct('s', {i}, 'v', array({values})), NULL)")
    # at most FEW rows a state
    rows = df.select(F.expr(_exploded(cells)).alias("c")).select("c.s", "c.v").collect()
    found: dict = {i: [] for i in range(len(states))}
    for r in rows:
        found[r["s"]].append([v if p.text or v is None else Decimal(v)
                              for p, v in zip(parts[states[r["s"]].score], r["v"])])
    for i, b in enumerate(states):
        known = parts[b.score]
        ranked = sorted(found[i], key=lambda row: [(
            (v is not None) == p.nulls_first, 0 if v is None else v) for p, v in zip(known, row)])
        for other in near:
            if other is not b and other.state() == b.state():
                other.fixed = ranked[other.place - 1]
        b.fixed = ranked[b.place - 1]


def _exploded(cells: list[str]) -> str:
    return f"explode(filter(array({', '.join(cells)}), c -> c IS NOT NULL))"


def _behind(boundary: _Boundary, parts: Sequence[Part]) -> str:
    """Whether a row comes after the boundary row."""
    out = "FALSE"
    for part, value in reversed(list(zip(parts, boundary.fixed))):
        if value is None:
            later = f"{part.value} IS NOT NULL" if part.nulls_first else "FALSE"
        else:
            later = f"coalesce({part.value} > {_literal(value, part)}, {str(not part.nulls_first).upper()})"
        out = f"({later} OR ({_same(part, value)} AND {out}))"
    return out


def with_tiles(df: DataFrame, scores: dict[str, Sequence[Key]], k: int) -> DataFrame:
    """``df`` (written once) with one NTILE(k) column (long) per ``{name:
    order}``. Every order must be total: end it with columns that are unique
    together. Values are integers, decimals or dates, in both directions, and
    text ascending (compared by its collation); nulls come first ascending
    and last descending. With fewer rows than tiles the last tiles are
    empty; an empty input gives no rows.

    Jobs run while the result is built: the write and the counts."""
    parts = {name: [_part(df, key) for key in order] for name, order in scores.items()}
    watch = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    for i, order in enumerate(parts.values()):
        for j, part in enumerate(order):
            metrics += [F.expr(f"min({part.value})").alias(f"low_{i}_{j}"),
                        F.expr(f"max({part.value})").alias(f"high_{i}_{j}")]
    stored = materialize(df.observe(watch, *metrics), "tiles")
    seen = watch.get
    total = seen["rows"]
    bounds = {name: [(seen[f"low_{i}_{j}"], seen[f"high_{i}_{j}"]) for j in range(len(order))]
              for i, (name, order) in enumerate(parts.items())}
    q, r = divmod(total, k)
    places = [t * q + min(t, r) for t in range(1, k)]
    # a boundary at the last row has nothing behind it
    found = [_Boundary(name, place, total, [], *bounds[name][0])
             for name in parts for place in places if 0 < place < total]
    while True:
        open_ = [b for b in found if len(b.fixed) < len(parts[b.score]) and b.rows > FEW]
        if not open_:
            break
        bins = _count(stored, open_, parts)
        before = [(b, b.state()) for b in open_]
        for b, state in before:
            _advance(b, bins[state], bounds, parts[b.score])
    near = [b for b in found if len(b.fixed) < len(parts[b.score])]
    if near:
        _read_off(stored, near, parts)
    tiles = {name: " + ".join(["1L", *[f"IF({_behind(b, order)}, 1L, 0L)" for b in found if b.score == name]])
             for name, order in parts.items()}
    return stored.withColumns({name: F.expr(tile) for name, tile in tiles.items()})
