"""Column expressions: every scalar function, as built-in Spark expressions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortscope import vocab as V


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c, fill: float = 0.0) -> Column:
    """NULL becomes ``fill``."""
    return F.coalesce(col(c), F.lit(fill))


def flag(cond: Column) -> Column:
    """0/1 from a condition; an unknown comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def total(cols) -> Column:
    """Row sum, NULL counted as 0."""
    return reduce(add, [nz(c) for c in cols]) if cols else F.lit(0.0)


def row_max(cols) -> Column:
    """Largest value of a row, NULL counted as 0."""
    parts = [nz(c) for c in cols] or [F.lit(0.0)]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def safe_ratio(a: Column, b: Column) -> Column:
    return a / (F.abs(b) + F.lit(V.EPS))


def log1p0(c) -> Column:
    """``log1p`` of the positive part, NULL counted as 0."""
    return F.log1p(F.greatest(nz(c), F.lit(0.0)))


def null_if_nan(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def nan_as_null(df):
    """NaN means "not known" everywhere: it becomes NULL where a table is read."""
    return df.withColumns({c: null_if_nan(f"`{c}`") for c, kind in df.dtypes
                           if kind in ("double", "float")})


def norm01(c: Column, lo: float, hi: float) -> Column:
    """Linear map of [lo, hi] onto [0, 1]; an empty range maps to 0."""
    if hi <= lo:
        return F.lit(0.0)
    return clip((c - F.lit(float(lo))) / F.lit(float(hi) - float(lo) + V.EPS), 0, 1)


def ladder(c: Column, edges: list, labels: list[str], right_closed: bool = False,
           default: str | None = None) -> Column:
    """Label of the interval a value falls in.

    Left-closed intervals run from the last edge upward; right-closed ones need one
    more edge than labels and leave values outside the edges to ``default``.
    """
    out = None
    if right_closed:
        for lo, hi, label in zip(edges[:-1], edges[1:], labels):
            cond = (c > lo) & (c <= hi)
            out = F.when(cond, label) if out is None else out.when(cond, label)
    else:
        tops = list(edges[1:]) + [None]
        for lo, hi, label in zip(edges, tops, labels):
            cond = (c >= lo) if hi is None else (c >= lo) & (c < hi)
            out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(default))


def income_band(agi: Column) -> Column:
    return ladder(agi, V.INCOME_EDGES, V.INCOME_BANDS, default=V.UNKNOWN)


def age_group(age: Column) -> Column:
    return ladder(nz(age, 45.0), V.AGE_EDGES, V.AGE_GROUPS, right_closed=True)


def row_entropy(cols: list[str]) -> Column:
    """Shannon entropy in bits of the non-negative parts of a row; 0 for an empty row.

    Kept to ten decimals, so that equal mixes stay ties when the value is ranked.
    """
    if not cols:
        return F.lit(0.0)
    parts = [F.greatest(nz(c), F.lit(0.0)) for c in cols]
    whole = reduce(add, parts)
    terms = [F.when(p > 0, -(p / whole) * F.log2(p / whole)).otherwise(0.0) for p in parts]
    return F.when(whole > 0, F.floor(reduce(add, terms) * 1e10 + 0.5) / 1e10).otherwise(0.0)


def first_digit(c) -> Column:
    """Leading decimal digit of ``abs(c)``; NULL below 1.

    The small shifts keep exact powers of ten on the right side of ``floor``.
    """
    a = F.abs(col(c))
    lg = F.log10(a)
    lead = F.floor(F.pow(F.lit(10.0), lg - F.floor(lg + 1e-10)) + 1e-10)
    return F.when(a >= 1, F.least(F.greatest(lead, F.lit(1)), F.lit(9)).cast("int"))


def benford_score(digit_counts: list[Column], n: Column, minimum: int = 3) -> Column:
    """Deviation of digit shares from Benford's law; 0 below ``minimum`` values."""
    terms = []
    for count, expected in zip(digit_counts, V.BENFORD):
        share = count / (n + F.lit(V.EPS))
        terms.append((share - expected) * (share - expected) / F.lit(expected))
    return F.when(n >= minimum, reduce(add, terms)).otherwise(0.0)


def row_benford(digit_cols: list[str]) -> Column:
    """Benford deviation over the digits already extracted into ``digit_cols``."""
    counts = [reduce(add, [flag(F.col(d) == k) for d in digit_cols]) for k in range(1, 10)]
    n = reduce(add, [flag(F.col(d).isNotNull()) for d in digit_cols])
    return benford_score(counts, n)


def round_number_ratio(cols: list[str]) -> Column:
    """Share of non-zero whole amounts divisible by 100."""
    whole = [F.abs(nz(c)).cast("long") for c in cols]
    hits = reduce(add, [flag((w != 0) & (w % 100 == 0)) for w in whole])
    n = reduce(add, [flag(w != 0) for w in whole])
    return F.when(n > 0, hits / (n + F.lit(V.EPS))).otherwise(0.0)


def effective_rate(agi: Column) -> Column:
    """Average rate of a progressive schedule on ``agi``; 0 without income."""
    x = nz(agi)
    parts, floor = [], 0
    for top, rate in V.EFFECTIVE_BRACKETS:
        part = F.greatest(x - float(floor), F.lit(0.0))
        if top is not None:
            part = F.least(part, F.lit(float(top - floor)))
            floor = top
        parts.append(part * rate)
    return F.when(x > 0, reduce(add, parts) / F.greatest(x, F.lit(V.EPS))).otherwise(0.0)


def bracket_tax(income: Column, tops: Column, status: Column) -> Column:
    """Progressive liability from a row's bracket tops (array), rounded to cents.

    Joint filers and qualifying widows have every threshold doubled.
    """
    scale = F.when(status.isin(V.DOUBLED_STATUSES), 2.0).otherwise(1.0)
    parts = []
    for i, rate in enumerate(V.MARGINAL_RATES):
        lo = tops[i - 1] * scale if i else F.lit(0.0)
        part = income - lo
        if i < len(V.MARGINAL_RATES) - 1:
            part = F.least(part, tops[i] * scale - lo)
        parts.append(F.greatest(part, F.lit(0.0)) * rate)
    return F.when(income > 0, cents(reduce(add, parts))).otherwise(0.0)


def draw_key(seed, *cols) -> Column:
    """Hex digest that orders rows pseudo-randomly, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


DRAW_BITS = 52


def digest_integer(digest: Column) -> Column:
    """Whole number below 2^52 from the first 13 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def digest_uniform(digest: Column) -> Column:
    """Uniform number in [0, 1), exact in a double."""
    return digest_integer(digest).cast("double") / F.lit(float(2 ** DRAW_BITS))


def digest_position(digest: Column, size: Column) -> Column:
    """Whole number below ``size``, by integer arithmetic: every position can be drawn."""
    whole = digest_integer(digest).cast("decimal(17,0)") * size.cast("decimal(17,0)")
    unit = F.lit(2 ** DRAW_BITS).cast("decimal(17,0)")
    return ((whole - whole % unit) / unit).cast("long")         # exact: no rest to round


def weighted_choice(u: Column, weights: dict) -> Column:
    """Category whose cumulative weight interval holds ``u`` (inverse CDF)."""
    whole, acc, out = float(sum(weights.values())), 0.0, None
    keys = list(weights)
    for key in keys[:-1]:
        acc += weights[key]
        out = (F.when(u < acc / whole, F.lit(key)) if out is None
               else out.when(u < acc / whole, F.lit(key)))
    return out.otherwise(F.lit(keys[-1])) if out is not None else F.lit(keys[0])


def normalise_label(c) -> Column:
    """Trimmed lower case with underscores."""
    return F.regexp_replace(F.lower(F.trim(col(c))), " ", "_")


def person_code(zone, idx) -> Column:
    return F.format_string("P%d_%07d", col(zone).cast("int"), col(idx).cast("long"))


def business_code(zone, abbreviation, idx) -> Column:
    return F.format_string("B%d_%s_%07d", col(zone).cast("int"), col(abbreviation),
                           col(idx).cast("long"))


def lookup(c, mapping: dict, default=None) -> Column:
    """Constant map applied to a column, with a default for missing keys."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.create_map(*pairs)[col(c)]
    return found if default is None else F.coalesce(found, F.lit(default))


def value_bucket(c: Column, per_octave: int = 64) -> Column:
    """Order-preserving bucket of a number, about 1 % wide, bounded in count.

    ``a <= b`` implies ``bucket(a) <= bucket(b)``, so bucket totals give exact ranks
    of bucket edges without sorting the rows.
    """
    octave = F.least(F.log2(F.abs(c) * F.lit(1e6) + F.lit(1.0)), F.lit(1100.0))   # infinity too
    m = F.floor(octave * float(per_octave)).cast("int")
    return F.when(c < 0, -m - 1).otherwise(m)


def linear_split(v: Column, lo: Column, hi: Column, parts: int) -> Column:
    """Order-preserving part of ``[lo, hi]`` that holds ``v``; infinite ends are parts of
    their own."""
    inside = F.floor(F.nanvl((v - lo) / (hi - lo), F.lit(0.0)) * parts).cast("int")
    return F.when(v == lo, 0).when(v == hi, parts + 1).otherwise(inside + 1)


def rounded(c, places: int) -> Column:
    """Decimal rounding, halves away from zero.

    The small shift absorbs binary noise at ties; ``round`` on doubles goes through
    decimal objects and is many times slower.
    """
    c, scale = col(c), 10 ** places
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.500001) / scale


def cents(c) -> Column:
    """Money to two decimals."""
    return rounded(c, 2)


def floor0(c) -> Column:
    return F.greatest(c, F.lit(0.0))
