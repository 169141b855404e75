"""Column-expression helpers (X1–X18). All are built-in Spark expressions: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def falsy_default(c, default: str) -> Column:
    """Python ``x or default`` for strings: null and '' both fall back."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit(default))


def first_nonempty(*cols) -> Column:
    """``a or b or ...`` over strings."""
    return F.coalesce(*[F.nullif(col_(c), F.lit("")) for c in cols])


def age_at(as_of, birth) -> Column:
    """Whole years ``int(days / 365.25)``, truncated toward zero (X1). Null when a date is."""
    return (F.datediff(col_(as_of), col_(birth)) / F.lit(365.25)).cast("int")


def age_years_real(as_of, birth) -> Column:
    """Real-valued age ``days / 365.25``."""
    return F.datediff(col_(as_of), col_(birth)) / F.lit(365.25)


def age_by_year(birth_str, ref_year: int = 2025) -> Column:
    """``ref_year - int(birth[:4])``, -1 when the prefix is not an integer."""
    return F.coalesce(F.lit(ref_year) - F.substring(col_(birth_str), 1, 4).try_cast("int"),
                      F.lit(-1))


def year_boundaries(start, end) -> Column:
    """SQL ``DATE_DIFF('year', a, b)``: counts year boundaries, not full years."""
    return F.year(col_(end)) - F.year(col_(start))


def clamp01(c) -> Column:
    """Clamp to [0, 1]; NaN is treated as missing."""
    x = F.when(F.isnan(col_(c)), F.lit(None)).otherwise(col_(c))
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def to_double_or_zero(c) -> Column:
    """Numeric coercion with default 0.0."""
    return F.coalesce(col_(c).try_cast("double"), F.lit(0.0))


def capitalize(c) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower (X11)."""
    s = col_(c)
    return F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))),
                    F.lower(F.substr(s, F.lit(2), F.length(s))))


# Whitespace set stripped by strip_ws (ASCII whitespace, as Python's str.strip on ASCII text).
WS_CLASS = "[ \\t\\n\\x0B\\f\\r]"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` on ASCII whitespace (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(col_(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def short_label(c, width: int = 50) -> Column:
    """Display label: first ``width`` chars followed by '...' (always appended, F11)."""
    return F.concat(F.substring(col_(c), 1, width), F.lit("..."))


def split_prompt_expected(text) -> tuple[Column, Column]:
    """Split a sample at the first '\\nAI:'; without it, at half the length.

    Returns (prompt, expected), both stripped; ``expected`` keeps the 'AI:' marker.
    """
    t = col_(text)
    pos = F.instr(t, "\nAI:")  # 1-based, 0 when absent
    cut = F.when(pos > 0, pos - 1).otherwise(F.floor(F.length(t) / 2).cast("int"))  # 0-based
    prompt = strip_ws(F.substr(t, F.lit(1), cut))
    expected = strip_ws(F.substr(t, cut + 1, F.length(t)))
    return prompt, expected


_SPLITTER = 134217729.0   # 2^27 + 1: Veltkamp split of a double into two 26-bit halves


def _split(v):
    c = v * _SPLITTER
    hi = c - (c - v)
    return hi, v - hi


def format_fixed(c, digits: int = 2) -> Column:
    """Python's ``f"{x:.{digits}f}"``: the exact binary value rounded half-to-even.

    Java's ``%.2f`` (``format_string``) rounds the shortest decimal string half-up, so
    0.825 gives '0.83' there and '0.82' in Python.  Here the product x·10^digits is
    computed with its exact rounding error (Dekker's two-product), which decides the
    ties; everything stays a built-in double expression.  Null stays null.
    """
    x = col_(c)
    scale = float(10 ** digits)
    a = F.abs(x)
    p = a * F.lit(scale)
    ah, al = _split(a)
    sh = (scale * _SPLITTER) - ((scale * _SPLITTER) - scale)
    sl = scale - sh
    err = ((ah * F.lit(sh) - p) + ah * F.lit(sl) + al * F.lit(sh)) + al * F.lit(sl)
    k = F.floor(p)
    frac = p - k
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
           .when(err > 0, True).when(err < 0, False).otherwise(k % 2 == 1))
    n = (k + F.when(up, 1).otherwise(0)).cast("decimal(38,0)")
    whole = F.floor(n / F.lit(10 ** digits)).cast("string")
    part = F.lpad((n % F.lit(10 ** digits)).cast("long").cast("string"), digits, "0")
    body = F.concat(whole, F.lit("."), part) if digits > 0 else whole
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
             .when(F.isnan(x), F.lit("nan"))
             .when(x == float("inf"), F.lit("inf"))
             .when(x == float("-inf"), F.lit("-inf"))
             .otherwise(F.concat(sign, body)))


_EXPR_CACHE: dict = {}


def cached_expr(key, build):
    """Memoise a data-independent Column built by ``build()`` for the active SparkContext.

    Large rule expressions (validation, record templates) cost thousands of py4j calls to
    assemble; the unresolved expression is the same for every query of an application.  The
    cache holds the expressions of the current application only.
    """
    from pyspark import SparkContext
    app = SparkContext._active_spark_context.applicationId
    if any(a != app for a, _ in _EXPR_CACHE):
        _EXPR_CACHE.clear()
    k = (app, key)
    if k not in _EXPR_CACHE:
        _EXPR_CACHE[k] = build()
    return _EXPR_CACHE[k]
