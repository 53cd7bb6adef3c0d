"""Column functions for Python-compatible text handling, all JVM-side.

Java's ``\\s`` is ASCII-only, so whitespace is spelled out as the Unicode
White_Space set; ``trim`` would strip spaces only.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Python's str.strip() removes: Unicode White_Space and the separators U+001C..U+001F.
WS_CLASS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\p{Z}]"
# The same characters one by one, for a trim without a pattern.
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Python str.splitlines() boundaries.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def bind(df: DataFrame, keep: Sequence[str], **cols: Column) -> DataFrame:
    """Materialise ``cols`` as outputs of a Generate (inline of a one-element
    array). Catalyst cannot inline Generate outputs into later filters or
    projections, so each expression is evaluated once per row."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def normalise(c) -> Column:
    """strip + lower case."""
    return F.lower(strip(c))


def rstrip_chars(c, chars: str) -> Column:
    """Python ``str.rstrip(chars)`` for a literal character set."""
    cls = "".join("\\" + ch if ch in "\\^-]" else ch for ch in chars)
    return F.regexp_replace(_c(c), f"[{cls}]+$", "")


def split_lines(c) -> Column:
    """Python ``str.splitlines()`` as an array (a trailing empty piece may remain)."""
    return F.split(_c(c), LINE_BREAKS)


def str_array(values: Iterable[str]) -> Column:
    """A literal ARRAY<STRING> column (small, fixed vocabularies only)."""
    return F.array(*[F.lit(v) for v in values])


def starts_with_any(c, prefixes: Iterable[str]) -> Column:
    col = _c(c)
    return F.exists(str_array(prefixes), lambda p: F.startswith(col, p))


def map_values(c, mapping: Mapping[str, str]) -> Column:
    """Replace whole values found in ``mapping``; keep others."""
    col = _c(c)
    out = col
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)).otherwise(out)
    return out


def hex_digit(c, pos: int = 1) -> Column:
    """The ``pos``-th hex digit (1-based) of md5(c) as a one-character string."""
    return F.substring(F.md5(_c(c)), pos, 1)


def initial_upper(c) -> Column:
    """First character upper case, the rest lower case."""
    col = _c(c)
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def literal_table(spark, rows, ddl: str):
    """A small fixed table built JVM-side (inline of struct literals over a
    one-row range), so scanning it starts no Python worker."""
    from pyspark.sql import types as T
    schema = T._parse_datatype_string(ddl)
    fields = schema.fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows]
    if not structs:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    return spark.range(1).select(F.inline(F.array(*structs)))
