"""Text column functions: mail cleaning, stripping, prefixes, prompts, names.

All of these are Spark SQL expressions (regexp_*, btrim, substring), so they
run inside whole-stage codegen and work unchanged on streaming DataFrames.
The mail cleaner is split into successive projections so that Catalyst does
not inline (and repeat) an expensive regular expression into later steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.operators.partitioning import spread

# Characters removed by a Unicode strip: every code point that is whitespace
# by the Unicode White_Space property as Python's str.isspace() reports it.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Unicode classes used instead of \w, \d and \s, whose short forms are ASCII.
UNICODE_CLASSES = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}",
                   "s": "".join(rf"\x{{{ord(ch):x}}}" for ch in WHITESPACE)}


def unicode_classes(pattern: str) -> str:
    """Rewrite ``\\w``, ``\\d`` and ``\\s`` (inside or outside a class) to Unicode classes."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in UNICODE_CLASSES:
                out.append(UNICODE_CLASSES[nxt] if in_class else f"[{UNICODE_CLASSES[nxt]}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip leading/trailing Unicode whitespace (``trim`` only removes spaces)."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def is_usable_text(c) -> Column:
    """A string that is not blank after a Unicode strip."""
    c = col_(c)
    return c.isNotNull() & (F.length(py_strip(c)) > 0)


# -- X1: text after the mail headers --------------------------------------

MARKER = "X-FileName:"


def extract_after_headers(c) -> Column:
    c = col_(c)
    header_end = "(?s)" + spec.HEADER_END_PATTERN
    # Line fallback: from the first line holding the marker, skip it and the
    # next line; applies only when a line after those two exists.
    first = F.instr(c, MARKER)
    from_marker = F.substr(c, first)
    line_fallback = "(?s)^X-FileName:[^\n]*\n[^\n]*\n(.*)"
    return (
        F.when(c.isNull(), F.lit(""))
        .when(c.rlike(header_end), py_strip(F.regexp_extract(c, header_end, 1)))
        .when((first > 0) & from_marker.rlike(line_fallback),
              py_strip(F.regexp_extract(from_marker, line_fallback, 1)))
        .otherwise(c)
    )


# -- X2: conversation split --------------------------------------------------

def split_conversation(c) -> Column:
    c = col_(c)
    forwarded = "(?s)" + unicode_classes(spec.FORWARDED_PATTERN)
    multi_to = "(?si)" + spec.MULTIPLE_TO_PATTERN
    replied = "(?si)" + unicode_classes(spec.REPLIED_PATTERN)
    before_reply = "(?si)^(.*?)" + unicode_classes(spec.REPLIED_PATTERN)
    return (
        F.when(c.rlike(forwarded), F.lit(""))
        .when(c.rlike(multi_to) & c.rlike(replied),
              py_strip(F.regexp_extract(c, before_reply, 1)))
        .otherwise(c)
    )


# -- X3 / X4 -------------------------------------------------------------------

# Literals every match of the quoted-header pattern contains (case-sensitive).
_QUOTED_HEADER_LITERALS = ["<", "To:", "Subject:"]


def remove_quoted_headers(c) -> Column:
    """Drop quoted ``name <addr> on date ... To: ... Subject: ...`` blocks.

    The pattern opens with a repeated character class, so the regex engine
    backtracks at every word; a substring test for the literals any match
    must contain skips it for the (usual) texts that cannot match.
    """
    c = col_(c)
    possible = None
    for lit in _QUOTED_HEADER_LITERALS:
        cond = F.instr(c, lit) > 0
        possible = cond if possible is None else possible & cond
    return F.when(possible, F.regexp_replace(c, "(?s)" + unicode_classes(spec.QUOTED_HEADER_PATTERN), "")) \
        .otherwise(c)


def remove_footers(c) -> Column:
    out = col_(c)
    for pattern in spec.FOOTER_PATTERNS:
        out = F.regexp_replace(out, "(?s)" + unicode_classes(pattern), "")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return py_strip(out)


def footer_hit(c, pattern: str) -> Column:
    return col_(c).rlike("(?s)" + unicode_classes(pattern))


# -- X5: the whole cleaner as successive projections ------------------------

def clean_mail(df: DataFrame, message_col: str = "message",
               out_col: str = "preprocessed_text") -> DataFrame:
    """Headers -> conversation split -> quoted headers -> footers.

    Returns ``df`` with ``out_col`` added; the result is ``''`` when the mail
    is empty, forwarded, or only headers.
    """
    step1 = spread(df).withColumn("_lf_body", extract_after_headers(message_col))
    step2 = step1.withColumn("_lf_thread", split_conversation("_lf_body"))
    step3 = step2.withColumn(
        out_col,
        F.when(F.col("_lf_thread") == "", F.lit(""))
        .otherwise(remove_footers(remove_quoted_headers("_lf_thread"))),
    )
    return step3.drop("_lf_body", "_lf_thread")


def drop_empty(df: DataFrame, col: str) -> DataFrame:
    """Keep rows whose ``col`` is not ``''`` without re-evaluating ``col``.

    A plain filter on a computed column is pushed below the projection with
    the expression inlined, so the whole cleaning chain would run twice per
    row.  A zero-or-one ``explode`` of the computed value is not pushed down.
    """
    keep = F.when(F.col(col) != "", F.array(F.col(col))).otherwise(F.array().cast("array<string>"))
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(keep).alias(col))


# -- X8 / X9: prefixes and prompts ------------------------------------------

def with_prefix(c, prefix_name: str, medium: str = spec.INSTRUCT_MEDIUM_CLASSIFICATION) -> Column:
    prefix = spec.prefix_for(prefix_name, medium)
    c = col_(c)
    return c if prefix is None else F.concat(F.lit(prefix), c)


def prefix_by_name(c, name_col) -> Column:
    """Prefix chosen per row from a column holding a prefix-function name."""
    c, name_col = col_(c), col_(name_col)
    out = F.when(name_col == "none", c)
    for name in spec.PREFIX_NAMES:
        prefix = spec.prefix_for(name)
        if prefix is not None:
            out = out.when(name_col == name, F.concat(F.lit(prefix), c))
    return out


def annotate_prompt(c, labels=spec.TARGET_LABELS) -> Column:
    head, tail = spec.annotate_user_prompt(labels).split("{text}")
    return F.concat(F.lit(head), col_(c), F.lit(tail))


# -- X11 / K6 / K7: names ---------------------------------------------------------

def safe_name(c) -> Column:
    """Every character that is not a letter, digit, '-' or '_' becomes '_'."""
    return F.regexp_replace(col_(c), r"[^\p{L}\p{N}_-]", "_")


def event_file_name(context, stamp) -> Column:
    """``monitoring_events_<safe context>_<yyyyMMdd_HHmmss>.json``."""
    return F.concat(F.lit("monitoring_events_"), safe_name(context), F.lit("_"),
                    F.date_format(col_(stamp), "yyyyMMdd_HHmmss"), F.lit(".json"))


def model_path_name(c) -> Column:
    return F.translate(col_(c), ":", "_")


# -- number formatting ----------------------------------------------------------

def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fixed_decimals(c, digits: int) -> Column:
    """Format a double with ``digits`` decimals: its exact binary value rounded
    half to even, the sign kept (``-0.00``), ``nan`` and ``inf`` by name.

    The fraction times 10**digits is taken as a product plus that product's
    rounding error, which is exact when the fraction is split into two parts of
    at most 26 bits; so no tie is made or missed.  From 2**63 the whole part
    has the digits of the shortest decimal; beyond 38 digits: null.
    """
    c = col_(c).cast("double")
    x = F.abs(c)
    scale = float(10 ** digits)

    def rounded(fraction: Column) -> Column:
        shifted = fraction * F.lit(2.0 ** 27 + 1)
        high = shifted - (shifted - fraction)
        return _let(fraction * scale, lambda p: _let(
            (p - F.floor(p).cast("double") - 0.5) + ((high * scale - p) + (fraction - high) * scale),
            lambda over: F.floor(p) + F.when((over > 0) | ((over == 0) & (F.floor(p) % 2 == 1)), 1).otherwise(0)))

    def joined(q: Column) -> Column:
        whole = F.when(x < 2.0 ** 63, (F.floor(x) + F.floor(q / scale)).cast("string")) \
            .otherwise(x.try_cast("decimal(38,0)").cast("string"))
        return F.concat(whole, F.lit("."), F.lpad((q % int(scale)).cast("string"), digits, "0"))

    fraction = F.when(x < 2.0 ** 53, x - F.floor(x).cast("double")).otherwise(F.lit(0.0))
    number = F.when(x == float("inf"), "inf").otherwise(_let(_let(fraction, rounded), joined))
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(c), "nan").when(c.isNotNull(), F.concat(sign, number))
