"""Numbers of tokens: integers, fraction signs, built-up fractions, an approximate mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTIONS = {"½": (1, 2), "⅓": (1, 3), "⅔": (2, 3), "¼": (1, 4), "¾": (3, 4), "⅕": (1, 5), "⅖": (2, 5), "⅗": (3, 5), "⅘": (4, 5), "⅙": (1, 6), "⅚": (5, 6), "⅛": (1, 8), "⅜": (3, 8), "⅝": (5, 8), "⅞": (7, 8)}
#: What a value's fractional part is written as, in the order in which they are tried.
SHOWN = {"½": (1, 2), "⅓": (1, 3), "⅔": (2, 3), "¼": (1, 4), "¾": (3, 4), "⅙": (1, 6), "⅚": (5, 6), "⅛": (1, 8), "⅜": (3, 8), "⅝": (5, 8), "⅞": (7, 8), "¹⁄₁₆": (1, 16), "⅕": (1, 5)}
_UP, _DOWN = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"
BARE = "^≈\\s*"
NUMERAL = "^[0-9¹²³⁴⁵⁶⁷⁸⁹⁰⅟₁₂₃₄₅₆₇₈₉₀≈\U00010101]+$"


def parse_value(token: Column) -> Column:
    """The number a token states, or null. After one approximate mark: an integer of any length
    that a double can hold, one fraction sign alone, or two runs of digits on either side of a
    fraction slash, above it plain or superscript and below it plain or subscript."""
    bare = F.regexp_replace(F.trim(token), BARE, "")
    whole = F.when(bare.rlike("^[0-9]+$"), bare.try_cast("double"))
    glyph = F.try_element_at(F.create_map(*[F.lit(x) for s, (a, b) in FRACTIONS.items() for x in (s, a / b)]), bare)
    ratio = f"^([0-9]+|[{_UP}]+)[⁄/]([0-9]+|[{_DOWN}]+)$"
    up = F.translate(F.regexp_extract(bare, ratio, 1), _UP, "0123456789").try_cast("double")
    down = F.translate(F.regexp_extract(bare, ratio, 2), _DOWN, "0123456789").try_cast("double")
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    built = F.when(bare.rlike(ratio), F.try_divide(finite(up), finite(down)))
    # most tokens are words: one test spares them the rest
    number = F.trim(token).rlike(f"^[≈0-9{''.join(FRACTIONS)}{_UP}]")
    return F.when(number, F.coalesce(finite(whole), glyph, built))


def is_value_token(token: Column) -> Column:
    return parse_value(token).isNotNull()


def is_numeral_token(token: Column) -> Column:
    """Whether a token is made of digits, raised or lowered ones, approximate marks and dividers."""
    return token.rlike(NUMERAL)


def sum_values(values: Column) -> Column:
    """The sum of an array of parsed numbers, 0 for none."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def some_value(values: Column) -> Column:
    return F.exists(values, F.isnotnull)


def line_value(tokens: Column) -> Column:
    """The sum of the numbers in an array of tokens, 0 for none."""
    return sum_values(F.transform(tokens, parse_value))


def has_value(tokens: Column) -> Column:
    return F.exists(tokens, is_value_token)


def format_value(value: Column) -> Column:
    """A whole number, with a fraction sign where one is within a millionth; else at most three
    decimals without trailing zeros."""
    size = F.abs(value)
    whole = F.floor(size)
    rest = size - whole
    glyph = F.lit(None).cast("string")
    for s, (a, b) in reversed(SHOWN.items()):
        glyph = F.when(F.abs(rest - a / b) < 1e-6, F.lit(s)).otherwise(glyph)
    minus = F.when(value < 0, "-").otherwise("")
    places = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", size), "0+$", ""), "\\.$", "")
    places = F.concat(F.when(places.try_cast("double") != 0, minus).otherwise(""), places)
    shown = F.concat(minus, F.when(whole > 0, whole.cast("string")).otherwise(""), glyph)
    return F.when(rest == 0, F.format_string("%.0f", value)).when(glyph.isNotNull(), shown).otherwise(places)


def value_sql(t: str) -> str:
    """``parse_value`` of a DuckDB expression."""
    bare = f"regexp_replace(trim({t}), '^≈\\s*', '')"
    glyphs = " ".join(f"WHEN {bare} = '{s}' THEN {a}::DOUBLE / {b}" for s, (a, b) in FRACTIONS.items())
    ratio = f"^([0-9]+|[{_UP}]+)[⁄/]([0-9]+|[{_DOWN}]+)$"
    part = lambda k, table: f"TRY_CAST(translate(regexp_extract({bare}, '{ratio}', {k}), '{table}', '0123456789') AS DOUBLE)"
    return f"(CASE WHEN regexp_full_match({bare}, '[0-9]+') THEN TRY_CAST({bare} AS DOUBLE) {glyphs} WHEN regexp_matches({bare}, '{ratio}') AND {part(2, _DOWN)} <> 0 THEN {part(1, _UP)} / {part(2, _DOWN)} END)"
