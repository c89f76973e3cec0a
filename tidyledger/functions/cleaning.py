"""Column -> Column forms of the cleaning rules. No Python runs per row.

Every function takes a string column and leaves null alone. Java's ``\\s`` and
``\\w`` are ASCII only, hence the ``(?U)`` flag; the four separator control
characters are added because Unicode's White_Space property leaves them out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from tidyledger.functions import vocabulary as words

_BLANK = r"[\s\x1c-\x1f]"
# The characters of _BLANK under (?U), one by one.
_BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Strip Unicode whitespace from both ends (``trim`` would keep NBSP).

    Only the ends are looked at; a regular expression walks the whole text.
    """
    return F.btrim(c, F.lit(_BLANKS))


def _lookup(pairs: Mapping[str, object], key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(literal, key)


# --- money -----------------------------------------------------------------

# Every step is one regular expression over the step before, so each amount is
# walked a fixed number of times and never copied into several branches.
_SYMBOLS = "€$"
_CODES = rf"(?U){_BLANK}*(EUR|USD|eur|usd){_BLANK}*"
# Dots that only group thousands (``1.234.567``), and dots with the last comma behind them.
_GROUP_DOT = r"\G([0-9]{1,3})\.(?=[0-9]{3}(?:\.[0-9]{3})*$)"
_DOT_BEFORE_COMMA = r"\.(?=.*,[^.]*$)"
# A comma with no dot behind it is the decimal mark; any other comma is dropped.
_DECIMAL_COMMA = r",(?=[^.]*$)"
_FLOAT_TEXT = rf"(?U)^{_BLANK}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?){_BLANK}*$"


def normalize_currency(c: Column) -> Column:
    """Amount as double; null for blank text, text without digits, or text that is no number.

    Text the rewrite spoils (``1e-5``) is tried as it stands.
    """
    bare = strip_ws(F.regexp_replace(F.translate(strip_ws(c), _SYMBOLS, ""), _CODES, ""))
    joined = F.regexp_replace(F.regexp_replace(bare, _GROUP_DOT, "$1"), _DOT_BEFORE_COMMA, "")
    digits = F.regexp_replace(F.regexp_replace(joined, _DECIMAL_COMMA, "."), r"[^0-9.\-]", "")
    # Text without a digit needs none of this, and a failing cast is slow.
    return F.when(c.rlike("[0-9]"), F.coalesce(
        digits.try_cast("double"), F.regexp_extract(c, _FLOAT_TEXT, 1).try_cast("double")))


def has_amount_text(c: Column) -> Column:
    """Some digit, dot or sign is left, so a missing number means the text could not be read."""
    return c.rlike(r"[0-9.\-]")


def currency_unreadable(c: Column) -> Column:
    """True where the text has digits but is no number (``1-2``), so it must stay as it is."""
    return F.coalesce(has_amount_text(c) & normalize_currency(c).isNull(), F.lit(False))


# --- dates -----------------------------------------------------------------

_DAY_FIRST = r"^(\d{1,2})([/-])(\d{1,2})\2"
_LONG_DATE = rf"(?iU)^(\d{{1,2}}){_BLANK}+de{_BLANK}+(\w+){_BLANK}+de{_BLANK}+(\d{{4}})"
_ISO_DATE = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"
_ISO_DATETIME = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}[Tt_ ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$"
)
_UNIX_TIME = r"^-?\d{1,11}(\.\d+)?$"


def normalize_date(c: Column) -> Column:
    """Date from ISO, day-first (2 or 4 digit year) or written-out Spanish text, else null."""
    text = strip_ws(c)
    iso = F.regexp_replace(text, _DAY_FIRST + r"(\d{4})$", "$4-$3-$1")
    iso = F.regexp_replace(iso, _DAY_FIRST + r"([0-4]\d)$", "20$4-$3-$1")
    iso = F.regexp_replace(iso, _DAY_FIRST + r"([5-9]\d)$", "19$4-$3-$1")
    month = _lookup(words.SPANISH_MONTHS, F.lower(F.regexp_extract(text, _LONG_DATE, 2)))
    written = F.concat_ws(
        "-",
        F.regexp_extract(text, _LONG_DATE, 3),
        F.coalesce(month.cast("string"), F.lit("x")),
        F.regexp_extract(text, _LONG_DATE, 1),
    )
    ready = F.when(F.lower(text).contains("de"), written).otherwise(iso)
    return F.when(ready.rlike(_ISO_DATE), ready.try_cast("date"))


def parse_validator_date(c: Column) -> Column:
    """What the validator itself takes beyond the rules: ISO date-times and Unix time."""
    text = strip_ws(c)
    return (
        F.when(text.rlike(_ISO_DATETIME), F.substring(text, 1, 10).try_cast("date"))
        .when(text.rlike(_UNIX_TIME), F.date_add(
            F.lit("1970-01-01").cast("date"),
            F.floor(text.try_cast("double") / 86400).cast("int")))
    )


# --- words and identifiers -------------------------------------------------


def normalize_enum(c: Column, variants: Mapping[str, Sequence[str]]) -> Column:
    """Canonical word for a known spelling, otherwise the stripped text."""
    spelled = {v: canonical for canonical, many in variants.items() for v in many}
    text = strip_ws(c)
    return F.coalesce(_lookup(spelled, F.lower(text)), text)


def normalize_type(c: Column) -> Column:
    return normalize_enum(c, words.TYPE_WORDS)


def normalize_status(c: Column) -> Column:
    return normalize_enum(c, words.STATUS_WORDS)


_TAX_ID = r"^([A-Z][0-9]{8}|[0-9]{8}[A-Z]?)$"


def normalize_tax_id(c: Column) -> Column:
    """Letter + 8 digits or 8 digits (+ letter) without separators, else the stripped text."""
    squeezed = F.upper(F.regexp_replace(c, rf"(?U)[\s\x1c-\x1f\-]", ""))
    return F.when(squeezed.rlike(_TAX_ID), squeezed).otherwise(strip_ws(c))


def tax_id_without_letter(c: Column) -> Column:
    """True for a normalised tax id that is only 8 digits."""
    return c.rlike("^[0-9]{8}$")


_SEPARATOR = rf"(?:-|[/\s\x1c-\x1f]+)?"
_INVOICE_NUMBER = rf"(?isU)^(?:FAC{_SEPARATOR})?([0-9]{{4}}){_SEPARATOR}([0-9]+).*$"
# Three zeros are put before the number; these are the surplus ones beyond a width of four.
_SURPLUS_ZEROS = r"^(FAC-[0-9]{4}-)(?:000(?=[0-9]{4,}$)|00(?=[0-9]{4}$)|0(?=[0-9]{4}$))"


def normalize_invoice_number(c: Column) -> Column:
    """``FAC-YYYY-NNNN`` from the usual spellings; trailing text is dropped, other text kept."""
    wide = F.regexp_replace(strip_ws(c), _INVOICE_NUMBER, "FAC-$1-000$2")
    return F.regexp_replace(wide, _SURPLUS_ZEROS, "$1")


# A mark and a blank after every non-letter that precedes a letter make
# ``initcap`` (which capitalises after blanks only) start a new word there.
_MARK = "\u0001 "


def title_case(c: Column) -> Column:
    """Capital after any non-letter, so ``s.l.`` becomes ``S.L.`` (``initcap`` gives ``S.l.``)."""
    split = F.regexp_replace(strip_ws(c), r"(\P{L})(?=\p{L})", "$1" + _MARK)
    return F.replace(F.initcap(split), F.lit(_MARK), F.lit(""))


# --- derived amounts -------------------------------------------------------


def pending_amount(status: Column, total: Column) -> Column:
    """Open amount implied by the invoice state; 0 for an unknown state or an unreadable total."""
    state = F.lower(F.coalesce(status, F.lit("")))
    return F.coalesce(
        F.when(state.contains("pagada") & ~state.contains("parcialmente"), F.lit(0.0))
        .when(state.contains("pendiente") | state.contains("vencida"), total)
        .when(state.contains("parcialmente"), total * 0.5)
        .otherwise(F.lit(0.0)),
        F.lit(0.0),
    )


def consistency_warnings(status: Column, pending: Column) -> Column:
    """Warnings (never errors) where state and open amount contradict each other."""
    state = F.lower(status)
    return F.array_compact(F.array(
        F.when(
            (state == "pagada") & (pending > 0),
            F.concat(
                F.lit("WARNING: Inconsistency: estado_factura='Pagada' but importe_pendiente="),
                pending.cast("string"), F.lit(" > 0")),
        ),
        F.when(
            (state == "pendiente") & (pending == 0),
            F.lit("WARNING: Inconsistency: estado_factura='Pendiente' but importe_pendiente=0"),
        ),
    ))
