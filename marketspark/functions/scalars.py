"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMON = "Common Stock"


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def status_case(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """First matching rule wins."""
    (condition, value), *rest = rules
    case = F.when(condition, value)
    for condition, value in rest:
        case = case.when(condition, value)
    return case.otherwise(F.lit(default))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """``a / b`` as a double, null for a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def overlay(*columns: str | Column) -> Column:
    """First non-null value in priority order."""
    return F.coalesce(*[_c(c) for c in columns])


def is_true(condition: str | Column) -> Column:
    """Null counts as false."""
    return F.coalesce(_c(condition), F.lit(False))


def not_true(condition: str | Column) -> Column:
    """Null counts as not true."""
    return ~is_true(condition)


def distinct_from(a: str | Column, b: str | Column) -> Column:
    """IS DISTINCT FROM: null equals null."""
    return ~_c(a).eqNullSafe(_c(b))


def canonical_code(code: str | Column) -> Column:
    """Upper-case code without an ``_OLD<n>`` suffix, dashes as dots."""
    return F.replace(F.regexp_replace(F.upper(_c(code)), "_OLD[0-9]*$", ""), F.lit("-"), F.lit("."))


def strip_market_suffix(code: str | Column) -> Column:
    """Upper-case code without the trailing ``.US`` (see README, "Known differences")."""
    return F.regexp_replace(F.upper(_c(code)), r"\.US$", "")


def alphanumeric(text: str | Column) -> Column:
    """Upper-case letters and digits only: the form in which names are compared."""
    return F.regexp_replace(F.upper(F.trim(_c(text))), "[^A-Z0-9]", "")


def text_key(*parts: str | Column, separator: str = "|") -> Column:
    """Upper-case, trimmed parts joined by a separator."""
    return F.concat_ws(separator, *[F.upper(F.trim(_c(p).cast("string"))) for p in parts])


def stable_hash(*parts: str | Column, null: str = "<NULL>", bits: int | None = None) -> Column:
    """Content id: md5 (or SHA-2 with ``bits``) of the parts with nulls made explicit."""
    text = F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit(null)) for p in parts])
    return F.sha2(text, bits) if bits else F.md5(text)


def day_difference(start: str | Column, end: str | Column) -> Column:
    """Days from ``start`` to ``end``."""
    return F.datediff(_c(end), _c(start))


def ratio_matches(a: str | Column, b: str | Column, relative: float = 1e-6) -> Column:
    """``|a - b| <= relative * max(1, |b|)``."""
    return F.abs(_c(a) - _c(b)) <= F.lit(relative) * F.greatest(F.lit(1.0), F.abs(_c(b)))


def log_ratio(a: str | Column, b: str | Column) -> Column:
    """``|ln(a / b)|``, null unless both are positive."""
    return F.when((_c(a) > 0) & (_c(b) > 0), F.abs(F.ln(_c(a) / _c(b))))


def log_ratio_within(a: str | Column, b: str | Column, factor: float) -> Column:
    """True when a and b differ by at most ``factor`` in either direction."""
    return log_ratio(a, b) <= F.ln(F.lit(float(factor)))


def scale_band(ratio: str | Column) -> Column:
    """Is a ratio near 1, 1000 or 1/1000?"""
    r = _c(ratio)
    return (
        F.when(r.isNull(), "not_comparable")
        .when(r.between(800, 1250), "near_1000x_high")
        .when(r.between(0.0008, 0.00125), "near_1000x_low")
        .when(r.between(0.8, 1.25), "near_1x")
        .otherwise("other_ratio")
    )


def freshness(value: str | Column, age_days: str | Column) -> Column:
    """Staleness bucket of a dated value."""
    age = _c(age_days)
    return (
        F.when(_c(value).isNull(), "missing")
        .when(age <= 120, "fresh")
        .when(age <= 180, "acceptable")
        .when(age <= 365, "stale")
        .otherwise("very_stale")
    )


def valid_isin(code: str | Column) -> Column:
    """Format and check digit of an ISIN.

    Letters count as 10 to 35, every second digit from the right is doubled and the
    digit sum must be a multiple of ten.
    """
    text = _c(code)
    digits = F.concat(*[F.conv(F.substring(text, i, 1), 36, 10) for i in range(1, 13)])
    shape = text.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")
    return F.when(shape, F.call_function("luhn_check", digits)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def parse_ratio(text: str | Column) -> Column:
    """``"2/1"`` to a struct (to_factor, for_factor, ratio); null when zero or malformed."""
    parts = F.split(F.trim(_c(text)), "/")
    to = F.try_element_at(parts, F.lit(1)).try_cast("double")
    per = F.try_element_at(parts, F.lit(2)).try_cast("double")
    good = (F.size(parts) == 2) & to.isNotNull() & per.isNotNull() & (per != 0) & (to != 0)
    return F.when(
        good,
        F.struct(to.alias("to_factor"), per.alias("for_factor"), F.try_divide(to, per).alias("ratio")),
    )


def symbol_candidates(ticker: str | Column) -> Column:
    """Provider spellings to try in order: ``X.Y.US`` and, for dotted codes, ``X-Y.US``."""
    code = F.upper(F.trim(_c(ticker)))
    dashed = F.concat(F.replace(code, F.lit("."), F.lit("-")), F.lit(".US"))
    return F.array_distinct(F.array(F.concat(code, F.lit(".US")), dashed))


def normalize_cik(code: str | Column) -> Column:
    """Issuer number without the ``CIK`` prefix, padded to ten digits."""
    bare = F.trim(F.regexp_replace(F.upper(_c(code).cast("string")), "^CIK", ""))
    return F.lpad(bare, 10, "0")


def valid_bar(open_: str = "open", high: str = "high", low: str = "low", close: str = "close",
              volume: str = "volume") -> Column:
    """``0 < low <= min(open, close) <= max(open, close) <= high`` and a volume of at least zero."""
    o, h, lo, c, v = (_c(x) for x in (open_, high, low, close, volume))
    ok = (lo > 0) & (lo <= F.least(o, c)) & (F.greatest(o, c) <= h) & (v >= 0)
    known = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull() & v.isNotNull()
    return F.coalesce(ok & known, F.lit(False))


def flat_zero_volume(open_: str = "open", high: str = "high", low: str = "low", close: str = "close",
                     volume: str = "volume") -> Column:
    """A bar without trades: no volume and one price."""
    same = (_c(open_) == _c(high)) & (_c(high) == _c(low)) & (_c(low) == _c(close))
    return F.coalesce((_c(volume) == 0) & same, F.lit(False))


def syntax_type(symbol: str | Column) -> Column:
    """Instrument type that the spelling of a symbol alone gives away."""
    code = F.upper(_c(symbol))
    return (
        F.when(code.contains("$"), "Preferred Stock")
        .when(code.rlike(r"\.WS?$"), "Warrant")
        .when(code.rlike(r"\.U$"), "Unit")
        .when(code.rlike(r"\.R$"), "Right")
    )


# Wordings that decide the instrument type, in order of precedence.
# Each entry is (type, pattern over the upper-case name).
NAME_RULES_BEFORE_PREFERRED = (("When-Issued", "WHEN-ISSUED|WHEN ISSUED|EX-DISTRIBUTION"),)
PREFERRED_WORDS = "PREFERRED STOCK|PREFERRED SHARE| PFD|PFD |DEPOSITARY SHARE.*PREFERRED|PREFERRED.*DEPOSITARY SHARE"
NAME_RULES_AFTER_PREFERRED = (
    ("Warrant", "(^| - | )WARRANTS?([ ,(]|$)"),
    ("Preferred Stock", "PREFERRED UNITS?([ ,(]|$)"),
    ("Unit", "(^| - | )UNITS?([ ,(]|$)|COMMON UNITS|LIMITED PARTNER INTERESTS|LIMITED PARTNERSHIP UNITS"),
    ("Right", "(^| - | )RIGHTS?([ ,(]|$)"),
    ("ETN", " ETN|ETRACS|EXCHANGE[ -]TRADED NOTE|INDEX SERIES|LINKED TO THE .* INDEX|LINKED TO THE MORNINGSTAR"),
    (
        "Notes",
        "NOTES DUE|SENIOR NOTE|SENIOR SECURED NOTE|SENIOR UNSECURED NOTE|SUBORDINATED NOTE|DEBENTURE"
        "|STRUCTURED REPACKAGED|FIXED-INCOME",
    ),
    ("FUND", "CLOSED[ -]END FUND"),
    (
        COMMON,
        "COMMON STOCK|COMMON SHARE|ORDINARY SHARE|CLASS A VOTING SHARES|CLASS B NON-VOTING SHARES"
        "|AMERICAN DEPOSITARY",
    ),
)


def classify_instrument(
    symbol: str | Column, name: str | Column, is_etf: str | Column, is_test: str | Column
) -> Column:
    """Instrument type from a symbol, its flags and the wording of its name; null if nothing fits."""
    text = F.upper(_c(name))
    rules = [
        ((_c(is_test) == 1) | text.rlike("TEST SYMBOL|TEST COMPANY"), "Test Issue"),
        (_c(is_etf) == 1, "ETF"),
        *[(text.rlike(p), t) for t, p in NAME_RULES_BEFORE_PREFERRED],
        (text.rlike(PREFERRED_WORDS) & ~text.contains("COMMON STOCK"), "Preferred Stock"),
        *[(text.rlike(p), t) for t, p in NAME_RULES_AFTER_PREFERRED],
    ]
    return F.coalesce(syntax_type(symbol), status_case(rules, None))


def unit_unverified(name: str | Column, exchange: str | Column, currency: str | Column) -> Column:
    """The quoted unit may not be one share: depositary wording, or a foreign reporting currency."""
    wording = F.upper(F.coalesce(_c(name), F.lit(""))).rlike(r"DEPOSITARY|DEPOSITORY|\bADS\b|\bADR\b")
    foreign = _c(exchange).isin("NYSE", "NASDAQ") & _c(currency).isNotNull() & (_c(currency) != "USD")
    return wording | F.coalesce(foreign, F.lit(False))
