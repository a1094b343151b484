"""Date formats written with human tokens (YYYY-MM-DD), parsed and rendered by Spark."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from rowassay.functions.numbers import to_double
from rowassay.functions.text import strip

# The named formats, in the order they are tried.
NAMED_FORMATS = [
    "YYYY-MM-DD",
    "YYYY/MM/DD",
    "YYYYMMDD",
    "MM/DD/YYYY",
    "DD/MM/YYYY",
    "MM-DD-YYYY",
    "DD-MM-YYYY",
    "DD-MMM-YYYY",
    "MMM DD, YYYY",
    "MMMM DD, YYYY",
    "YYYY-MM-DD HH:mm:ss",
    "YYYY-MM-DDTHH:mm:ssZ",
    "MM/DD/YY",
    "DD/MM/YY",
    "MMDDYY",
    "DDMMYY",
]

# Input formats a date treatment accepts when none are listed.
COERCE_FORMATS = [
    "YYYY-MM-DD", "MM/DD/YYYY", "DD/MM/YYYY", "YYYY/MM/DD",
    "MM-DD-YYYY", "DD-MM-YYYY", "YYYYMMDD",
    "MM/DD/YY", "DD/MM/YY", "MMM DD, YYYY", "MMMM DD, YYYY",
    "DD-MMM-YYYY",
]

EXCEL_MIN, EXCEL_MAX = 1, 2958465

# token -> (pattern that reads it, Spark letters that read it, Spark letters that write it)
_TOKENS = {
    "YYYY": (r"(?<Y>(?!0000)\d{4})", "yyyy", "yyyy"),
    "YY": (r"(?<y>\d{2})", "yy", "yy"),
    "MMMM": (r"[A-Za-z]+", "MMMM", "MMMM"),
    "MMM": (r"[A-Za-z]{3}", "MMM", "MMM"),
    "MM": (r"(?<m>1[0-2]|0[1-9]|[1-9])", "M", "MM"),
    "M": (r"(?<m>1[0-2]|0[1-9]|[1-9])", "M", "M"),
    "DD": (r"(?<d>3[01]|[12]\d|0[1-9]|[1-9])", "d", "dd"),
    "D": (r"(?<d>3[01]|[12]\d|0[1-9]|[1-9])", "d", "d"),
    "HH": (r"(?<H>2[0-3]|[01]\d|\d)", "H", "HH"),
    "H": (r"(?<H>2[0-3]|[01]\d|\d)", "H", "H"),
    "hh": (r"(?:1[0-2]|0[1-9]|[1-9])", "h", "hh"),
    "h": (r"(?:1[0-2]|0[1-9]|[1-9])", "h", "h"),
    "mm": (r"(?<M>[0-5]\d|\d)", "m", "mm"),
    "m": (r"(?<M>[0-5]\d|\d)", "m", "m"),
    "ss": (r"(?<S>[0-5]\d|\d)", "s", "ss"),
    "s": (r"(?<S>[0-5]\d|\d)", "s", "s"),
    "A": (r"(?i:am|pm)", "a", "a"),
    "a": (r"(?i:am|pm)", "a", "a"),
    "ZZ": (r"[+-]\d\d:\d\d", "xxx", "xxx"),
    "Z": (r"[+-]\d{4}", "xx", "xx"),
    "dddd": (r"[A-Za-z]+", "EEEE", "EEEE"),
    "ddd": (r"[A-Za-z]{3}", "EEE", "EEE"),
}
_NUMERIC_ONLY = {"YYYY", "YY", "MM", "M", "DD", "D", "HH", "H", "mm", "m", "ss", "s"}
_SPLIT = re.compile("|".join(sorted(_TOKENS, key=len, reverse=True)))


@lru_cache(maxsize=256)
def _pieces(fmt: str) -> tuple[tuple[str, bool], ...]:
    """(text, is_token) pairs. In the ISO timestamp format T and Z are plain letters."""
    literal_z = fmt == "YYYY-MM-DDTHH:mm:ssZ"
    out, at = [], 0
    for hit in _SPLIT.finditer(fmt):
        if hit.start() > at:
            out.append((fmt[at : hit.start()], False))
        out.append((hit[0], not (literal_z and hit[0] == "Z")))
        at = hit.end()
    if at < len(fmt):
        out.append((fmt[at:], False))
    return tuple(out)


def _shape(fmt: str, two_digit_year: str | None = None) -> str:
    """A pattern of the texts a format accepts: field widths are lenient, letter case is free."""
    body, seen = "", set()
    for text, token in _pieces(fmt):
        if token:
            part = _TOKENS[text][0]
            if text == "YY" and two_digit_year:
                part = f"(?<y>{two_digit_year})"
            name = re.match(r"\(\?<(\w)>", part)
            if name and name[1] in seen:
                part = rf"\k<{name[1]}>"
            elif name:
                seen.add(name[1])
            body += part
        else:
            body += re.sub(r"(\\?\s)+", r"\\s+", re.escape(text))
    return f"(?i)^{body}$"


def _letters(fmt: str, writing: bool) -> str:
    out = ""
    for text, token in _pieces(fmt):
        out += _TOKENS[text][2 if writing else 1] if token else "'" + text.replace("'", "''") + "'"
    return out


def parse(text: Column, fmt: str) -> Column:
    """Trimmed text to a zone-free timestamp, or null.

    Numeric formats are rewritten to ISO by one regular expression and cast. Formats with
    names go through the formatter, behind a shape test so that misses raise nothing inside.
    """
    tokens = {t for t, is_token in _pieces(fmt) if is_token}
    if not tokens & {"YYYY", "YY"}:
        return _by_formatter(text, fmt)
    if tokens <= _NUMERIC_ONLY:
        if "YY" in tokens and "YYYY" not in tokens:
            # 69..99 belong to the 1900s, 00..68 to the 2000s.
            return F.coalesce(
                _by_rewrite(text, fmt, tokens, "19", r"69|[7-9]\d"),
                _by_rewrite(text, fmt, tokens, "20", r"[0-5]\d|6[0-8]"),
            )
        return _by_rewrite(text, fmt, tokens)
    parsed = _by_formatter(text, fmt)
    if "YY" in tokens:
        parsed = F.when(F.year(parsed) >= 2069, parsed - F.expr("INTERVAL 100 YEARS")).otherwise(parsed)
    return parsed


def _by_rewrite(text, fmt, tokens, century=None, two_digit_year=None) -> Column:
    shape = _shape(fmt, two_digit_year)
    if fmt in ("YYYY-MM-DD", "YYYY-MM-DD HH:mm:ss"):
        # the cast reads these as they are
        plain = text.try_cast("timestamp_ntz")
        if " " in fmt:
            plain = F.coalesce(plain, F.regexp_replace(text, r"\s+", " ").try_cast("timestamp_ntz"))
        return F.when(text.rlike(shape), plain)
    year = f"{century}${{y}}" if century else "${Y}"
    month = "${m}" if tokens & {"MM", "M"} else "01"
    day = "${d}" if tokens & {"DD", "D"} else "01"
    clock = [
        "${%s}" % group if tokens & names else "00"
        for group, names in (("H", {"HH", "H"}), ("M", {"mm", "m"}), ("S", {"ss", "s"}))
    ]
    iso = f"{year}-{month}-{day}"
    if clock != ["00", "00", "00"]:
        iso += " " + ":".join(clock)
    return F.when(text.rlike(shape), F.regexp_replace(text, shape, iso).try_cast("timestamp_ntz"))


def _by_formatter(text, fmt) -> Column:
    spaced = F.regexp_replace(text, r"\s+", " ") if " " in fmt else text
    return F.when(
        text.rlike(_shape(fmt)),
        F.try_to_timestamp(spaced, F.lit(_letters(fmt, writing=False))).cast("timestamp_ntz"),
    )


def excel_serial(days: Column, system: str = "1900") -> Column:
    """Days since the spreadsheet epoch, fractions included."""
    base = "1904-01-01" if system == "1904" else "1899-12-30"
    seconds = F.round(days * 86400, 6).cast("decimal(18,6)")
    return F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def parse_any(text: Column, formats: list[str], excel: bool = False) -> Column:
    """First format that reads the value wins; spreadsheet serials come first when enabled."""
    clean = strip(text)
    tries = []
    if excel:
        days = to_double(clean)
        tries.append(F.when(days.between(EXCEL_MIN, EXCEL_MAX), excel_serial(days)))
    tries += [parse(clean, f) for f in formats]
    if not tries:
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


_ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?Z?)?$"


def guess(text: Column) -> Column:
    """Any ISO date or timestamp, then the named formats, month before day."""
    clean = strip(text)
    iso = F.when(clean.rlike(_ISO_TIME), F.rtrim(clean, F.lit("Z")).try_cast("timestamp_ntz"))
    rest = [f for f in NAMED_FORMATS if f not in ("YYYY-MM-DD", "YYYY-MM-DD HH:mm:ss", "YYYY-MM-DDTHH:mm:ssZ")]
    return F.coalesce(iso, *[parse(clean, f) for f in rest])


def moment(c: Column, dtype: T.DataType | None) -> Column:
    """A typed date or timestamp as is, text guessed."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    return guess(c if isinstance(dtype, T.StringType) else c.cast("string"))


def render(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, _letters(fmt, writing=True))
