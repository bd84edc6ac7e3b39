"""Clock text, file names and the quarter-hour key, as SQL expression text.

All times are naive local times (``TIMESTAMP_NTZ``). Parts are assembled
without a formatter, so neither the session time zone nor the locale matters.
"""

from __future__ import annotations

from verdance.functions.arrays import bind

# Month and weekday names as written by the instruments.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
WEEKDAYS = "MonTueWedThuFriSatSun"
# File name patterns.
FILE_NAME = r"^(fix_)?(QE_PRO|HR2000PLUS)_(.{20})\\.csv$"
PREFIX = {"QE": "QE_PRO_", "HR": "HR2000PLUS_"}

_CLOCK = r"^[A-Z][a-z]{2}[ _]+\\d{1,2}[ _]\\d{2}[:_]\\d{2}[:_]\\d{2}[ _]\\d{4}$"


def parse_clock(text: str) -> str:
    """``Jul 18 16:00:40 2016`` or ``Jul_18_16_00_40_2016``; NULL when malformed."""

    def number(i: int, kind: str = "INT") -> str:
        return f"try_cast(get(clk.p, {i}) AS {kind})"

    at = f"instr('{MONTHS}', get(clk.p, 0))"
    month = f"if({at} % 3 = 1, int(({at} + 2) div 3), NULL)"
    parsed = (
        f"try_make_timestamp_ntz({number(5)}, {month}, {number(1)}, {number(2)}, {number(3)},"
        f" {number(4, 'DECIMAL(16, 6)')})"
    )
    # one pattern test and one split per text
    parts = f"if(txt.t RLIKE '{_CLOCK}', split(txt.t, '[ _:]+'), NULL)"
    return bind({"t": text}, "txt", bind({"p": parts}, "clk", parsed))


def parse_header_time(line: str) -> str:
    """Header line: the date text starts at character 28 with the weekday."""
    text = f"trim(substring({line}, 28, 33))"
    return parse_clock(f"if({text} RLIKE '^[A-Z][a-z][a-z] ', substring({text}, 5, 30), NULL)")


def name_part(file_name: str, group: int) -> str:
    return f"regexp_extract({file_name}, '{FILE_NAME}', {group})"


def name_clock_text(file_name: str) -> str:
    """Date text of a file name with the day padded to two digits."""
    return f"replace({name_part(file_name, 3)}, '__', '_0')"


def parse_name_time(file_name: str) -> str:
    return parse_clock(name_clock_text(file_name))


def instrument_of(file_name: str) -> str:
    return f"CASE {name_part(file_name, 2)} WHEN 'QE_PRO' THEN 'QE' WHEN 'HR2000PLUS' THEN 'HR' END"


def run_kind_of(file_name: str) -> str:
    return f"if({name_part(file_name, 1)} = 'fix_', 'fixed', 'auto')"


def sanitise(text: str) -> str:
    """Blank and colon to underscore, cut at the first line end."""
    return f"translate(split_part({text}, '\\n', 1), ' :', '__')"


def clock_text(ts: str) -> str:
    """C library date text, day padded with a blank: ``Mon Jul  8 16:00:40 2016``."""
    return (
        f"concat_ws(' ', substring('{WEEKDAYS}', weekday({ts}) * 3 + 1, 3),"
        f" substring('{MONTHS}', (month({ts}) - 1) * 3 + 1, 3),"
        f" lpad(string(dayofmonth({ts})), 2, ' '),"
        f" concat_ws(':', {two('hour', ts)}, {two('minute', ts)}, {two('second', ts)}),"
        f" lpad(string(year({ts})), 4, '0'))"
    )


def two(part: str, ts: str) -> str:
    return f"lpad(string({part}({ts})), 2, '0')"


def file_name(ts: str, prefix: str) -> str:
    """File name of a run that started at ``ts``; ``prefix`` is an expression."""
    return f"concat({prefix}, {sanitise(f'substring({clock_text(ts)}, 5, 20)')}, '.csv')"


def quarter_hour(ts: str) -> str:
    """Start of the quarter-hour."""
    return (
        f"make_timestamp_ntz(year({ts}), month({ts}), dayofmonth({ts}), hour({ts}),"
        f" int(minute({ts}) div 15 * 15), 0)"
    )


def day_key(ts: str) -> str:
    """Zero-based day of the year plus the quarter-hour as a fraction of a day."""
    return f"(dayofyear({ts}) - 1) + (hour({ts}) + (minute({ts}) div 15) / 4D) / 24D"
