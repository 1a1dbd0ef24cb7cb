"""Dotted version numbers and script file names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of version directories and script files.
VERSION_PATTERN = r"\A[0-9]++(?:\.[0-9]++)*+\z"
SCRIPT_PATTERN = r"^(\d+)-.*\.(sql|py|json)$"
STRICT_SCRIPT_PATTERN = r"^\d{2}-.*\.(sql|py|json)$"
SCRIPT_EXTENSION_PATTERN = r"\.(sql|py|json)$"
INIT_FILE = "init.sql"
KEY_WIDTH = 9  # digits that tell the length of a version's part
NUMBER_TYPE = "decimal(38,0)"
LONGEST_NUMBER = "9" * 38


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_version(version: Column | str) -> Column:
    """True for dotted integers of any length."""
    return _col(version).rlike(VERSION_PATTERN)


def version_key(version: Column | str) -> Column:
    """``array<string>`` that sorts as the version does; NULL for anything else.

    A part is its number of digits, then its digits, without leading zeros: that
    sorts as the number does, however long it is. Trailing zero parts are
    dropped, so ``1.4`` and ``1.4.0`` get one key.
    """
    version = _col(version)
    parts = F.split(F.regexp_replace(version, r"(?:\.0++)++$", ""), r"\.")
    return F.when(is_version(version), F.transform(parts, _number_key))


def _number_key(digits: Column) -> Column:
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), KEY_WIDTH, "0"), plain)


def version_of_key(key: Column | str) -> Column:
    """The version that a key stands for, in its shortest form."""
    return F.array_join(F.transform(_col(key), lambda part: F.substring(part, KEY_WIDTH + 1, 1 << 30)), ".")


def below_all_versions() -> Column:
    """A key less than that of every version."""
    return F.array().cast("array<string>")


def version_literal(version: str) -> Column:
    """The key of a version known when the plan is built."""
    return version_key(F.lit(version))


def compare_versions(left: Column | str, right: Column | str) -> Column:
    """-1, 0 or 1; NULL when either side is not a version."""
    a, b = version_key(left), version_key(right)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def from_version(version: Column | str, floor: str | None) -> Column:
    """Versions at or above ``floor``; no floor keeps every version."""
    if not floor:
        return is_version(version)
    return version_key(version) >= version_literal(floor)


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def is_script_name(filename: Column | str) -> Column:
    """Numbered ``.sql``, ``.py`` or ``.json`` file, which ``init.sql`` is not."""
    return _col(filename).rlike(SCRIPT_PATTERN)


def is_strict_script_name(filename: Column | str) -> Column:
    """The form the rules ask for: exactly two digits, then a dash."""
    return _col(filename).rlike(STRICT_SCRIPT_PATTERN)


def has_script_extension(filename: Column | str) -> Column:
    return _col(filename).rlike(SCRIPT_EXTENSION_PATTERN)


def _script_digits(path: Column | str) -> Column:
    return F.regexp_extract(base_name(path), SCRIPT_PATTERN, 1)


def script_key(path: Column | str) -> Column:
    """Text that sorts as the leading number of a script file does, however long that is; NULL without one."""
    digits = _script_digits(path)
    return F.when(digits != "", _number_key(digits))


def script_number(path: Column | str) -> Column:
    """Leading number of a script file given by name or path, to be shown; NULL without one.

    Numbers of more than 38 digits are all shown as the greatest one. Whatever
    compares or orders numbers goes by :func:`script_key`, which has no such limit.
    """
    digits = _script_digits(path)
    return F.when(digits != "", F.coalesce(digits.try_cast(NUMBER_TYPE), F.lit(LONGEST_NUMBER).cast(NUMBER_TYPE)))


def file_extension(path: Column | str) -> Column:
    """Last extension with its dot, or an empty string."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def relative_name(version: Column | str, filename: Column | str) -> Column:
    return F.concat_ws("/", _col(version), _col(filename))


def anchor_version(anchor: Column | str) -> Column:
    """Version part of a recorded ``version/filename``; NULL when nothing is recorded."""
    anchor = _col(anchor)
    return F.when(F.length(anchor) > 0, F.substring_index(anchor, "/", 1))


def anchor_number(anchor: Column | str) -> Column:
    """Script number of the recorded file; -1 for ``init.sql`` or nothing."""
    return F.coalesce(script_number(anchor), F.lit(-1).cast(NUMBER_TYPE))
