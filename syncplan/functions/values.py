"""Functions on names, hashes, numbers and errors as column expressions (null gives null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _col

_WHITE = " \t\n\r\x0b\x0c"
ERROR_BYTES = 4096
#: Beyond what a double holds.
NUMBER_EXPONENT = 400
ERROR_MARK = "...[truncated]"
BYTE_UNITS = ("KB", "MB", "GB", "TB", "PB")


def trim_white(text: Column | str) -> Column:
    return F.trim(_col(text), F.lit(_WHITE))


def canonical_field_name(name: Column | str) -> Column:
    return F.lower(trim_white(name))


def canonical_path(path: Column | str) -> Column:
    """``Topics > Sports`` and ``topics/sports`` are the same path."""
    parts = F.split(F.replace(_col(path), F.lit(">"), F.lit("/")), "/")
    return F.lower(F.array_join(F.transform(parts, trim_white), "/"))


def line_hash(line: Column | str) -> Column:
    """The first 16 hexadecimal digits of the trimmed line's SHA-256."""
    return F.substring(F.sha2(trim_white(line), 256), 1, 16)


def ledger_key(manifest: Column | str, destination: Column | str) -> Column:
    """``<manifest's name>-<8 digits of the hash of path and destination>``."""
    manifest = _col(manifest)
    name = F.regexp_replace(F.element_at(F.split(manifest, "/"), -1), r"\.[^.]*\z", "")
    return F.concat(name, F.lit("-"), F.substring(F.sha2(F.concat(manifest, F.lit("\x00"), _col(destination)), 256), 1, 8))


def truncate_error(text: Column | str, limit: int = ERROR_BYTES) -> Column:
    """At most so many bytes of UTF-8, the mark included; cut between characters, never within one."""
    text = _col(text)
    room, body = limit - len(ERROR_MARK), text.cast("binary")
    within = lambda i: F.hex(F.substring(body, i, 1)).rlike("^[89AB]")  # noqa: E731  byte i goes on with a character
    # as many whole characters as fit: where the next byte would go on, back to the character's first byte
    end = F.when(~within(room + 1), room).when(~within(room), room - 1).when(~within(room - 1), room - 2).otherwise(room - 3)
    short = F.substring(body, F.lit(1), end).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(short, F.lit(ERROR_MARK)))


def human_bytes(n: Column | str, largest: str = "PB") -> Column:
    """``512 B``, ``1.50 KB``, ``2.00 GB``: powers of 1024 up to the unit ``largest``, rounded as C's ``%.2f`` rounds.

    Hundredths are counted in whole numbers: a formatter that rounds a number's shortest decimal text may round up what lies
    just below a half.
    """
    n = _col(n).cast("double").cast("long")
    out = F.format_string("%d B", n)
    for power, unit in enumerate(BYTE_UNITS[: BYTE_UNITS.index(largest) + 1], 1):
        part = F.lit((1 << 10 * power) - 1)
        whole, rest = F.shiftright(n, 10 * power), n.bitwiseAND(part) * 100
        cents, over = F.shiftright(rest, 10 * power), rest.bitwiseAND(part)
        half = F.lit(1 << 10 * power - 1)  # of two hundredths as near as each other, the even one
        up = F.when((over > half) | (over == half) & (cents % 2 == 1), 1).otherwise(0)
        cents = cents + up
        out = F.when(n >= 1 << 10 * power, F.format_string(f"%d.%02d {unit}", whole + F.when(cents == 100, 1).otherwise(0), cents % 100)).otherwise(out)
    return out


def backoff_seconds(attempts: Column | str, base: float = 2.0, most: float = 300.0, jitter: float = 0.0, key: Column | str | None = None) -> Column:
    """min(base * 2**(attempts - 1), most), spread by up to ``jitter`` of it; the same for the same key and attempt."""
    attempts = _col(attempts)
    whole = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1))
    if not jitter or key is None:
        return whole
    share = F.pmod(F.xxhash64(_col(key), attempts), F.lit(1_000_001)) / 1_000_000.0
    return whole * (1 + F.lit(float(jitter)) * (2 * share - 1))


def plain_number(value: Column | str) -> Column:
    """A number, or text that is one, as plain decimal text without exponent, leading or trailing zeros; null if it is none.

    The point is moved within the text, so numbers of any length stay exact.  Numbers with an exponent beyond
    NUMBER_EXPONENT either way give null.
    """
    text = trim_white(_col(value).cast("string"))
    part = lambda i: F.regexp_extract(text, r"^([+-]?)(?=\.?\d)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?\z", i)
    whole, fraction = part(2), part(3)
    exponent = F.when(part(4) == "", F.lit(0)).otherwise(part(4).try_cast("int"))
    digits, point = F.concat(whole, fraction), F.length(whole) + exponent  # the point stands before digits[point]
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    before = F.concat(F.substring(digits, F.lit(1), F.greatest(point, F.lit(0))), zeros(point - F.length(digits)))
    after = F.concat(zeros(-point), F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.length(digits)))
    before, after = F.regexp_replace(before, "^0+", ""), F.regexp_replace(after, r"0+\z", "")
    plain = F.concat(
        F.when((part(1) == "-") & ((before != "") | (after != "")), "-").otherwise(""),
        F.when(before == "", "0").otherwise(before),
        F.when(after == "", "").otherwise(F.concat(F.lit("."), after)),
    )
    return F.when((digits != "") & F.abs(exponent).between(0, NUMBER_EXPONENT), plain)


def http_category(status: Column | str) -> Column:
    status = _col(status)
    return (
        F.when(status.between(200, 299), "ok")
        .when(status == 400, "bad_request")
        .when(status == 401, "unauthorized")
        .when(status == 403, "forbidden")
        .when(status == 404, "not_found")
        .when(status == 409, "conflict")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server")
        .otherwise("other")
    )


def retryable(status: Column | str, verb: Column | str) -> Column:
    """429 always; 500, 502, 503 and 504 only for verbs that may be repeated."""
    status, verb = _col(status), F.upper(_col(verb))
    repeatable = verb.isin("GET", "HEAD", "PUT", "DELETE", "OPTIONS")
    return (status == 429) | (status.isin(500, 502, 503, 504) & repeatable)
