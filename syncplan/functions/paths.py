"""Path functions as column expressions (a null path gives null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stem(path: Column | str) -> Column:
    """The path without the extension of its last segment; of a dotfile nothing is left."""
    return F.regexp_replace(_col(path), r"\.[^./]*\z", "")


def directory(path: Column | str) -> Column:
    """What stands before the last ``/``; '' at the top."""
    return F.regexp_extract(_col(path), r"(?s)^(.*)/[^/]*\z", 1)


def extension(path: Column | str) -> Column:
    """The last segment's extension without its dot, or ''."""
    return F.regexp_extract(_col(path), r"\.([^./]*)\z", 1)


def segments(path: Column | str) -> Column:
    return F.filter(F.split(_col(path), "/"), lambda s: s != "")


def segment(path: Column | str, i: int) -> Column:
    """The i-th segment from 1, or from the end if i is negative; null if there are not so many."""
    return F.try_element_at(segments(path), F.lit(i))


def basename(path: Column | str) -> Column:
    """The last segment; ``upload`` where there is none."""
    last = F.element_at(F.split(F.regexp_replace(_col(path), r"/+\z", ""), "/"), -1)
    return F.when(last.isin("", "."), F.lit("upload")).otherwise(last)


def sanitize_filename(name: Column | str) -> Column:
    """Each character that file systems forbid becomes ``_``."""
    return F.regexp_replace(_col(name), r'[\x00-\x1F<>:"/\\|?*]', "_")


def rename_warning(path: Column | str) -> Column:
    """Text for a name that ``sanitize_filename`` changes, else null."""
    name = basename(path)
    clean = sanitize_filename(name)
    return F.when(clean != name, F.format_string('filename rewritten: "%s" -> "%s"', name, clean))


def full_key(path: Column | str, prefix: str) -> Column:
    """A path under a configured prefix, with exactly one ``/`` between them."""
    bare = prefix.strip("/")
    return F.concat(F.lit(f"{bare}/"), F.ltrim(_col(path), F.lit("/"))) if bare else F.ltrim(_col(path), F.lit("/"))


def rel_key(key: Column | str, prefix: str) -> Column:
    """A key without its configured prefix; null for a key that isn't under it."""
    bare, key = prefix.strip("/"), _col(key)
    if not bare:
        return F.ltrim(key, F.lit("/"))
    return F.when(F.startswith(key, F.lit(f"{bare}/")), F.ltrim(F.substring(key, len(bare) + 2, 1 << 30), F.lit("/"))).when(
        key == bare, F.lit("")
    )


def is_under(path: Column | str, prefix: Column | str) -> Column:
    """Equal to the prefix or below it; everything is under ''."""
    path = _col(path)
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (prefix == "") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def version_token(size: Column | str, mtime: Column | str) -> Column:
    """``<size>-<microseconds>``; Spark's timestamps end at microseconds."""
    return F.concat_ws("-", _col(size).cast("string"), F.unix_micros(_col(mtime).cast("timestamp")).cast("string"))


def trim_etag(tag: Column | str) -> Column:
    return F.regexp_replace(_col(tag), '^"|"$', "")


def scope_key(connector: Column | str, prefix: Column | str) -> Column:
    """The connector's name, and ``#prefix`` if there is one."""
    connector, prefix = _col(connector), _col(prefix)
    return F.when(F.coalesce(prefix, F.lit("")) == "", connector).otherwise(F.concat(connector, F.lit("#"), prefix))


def redact_urls(text: Column | str) -> Column:
    """Queries of http(s) addresses in a text are replaced.

    An address ends at white space or a quote; its query begins at the first ``?`` behind some host.
    """

    def redacted(word: Column) -> Column:
        at = F.regexp_instr(word, F.lit("https?://[^?]"))
        address = F.substring(word, at, F.length(word))
        cut = F.concat(F.substring(word, F.lit(1), at - 1), F.substring_index(address, "?", 1), F.lit("?<redacted>"))
        return F.when((at > 0) & F.contains(address, F.lit("?")), cut).otherwise(word)

    words = F.split(_col(text), r"""(?<=[\s"'])|(?=[\s"'])""")  # white space and quotes stand alone
    return F.array_join(F.transform(words, redacted), "")
