"""Ignore patterns: F1 and F2."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import _col

IGNORE_NAME = ".syncignore"
#: Bytes of an ignore file that count.
IGNORE_BYTES = 1 << 20
#: Patterns beyond which those without wildcards are looked up.
MANY = 64


def _segment(text: str) -> str:
    """One path segment of a pattern as a regular expression."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "*":
            while i + 1 < len(text) and text[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            inner = text[i + 1 : end]
            negated = inner[0] in "!^" and len(inner) > 1
            inner = inner[negated:].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"(?!/)[{'^' * negated}{inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def pattern_regex(line: str) -> str | None:
    """The regular expression of one line, or None for a blank line or comment.

    A bare name matches at any depth, a leading or inner ``/`` anchors, a trailing ``/`` or ``/**`` means the directory
    and all below it, ``*`` and ``?`` stay in one segment, ``**`` as a segment spans any number of them.
    """
    text = line.rstrip("\r\n").strip()
    if not text or text.startswith("#"):
        return None
    below = text.endswith("/") or text.endswith("/**")
    text = text.removesuffix("/**").rstrip("/")
    anchored = text.startswith("/") or "/" in text
    parts = [p for p in text.split("/") if p]
    if not parts:
        return None
    if parts[0] == "**":
        parts, anchored = parts[1:], False
        if not parts:
            return ".*"
    out, gap = "", False
    for i, part in enumerate(parts):
        if part == "**":
            gap = True
            continue
        if i:
            out += "/(?:.*/)?" if gap else "/"
        gap = False
        out += _segment(part)
    out += "(?:/.*)?" if gap or below else ""
    return ("" if anchored else "(?:.*/)?") + out


def _plain(line: str) -> tuple[str, str] | None:
    """Of a pattern without wildcards what it names (name, names, path or paths; the plural is a folder and all below) and the text."""
    text = line.strip()
    if not text or text.startswith("#") or re.search(r"[*?\[]", text.removesuffix("/**")):
        return None
    below, bare = text.endswith(("/", "/**")), text.removesuffix("/**").rstrip("/")
    parts = [p for p in bare.split("/") if p]
    if not parts:
        return None
    return ("path" if "/" in bare else "name") + "s" * below, "/".join(parts)


def _quoted(texts: Iterable[str]) -> str:
    return ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in texts)


def _named(plain: dict[str, list[str]], path: Column) -> Column:
    """Whether a path is matched by any of the plain patterns, found by hash and not one after another.

    Lists are SQL text, which Spark parses much sooner than it is given a column for each; it makes a hash set of a long one.
    """
    parts = F.split(path, "/")
    of = {
        "name": lambda: F.slice(parts, -1, 1), "names": lambda: parts, "path": lambda: F.array(path),
        "paths": lambda: F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/")),
    }
    found = F.lit(False)
    for kind, texts in plain.items():
        found = found | F.call_function("exists", of[kind](), F.expr(f"x -> x in ({_quoted(texts)})"))
    return found


def ignore_predicate(lines: Iterable[str], path: Column | str = "path", rel_dir: str = "") -> Column:
    """Whether a path matches any pattern; with ``rel_dir``, patterns hold below that directory.  One alternation, no UDF.

    Of more than MANY patterns those without wildcards are looked up in sets.
    """
    lines, plain = [x for x in lines if pattern_regex(x)], {}
    if len(lines) > MANY:
        for kind, text in filter(None, map(_plain, lines)):
            plain.setdefault(kind, []).append(text)
        lines = [x for x in lines if not _plain(x)]
    found, path = [pattern_regex(x) for x in lines], _col(path)
    start = rel_dir.strip("/") + "/" if rel_dir.strip("/") else ""
    out = path.rlike("(?s)\\A" + re.escape(start) + "(?:" + "|".join(found) + ")\\z") if found else F.lit(False)
    if plain:
        out = out | (F.startswith(path, F.lit(start)) & _named(plain, F.substring(path, len(start) + 1, 1 << 30)))
    return F.coalesce(out, F.lit(False))


def event_eligible(lines: Iterable[str], path: Column | str = "path") -> Column:
    """Not ignored, and not the ignore file itself."""
    return (F.element_at(F.split(_col(path), "/"), -1) != IGNORE_NAME) & ~ignore_predicate(lines, path)


def filter_ignored(entries: DataFrame, lines: Iterable[str], path: str = "path") -> DataFrame:
    return entries.filter(event_eligible(lines, path))


def ignore_lines(content: str | bytes | None) -> list[str]:
    """Lines of an ignore file's first mebibyte; none if the file is absent."""
    raw = (content or b"") if not isinstance(content, str) else content.encode()
    return raw[:IGNORE_BYTES].decode("utf-8", "replace").splitlines()
