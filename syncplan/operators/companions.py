"""Companion files: P1 to P6, J4, J6, J9, J10, S7's caller side and D1."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.paths import _col, directory, extension, stem
from .synclog import latest

#: Bytes of a companion that are read.
COMPANION_BYTES = 64 << 20
#: Companions of a directory that meet its assets in one part.
PAIRED = 1024
MATCH = "dir string, basename string, extension string, vars map<string,string>, wildcards array<string>, pattern string"
#: Elements within one another.
XML_DEPTH = 256
#: Prefixes of XMP's namespaces.
XML_PREFIXES = {
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://ns.adobe.com/xap/1.0/": "xmp",
    "http://ns.adobe.com/xap/1.0/rights": "xmpRights",
    "http://ns.adobe.com/photoshop/1.0/": "photoshop",
    "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/": "Iptc4xmpCore",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "adobe:ns:meta/": "x",
}
FIELDS = "array<struct<name: string, value: string, language: string>>"


@dataclass(frozen=True)
class CompanionPattern:
    """A file name with ``${basename}`` (required, may hold dots), ``${extension}``, other ``${names}`` and ``*``.

    Each but the basename is one or more characters without ``/`` and ``.``.  Groups of the regular expression are
    positional, as Java's names can't hold every name.
    """

    raw: str
    regex: str = field(init=False)
    groups: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if "/" in self.raw:
            raise ValueError(f"pattern {self.raw!r}: a pattern names a file, without /")
        out, groups, i = [], [], 0
        while i < len(self.raw):
            if self.raw.startswith("${", i):
                end = self.raw.find("}", i)
                if end < 0:
                    raise ValueError(f"pattern {self.raw!r}: a variable isn't closed")
                name = self.raw[i + 2 : end]
                if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                    raise ValueError(f"pattern {self.raw!r}: {name!r} is no name")
                if name in groups:
                    raise ValueError(f"pattern {self.raw!r}: {name} is given twice")
                groups.append(name)
                out.append("([^/]+)" if name == "basename" else "([^/.]+)")
                i = end + 1
            elif self.raw[i] == "*":
                groups.append("*")
                out.append("([^/.]+)")
                i += 1
            else:
                out.append(re.escape(self.raw[i]))
                i += 1
        if "basename" not in groups:
            raise ValueError(f"pattern {self.raw!r}: ${{basename}} is missing")
        object.__setattr__(self, "regex", r"\A(?:[^/]*/)*" + "".join(out) + r"\z")
        object.__setattr__(self, "groups", tuple(groups))

    def match(self, path: Column | str = "path") -> Column:
        """A struct of MATCH, null where the path doesn't match."""
        path = _col(path)
        got = {n: F.regexp_extract(path, self.regex, i) for i, n in enumerate(self.groups, 1) if n != "*"}
        stars = [F.regexp_extract(path, self.regex, i) for i, n in enumerate(self.groups, 1) if n == "*"]
        own = [x for n in got if n not in ("basename", "extension") for x in (F.lit(n), got[n])]
        found = F.struct(
            directory(path).alias("dir"),
            got["basename"].alias("basename"),
            got.get("extension", F.lit("")).alias("extension"),
            (F.create_map(*own) if own else F.create_map().cast("map<string,string>")).alias("vars"),
            (F.array(*stars) if stars else F.array().cast("array<string>")).alias("wildcards"),
            F.lit(self.raw).alias("pattern"),
        )
        return F.when(path.rlike(self.regex), found)


def match_companions(events: DataFrame, channels: Iterable[tuple[str, str, tuple[CompanionPattern, ...]]]) -> DataFrame:
    """Adds ``matches``: for each channel of the event's source the first pattern that matches, as (channel_name, MATCH)."""
    channels, found = list(channels), []
    # each pattern is matched once, in a column of its own, whatever number of channels has it
    distinct = list(dict.fromkeys(p.raw for _, _, patterns in channels for p in patterns))
    of = {raw: f"_match{i}" for i, raw in enumerate(distinct)}
    given = events.columns
    events = events.withColumns({c: CompanionPattern(raw).match("path") for raw, c in of.items()})
    for name, source, patterns in channels:
        if patterns:
            first = F.coalesce(*(F.col(of[p.raw]) for p in patterns))
            named = F.struct(F.lit(name).alias("channel_name"), *(first[c.split()[0]].alias(c.split()[0]) for c in MATCH.split(", ")))
            found.append(F.when((F.col("connector") == source) & first.isNotNull(), named))
    kind = f"array<struct<channel_name: string, {', '.join(': '.join(c.split()) for c in MATCH.split(', '))}>>"
    return events.select(*given, (F.array_compact(F.array(*found)) if found else F.array().cast(kind)).alias("matches"))


def plan_companions(companions: DataFrame, log: DataFrame, match_extension: bool = False) -> DataFrame:
    """Companion events with the latest record of their asset, found by channel, stem and directory; others are dropped.

    The record's extension isn't compared unless ``match_extension`` is set: ``hero.jpg`` and ``hero.png`` share a stem.
    """
    known = log.filter(F.col("source_stem").isNotNull())
    keys = ["channel_name", "source_stem", "source_dir"]
    if match_extension:
        known = known.withColumn("_extension", extension("source_path"))
        keys.append("_extension")
    parents = latest(known, *keys).select(*keys, F.col("source_path").alias("parent_path"), "dest_id")
    joined = F.concat(F.when(F.col("dir") == "", F.lit("")).otherwise(F.concat("dir", F.lit("/"))), F.col("basename"))
    rows = companions.withColumn("source_stem", joined).withColumn("source_dir", F.col("dir"))
    if match_extension:
        rows = rows.withColumn("_extension", F.col("extension"))
    return rows.join(parents, keys).drop(*(k for k in keys if k != "channel_name")).withColumn("work_kind", F.lit("companion"))


def presync(creates: DataFrame, companions: DataFrame, match: str = "stem") -> DataFrame:
    """``channel_name, path, companion_path`` and the match, for each asset to be created and each companion beside it.

    match="stem" takes companions of the asset's stem; match="directory" every companion of its directory.  The asset itself
    is never its own companion.  A directory's companions are dealt to parts of about ``PAIRED``, each met by all of its
    assets, so the pairs of a large directory are made by many tasks.
    """
    if match not in ("stem", "directory"):
        raise ValueError(f"match is 'stem' or 'directory', not {match!r}")
    assets = creates.select("channel_name", "path", directory("path").alias("_dir"), stem("path").alias("_stem"))
    own = F.concat(F.when(F.col("dir") == "", F.lit("")).otherwise(F.concat("dir", F.lit("/"))), F.col("basename"))
    beside = companions.select(
        "channel_name", F.col("path").alias("companion_path"), F.col("dir").alias("_dir"), own.alias("_stem"), "basename", "extension", "vars", "wildcards", "pattern"
    )
    keys = ["channel_name", "_dir"] + (["_stem"] if match == "stem" else [])
    if match == "directory":
        sizes = beside.groupBy(*keys).agg(F.ceil(F.count("*") / PAIRED).alias("_parts"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
        assets = assets.join(sizes, keys).withColumn("_part", each).drop("_parts")
        part = F.pmod(F.xxhash64("companion_path"), F.col("_parts"))
        beside = beside.drop("_stem").join(sizes, keys).withColumn("_part", part).drop("_parts")
        keys, tasks = [*keys, "_part"], int(creates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        assets, beside = (side.repartition(tasks, *keys) for side in (assets, beside))  # their rows are few, their pairs many
    joined = assets.join(beside, keys).filter(F.col("path") != F.col("companion_path"))
    return joined.drop("_dir", "_stem", "_part")


def presync_counts(creates: DataFrame, companions: DataFrame, match: str = "stem") -> DataFrame:
    """Each asset to be created and how many rows ``presync`` gives for it (those with none are left out); pairs aren't made.

    Companions are counted by directory (or stem), so the work grows with the rows and not with their product.
    """
    if match not in ("stem", "directory"):
        raise ValueError(f"match is 'stem' or 'directory', not {match!r}")
    own = F.concat(F.when(F.col("dir") == "", F.lit("")).otherwise(F.concat("dir", F.lit("/"))), F.col("basename"))
    beside = companions.select("channel_name", "path", F.col("dir").alias("_dir"), own.alias("_stem"))
    keys = ["channel_name", "_dir", *(["_stem"] if match == "stem" else [])]
    assets = creates.select("channel_name", "path", directory("path").alias("_dir"), stem("path").alias("_stem"))
    sizes = beside.groupBy(*keys).agg(F.count("*").alias("_all"))
    itself = beside.groupBy(*keys, "path").agg(F.count("*").alias("_itself"))
    rows = assets.join(sizes, keys).join(itself, [*keys, "path"], "left")
    n = F.col("_all") - F.coalesce("_itself", F.lit(0))
    return rows.select("channel_name", "path", n.alias("companions")).filter("companions > 0")


def late_companions(created: DataFrame, companions: DataFrame, presynced: DataFrame, match: str = "stem") -> DataFrame:
    """Companions of created assets that weren't folded into the create; with ``attempts`` above 1, all of them."""
    beside = presync(created, companions, match)
    if "attempts" in created.columns:
        beside = beside.join(created.select("channel_name", "path", "attempts"), ["channel_name", "path"])
    else:
        beside = beside.withColumn("attempts", F.lit(1))
    done = presynced.select("channel_name", "path", "companion_path").distinct().withColumn("_done", F.lit(True))
    joined = beside.join(done, ["channel_name", "path", "companion_path"], "left")
    return joined.filter(F.col("_done").isNull() | (F.col("attempts") > 1)).drop("_done", "attempts")


def _entry(name: str, value: Column, language: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        value.cast("string").alias("value"),
        (language if language is not None else F.lit(None)).cast("string").alias("language"),
    )


def companion_fields_json(df: DataFrame, mapping: dict[str, str], content: str = "content") -> DataFrame:
    """Adds ``fields`` and ``error``; ``mapping`` is field name -> path into the document (``$.a.b``).  Integers stay so."""
    parsed = F.try_parse_json(F.col(content).cast("string"))
    values = [(n, F.try_variant_get(parsed, path, "string")) for n, path in mapping.items()]
    fields = F.array_compact(F.array(*(F.when(v.isNotNull(), _entry(n, v)) for n, v in values)))
    error = F.when(parsed.isNull(), F.lit("not valid JSON"))
    return df.withColumn("fields", F.when(parsed.isNotNull(), fields)).withColumn("error", error)


def companion_fields_bundle(df: DataFrame, name: str, content: str = "content") -> DataFrame:
    """A file of culture -> text becomes one entry of the field for each culture."""
    texts = F.from_json(F.col(content).cast("string"), "map<string,string>")
    entries = F.transform(F.array_sort(F.map_entries(texts)), lambda e: _entry(name, e["value"], e["key"]))
    return df.withColumn("fields", entries)


class _Tree:
    """Builds a document's tree from a parser's calls; see ``xml_documents``."""

    def __init__(self):
        self.open: list[tuple[str, dict, list[str], dict[str, str], bool]] = []  # name, content, text, prefixes, has children
        self.document: dict = {}

    def _name(self, name: str, prefixes: dict[str, str]) -> str:
        prefix, colon, local = name.rpartition(":")
        uri = prefixes.get(prefix)
        if uri is None:
            return name
        known = XML_PREFIXES.get(uri)
        return f"{known}:{local}" if known else local

    def start(self, name: str, attributes: list[str]) -> None:
        if len(self.open) >= XML_DEPTH:
            raise ValueError(f"more than {XML_DEPTH} elements within one another")
        given = dict(zip(attributes[::2], attributes[1::2], strict=True))
        declared = {k[6:]: v for k, v in given.items() if k.startswith("xmlns:")} | ({"": given["xmlns"]} if "xmlns" in given else {})
        above = self.open[-1][3] if self.open else {}
        prefixes = above | declared if declared else above
        own: dict = {}
        for key, value in given.items():  # a prefix's declaration is an attribute of the prefix's name; the default namespace isn't for attributes
            own[key[6:] if key.startswith("xmlns:") else self._name(key, prefixes) if ":" in key else key] = value
        if self.open:
            self.open[-1] = (*self.open[-1][:4], True)
        self.open.append((self._name(name, prefixes), own, [], prefixes, False))

    def text(self, data: str) -> None:
        if self.open:
            self.open[-1][2].append(data)

    def end(self, _: str) -> None:
        name, own, parts, _, has_children = self.open.pop()
        text = "".join(parts).strip()
        leaf = not own and not has_children
        if text and not leaf:
            own["#text"] = text
        into = self.open[-1][1] if self.open else self.document
        value = text if leaf else own
        if name not in into:
            into[name] = value
        elif isinstance(into[name], list):
            into[name].append(value)
        else:
            into[name] = [into[name], value]


def _xml_tree(content: bytes | None) -> tuple[str | None, str | None, str | None]:
    """JSON of the document and of its first element's content, or an error."""
    if content is None:
        return None, None, "no content"
    body = re.sub(rb"\A(?:\xef\xbb\xbf)?\s*(?:<\?xml\b[^>]*\?>)?", b"", content)
    tree, parser = _Tree(), expat.ParserCreate("utf-8")
    parser.ordered_attributes, parser.buffer_text = True, True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tree.start, tree.end, tree.text
    parser.SkippedEntityHandler = lambda name, _: tree.text(f"&{name};")
    parser.UseForeignDTD(True)  # so an entity that nobody declared is told to the handler
    parser.ExternalEntityRefHandler = lambda *_: 1
    try:
        parser.Parse(body, True)
    except ValueError as e:
        return None, None, f"not valid XML: {e}"
    except expat.ExpatError as e:
        if body.strip() or tree.document:
            return None, None, f"not valid XML: {e}"
    root = next(iter(tree.document.values()), {})
    return json.dumps(tree.document, ensure_ascii=False), json.dumps(root, ensure_ascii=False), None


@F.arrow_udf(StructType([StructField(n, StringType()) for n in ("document", "root", "error")]))
def _xml_trees(content: pa.Array) -> pa.Array:
    found = [_xml_tree(x) for x in content.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 3, ["document", "root", "error"])


def xml_documents(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``tree`` (VARIANT) and ``error``: the XML document as a tree.

    An element is a map of its attributes and children by name, attributes without a mark; one of text alone is its trimmed
    text.  Children of one name are a list; text beside attributes or children is ``#text``.  A declared prefix becomes the
    usual one of XMP's namespaces and goes for any other; an undeclared one stays.  A document that isn't well-formed, or
    nests deeper than XML_DEPTH, is an error of its row; an empty one has no elements.
    """
    made = df.withColumn("_made", _xml_trees(F.col(content).cast("binary")))
    return made.withColumns({"tree": F.parse_json("_made.document"), "error": F.col("_made.error")}).drop("_made")


def _field_text(value: Column) -> Column:
    """Text of a VARIANT: text trimmed, lists and maps as JSON; null where it is null or empty."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string"))).otherwise(F.to_json(value))
    return F.when(value.isNotNull(), F.nullif(text, F.lit("")))


def companion_fields_xml(df: DataFrame, mapping: dict[str, str], content: str = "content") -> DataFrame:
    """Adds ``fields`` and ``error``; ``mapping`` is field name -> where its value is.

    That is an element or attribute of the root, prefix included (``dc:rights``), or a path from the document on
    (``$["x:xmpmeta"]["rdf:RDF"]``).  Repeated elements give a JSON list; fields that aren't there or empty are left out.
    """
    made = df.withColumn("_made", _xml_trees(F.col(content).cast("binary")))
    made = made.withColumns({"_document": F.parse_json("_made.document"), "_root": F.parse_json("_made.root")})
    wanted = {n: path for n, path in mapping.items() if path.startswith("$") or '"' not in path}  # no name holds a quote
    got = [(n, F.try_variant_get(*((F.col("_document"), path) if path.startswith("$") else (F.col("_root"), f'$["{path}"]')), "variant")) for n, path in wanted.items()]
    fields = F.array_compact(F.array(*(F.when(_field_text(v).isNotNull(), _entry(n, _field_text(v))) for n, v in got)).cast(FIELDS))
    error = F.col("_made.error")
    return made.withColumns({"fields": F.when(error.isNull(), fields), "error": error}).drop("_made", "_document", "_root")


def csv_records(text: str, delimiter: str = ",", comment: str = "") -> list[list[str]]:
    """Cells of each record.

    A cell that begins with a quote ends at a quote before a delimiter or a line's end; until then two quotes are one, a
    single one is itself, and line breaks belong to it.  Elsewhere quotes are text.  Blank lines between records and lines
    that begin with ``comment`` don't count, and ``\\r\\n`` is ``\\n``.
    """
    text, d = text.replace("\r\n", "\n").removesuffix("\r"), re.escape(delimiter)
    quoted = re.compile(rf'"((?:[^"]++|""|"(?!["\n]|{d}|\Z))*+)(?:"|\Z)')
    plain = re.compile(rf"(?:(?!{d})[^\n])*+")
    records, at, n = [], 0, len(text)
    while at < n:
        if text[at] == "\n" or comment and text.startswith(comment, at):
            end = text.find("\n", at)
            at = n if end < 0 else end + 1
            continue
        cells = []
        while True:
            m = (quoted if text.startswith('"', at) else plain).match(text, at)
            cells.append(m[1].replace('""', '"') if m.re is quoted else m[0])
            at = m.end()
            if at >= n or text[at] == "\n":
                break
            at += len(delimiter)
        records.append(cells)
        at += 1
    return records


def companion_fields_csv(
    df: DataFrame, mapping: dict[str, str | int], content: str = "content", delimiter: str = ",", comment: str = "#", header: bool = True
) -> DataFrame:
    """One row for each record: its number from 1 as ``record``, and ``fields``; see ``csv_records``.

    ``mapping`` is field name -> name in the file's first record, the last of that name, or the number of a cell from 1.
    Cells that a record lacks are left out; cells beyond the header have only their numbers.  With ``header=False`` the
    first record is one of data.
    """

    @F.arrow_udf("array<array<string>>")
    def parsed(texts: pa.Array) -> pa.Array:
        found = [None if x is None else csv_records(x.decode("utf-8", "replace"), delimiter, comment) for x in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.list_(pa.string())))

    names = df.columns
    rows = df.withColumn("_records", parsed(F.col(content).cast("binary")))
    rows = rows.withColumn("_header", F.coalesce(F.get("_records", F.lit(0)), F.array().cast("array<string>")) if header else F.array().cast("array<string>"))
    rows = rows.select(*names, "_header", F.posexplode(F.slice("_records", 2 if header else 1, 1 << 30)).alias("_number", "_cells"))
    last = lambda name: F.when(F.array_contains("_header", name), F.size("_header") + 1 - F.array_position(F.reverse("_header"), name)).cast("int")
    got = [(n, F.try_element_at("_cells", F.lit(k) if isinstance(k, int) else last(k))) for n, k in mapping.items()]
    fields = F.array_compact(F.array(*(F.when(v.isNotNull(), _entry(n, v)) for n, v in got)))
    return rows.withColumns({"fields": fields, "record": F.col("_number") + 1}).drop("_header", "_number", "_cells")


def companion_fields_text(df: DataFrame, name: str, language_var: str = "lang", content: str = "content", deleted: Column | None = None) -> DataFrame:
    """The trimmed text is the field's value in the captured language; of a deleted companion the empty text."""
    text = F.regexp_replace(F.col(content).cast("string"), r"\A\s+|\s+\z", "")
    value = text if deleted is None else F.when(deleted, F.lit("")).otherwise(text)
    return df.withColumn("fields", F.array(_entry(name, F.coalesce(value, F.lit("")), F.try_element_at("vars", F.lit(language_var)))))


@dataclass(frozen=True)
class Companion:
    """A pattern and the user's function: from a DataFrame of matched companions to one with ``fields`` (and ``error``)."""

    pattern: CompanionPattern
    fn: Callable[[DataFrame], DataFrame]

    def run(self, companions: DataFrame) -> DataFrame:
        own = companions.filter(F.col("pattern") == self.pattern.raw)
        out = self.fn(own)
        if "fields" not in out.columns:
            raise ValueError("a companion function returns a column 'fields': an array of (name, value, language)")
        return out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))
