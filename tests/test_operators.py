import datetime
import json
import random
import re
from urllib.parse import quote

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syncplan.functions import paths as P
from syncplan.operators import catalog as C
from syncplan.operators import diff as D
from syncplan.operators import ledger as L
from syncplan.operators import manifest as M
from syncplan.operators import synclog, work
from syncplan.operators.channels import Channel, check_filter, plan_assets, route, split_companions
from syncplan.operators.companions import Companion, CompanionPattern, companion_fields_json, companion_fields_csv, companion_fields_text, companion_fields_xml, csv_records, late_companions, plan_companions, presync, presync_counts, xml_documents
from syncplan.operators.enrich import Enrich, lateral_fields, python_fields, register_fields_function, run_enrichers, split_failed
from syncplan.operators.diff import commit_snapshot, load_snapshot
from syncplan.operators import ignore as I
from syncplan.operators.ignore import filter_ignored, ignore_lines, pattern_regex
from syncplan.operators.metrics import ema
from syncplan.operators.watchers import Watcher, assign_watcher, normalize_watchers, sub_prefixes
from syncplan.schemas import SYNC_LOG
from syncplan.sources.store import BucketStore
from syncplan.operators.records import TABLES, Records, RecordStore, apply_plan
from syncplan.sources.listing import copy_assets, list_entries, read_companions, segment_plan, walk_entries, write_files

T0 = datetime.datetime(2024, 1, 1)


def _paths(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


@pytest.mark.parametrize("line,yes,no", [
    ("Thumbs.db", ["Thumbs.db", "a/b/Thumbs.db"], ["Thumbs.dbx"]),
    ("/build", ["build"], ["sub/build", "build/x"]),
    ("logs/", ["logs", "logs/a", "sub/logs/a/b.txt"], ["logsfile.txt"]),
    ("tmp/**", ["tmp", "tmp/a/b", "x/tmp/a"], ["tmpx", "src/tmp.txt"]),
    ("*.log\r\n", ["a.log", "x/y.log"], ["a.log.txt"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb", "z/a/b"]),
    ("**/z.txt", ["z.txt", "a/z.txt"], ["az.txt"]),
    ("f[0-9]?.x", ["f1a.x"], ["fa1.x", "f1.x"]),
])
def test_ignore_patterns(spark, line, yes, no):
    kept = {r["path"] for r in filter_ignored(_paths(spark, *yes, *no), [line]).collect()}
    assert kept == set(no)


def test_many_plain_patterns_match_as_single_ones_do(spark):
    lines = ["name", "it's", "back\\slash", "dir/", "gone/**", "/top", "a/b", "a/b/c/", "/x//y/", "**/p/q", "*.tmp", "h?t", "[ab]c", "# no", " ", "spaced  "]
    paths = [f"{a}{b}{c}" for a in ("", "z/", "a/b/", "x/y/") for b in ("name", "it's", "back\\slash", "dir", "gone", "top", "a/b", "a/b/c", "x/y", "p/q", "f.tmp", "hot", "ac", "spaced", "names", "", "a\nb") for c in ("", "/", "/e", "/name")]
    rows = _paths(spark, *paths).select("path", *(I.ignore_predicate([line], rel_dir=d).alias(f"{d}{i}") for d in ("", "z") for i, line in enumerate(lines)))
    many = [*lines, *(f"none{i}" for i in range(100)), *(f"none/{i}/" for i in range(100))]
    got = rows.withColumns({f"_{d}": I.ignore_predicate(many, rel_dir=d) for d in ("", "z")}).collect()
    for d in ("", "z"):
        assert {r["path"] for r in got if r[f"_{d}"]} == {r["path"] for r in got if any(r[f"{d}{i}"] for i in range(len(lines)))}
    plan = rows.filter(~I.ignore_predicate(many))._jdf.queryExecution().executedPlan().toString()
    assert "none99" in plan and "INSET" in plan and r"none0\z" not in plan and "|none" not in plan


def test_ignore_file(spark):
    assert pattern_regex("# c") is None and pattern_regex("  ") is None
    assert ignore_lines(None) == [] and ignore_lines("a\r\nb") == ["a", "b"]
    assert filter_ignored(_paths(spark, ".syncignore", "a"), []).count() == 1


def test_watchers(spark):
    with pytest.raises(ValueError):
        normalize_watchers([Watcher("a", 1), Watcher("/a/", 2)])
    with pytest.raises(ValueError):
        normalize_watchers([Watcher("a", 0)])
    watchers = normalize_watchers([Watcher("images/hot", 10), Watcher(" images/ ", 60)], 86400)
    assert sub_prefixes(watchers, "") == ["images", "images/hot"] and sub_prefixes(watchers, "images") == ["images/hot"]
    paths = _paths(spark, "images/hot/x.jpg", "images/hotel/x.jpg", "images", "other/x", "images/hot")
    want = {"images/hot/x.jpg": "images/hot", "images/hotel/x.jpg": "images", "images": "images", "other/x": "", "images/hot": "images/hot"}
    assert {r["path"]: r["watcher"] for r in assign_watcher(paths, watchers).collect()} == want
    table = spark.createDataFrame([(w.prefix,) for w in watchers], "prefix string")
    assert {r["path"]: r["watcher"] for r in assign_watcher(paths, table).collect()} == want


def _snapshot(spark, *rows):
    return spark.createDataFrame([(p, s, T0, h, None) for p, s, h in rows], "path string, size long, mtime timestamp, hash string, metadata map<string,string>")


def test_diff_passes_and_state(spark, tmp_path):
    passes = [[("a", 1, "h")], [("a", 1, "h")], [("a", 2, "h")], []]
    prev, got = _snapshot(spark), []
    for rows in passes:
        cur = _snapshot(spark, *rows)
        got += [(r["change"], r["kind"]) for r in D.diff_snapshots(prev, cur).collect()]
        prev = cur
    assert got == [("new", "OnCreate"), ("unchanged", None), ("modified", "OnUpdate"), ("deleted", "OnDelete")]
    same = _snapshot(spark, ("x", 1, None))
    assert D.events(D.diff_snapshots(same, _snapshot(spark, ("x", 1, "")))).count() == 0
    for n, scope in ((1, "s3#a/b"), (2, "s3#a/b"), (1, "s3")):
        assert D.commit_snapshot(_snapshot(spark, (f"p{n}", n, "h")), str(tmp_path), scope) == n
    schema = "path string, size long, mtime timestamp, hash string, metadata map<string,string>"
    assert [r["path"] for r in D.load_snapshot(spark, str(tmp_path), "s3#a/b", schema).collect()] == ["p2"]
    assert D.load_snapshot(spark, str(tmp_path), "none", schema).count() == 0
    (tmp_path / "scope=s3" / "generation=2").mkdir()  # without a marker it isn't there
    assert [r["path"] for r in D.load_snapshot(spark, str(tmp_path), "s3", schema).collect()] == ["p1"]


def _log(spark, *rows):
    """(id, channel, path, version, dest)"""
    return synclog.with_stem(spark.createDataFrame([(i, T0, c, "src", p, v, d, "create", None, None, None, None) for i, c, p, v, d in rows], SYNC_LOG))


def test_log(spark, tmp_path):
    log = _log(spark, (1, "c", "hello.txt", "v1", "r1"), (2, "c", "hello.txt", "v2", "r1"), (3, "d", "hello.txt", "v1", "r9"))
    assert {(r["channel_name"], r["source_version"]) for r in synclog.latest(log).collect()} == {("c", "v2"), ("d", "v1")}
    written = spark.createDataFrame([("c", "hello.txt", "v2", "r1"), ("c", "new.txt", "v1", "r2"), ("d", "hello.txt", "v2", "r9")], "channel_name string, source_path string, source_version string, dest_id string")
    rows = synclog.new_log_rows(log, written, T0, idempotent=True).collect()
    assert {(r["channel_name"], r["source_path"]) for r in rows} == {("c", "new.txt"), ("d", "hello.txt")} and min(r["id"] for r in rows) > 3
    old = log.withColumn("ts", F.when(F.col("id") < 3, F.lit(datetime.datetime(2020, 1, 1))).otherwise(F.col("ts")))
    rest = synclog.archive_older_than(old, T0, str(tmp_path / "out"))
    assert [r["id"] for r in rest.collect()] == [3] and spark.read.json(str(tmp_path / "out")).count() == 2
    assert "file_size" not in spark.read.json(str(tmp_path / "out")).columns
    assert [r["derived_kind"] for r in synclog.version_history(log).orderBy("id").collect()] == ["create", "update", "create"]


@pytest.mark.parametrize("raw,path,want", [
    ("${basename}.${extension}.metadata.json", "photos/my.weird.photo.jpg.metadata.json", ("photos", "my.weird.photo", "jpg", {}, [])),
    ("${basename}.caption.${lang}.txt", "a/b.caption.en.txt", ("a", "b", "", {"lang": "en"}, [])),
    ("${basename}.*.*.txt", "b.en.v2.txt", ("", "b", "", {}, ["en", "v2"])),
    ("${basename}.caption.${lang}.txt", "b.caption.en.us.txt", None),
    ("${basename}$.x", "b$.x", ("", "b", "", {}, [])),
])
def test_companion_patterns(spark, raw, path, want):
    m = _paths(spark, path).select(CompanionPattern(raw).match("path").alias("m")).first()["m"]
    assert want == (m and (m["dir"], m["basename"], m["extension"], m["vars"], m["wildcards"]))


@pytest.mark.parametrize("raw", ["a/${basename}", "x.txt", "${basename}${basename}", "${basename}.${1}", "${basename}.${", "${basename}.${}"])
def test_bad_patterns(raw):
    with pytest.raises(ValueError):
        CompanionPattern(raw)


def test_channels(spark):
    for bad in ({"event": "OnCreate", "events": ("OnUpdate",)}, {}, {"events": ()}, {"events": ("OnCreate", "OnCreate")}, {"event": "OnMove"}):
        with pytest.raises(ValueError):
            Channel("c", "s", **bad)
    events = spark.createDataFrame([("s", "OnCreate", "tiny.txt", 5, "h"), ("s", "OnCreate", "big.bin", 1024, "h"), ("t", "OnCreate", "x", 1024, "h"), ("s", "OnCreate", "big.xmp", None, "h")], "connector string, kind string, path string, size long, hash string")
    channel = Channel("c", "s", event="OnCreate", filter="size > 100", companions=(CompanionPattern("${basename}.xmp"),))
    assert [r["path"] for r in route(events, [channel]).collect()] == ["big.bin"]
    with pytest.raises(ValueError):
        check_filter(events, "size + 1")
    assets, companions = split_companions(events, [channel])
    assert sorted(r["path"] for r in assets.collect()) == ["big.bin", "tiny.txt", "x"]
    assert [(r["path"], r["channel_name"], r["basename"]) for r in companions.collect()] == [("big.xmp", "c", "big")]


def test_only_fresh_events_are_planned(spark):
    log = _log(spark, *[(i, "c", f"p{i}", "v1", f"r{i}") for i in range(600)])
    events = spark.createDataFrame([("s", "OnUpdate", f"p{i}", 1, "v1") for i in range(600)] + [("s", "OnCreate", "fresh.txt", 1, "v1"), ("s", "OnUpdate", "p1", 1, "")], "connector string, kind string, path string, size long, hash string")
    plan = plan_assets(route(events, [Channel("c", "s", events=("OnCreate", "OnUpdate"))]), log)
    assert {(r["path"], r["work_kind"]) for r in plan.collect()} == {("fresh.txt", "create"), ("p1", "update")}


def test_companions_meet_assets(spark):
    log = _log(spark, (1, "c", "a/hero.jpg", "v", "r1"), (2, "c", "a/hero.png", "v", "r2"), (3, "c", "top.jpg", "v", "r3"))
    schema = "channel_name string, path string, dir string, basename string, extension string, vars map<string,string>, wildcards array<string>, pattern string"
    found = spark.createDataFrame([("c", "a/hero.jpg.xmp", "a", "hero", "jpg", {}, [], "p"), ("c", "top.xmp", "", "top", "", {}, [], "p"), ("c", "b/hero.xmp", "b", "hero", "", {}, [], "p")], schema)
    assert {r["path"]: r["dest_id"] for r in plan_companions(found, log).collect()} == {"a/hero.jpg.xmp": "r2", "top.xmp": "r3"}
    assert {r["path"]: r["dest_id"] for r in plan_companions(found, log, match_extension=True).collect()} == {"a/hero.jpg.xmp": "r1"}
    creates = spark.createDataFrame([("c", "a/hero.jpg", 1), ("c", "a/other.jpg", 1)], "channel_name string, path string, attempts int")
    assert [r["path"] for r in presync(creates, found).collect()] == ["a/hero.jpg"]
    both = presync(creates, found, "directory")
    assert sorted(r["path"] for r in both.collect()) == ["a/hero.jpg", "a/other.jpg"]
    assert late_companions(creates, found, presync(creates, found)).count() == 0
    assert late_companions(creates.withColumn("attempts", F.lit(2)), found, presync(creates, found)).count() == 1


def test_pairs_of_a_large_directory_are_made_by_several_tasks(spark):
    """All of them, and once; another directory and another channel keep theirs."""
    creates = spark.range(300).select(F.when(F.col("id") < 290, "x").otherwise("y").alias("channel_name"), F.concat(F.when(F.col("id") < 280, "d/").otherwise("e/"), "id", F.lit(".jpg")).alias("path"))
    names = spark.range(9000).select(F.lit("x").alias("channel_name"), F.concat(F.when(F.col("id") < 8990, "d").otherwise("e"), F.lit("/"), "id", F.lit(".xmp")).alias("path"))
    pattern = CompanionPattern("${basename}.xmp")
    found = names.withColumn("m", pattern.match("path")).select("channel_name", "path", "m.*")
    rows = presync(creates, found, "directory").select("channel_name", F.substring("path", 1, 2).alias("dir"), "path", "companion_path", F.spark_partition_id().alias("task"))
    got = rows.groupBy("channel_name", "dir").agg(F.count("*").alias("n"), F.countDistinct("path", "companion_path").alias("pairs"), F.countDistinct("task").alias("tasks")).collect()
    assert {(r["channel_name"], r["dir"]): (r["n"], r["pairs"]) for r in got} == {("x", "d/"): (280 * 8990,) * 2, ("x", "e/"): (100, 100)}
    assert max(r["tasks"] for r in got) > 2


def test_counts_of_companions_are_those_of_the_pairs(spark):
    """Assets that are companions themselves, given twice, in no directory, alone, or of another channel."""
    names = ["d/a.xmp", "d/a.xmp", "d/b.xmp", "d/c.jpg", "a.xmp", "e/z.xmp"]
    pattern = CompanionPattern("${basename}.*")
    found = _paths(spark, *names).withColumn("channel_name", F.when(F.startswith("path", F.lit("e/")), "y").otherwise("x")).withColumn("m", pattern.match("path")).select("channel_name", "path", "m.*")
    creates = _paths(spark, "d/a.jpg", "d/a.xmp", "d/c.jpg", "d/c.jpg", "a.jpg", "e/z.jpg", "f/q.jpg", "e/z.xmp").withColumn("channel_name", F.lit("x"))
    for match in ("stem", "directory"):
        pairs = presync(creates, found, match).groupBy("channel_name", "path").agg(F.count("*").alias("n"))
        counts = presync_counts(creates, found, match).groupBy("channel_name", "path").agg(F.sum("companions").alias("n"))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, pairs.collect())) != []


def test_companion_contents(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": 7}, "t": "x"}'), (2, "{broken")], "id int, content string")
    got = {r["id"]: r for r in companion_fields_json(rows, {"B": "$.a.b", "T": "$.t"}).collect()}
    assert [(f["name"], f["value"]) for f in got[1]["fields"]] == [("B", "7"), ("T", "x")] and got[2]["error"]
    xml = spark.createDataFrame([('<x:xmp dc:rights=" mine "><title>T</title></x:xmp>',)], "content string")
    assert [(f["name"], f["value"]) for f in companion_fields_xml(xml, {"R": "dc:rights", "T": "title", "N": "none"}).first()["fields"]] == [("R", "mine"), ("T", "T")]
    text = spark.createDataFrame([("  hi \n", {"lang": "fr"}, False, "p"), ("gone", {}, True, "p")], "content string, vars map<string,string>, deleted boolean, pattern string")
    got = companion_fields_text(text, "Caption", deleted=F.col("deleted")).collect()
    assert [(r["fields"][0]["value"], r["fields"][0]["language"]) for r in got] == [("hi", "fr"), ("", None)]
    pattern = CompanionPattern("${basename}.txt")
    with pytest.raises(ValueError):
        Companion(pattern, lambda df: df).run(text)
    assert Companion(pattern, lambda df: companion_fields_text(df, "C")).run(text).count() == 0


def _xml(spark, *documents):
    rows = spark.createDataFrame(list(enumerate(documents)), "i int, content string")
    return {r["i"]: (json.loads(r["tree"]) if r["tree"] else None, r["error"]) for r in xml_documents(rows).select("i", F.to_json("tree").alias("tree"), "error").collect()}


def test_xml_trees(spark):
    dc, rdf = "http://purl.org/dc/elements/1.1/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    got = _xml(
        spark,
        "<r><k>a</k><k> b </k><c d='1'><e>02</e></c></r>",
        "<r>mixed <b>bold</b> text</r>",
        f'<q:r xmlns:q="{dc}" q:a="5" b="6" xmlns:o="urn:other"><o:t>x</o:t><q:t/></q:r>',
        f'<r xmlns="{rdf}"><a>1</a><b xmlns="">2</b></r>',
        '<r k="0"><k a="1"><k>2</k></k><k>3</k></r>',
        "\ufeff <?xml version='1.0' encoding='latin-1'?><!-- c --><r>é&amp;&#65;&nbsp;<![CDATA[<z>]]></r>",
        "<a>" * 256 + "</a>" * 256,
        "<a>" * 257 + "</a>" * 257,
        "<r><k>a",
        "<a></b>",
        "words",
        "",
        None,
    )
    assert got[0] == ({"r": {"k": ["a", "b"], "c": {"d": "1", "e": "02"}}}, None)
    assert got[1][0] == {"r": {"b": "bold", "#text": "mixed  text"}}
    assert got[2][0] == {"dc:r": {"q": dc, "dc:a": "5", "b": "6", "o": "urn:other", "t": "x", "dc:t": ""}}
    assert got[3][0] == {"rdf:r": {"xmlns": rdf, "rdf:a": "1", "b": {"xmlns": "", "#text": "2"}}}
    assert got[4][0] == {"r": {"k": ["0", {"a": "1", "k": "2"}, "3"]}}
    assert got[5] == ({"r": "é&A&nbsp;<z>"}, None)
    assert got[6][1] is None and "256" in got[7][1]
    assert all(got[i][0] is None and got[i][1] for i in (7, 8, 9, 10, 12)) and got[11] == ({}, None)


def test_xml_fields(spark):
    rows = spark.createDataFrame([('<r><a>1</a><a>2</a><q"x> </q"x></r>',), ('<r a.b="v"><c> </c></r>',), (None,)], "content string")
    got = companion_fields_xml(rows, {"A": "a", "Dot": "a.b", "Quote": 'q"x', "C": "c", "Root": "$.r"}).collect()
    assert got[0]["fields"] is None and got[0]["error"]  # a quote can't be in a name
    assert [(f["name"], f["value"]) for f in got[1]["fields"]] == [("Dot", "v"), ("Root", '{"a.b":"v","c":""}')] and got[1]["error"] is None
    assert got[2]["fields"] is None and got[2]["error"] == "no content"


@pytest.mark.parametrize(
    "text, records",
    [
        ('k,n\n1,"a\nb"\n2,c', [["k", "n"], ["1", "a\nb"], ["2", "c"]]),
        ('a,"b""c",d"e\n', [["a", 'b"c', 'd"e']]),
        ('"x"y",z\n"open\nend', [['x"y', "z"], ["open\nend"]]),
        ('#c,"\n\na,\n"#q",1\r\n # kept\nlast\r', [["a", ""], ["#q", "1"], [" # kept"], ["last"]]),
        ('"a\r\nb"\n\n"b"', [["a\nb"], ["b"]]),
        ('"a""', [['a"']]),
        (",\n", [["", ""]]),
        ("", []),
        ("\n\n#only\n", []),
        ('"' + 'x""\n' * 50_000 + '",1', [['x"\n' * 50_000, "1"]]),
    ],
)
def test_csv_records(text, records):
    assert csv_records(text, ",", "#") == records
    assert csv_records(text.replace(",", ";"), ";", "#") == [[c.replace(",", ";") for c in r] for r in records]


@given(st.lists(st.lists(st.text(st.sampled_from('a," \n#é;')), min_size=1, max_size=4), max_size=5))
def test_csv_round_trip(rows):
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    assert csv_records("\n".join(",".join(map(quote, r)) for r in rows), ",", "#") == rows


def test_csv_fields(spark):
    rows = spark.createDataFrame([(1, "a,b,a\n1,2,3\n4\n"), (2, None), (3, "a\n"), (4, "")], "id int, content string")
    got = companion_fields_csv(rows, {"A": "a", "B": "b", "C": "c", "Second": 2}).collect()
    assert [(r["id"], r["record"], [(f["name"], f["value"]) for f in r["fields"]]) for r in got] == [(1, 1, [("A", "3"), ("B", "2"), ("Second", "2")]), (1, 2, [])]
    got = companion_fields_csv(rows, {"First": 1}, header=False).collect()
    assert [(r["id"], r["record"], r["fields"][0]["value"]) for r in got] == [(1, 1, "a"), (1, 2, "1"), (1, 3, "4"), (3, 1, "a")]


def test_user_functions(spark):
    rows = spark.createDataFrame([("c", "a", 2), ("c", "b", 0)], "channel_name string, path string, n int")

    def fn(row):
        return [{"name": "Half", "value": 4 / row["n"], "language": None}]

    got = {r["path"]: r for r in python_fields(rows, fn).collect()}
    assert got["a"]["fields"][0]["value"] == "2" and got["b"]["error"].startswith("ZeroDivisionError")
    good, failed = split_failed(python_fields(rows, fn))
    assert [r["path"] for r in good.collect()] == ["a"] and [r["path"] for r in failed.collect()] == ["b"]
    out = run_enrichers(rows, [Enrich(lambda df: python_fields(df, fn)), Enrich(lambda df: python_fields(df, lambda r: [{"name": "P", "value": r["path"]}]))])
    assert {r["path"]: [f["name"] for f in r["fields"]] for r in out.collect()} == {"a": ["Half", "P"], "b": ["P"]}


def _catalog(spark):
    fields = [(f"f{i}", n, t, i) for i, (n, t) in enumerate([("Caption", "SingleLineText"), ("Count", "Numeric"), ("Tags", "TextList"), ("Topics", "ClassificationList"), ("Color", "OptionList"), ("Links", "HyperlinkList"), ("Data", "Json"), ("caption ", "MultiLineText")])]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return C.Catalog(
        table(fields, "id string, name string, data_type string, ordinal int"),
        table([("f4", "o1", "Red"), ("f9", "o2", "Blue")], "field_id string, id string, name string"),
        table([("k1", "Topics/Sports/Football")], "id string, name_path string"),
        table([("l1", "en-US", "English"), ("l2", "fr-FR", "French")], "id string, culture string, name string"),
        table([("u1", "Ann", "ann@x.y")], "id string, name string, email string"),
        table([("g1", "Staff")], "id string, name string"),
    ).checked()


def _entries(spark, *rows):
    df = spark.createDataFrame([(r, i, n, v, lang) for i, (r, n, v, lang) in enumerate(rows)], "record string, pos int, name string, v string, language string")
    return df.select("record", "pos", "name", F.parse_json("v").alias("value"), "language")


def test_resolve_fields(spark):
    entries = _entries(
        spark, ("a", " caption", '"Hi"', "en-US"), ("a", "Caption", '"Salut"', "FR-fr"), ("a", "Count", "1234", None), ("a", "count", "3.14", None), ("a", "Tags", '["x","y"]', None),
        ("a", "Topics", '"topics > Sports > football"', None), ("a", "Color", '["red"]', None), ("a", "Links", '[{"url":"u"}]', None), ("a", "Data", '{"k":1}', None),
        ("b", "Nope", '"x"', None), ("c", "Color", '["blue"]', None), ("d", "Count", '["x"]', None), ("e", "Links", '"bare"', None), ("f", "Caption", None, None), ("g", "Caption", '"x"', "xx"),
        ("h", "Tags", "[1]", None), ("i", "Count", '"ok"', None), ("i", "Caption", "5", None), ("i", "Nope", '"x"', None),
    )
    got = {r["record"]: r for r in C.resolve_fields(entries, _catalog(spark), "en-US").collect()}
    fields = got["a"]["fields"]
    assert [f["field_id"] for f in fields] == ["f7", "f1", "f2", "f3", "f4", "f5", "f6"]
    assert [(x["language_id"], x["value"]) for x in fields[0]["localized"]] == [("l1", "Hi"), ("l2", "Salut")]
    assert [x["value"] for x in fields[1]["localized"]] == ["1234", "3.14"]
    assert [f["localized"][0]["values"] for f in fields[2:5]] == [["x", "y"], ["k1"], ["o1"]]
    assert fields[5]["localized"][0]["links"][0]["url"] == "u" and fields[6]["localized"][0]["value"] == '{"k":1}'
    parts = {"b": "unknown field", "c": 'unknown name "blue"', "d": "does not take", "e": "does not take", "f": "missing", "g": "unknown language", "h": "does not take", "i": 'field "Caption"'}
    assert all(parts[k] in got[k]["error"] and got[k]["fields"] is None for k in parts)
    assert "no default" in C.resolve_fields(_entries(spark, ("a", "Caption", '"x"', None)), _catalog(spark)).first()["error"]


def test_manifest(spark, tmp_path):
    lines = ['{"file":"a.jpg","fields":[{"name":"Caption","value":"x"}]}', "", '{"id":"R1","file":"b.jpg"}', '{"id":"R1","status":" Released "}', '{"id":"x","title":"oops"}', "[1]", "{broken",
             '{"id":"no/slash"}', '{"file":"missing.jpg"}', '{"id":"x","fields":[{"name":"C","val":1}]}', '{"id":"x","fields":[{"value":1}]}', '{"id":"R1"} tail', '{"fields":[]}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines) + "\n")
    manifest = M.read_manifest(spark, str(tmp_path / "m.jsonl"))
    entries = _paths(spark, "a.jpg", "b.jpg").withColumn("size", F.lit(1))
    got = {r["line"]: r for r in M.validate_manifest(manifest, entries).collect()}
    assert sorted(got) == [1, *range(3, 14)]
    assert {n: r["action"] for n, r in got.items() if r["error"] is None} == {1: "created", 3: "updated", 4: "metadata"}
    for n, part in ((5, "title"), (6, "not a JSON"), (7, "not a JSON"), (8, "malformed"), (9, "not found"), (10, '"val"'), (11, "no name"), (12, "not a JSON"), (13, "needs")):
        assert part in got[n]["error"], (n, got[n]["error"])
    usage = M.field_usage(manifest).first()
    assert usage["names"] == ["C", "Caption"] and not usage["uses_language"]


def test_numbers_across_files_and_blocks(spark, tmp_path):
    text = "".join(f'{{"id":"r{i}"}}\n' + ("\n" if i % 5 == 0 else "") for i in range(5000))
    (tmp_path / "m.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {r["line"]: r["raw"] for r in M.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: x for i, x in enumerate(text.split("\n"), 1) if x}


def test_ledger(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"line":1,"hash":"h1","action":"created","dest_id":"a"}\n{"line":2,"hash":"h2","action":"uploaded","token":"t1"}\n{"line":2,"hash":"h2","action":"uploaded","token":"t2"}\n'
                                      '{"line":3,"hash":"h3","action":"created","dest_id":"b"}\n{"action":"filed","filed":["a"]}\n{"line":4,"hash":"h4","action":"error","error":"x","warn":"w"}\n{"line":5,"ha')
    ledger = L.read_ledger(spark, str(tmp_path / "l.jsonl"))
    assert {(r["hash"], r["done"], r["token"]) for r in L.ledger_state(ledger).collect()} == {("h1", True, None), ("h2", False, "t2"), ("h3", True, None), ("h4", False, None)}
    assert [r["dest_id"] for r in L.unfiled(ledger).collect()] == ["b"]
    s = L.import_summary(ledger, 10).first()
    assert (s["created"], s["failed"], s["rewritten"], s["aborted"]) == (2, 1, 1, 7)
    lines = spark.createDataFrame([(1, "h1"), (2, "h2"), (2, "h2"), (9, "h9")], "line int, hash string")
    assert sorted((r["hash"], r["skipped"], r["token"]) for r in M.resume_manifest(lines, L.ledger_state(ledger)).na.fill("").collect()) == [("h1", True, ""), ("h2", False, "t2"), ("h2", False, "t2"), ("h9", False, "")]


def test_appends_to_a_ledger_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for run, n in enumerate((2, 500, 90, 3, 800)):  # larger and smaller files in turn
        rows = spark.range(n, numPartitions=2).selectExpr("'h' hash", "'uploaded' action", f"concat('{run}-', id) token")
        L.append_ledger(rows, path)
        ledger = L.read_ledger(spark, path)
        assert L.ledger_state(ledger).first()["token"] == f"{run}-{n - 1}"
    assert [r["token"] for r in ledger.orderBy("seq").collect()] == [f"{run}-{i}" for run, n in enumerate((2, 500, 90, 3, 800)) for i in range(n)]


def test_one_ledger_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("".join(f'{{"hash":"h","action":"uploaded","token":"{i}"}}\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        tokens = [r["token"] for r in L.read_ledger(spark, str(tmp_path / "l.jsonl")).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tokens == [str(i) for i in range(2000)]


def test_work(spark):
    schema = "id int, channel_name string, status string, attempts int, next_run_at timestamp, last_error string"
    rows = spark.createDataFrame([(1, "c", "pending", 0, T0, None), (2, "c", "running", 4, T0, None), (3, "d", "failed", 5, T0, "e"), (4, "c", "running", 0, T0, None)], schema)
    out = {r["id"]: r for r in work.apply_outcomes(rows, spark.createDataFrame([(1, False, "boom"), (2, False, "boom"), (4, True, None)], "id int, ok boolean, error string"), T0, jitter=0.0).collect()}
    assert sorted(out) == [1, 2, 3] and (out[1]["status"], out[1]["attempts"], out[2]["status"]) == ("pending", 1, "failed")
    assert out[1]["next_run_at"] == T0 + datetime.timedelta(seconds=2)
    with pytest.raises(ValueError):
        work.requeue(rows, T0)
    with pytest.raises(ValueError):
        work.requeue(rows, T0, id=9)
    assert {r["id"]: r["status"] for r in work.requeue(rows, T0, all=True).collect()}[3] == "pending"
    assert [r["n"] for r in work.counts_by_status(rows.limit(0)).collect()] == [0, 0, 0]


@pytest.mark.parametrize("size,count", [(0, 0), (-1, 0), (1, 1), (16 << 20, 1), ((16 << 20) + 1, 2), (48 << 20, 3)])
def test_block_plan(spark, size, count):
    plan = segment_plan(spark.createDataFrame([("f", size)], "path string, size long")).collect()
    assert len(plan) == count and sum(r["length"] for r in plan) == max(0, size)


def test_block_plan_beyond_the_cap(spark):
    r = segment_plan(spark.createDataFrame([("f", (16 << 20) * 50_000 + 1)], "path string, size long")).agg(F.count("*").alias("n"), F.max("length").alias("b"), F.sum("length").alias("s")).first()
    assert r["n"] <= 50_000 and r["b"] % (1 << 20) == 0 and r["s"] == (16 << 20) * 50_000 + 1


def test_local_listing_and_copy(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a").mkdir(parents=True)
    (root / "a/x.txt").write_text("hello")
    (root / "y.xmp").write_bytes(b"1234567")
    rows = {r["path"]: r for r in list_entries(spark, str(root)).collect()}
    assert set(rows) == {"a/x.txt", "y.xmp"} and rows["a/x.txt"]["size"] == 5 and rows["a/x.txt"]["hash"].startswith("5-")
    assert [r["path"] for r in list_entries(spark, str(root), "a").collect()] == ["a/x.txt"]
    assert list_entries(spark, str(root), "none").count() == 0
    assert bytes(read_companions(spark, str(root), _paths(spark, "y.xmp"), limit=3).first()["content"]) == b"123"
    copied = copy_assets(list_entries(spark, str(root)), f"file://{root}", f"file://{tmp_path}/out").collect()
    assert {r["path"]: r["bytes"] for r in copied} == {"a/x.txt": 5, "y.xmp": 7} and (tmp_path / "out/a/x.txt").read_text() == "hello"


def test_only_wanted_companions_are_opened(spark, tmp_path):
    """An unwanted file that Spark would refuse to load doesn't matter, and no more than the limit is read."""
    (tmp_path / "in/d").mkdir(parents=True)
    for name, size in (("small.xmp", 5), ("large.jpg", 5000)):
        (tmp_path / "in/d" / name).write_bytes(b"x" * size)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        wanted = spark.createDataFrame([("d/small.xmp", 1, 7), ("d/none.xmp", 2, 8), (None, 3, 9)], "path string, n int, content_type int")
        rows = read_companions(spark, str(tmp_path / "in"), wanted).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r["path"], r["n"], r["content_type"], bytes(r["content"])) for r in rows] == [("d/small.xmp", 1, 7, b"xxxxx")]


def test_copy_by_blocks(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    contents = {"d/a": bytes(range(256)) * 41, "d/b": b"", "c": b"y" * 100}
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    entries = spark.createDataFrame([("d/a", len(contents["d/a"])), ("d/b", 0), ("c", -1)], "path string, size long")
    for _ in range(2):  # again, over what is there
        rows = copy_assets(entries, f"file://{tmp_path}/in", f"file://{tmp_path}/out", block_size=1000).collect()
        assert {r["path"]: r["bytes"] for r in rows} == {k: len(v) for k, v in contents.items()}
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found == contents


def test_a_table_function_of_assets_and_companions(spark):
    def fn(asset, companions):
        if asset["n"] == 3:
            raise ValueError("no")
        shapes = {0: [], 1: [{"name": "a", "value": 2.0, "language": "en"}, {"name": "b", "value": [1.5, "x", {"k": True, "i": 3.0}]}, {"name": "c", "value": None}], 2: {"a": 1}, 4: [{"name": "a", "value": float("nan")}], 5: [{"name": "a", "value": len(companions)}, {"nome": "x"}], 6: None, 7: [{"name": "all", "value": [c["p"] for c in companions]}]}
        return shapes[asset["n"]]

    register_fields_function(spark, "odd_fields", fn)
    rows = spark.createDataFrame([(i, (i,), [("p", i), ("q", None)] if i != 6 else None) for i in range(8)], "i int, asset struct<n: int>, companions array<struct<p: string, n: int>>")
    got = [(r["i"], r["name"], r["v"], r["language"], r["error"]) for r in lateral_fields(rows, "odd_fields").select("i", "name", F.to_json("value").alias("v"), "language", "error").collect()]
    assert [x for x in got if x[0] == 1] == [(1, "a", "2", "en", None), (1, "b", '[1.5,"x",{"i":3,"k":true}]', None, None), (1, "c", "null", None, None)]
    assert sorted(x[0] for x in got) == [1, 1, 1, 2, 3, 4, 5, 7] and [x[2] for x in got if x[0] == 7] == ['["p","q"]']
    assert {x[0]: x[4].split(":")[0] for x in got if x[4]} == {2: "TypeError", 3: "ValueError", 4: "ValueError", 5: "TypeError"}
    with pytest.raises(Exception, match="array of structs"):
        lateral_fields(rows.withColumn("companions", F.lit("x")), "odd_fields").collect()


def test_a_ledger_is_measured_while_it_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "h", "created", 10), (2, "i", "error", 5), (3, "j", "uploaded", 7)], "line long, hash string, action string, size long")
    got = L.append_measured(rows, str(tmp_path / "l"), total=5, size="size")
    assert (got["created"], got["failed"], got["aborted"], got["rows"], got["bytes"]) == (1, 1, 3, 3, 22) and got["records_per_second"] > 0
    assert L.read_ledger(spark, str(tmp_path / "l")).count() == 3


def test_copies_of_files_that_are_not_as_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("short", 9000), ("long", 30_000), ("right", 20_000), ("any", 77)):
        (tmp_path / "in" / name).write_bytes(bytes(i % 251 for i in range(size)))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/short").write_text("before")
    entries = spark.createDataFrame([(n, 20_000) for n in ("short", "long", "right", "gone")] + [("any", -1)], "path string, size long")
    with pytest.raises(Exception, match="listed with 20000 bytes"):
        copy_assets(entries.filter("path = 'short'"), f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    rows = {r["path"]: r for r in copy_assets(entries, f"file://{tmp_path}/in", f"file://{tmp_path}/out", block_size=1000, errors="rows").collect()}
    assert {p: r["bytes"] for p, r in rows.items()} == {"short": 0, "long": 0, "gone": 0, "right": 20_000, "any": 77}
    assert {p for p, r in rows.items() if r["error"]} == {"short", "long", "gone"} and "has 9000" in rows["short"]["error"]
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_copy-")} == {"short", "right", "any"}
    assert (tmp_path / "out/short").read_text() == "before" and (tmp_path / "out/right").read_bytes() == (tmp_path / "in/right").read_bytes()


def _texts(spark, n):
    rows = spark.range(n).selectExpr("concat('d', id, '/f.txt') as path", "id").repartition(4, "path").sortWithinPartitions("path")
    return rows.selectExpr("path", "explode(array(concat('a', id), null, 'b')) as c").select("path", F.coalesce("c", F.lit("-")).alias("content"))


def test_written_files_hold_their_rows_in_order(spark, tmp_path):
    for _ in range(2):  # a repeated write leaves the same files
        write_files(_texts(spark, 50), str(tmp_path))
    files = {p.relative_to(tmp_path).as_posix(): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert files == {f"d{i}/f.txt": f"a{i}-b" for i in range(50)}


def test_many_small_files_are_read_by_several_tasks(spark, tmp_path):
    """Their names are a few kilobytes, which adaptive execution would put into one task."""
    write_files(_texts(spark, 400), f"{tmp_path}/in")
    names = walk_entries(spark, f"{tmp_path}/in").select("path")
    rows = read_companions(spark, f"{tmp_path}/in", names).select("path", "content", F.spark_partition_id().alias("task")).collect()
    assert {(r["path"], bytes(r["content"])) for r in rows} == {(f"d{i}/f.txt", f"a{i}-b".encode()) for i in range(400)}
    assert len({r["task"] for r in rows}) > 4


def test_many_small_files_are_copied_by_several_tasks(spark, tmp_path):
    write_files(_texts(spark, 400), f"{tmp_path}/in")
    done = copy_assets(walk_entries(spark, f"{tmp_path}/in"), f"file://{tmp_path}/in", f"file://{tmp_path}/out", block_size=2)
    rows = done.withColumn("task", F.spark_partition_id()).collect()
    assert {r["path"]: r["bytes"] for r in rows} == {f"d{i}/f.txt": len(f"a{i}-b") for i in range(400)} and len({r["task"] for r in rows}) > 4
    assert all((tmp_path / f"out/d{i}/f.txt").read_text() == f"a{i}-b" for i in range(400))


def test_a_listing_is_spark_s_but_not_in_splits_of_few_files(spark, tmp_path):
    root = tmp_path / "a b%20c"
    write_files(_texts(spark, 400), f"file://{quote(str(root))}")
    for name in ("_hidden/x", ".hidden/x", "_k=1/x", "_SUCCESS", ".f.crc", "y._COPYING_", "_metadata/x", "empty", "full"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if name == "empty" else name)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/z").write_text("zz")
    (root / "link").symlink_to(tmp_path / "other")
    (root / "linked").symlink_to(tmp_path / "other/z")
    (root / "broken").symlink_to(tmp_path / "nothing")
    for prefix in ("", "d7", "link", "full", "none"):
        where = root / prefix
        spark_s = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{where}") if where.exists() else spark.createDataFrame([], "path string, length long, modificationTime timestamp")
        want = sorted((r["path"].removeprefix(f"file:{root}/"), r["length"], r["modificationTime"]) for r in spark_s.select("path", "length", "modificationTime").collect())
        got = list_entries(spark, str(root), prefix)
        assert sorted((r["path"], r["size"], r["mtime"]) for r in got.collect()) == want and (len(want) > 0) == (prefix != "none")
    assert list_entries(spark, str(root)).rdd.getNumPartitions() < 10


def test_a_walk_by_tasks(spark, tmp_path):
    """Many folders, a deep one, links round in circles, and ignored folders that can't even be entered."""
    files = {f"a{i % 5}/b{i % 11}/f{i}": i % 13 for i in range(400)} | {"/".join(["deep"] * 40) + "/x": 1, "top.txt": 3, "skip/d/x": 1}
    for name, size in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "a0/loop").symlink_to(tmp_path)
    (tmp_path / "link").symlink_to(tmp_path / "top.txt")
    listed = {r["path"]: r["size"] for r in list_entries(spark, str(tmp_path), "a1").collect()}
    for budget in (20, 10**6):
        rows = walk_entries(spark, str(tmp_path), budget=budget).collect()
        assert {r["path"]: r["size"] for r in rows} == files and len(rows) == len(files)
        assert all(r["hash"] == f"{r['size']}-{int(r['mtime'].timestamp() * 1_000_000)}" for r in rows[:1]) or rows[0]["hash"].startswith(f"{rows[0]['size']}-")
        assert {r["path"]: r["size"] for r in walk_entries(spark, str(tmp_path), "a1", budget=budget).filter("size > 0").collect()} == listed
    kept = {r["path"] for r in walk_entries(spark, f"file://{tmp_path}", ignore=["skip/", "f?"]).collect()}
    assert kept == {p for p in files if not p.startswith("skip/") and not re.search(r"/f.$", p)}
    assert walk_entries(spark, str(tmp_path), "none").count() == 0


def test_a_scope_compared_and_merged_in_parts(spark, tmp_path, monkeypatch):
    """Changes as large as the base make a new base; parts of some buckets give what the whole gives; no shuffle files stay."""
    monkeypatch.setattr(BucketStore, "part_bytes", 20_000)
    monkeypatch.setattr(D, "GROWN", 1)
    schema = "path string, size long, mtime timestamp, hash string"
    now = F.lit(datetime.datetime(2024, 1, 1))
    made = lambda low, high, size: spark.range(low, high).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(size).cast("long").alias("size"), now.alias("mtime"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    wholes = [(0, 3000, 1), (0, 3000, 2), (1000, 4000, 2), (1000, 1000, 2), (0, 500, 3)]
    seen = {}
    for generation, whole in enumerate(wholes, 1):
        state = D.SnapshotState(spark, str(tmp_path), "s", schema)
        pieces, changed = state.stage(made(*whole))
        wanted = {f"p{i}": whole[2] for i in range(*whole[:2])}
        got = {r["path"]: (r["size"], r["_deleted"], r["_was"]) for r in changed.collect()}
        assert got == {p: (n, False, p in seen) for p, n in wanted.items() if seen.get(p) != n} | {p: (n, True, True) for p, n in seen.items() if p not in wanted}
        assert state.commit(pieces) == generation
        for back, rows in ((generation, wanted), (generation - 1, seen)):
            if back:
                assert {r["path"]: r["size"] for r in load_snapshot(spark, str(tmp_path), "s", schema, back).collect()} == rows
        seen = wanted
        if generation == 2:  # all rows have changed: a base, and no changes beside it
            assert {len(names) for names in state.store.pieces("state").values()} == {1}
    assert len(list((tmp_path / "scope=s/state").iterdir())) < 200 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_a_plan_rewrites_the_buckets_of_its_records(spark, tmp_path):
    ids = [f"r{i}" for i in range(200)]
    old = spark.createDataFrame([(i, "draft", T0) for i in ids], TABLES["records"])
    files = spark.createDataFrame([(i, f"f-{i}", True) for i in ids], TABLES["files"])
    versions = spark.createDataFrame([(i, f"f-{i}", 1, "old", "h", 1) for i in ids], TABLES["versions"])
    fields = spark.createDataFrame([(i, "t", [("l", "old")]) for i in ids], TABLES["fields"])
    store = RecordStore(spark, str(tmp_path))
    store.put(Records(old, files, versions, fields))
    before = store.store.pieces("fields")
    plan = spark.createDataFrame([(1, "r5", "p", "h2", 9, "released", [("t", [("l", "new")])]), (2, None, "q", "h", 3, None, None)], "plan_id long, dest_id string, path string, hash string, size long, status string, fields array<struct<field_id: string, localized: array<struct<language_id: string, value: string>>>>")
    met = RecordStore(spark, str(tmp_path)).apply(plan, T0)
    now = RecordStore(spark, str(tmp_path))
    assert len(met) <= 2 and {b for b, p in now.store.pieces("fields").items() if p != before.get(b)} <= set(met)
    assert len(now.read(met).records.inputFiles()) <= 2 < len(now.read().records.inputFiles())
    whole = apply_plan(plan, Records(old, files, versions, fields), T0)
    for table in TABLES:
        a, b = getattr(now.read(), table), getattr(whole, table)
        assert sorted(map(str, (tuple(r) for r in a.select(*b.columns).collect()))) == sorted(map(str, (tuple(r) for r in b.collect())))


def test_runs_of_a_ledger_are_numbered_without_reading_it(spark, tmp_path):
    path = str(tmp_path / "l")
    rows = spark.createDataFrame([(1, "h", "created")], "line long, hash string, action string")
    for _ in range(2):
        L.append_ledger(rows, path)
    (tmp_path / "l/part-torn.json").write_text('{"run": 7')
    L.append_ledger(rows, path)
    assert sorted(r["seq"]["run"] for r in L.read_ledger(spark, path).collect()) == [1, 2, 3]
    (tmp_path / "l/_run").unlink()
    (tmp_path / "l/._run.crc").unlink()
    L.append_ledger(rows, path)
    assert L.read_ledger(spark, path).agg(F.max("seq.run")).first()[0] == 4


def test_ema_of_a_run_on_many_tasks(spark):
    rows = [(k, t, float((t * 7 + k) % 11)) for k in range(3) for t in range(500 if k == 0 else 3)] + [(0, None, 5.0), (1, 9, None)]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(5)
    got = {r["k"]: r["ema"] for r in ema(df, "v", "t", "k").collect()}
    for k in range(3):
        value = None
        for _, _, v in sorted(r for r in rows if r[0] == k and None not in r):
            value = v if value is None else 0.3 * v + 0.7 * value
        assert abs(got[k] - value) < 1e-9


def test_generations_that_are_gone_are_an_error(spark, tmp_path):
    for n in range(1, 6):
        commit_snapshot(spark.range(n).selectExpr("cast(id as string) as path"), str(tmp_path), "s")
    assert D.generations(spark, str(tmp_path), "s") == [4, 5]
    assert [load_snapshot(spark, str(tmp_path), "s", "path string", g).count() for g in (4, 5, None)] == [4, 5, 5]
    for g in (1, 3, 6):
        with pytest.raises(ValueError, match="isn't kept"):
            load_snapshot(spark, str(tmp_path), "s", "path string", g)


def _bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_scan_writes_what_changed(spark, tmp_path):
    """Against a plain dict, over many scans; the bytes of a scan follow its changes and not the listing."""
    rng, now = random.Random(5), {f"d{i % 7}/f{i}": 1 for i in range(3000)}
    state = D.SnapshotState(spark, str(tmp_path), "s", "path string, size long, mtime timestamp, hash string")
    listing = lambda rows: spark.createDataFrame([(p, v, T0, f"h{v}") for p, v in rows.items()], "path string, size long, mtime timestamp, hash string")
    state.commit(state.stage(listing(now))[0])
    whole = _bytes(tmp_path)
    for scan in range(16):
        before, new = dict(now), {f"n{scan}-{i}": 1 for i in range(3)}
        for p in rng.sample(sorted(now), 4):
            now[p] += 1
        for p in rng.sample(sorted(now), 3):
            del now[p]
        now |= new | ({"d0/f0": 9} if scan % 2 else {})
        pieces, changes = state.stage(listing(now))
        got = {r["path"]: "deleted" if r["_deleted"] else "modified" if r["_was"] else "new" for r in changes.collect()}
        expected = {p: "new" if p not in before else "deleted" if p not in now else "modified" for p in before.keys() | now.keys() if before.get(p) != now.get(p)}
        assert got == expected
        written = _bytes(tmp_path / "scope=s/state" / pieces.name)
        assert written < whole / 3  # a dozen rows in as many files; the listing has 3,000
        assert state.commit(pieces) == scan + 2
        assert {r["path"]: r["size"] for r in state.load().collect()} == now
        assert {r["path"]: r["size"] for r in state.load(scan + 1).collect()} == before
    assert max(len(p) for p in state.store.pieces("state").values()) <= D.DELTAS
    names = {n for v in state.store.kept["versions"] for own in v["tables"].values() for pieces in own.values() for n in pieces}
    assert {p.name for p in (tmp_path / "scope=s/state").iterdir()} == names  # nothing else is left


def test_one_writer_at_a_time_and_failed_reads(spark, tmp_path):
    a, b = (BucketStore(spark, str(tmp_path), {"t": "id"}) for _ in range(2))
    rows = spark.createDataFrame([("x",), (None,)], "id string")
    a.commit(a.stage("t", rows))
    with pytest.raises(RuntimeError, match="another writer"):
        b.commit(b.stage("t", rows))
    assert BucketStore(spark, str(tmp_path), {"t": "id"}).read("t", "id string").count() == 2
    (tmp_path / "pointer.json").write_text("{")  # damaged: an error, and not an empty state that the next commit would overwrite
    with pytest.raises(Exception, match="Checksum|Expecting"):
        BucketStore(spark, str(tmp_path), {"t": "id"})



def test_redacted_addresses(spark):
    texts = ["see https://h/a?b=c, and 'http://x/y?z' or (https://h?u=https://k?v) http://?q end?x", "https://h/p", "", "a\n\thttp://h/?\nb"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(P.redact_urls("t").alias("t")).collect()
    assert [r["t"] for r in rows] == [
        "see https://h/a?<redacted> and 'http://x/y?<redacted>' or (https://h?<redacted> http://?q end?x", "https://h/p", "", "a\n\thttp://h/?<redacted>\nb", None
    ]
