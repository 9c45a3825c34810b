import random
import re
from collections import defaultdict

import pytest

from syncplan.llm.substring_dedup import REACH, WINDOW, repeated_spans, without_repeats


def _planted(seed):
    """Clean documents; passages of 51 to 120 words, planted at any word of two to five of them, the first first."""
    rng = random.Random(seed)
    vocabulary = [f"wörd{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 150
    ends = [" "] * 20 + ["\n"]  # a passage keeps its own line ends
    words_of = lambda k: [w + rng.choice(ends) for w in rng.choices(vocabulary, k=k)]
    docs = [[words_of(rng.randrange(60, 400))] for _ in range(60)]
    planted = {}
    for p in range(10):
        passage = words_of(rng.randrange(51, 120))
        held = sorted(rng.sample(range(40), rng.randrange(2, 6)))
        for d in held:
            words = docs[d][0]
            at = rng.randrange(len(words))
            words[at:at] = passage
        planted[p] = held
    texts = ["".join(words).replace(" ", rng.choice([" ", "  "])) for (words,) in docs]
    later = {d for held in planted.values() for d in held[1:]}
    return list(enumerate(texts)), later


def test_planted_passages(spark):
    docs, later = _planted(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = repeated_spans(df, min_line_words=25).collect()
    found = {r["doc_id"] for r in rows}
    assert found == later
    texts = dict(docs)
    earlier = {d: " ".join(t.split()) for d, t in docs}
    for r in rows:
        span = " ".join(texts[r["doc_id"]][r["start"] : r["end"]].split())
        assert len(span.split()) == r["n_words"] and r["first_doc_id"] < r["doc_id"]
        assert span in earlier[r["first_doc_id"]]


def test_lines_offsets_and_odd_rows(spark):
    line = " ".join(f"x{i}" for i in range(40))
    rows = [(1, f"a é\n{line}\nz"), (2, f"{line.upper()}\nother words here"), (3, None), (4, ""), (5, f"q {line}"), (5, f"q {line}"), (None, line),
            (7, "short line\nno\nSHORT  line\n"), (8, "a é\nshort line é")]
    df = spark.createDataFrame([(d, t, 0, 7, "r") for d, t in rows], "doc_id long, text string, start long, k1 long, removed string")
    got = {r["doc_id"]: r for r in repeated_spans(df).collect()}
    assert set(got) == {2, 5, 7, 8, None}
    assert (got[2]["start"], got[2]["end"], got[2]["n_words"], got[2]["first_doc_id"]) == (0, len(line), 40, 1)
    assert (got[7]["start"], got[7]["end"], got[7]["first_doc_id"]) == (14, 25, 7) and got[8]["end"] == 3
    cut = {r["doc_id"]: r for r in without_repeats(df).collect()}
    assert cut[1]["text"] == rows[0][1] and cut[1]["removed_"] is None and cut[2]["text"] == "\nother words here"
    assert cut[None]["text"] == "" and [tuple(x) for x in cut[None]["removed_"]] == [(0, len(line))]
    assert cut[7]["text"] == "short line\nno\n\n" and {(r["k1"], r["removed"], r["start"]) for r in cut.values()} == {(7, "r", 0)}
    assert without_repeats(df).count() == len(rows) and repeated_spans(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in repeated_spans(df, min_line_words=25).collect()} == {2, 5, None}


def test_one_word_over_and_over(spark):
    df = spark.createDataFrame([(1, "of " * 80), (2, "some words " + "of " * 60 + "then others"), (3, "x" * 300_000 + " of")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_words"] for r in repeated_spans(df).collect()}
    assert set(got) == {1, 2} and got[1] >= 40 and got[2] >= 45


def test_several_sources_are_several_rows(spark):
    """Lines put together from other documents: each row has the one document that holds its words."""
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(6)]
    docs = [(i, f"{line}\nown {i}") for i, line in enumerate(lines)] + [(9, "\n".join(lines))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r["first_doc_id"], r["n_words"]) for r in repeated_spans(df).collect()) == [(i, 12) for i in range(6)]
    assert repeated_spans(df, min_line_words=13).count() == 0  # no 16 words in a row are in one document


def test_short_lines_go_with_a_neighbour(spark):
    """A licence that many hold stays; in a passage that goes, or beside one, it goes too, on either side and in a row."""
    long = " ".join(f"p{i}" for i in range(30))
    texts = ["all rights\nmy own", f"head\nof note\n{long}\nall rights\nsee below", "all rights\nother", f"x y\n\nhead\nof note\n{long.upper()}\nall rights\nsee below\nz", f"see below\nw\n{long}\n\n\nall rights"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in without_repeats(df, min_line_words=WINDOW).collect()}
    assert [cut[i] for i in range(3)] == texts[:3]
    assert cut[3].split() == ["x", "y", "z"] and cut[4].split() == ["see", "below", "w"]
    everything = {r["doc_id"]: r["text"].split() for r in without_repeats(df).collect()}
    assert everything[2] == ["other"] and everything[4] == ["w"] and everything[1] == ["head", "of", "note", *long.split(), "see", "below"]


def test_paragraphs_of_short_lines(spark):
    """Six lines of three words: no line is long, and the whole paragraph goes, its ends too."""
    paragraph = "\n".join(f"a{i} b{i} c{i}" for i in range(6))
    df = spark.createDataFrame([(1, f"one two\n\n{paragraph}\n\nend"), (2, f"other {1}\n \n{paragraph.replace(' ', '  ')}\n\nmore")], "doc_id long, text string")
    rows = repeated_spans(df, min_line_words=WINDOW).collect()
    assert [(r["doc_id"], r["n_words"], r["first_doc_id"]) for r in rows] == [(2, 18, 1)]


@pytest.mark.parametrize("size, least", [(10, 0.0), (16, 0.05), (20, 0.3), (25, 1.0), (30, 1.0), (36, 1.0)])
def test_recall_of_passages_amid_lines(spark, size, least):
    """200 passages that stand amid the lines of two documents each, by length; from 25 words on all are met."""
    rng = random.Random(size)
    some = lambda k: " ".join(f"w{rng.randrange(10**7)}" for _ in range(k))
    passages = [some(size) for _ in range(200)]
    docs = [(i, f"{some(20)} {p} {some(20)}") for i, p in enumerate(passages)] + [(1000 + i, f"{some(9)} {p} {some(33)}") for i, p in enumerate(passages)]
    found = repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), min_line_words=WINDOW).collect()
    assert {r["first_doc_id"] for r in found} == {r["doc_id"] - 1000 for r in found}
    assert len(found) >= least * 200 and (size >= WINDOW or not found)


def test_columns_of_any_name(spark):
    line = " ".join(f"x{i}" for i in range(20))
    df = spark.createDataFrame([(1, line, "A", 1, 2), (2, line, "B", 3, 4)], "doc_id long, text string, `a.b` string, TEXT int, `k``1` int")
    out = without_repeats(df)
    assert out.columns == [*df.columns, "removed"]
    assert sorted(tuple(r)[:5] for r in out.collect()) == [(1, line, "A", 1, 2), (2, "", "B", 3, 4)]


@pytest.mark.parametrize("least", [1, WINDOW])
def test_whole_table_against_brute_force(spark, sf_dir, least):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    spans = defaultdict(list)
    for r in repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_line_words=least).collect():
        spans[r["doc_id"]].append(r)
    places = {r["doc_id"]: [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"] or "")] for r in rows}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r["doc_id"]: [(r["text"] or "")[a:b].translate(lower) for a, b in places[r["doc_id"]]] for r in rows}
    lines, first_line, first_gram, paragraphs, first_paragraph = {}, {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        doc, at, own, begin = r["doc_id"], 0, [], 0
        paragraphs[doc] = []
        for line in (r["text"] or "").split("\n"):
            k = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if k:
                own.append((at, at + k))
                first_line.setdefault(tuple(words[doc][at : at + k]), (doc, at))
            if not k and at > begin:
                paragraphs[doc].append((begin, at))
                begin = at
            at += k
        if at > begin:
            paragraphs[doc].append((begin, at))
        for x, y in paragraphs[doc]:
            first_paragraph.setdefault(tuple(words[doc][x:y]), (doc, x))
        lines[doc] = own
        for i in range(len(words[doc]) - WINDOW + 1):
            first_gram.setdefault(tuple(words[doc][i : i + WINDOW]), (doc, i))
    n_found = 0
    for doc, own in words.items():
        starts, ends = {a: i for i, (a, _) in enumerate(places[doc])}, {b: i + 1 for i, (_, b) in enumerate(places[doc])}
        covered = set()
        for s in spans[doc]:
            a, b = starts[s["start"]], ends[s["end"]]
            assert b - a == s["n_words"]
            sound = set()  # words of whole lines, paragraphs or WINDOW in a row that the named document holds first
            for x, y in lines[doc]:
                if a <= x and y <= b and first_line[tuple(own[x:y])][0] == s["first_doc_id"] and first_line[tuple(own[x:y])] != (doc, x):
                    sound.update(range(x, y))
            for x, y in paragraphs[doc]:
                if a <= x and y <= b and first_paragraph[tuple(own[x:y])][0] == s["first_doc_id"] and first_paragraph[tuple(own[x:y])] != (doc, x):
                    sound.update(range(x, y))
            for i in range(a, b - WINDOW + 1):
                if first_gram[tuple(own[i : i + WINDOW])][0] == s["first_doc_id"] and first_gram[tuple(own[i : i + WINDOW])] != (doc, i):
                    sound.update(range(i, i + WINDOW))
            assert sound == set(range(a, b))
            covered |= sound
            n_found += 1
        for kind, first in ((lines[doc], first_line), (paragraphs[doc], first_paragraph)):
            for x, y in kind:
                if y - x >= least and first[tuple(own[x:y])] != (doc, x):
                    assert covered >= set(range(x, y))
        for i in range(len(own) - WINDOW - REACH + 1):
            grams = [first_gram[tuple(own[j : j + WINDOW])] for j in range(i, i + REACH)]
            if grams[0][0] < doc and all(g == (grams[0][0], grams[0][1] + k) for k, g in enumerate(grams)):  # a passage of 25 words there
                assert covered >= set(range(i + REACH - 1, i + WINDOW))
    assert n_found > 20
