from syncplan.llm.quality_rules import keep_good, measure, quality_rules


def test_measures():
    n, chars, symbols, dup, repeat, lines = measure("a b c\nA  b c\n\na b c\n#x a\x0bb")
    assert (n, chars, symbols, dup) == (12, 13, 1, 1)
    assert repeat == 6  # "a b c" twice; windows over line ends count too, but none of those repeats
    assert len(lines) == 2 and sum(x for _, x in lines) == 12
    assert measure(None) == (0, 0, 0, 0, 0, []) and measure("a b a b a")[4] == 5


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", h, len(t or ""), 0) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int")


def _text(i, k=60):
    return " ".join(f"w{i}x{j}" for j in range(k))


def test_lines_above_the_limit(spark):
    rows = [(i, f"Same  LINE here.\n{_text(i)}", "h") for i in range(40)] + [(100 + i, f"same line here.\n{_text(i)}", "g") for i in range(5)]
    rows += [(200, "\n".join(["same line here."] * 20) + "\n" + _text(200, 20), "h"), (201, "same line here.\n" * 5, "h")]
    got = {r["doc_id"]: r for r in quality_rules(_docs(spark, rows)).collect()}
    assert got[0]["removed_words"] == 3 and got[0]["kept"] and got[100]["removed_words"] == 0
    assert got[200]["removed_words"] == 60 and not got[200]["kept"] and got[201]["base_failed"]
    out = {r["doc_id"]: r for r in keep_good(_docs(spark, rows)).collect()}
    assert set(out) == {*range(40), *range(100, 105)}
    assert out[3]["text"] == _text(3) and out[3]["n_chars"] == len(_text(3)) and out[101]["text"].startswith("same line")


def test_copies_count_once(spark):
    rows = [(i, f"one line\n{_text(1)}", "h") for i in range(50)]
    assert all(r["kept"] and r["removed_words"] == 0 for r in quality_rules(_docs(spark, rows)).collect())


def test_odd_rows(spark):
    rows = [(1, None, "h"), (2, "", None), (None, _text(5), None), (4, _text(5), None), (4, _text(5), None), (6, " \t\n" * 9, "h")]
    got = sorted(((r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules(_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 0, False), (2, 0, False), (None, 60, True), (4, 60, True), (4, 60, True), (6, 0, False)], key=str)
    assert quality_rules(_docs(spark, rows).limit(0)).count() == 0


def test_kept_documents_keep_columns_of_any_name(spark):
    line = "one line that every document of the host holds and more words"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{line}\n{own(i)}", "h", 111, "r", [i], i, None) for i in range(60)] + [(None, "few words", "h", 1, "r", [1], 1, 1)]
    rows += [rows[0], (2**60 + 1, own(99), None, 111, None, None, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 int, removed_lines string, lines array<int>, host int, kept int")
    out = sorted((tuple(r) for r in keep_good(df).collect()), key=str)
    expected = [(i, own(i), *rest) for i, _, *rest in (r for r in rows if r[0] is not None and r[0] < 100)] + [rows[-1]]
    assert out == sorted(((a, b, c, d, e, list(f) if f is not None else None, g, h) for a, b, c, d, e, f, g, h in expected), key=str)
