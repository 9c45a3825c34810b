import random

from pyspark.sql import functions as F

from syncplan.llm.decontaminate import brute_force, decontaminate, drop_contaminated


def _rows(df):
    out = df.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256), "contaminated",
    )
    return sorted((tuple(r) for r in out.collect()), key=str)


def _cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "e1", "Ff"] + [f"w{i}" for i in range(60)]
    items = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 9, 10, 11, 25])))) for i in range(40)]
    items += [(40, items[3][1].upper()), (41, None), (42, "..."), (43, "w1 " * 30)]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[: rng.randrange(len(own) + 1)] if rng.random() < 0.3 else own
        docs.append((i, rng.choice([" ", "\n", "; "]).join(words)))
    return docs + [(100, None), (101, ""), (102, "w1 " * 50)], items


def test_against_brute_force_in_one_and_many_blocks(spark):
    for seed, block in ((1, 10**6), (2, 60)):
        docs, items = _cases(seed)
        df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int")
        benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
        assert _rows(decontaminate(df, benchmark, block_words=block)) == sorted(brute_force(docs, items), key=str)


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, f"x {passage} y"), (1, f"x {passage} y"), (None, passage.upper()), (3, passage.replace("ten", "tens")), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passage), (7, passage + " more")], "item_id long, text string")
    for block in (10**6, 1):
        got = sorted(((r["doc_id"], r["n_hit"], r["items"]) for r in decontaminate(df, benchmark, block_words=block).collect()), key=str)
        assert got == sorted([(1, 10, [7]), (1, 10, [7]), (None, 10, [7]), (3, 0, []), (4, 0, [])], key=str)
    assert sorted(r["doc_id"] for r in drop_contaminated(df, benchmark).collect()) == [3, 4]
    assert decontaminate(df, benchmark.limit(0)).filter("contaminated").count() == 0 and decontaminate(df.limit(0), benchmark).count() == 0


def test_clean_documents_keep_columns_of_any_name(spark):
    passage = " ".join(f"b{i}" for i in range(12))
    rows = [(1, f"a {passage} z", 5, "i"), (2, "clean", 6, None), (2, "clean", 6, None), (None, None, 7, "j"), (2, f"x {passage}", 8, "k"), (3, "long " * 200_000, 9, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 long, items string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = sorted((tuple(r) for r in drop_contaminated(df, items).collect()), key=str)
    assert out == sorted([rows[1], rows[2], rows[3], rows[5]], key=str)
