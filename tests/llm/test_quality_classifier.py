import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from syncplan.llm.quality_classifier import _sample, classify


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    out = classify(docs, labels, labelled=~held)
    assert out.count() == docs.count()
    rows = out.join(labels.filter(held), "doc_id").select("kept", labels["quality"].alias("label")).collect()
    good = [r["kept"] for r in rows if r["label"] == 1]
    bad = [not r["kept"] for r in rows if r["label"] == 0]
    assert len(rows) > 500 and sum(good) > 0.98 * len(good) and sum(bad) > 0.9 * len(bad)


def test_sparse_paths_shrink(spark):
    rows = [(i, "Some plain words stand here. They go on for a while.", "big", "en") for i in range(60)]
    rows += [(100 + i, "WORD!! " * 60, "bad", "en") for i in range(60)] + [(200, "WORD!! " * 60, "lone", "en"), (201, None, None, None)]
    rows += [(200, "WORD!! " * 60, "lone", "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, lang string, evidence double")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(50)] + [(None, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    out = classify(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[0]["kept"] and not by[100]["kept"] and by[100]["path_quality"] < by[200]["path_quality"] < by[0]["path_quality"]


def _posteriors(rows):
    """Host and path quality of each (host, section, evidence), straight from the definitions."""
    n, total = len(rows), sum(e for *_, e in rows)
    by_path, by_host = defaultdict(list), defaultdict(list)
    for h, s, e in rows:
        by_path[h, s].append(e)
        by_host[h].append(e)
    mean_of = lambda xs: sum(xs) / len(xs)
    within = sum((e - mean_of(xs)) ** 2 for xs in by_path.values() for e in xs) / (n - len(by_path))
    mixed = sum(len(xs) ** 2 / len(by_host[h]) for (h, _), xs in by_path.items())
    spread = sum(len(xs) * (mean_of(xs) - mean_of(by_host[h])) ** 2 for (h, _), xs in by_path.items())
    path = max(0, (spread - (len(by_path) - len(by_host)) * within) / (n - mixed))
    spread = sum(len(xs) * (mean_of(xs) - total / n) ** 2 for xs in by_host.values())
    path_nn = sum(len(xs) ** 2 for xs in by_path.values()) / n
    host = max(0, (spread - (len(by_host) - 1) * within - path * (mixed - path_nn)) / (n - sum(len(x) ** 2 for x in by_host.values()) / n))
    out = []
    for i, (h, s, _) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != i]
        at_host = [e for h2, _, e in others if h2 == h]
        at_path = [e for h2, s2, e in others if (h2, s2) == (h, s)]
        q = total / n
        if at_host:
            sizes = Counter(s2 for h2, s2, _ in others if h2 == h)
            error = within / len(at_host) + path * sum(c * c for c in sizes.values()) / len(at_host) ** 2
            q += host / (host + error) * (mean_of(at_host) - q)
        p = q
        if at_path and path:
            p += path / (path + within / len(at_path)) * (mean_of(at_path) - q)
        out.append((q, p))
    return out


def test_both_levels_against_brute_force(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(120):
        host, section = rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])
        bad = rng.random() < {"a": 0.1, "b": 0.8, "c": 0.4, None: 0.5}[host] + (0.15 if section == "x" else -0.1)
        words = rng.choices(["plain", "words", "stand", "here."], k=40) if not bad else rng.choices(["$$$", "BUY!!", "now|", "w"], k=40)
        docs.append((i, " ".join(words + rng.choices(["plain", "$$$", "other"], k=rng.randrange(30))), host, section))
        labels.append((i, int(not bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    out = sorted(classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect(), key=lambda r: r["doc_id"])
    expected = _posteriors([(h, s, r["evidence"]) for (_, _, h, s), r in zip(docs, out, strict=True)])
    for r, (host, path) in zip(out, expected, strict=True):
        assert abs(r["host_quality"] - host) < 1e-9 and abs(r["path_quality"] - path) < 1e-9
        mean = sum(x["evidence"] for x in out) / len(out)
        odds = r["evidence"] / (1 - r["evidence"]) * path / (1 - path) / (mean / (1 - mean))
        assert abs(r["quality"] - odds / (1 + odds)) < 1e-9 and r["kept"] == (r["quality"] >= 0.5)


def test_sample_is_bounded_and_ties_and_long_texts(spark):
    docs = [(i, "word " * (i % 7 + 1), "h", "en") for i in range(300)] + [(7, "long " * 200_000, "h", "en"), (None, None, "h", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0)], "doc_id long, quality int")
    x, y = _sample(df.select("doc_id", "text"), labels, 40)
    assert 20 < len(x) == len(y) <= 40
    out = classify(df, labels, sample_rows=40).collect()
    assert len(out) == len(docs)
    half = classify(df.limit(3), labels.limit(0)).collect()  # no labels: evidence and quality are one half, which is kept
    assert {(r["evidence"], r["kept"]) for r in half} == {(0.5, True)}


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "h", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["evidence"] for r in classify(docs, labels).collect()] == [0.5]
    assert classify(docs.limit(0), labels).count() == 0
