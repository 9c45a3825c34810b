import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from syncplan.llm import jaccard_join
from syncplan.llm.components import components
from syncplan.llm.jaccard_join import near_duplicates, one_of_each, pack_arrays, unpack_arrays


def _sets(docs, k=5):
    out = {}
    for doc, text in docs:
        words = [w.lower() for w in (text or "").split()]
        out[doc] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    return out


def _expected(docs, k=5):
    sets = _sets(docs, k)
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


def _near_copies(seed):
    """Groups of copies at every distance around the threshold, chains among them, and a passage that all share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, passage = [], " ".join(rng.choices(vocabulary, k=30))
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 40 + 1, len(words) // 20 + 1])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = copy  # a chain: the next ones are copies of this copy
            docs.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_against_all_pairs(spark, monkeypatch):
    for seed, hot in ((1, 64), (2, 4)):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        monkeypatch.setattr(jaccard_join, "STRETCH", 2000)
        docs = _near_copies(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert sorted(tuple(r) for r in near_duplicates(df).collect()) == _expected(docs)


def test_pairs_left_after_hubs(spark, monkeypatch):
    """Without hub rounds all links are found among the pairs that are left."""
    docs = _near_copies(3)
    monkeypatch.setattr(jaccard_join._links, "__defaults__", (0,))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == _expected(docs)


def _template(n):
    """Texts of 150 words that all share and 46 of 400 others, of which hardly any link."""
    rng = random.Random(n)
    shared = [f"t{i}" for i in range(150)]
    return [(i, " ".join(shared + [f"o{x}" for x in rng.sample(range(400), 46)])) for i in range(n)]


def test_pages_of_a_template_do_not_meet_in_pairs(spark, monkeypatch):
    made = []
    compared = jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "_compared", lambda pairs, near, percent: made.append(pairs.count()) or compared(pairs, near, percent))
    for n in (150, 600):
        made.clear()
        docs = _template(n)
        got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=1).collect()
        assert sorted(tuple(r) for r in got) == _expected(docs, 1)
        assert made[-1] < 0.05 * n * (n - 1) / 2 and sum(made) < 100 * n  # hubs make a pair a posting at most


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=600), st.sets(st.integers(0, 2**48 - 1), max_size=600), st.sets(st.integers(0, 2**48 - 1), max_size=900))
def test_sets_differ_in_as_many_tokens_as_bits(a, b, both):
    a, b = a | both, b | both
    x, y = (jaccard_join._bits(np.array(sorted(t), np.uint64)) for t in (a, b))
    assert x.shape == (jaccard_join.BITS // 64,)
    assert sum(int(w).bit_count() for w in (x ^ y).view("<u8")) <= len(a ^ b)


def test_orders_differ_in_kind_and_are_the_same_for_all_sets():
    rng = np.random.default_rng(1)
    token = np.unique(rng.integers(0, 2**48, 500).astype(np.uint64))
    rank = rng.integers(2, 256, len(token)).astype(np.uint8)
    orders = jaccard_join._orders(token, rank)
    of = dict(zip(token.tolist(), rank.tolist(), strict=True))
    assert [of[t] for t in orders[0].tolist()] == sorted(rank.tolist()) and [of[t] for t in orders[2].tolist()] == sorted(rank.tolist(), reverse=True)
    some = np.sort(rng.permutation(len(token))[:200])
    for whole, part in zip(orders, jaccard_join._orders(token[some], rank[some]), strict=True):
        assert [t for t in whole.tolist() if t in set(token[some].tolist())] == part.tolist()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "A b", "x"), (5, "a B", "x"), (5, "a B", "x"), (None, "a b", "x"),
            (None, "alone here", "x"), (9, "one two three four five six", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, 4), (None, 1, None), (9, 2, 9)], key=str)
    left = [r["doc_id"] for r in one_of_each(df.unionByName(df.filter("doc_id = 9"))).collect()]
    assert sorted(left, key=str) == sorted([1, 2, 3, 4, 9, None], key=str)


def test_one_of_each_judges_texts_not_ids(spark):
    """Unlike texts under one id each stay or go by their own group; columns named as those used within come through."""
    rows = [(7, "one two three four five six", 1, "a", 3), (7, "seven eight nine ten eleven twelve", 2, None, 3),
            (3, "ONE two three four five six", None, "b", 3), (7, "", 4, "c", 3), (7, "", 4, "c", 3), (8, "alone it stays with us here", 5, "d", 3),
            (8, "alone it stays with us here", 5, "d", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 long, kept string, cls int")
    got = sorted((tuple(r) for r in one_of_each(df).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[3], rows[4], rows[5]], key=str)


def test_ranges_dealt_in_steps(spark, monkeypatch):
    """More ranges than one step deals out, and hot tokens that only a later step can see."""
    monkeypatch.setattr(jaccard_join, "FAN", 4)
    monkeypatch.setattr(jaccard_join, "RANGE_TOKENS", 100)
    monkeypatch.setattr(jaccard_join, "LEAST_RANGES", 8)
    monkeypatch.setattr(jaccard_join, "STRETCH", 3000)
    monkeypatch.setattr(jaccard_join, "HOT", 8)
    docs = _near_copies(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == _expected(docs)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 499), (499, 700), (3, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 499: 499, 500: 499, 700: 499}


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(0, 255)))
def test_packed_arrays(a, b):
    x, y = unpack_arrays(pack_arrays(np.array(a, np.uint64), np.array(b, np.uint8)))
    assert x.tolist() == a and y.tolist() == b


def test_a_very_long_text_and_its_copies(spark):
    words = [f"w{i}" for i in range(150_000)]
    near = [*words[:70_000], "other", *words[70_001:]]
    docs = [(3, " ".join(near), 1), (1, " ".join(words), 2), (2, " ".join(words), 3), (4, " ".join(words[:100_000]), 4), (5, "short", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == [(1, 149_996, 1), (2, 149_996, 1), (3, 149_996, 1), (4, 99_996, 4), (5, 1, 5)]
