"""N-gram Jaccard join and suffix-array dedup against brute force."""

import random

import pytest

from factloom.llm import components, ngram_join, suffixes
from factloom.llm.queries import queries

from .conftest import words


def closed(pairs):
    """Classes of what pairs connect."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def expanded(rows):
    """All pairs that classes and pairs of their least members stand for."""
    twins = {}
    for a, b, j in rows:
        if j == 1.0:
            twins.setdefault(a, {a}).add(b)
    out = set()
    for own in twins.values():
        out |= {(a, b) for a in own for b in own if a < b}
    for a, b, _ in rows:
        out |= {(min(x, y), max(x, y)) for x in twins.get(a, {a}) for y in twins.get(b, {b}) if x != y}
    return out


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(None, 1), (2, None), (7, 7)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {x: min(c) for c in closed([(a, b) for a, b in pairs if a is not None and b is not None and a != b]) for x in c}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, n=ngram_join.N, threshold=ngram_join.THRESHOLD):
    """``doc_id: (class, links)`` from all pairs of texts."""
    pairs = ngram_join.brute_pairs(rows, n, threshold)
    links = {d: 0 for d, _ in rows if d is not None}
    for a, b in pairs:
        links[rows[a][0]] += 1
        links[rows[b][0]] += 1
    root = {x: min(c) for c in closed([(rows[a][0], rows[b][0]) for a, b in pairs]) for x in c}
    return {d: (root.get(d, d), k) for d, k in links.items()}


def links_of(df):
    rows = [(r.doc_id, (r.class_id, r.n_links)) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def test_op3_equals_brute_force(spark, tables, rows):
    got = links_of(queries()["op3_ngram_jaccard"](spark, tables))
    assert got == brute_links([r[:2] for r in rows]) and any(n for _, n in got.values())


@pytest.mark.parametrize("n,threshold,members", [(1, 0.5, 2048), (2, 0.9, 5), (3, 1.0, 2048), (2, 0.3, 3), (1, 0.4, 4)])
def test_join_at_other_parameters(spark, monkeypatch, n, threshold, members):
    """Also with components that are cut into tiles, and with ids that several different texts share."""
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    rnd = random.Random(n)
    base = [[rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 14))] for _ in range(14)]
    texts = [(k % 37, " ".join(w if rnd.random() > 0.15 else "x" for w in base[k % 14])) for k in range(42)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert links_of(ngram_join.linked(df, n, threshold)) == brute_links(texts, n, threshold)
    own = [(k, t) for k, (_, t) in enumerate(texts)]
    got = [(r.doc_a, r.doc_b, r.jaccard) for r in ngram_join.jaccard_pairs(spark.createDataFrame(own, "doc_id long, text string"), n, threshold).collect()]
    assert expanded(got) == set(ngram_join.brute_pairs(own, n, threshold)) and all(j <= 1 for *_, j in got)


def test_rows_of_one_id_are_texts_of_their_own(spark):
    texts = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "a b c d e f g h x"), (3, "p q r s t u v w"), (4, "k l m n o")]
    got = links_of(ngram_join.linked(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (4, 0)}
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(spark.createDataFrame(texts, "doc_id long, text string")).collect()) == [1, 1, 4]


@pytest.mark.parametrize("hot", [1, 2, 9])
def test_ties_lose_no_partner(spark, monkeypatch, hot):
    """Whatever is counted pair by pair and whatever tied to one holder, and where all n-grams of a fragment fall together."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rnd = random.Random(hot)
    stem = [f"s{k}" for k in range(30)]
    texts = [(k, " ".join(w if rnd.random() > 0.12 else f"y{rnd.randrange(40)}" for w in (stem if k % 2 else stem[:18])[: rnd.randrange(5, 31)])) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for n, threshold in ((1, 0.55), (2, 0.4), (1, 0.8)):
        assert links_of(ngram_join.linked(df, n, threshold)) == brute_links(texts, n, threshold)


def test_partners_share_what_the_bound_says():
    import numpy as np

    rnd = np.random.default_rng(5)
    for t in (0.3, 0.55, 0.8, 1.0):
        tight = 0
        for _ in range(4000):
            x, y = (set(rnd.choice(24, rnd.integers(1, 24), replace=False).tolist()) for _ in range(2))
            if rnd.random() < 0.7:
                y = (x - {rnd.integers(24)}) | {int(rnd.integers(24))} if len(x) > 1 else x
            if len(x & y) < t * len(x | y) - 1e-12:
                continue
            prefix = [set(sorted(s)[: len(s) - int(ngram_join.need(len(s), t)) + 1]) for s in (x, y)]
            spare = len(prefix[0] & prefix[1]) - int(ngram_join.least_shared(np.array(len(x)), np.array(len(y)), t))
            assert spare >= 0
            tight += spare == 0
        assert tight


def test_connected():
    import numpy as np

    rnd = np.random.default_rng(3)
    for m in (1, 5, 60):
        i, j = rnd.integers(0, m, m), rnd.integers(0, m, m)
        want = {x: min(c) for c in closed(list(zip(i.tolist(), j.tolist(), strict=True))) for x in c}
        assert [want.get(k, k) for k in range(m)] == ngram_join.connected(i, j, m).tolist()


def test_overlaps_in_blocks():
    import numpy as np

    rnd = np.random.default_rng(0)
    sets = sorted((np.unique(rnd.integers(0, 30, rnd.integers(1, 20))).astype(np.uint64) for _ in range(25)), key=len)
    owner = np.repeat(np.arange(25), [len(s) for s in sets])
    size = np.array([len(s) for s in sets])
    want = {(i, j): len(set(sets[i]) & set(sets[j])) for i in range(25) for j in range(i + 1, 25) if size[i] >= 0.5 * size[j] and set(sets[i]) & set(sets[j])}
    for left in (7, 20):
        two = np.concatenate([np.sort(size[:left]), np.sort(size[left:])])
        got = {(int(a), int(b)): int(c) for i, j, s in ngram_join.overlaps(np.concatenate(sets), owner, two, 0.5, 300, left=left) for a, b, c in zip(i, j, s, strict=True)}
        assert got == {(a, b): c for (a, b), c in want.items() if a < left <= b}
    for block in (10, 300, 1 << 20):
        got = {(int(a), int(b)): int(c) for i, j, s in ngram_join.overlaps(np.concatenate(sets), owner, size, 0.5, block) for a, b, c in zip(i, j, s, strict=True)}
        assert got == want


def test_one_of_each_group_stays_with_all_columns(spark, documents, rows, no_documents):
    out = ngram_join.one_of_each_group(documents)
    assert out.columns == documents.columns
    groups = closed([(rows[a][0], rows[b][0]) for a, b in ngram_join.brute_pairs([r[:2] for r in rows])])
    gone = {x for g in groups for x in g if x != min(g)}
    want = sorted((r[0] is None, r[0] or 0) for r in rows if r[0] not in gone)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == want
    assert ngram_join.one_of_each_group(no_documents).count() == 0 and ngram_join.jaccard_pairs(no_documents).count() == 0 and ngram_join.linked(no_documents).count() == 0


def spans(df):
    return {(r.doc_id, r.start_word, r.end_word, r.copy) for r in df.collect()}


def test_op9_equals_brute_force(spark, tables, rows):
    own = list({(d, tuple(words(t))) for d, t, *_ in rows if d is not None and t is not None})
    want = suffixes.brute_spans(own)
    got = spans(queries()["op9_suffix_array"](spark, tables))
    assert got == want and any(c for *_, c in got)


@pytest.mark.parametrize("length", [1, 2, 7])
def test_hot_passages_across_buckets(spark, monkeypatch, length):
    """Few different suffixes: splitters are equal, so runs lie across buckets."""
    monkeypatch.setattr(suffixes, "SAMPLE_SUFFIXES", 1)
    monkeypatch.setattr(suffixes, "SAMPLE_DOCUMENTS", 1)
    monkeypatch.setattr(suffixes, "parts", lambda _: 20)
    rnd = random.Random(length)
    hot = "a b c d e f g h".split()
    texts = [(k, " ".join(hot * 3 if k % 3 else rnd.choices("abxyz", k=20))) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert len(set(suffixes.splitters(df, length, 40))) < 35
    assert spans(suffixes.repeated_spans(df, length)) == suffixes.brute_spans([(d, t.split()) for d, t in texts], length)


def test_multikey_sort():
    import numpy as np

    rnd = np.random.default_rng(5)
    columns = [rnd.integers(0, 5, 300), rnd.integers(0, 4, 300), rnd.integers(0, 1000, 300)]
    order = suffixes.multikey_sort(columns)
    rows = [tuple(c[k] for c in columns) for k in order]
    assert rows == sorted(rows) and sorted(order) == list(range(300))
    assert len(suffixes.multikey_sort([np.zeros(0), np.zeros(0)])) == 0


def test_copies_are_cut_and_sources_stay(spark, documents, rows, no_documents):
    out = suffixes.without_copies(documents)
    assert out.columns == documents.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect() if r.doc_id is not None}
    cut = [(d, a, b) for d, a, b, copy in suffixes.brute_spans(list({(d, tuple(words(t))) for d, t, *_ in rows if d is not None and t is not None})) if copy]
    touched = {d for d, *_ in cut}
    for d, text, _, _, n in rows:
        if d is not None and d not in touched:
            assert got[d] == (text, n)
    for d in touched:
        left = words(dict((r[0], r[1]) for r in rows)[d])
        for _, a, b in sorted((x for x in cut if x[0] == d), reverse=True):
            del left[a:b]
        assert words(got[d][0]) == left if left else d not in got or not words(got[d][0])
    assert suffixes.without_copies(no_documents).count() == 0
    assert suffixes.repeated_spans(suffixes.without_copies(documents)).where("copy").count() == 0
