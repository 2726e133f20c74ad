"""Fingerprints, HTML extraction, Katz scores, mixing, token counts, chat formatting and the pipeline."""

import hashlib
import math
import random
import re
import statistics
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import chat, decontam, fingerprints, html_text, katz, mixing, ngram_join, quality, suffixes, wordpiece
from factloom.llm.queries import oracle_sql, queries

from .conftest import CLASHING, words
from .test_dedup import closed


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", ["op1_iblt_fingerprints", "op3_ngram_jaccard", "op7_pareto_mixing", "op10_chat_format"])
def test_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
    except Exception:
        pytest.skip("the tables aren't here")
    assert docs.count()
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = c.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries()[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(norm, r)) for r in df.select(*names).collect()) == sorted(tuple(map(norm, r)) for r in found.fetchall())


# fingerprints


@pytest.mark.parametrize("cells", [3, 24, 96])
def test_tables_give_back_differences_or_nothing(cells):
    rnd = np.random.default_rng(cells)
    solved = 0
    for d in range(0, 40, 3):
        common, a, b = (set(rnd.integers(0, 1 << 60, n).tolist()) for n in (50, d, d // 2))
        table = fingerprints.subtract(*(fingerprints.sketch(np.array(sorted(common | x), np.uint64), cells) for x in (a, b)))
        found = fingerprints.peel(table)
        assert found in (None, (sorted(a), sorted(b)))
        solved += found is not None
    assert solved >= (13 if cells == 96 else 1)


def brute_versions(rows):
    """``doc_id: {(version_of, added, removed)}`` of ``(doc_id, text)``; of rows that share an id, the order is left open."""
    own = {}
    for d, t in rows:
        if d is not None:
            now, long = fingerprints.digests(t or "")
            own[d, tuple(now)] = (d, set(now), set(long))
    want = {}
    for d, now, long in own.values():
        named = Counter()
        for p in long:
            if before := [k for k, (e, _, other) in own.items() if e < d and p in other]:
                named[max(before)] += 1
        best = max(named, key=lambda k: (named[k], k[0]), default=None)
        told = (None, None, None)
        if best is not None and 2 * len(now & own[best][1]) >= min(len(now), len(own[best][1])):
            told = (best[0], sorted(now - own[best][1]), sorted(own[best][1] - now))
        want.setdefault(d, set()).add(str(told))
    return want


def told_versions(df):
    as_list = lambda s: None if s is None else sorted(int(x) for x in s)
    return [(r.doc_id, str((r.version_of, as_list(r.added), as_list(r.removed)))) for r in df.collect()]


def test_op1_equals_differences_of_sets(spark, tables, documents, rows, no_documents):
    got = queries()["op1_iblt_fingerprints"](spark, tables)
    assert got.columns == ["doc_id", "n_paragraphs", "version_of", "added", "removed"] and got.count() == len(rows)
    want = brute_versions([r[:2] for r in rows])
    for d, told in told_versions(fingerprints.version_changes(documents)):
        assert told in want[d] if d is not None else told == "(None, None, None)"
    small = fingerprints.version_changes(spark.createDataFrame([(k, "\n".join([c * 70 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP"] + [f"p{k}-{i}" for i in range(40)])) for k in range(3)], "doc_id long, text string"), cells=3)
    assert sorted(len(r.added) for r in small.where("version_of is not null").collect()) == [40, 40]  # after retries
    assert fingerprints.version_changes(no_documents).count() == 0
    assert fingerprints.fingerprint_sketches(no_documents).count() == 0


def test_versions_across_partitions(spark, monkeypatch):
    """A line that all documents have, edited and reordered paragraphs, and holders of one paragraph in many partitions."""
    monkeypatch.setattr(fingerprints, "exchange_parts", lambda _: 7)
    rnd = random.Random(8)
    base = [[f"{rnd.random()} is what the paragraph says {'x' * 60}" for _ in range(rnd.randrange(2, 9))] for _ in range(12)]
    texts = []
    for k in range(90):
        own = [p if rnd.random() > 0.2 else p + " edited" for p in base[rnd.randrange(12)]]
        rnd.shuffle(own)
        texts.append((k * 3 % 97, "\n".join(["license " * 12, *own, "short"])))
    want = brute_versions(texts)
    got = told_versions(fingerprints.version_changes(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)))
    assert len(got) == 90 and {d: {t} for d, t in got} == want
    assert sum("None" not in t for _, t in got) > 60


# HTML


def test_op5_keeps_the_article(spark, tables):
    got = sorted((r.page_id is None, r.page_id or 0, r.text) for r in queries()["op5_html_line_blocks"](spark, tables).collect() if r.text is not None)
    article = "Head\n" + ("word " * 30).strip() + "\n" + ("more " * 20).strip()
    assert got == [(False, 0, article), (False, 0, article), (False, 2, ""), (False, 3, ""), (True, 0, "only & one line")]


def naive_kept(lengths, width, surge):
    """Lines that are kept, line by line, from the definition."""
    n = len(lengths)
    block = [sum(lengths[k : k + width]) for k in range(n)]
    good = [k for k in range(n) if lengths[k] and block[k] > lengths[k]]
    alone = not good
    if not any(lengths):
        return set()
    surge = min(surge, max(block[k] for k in good) if good else max(block))
    kept, reading = set(), False
    for k in range(n):
        if reading and not block[k]:
            reading = False
        if not reading and lengths[k] and block[k] >= surge and (alone or block[k] > lengths[k]):
            reading = True
        if reading:
            kept.add(k)
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_surges_and_dives_equal_the_definition(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        lengths = [rnd.choice((0, 0, 0, 3, 20, 90)) for _ in range(rnd.randrange(0, 25))]
        width, surge = rnd.randrange(1, 5), rnd.randrange(1, 120)
        got = {k for a, b in html_text.kept_lines(lengths, width, surge) for k in range(a, b)}
        assert got == naive_kept(lengths, width, surge)


def test_articles_of_pages_with_line_ends():
    menu = "<nav>\n<ul>\n<li>Home page of us</li>\n<li>About the company</li>\n<li>Contact and imprint</li>\n</ul>\n</nav>\n"
    paragraphs = [f"{k} " + "word " * 60 for k in range(3)]
    for end in ("\n", "\r\n", "\n\n    "):
        page = (menu + "<article><h1>Head</h1>\n" + "\n".join(f"<p>{p}</p>" for p in paragraphs) + "\n</article>\n<footer>\nA notice of the footer\n</footer>").replace("\n", end)
        assert html_text.main_text(page) == "\n".join(["Head", *(p.strip() for p in paragraphs)])
    compact = menu.replace("\n", "")
    assert html_text.main_text(compact + f"<article><p>{paragraphs[0]}</p></article><footer>{'notice ' * 16}</footer>") == paragraphs[0].strip()
    assert html_text.main_text(f"<p>{paragraphs[0]}</p><pre>one\n two</pre>") == f"{paragraphs[0].strip()}\none\ntwo"


# Katz


def brute_katz(rows, order, cutoff):
    texts = [(d, words(t)) for d, t, *_ in rows]
    uni = Counter(w for _, ws in texts for w in ws)
    every = [*uni, 0]
    total = sum(uni.values()) + len(every)
    counts = {n: Counter(tuple(ws[i - n + 1 : i + 1]) for _, ws in texts for i in range(n - 1, len(ws))) for n in range(2, order + 1)}
    after = {n: {} for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            after[n].setdefault(g[:-1], {})[g[-1]] = k
    ratios = {n: katz.discounts(dict(Counter(c.values()))) for n, c in counts.items()}

    @lru_cache(None)
    def history(h):
        seen = after[len(h) + 1].get(h)
        if seen is None:
            return None
        mass = {w: (ratios[len(h) + 1][c] if c <= katz.DISCOUNTED else 1) * c for w, c in seen.items() if c > cutoff}
        n = sum(seen.values())
        n += sum(mass.values()) >= n * (1 - 1e-12)
        p = {w: m / n for w, m in mass.items()}
        left = 1 - sum(probability(h[1:], w) for w in p)
        if left <= 1e-12:
            return {w: x / sum(p.values()) for w, x in p.items()}, 0.0
        return p, (1 - sum(p.values())) / left

    def probability(h, w):
        if not h:
            return (uni.get(w, 0) + 1) / total
        found = history(h)
        if found is None:
            return probability(h[1:], w)
        return found[0][w] if w in found[0] else found[1] * probability(h[1:], w)

    scores = [(d, len(ws), sum(math.log(probability(tuple(ws[max(0, i - order + 1) : i]), ws[i])) for i in range(len(ws))) if ws else None) for d, ws in texts]
    return scores, probability, every, after


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_brute_force_and_sums_to_one(spark, documents, rows, order):
    want, probability, every, after = brute_katz(rows, order, katz.CUTOFF)
    got = katz.scores(documents, order).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    pairs = list(zip(sorted(want, key=key), sorted(((r.doc_id, r.n_tokens, r.log_probability) for r in got), key=key), strict=True))
    assert all(a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-5 * max(1, abs(a[2]))) for a, b in pairs)
    for table in after.values():
        for h in list(table)[:20]:
            assert abs(sum(probability(h, w) for w in every) - 1) < 1e-9


def test_op6_and_its_tables(spark, tables, documents, rows, no_documents):
    want, *_ = brute_katz(rows, katz.ORDER, katz.CUTOFF)
    assert queries()["op6_katz_scores"](spark, tables).count() == len(want)
    assert katz.scores(no_documents).count() == 0
    scored, vocabulary, model = katz.trained_and_scored(documents, 2)
    assert scored.count() == len(rows)
    everything = np.arange(len(vocabulary.unigram), dtype=np.uint64)
    for part in list(katz.model_parts(model, 8)[2].values())[:4]:
        for h in part.histories[:10]:
            p = part.evaluate(h << np.uint64(16) | everything, vocabulary.unigram)
            assert abs(p.sum() - 1) < 1e-9
    few = katz.trained_and_scored(documents, 2, words=5)
    assert few[0].count() == len(rows) and len(few[1].hash) == 5


def test_every_word_is_told_apart(spark):
    """More words than 16 bits have numbers for, each in one place; a common vocabulary would take all rare ones for one word."""
    rnd = random.Random(3)
    rare = [f"r{k}" for k in range(70_000)]
    rows = [(k, " ".join(rare[100 * k : 100 * k + 100] + [rnd.choice("abcd") for _ in range(60)])) for k in range(700)]
    _, vocabulary, _ = katz.trained_and_scored(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    assert vocabulary.words == 70_004 == len(vocabulary.hash) and vocabulary.unknown == 0
    for order in (2, 3):
        want, *_ = brute_katz(rows, order, 1)
        got = {r.doc_id: r.log_probability for r in katz.scores(spark.createDataFrame(rows, "doc_id long, text string"), order, cutoff=1).collect()}
        assert all(abs(got[d] - x) < 1e-5 * abs(x) for d, _, x in want)


def test_op6_tells_two_words_of_context(spark, tmp_path):
    """The same pairs of words everywhere, so that only a third word and n-grams counted once tell the documents apart."""
    rows = [(0, "a b c a b c a b c"), (1, "a b d"), (2, "x b c x b c"), (3, "x b d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_probability for r in queries()["op6_katz_scores"](spark, str(tmp_path)).collect()}
    want, *_ = brute_katz(rows, 3, 0)
    assert all(got[d] == pytest.approx(x, rel=1e-5) for d, _, x in want)
    assert not any(got[d] == pytest.approx(x, rel=1e-5) for lower in ((2, 0), (3, 1)) for d, _, x in brute_katz(rows, *lower)[0] if d in (1, 3))


@pytest.mark.parametrize("order", [2, 3])
def test_katz_with_a_cutoff_backs_off(spark, documents, rows, order):
    want, *_ = brute_katz(rows, order, 1)
    got = sorted((r.n_tokens, r.log_probability) for r in katz.scores(documents, order, cutoff=1).where("log_probability is not null").collect())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 * max(1, abs(a[1])) for a, b in zip(sorted((n, x) for _, n, x in want if x is not None), got, strict=True))


def test_good_turing_ratios():
    d = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5})
    a = 6 * 5 / 100
    assert d[1] == pytest.approx((2 * 40 / 100 - a) / (1 - a)) and all(0 < x < 1 for x in d[1:])
    assert set(katz.discounts({})) == {katz.FLAT}


@pytest.mark.parametrize("n", [(253241, 36000, 5971, 1298, 2087, 413), (100, 10), (100, 40, 0, 12, 8, 5), (30, 16, 9, 6, 5, 5)])
def test_irregular_counts_of_counts_are_smoothed_and_still_discount_by_good_turing(n):
    """Counts of counts of sf0.01's order 3, whose n(5) is above n(4); too few; one missing; common term of one and more."""
    known = [r for r, x in enumerate(n, 1) if x]
    z = [2 * n[r - 1] / (b - a) for a, r, b in zip([0, *known], known, [*known[1:], 2 * known[-1] - known[-2]], strict=False)]
    slope = statistics.linear_regression([math.log(r) for r in known], [math.log(x) for x in z]).slope
    d = katz.discounts(dict(enumerate(n, 1)))[1:]
    factor = [(1 - d[r - 1]) / (1 - (1 + 1 / r) ** (slope + 1)) for r in range(1, 6)]
    assert factor == pytest.approx([factor[0]] * 5)
    assert sum(n_ * r * (1 - x) for n_, r, x in zip(n, range(1, 6), d, strict=False)) == pytest.approx(n[0])
    assert 0 < d[0] and all(np.diff(d) > 0) and d[-1] < 1
    assert all(set(katz.discounts(x)) == {katz.FLAT} for x in ({1: 100}, {1: 10, 2: 10}, {2: 7}, {2: 7, 3: 2}, {1: 100, 6: 3}))


# mixing


def test_op7_draws_what_is_due(spark, tables, documents, rows, no_documents):
    got = queries()["op7_pareto_mixing"](spark, tables).collect()
    base = documents.select("doc_id", F.col("source").alias("mix_source"), F.coalesce(mixing.measure(), F.lit(0)).alias("mix_measure"))
    due = {r.mix_source: r.due for r in mixing.due(base).collect()}
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies
        assert r.copies == r.certain + r.drawn and r.drawn in (0, 1)
    assert dict(taken) == due
    again = mixing.mixed(documents.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mixed(no_documents).count() == 0
    given = mixing.mixed(documents, {"s0": 3, "s1": 1, "none": 5}, 0.5)
    assert {r.source for r in given.collect()} <= {"s0", "s1"}


def test_inclusion_follows_measures(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 400).otherwise(100).alias("n_chars"))
    got = mixing.mixed(docs, share=0.3)
    big = got.where("doc_id % 2 = 0").count()
    assert got.count() == 1200 and abs(big / (1200 - big) - 2) < 0.25


# token counts


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_greedy(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        pieces = {bytes(rnd.choice(b"ab ") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(0, 9))}
        strings = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 14))) for _ in range(20)]
        length = np.array([len(s) for s in strings])
        raw = np.frombuffer(b"".join(strings) + b"!", np.uint8)
        got = wordpiece.Automaton(pieces).counts(raw, np.cumsum(length) - length, length)
        assert got.tolist() == [wordpiece.brute_count(b" " + s, pieces) for s in strings]


def test_op8_equals_greedy(spark, tables, rows, no_documents):
    pieces = set(wordpiece.read_vocabulary())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_tokens) for r in queries()["op8_wordpiece_counts"](spark, tables).where("n_words is not null").collect())
    want = []
    for d, t, *_ in rows:
        if t is not None:
            own = re.findall(rb"[^ \t\n\r\x0b\x0c]+", t.encode())
            want.append((d is None, d or 0, len(own), sum(wordpiece.brute_count(b" " + w, pieces) for w in own)))
    assert got == sorted(want)
    assert wordpiece.token_counts(no_documents).count() == 0
    assert wordpiece.token_counts(no_documents.limit(0), [b"a"]).count() == 0


# chat


def test_op10_renders_parts(spark, tables):
    got = {(r.conv_id, r.n_messages): r for r in chat.formatted(spark.read.parquet(f"{tables}/conversations.parquet")).collect()}
    r = got[0, 3]
    assert r.text.startswith("<|user|>\nlook: <|image:0|> and <|audio:1|> <\\|end|><|end|>\n<|assistant|>\nsure<|end|>\n<|user|>\n<|document:2|>x")
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 256), ("audio", "b.wav", 63), ("document", "c.pdf", 1536)]
    assert got[1, 3].text == "<|user|>\n<|end|>\n" * 3 and got[None, 1].text == "<|user|>\n[not json<|end|>\n"
    assert got[2, 1].n_tokens == 5002 and got[2, 1].text.startswith("<|sys_tem|>\n")
    assert queries()["op10_chat_format"](spark, tables).count() == 4
    assert chat.formatted(spark.read.parquet(f"{tables}/conversations.parquet").limit(0)).count() == 0


def test_parts_that_lack_something_stay_as_text():
    text, attachments, _ = chat.render([("user", '[{"type": "image"}, {"type": "audio", "ref": "a", "size": -1}, {"type": "text", "text": 5}]')])
    assert not attachments and '{"type": "image"}' in text and '"size": -1' in text and '"text": 5' in text


# pipeline


def test_stages_take_and_keep_documents(spark, tables, documents):
    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert set(CLASHING) <= set(docs.columns)
    ids = {r.doc_id for r in docs.collect()}
    got = {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()}
    assert got <= ids and got


def brute_mix(docs):
    """``(doc_id, source, copies)`` of ``(doc_id, source, n_chars)``, by sorting each source."""
    measured = [(d, s, math.ceil(math.sqrt(n)) if n is not None else 0) for d, s, n in docs]
    sources = sorted({s for _, s, _ in measured}, key=lambda s: (s is not None, s))
    weight = {s: math.floor(1000 * sum(x[1] == s for x in measured) ** 0.5) for s in sources}
    out, upto, before = [], 0, 0
    for s in sources:
        upto += weight[s]
        end = len(measured) * upto // sum(weight.values())
        due, before = end - before, end
        own = [(d, m) for d, t, m in measured if t == s]
        total = sum(m for _, m in own)
        if not total or due <= 0:
            continue
        ranked, sure = [], 0
        for d, m in own:
            expected = due * m / total
            p = expected - math.floor(expected)
            u = (int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            ranked.append((u / (1 - u) * (1 - p) / p if p > 0 else math.inf, d is not None, d or 0, d, math.floor(expected)))
            sure += math.floor(expected)
        out += [(r[3], s, r[4] + (k < due - sure)) for k, r in enumerate(sorted(ranked)) if r[4] + (k < due - sure)]
    return out


def test_run_equals_brute_force(spark, tables, documents, rows):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    keep = {r.doc_id: r.keep for r in quality.quality_scores(documents, labels).collect() if r.doc_id is not None}
    by_text = {t: keep[d] for d, t, *_ in rows if d is not None}  # the classifier sees texts only
    left = [(d, t, s, n) for d, t, _, s, n in rows if by_text[t]]
    gone = {x for g in closed([(left[a][0], left[b][0]) for a, b in ngram_join.brute_pairs([(d, t) for d, t, *_ in left])]) for x in g if x != min(g)}
    left = [r for r in left if r[0] not in gone]
    cut = {}
    for d, a, b, copy in suffixes.brute_spans(list({(d, tuple(words(t))) for d, t, *_ in left if d is not None and t is not None})):
        if copy:
            cut.setdefault(d, []).append((a, b))
    after = []
    for d, t, s, n in left:
        if d in cut:
            places = [m.span() for m in re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", t)]
            for a, b in sorted(cut[d], reverse=True):
                t = t[: places[a][0]] + t[places[b - 1][1] :]
            t = t.strip()
            n = len(t)
            if not t:
                continue
        after.append((d, t, s, n))
    leaked = {k for k, _ in decontam.brute_contaminated([(k, r[1]) for k, r in enumerate(after)], items)}
    want = brute_mix([(d, s, n) for k, (d, _, s, n) in enumerate(after) if k not in leaked])
    got = [(r.doc_id, r.source, r.copies) for r in corpus_pipeline.run(spark, tables).collect()]
    assert Counter(got) == Counter(want) and leaked and gone and cut and len(left) < len(rows)


def test_stages_on_no_documents(spark, tables, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, tables).count() == 0
