"""Quality classifier and decontamination."""

import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import decontam, quality
from factloom.llm.queries import queries

from .conftest import words


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean, junk and toxic documents; some of the clean ones are trusted, and as many of all kinds have other labels."""
    rnd = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    docs, labels, kinds = [], [], {}
    for k in range(1500):
        kind = rnd.choices(("clean", "junk", "toxic"), (70, 15, 15))[0]
        text = rnd.choices(vocabulary, k=rnd.randrange(15, 120))
        if kind == "junk":
            text = [w.upper() + "!!" for w in text]
        if kind == "toxic":
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(("idiot", "moron", "scum")))
        docs.append((k, " ".join(text)))
        kinds[k] = kind
        if rnd.random() < 0.4:
            labels.append((k, int(kind != "junk"), int(kind == "toxic")))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), kinds


def test_held_out_accuracy(corpus):
    docs, labels, kinds = corpus
    known = {r.doc_id for r in labels.collect()}
    keep = {r.doc_id: r.keep for r in quality.quality_scores(docs, labels).collect()}
    share = lambda kind: np.mean([keep[k] for k in kinds if kinds[k] == kind and k not in known])
    assert share("clean") > 0.98 and share("junk") < 0.1 and share("toxic") < 0.15
    again = {r.doc_id: r.keep for r in quality.quality_scores(docs.repartition(5), labels.repartition(2)).collect()}
    assert again == keep


def test_risk_and_its_gradient():
    """The risk falls along the direction that is followed, which is its gradient by differences; where it is clamped, the clamped part's the other way."""
    rnd = np.random.default_rng(2)
    n, m, width = 40, 60, 7
    dense = {k: rnd.random((c, width)) < 0.4 for k, c in (("p", n), ("u", m))}
    sets = {k: quality._Set(*np.nonzero(x), np.zeros(len(x), bool)) for k, x in dense.items()}

    def brute(theta, prior):
        g = {k: x @ theta[:-1] + theta[-1] for k, x in dense.items()}
        loss = lambda v: sum(np.log(1 + np.exp(-x)) for x in v) / len(v)
        return prior * loss(g["p"]), loss(-g["u"]) - prior * loss(-g["p"]), g

    for prior in (0.3, 0.9):
        for _ in range(5):
            theta = rnd.normal(0, 1.5, width + 1)
            first, second, g = brute(theta, prior)
            assert abs(quality.risk(g["p"], g["u"], prior) - first - max(0, second)) < 1e-9
            slope, negative = quality.slope(sets["p"], sets["u"], width, theta, prior)
            assert abs(negative - second) < 1e-9
            for k in range(width + 1):
                step = np.zeros(width + 1)
                step[k] = 1e-6
                up, down = brute(theta + step, prior), brute(theta - step, prior)
                want = (up[0] + up[1] - down[0] - down[1]) / 2e-6 if second >= 0 else -(up[1] - down[1]) / 2e-6
                assert abs(slope[k] - want) < 1e-6


def test_all_unlabelled_documents_are_learnt_from(corpus, monkeypatch):
    """In one block or in several, and whatever the sample's bound: it holds for positives only."""
    docs, labels, kinds = corpus
    seen = []
    whole = quality.trained(docs, labels)
    monkeypatch.setattr(quality, "BLOCK", 200)
    parts = quality.trained(docs, labels)
    keep = lambda m: {k: m.scores(pa.array([t]))[0] >= m.threshold for k, t in docs.collect()[:300]}
    a, b = keep(whole), keep(parts)
    seen = [k for k in a if a[k] != b[k]]
    assert len(seen) < 15 and abs(whole.prior - parts.prior) < 0.1
    few = quality.trained(docs, labels, sample=30)
    assert few is None or few.prior > 0


def test_prior_is_estimated():
    rnd = np.random.default_rng(0)
    positive = rnd.normal(2, 1, 3000)
    unlabelled = np.concatenate([rnd.normal(2, 1, 1800), rnd.normal(-2, 1, 1200)])
    assert abs(quality.estimated_prior(positive, unlabelled) - 0.6) < 0.06


def test_op2_on_odd_rows(spark, tables, documents, no_documents):
    got = queries()["op2_pu_quality"](spark, tables)
    assert got.columns == ["doc_id", "score", "keep"] and got.count() == documents.count()
    assert got.where("keep is null").count() == 0
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    assert quality.quality_scores(no_documents, labels).count() == 0
    untrained = quality.quality_scores(documents, labels.limit(0))
    assert untrained.where("score is null and keep").count() == documents.count()
    kept = quality.kept(documents, labels)
    assert kept.columns == documents.columns and kept.count() == got.where("keep").count()
    assert quality.kept(documents, labels.limit(0)).count() == documents.count()


def test_features_are_those_of_each_text_alone():
    import pyarrow as pa

    texts = ["One two two.", None, "", "ÉÉ | 12", "a " * 3000]
    owner, bucket = quality.features(pa.array(texts))
    for d, text in enumerate(texts):
        _, alone = quality.features(pa.array([text], pa.string()))
        assert sorted(bucket[owner == d]) == sorted(alone) and len(set(alone)) == len(alone)


def test_op4_equals_brute_force(spark, tables, rows):
    got = [(r.doc_id, r.item_id) for r in queries()["op4_spaced_seed_decontamination"](spark, tables).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = decontam.brute_contaminated([r[:2] for r in rows], items)
    assert set(got) == want and {i for _, i in want} == {0, 1}


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.18])
def test_substituted_passages_are_found(spark, rate):
    rnd = random.Random(int(rate * 100))
    items = [(k, " ".join(f"v{rnd.randrange(500)}" for _ in range(rnd.randrange(15, 60)))) for k in range(60)]
    docs = []
    for k, text in items:
        own = [f"zz{rnd.randrange(99)}" if rnd.random() < rate else w for w in text.split()]
        docs.append((k, " ".join([f"u{rnd.randrange(500)}" for _ in range(30)] + own + [f"u{rnd.randrange(500)}" for _ in range(30)])))
    docs += [(1000 + k, " ".join(f"v{rnd.randrange(500)}" for _ in range(200))) for k in range(40)]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = decontam.brute_contaminated(docs, items)
    assert got <= want and len(got) >= 0.9 * len(want) and not any(d >= 1000 for d, _ in got)


def test_large_benchmarks_are_joined_in_parts(spark, documents, tables, monkeypatch):
    benchmark = spark.read.parquet(f"{tables}/benchmark.parquet")
    whole = {tuple(r) for r in decontam.contaminated(documents, benchmark).collect()}
    monkeypatch.setattr(decontam, "INDEX_WORDS", 5)
    assert len(list(decontam.indexes(benchmark))) > 1
    assert {tuple(r) for r in decontam.contaminated(documents, benchmark).collect()} == whole


def test_contaminated_documents_go(spark, documents, tables, no_documents):
    benchmark = spark.read.parquet(f"{tables}/benchmark.parquet")
    out = decontam.decontaminated(documents, benchmark)
    bad = {r.doc_id for r in decontam.contaminated(documents, benchmark).collect()}
    assert out.columns == documents.columns and out.count() == documents.where(~documents.doc_id.isin(*bad) | documents.doc_id.isNull()).count()
    assert decontam.decontaminated(documents, benchmark.limit(0)).count() == documents.count()
    assert decontam.contaminated(documents, benchmark.limit(0)).count() == 0
    assert decontam.decontaminated(no_documents, benchmark).count() == 0 and decontam.contaminated(no_documents, benchmark).count() == 0
    assert words("x") == ["x"]
