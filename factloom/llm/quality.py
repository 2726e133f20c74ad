"""Quality classifier from trusted positives and unlabelled web text (positive-unlabelled learning).

A linear scorer over binary features (hashed words, hashed beginnings of words, and how texts are written: shares of punctuation, capitals, digits, bars and line
ends, word and text lengths, repeated words) is trained by minimising the non-negative unbiased risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the logistic loss: whenever the second term is negative, its gradient is followed upwards instead (Kiryo et al., 2017). The class
prior is estimated from positives and unlabelled documents alone: for a scorer that tells the two apart, the share of the
unlabelled that score above a threshold over the share of held-out positives that do bounds it, and the least such ratio is taken.
A document is kept if its score reaches the threshold, at which ``1 - LOST`` of the held-out positives stay.

The trusted positives are a bounded sample, ``SAMPLE`` rows of least hash of ``doc_id``. Unlabelled documents are all of them: features are counted over all, the risk is
minimised in blocks of ``BLOCK`` unlabelled documents, each against all positives of the sample, by steps over shares of both (as published), and blocks' weights are averaged; the prior is read from the scores of all that are held out (a third).
Features of documents are written once in the shared folder. Rows are sorted inside blocks, so the same input gives the same model. Scores are computed for all documents, over whole texts.

Null texts and texts without words have no word features and are scored by their form. A null label says nothing; repeated
labels must agree to be trusted. A null ``doc_id`` is scored, but not learnt from. With fewer than three positives or three unlabelled documents, or no feature that tells them apart, there is no model: every
score is null and every document is kept. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.packs import grouped, pack, trim, unpack
from factloom.llm.shared import bounded, pieces, small, texts_of, written

#: Trusted positives that the model is fitted to, at most. The only bound: all unlabelled documents are learnt from, and all documents are scored.
SAMPLE = 24_000
#: Unlabelled documents of a block; blocks are fitted side by side.
BLOCK = 15_000
#: Unlabelled documents of a step, at least, if a block has so many; positives are shared out over the steps alike.
STEP_ROWS = 1_250
#: Share of held-out positives that the threshold may lose.
LOST = 0.003
WORD_BITS = 20
#: Bytes of a word's beginning.
PREFIX = 5
#: Documents that must have a feature for it to be learnt.
LEAST_HOLDERS = 12
#: Standard errors by which a feature's shares among positives and unlabelled must differ for it to be learnt.
SIGNIFICANT = 5.0
STEPS, RATE, DECAY = 300, 0.05, 1e-5
#: Weights are summed over blocks as whole numbers of this fraction, so that the order of the blocks doesn't matter.
FRACTION = 1 << 24

_FORM = 16
_WIDTH = (1 << WORD_BITS) + 10 * _FORM


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: the texts' numbers, not falling, and the features."""
    w = tokens.words(texts)
    raw, offsets = tokens.buffer(texts)
    owner = w.owner()
    size = np.maximum(1, np.diff(offsets))
    n = len(size)
    count = np.diff(w.first)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    word, capital = tokens.WORD[raw], (raw >= 65) & (raw <= 90)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    levels = [
        share(~word & ~white) * 40,
        share(capital) * 20,
        share((raw >= 48) & (raw <= 57)) * 40,
        share(raw == 124) * 100,
        share(raw == 10) * 200,
        share(raw >= 128) * 40,
        np.log2(count + 1),
        np.minimum(size / np.maximum(1, count), 15),
    ]
    # words, and what they begin with: inflected words are many, their beginnings few
    beginnings = tokens.mix(tokens.words(texts, prefix=PREFIX).hash + np.uint64(1))
    row = owner.astype(np.uint64) << np.uint64(WORD_BITS)
    whole = np.unique(row | w.hash >> np.uint64(64 - WORD_BITS))
    distinct = np.bincount((whole >> np.uint64(WORD_BITS)).astype(np.int64), minlength=n)
    key = np.unique(np.concatenate([whole, row | beginnings >> np.uint64(64 - WORD_BITS)]))
    owner, bucket = (key >> np.uint64(WORD_BITS)).astype(np.int64), (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    levels.append(distinct / np.maximum(1, count) * 15)
    again = np.zeros(len(w.hash), dtype=bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[:-1][count > 0]] = False
    levels.append(np.bincount(w.owner()[again], minlength=n) / np.maximum(1, count) * 40)
    form = np.stack([(1 << WORD_BITS) + k * _FORM + np.minimum(v, _FORM - 1).astype(np.int64) for k, v in enumerate(levels)], axis=1).ravel()
    owner, bucket = np.concatenate([owner, np.repeat(np.arange(n), len(levels))]), np.concatenate([bucket, form])
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def _sums(weights: np.ndarray, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=weights[bucket], minlength=n)


class Model:
    __slots__ = ("bias", "prior", "threshold", "weights")

    def __init__(self, weights: np.ndarray, bias: float, prior: float, threshold: float):
        self.weights, self.bias, self.prior, self.threshold = weights, bias, prior, threshold

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for at, to in tokens.slices(texts):
            owner, bucket = features(texts.slice(at, to - at))
            out.append(_sums(self.weights, owner, bucket, to - at) + self.bias)
        return np.concatenate(out)


class _Set:
    """Documents as rows of learnt features, given as their numbers, not falling, and the features."""

    def __init__(self, owner: np.ndarray, bucket: np.ndarray, held: np.ndarray):
        self.owner, self.bucket, self.held, self.n = owner.astype(np.int32), bucket, held, len(held)

    def fitted(self) -> _Set:
        """The rows that aren't held out."""
        place = np.cumsum(~self.held) - 1
        inside = ~self.held[self.owner]
        return _Set(place[self.owner[inside]], self.bucket[inside], np.zeros(int((~self.held).sum()), dtype=bool))

    def shares(self, k: int) -> list[_Set]:
        """Every ``k``-th row, from each of the first ``k``; rows are in the order of a hash, so that shares are alike."""
        if k == 1:
            return [self]
        order = np.argsort(self.owner % k, kind="stable")
        owner, bucket = self.owner[order], self.bucket[order]
        cut = np.searchsorted(owner % k, np.arange(k + 1))
        return [_Set(owner[a:b] // k, bucket[a:b], self.held[j::k]) for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def scores(self, weights, bias):
        return _sums(weights, self.owner, self.bucket, self.n) + bias

    def gradient(self, per_row: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.bucket, weights=per_row[self.owner], minlength=width)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def slope(positive: _Set, unlabelled: _Set, width: int, theta: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """What is followed downwards from weights and bias ``theta``: the gradient of the risk, or the other way that of its second term where this is negative; and that term.
    Without a prior, the gradient of the loss of telling the two kinds apart."""
    gp, gu = positive.scores(theta[:-1], theta[-1]), unlabelled.scores(theta[:-1], theta[-1])
    up, down_p, down_u = -_logistic(-gp) / positive.n, _logistic(gp) / positive.n, _logistic(gu) / unlabelled.n  # slopes of loss(g) and loss(-g)
    negative = 0.0
    if prior is None:
        dp, du = up, down_u
    else:
        negative = float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())
        dp, du = (prior * (up - down_p), down_u) if negative >= 0 else (prior * down_p, -down_u)
    return np.append(positive.gradient(dp, width) + unlabelled.gradient(du, width), dp.sum() + du.sum()), negative


def _descend(positive: _Set, unlabelled: _Set, width: int, prior: float | None, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam: of the non-negative risk, or of telling the two apart if ``prior`` is None. Each step takes the next share of both kinds, of ``STEP_ROWS``
    unlabelled rows or more. Steps shrink to nothing, and the last third's weights are averaged, as the risk's second term goes to and fro about zero."""
    k = max(1, min(unlabelled.n // STEP_ROWS, positive.n // 3))
    shares = list(zip(positive.shares(k), unlabelled.shares(k), strict=True))
    theta = np.zeros(width + 1)
    mean, square, total = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    late = steps - max(1, steps // 3)
    for step in range(1, steps + 1):
        way, _ = slope(*shares[step % k], width, theta, prior)
        way[:-1] += DECAY * theta[:-1]
        mean, square = 0.9 * mean + 0.1 * way, 0.99 * square + 0.01 * way**2
        theta -= RATE * (1 - (step - 1) / steps) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        if step > late:
            total += theta
    theta = total / (steps - late)
    return theta[:-1], float(theta[-1])


def prior_cuts(positive: np.ndarray) -> np.ndarray:
    """Thresholds that keep a fifth of the positives or more."""
    return np.quantile(positive, np.linspace(0, 0.8, 33))


def least_ratio(positive: np.ndarray, cuts: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of shares of unlabelled and of positive scores above a threshold, given the unlabelled shares."""
    above = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    return float(np.clip((unlabelled / above).min(), 0.05, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from scores of held-out positives and unlabelled documents."""
    cuts = prior_cuts(positive)
    return least_ratio(positive, cuts, 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk of scores."""
    loss = lambda g: np.logaddexp(0, -g).mean()
    return prior * loss(positive) + max(0.0, loss(-unlabelled) - prior * loss(-positive))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(trusted, key, text)`` as packed features."""
    for batch in batches:
        texts = batch.column(2)
        for at, to in tokens.slices(texts):
            owner, bucket = features(texts.slice(at, to - at))
            begin, n = grouped(owner)
            blobs = [pack(np.sort(bucket[b : b + m]).astype(np.uint32)) for b, m in zip(begin, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(blobs, pa.binary())], names=["trusted", "key", "features"])
    trim()


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(feature, positive, unlabelled)``: documents of either kind that have it, of one part."""
    counts = np.zeros((2, _WIDTH), dtype=np.int64)
    for batch in batches:
        for trusted, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[0 if trusted else 1, unpack(blob, 1)[0]] += 1  # a row's features are distinct
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["feature", "positive", "unlabelled"])


def _rows(keys: list[int], blobs: list[bytes], columns: np.ndarray) -> _Set:
    """A set of rows, in the order of their keys and features."""
    order = sorted(range(len(keys)), key=lambda k: (keys[k], blobs[k]))
    learnt = [c[c >= 0] for c in (columns[unpack(blobs[k], 1)[0]] for k in order)]
    owner = np.repeat(np.arange(len(order)), [len(c) for c in learnt])
    return _Set(owner, np.concatenate([np.zeros(0, np.int32), *learnt]), np.array([keys[k] % 3 == 2 for k in order], dtype=bool))


def _fitted(shared, prior: float | None, steps: int):
    def run(table: pa.Table) -> pa.Table:
        """``(feature, total)``: weights of one block times its number of rows, as whole numbers of ``FRACTION``; the bias comes after the weights, and then the rows."""
        columns, width, positive = shared.value
        unlabelled = _rows(table.column("key").to_pylist(), table.column("features").to_pylist(), columns)
        weights, bias = _descend(positive, unlabelled, width, prior, steps)
        trim()
        total = np.append(np.rint(np.append(weights, bias) * FRACTION).astype(np.int64), 1) * unlabelled.n
        return pa.table({"feature": pa.array(np.arange(width + 2)), "total": pa.array(total)})

    return run


def _above(shared, theta: np.ndarray, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(cut, n)``: rows of one part that score at least each cut."""
        columns = shared.value[0]
        total = np.zeros(len(cuts), dtype=np.int64)
        for batch in batches:
            own = _rows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), columns)
            total += own.n - np.searchsorted(np.sort(own.scores(theta[:-1], theta[-1])), cuts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array(total)], names=["cut", "n"])

    return run


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """A model from at most ``sample`` trusted positives (quality 1, toxic 0) and all documents without a label."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("trusted"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = ids.join(known.where("trusted"), F.col("doc_id") == F.col("label_id"), "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # labels that aren't chosen take their documents out of both kinds
    roles = known.join(chosen.select(F.col("doc_id").alias("chosen_id"), F.lit(True).alias("chosen")), F.col("label_id") == F.col("chosen_id"), "left").select("label_id", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    texts = texts_of(docs).where("doc_id is not null").join(small(written(roles)), F.col("doc_id") == F.col("label_id"), "left").where("label_id is null or chosen")
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    rows = written(texts.select(F.col("label_id").isNotNull().alias("trusted"), key.alias("key"), "text").mapInArrow(_featured, "trusted boolean, key long, features binary"))
    n, m = (rows.agg(F.count_if("trusted"), F.count_if(~F.col("trusted"))).first()) or (0, 0)
    if min(n, m) < 3:
        return None
    # features that both kinds have about equally often tell nothing, and hundreds of them in a text would drown those that do
    held = rows.select("trusted", "features").mapInArrow(_holders, "feature int, positive long, unlabelled long").groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("unlabelled").alias("u"))
    share = (F.col("p") + F.col("u")) / (n + m)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n + 1 / m))
    telling = held.where((F.col("p") + F.col("u") >= LEAST_HOLDERS) & (F.abs(F.col("p") / n - F.col("u") / m) >= SIGNIFICANT * spread))
    learnt = np.sort(telling.select("feature").toArrow().column(0).to_numpy())
    positives = rows.where("trusted").select("key", "features").toArrow()
    columns = np.full(_WIDTH, -1, dtype=np.int32)
    columns[learnt] = np.arange(len(learnt))
    positive = _rows(positives.column(0).to_pylist(), positives.column(1).to_pylist(), columns)
    del positives
    trim()  # the driver lives on
    if not 0 < positive.held.sum() < n or not len(learnt):
        return None
    shared = spark.sparkContext.broadcast((columns, len(learnt), positive.fitted()))
    unlabelled = rows.where("not trusted").select("key", "features")
    blocks = -(-m // BLOCK)
    # every third one is held out, by the key; blocks go by what is left of it
    blocked = unlabelled.where("key % 3 <> 2").withColumn("block", F.pmod(F.floor(F.col("key") / 3), F.lit(blocks)))

    def averaged(prior: float | None, steps: int) -> np.ndarray:
        fitted = blocked.repartition(blocks, "block").groupBy("block").applyInArrow(_fitted(shared, prior, steps), "feature long, total long")
        sums = fitted.groupBy("feature").agg(F.sum("total").alias("total")).toArrow()  # as many rows as learnt features
        total = np.zeros(len(learnt) + 2)
        total[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
        return total[:-1] / FRACTION / max(1, total[-1])

    theta = averaged(None, max(1, steps // 3))
    cuts = prior_cuts(positive.scores(theta[:-1], theta[-1])[positive.held])
    above = unlabelled.where("key % 3 = 2").mapInArrow(_above(shared, theta, cuts), "cut long, n long").groupBy("cut").agg(F.sum("n").alias("n")).orderBy("cut").collect()
    out = unlabelled.where("key % 3 = 2").count()
    if not out:
        return None
    prior = least_ratio(positive.scores(theta[:-1], theta[-1])[positive.held], cuts, np.array([r.n for r in above]) / out)
    theta = averaged(prior, steps)
    threshold = float(np.quantile(positive.scores(theta[:-1], theta[-1])[positive.held], LOST, method="lower"))
    full = np.zeros(_WIDTH, dtype=np.float32)
    full[learnt] = theta[:-1]
    shared.destroy()
    # as scores are computed from these weights, so is the threshold
    scale = float(np.finfo(np.float32).eps) * max(1.0, float(np.abs(theta).sum()))
    return Model(full, float(theta[-1]), prior, threshold - scale)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            score = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= model.threshold)], names=["doc_id", "score", "keep"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, score, keep)`` of every row of ``docs``."""
    source = texts_of(docs)
    model = trained(docs, labels, sample)
    if model is None:
        return source.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    return source.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, keep boolean")


def _kept(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in (p for b in batches for p in pieces(b)):
            yield batch.filter(pa.array(model.scores(batch.column(text_at)) >= model.threshold))

    return run


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, with all their columns."""
    model = trained(docs, labels, sample)
    if model is None:
        return docs
    bounded(docs.sparkSession)
    return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")), docs.schema)
