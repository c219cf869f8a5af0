"""Trained classifiers: folds, odd cases, held-out accuracy on the small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.llm import fitting, quality, toxicity
from evidara.llm.queries import op5_toxicity, op8_quality
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    for v in np.unique(score):
        ranks[score == v] = np.mean(np.flatnonzero(score[order] == v)) + 1
    p = label == 1
    return (ranks[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize("query, column, folds, held, least", [(op8_quality, "quality", 5, 0, 0.95), (op5_toxicity, "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, query, column, folds, held, least):
    rows = query(spark, SF).toPandas()
    assert len(rows) == 1000
    assert all(rows["held_out"] == [zlib.crc32(str(i).encode()) % folds == held for i in rows["doc_id"]])
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert auc(both["score"].to_numpy(), both[column].to_numpy()) > least


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_cases(spark, odd, none, no_labels, score):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(ODD))] + [(3, 0, 0), (None, 1, 1), (4, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, no_labels):
        rows = score(odd, own).collect()
        assert len(rows) == len(ODD) + 3
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert score(none, labels).count() == 0
    assert score(none, no_labels).count() == 0


def test_scores_ignore_ids_and_sources(spark, odd, no_labels):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(ODD))], "doc_id long, quality int, toxic int")
    moved = odd.withColumn("source", F.lit("zzz")).withColumn("lang", F.lit("zz"))
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        key = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in df.collect())
        assert np.allclose([s for _, s in key(score(odd, labels))], [s for _, s in key(score(moved, labels))])


def test_votes():
    import pyarrow as pa

    texts = ["you are a stupid idiot", "STUPID", "s**t happens", "stop!!!", "sooooo", None, "", "IDIOTS and pathetic LOSERS you", "fine words only"]
    votes, density, d, t, c = toxicity.signals(pa.array(texts))
    has = lambda i, name: bool(votes[i, toxicity.VOTERS.index(name)])
    assert has(0, "insult_person") and has(0, "insult_quality") and has(0, "at_someone") and has(0, "two_terms")
    assert has(1, "shouted_hit") and not has(0, "shouted_hit")
    assert has(2, "masked_word") and has(3, "bang_burst") and has(4, "stretched")
    assert not votes[[5, 6, 8]].any()
    assert [toxicity.TERMS[x] for x in t[d == 0]] == sorted(["stupid", "idiot"], key=toxicity.TERMS.index)


def test_words_outside_the_lexicon_are_learnt_from_labels(spark):
    rng = np.random.default_rng(3)
    syllables = "ba ke lo mi nu ra se to vi zu".split()
    word = lambda: "".join(rng.choice(syllables, 3))
    rows = []
    for i in range(1200):
        text, toxic = [word() for _ in range(60)], i % 6 == 0
        if toxic:  # a stem of no lexicon, with endings of its own each time
            for at in rng.choice(60, 6, replace=False):
                text[at] = "qualdrem" + word()
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity_scores(docs, labels).toPandas()
    held = found[found["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert held.loc[held["toxic"] == 1, "predicted"].mean() > 0.9
    assert held.loc[held["toxic"] == 0, "predicted"].mean() < 0.05


def test_held_out_toxicity_by_language(spark):
    """The words of a language need no lexicon: labels carry over to rows that training has not seen."""
    sf = "/root/testdata/sf0.1"
    found = op5_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    toxic, clean = found[found["toxic"] == 1], found[found["toxic"] == 0]
    assert toxic["predicted"].mean() >= 0.85 and clean["predicted"].mean() <= 0.03
    assert (toxic.groupby("lang")["predicted"].mean() >= 0.6).all() and len(toxic["lang"].unique()) == 4


def test_label_model_finds_the_accurate_voters():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.1
    v = np.zeros((len(y), len(toxicity.VOTERS)), bool)
    v[:, 0] = np.where(y, rng.random(len(y)) < 0.8, rng.random(len(y)) < 0.01)
    v[:, 1] = v[:, 0]  # repeats the first voter
    v[:, 2] = np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.02)
    v[:, 12] = rng.random(len(y)) < 0.2  # says nothing
    mask = (v * (1 << np.arange(v.shape[1]))).sum(1)
    kinds, back, n = np.unique(mask, return_inverse=True, return_counts=True)
    model = toxicity.LabelModel().fit(kinds, n.astype(float), np.zeros(len(kinds)), np.zeros(len(kinds)))
    assert abs(model.weights[12]) < 0.3 * model.weights[2]
    assert auc(model.posterior(kinds)[back], y.astype(int)) > 0.9


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random(5000)
    y = (rng.random(5000) < x**2).astype(float)
    iso = fitting.Isotonic(0, 1)
    iso.fit(iso.sums(x, y))
    grid = iso.apply(np.linspace(-1, 2, 200))
    assert (np.diff(grid) >= 0).all()
    assert abs(iso.apply(np.array([0.8]))[0] - 0.64) < 0.1


def plain_isotonic(x, y, low, high, bins):
    """Monotone means over the bins of a grid by the max-min formula; linear between the centres of equal values."""
    b = np.clip(((x - low) / (high - low) * bins).astype(int), 0, bins - 1)
    on = sorted(set(b.tolist()))
    n, ones, raw = (np.array([f(b == i) for i in on]) for f in (np.sum, lambda m: y[m].sum(), lambda m: x[m].sum()))
    c, s = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(ones)])
    fit = [max(min((s[j + 1] - s[a]) / (c[j + 1] - c[a]) for j in range(i, len(on))) for a in range(i + 1)) for i in range(len(on))]
    edges = [0, *(i for i in range(1, len(on)) if not np.isclose(fit[i], fit[i - 1], atol=1e-12)), len(on)]
    share = ones.sum() / n.sum()
    centres, values = zip(*(((raw[a:z].sum() / n[a:z].sum()), (ones[a:z].sum() + 0.5 * share) / (n[a:z].sum() + 0.5)) for a, z in zip(edges, edges[1:])))
    return lambda v: np.clip(np.interp(v, centres, np.maximum.accumulate(values)), 0, 1)


def test_quality_against_a_plain_fit(spark):
    """The same model by dense matrices in one place."""
    import pyarrow as pa

    from evidara.llm import textstats

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = sorted(docs)
    x = np.asarray(textstats.statistics(pa.array([docs[i] for i in ids])), float)
    learns = np.array([i in labels and zlib.crc32(str(i).encode()) % 5 != 0 for i in ids])
    y = np.array([labels.get(i, 0) for i in ids], float)
    mean, sd = x[learns].mean(0), x[learns].std(0)
    z = np.clip((x - mean) / np.where(sd > 1e-9, sd, 1.0), -quality.CLIP, quality.CLIP)
    rng, n = np.random.default_rng(quality.SEED), quality.FEATURES
    w = rng.normal(size=(x.shape[1], n)) / quality.WIDTH
    f = np.column_stack([np.sqrt(2 / n) * np.cos(z @ w + rng.uniform(0, 2 * np.pi, n)), np.ones(len(x))])
    own = f[learns]
    beta = np.linalg.solve(own.T @ own + np.diag([quality.RIDGE] * n + [0.0]) + 1e-9 * np.eye(n + 1), own.T @ y[learns])
    raw = f @ beta
    wanted = plain_isotonic(raw[learns], y[learns], -0.5, 1.5, fitting.Isotonic.BINS)(raw)
    got = {r["doc_id"]: r["score"] for r in op8_quality(spark, sf).collect()}
    assert np.allclose([got[i] for i in ids], wanted, atol=1e-6)


def test_toxicity_against_a_plain_fit(spark):
    """The label model by single rows, and the classifier's objective against gradient descent on a dense matrix."""
    from evidara.llm.common import cut

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    table = cut(toxicity.signal_table(docs).join(fitting.labels_of(labels, "toxic"), "doc_id", "left"))
    inner = fitting.fold(F.concat(F.lit("inner "), F.col("doc_id").cast("string")), toxicity.INNER).alias("inner")
    train = table.filter(fitting.fold(F.col("doc_id"), 4) != 2).select("*", inner)
    rows = train.orderBy("doc_id").collect()
    mask = np.array([r["mask"] for r in rows])
    known = np.array([r["label"] is not None for r in rows])
    y = np.array([r["label"] or 0.0 for r in rows])
    by_row = toxicity.LabelModel().fit(mask, (~known).astype(float), known * y, known * (1 - y))
    kinds = sorted(set(mask.tolist()))
    count = lambda on: np.array([float((on & (mask == m)).sum()) for m in kinds])
    model = toxicity.LabelModel().fit(np.array(kinds), count(~known), count(known & (y == 1)), count(known & (y == 0)))
    assert np.allclose(model.posterior(mask), by_row.posterior(mask), atol=1e-9)
    theta = toxicity.fit_linear(train, model)
    x = np.zeros((len(rows), toxicity.SIZE + toxicity.BUCKETS))
    x[:, : len(toxicity.VOTERS)] = toxicity.bits(mask)
    for k, r in enumerate(rows):
        for t, c in zip(r["terms"], r["counts"]):
            x[k, len(toxicity.VOTERS) + t] = np.log1p(c)
        for b, c in zip(np.frombuffer(bytes(r["buckets"]), "<u2"), bytes(r["times"])):
            x[k, toxicity.SIZE + b] = 10 * np.log1p(c) / np.sqrt(max(r["words"], 1))
        x[k, toxicity.SIZE - 2 : toxicity.SIZE] = min(100 * r["density"], 5), 1
    target = np.where(known, y, by_row.posterior(mask))
    penalty = np.concatenate([np.full(toxicity.SIZE - 1, toxicity.RIDGE), [1e-6], np.full(toxicity.BUCKETS, toxicity.BUCKET_RIDGE)])
    g = 1
    weight = np.where(known, 1.0, toxicity.UNLABELLED) * (np.array([r["inner"] for r in rows]) != g)

    def objective(t):
        z = x @ t
        return weight @ (np.logaddexp(0, z) - target * z) + 0.5 * penalty @ t**2, x.T @ (weight * (1 / (1 + np.exp(-z)) - target)) + penalty * t

    plain, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    step = 1.0 / (0.25 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + penalty.max())
    for k in range(900):  # accelerated descent
        value, slope = objective(plain + k / (k + 3) * velocity)
        after = plain + k / (k + 3) * velocity - step * slope
        plain, velocity = after, after - plain
    least, found = objective(plain)[0], objective(theta[g])[0]
    assert found <= least * 1.02 + 0.05
    assert np.mean((x @ plain > 0) == (x @ theta[g] > 0)) > 0.98


def test_counts_beyond_a_byte_count_in_full(spark):
    """A word's share of a long text goes in by its whole count."""
    rows = [(1, "word " * 300 + "other"), (2, "word " * 254 + "other"), (3, "word " * 70000), (4, "")]
    table = toxicity.signal_table(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toArrow().combine_chunks().to_batches()[0]
    row, _, value = toxicity._hashed(table)
    ids = table.column("doc_id").to_pylist()
    for i, (n, words) in {1: (300, 301), 2: (254, 255), 3: (70000, 70000)}.items():
        assert max(value[row == ids.index(i)]) == pytest.approx(10 * np.log1p(n) / np.sqrt(words))
