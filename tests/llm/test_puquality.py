"""Learning against the same sums in one place, the estimated share on made data, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapcat.llm import puquality as q
from snapcat.llm.langid import held_out


def test_describe():
    for text in (None, "", " \n\t", "x", "\x00", "é\n\né", "A. B!\nA. B!\n", "a " * 700_000, "#$%", "word"):
        own = q.describe(text)
        assert len(own) == len(q.FEATURES) and all(0 <= x <= 1 for x in own), (text, own)
    own = dict(zip(q.FEATURES, q.describe("One two, two.\none# TWO 12 (ß)\nOne two, two."), strict=True))
    n = 10
    assert own["distinct"] == 7 / n and own["most_frequent"] == 2 / n and own["repeats_last"] == 0 and own["lines_repeated"] == pytest.approx(1 / 3)
    assert own["capital_words"] == 1 / n and own["bare_words"] == 1 / n and own["odd_ends"] == 1 / n and own["lines_unended"] == pytest.approx(1 / 3)
    # A word is not seen twice where a long text is cut into blocks.
    long = "ab cd " * 900_000
    assert q.describe(long)[2] == 2 / 1_800_000 and q.describe(long)[5] == pytest.approx(1 - 2 / 1_799_999)


def test_hats():
    x = np.random.default_rng(1).random((50, len(q.FEATURES)))
    basis = q.hats(x)
    assert basis.shape == (50, q.WIDTH) and np.allclose(basis[:, 1:].reshape(50, -1, q.KNOTS).sum(2), 1)
    assert q.hats(np.zeros((0, len(q.FEATURES)))).shape == (0, q.WIDTH)


def made(spark, n, share, seed):
    """Good texts near 0.3 and bad ones near 0.7 in four features; a third of the good ones trusted."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    x = rng.random((n, len(q.FEATURES)))
    x[:, :4] = np.clip(rng.normal(np.where(good, 0.3, 0.7)[:, None], 0.08, (n, 4)), 0, 1)
    positive = good & (rng.random(n) < 0.33)
    frame = spark.createDataFrame([(v.tolist(), bool(p)) for v, p in zip(x, positive, strict=True)], "x array<double>, positive boolean").repartition(7)
    return frame, x, positive, good


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_learn(spark, share):
    frame, x, positive, good = made(spark, 6000, share, 11)
    model = q.learn(frame)
    assert abs(model.prior - share) < 0.03
    assert ((model.scores(x) >= 0.5) == good).mean() > 0.97


def test_pass_and_minimum(spark):
    frame, x, p, _ = made(spark, 500, 0.6, 12)
    basis = q.hats(x)
    w = np.random.default_rng(5).normal(size=q.WIDTH)
    z = basis @ w
    sums, s = q.pass_over(frame, w), 1 / (1 + np.exp(-z))
    assert np.allclose(sums[0, :5], [p.sum(), 500, np.log1p(np.exp(-z[p])).sum(), np.log1p(np.exp(z[p])).sum(), np.log1p(np.exp(z)).sum()])
    assert np.allclose(sums[1:4], [((s - 1)[:, None] * basis)[p].sum(0), (s[:, None] * basis)[p].sum(0), (s[:, None] * basis).sum(0)])
    curved = basis * (s * (1 - s))[:, None]
    assert np.allclose(sums[q.OF_P : q.OF_U], curved[p].T @ basis[p]) and np.allclose(sums[q.OF_U :], curved.T @ basis)

    def risk(w, prior):
        z = basis @ w
        bad = q.softplus(z).mean() - prior * q.softplus(z[p]).mean()
        return prior * q.softplus(-z[p]).mean() + q.SMOOTH * q.softplus(bad / q.SMOOTH) + 0.5 * q.RIDGE * (w[1:] ** 2).sum()

    rng = np.random.default_rng(6)
    # At 0.6 the risk on bad texts is held at zero, at 0.2 it is above.
    for prior in (0.6, 0.2):
        best = q.fit(frame, prior, np.zeros(q.WIDTH))
        assert all(risk(best, prior) <= risk(best + rng.normal(size=q.WIDTH) * size, prior) + 1e-6 for size in (0.01, 0.1, 1) for _ in range(20))


def labelled(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS positive", "0 AS score")
    return q.with_positives(frame, spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "1 AS id"))


def test_odd_rows(spark):
    docs = [(1, "Good text here."), (2, None), (2, None), (None, ""), (3, "###"), (4, "Good too.")]
    rows = labelled(spark, docs, [(1, 1), (1, 1), (4, 1), (4, 0), (None, 1), (2, None), (9, 1)])
    assert sorted((r.id or 0, r.positive) for r in rows.collect()) == [(0, False), (1, True), (2, False), (2, False), (3, False), (4, False)]
    found = q.scored(rows, q.learn(rows)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    none = labelled(spark, docs, [(3, 0)])
    assert [r.score for r in q.scored(none, q.learn(none)).collect()] == [0.0] * 6
    empty = labelled(spark, [], [(1, 1)])
    assert q.scored(empty, q.learn(empty)).count() == 0


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = q.op11_pu_quality(spark, sf_dir)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    known = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(known) > 80 and sum(r.predicted == r.quality for r in known) / len(known) > 0.95


def test_labels_of_held_out_rows_are_not_read(spark, sf_dir):
    rows = q.with_positives(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    some = q.learn(rows.where(~held_out("id")))
    flipped = rows.withColumn("positive", F.when(held_out("id"), ~F.col("positive")).otherwise(F.col("positive")))
    assert np.allclose(q.learn(flipped.where(~held_out("id"))).weights, some.weights, atol=1e-6)
