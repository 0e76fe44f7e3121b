import numpy as np
from helpers import odd_rows
from pyspark.sql import functions as F
from tabulon.llm import toxicity as X
from tabulon.llm.common import held_out
from tabulon.sources.tables import table


def brute_features(text):
    """n-grams and words as strings."""
    out = []
    for w in (text or "").lower().split():
        s = f" {w} "
        out += [s[i:i + n] for n in X.SIZES for i in range(len(s) - n + 1)] + [("word", w)]
    return out


def test_features_are_those_of_the_words():
    for t in ["", None, "  ", "a", "ab cd", "The IDIOT, idiot", "été 𝄞x y", "one two one"]:
        want = brute_features(t)
        got = X.features(t)
        assert len(got) == len(want)
        groups = {}
        for f in want:
            groups[f] = groups.get(f, 0) + 1
        assert sorted(np.unique(got, return_counts=True)[1].tolist()) == sorted(groups.values())
    assert set(X.features("idiot").tolist()) <= set(X.features("the idiot says").tolist())
    long = "some words " * 300_000
    assert len(X.features(long)) == 300_000 * len(X.features("some words"))


def test_misspellings():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(plain, 40)) for _ in range(300)]
    labels = [0] * 150 + [1] * 150
    texts[150:] = [t + " you stupid moron" for t in texts[150:]]
    scores, intercept = X.train(texts, labels, 0.5)
    logit = lambda t: np.log(X.score_text(t, scores, intercept)) - np.log1p(-X.score_text(t, scores, intercept))
    clean = [" ".join(rng.choice(plain, 40)) for _ in range(20)]
    spelt = np.array([logit(t + " you stupid moron") - logit(t) for t in clean])
    unseen = np.array([logit(t + " you stuppid morronn") - logit(t) for t in clean])
    neutral = np.array([logit(t + " the table is green") - logit(t) for t in clean])
    assert (spelt > 0).all() and (unseen > 0).all() and unseen.mean() > 0.4 * spelt.mean() and unseen.mean() > 2 * abs(neutral.mean())


def test_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    out = X.toxicity(docs, labels, ~held_out(F.col("doc_id"), 0)).join(labels, "doc_id").filter(held_out(F.col("doc_id"), 0)).toPandas()
    y, rank = out.toxic.to_numpy(), out.score.rank().to_numpy()
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) > 0.9
    assert set(out.predicted) <= {0, 1} and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)] + [(None, 1, 1), (3, None, None), (4, 0, 7)], "doc_id long, quality int, toxic int")
    out = X.toxicity(odd, labels, F.lit(True)).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((r[0] for r in odd_rows()), key=str) and all(0 <= r.score <= 1 for r in out)
    assert X.toxicity(none, labels, F.lit(True)).count() == 0
    for few, want in ((labels.filter("toxic = 1"), 1), (labels.filter("toxic = 0"), 0), (labels.limit(0), 0)):
        assert {r.predicted for r in X.toxicity(odd, few, F.lit(True)).collect()} == {want}
    kept = X.drop_toxic(odd, labels.filter("toxic = 0"), F.lit(True))
    assert kept.columns == odd.columns and kept.count() == len(odd_rows())


def test_bags_share_few_arrays():
    """Short arrays, one per text, would stay in the driver's memory after the training."""
    texts = [f"some words w{i} w{i * 7} idiot idiot" if i % 9 else None for i in range(X.SHARED * 2 + 5)]
    bags = X._bags(texts)
    for t, (ids, w) in zip(texts, bags, strict=True):
        f = X.features(t)
        want, n = np.unique(f, return_counts=True)
        assert ids.tolist() == want.tolist() and w.tolist() == (n / max(1, len(f))).astype(np.float32).tolist()
    assert X._bags([]) == [] and len({id(x.base) for bag in bags for x in bag}) <= 6
    ids = np.concatenate([b[0] for b in bags])
    rows, where = X._distinct(ids)
    want, place = np.unique(ids, return_inverse=True)
    assert rows.tolist() == want.tolist() and where.tolist() == place.tolist()
