import numpy as np
import pyarrow as pa
import pytest

from stratalith.llm import quality
from tests.llm import tables


def test_features_by_hand():
    text = "One two, two!\nOne two, two!\nA1"
    x = dict(zip(quality.FEATURES, quality.features(pa.array([None, text, "", "x y"]))[1], strict=True))
    n = len(text)
    assert x["share_lower"] == sum(c.islower() for c in text) / n
    assert x["share_upper"] == sum(c.isupper() for c in text) / n
    assert x["share_digit"] == 1 / n
    assert x["share_exclamation"] == 2 / n
    assert x["log_words"] == pytest.approx(np.log1p(7))
    assert x["distinct_words"] == 4 / 7
    assert x["commonest_word"] == 2 / 7
    assert x["distinct_lines"] == 2 / 3
    assert x["mean_word"] == pytest.approx(sum(map(len, text.split())) / 7)


def test_features_do_not_depend_on_the_block():
    texts = [" ".join(tables.soup(i, i * 3)) for i in range(20)] + [None, "", "\n\n"]
    whole = quality.features(pa.array(texts))
    each = np.vstack([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, each)


def _walk(forest, row):
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_flat_traversal_equals_walking_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x, y, trees=15)
    assert np.allclose(forest.margin(x[:50]), [_walk(forest, r) for r in x[:50]])
    fresh = rng.normal(size=(600, 5))
    assert ((forest.margin(fresh) > 0) == ((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0.3))).mean() > 0.9


@pytest.mark.parametrize("seed", range(4))
def test_splits_are_those_of_an_exhaustive_search(seed):
    """Histograms with a bin for each value against every threshold of every feature, tried row by row."""
    rng = np.random.default_rng(seed)
    n, width, many, penalty, least = 60, 4, 3, 1.0, 5
    x = rng.integers(0, 12, (n, width)).astype(float)
    grad, hess, node = rng.normal(size=n), rng.random(n) * 0.25, rng.integers(0, many, n)
    cuts = [np.unique(x[:, f]) for f in range(width)]
    bins = max(map(len, cuts)) + 1
    flat = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]) + np.arange(width) * bins
    feature, threshold = quality.split(flat, cuts, bins, grad, hess, node, many, penalty, least)
    gain = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + penalty)
    for k in range(many):
        own = node == k
        tried = {}
        for f in range(width):
            for t in cuts[f]:
                left, right = own & (x[:, f] <= t), own & (x[:, f] > t)
                if left.sum() >= least and right.sum() >= least:
                    tried[f, t] = gain(left) + gain(right) - gain(own)
        best = max(tried.values(), default=-1)
        if best <= 1e-9:
            assert np.isinf(threshold[k])
            continue
        assert tried[feature[k], threshold[k]] == pytest.approx(best)


def test_boosting_adds_what_leaves_should_hold():
    """Of one stump fitted by hand: leaves are minus rate times gradient over hessian plus penalty."""
    x = np.array([[0.0], [0.0], [1.0], [1.0]] * 10)
    y = np.array([0.0, 0.0, 1.0, 0.0] * 10)
    forest = quality.fit(x, y, trees=1, depth=1, rate=0.5, least=1)
    p = y.mean()
    leaf = lambda side: -0.5 * (p - y[side]).sum() / (side.sum() * p * (1 - p) + 1)
    assert np.allclose(forest.margin(np.array([[0.0], [1.0]])), np.log(p / (1 - p)) + np.array([leaf(x[:, 0] == 0), leaf(x[:, 0] == 1)]))


def test_ids_of_any_integer_type_and_repeated_ids(spark):
    d = tables.docs(spark, [(1, "good text here"), (1, "another text"), (2, "b"), (None, "c")] * 3)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id int, quality int")
    narrow = d.withColumn("doc_id", d["doc_id"].cast("int"))
    found = quality.quality_scores(narrow, labels)
    assert found.schema["doc_id"].dataType.simpleString() == "bigint" and found.count() == 12


def test_one_class_is_a_constant():
    assert np.allclose(quality.fit(np.ones((5, 2)), np.ones(5)).score(np.ones((3, 2))), 0.999)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("xxhash64(doc_id) % 3 <> 0"), labels.where("xxhash64(doc_id) % 3 = 0")
    found = quality.quality_scores(d, train).join(test, "doc_id").selectExpr("avg(int(keep = (quality = 1))) a", "avg(if(quality = 1, int(keep), null)) k").first()
    assert found["a"] > 0.85 and found["k"] > 0.9


def test_irregular_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (7, 0), (None, 1), (8, None), (999, 1)], "doc_id long, quality int")
    d = tables.messy(spark)
    scored = quality.quality_scores(d, labels).collect()
    assert len(scored) == d.count()
    assert all(r["score"] is not None and r["keep"] == (r["score"] >= 0.5) for r in scored)
    kept = quality.drop_low_quality(d, labels)
    assert kept.schema == d.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in scored if r["keep"])


@pytest.mark.parametrize("label_rows", [[], [(1, 0)]])
def test_empty_tables(spark, label_rows):
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int")
    assert quality.quality_scores(tables.empty(spark), labels).count() == 0
    assert quality.drop_low_quality(tables.empty(spark), labels).count() == 0
    assert quality.quality_scores(tables.docs(spark, [(1, "a b")]), labels).count() == 1
