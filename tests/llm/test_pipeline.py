import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalith.llm import mixing, neardup, quality, tokens
from stratalith.llm.common import written_paths
from stratalith.llm.minhash import MinHash, signatures
from stratalith.llm.queries import ORACLE_SQL, QUERIES
from tests.differ import duck_rows, spark_rows
from tests.llm import tables


def _labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def _corpus():
    """Good and bad texts, copies, near copies, a hot source, repeated rows, nulls, and a text longer than a window."""
    r = random.Random(9)
    rows, labels = [], []
    for i in range(90):
        good = i % 5 != 0
        words = tables.soup(i, 70, 3000) if good else ["!!!", "$$", "BUY"] * 25
        text = " ".join(words) + ("." if good else f" {i}" * (i % 3))
        rows.append((i, text, "en" if i % 4 else "de", "hot" if i % 3 else f"s{i % 2}"))
        labels.append((i, int(good), 0))
    rows += [(100 + i, rows[i][1], "en", "copy") for i in range(0, 40, 2)]
    rows += [(200 + i, " ".join(w if r.random() > 0.02 else "changed" for w in rows[i][1].split()), "en", "near") for i in range(1, 40, 3)]
    rows += [(300, " ".join(tables.soup(77, 9000, 9000)), "en", "long"), (301, None, "en", "hot"), (302, "", None, "hot"), (None, "a lonely text", "en", "hot"), (303, " ".join(tables.soup(78, 50, 5000)), None, None)]
    return rows + [rows[3], rows[3]], labels


def _kept_by_model(spark, docs, folder):
    forest = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def keep(text):
        x, total = quality.features(pa.array([text], pa.string()))[0], forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return total >= 0

    return Counter(tuple(r) for r in docs.collect() if keep(r["text"]))


def _kept_of_copies(docs):
    least, out = {}, Counter()
    for row in docs.collect():
        if row["doc_id"] is None or row["text"] is None:
            out[tuple(row)] += 1
        elif row["text"] not in least or row["doc_id"] < least[row["text"]]["doc_id"]:
            least[row["text"]] = row
    return out + Counter(tuple(r) for r in least.values())


def _kept_of_near_copies(docs):
    """All pairs of signatures, by union and find."""
    p = MinHash()
    signed = {r["doc_id"]: r for r in signatures(docs, p).collect()}
    root = {i: i for i in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            agree = sum(x == y for x, y in zip(signed[a]["sketch"], signed[b]["sketch"], strict=True))
            if a < b and set(signed[a]["bands"]) & set(signed[b]["bands"]) and agree >= (neardup.THRESHOLD * 255 / 256 + 1 / 256) * p.size:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return Counter(tuple(r) for r in docs.collect() if root.get(r["doc_id"], r["doc_id"]) == r["doc_id"])


def _mixed(docs):
    """Every pattern's documents sorted whole, by place and doc_id."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id"), 34)
    rows = [(r, len((r["text"] or "").split()), r["place"]) for r in docs.withColumn("place", place).collect()]
    by = {}
    for r, n, at in rows:
        if r["doc_id"] is not None:
            by.setdefault(tuple(sorted(f"{k}:{r[c]}" for k, c in (("source", "source"), ("lang", "lang")) if r[c] is not None)), []).append((at, r["doc_id"], n, r))
    patterns = sorted(by)
    tokens = [sum(x[2] for x in by[p]) for p in patterns]
    names = sorted({s for p in patterns for s in p})
    held = {s: sum(n for p, n in zip(patterns, tokens, strict=True) if s in p) for s in names}
    share = {s: held[s] ** mixing.POWER for s in names}
    quotas = [int(sum(tokens) * share[s] / sum(share.values())) for s in names]
    given = Counter()
    for (p, _), n in mixing.route(tokens, [[names.index(s) for s in p] for p in patterns], quotas).items():
        given[p] += n
    out = Counter(tuple(r)[:-1] for r, _, _ in rows if r["doc_id"] is None)
    for k, p in enumerate(patterns):
        left = given[k] % tokens[k] if tokens[k] else 0
        for _, _, n, r in sorted(by[p], key=lambda x: x[:2]):
            left -= n
            times = (given[k] // tokens[k] + (left >= 0)) if n else 1
            out[tuple(r)[:-1]] += times
    return +out


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = _corpus()
    tables.docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    _labels(spark, tmp_path, labels)
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, folder = seen.columns, str(tmp_path)
    brute = {"quality": lambda d: _kept_by_model(spark, d, folder), "exact_dedup": _kept_of_copies, "near_dedup": _kept_of_near_copies, "mixing": _mixed}
    sizes = [seen.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, folder).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name in brute:
            assert now.columns == columns
            assert Counter(tuple(r) for r in now.collect()) == brute[name](seen), name
            sizes.append(now.count())
        else:
            used, given, encode = Counter(), Counter(), tokens.counter(tokens.VOCABULARY).encode
            for r in seen.where("doc_id IS NOT NULL").collect():
                given.update((r["doc_id"], k) for k in range(len(encode(r["text"] or ""))))
            for w in now.collect():
                assert w["used"] == sum(w["lengths"]) <= 4096
                for i, s, n in zip(w["doc_ids"], w["starts"], w["lengths"], strict=True):
                    used.update((i, k) for k in range(s, s + n))
            assert used == given
        seen = now
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]


def test_irregular_table(spark, tmp_path):
    rows = [(1, "a good text"), (1, "a good text"), (2, None), (3, ""), (None, "x"), (4, " ".join(tables.soup(1, 9000)))]
    tables.docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    _labels(spark, tmp_path, [])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    used = Counter()
    for w in found:
        for i, n in zip(w["doc_ids"], w["lengths"], strict=True):
            used[i] += n
    assert set(used) <= {1, 4} and used[4] % len(tokens.counter(tokens.VOCABULARY).encode(rows[-1][1])) == 0


def test_empty_table(spark, tmp_path):
    tables.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    _labels(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_result_stays_on_disk(spark, tmp_path):
    rows, labels = _corpus()
    tables.docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    _labels(spark, tmp_path, labels)
    before = set(written_paths(spark))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(written_paths(spark)) - before) == 1 and out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(folder, ORACLE_SQL[name])
