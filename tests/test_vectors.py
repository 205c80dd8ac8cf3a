"""Searches of all queries against brute force, with odd vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from schemascope import queries, rule_queries  # noqa: F401
from schemascope.operators import search


def cos(a, b):
    if a is None or b is None:
        return None
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 0.0 if len(a) != len(b) or not norm else sum(x * y for x, y in zip(a, b, strict=True)) / norm


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    near = [[float(rng.randrange(-8, 9)) / 8 for _ in range(6)] for _ in range(25)]
    vectors = [rng.choice(near) for _ in range(230)] + [[rng.random() for _ in range(6)] for _ in range(70)] + [None, [], [0.0] * 6, [1.0, 2.0]]
    rng.shuffle(vectors)
    return [(i, v, rng.choice([0, 1, 2, 3, None])) for i, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    yield path
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def single(rows):
    import numpy as np

    return [(i, None if v is None else [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def near(got, want):
    assert set(got) == set(want)
    for k, s in want.items():
        assert (got[k] is None) == (s is None) and (s is None or abs(got[k] - s) < 1.5e-6), (k, got[k], s)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_e01_every_pair(spark, rows, folder):
    x, df = single(rows), queries.QUERIES["e01_cosine"](spark, folder)
    near({(r.query, r.vec_id): r.score for r in df.collect()}, {(q, i): cos(v, u) for q, u, _ in x if q % 50 == 0 for i, v, _ in x})
    assert "Join" not in plan(df) and "CartesianProduct" not in plan(df)


def test_e02_every_pair_without_a_shuffle(spark, rows, folder):
    x, df = single(rows), queries.QUERIES["e02_batch_similarity"](spark, folder)
    near({(r.query, r.vec_id): r.score for r in df.collect()}, {(q, i): (0.0 if lab == 3 else cos(v, u) or 0.0) for q, u, _ in x if q % 50 == 0 for i, v, lab in x})
    assert "Exchange" not in plan(df) and "Join" not in plan(df)


def test_e07_greatest(spark, rows, folder):
    x, df = single(rows), queries.QUERIES["e07_max_score"](spark, folder)
    want = {q: max((s for i, v, _ in x if i != q and (s := cos(v, u)) is not None), default=None) for q, u, _ in x if q % 50 == 0}
    near({r.query: r.score for r in df.collect()}, {q: s for q, s in want.items() if s is not None})
    assert "Join" not in plan(df) and "CartesianProduct" not in plan(df)


def test_e06_best_of_each_label(spark, rows, folder):
    x, want = single(rows), set()
    for q, u, _ in x:
        if q % 50 == 0:
            for label in (0, 1, 2, 3, None):
                best = sorted((-s, i) for i, v, lab in x if lab == label and (s := cos(v, u)) is not None and s >= 0.1)[:5]
                want |= {(q, label, i) for _, i in best}
    df = queries.QUERIES["e06_scoped_top"](spark, folder)
    got = [tuple(r) for r in df.select("query", "label", "vec_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(lab is None for _, lab, _ in got)
    assert "Join" not in plan(df) and "CartesianProduct" not in plan(df)


def test_too_many_queries_are_an_error_and_none_give_no_rows(spark, folder):
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = v.select(F.col("vec_id").alias("query"), "embedding")
    with pytest.raises(ValueError):
        search.pair_scores(v, asked, "vec_id", most_queries=10)
    none = asked.where("query < 0")
    assert search.pair_scores(v, none, "vec_id").count() == search.best_scores(v, none, "vec_id").count() == search.scoped_top_each(v, none, 5, "vec_id", "label").count() == 0
