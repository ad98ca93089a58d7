"""Random projection of sparse rows against signs drawn one by one."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from clickmill.functions.vectors import hash_uniform
from clickmill.operators import textvec


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30))) for i in range(40)]
    return spark.createDataFrame(rows, "id int, text string")


def sign(token: str, d: int, seed: int) -> float:
    return -1.0 if int(md5(f"{token}|{d}|{seed}".encode()).hexdigest()[:8], 16) / 2**32 < 0.5 else 1.0


@pytest.mark.parametrize("dim", [3, 62, 63, 130])
def test_signs_carried_or_joined_give_the_same_sums(docs, dim):
    bow = textvec.bag_of_words(docs, "id", F.col("text"))
    plain = textvec.tf_idf(bow, "id", docs).select("id", "token", "weight")
    carried = textvec.tf_idf(bow, "id", docs, textvec.token_signs(dim, 7))
    want = {}
    for r in plain.collect():
        sums = want.setdefault(r["id"], [0.0] * dim)
        for d in range(dim):
            sums[d] += r["weight"] * sign(r["token"], d, 7) / dim**0.5
    for rows in (plain, carried):
        got = {r["id"]: r["embedding"] for r in textvec.random_projection(rows, "id", dim, 7).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_signs_are_those_of_the_hash(spark):
    tokens = spark.range(500).select(F.concat(F.lit("t\u00e9"), "id").alias("token"))
    plus = hash_uniform(F.col("token"), F.lit(2), F.lit(42)) >= 0.5
    bit = textvec.token_signs(3).bitwiseAND(F.lit(4).cast("bigint")) != 0
    assert tokens.where(plus != bit).count() == 0
    assert 100 < tokens.where(plus).count() < 400


def test_weights_are_not_moved_again_for_their_projection(spark, docs):
    """Carried signs need one shuffle by token and one by document after the counts; the join of
    signs to the weights needed two more, and counted the words a second time."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bow = docs.select("id", F.explode(F.split("text", " ")).alias("token"), F.lit(1).alias("tf"))
        rows = textvec.tf_idf(bow, "id", docs, textvec.token_signs(4))
        flat = textvec.random_projection(rows, "id", 4)
        plan = flat._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning(id") == 1
    assert plan.count("Exchange hashpartitioning(token") == 2  # the rows, and the counts of a word
