import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import ledger as L
from corpuslens.plans.corpus import build_corpus, extend_corpus
from plans import plan


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string").select(L.ledger_key(F.col("v")).alias("key"), "v")


def test_keys_tell_values_and_nulls_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("n", None), (None, None), ("vab", None)]
    df = spark.createDataFrame(rows, "a string, b string").select(L.ledger_key(F.col("a"), F.col("b")).alias("key"))
    assert df.distinct().count() == len(rows) and {len(r.key) for r in df.collect()} == {16}


def test_filter_misses_nothing_and_lets_few_through(spark, tmp_path):
    blocks = 1 << 6
    led = L.Ledger(spark, str(tmp_path), blocks)
    n = blocks * L.KEYS_PER_BLOCK
    assert led.add(keys(spark, [f"in{i}" for i in range(n)]), "one") == n
    bits = led.bits(["one"])
    assert L.may_hold(keys(spark, [f"in{i}" for i in range(n)]), bits, blocks).count() == n
    assert led.passed(["one"], 20_000) < 0.02
    assert led.passed([]) == 0.0
    p = plan(L.block_filter(keys(spark, ["a"]), blocks))
    assert "partial_bit_or" in p and "Python" not in p


def test_new_keys_are_those_of_no_earlier_instalment(spark, tmp_path):
    r = random.Random(1)
    led, seen, names = L.Ledger(spark, str(tmp_path), 16), set(), []
    for k in range(4):
        values = [f"k{r.randrange(300)}" for _ in range(150)] + ["same", "same"]
        got = [x.v for x in led.new(keys(spark, values), names).collect()]
        assert sorted(got) == sorted(v for v in values if v not in seen)
        led.add(keys(spark, sorted(set(got))), f"part {k}")
        seen |= set(values)
        names.append(f"part {k}")
    assert led.new(keys(spark, []), names).count() == 0
    with pytest.raises(ValueError, match="no filter"):
        L.Ledger(spark, str(tmp_path), 32).new(keys(spark, ["a"]), names)


def pages(spark, n, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(60)) for _ in range(n // 3)]
    rows = [
        (f"http://h{r.randrange(3)}.org/{r.randrange(n // 2)}{r.choice(['', '/', '?x=1'])}", r.choice("pq"), f"{k:05d}", r.choice([*texts, None, "", "short"]))
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "url string, crawl string, fetch_time string, text string")


@pytest.mark.parametrize("cuts", [[0, 400], [0, 100, 110, 250, 400], [0, 0, 399, 400]])
def test_corpus_of_instalments_is_the_corpus_at_once(spark, tmp_path, cuts):
    everything = pages(spark, 400, 2)
    want = sorted(map(tuple, build_corpus(everything).collect()))
    got, names = [], []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = everything.filter(F.col("fetch_time").between(f"{lo:05d}", f"{hi - 1:05d}"))
        for _ in range(2):
            # Run twice, as after a failure: the second run replaces what the first stored.
            added = extend_corpus(part, str(tmp_path), f"i{k}", names, blocks=8).collect()
        got += map(tuple, added)
        names.append(f"i{k}")
    assert sorted(got) == want and len(want) > 50
    with pytest.raises(ValueError, match="before itself"):
        extend_corpus(everything, str(tmp_path), "i0", ["i0"])
