import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslens.llm import naming, simhash
from corpuslens.llm.components import connected_components


def exact(docs, **options):
    return sorted((tuple(r) for r in naming.exact_duplicates(docs, **options).collect()), key=str)


@pytest.mark.parametrize("block_bytes", [3, 4096])
def test_equal_texts_are_those_equal_after_normalisation(spark, odd_docs, block_bytes):
    docs = odd_docs.filter("length(text) < 1000 OR text IS NULL")
    norm = {}
    for r in docs.collect():
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    got = naming.exact_duplicates(docs, block_bytes=block_bytes).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = next(v for v in norm.values() if r.doc_id in v)
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(ids))
        assert r.kept == (r.doc_id == r.keep_id)


def test_long_texts_and_digests(odd_docs):
    rows = {r.doc_id: r for r in naming.exact_duplicates(odd_docs).filter("doc_id IN (3, 6, 7)").collect()}
    assert rows[6].kept and rows[7].kept and rows[6].group_size == 1
    assert rows[3].text_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_contents_with_one_hash_get_different_names(spark):
    items = spark.createDataFrame([(0, 7, "a"), (1, 7, "b"), (2, 7, "a"), (3, 9, "a")], "row int, h bigint, content string")
    found = naming.clashes(items.select("h", "content"))
    assert sorted(map(tuple, found.collect())) == [(7, 0, "a"), (7, 1, "b")] or sorted(
        (r.h, r["rank"], r.content) for r in found.collect()
    ) == [(7, 0, "a"), (7, 1, "b")]
    named = {r.row: (r.h, r["rank"]) for r in naming.name_items(items, found).collect()}
    assert named == {0: (7, 0), 1: (7, 1), 2: (7, 0), 3: (9, 0)}


def test_exact_dedup_is_native(odd_docs):
    plan = naming.exact_duplicates(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_nothing_from_nothing(no_docs):
    assert exact(no_docs) == []
    assert simhash.near_duplicates(no_docs).collect() == []


def by_hand(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd_docs):
    docs = odd_docs.filter("length(text) < 1000 OR text IS NULL")
    want = {(r.doc_id, f"{by_hand(r.text, 3):016x}") for r in docs.collect()}
    rows = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.fingerprint) for r in rows} == want and len(rows) == docs.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3: 3, 4: 3, 5: 3}


def clusters(n_centers, seed):
    rng, out = np.random.default_rng(seed), set()
    for x in rng.integers(0, 2**64, n_centers, dtype=np.uint64):
        for _ in range(8):
            y = int(x)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                y ^= 1 << int(b)
            out.add(y)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("radius,most", [(3, 2_000_000), (3, 3_000), (2, 2_000_000)])
def test_links_join_what_lies_within_the_radius(spark, radius, most):
    fps = clusters(25, radius)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    want = simhash.forest(*np.nonzero(np.triu(near, 1)), len(fps))
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    links = simhash.near_links(df, most, radius).toPandas()
    place = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    got = simhash.forest(np.array([place[x] for x in links.u]), np.array([place[x] for x in links.v]), len(fps))
    assert (got == want).all()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i + 1, i) for i in range(60)]
    star = [(100 + i, 99) for i in range(1, 50)]
    roots = dict(map(tuple, connected_components(spark.createDataFrame(path + star, "u bigint, v bigint")).collect()))
    assert roots == {i: 0 for i in range(61)} | {99: 99} | {100 + i: 99 for i in range(1, 50)}
