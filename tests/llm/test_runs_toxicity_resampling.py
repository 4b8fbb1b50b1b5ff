import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import periods, resampling, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def runs_by_brute_force(w, times=4, least=6):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                x = w[i : j + q]
                if not any(x[d:] == x[: len(x) - d] for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(text, doc_id):
    w = SPACE.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def report_by_brute_force(doc_id, text):
    w = looped(text, doc_id)
    runs = runs_by_brute_force(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (
        doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def invented(seed, n_docs=120, most=90):
    r = random.Random(seed)
    out = []
    for d in range(n_docs):
        w = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.randrange(most))]
        out.append((d, r.choice([" ", "\n", " \t "]).join(w)))
    return out


@pytest.mark.parametrize("times, least", [(4, 6), (2, 2), (3, 7), (5, 4)])
def test_runs_as_by_brute_force(times, least):
    texts = [t for _, t in invented(3, 400)]
    got = periods.runs_in([t.encode() for t in texts], times, least)
    assert got == [runs_by_brute_force(t.split(), times, least) for t in texts]
    assert any(got)


def test_a_lag_with_several_stretches():
    """Equal words at all multiples of a lag, of which only two stretches are periodic."""
    r = random.Random(1)
    block, other = [str(r.random()) for _ in range(9)], []
    for k in range(30):
        other += ["the", *(block if 3 <= k < 8 or 15 <= k < 22 else [str(r.random()) for _ in range(9)])]
    got = periods.runs_in([" ".join(other).encode()])[0]
    assert got == runs_by_brute_force(other) and len(got) == 2


def test_hard_texts_stay_cheap():
    fib = ["a", "b"]
    words = ["b", "a"]
    while len(words) < 20000:
        words, fib = words + fib, words
    for w in (["x"] * 50000, [str(i % 700) for i in range(50000)], words):
        assert len(periods.runs_in([" ".join(w).encode()])[0]) == (0 if w is words else 1)


def test_run_report_of_odd_rows_as_by_brute_force(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(d + 1000, t) for d, t in invented(4)] + [(d, "one two three four five six seven " * 9) for d in range(200, 260)], "doc_id bigint, text string")
    docs = docs.selectExpr("*", "1 AS runs", "2 AS g").unionByName(odd_docs.selectExpr("doc_id", "text", "1 AS runs", "2 AS g"))
    want = Counter(report_by_brute_force(r.doc_id, r.text) if r.text is None or len(r.text) < 9000 else None for r in docs.collect())
    got = [tuple(r) for r in periods.run_report(periods.with_loops(docs)).collect()]
    long = [g for g in got if g[0] in (6, 7)]
    assert Counter([g for g in got if g[0] not in (6, 7)] + [None] * 2) == want
    # The long texts repeat three words 20,000 times, unless their ids are altered.
    assert [g[4] for g in long] == [3, 3]
    assert periods.run_report(periods.with_loops(no_docs)).collect() == []


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so no no no no no no\tend é"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.collapsed, r.runs) for r in periods.periodic_runs(docs).collect()}
    assert got[1][0] == "so no end é" and [tuple(x) for x in got[1][1]] == [(1, 6, 1)]
    assert got[2] == ("", [])


# Toxicity


def kernel_by_brute_force(a, b):
    def weights(w):
        c = [toxicity.EDGE, *toxicity._CODE[np.frombuffer(w, dtype=np.uint8)].tolist(), toxicity.EDGE]
        found, norm = Counter(), 0.0
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    x = toxicity.DECAY ** (k - i - 2)
                    found[c[i], c[j], c[k]] += x
                    norm += x * x
        return found, math.sqrt(norm)

    (fa, na), (fb, nb) = weights(a), weights(b)
    return (sum(x * fb[t] for t, x in fa.items()) / (na * nb)) ** toxicity.POWER


def test_kernel_as_by_brute_force():
    words = [b"idiot", b"id.iot", b"i d i o t", b"a", b"pathetic", b"path", "é".encode(), b"x" * 24]
    k = toxicity.Kernel(words[:4])
    buffer = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = k.values(buffer, ends - [len(w) for w in words], ends)
    want = [[kernel_by_brute_force(a, b) for b in words[:4]] for a in words]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6)
    white = toxicity.whitening(k, words[:4])
    gram = np.array(want[:4])
    assert np.allclose(white @ gram @ white.T, np.eye(4), atol=1e-3)


def test_gaps_and_inserted_characters_keep_words_alike():
    for near in (b"id.iot", b"idixot", b"i.d.i.o.t", b"idioot"):
        assert kernel_by_brute_force(b"idiot", near) > 3 * kernel_by_brute_force(b"idiot", b"notion")


def test_sentences_and_their_words():
    s = toxicity.Sentences(["Ab, cd! (Ef) gh.\nI D i o t was".encode(), b"", b"--", b"z" * 40])
    words = [(int(s.owner[s.sentence[i]]), int(s.sentence[i]), s.word(i)) for i in range(len(s.starts))]
    assert words == [
        (0, 0, b"ab"), (0, 0, b"cd"), (0, 1, b"ef"), (0, 1, b"gh"), (0, 2, b"i d i o t"), (0, 2, b"was"), (2, 3, b"--"),
        (3, 4, b"z" * 24), (3, 4, b"z" * 24), (3, 4, b"z" * 16),
    ]
    many = toxicity.Sentences([b"w " * 100])
    assert many.count == 4 and toxicity.Sentences([]).count == 0


BAD = ["idiot", "moron", "scumbag", "pathetic"]


def labelled(n, seed):
    """Texts of three sentences; those with an insult are toxic."""
    r = random.Random(seed)
    usual = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    rows = []
    for d in range(n):
        toxic = d % 4 == 0
        sentences = [[r.choice(usual) for _ in range(r.randrange(4, 12))] for _ in range(3)]
        if toxic:
            sentences[r.randrange(3)].insert(r.randrange(4), r.choice(BAD))
        rows.append((d, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def machine_rows(spark):
    rows = labelled(1200, 7)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").selectExpr("*", "0 AS toxic", "0 AS place", "1 AS score")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int").selectExpr("*", "'x' AS text")
    return rows, docs, labels


def test_held_out_accuracy_and_obfuscated_insults(spark, machine_rows):
    rows, docs, labels = machine_rows
    got = {r.doc_id: r for r in toxicity.classify_toxicity(docs, labels).collect()}
    label = {r[0]: r[2] for r in rows}
    fold = {d for d in label if zlib.crc32(str(d).encode()) % 3 == 1}
    assert {d for d, r in got.items() if r.held_out} == fold and len(got) == len(rows)
    assert np.mean([got[d].predicted == label[d] for d in fold]) > 0.97
    machine = toxicity.fit_toxicity(docs, labels)
    texts = ["What an i-diot he is", "such a mo.ron", "you p a t h e t i c one", "an idixot there", "the usual things here", "", None, " . "]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    worst = {r.doc_id: r.worst for r in toxicity.score_toxicity(asked, machine).collect()}
    assert min(worst[k] for k in range(4)) > worst[4] and worst[5] == worst[6]
    assert toxicity.fit_toxicity(docs, labels).b == machine.b


def test_labels_of_the_held_out_fold_do_not_matter(spark, machine_rows):
    _, docs, labels = machine_rows
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.classify_toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_toxicity_of_odd_and_no_rows(spark, odd_docs, no_docs, machine_rows):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1), (8, 0), (8, 0), (None, 1), (4, None), (9, 7), (6, 0)], "doc_id bigint, toxic int")
    got = toxicity.classify_toxicity(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.classify_toxicity(odd_docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.classify_toxicity(no_docs, labels).collect() == []


def test_documents_beyond_the_sentence_bound_are_left_out(spark, machine_rows):
    _, docs, labels = machine_rows
    few = toxicity.fit_toxicity(docs, labels, most_sentences=0)
    assert few.a == 0 and not few.beta.any()


# Resampling


def resampled_by_brute_force(docs, target, order, buckets, percent, min_words):
    def grams(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    each = [(d, *grams(t)) for d, t in docs]
    s = Counter(bucket(g) for _, _, gs in each for g in gs)
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    rows = []
    for d, w, gs in each:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(sha(f"2024:{'null' if d is None else d}")[:8], 16)
        rows.append([d, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("order, buckets, percent, min_words", [(1, 10_000, 10, 20), (3, 97, 50, 3), (2, 1, 100, 0)])
def test_draw_as_by_brute_force(spark, odd_docs, no_docs, order, buckets, percent, min_words):
    r = random.Random(order)
    docs = [(d, " ".join(r.choice(["alpha", "Beta", "gam-ma", "delta9", "É"]) for _ in range(r.randrange(60)))) for d in range(300)]
    odd = [(x.doc_id, x.text) for x in odd_docs.collect()]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").unionByName(odd_docs.select("doc_id", "text"))
    target = ["alpha alpha beta", None, "", "the cat"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    frame = frame.selectExpr("*", "1 AS place", "2 AS part", "3 AS rank", "4 AS weight", "5 AS ahead")
    got = resampling.resample(frame, bench, order, buckets, percent, min_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_brute_force(docs + odd, target, order, buckets, percent, min_words)
    assert resampling.resample(no_docs, bench).collect() == []
    none = resampling.resample(frame, bench.limit(0), order, buckets, percent, min_words)
    assert sorted(map(tuple, none.collect()), key=str) == resampled_by_brute_force(docs + odd, [], order, buckets, percent, min_words)


def test_equal_hashes_do_not_make_equal_ngrams():
    grams = [b"a", b"b", b"a", b"c", b"b", b"a"] * 3
    for digest in (lambda g: 7, lambda g: 2**64 - 1 if g == b"c" else 2**64 - 2, len):
        t = resampling.Interned(grams, 1000, digest)
        slots = {g: {int(s) for s, x in zip(t.slot, grams) if x == g} for g in set(grams)}
        assert all(len(s) == 1 for s in slots.values()) and len(set.union(*slots.values())) == 3
        assert {g: int(t.count[s.pop()]) for g, s in slots.items()} == {b"a": 9, b"b": 6, b"c": 3}
    empty = resampling.Interned([], 10)
    assert len(empty.used) == 0 and len(empty.slot) == 0
