import hashlib
import re
import zlib

import numpy as np
import pytest

from corpuslens.llm import attention, decontaminate, language, mixing, passages, quality, scoring
from corpuslens.llm.arrays import LETTERS_DIGITS, NOT_SPACE, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_words_of_both_kinds():
    texts = ["The cat's ÉTÉ-x_9", "", " a\x0bb\xa0c ", "x" * 5000 + " y"]
    for pattern, table in ((WORD, LETTERS_DIGITS), (re.compile(r"[^\x20\x09-\x0D]+"), NOT_SPACE)):
        w = Words([t.encode() for t in texts], table)
        got = [w.bytes[a:b].decode() for a, b in zip(w.starts, w.ends)]
        assert got == [x for t in texts for x in pattern.findall(lower(t))]
        assert len(set(w.hashes.tolist())) == len(set(got))


def leaks(docs, items, window=10):
    wins = {}
    for item, text in items:
        ws = WORD.findall(lower(text))
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            wins.setdefault(tuple(ws[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        ws, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(ws) - size + 1):
                if items_ := wins.get(tuple(ws[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= items_
        ids = ",".join(sorted(found))
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two three four five six seven eight nine ten, eleven"), (20, "SHORT item"), (3, None), (4, "..."), (30, "short item!")]
TEXTS = [
    (1, "zero one two THREE four-five six seven eight nine ten"), (2, "a short item and a short item"), (3, None), (4, ""),
    (5, "one two three four five six seven eight nine"), (6, "one two three four five six seven eight nine ten eleven " * 50),
    (7, "item short"),
]


@pytest.mark.parametrize("most_windows", [200_000, 1])
def test_leaks_as_by_brute_force(spark, most_windows):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS items")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 AS hash")
    want = leaks(TEXTS, ITEMS)
    if most_windows > 1:
        assert sorted((tuple(r) for r in decontaminate.leak_report(docs, bench).collect()), key=str) == want
    got = decontaminate.find_leaks(docs, bench, most_windows=most_windows).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got) == [w[:4] for w in want]


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep, a short item here."), (2, "clean"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert dict(map(tuple, decontaminate.remove_spans(docs, bench).collect())) == {1: "Keep, a  here.", 2: "clean", 3: ""}


@pytest.mark.parametrize("most_windows", [1, 3, 200_000])
def test_parts_of_a_benchmark_do_not_change_what_is_cut(spark, most_windows):
    """Windows that overlap are cut together, whichever part they are sent in."""
    words_ = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words_)), (1, "w1 w2"), (None, None), (2, "")], "doc_id bigint, text string").selectExpr("*", "0 AS row", "1 AS hits")
    bench = spark.createDataFrame([(1, " ".join(words_[5:24]))], "item_id bigint, text string")
    got = decontaminate.remove_spans(docs, bench, most_windows=most_windows).collect()
    want = " ".join(words_[:5]) + "  " + " ".join(words_[24:])
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, ""), (1, want), (1, "w1 w2"), (2, "")]
    assert decontaminate.remove_spans(docs.limit(0), bench, most_windows=most_windows).collect() == []


def test_every_language_is_learned(spark):
    rows = [(k, f"{'abcdefghijklmnopqrst'[k % 20] * 3}{'bcdfghjklmnpqrs'[k // 20] * 3} ".join("x" * 12), f"l{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "0 AS rate", "1 AS _lang", "2 AS k")
    model = language.fit_languages(docs)
    assert len(set(model.languages)) == 300
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(docs, model).collect()}
    assert got == {k: f"l{k}" for k in range(300)}


def test_leaks_of_odd_and_no_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.leak_report(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.leak_report(no_docs, bench).collect() == []
    assert decontaminate.leak_report(odd_docs, bench.limit(0)).filter("contaminated").count() == 0


def test_targets_by_repeated_sharing(spark):
    sizes = [("a", 100), ("b", 5), ("c", 10), ("d", 0), (None, 300)]
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    total, open_, want = 415.0, {s for s, _ in sizes}, {}
    while True:
        left = total - sum(want.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * dict(sizes)[s]}
        if not over:
            break
        want |= {s: 3.0 * dict(sizes)[s] for s in over}
        open_ -= over
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint"), [1, 2, 3]).collect()}
    assert got == pytest.approx(want | share)


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["a", "b", "c", None][min(3, int(rng.integers(0, 9)))]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one = mixing.mix_sources(docs).toPandas()
    two = mixing.mix_sources(docs.repartition(5)).toPandas()
    key = ["doc_id"]
    assert one.sort_values(key).reset_index(drop=True).equals(two.sort_values(key).reset_index(drop=True))
    one["source"] = [dict((i, s) for i, _, s in rows)[i] or "null" for i in one.doc_id]
    for _, g in one.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60
    assert (one.taken <= 3 * one["size"]).all() and (one.taken % one["size"] == 0).all()


def test_mix_of_odd_and_no_rows(odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs)
    assert got.count() == odd_docs.count() and got.filter("taken > 3 * size").count() == 0
    assert mixing.mix_sources(no_docs).collect() == []


EN, FR = "the and of to in is that it was for with on as are be", "le la les de des un une et en que qui dans pour sur au"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        words = (EN if i % 2 else FR).split()
        good = i % 3 > 0
        text = " ".join(rng.choice(words, 40)) + ("" if good else " ###" * 20)
        rows.append((i, text, "en" if i % 2 else "fr", int(good)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")


def held_out(i, folds, which):
    return zlib.crc32(str(i).encode()) % folds == which


def test_languages_of_held_out_texts(labelled):
    want = {r.doc_id: r.lang for r in labelled.collect()}
    for r in language.identify_languages(labelled).collect():
        assert r.held_out == held_out(r.doc_id, 4, 2)
        assert r.lang_pred == want[r.doc_id] and not r.rejected and 0 <= r.score <= 1


def test_rejection_and_unknown(spark, labelled, odd_docs, no_docs):
    model = language.fit_languages(labelled)
    rng = np.random.default_rng(0)
    far = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x8000, 4000))
    docs = spark.createDataFrame([(1, far), (2, "1 2 3"), (3, None), (4, "the")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in language.predict_languages(docs, model).collect()}
    assert got[1].rejected and got[1].lang_pred in ("en", "fr") and not got[4].rejected
    assert (got[2].lang_pred, got[3].lang_pred, got[2].score) == ("und", "und", 0)
    assert language.identify_languages(odd_docs).count() == odd_docs.count()
    assert language.identify_languages(no_docs).collect() == []
    assert {r.lang_pred for r in language.predict_languages(docs, None).collect()} == {"und"}


def test_quality_of_held_out_texts(spark, labelled, odd_docs, no_docs):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")
    want = {r.doc_id: r.quality for r in labels.collect()}
    for r in quality.classify_quality(docs, labels).collect():
        assert r.held_out == held_out(r.doc_id, 5, 0) and (r.score > 0.5) == want[r.doc_id]
        assert r.predicted == int(r.score >= 0.3)
    assert quality.classify_quality(odd_docs, labels).count() == odd_docs.count()
    assert quality.classify_quality(no_docs, labels.limit(0)).collect() == []
    assert {r.score for r in quality.classify_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_repeats(labelled):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")
    one, two = quality.fit_quality(docs, labels), quality.fit_quality(docs.repartition(7), labels.repartition(3))
    assert (one == two).all()


def shared(rng, n):
    return " ".join(rng.choice(100_000, n).astype(str))


def test_passages_are_found_with_their_places(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    long, half_a, half_b = shared(rng, 80), shared(rng, 30), shared(rng, 30)
    fuzzy = long.split()
    fuzzy[40] = "other"
    del fuzzy[60]
    rows = [
        (1, f"{shared(rng, 20)} {long} {shared(rng, 50)}"),
        (2, f"{shared(rng, 7)} {long.upper()}"),
        (3, f"{' '.join(fuzzy)} {shared(rng, 9)}"),
        (4, f"{half_a} {shared(rng, 40)}"),
        (5, f"{shared(rng, 40)} {half_a} {half_b}"),
        (6, f"{half_a} {half_b} {shared(rng, 20)}"),
        (7, f"{half_a} {shared(rng, 20)}"),
        (8, None), (9, ""), (None, long),
        (10, " ".join([long] * 3)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS start", "2 AS seed", "3 AS doc")
    got = {(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end): r for r in passages.shared_passages(docs).collect()}
    assert (2, 1, 7, 87, 20, 100) in got and (3, 1, 0, 79, 20, 100) in got
    assert got[3, 1, 0, 79, 20, 100].matched == 78
    # Seeds of the first half point to document 4, all others to document 5, whose chain is extended to the left by MARGIN.
    assert {k[:4] for k in got if k[0] == 6} == {(6, 4, 0, 30), (6, 5, 34 - passages.MARGIN, 60)}
    assert {k[0] for k in got} == {2, 3, 6, 10}
    cut = dict(map(tuple, passages.cut_passages(docs.filter("doc_id IN (1, 2)"), passages.shared_passages(docs)).collect()))
    assert cut[1] == rows[0][1] and len(cut[2].split()) == 7
    assert passages.shared_passages(no_docs).collect() == []
    assert {(r.doc_id, r.other_id) for r in passages.shared_passages(odd_docs).collect()} == {(7, 6)}


@pytest.mark.parametrize("n_words, piece, changed", [(60, 10, 0), (50, 10, 0), (50, 40, 0), (80, 12, 1)])
def test_passages_are_found_whose_pieces_stand_in_earlier_documents(spark, n_words, piece, changed):
    """Every seed of a passage points to a document that has a few words of it."""
    rng = np.random.default_rng(n_words + piece)
    rows, want = [], {}
    for k in range(0, 10_000, 1000):
        words_ = shared(rng, n_words).split()
        pieces = [" ".join(words_[i : i + piece]) for i in range(0, n_words - piece + 1, 5 if piece < 20 else 2)]
        rows += [(k + i, f"{shared(rng, 9)} {x} {shared(rng, 9)}") for i, x in enumerate(pieces)]
        first, second = list(words_), list(words_)
        if changed:
            second[n_words // 2] = "changed"
        rows += [(k + 900, f"{shared(rng, 30)} {' '.join(first)} {shared(rng, 30)}"), (k + 901, f"{' '.join(second)} {shared(rng, 40)}")]
        want[k + 901] = k + 900
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r for r in passages.shared_passages(docs).collect() if want.get(r.doc_id) == r.other_id]
    # A chain over changed words may end short of the passage's ends.
    whole = [r for r in got if r.end - r.start >= (50 if changed else n_words)]
    assert {r.doc_id for r in whole} == set(want) and (changed or all(r.start == 0 for r in whole))


def test_equal_windows_are_covered(spark):
    """Texts of pieces drawn from a few pools: every run of 50 words that an earlier document has is covered by passages, but for its ends."""
    rng = np.random.default_rng(5)
    pool = [shared(rng, int(n)).split() for n in rng.integers(8, 70, 40)]
    texts = [[w for i in rng.integers(len(pool), size=6) for w in pool[i][int(rng.integers(5)) :]] for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id bigint, text string")
    covered = [np.zeros(len(x), dtype=bool) for x in texts]
    for r in passages.shared_passages(docs).collect():
        covered[r.doc_id][r.start : r.end] = True
    seen, missed = set(), 0
    for x, c in zip(texts, covered):
        windows = [tuple(x[i : i + 50]) for i in range(len(x) - 49)]
        missed += sum(w in seen and not c[i + 9 : i + 41].all() for i, w in enumerate(windows))
        seen |= set(windows)
    assert not missed


@pytest.mark.parametrize("n_words, every, least", [(55, 20, 0.95), (55, 15, 0.95), (80, 12, 0.9), (200, 10, 0.95), (200, 8, 0.9)])
def test_fuzzy_passages_are_found(spark, n_words, every, least):
    """Planted passages with one word in so many changed, and some with a word changed near an end; other texts share nothing."""
    rng = np.random.default_rng(n_words + every)
    rows, want = [], set()
    for k in range(40):
        words_ = shared(rng, n_words).split()
        changed = list(words_)
        for i in range(int(rng.integers(every)), n_words, every):
            changed[i] = f"changed{k}x{i}"
        near = list(words_)
        near[5 if k % 2 else -6] = "changed"
        rows += [(4 * k, f"{shared(rng, 30)} {' '.join(words_)} {shared(rng, 30)}"), (4 * k + 1, f"{shared(rng, 9)} {' '.join(changed)} {shared(rng, 50)}"),
                 (4 * k + 2, f"{shared(rng, 40)} {' '.join(near)}"), (4 * k + 3, shared(rng, 150))]
        want |= {4 * k + 1, 4 * k + 2}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.other_id) for r in passages.shared_passages(docs).collect()}
    assert all(a // 4 == b // 4 and a % 4 != 3 for a, b in got)
    caught = {a for a, _ in got}
    assert len([a for a in want if a % 4 == 2 and a in caught]) == 40
    assert len([a for a in want if a % 4 == 1 and a in caught]) >= least * 40


def test_chains_rise_in_both_texts():
    runs = [(0, 12, 0, 12), (13, 30, 14, 31), (5, 16, 90, 101), (32, 44, 2, 14)]
    found = passages.chains(sorted(runs))
    assert [(0, 12, 0, 12), (13, 30, 14, 31)] in found and sorted(r for c in found for r in c) == sorted(runs)


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(0)
    prior = attention.prior_of(rng.poisson(0.02, (attention.VOCABULARY, attention.VOCABULARY)).astype(float))
    w = {k: (v + 0.1 * rng.normal(size=v.shape)).astype(np.float32) for k, v in attention.initial(1).items()}
    return w, prior


def one_by_one(w, prior, ids):
    """Each subword scored alone, from the inputs that its window lets it see."""
    out, y = [], [attention.END, *ids, attention.END]
    for t in range(1, len(y)):
        start = (t - 1) // attention.SCORED * attention.SCORED - (attention.CONTEXT - attention.SCORED)
        seen = y[max(0, start) : t]
        x = w["embed"][seen].astype(float)
        s = (x @ w["k"]) @ (x[-1] @ w["q"]) / np.sqrt(attention.WIDTH) + w["near"][len(seen) - 1 - np.arange(len(seen))]
        a = np.exp(s) / np.exp(s).sum()
        h = np.tanh(x[-1] @ w["own"] + a @ (x @ w["v"]) @ w["seen"] + w["bias"])
        group, (kind, place) = y[t] // attention.PLACES, divmod(y[t] // attention.PLACES, attention.GROUPS)
        first = h @ w["classes"] + w["class_bias"] + prior.classes[seen[-1]]
        second = h @ w["groups"][kind] + w["group_bias"][kind] + prior.groups[seen[-1] * attention.CLASSES + kind]
        out.append(
            first[kind] - np.log(np.exp(first).sum()) + second[place] - np.log(np.exp(second).sum()) + prior.places[seen[-1], y[t]]
        )
        assert group < attention.CLASSES * attention.GROUPS
    return out


def test_windows_score_each_subword_once(trained):
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, attention.END, n) for n in (0, 1, 17, 18, 19, 100, 40)]
    want = [x for t in texts for x in one_by_one(*trained, t.tolist())]
    assert attention.log_probabilities(*trained, texts) == pytest.approx(want, abs=1e-3)


def test_probabilities_of_the_next_subword_sum_to_one(trained):
    texts = [np.array([7, 8, i]) for i in range(attention.END)]
    p = np.exp(attention.log_probabilities(*trained, texts).reshape(-1, 4))
    assert p[:, 2].sum() + np.exp(attention.log_probabilities(*trained, [np.array([7, 8])])[2]) == pytest.approx(1, abs=1e-3)


def test_gradients(trained):
    w, prior = ({k: v.copy() for k, v in trained[0].items()}, trained[1])
    rng = np.random.default_rng(2)
    windows, n = rng.integers(0, attention.VOCABULARY, (3, attention.CONTEXT + 1)), np.array([24, 5, 20])
    _, g = attention.gradients(w, prior, windows, n)
    for k in w:
        i = int(np.argmax(abs(g[k].ravel())))
        flat, old = w[k].ravel(), w[k].ravel()[i]
        flat[i] = old + 1e-2
        up, _ = attention.gradients(w, prior, windows, n)
        flat[i] = old - 1e-2
        down, _ = attention.gradients(w, prior, windows, n)
        flat[i] = old
        assert (up - down) / 2e-2 == pytest.approx(g[k].ravel()[i], rel=0.15, abs=2e-4)


@pytest.mark.parametrize("broadcast_words", [200_000, 3])
def test_base_scores_and_a_better_model(spark, broadcast_words):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, 30)) + (" Rare%d" % i)) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS word", "3 AS row")
    counts, n = {}, 0
    for i, t in rows:
        if not held_out(i, 5, 1):
            for w in [*lower(t).split(), None]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    for r in scoring.score_texts(docs, broadcast_words=broadcast_words).collect():
        tokens = [*lower(dict(rows)[r.doc_id]).split(), None]
        want = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held_out(r.doc_id, 5, 1), len(tokens), n)
        assert r.n_known == sum(w in counts for w in tokens)
        assert r.base_score == pytest.approx(want) and r.score < 0
        # A subword costs less than if all were alike.
        assert r.score > -np.log10(attention.VOCABULARY) * (len(lower(dict(rows)[r.doc_id]).encode()) + 1)


def test_scores_of_odd_and_no_rows(odd_docs, no_docs):
    got = scoring.score_texts(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    assert scoring.score_texts(no_docs).collect() == []


def test_training_windows_cover_whole_texts(spark):
    """Every subword and the end of every text is once what follows in a window."""
    texts = ["", "one", "some words of a text " * 3, "many different words in a long text " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = scoring.gathered(docs, scoring.subword_ranks(scoring.TOKENIZER)).collect()
    followed = sum(r.n for r in found if r.kind == scoring.PAIR)
    assert sum(r.n for r in found if r.kind == scoring.WINDOW) == followed > 400 * 7
