"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

Two words are alike by the triples of characters that they have in common, in order but not
necessarily adjacent: a triple counts ``DECAY`` for each character that it skips, and triples
wider than ``SPAN`` do not count. So a word with gaps or inserted characters still matches.
The kernel is divided by the norms, which are taken as if no triple occurred twice in a word (any
positive factor of each word keeps a kernel positive definite), and raised to the power ``POWER``.
The kernel of two sentences is the sum over their pairs of different words.

Nyström landmarks are words: some that tell toxic documents best, some at random. A sentence is
the sum of its words' vectors in the space of the landmarks. The machine is linear there, so a
sentence's value is a sum over its words, and each different word is worked out once in a task.

Labels belong to documents, and one insult makes a document toxic. So the machine learns from
sentences in rounds: all sentences of documents with label 0 are negative, and of each document
with label 1 the one that is worst by the last round is positive. A document's score is a sigmoid,
fitted to the labels, of the value of its worst sentence.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.arrays import NOT_SPACE, chunks, span_hashes, spans
from corpuslens.llm.folds import held_out, learned
from corpuslens.llm.scratch import stored

#: Decay of each skipped character, characters that a triple spans at most, power of the kernel.
DECAY, SPAN, POWER = 0.6, 8, 4
#: Landmarks that tell the labels apart, and random ones.
TELLING, RANDOM = 16, 48
#: Labelled documents that the machine is fitted on, at most, and their sentences at most.
SAMPLE, MOST_SENTENCES = 6_000, 400_000
#: Words of a sentence at most, and characters of a word; longer ones are several with half in common.
SENTENCE, LONGEST = 32, 24
#: Rounds of choosing the worst sentences, weight of the regulariser, Newton steps of a fit.
ROUNDS, RIDGE, STEPS = 6, 1.0, 20
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Different words that a task keeps the values of.
KEPT = 1_000_000
#: Characters as 32 classes: the end of a word, a-z, digits, other ASCII, three of other bytes.
EDGE, CLASSES = 31, 32
_CODE = np.array(
    [b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if 48 <= b <= 57 else 28 if b < 128 else 29 + b % 2 for b in range(256)],
    dtype=np.int32,
)
_ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_STOP = np.array([chr(b) in ".!?" for b in range(256)])


class Sentences:
    """The words of some texts: where they lie, their hashes, the sentence of each and the text of each sentence."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"\n".join(texts).lower()
        buffer = np.frombuffer(self.bytes, dtype=np.uint8)
        self.buffer = buffer
        starts, ends = spans(buffer, NOT_SPACE)
        text_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        owner = np.searchsorted(text_starts, starts, side="right") - 1
        if len(starts):
            # A sentence ends after a stop, at a line's end, at the text's end.
            line = np.cumsum(buffer == 10)[starts]
            stop = np.cumsum(np.concatenate(([0], _STOP[buffer[ends[:-1] - 1]])))
            new = np.concatenate(([True], (line[1:] != line[:-1]) | (stop[1:] != stop[:-1]) | (owner[1:] != owner[:-1])))
            first = np.flatnonzero(new)
            within = np.arange(len(starts)) - np.repeat(first, np.diff(np.concatenate((first, [len(starts)]))))
            sentence = np.cumsum(new | (within % SENTENCE == 0)) - 1
        else:
            sentence = owner
        self.owner = owner[np.flatnonzero(np.diff(sentence, prepend=-1))]
        self.count = len(self.owner)
        # Marks around a word go; a word of marks alone keeps them.
        at = np.flatnonzero(_ALNUM[buffer])
        a, b = np.searchsorted(at, starts), np.searchsorted(at, ends) - 1
        has = a <= b
        starts, ends = starts.copy(), ends.copy()
        starts[has], ends[has] = at[a[has]], at[b[has]] + 1
        starts, ends, sentence = self._spelled(starts, ends, sentence)
        n = np.maximum(1, -(-(ends - starts - LONGEST // 2) // (LONGEST // 2)))
        shift = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (LONGEST // 2)
        self.starts = np.repeat(starts, n) + shift
        self.ends = np.minimum(self.starts + LONGEST, np.repeat(ends, n))
        self.sentence = np.repeat(sentence, n)
        self.hashes = span_hashes(buffer, self.starts, self.ends)

    def _spelled(self, starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Three or more words of one character in a row become one word, with what stands between them."""
        one = ends - starts == 1
        same = one[1:] & one[:-1] & (sentence[1:] == sentence[:-1])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8))).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= 2]
        if not len(edges):
            return starts, ends, sentence
        drop = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(drop, edges[:, 0] + 1, 1)
        np.add.at(drop, edges[:, 1] + 1, -1)
        ends[edges[:, 0]] = ends[edges[:, 1]]
        keep = np.cumsum(drop[:-1]) == 0
        return starts[keep], ends[keep], sentence[keep]

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]]


def different(sentence: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The first place of each word number in each sentence."""
    order = np.lexsort((word, sentence))
    w, s = word[order], sentence[order]
    return order[np.concatenate(([True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])))[: len(order)]]


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The triples of places of a word of n characters and its two ends, and their weights, scaled to length one."""
    found = [
        (i, j, k) for i in range(n + 2) for j in range(i + 1, min(n + 2, i + SPAN)) for k in range(j + 1, min(n + 2, i + SPAN))
    ]
    places = np.array(found)
    weight = DECAY ** (places[:, 2] - places[:, 0] - 2.0)
    return places, (weight / np.sqrt((weight**2).sum())).astype(np.float32)


class Kernel:
    """Kernel values of words with landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        table = np.zeros((CLASSES**3, len(landmarks)), dtype=np.float32)
        for m, w in enumerate(landmarks):
            codes, weight = self._triples(np.frombuffer(w, dtype=np.uint8)[None, :])
            np.add.at(table[:, m], codes[0], weight)
        self.table = table

    def _triples(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the triples of words of one length, and their weights."""
        n = words.shape[1]
        if n not in self.places:
            self.places[n] = _places(n)
        places, weight = self.places[n]
        edge = np.full((len(words), 1), EDGE, dtype=np.int32)
        codes = np.hstack((edge, _CODE[words], edge))
        return (codes[:, places[:, 0]] * CLASSES + codes[:, places[:, 1]]) * CLASSES + codes[:, places[:, 2]], weight

    def values(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One row per word: its kernel with each landmark."""
        out = np.zeros((len(starts), self.table.shape[1]), dtype=np.float32)
        sizes = ends - starts
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            for some in np.split(rows, range(2048, len(rows), 2048)):
                codes, weight = self._triples(buffer[starts[some][:, None] + np.arange(n)])
                sums = np.zeros((len(some), out.shape[1]), dtype=np.float32)
                for t in range(len(weight)):
                    sums += self.table[codes[:, t]] * weight[t]
                out[some] = np.square(np.square(sums)) if POWER == 4 else sums**POWER
        return out


def whitening(kernel: Kernel, landmarks: list[bytes]) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix; directions that it hardly has are left out."""
    buffer = np.frombuffer(b"".join(landmarks), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in landmarks])
    k = kernel.values(buffer, ends - [len(w) for w in landmarks], ends).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-6 * value.max()
    return (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T


def _bytes(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("text").cast("string").cast("binary").alias("text"))


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(place, toxic, text) of the labelled documents with the smallest hash of the id, ``most`` at most."""
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(
        F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"),
        F.xxhash64("doc_id", F.lit("toxic")).alias("place"),
    )
    chosen = chosen.distinct().orderBy("place", "toxic").limit(most)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    return rows.select("place", "toxic", F.col("text").cast("string").cast("binary").alias("text"))


def landmarks_of(sample: DataFrame, telling: int = TELLING, random: int = RANDOM) -> dict[bytes, float]:
    """Landmarks and a first weight of each.

    They are the words of the sample that tell label 1 best by their documents, with the logarithm
    of their odds, and others by the order of their hash, with 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, toxic = b["text"].to_pylist(), np.array(b["toxic"].to_pylist())
            for lo, hi in chunks(texts):
                s = Sentences(texts[lo:hi])
                doc = s.owner[s.sentence]
                first = different(doc, s.hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.word(i) for i in first.tolist()], pa.binary()), pa.array(toxic[lo + doc[first]], pa.int32())],
                    ["word", "toxic"],
                )

    size = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in size}
    found = sample.mapInArrow(run, "word binary, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    counts = stored(found, "words")
    odds = F.log(((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("good") + 0.5) / (n.get(0, 0) + 1)))
    best = counts.filter("bad > 1").select("word", odds.alias("odds"), (F.col("bad") * odds).alias("worth"))
    best = best.filter("odds > 0").orderBy(F.desc("worth"), "word").limit(telling)
    other = counts.filter("bad + good > 1").orderBy(F.xxhash64("word"), "word").limit(random).select("word", F.lit(0.0).alias("odds"))
    # At most ``telling`` and ``random`` words; those that are both keep their odds.
    found = [(bytes(r["word"]), r["odds"]) for df in (other, best.select("word", "odds")) for r in df.collect()]
    return dict(found) or {b"-": 0.0}


def newton(z: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of the columns of z by squared hinge losses and a ridge on all but the last column, which is constant."""
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3 * ridge
    active = None
    for _ in range(steps):
        now = y * (z @ w) < 1
        if active is not None and np.array_equal(now, active):
            break
        active = now
        za = z[active]
        w = np.linalg.solve(za.T @ za + np.diag(penalty), za.T @ y[active])
    return w


def fit_machine(features: list[np.ndarray], toxic: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """(weights, a, b): of a sentence's features with a constant last; a document's probability is sigmoid(a x + b).

    features: the sentences of each document, ``start``: weights by which the first worst sentences
    are chosen. Without both labels the weights are 0 and the probability is the share of label 1.
    """
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    if len(set(toxic.tolist())) < 2:
        return np.zeros_like(start), 0.0, float(np.log(share / (1 - share)))
    counts = np.array([len(f) for f in features])
    ends = np.cumsum(counts)
    starts = ends - counts
    z = np.concatenate(features).astype(np.float64)
    good = np.flatnonzero(np.repeat(toxic == 0, counts))
    w, chosen = start, None
    for _ in range(rounds):
        value = z @ w
        last, chosen = chosen, np.array([s + int(np.argmax(value[s:e])) for s, e, t in zip(starts, ends, toxic) if t == 1])
        if last is not None and np.array_equal(last, chosen):
            break
        rows = np.concatenate((chosen, good))
        w = newton(z[rows], np.where(np.arange(len(rows)) < len(chosen), 1.0, -1.0))
    a, b = sigmoid_fit(np.maximum.reduceat(z @ w, starts), toxic)
    return w, a, b


def sigmoid_fit(x: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of the likeliest sigmoid(a x + b), with targets drawn in a little, as Platt's."""
    n1 = int(label.sum())
    n0 = len(label) - n1
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack((x, np.ones_like(x)), axis=1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = sigmoid(design @ w)
        step = np.linalg.solve((design.T * (p * (1 - p) + 1e-9)) @ design + 1e-6 * np.eye(2), design.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Machine:
    """What scoring needs: landmarks, the weight of each, the constant, and the sigmoid."""

    def __init__(self, landmarks: list[bytes], beta: np.ndarray, constant: float, a: float, b: float):
        self.landmarks, self.beta, self.constant, self.a, self.b = landmarks, beta, constant, a, b


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_sentences: int = MOST_SENTENCES,
    telling: int = TELLING, random: int = RANDOM,
) -> Machine:
    """The machine, from docs (doc_id, text) and labels (doc_id, toxic).

    At most ``most`` labelled documents are used, those whose id has the smallest hash; of these,
    in this order, those go that do not fit into ``most_sentences``. Their features are made in
    parallel and fitted by one task. Labels other than 0 and 1 and null texts are left out.
    Labels that contradict each other both count, and so does every row that repeats an id.
    """
    sample = stored(sample_of(docs, labels, most), "sample")
    first_weights = landmarks_of(sample, telling, random)
    landmarks = list(first_weights)
    white = whitening(Kernel(landmarks), landmarks)
    start = np.append(np.linalg.pinv(white) @ np.array(list(first_weights.values())), 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(landmarks)
        for b in batches:
            texts = b["text"].to_pylist()
            for lo, hi in chunks(texts):
                s = Sentences(texts[lo:hi])
                _, first, of = np.unique(s.hashes, return_index=True, return_inverse=True)
                vectors = kernel.values(s.buffer, s.starts[first], s.ends[first]) @ white.astype(np.float32)
                sums = np.ones((s.count, len(landmarks) + 1), dtype=np.float32)
                once = different(s.sentence, of)
                for k in range(len(landmarks)):
                    sums[:, k] = np.bincount(s.sentence[once], vectors[of[once], k], minlength=s.count)
                counts = np.bincount(s.owner, minlength=hi - lo)
                parts = np.split(sums, np.cumsum(counts)[:-1])
                # A text without words is one sentence without words.
                empty = np.zeros((1, len(landmarks) + 1), dtype=np.float32)
                empty[0, -1] = 1
                parts = [p if len(p) else empty for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [b["place"].slice(lo, hi - lo), b["toxic"].slice(lo, hi - lo),
                     pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["place", "toxic", "n", "features"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], most_sentences
        for b in batches:
            for n, toxic, data in zip(b["n"].to_pylist(), b["toxic"].to_pylist(), b["features"]):
                if n <= left:
                    rows.append((toxic, np.frombuffer(data.as_buffer(), dtype=np.float32).reshape(n, -1).copy()))
                    left -= n
        w, a, c = fit_machine([r[1] for r in rows], np.array([r[0] for r in rows], dtype=np.int64), start)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()]), pa.array([a]), pa.array([c])], ["w", "a", "b"])

    each = sample.mapInArrow(features, "place bigint, toxic int, n int, features binary")
    ordered = each.repartition(1).sortWithinPartitions("place", "toxic", "n", "features")
    r = ordered.mapInArrow(fit, "w array<double>, a double, b double").first()
    if r is None:
        return Machine(landmarks, np.zeros(len(landmarks)), 0.0, 0.0, 0.0)
    w = np.array(r["w"])
    return Machine(landmarks, white @ w[:-1], float(w[-1]), r["a"], r["b"])


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, worst) of each row of (doc_id, text): the probability of label 1 and the value of the worst sentence.

    Null, empty and blank texts have the score of a sentence without words.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    m = machine
    sent = docs.sparkSession.sparkContext.broadcast((m.landmarks, m.beta.astype(np.float32), m.constant, m.a, m.b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks, beta, constant, a, c = sent.value
        kernel = Kernel(landmarks)
        keys, known = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)
        for b in batches:
            texts = [t or b"" for t in b["text"].to_pylist()]
            worst = np.full(len(texts), -np.inf)
            for lo, hi in chunks(texts):
                s = Sentences(texts[lo:hi])
                u, first, of = np.unique(s.hashes, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
                new = keys[at] != u if len(keys) else np.ones(len(u), dtype=bool)
                value = np.zeros(len(u), dtype=np.float32)
                value[~new] = known[at[~new]] if len(keys) else 0
                f = first[new]
                value[new] = kernel.values(s.buffer, s.starts[f], s.ends[f]) @ beta
                once = different(s.sentence, of)
                sums = np.bincount(s.sentence[once], value[of[once]], minlength=s.count) + constant
                np.maximum.at(worst[lo:hi], s.owner, sums)
                if len(keys) + new.sum() > KEPT:
                    keys, known = u, value
                else:
                    both = np.concatenate((keys, u[new]))
                    order = np.argsort(both, kind="stable")
                    keys, known = both[order], np.concatenate((known, value[new]))[order]
            worst[np.isinf(worst)] = constant
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(sigmoid(a * worst + c)), pa.array(worst)], ["doc_id", "score", "worst"]
            )

    return _bytes(docs, "doc_id").mapInArrow(run, f"doc_id {id_type}, score double, worst double")


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from two thirds of the labelled ids, scored for all rows of ``docs``.

    Rows without an id are scored, but not learned from. Without labels all scores are alike.
    """
    ours = labels.filter(learned(F.col("doc_id"), FOLDS, HELD_OUT)).select("doc_id", "toxic")
    texts = docs.select("doc_id", "text")
    scored = score_toxicity(texts, fit_toxicity(texts, ours))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
