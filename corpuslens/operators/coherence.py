"""How good topics are, measured on texts rather than on the fit: coherence and completion of documents."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import bind
from corpuslens.operators.counting import Runs, listed, lowered, portions
from corpuslens.operators.lda import mixes, numbers
from corpuslens.operators.topics import TopicModel, dealt, term_weights
from corpuslens.schemas import require_columns
from corpuslens.sources.stages import shared_dir, write_stage

#: Tokens that a word's company is looked for in; terms of documents that are judged together.
WINDOW, JUDGED = 10, 1 << 16


def _windows(tokens: Column, terms: list[str], size: int) -> Column:
    """The places in ``terms`` of the different terms in each run of ``size`` tokens, or in all if they are fewer, ordered.

    Runs without any are left out.
    """
    # Tokens are looked up once for a text, so that a window compares numbers.
    marked = F.transform(tokens, lambda w: F.when(w.isin(terms), F.array_position(F.lit(terms).cast("array<string>"), w) - 1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - size + 1, F.lit(1)))

    def found(marks: Column) -> Column:
        return F.transform(starts, lambda s: F.sort_array(F.array_distinct(F.array_compact(F.slice(marks, s, size)))))

    return F.filter(bind(marked, found), lambda w: F.size(w) > 0)


def window_counts(docs: DataFrame, terms: list[str], window: int = WINDOW) -> tuple[DataFrame, DataFrame, int]:
    """(term, n), (a, b, n) with a < b, and how many windows there are in all, from docs (tokens).

    Windows are made inside the rows and counted in the map tasks; a window of w tokens has at most
    w (w - 1) / 2 pairs. The counts are stored, at most one row for each pair of ``terms``.
    """
    require_columns(docs, "tokens")
    wanted = sorted(set(terms))
    rows = docs.filter(F.size("tokens") > 0)
    every = rows.agg(F.sum(F.greatest(F.size("tokens") - window + 1, F.lit(1)))).first()[0] or 0
    found = rows.select(F.explode(_windows(F.col("tokens"), wanted, window)).alias("w"))
    # A single term is a pair of itself, so both counts take one pass. A pair is one number, its terms follow after counting.
    base = max(len(wanted), 1)
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b >= a), lambda b: a * base + b)))
    counted = found.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    name = F.lit(wanted).cast("array<string>")
    a, b = F.get(name, F.floor(F.col("p") / base).cast("int")), F.get(name, (F.col("p") % base).cast("int"))
    path = shared_dir(docs.sparkSession, "windows")
    write_stage(counted.select(a.alias("a"), b.alias("b"), "n"), path)
    counts = docs.sparkSession.read.schema("a string, b string, n bigint").parquet(path)
    return counts.filter("a = b").select(F.col("a").alias("term"), "n"), counts.filter("a < b"), int(every)


def topic_coherence(docs: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(topic, coherence): mean normalised pointwise mutual information of the pairs of a topic's terms.

    docs: (tokens), terms: (topic, term), as ``top_terms`` gives them. Probabilities are shares of
    the windows of ``window`` tokens. Terms that never share a window have -1, those that always do 1.
    """
    require_columns(terms, "topic", "term")
    listed = [r["term"] for r in terms.select("term").distinct().collect()]
    single, pairs, every = window_counts(docs, listed, window)
    of = terms.select("topic", "term").distinct()
    a = of.select("topic", F.col("term").alias("a")).join(single.select(F.col("term").alias("a"), F.col("n").alias("na")), "a", "left")
    b = of.select("topic", F.col("term").alias("b")).join(single.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b", "left")
    # The pairs of a topic's terms: as many as its list has, not its documents.
    both = a.join(b, "topic").filter("a < b").join(pairs, ["a", "b"], "left")
    n, total = F.col("n"), F.lit(float(every))
    share = n / total
    value = F.when(n.isNull(), -1.0).when(n == every, 1.0).otherwise(F.log(share * total * total / (F.col("na") * F.col("nb"))) / -F.log(share))
    return both.groupBy("topic").agg(F.avg(value).alias("coherence"))


def completion(model: TopicModel, corpus: DataFrame) -> DataFrame:
    """One row (log_likelihood, tokens, per_token): the words at odd places, given the topics of those at even places.

    Shares are inferred from one half of a document and judged by the other, so learning texts by
    heart does not help. Words outside the vocabulary are not judged. Both halves stay in their task.
    """
    require_columns(corpus, "text")
    lda = model.lda.toLocal() if model.lda.isDistributed() else model.lda
    matrix = lda.topicsMatrix().toArray()
    asked = (model.terms, term_weights(model.features), numbers(lda), matrix / matrix.sum(axis=0))
    shared = corpus.sparkSession.sparkContext.broadcast(asked)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, of, matrix = shared.value
        known = pa.array(terms, pa.large_string())
        for texts in (part for batch in batches for part in portions(batch.column(0))):
            runs = Runs(texts)
            odd = runs.place() % 2 == 1
            at, ids, n = runs.chosen(~odd).tokens().counts(known)
            shares = mixes(listed(at, ids, pa.int32()), listed(at, n * weights[ids], pa.float64()), of)
            at, ids, n = runs.chosen(odd).tokens().counts(known)
            docs, total = np.repeat(np.arange(len(texts)), np.diff(at)), []
            for i in range(0, len(ids), JUDGED):
                p = np.einsum("dk,dk->d", shares[docs[i : i + JUDGED]], matrix[ids[i : i + JUDGED]])
                # Words of a document whose other half has no term are counted, but have no likelihood.
                total.append((n[i : i + JUDGED][p > 0] * np.log(p[p > 0])).sum() if (p > 0).any() else None)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64()), pa.array([int(n.sum())] + [0] * (len(total) - 1), pa.int64())], ["log_likelihood", "tokens"])

    parts = dealt(corpus.select(lowered("text").alias("text"))).mapInArrow(judge, "log_likelihood double, tokens bigint")
    total = parts.agg(F.sum("log_likelihood").alias("log_likelihood"), F.sum("tokens").alias("tokens"))
    return total.withColumn("per_token", F.col("log_likelihood") / F.col("tokens"))
