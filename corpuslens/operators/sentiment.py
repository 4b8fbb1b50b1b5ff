"""Document sentiment from a lexicon, and its monthly panel."""

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.defaults import (
    AMPLIFIERS,
    BOOST,
    DAMPENERS,
    IDIOMS,
    LEFT_PHRASES,
    NEGATORS,
    RIGHT_PHRASES,
)
from corpuslens.functions.text import bind, head, partisan_score, plain_spaces
from corpuslens.schemas import require_columns

# --- fixed values: the published rule-based scheme (Hutto & Gilbert, 2014) ---
NEGATION = -0.74
NEVER_SO = 1.25
CAPITALS = 0.733
DISTANCE_DAMPING = [1.0, 0.95, 0.9]
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MAX_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
NORM_ALPHA = 15
#: Terms of a lexicon that tasks get as a set.
MAX_TERMS = 10_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space of ASCII besides the plain space.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f"

BOOSTERS = dict.fromkeys(AMPLIFIERS, BOOST) | dict.fromkeys(DAMPENERS, -BOOST)


def lexicon_table(spark: SparkSession, terms: Mapping[str, float]) -> DataFrame:
    """The lexicon as a table of known size, by which Spark decides whether to broadcast it."""
    columns = {"term": pa.array(list(terms), pa.string()), "valence": pa.array(map(float, terms.values()), pa.float64())}
    return spark.createDataFrame(pa.table(columns))


def _look_up(rows: DataFrame, lexicon: DataFrame, word: str, name: str) -> DataFrame:
    """Adds the valence of a word as ``name``; all look-ups read the same two columns and share one broadcast."""
    terms = lexicon.alias(name)
    found = rows.join(terms, F.col(word) == F.col(f"{name}.term"), "left")
    return found.select(*rows.columns, F.col(f"{name}.valence").alias(name))


def _words(text: Column) -> Column:
    """Words of a text as they are written; outer punctuation goes unless two or fewer characters remain."""
    # Replacing and cutting at one character needs no regular expression.
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), BLANKS, plain_spaces(text))
    tokens = F.array_remove(F.split(spaced, " "), "")

    def strip(w: Column) -> Column:
        bare = F.trim(w, F.lit(PUNCTUATION))
        return F.when(F.length(bare) <= 2, w).otherwise(bare)

    def marked(w: Column) -> Column:
        return F.substring(w, -1, 1).isin(list(PUNCTUATION)) | F.substring(w, 1, 1).isin(list(PUNCTUATION))

    # Most words have no outer punctuation, and looking for it costs less than trimming.
    return F.transform(tokens, lambda w: F.when(marked(w), strip(w)).otherwise(w))


def _lowered(written: Column, plain: Column) -> Column:
    """The words in lower case, changed in one piece: no word holds a blank, and case does not reach across one.

    ``plain`` tells that the whole text is in lower case as it stands.
    """
    whole = F.split(F.lower(F.array_join(written, " ")), " ")
    return F.when(plain | (F.size(written) == 0), written).otherwise(whole)


def _capitals(written: Column, words: Column, plain: Column) -> Column:
    """For each word a number whose bits tell whether it and the three words before it are in capitals.

    Capitals only mean something where other words have none: otherwise the array is empty.
    """
    # Most words are in lower case as they stand, and are not compared further.
    upper = F.zip_with(written, words, lambda w, low: ((w != low) & (w == F.upper(w))).cast("int"))

    def bits(flags: Column) -> Column:
        def before(i: Column, k: int) -> Column:
            return F.coalesce(F.get(flags, i - k), F.lit(0)) * (1 << k)

        some = F.array_contains(flags, 1) & F.array_contains(flags, 0)
        each = F.transform(flags, lambda u, i: u + before(i, 1) + before(i, 2) + before(i, 3))
        return F.when(some, each).otherwise(none)

    none = F.array().cast("array<int>")
    return F.when(plain, none).otherwise(bind(upper, bits))


def _count(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _emphasis(text: Column) -> Column:
    bangs = F.least(_count(text, "!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION
    marks = _count(text, "?")
    asked = (
        F.when(marks <= 1, F.lit(0.0)).when(marks <= MAX_QUESTIONS, marks * QUESTION).otherwise(MANY_QUESTIONS)
    )
    return bangs + asked


def _value(term: Column, values: Mapping[str, float]) -> Column:
    """The value of a term, null for others: one set look-up for each different value."""
    by_value: dict[float, list[str]] = {}
    for w, v in values.items():
        by_value.setdefault(float(v), []).append(w)
    return F.coalesce(*[F.when(term.isin(ws), F.lit(v)) for v, ws in by_value.items()], F.lit(None).cast("double"))


def _phrases(values: Mapping[str, float], *places: tuple[Column, ...]) -> list[Column]:
    """The value of the words at each of the places together. Lengths that no phrase has are not looked up."""
    by_length: dict[int, dict[str, float]] = {}
    for phrase, v in values.items():
        by_length.setdefault(phrase.count(" ") + 1, {})[phrase] = v

    def at(words: tuple[Column, ...]) -> Column:
        known = by_length[len(words)]
        # Joined only if no word is absent, and each is the word of some phrase at its place.
        may = reduce(lambda a, b: a & b, [w.isin(sorted(set(ws))) for w, ws in zip(words, zip(*map(str.split, known)))])
        return F.when(may, _value(F.concat(words[0], *[c for w in words[1:] for c in (F.lit(" "), w)]), known))

    return [at(words) for words in places if len(words) in by_length]


def _negated(word: Column, negators: Iterable[str]) -> Column:
    return F.coalesce(word.isin(list(negators)) | word.contains("n't"), F.lit(False))


def _is(word: Column, *values: str) -> Column:
    return F.coalesce(word.isin(*values), F.lit(False))


def _valence_columns(
    negators: list[str], boosters: Mapping[str, float], idioms: Mapping[str, float]
) -> list[dict[str, Column]]:
    """Successive projections that turn the lexicon valence of a word into its valence in context.

    ``p1, p2, p3`` are the words before ``w``, ``next, next2`` those after; ``in_1`` to ``in_3`` and
    ``in_next`` tell whether those are lexicon terms, ``capitals`` which words are in capitals.
    """
    w, p1, p2, p3, after, after2 = (F.col(c) for c in ("w", "p1", "p2", "p3", "next", "next2"))
    base = F.col("base")

    def loud(k: int) -> Column:
        return F.coalesce(F.col("capitals").bitwiseAND(1 << k) != 0, F.lit(False))

    after_no = (
        _is(p1, "no") | _is(p2, "no") | (_is(p3, "no") & _is(p1, "or", "nor"))
    )
    base = F.when(after_no, base * NEGATION).when((w == "no") & F.col("in_next"), F.lit(0.0)).otherwise(base)
    steps = [{"v": base}, {"v": F.col("v") + F.when(~loud(0), 0.0).when(F.col("v") > 0, CAPITALS).otherwise(-CAPITALS)}]
    never_so_2 = _is(p2, "never") & _is(p1, "so", "this")
    never_so_3 = (_is(p3, "never") & _is(p2, "so", "this")) | _is(p1, "so", "this")
    factors = [
        F.when(_negated(p1, negators), F.lit(NEGATION)),
        F.when(never_so_2, F.lit(NEVER_SO))
        .when(_is(p2, "without") & _is(p1, "doubt"), F.lit(1.0))
        .when(_negated(p2, negators), F.lit(NEGATION)),
        F.when(never_so_3, F.lit(NEVER_SO))
        .when(_is(p3, "without") & (_is(p2, "doubt") | _is(p1, "doubt")), F.lit(1.0))
        .when(_negated(p3, negators), F.lit(NEGATION)),
    ]
    for k, (prior, known, damping, factor) in enumerate(
        zip((p1, p2, p3), ("in_1", "in_2", "in_3"), DISTANCE_DAMPING, factors), start=1
    ):
        v = F.col("v")
        boost = _value(prior, boosters) * F.when(v < 0, -1.0).otherwise(1.0)
        boost = boost + F.when(~loud(k), 0.0).when(v > 0, CAPITALS).otherwise(-CAPITALS)
        moved = (v + F.coalesce(boost, F.lit(0.0)) * damping) * F.coalesce(factor, F.lit(1.0))
        steps.append({"v": F.when(prior.isNotNull() & ~F.col(known), moved).otherwise(v)})
    # Phrases around the word, the last in force first, replace its valence; degree phrases before it add to it.
    around = _phrases(idioms, (w, after, after2), (w, after), (p1, w), (p2, p1, w), (p2, p1), (p3, p2, p1), (p3, p2))
    degree = _phrases({b: v for b, v in boosters.items() if " " in b}, (p3, p2, p1), (p3, p2), (p2, p1))
    phrased = F.coalesce(*around, F.col("v"))
    for d in degree:
        phrased = phrased + F.coalesce(d, F.lit(0.0))
    # The row that stands for the text itself has no word.
    steps.append({"v": _apart(F.when(w.isNotNull() & p3.isNotNull() & ~F.col("in_3"), phrased).otherwise(F.col("v")))})
    least = _is(p1, "least") & ~F.col("in_1") & ~_is(p2, "at", "very")
    v = F.when(least, F.col("v") * NEGATION).otherwise(F.col("v"))
    # Degree words carry no valence of their own.
    plain = F.lit(0.0)
    steps.append({"v": F.when(w.isin(list(boosters)) | ((w == "kind") & _is(F.col("next"), "of")), plain).otherwise(v)})
    but = F.col("but")
    shift = F.when(but == 0, 1.0).when(F.col("i") < but, BEFORE_BUT).when(F.col("i") > but, AFTER_BUT).otherwise(1.0)
    steps.append({"v": F.col("v") * shift})
    return steps


def _apart(value: Column) -> Column:
    """``value`` in a projection of its own. Fused, all steps are one method that the JVM finds too long to compile.

    One cut between them is enough: each costs a copy of every row.
    """
    return value + F.get(F.transform(F.array("base"), lambda x: F.lit(0.0)), F.lit(0))


def _terms(lexicon: DataFrame) -> list[str] | None:
    """The terms of a lexicon of at most ``MAX_TERMS``, a parameter table; None if there are more."""
    found = lexicon.dropna().select("term").distinct().limit(MAX_TERMS + 1).collect()
    return [r["term"] for r in found] if len(found) <= MAX_TERMS else None


def _in_place(texts: DataFrame, lexicon: DataFrame, terms: list[str], kept: list[str]) -> DataFrame:
    """The terms of each text with their neighbours, and a row for the text itself. Other words get no row.

    Terms are told from other words inside the list of a text, by a set.
    """
    words, known, n = F.col("_words"), F.col("_known"), F.col("_n")

    def is_term(i: Column) -> Column:
        return F.coalesce(F.get(known, i), F.lit(False))

    def row(i: Column) -> Column:
        near = {"w": 0, "p1": -1, "p2": -2, "p3": -3, "next": 1, "next2": 2}
        flags = {"in_1": -1, "in_2": -2, "in_3": -3, "in_next": 1}
        return F.struct(
            (i + 1).alias("i"), *[F.get(words, i + k).alias(name) for name, k in near.items()],
            F.get("_capitals", i).alias("capitals"), *[is_term(i + k).alias(name) for name, k in flags.items()],
        )

    flagged = texts.withColumn("_known", F.transform(words, lambda w: w.isin(terms)))
    # The row behind the last word stands for the text itself, so that texts without terms stay.
    places = F.filter(F.sequence(F.lit(0), n), lambda i: is_term(i) | (i == n))
    hits = flagged.select(*kept, "_doc", "_amp", "_n", "but", F.inline(F.transform(places, row)))
    return _look_up(hits, lexicon, "w", "base")


def _by_join(texts: DataFrame, lexicon: DataFrame, kept: list[str]) -> DataFrame:
    """What ``_in_place`` gives, for a lexicon of any size: every word is joined with it."""
    words, n = F.col("_words"), F.col("_n")
    # The word list next to itself, shifted: each row is a word with its neighbours. Shifting adds
    # rows behind the last word; the first of them stands for the text itself, so that texts
    # without hits stay.
    none = F.lit(None).cast("string")
    near = F.arrays_zip(
        words.alias("w"),
        F.concat(F.array(none), words).alias("p1"),
        F.concat(F.array(none, none), words).alias("p2"),
        F.concat(F.array(none, none, none), words).alias("p3"),
        F.slice(words, 2, F.greatest(n - 1, F.lit(0))).alias("next"),
        F.slice(words, 3, F.greatest(n - 2, F.lit(0))).alias("next2"),
        F.col("_capitals").alias("capitals"),
    )
    rows = texts.select(*kept, "_doc", "_amp", "_n", "but", F.posexplode(near).alias("_pos", "_near"))
    rows = rows.select(
        *kept, "_doc", "_amp", "_n", "but", (F.col("_pos") + 1).alias("i"),
        *[F.col("_near")[name].alias(name) for name in ("w", "p1", "p2", "p3", "next", "next2", "capitals")],
    )
    hits = _look_up(rows, lexicon, "w", "base")
    hits = hits.filter(F.col("base").isNotNull() | (F.col("i") == F.col("_n") + 1))
    for near_word, flag in (("p1", "in_1"), ("p2", "in_2"), ("p3", "in_3"), ("next", "in_next")):
        hits = _look_up(hits, lexicon, near_word, flag).withColumn(flag, F.col(flag).isNotNull())
    return hits


def _total(values: Column) -> Column:
    """Sum without the noise of its order, which must not decide the sign of a balanced text."""
    return F.round(F.coalesce(F.sum(values), F.lit(0.0)), 9)


def lexicon_sentiment(
    docs: DataFrame,
    lexicon: DataFrame,
    negators: Iterable[str] = NEGATORS,
    boosters: Mapping[str, float] = BOOSTERS,
    text_col: str = "text",
    max_chars: int | None = None,
    idioms: Mapping[str, float] = IDIOMS,
) -> DataFrame:
    """``docs`` without the text, plus ``sentiment_compound, _pos, _neg, _neu``.

    ``lexicon`` has one row (term, valence) per term. Scored words are found inside the word list of
    each text, and only they become rows. With a lexicon of more than ``MAX_TERMS`` terms every word does and
    is joined with it; Spark shuffles one that is not known to be small. The words of a text are summed up in their map
    task, so one narrow row per text is shuffled. ``boosters`` and ``idioms`` may have phrases of two
    or three words; they count next to a scored word that has three words before it, the first of
    which is not a term. Words in capitals weigh more where not all are. Emoji are left out.
    ``max_chars`` scores the beginning of each text only.
    """
    require_columns(docs, text_col)
    require_columns(lexicon, "term", "valence")
    negators = list(negators)
    lexicon = lexicon.select("term", "valence")
    kept = [c for c in docs.columns if c != text_col]
    text = head(F.coalesce(F.col(text_col), F.lit("")), max_chars)
    prepared = docs.select(
        *kept, F.monotonically_increasing_id().alias("_doc"), _words(text).alias("_written"), _emphasis(text).alias("_amp"),
        (F.lower(text) == text).alias("_plain"),
    )
    lowered = prepared.withColumn("_words", _lowered(F.col("_written"), F.col("_plain")))
    texts = lowered.select(
        *kept, "_doc", "_amp", "_words", _capitals(F.col("_written"), F.col("_words"), F.col("_plain")).alias("_capitals"),
        F.size("_words").alias("_n"), F.array_position("_words", F.lit("but")).alias("but"),
    )
    terms = _terms(lexicon)
    hits = _by_join(texts, lexicon, kept) if terms is None else _in_place(texts, lexicon, terms, kept)
    scored = reduce(DataFrame.withColumns, _valence_columns(negators, boosters, idioms), hits)

    v = F.col("v")
    sums = scored.groupBy("_doc", "_n", "_amp", *kept).agg(
        _total(v).alias("_sum"),
        _total(F.when(v > 0, v + 1)).alias("_up"),
        _total(F.when(v < 0, 1 - v)).alias("_down"),
        F.count(F.when(v != 0, True)).alias("_marked"),
    )
    amp, total = F.col("_amp"), F.col("_sum")
    loud = total + F.when(total > 0, amp).when(total < 0, -amp).otherwise(0.0)
    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), loud / F.sqrt(loud * loud + NORM_ALPHA)))
    up, down = F.col("_up"), F.col("_down")
    louder = sums.select(
        *kept,
        F.when(F.col("_n") > 0, F.round(compound, 4)).otherwise(0.0).alias("sentiment_compound"),
        (up + F.when(up > down, amp).otherwise(0.0)).alias("_up"),
        (down + F.when(down > up, amp).otherwise(0.0)).alias("_down"),
        (F.col("_n") - F.col("_marked")).alias("_calm"),
    )
    whole = F.col("_up") + F.col("_down") + F.col("_calm")
    shares = {"pos": "_up", "neg": "_down", "neu": "_calm"}
    return louder.select(
        *kept, "sentiment_compound",
        *[
            F.when(whole > 0, F.round(F.col(c) / whole, 3)).otherwise(0.0).alias(f"sentiment_{n}")
            for n, c in shares.items()
        ],
    )


def score_documents(
    corpus: DataFrame,
    lexicon: DataFrame,
    left: Iterable[str] = LEFT_PHRASES,
    right: Iterable[str] = RIGHT_PHRASES,
    negators: Iterable[str] = NEGATORS,
    boosters: Mapping[str, float] = BOOSTERS,
    max_chars: int | None = None,
    idioms: Mapping[str, float] = IDIOMS,
) -> DataFrame:
    """The corpus without its text, with sentiment and partisan score per document."""
    slanted = corpus.withColumn("partisan_score", partisan_score(F.col("text"), left, right))
    return lexicon_sentiment(slanted, lexicon, negators, boosters, max_chars=max_chars, idioms=idioms)


def sentiment_panel(
    scored: DataFrame, min_docs: int = 10, by: Sequence[str] = ("domain", "year_month")
) -> DataFrame:
    """Sentiment and partisan score by domain and month, or by other columns, for groups with enough documents."""
    compound, partisan = F.col("sentiment_compound"), F.col("partisan_score")

    def mean(score: str) -> Column:
        # Scores have four decimals at most, and sums of decimals are exact in any order.
        return (F.sum(F.col(score).cast("decimal(20,4)")).cast("double") / F.count(score))

    return (
        scored.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("doc_count"),
            mean("sentiment_compound").alias("avg_sentiment"),
            F.stddev_samp(compound).alias("std_sentiment"),
            F.avg(partisan).alias("avg_partisan_score"),
            F.stddev_samp(partisan).alias("std_partisan_score"),
            mean("sentiment_pos").alias("avg_pos"),
            mean("sentiment_neg").alias("avg_neg"),
        )
        .filter(F.col("doc_count") >= min_docs)
    )
