"""One query per operator, over the whole given tables.

Floats are rounded to 8 places for comparison; arrays are exploded or joined to strings.
"""

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import inputs as I
from corpuslens import schemas
from corpuslens.defaults import LEFT_PHRASES, RIGHT_PHRASES
from corpuslens.functions import text as X
from corpuslens.functions import topics as TP
from corpuslens.functions import urls as U
from corpuslens.functions.phrases import phrase_counts as count_phrases
from corpuslens.operators import alignment as AL
from corpuslens.operators import bootstrap as B
from corpuslens.operators import clusters as C
from corpuslens.operators import coherence as CO
from corpuslens.operators import dedup as D
from corpuslens.operators import extract as E
from corpuslens.operators import ideology as G
from corpuslens.operators import index as IX
from corpuslens.operators import kmeans as KM
from corpuslens.operators import partials as PT
from corpuslens.operators import sentiment as S
from corpuslens.operators import terms as TM
from corpuslens.operators import topics as M
from corpuslens.operators import trends as TR
from corpuslens.plans import stages as P
from corpuslens.plans.corpus import ascii_only, extend_corpus, min_words
from corpuslens.sources import archive as A
from corpuslens.sources import stages as ST
from corpuslens.sources.warc import read_archive as read_warc

DIGITS = 8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(c, DIGITS).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


# Flagship


@query
def partisan_panel(spark, sf_dir, min_docs=1):
    """Corpus, partisan score per document, mean by domain and month."""
    scored = I.corpus(spark, sf_dir).select(
        "domain", "year_month", X.partisan_score(F.col("text"), I.LEFT, I.RIGHT).alias("partisan_score")
    )
    return rounded(
        scored.groupBy("domain", "year_month")
        .agg(F.count(F.lit(1)).alias("doc_count"), F.avg("partisan_score").alias("avg_partisan_score"))
        .filter(F.col("doc_count") >= min_docs)
    )


# Sources and sinks


@query
def stage_roundtrip(spark, sf_dir):
    path = ST.shared_dir(spark, "clean-text")
    ST.write_stage(I.clean_pages(spark, sf_dir), path, ["crawl"])
    return ST.read_stage(spark, path, schemas.CLEAN_TEXT)


@query
def crawl_rows(spark, sf_dir):
    path = ST.shared_dir(spark, "segments")
    ST.write_stage(I.index(spark, sf_dir), path, ["crawl"])
    stored = ST.read_stage(spark, path, schemas.SEGMENTS)
    return ST.for_crawl(stored, "CC-MAIN-2024-10").select("url", "fetch_time", "crawl")


@query
def parse_records(spark, sf_dir):
    return A.parse_records(I.records(spark, sf_dir)).drop("page_id")


@query
def fetch_records(spark, sf_dir):
    located, root = I.archive(spark, sf_dir)
    return A.parse_records(A.fetched(A.fetch_records(located, root))).select("url", "crawl", "fetch_time", "html")


@query
def read_archive(spark, sf_dir):
    """A folder of archive files read without a manifest, in ranges that cut most files."""
    root = I.archive_folder(spark, sf_dir)
    records = read_warc(spark, root, splitBytes=256 * 1024)
    return A.parse_records(A.fetched(records).drop("record_type", "warc_length")).select("url", "crawl", "fetch_time", "html")


@query
def archive_types(spark, sf_dir):
    """Records by type and crawl: bodies are not kept, and other crawls' files not opened."""
    root = I.archive_folder(spark, sf_dir)
    heads = read_warc(spark, root, ["crawl", "record_type"], types="all", crawls=",".join(I.CRAWLS[:3]), splitBytes=256 * 1024)
    return heads.groupBy("crawl", "record_type").agg(F.count(F.lit(1)).alias("n"))


@query
def fetch_rejects(spark, sf_dir):
    """Records that cannot be read: every fifth lies past the end of its file, every seventh in no file."""
    located, root = I.archive(spark, sf_dir)
    n = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(35))
    broken = located.withColumns({
        "warc_filename": F.when(n % 7 == 0, F.lit("absent.warc")).otherwise(F.col("warc_filename")),
        "warc_record_offset": F.when(n % 5 == 0, F.lit(1 << 40)).otherwise(F.col("warc_record_offset")),
    })
    lost = A.rejected(A.fetch_records(broken, root))
    return lost.select("url", "crawl", F.substring_index("error", ":", 1).alias("reason"))


@query
def topic_labels(spark, sf_dir):
    """Labels derived from the embeddings, written as one JSON object and read back."""
    values = I.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("topic", "value"))
    label = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg(F.col("value").cast("double")) * 10)), 6)
    labels = values.groupBy("topic").agg(label.alias("label"))
    # One object with an entry per topic.
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("topic").cast("string"), "label")))
    path = ST.shared_dir(spark, "labels")
    labels.agg(F.to_json(pairs).alias("value")).write.text(path)
    return ST.read_topic_labels(spark, path)


@query
def summary_csv(spark, sf_dir):
    path = ST.shared_dir(spark, "summary")
    ST.write_csv(rounded(C.cluster_summary(I.clusters(spark, sf_dir))), path)
    ddl = (
        "cluster int, ideology_score_mean double, avg_sentiment_mean double, doc_count_sum bigint, "
        "domain_count bigint"
    )
    return spark.read.schema(ddl).option("header", True).csv(path)


@query
def read_metrics(spark, sf_dir):
    """Polarization metrics of every crawl, stored as JSON per crawl and read back together."""
    base = ST.shared_dir(spark, "clusters")
    metrics = I.stored(C.polarization_index(I.crawl_clusters(spark, sf_dir), by=["crawl"]), "metrics")
    for crawl in I.CRAWLS:
        ST.write_json(ST.for_crawl(metrics, crawl).drop("crawl"), f"{base}/{crawl}/polarization_metrics")
    return ST.read_metrics(spark, base)


@query
def read_panel(spark, sf_dir):
    """Ideology panels stored per crawl, read back and united."""
    base = ST.shared_dir(spark, "ideology")
    for crawl, part in I.panels_by_crawl(spark, sf_dir).items():
        ST.write_stage(part, f"{base}/{crawl}/domain_ideology")
    return rounded(G.build_panel(ST.read_panel(spark, base, I.CRAWLS)))


@query
def stage_counts(spark, sf_dir):
    """Rows per stage from crawl index to corpus, counted while the stages are written."""
    located, root = I.archive(spark, sf_dir)
    out = ST.shared_dir(spark, "study")
    rows = P.collect_corpus(located, root, out, domains=I.DOMAIN_LIST, keywords=["/en/"])
    return spark.createDataFrame(list(rows.items()), "stage string, row_count bigint")


# Index


@query
def filter_domains(spark, sf_dir):
    return IX.filter_domains(I.pages(spark, sf_dir), I.DOMAIN_LIST).select("page_id", "url")


@query
def filter_url_keywords(spark, sf_dir):
    return IX.filter_url_keywords(I.docs(spark, sf_dir), ["/politics/"]).select("doc_id", "url")


@query
def filter_index(spark, sf_dir):
    index = I.index(spark, sf_dir)
    kept = IX.filter_index(index, "CC-MAIN-2024-10", I.DOMAIN_LIST, ["/en/"])
    return kept.drop("warc_record_offset", "warc_record_length")


@query
def default_index(spark, sf_dir):
    """The 45 default domains and 19 default keywords over addresses that hold some of them."""
    rows = I.listed(spark, sf_dir)
    kept = {
        "domain": IX.filter_domains(rows), "keyword": IX.filter_url_keywords(rows),
    }
    found = [df.select("page_id", "url", F.lit(name).alias("kept_by")) for name, df in kept.items()]
    return found[0].unionByName(found[1])


@query
def sample_index(spark, sf_dir):
    return IX.sample_index(I.index(spark, sf_dir), 0.5).select("url", "crawl")


@query
def sample_index_by_url(spark, sf_dir):
    return IX.sample_index_by_url(I.index(spark, sf_dir), 0.5).select("url", "crawl")


# URL and text functions


@query
def url_domain(spark, sf_dir):
    return I.pages(spark, sf_dir).select("page_id", U.url_domain(F.col("url")).alias("domain"))


@query
def url_fingerprint(spark, sf_dir):
    return I.pages(spark, sf_dir).select("page_id", U.url_fingerprint(F.col("url")).alias("url_fp"))


@query
def crawl_month(spark, sf_dir):
    return I.docs(spark, sf_dir).select("doc_id", U.crawl_month(F.col("crawl")).alias("year_month"))


def _documents(spark, sf_dir, **columns):
    return I.table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query
def normalize_text(spark, sf_dir):
    return _documents(spark, sf_dir, text=X.normalize_text(F.col("text")))


@query
def word_count(spark, sf_dir):
    return _documents(spark, sf_dir, word_count=X.word_count(F.col("text")))


@query
def text_fingerprint(spark, sf_dir):
    return _documents(spark, sf_dir, text_fp=X.text_fingerprint(F.col("text")))


@query
def text_fingerprint_whole(spark, sf_dir):
    return _documents(spark, sf_dir, text_fp=X.text_fingerprint(F.col("text"), None))


@query
def non_ascii_ratio(spark, sf_dir):
    return rounded(_documents(spark, sf_dir, ratio=X.non_ascii_ratio(F.col("text"))))


@query
def clean_for_nlp(spark, sf_dir):
    return _documents(spark, sf_dir, text=X.clean_for_nlp(F.col("text")))


@query
def phrase_counts(spark, sf_dir):
    t = F.col("text")
    return _documents(
        spark, sf_dir, left_count=X.phrase_count(t, I.LEFT), right_count=X.phrase_count(t, I.RIGHT)
    )


@query
def partisan_score(spark, sf_dir):
    return rounded(_documents(spark, sf_dir, score=X.partisan_score(F.col("text"), I.LEFT, I.RIGHT)))


@query
def default_phrases(spark, sf_dir):
    """The thirty default phrases, counted in one pass over each text."""
    t = F.col("text")
    counts = count_phrases(t, LEFT_PHRASES, RIGHT_PHRASES)
    found = I.phrased(spark, sf_dir).select("doc_id", counts.alias("n"), X.partisan_score(t).alias("score"))
    return rounded(found.select("doc_id", F.col("n")[0].alias("left_count"), F.col("n")[1].alias("right_count"), "score"))


@query
def lexicon_sentiment(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(S.lexicon_sentiment(docs, I.lexicon(spark), I.NEGATORS, I.BOOSTERS, idioms=I.IDIOMS))


@query
def lexicon_sentiment_whole(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(S.lexicon_sentiment(docs, I.lexicon(spark), I.NEGATORS, I.BOOSTERS, max_chars=None, idioms=I.IDIOMS))


@query
def extract_pages(spark, sf_dir):
    return E.extract_pages(I.pages(spark, sf_dir))


@query
def extract_pages_whole(spark, sf_dir):
    return E.extract_pages(I.pages(spark, sf_dir), max_chars=None)


# Filters and deduplication


@query
def min_words_filter(spark, sf_dir):
    return min_words(I.docs(spark, sf_dir)).select("doc_id", "url")


@query
def non_ascii_filter(spark, sf_dir):
    return ascii_only(I.docs(spark, sf_dir)).select("doc_id", "url")


@query
def dedup_url(spark, sf_dir):
    return D.dedup_by_url(I.docs(spark, sf_dir)).select("doc_id", "url", "fetch_time")


@query
def dedup_text(spark, sf_dir):
    return D.dedup_by_text(I.docs(spark, sf_dir)).select("doc_id", "url", "fetch_time")


@query
def dedup_text_whole(spark, sf_dir):
    return D.dedup_by_text(I.docs(spark, sf_dir), n_chars=None).select("doc_id", "url", "fetch_time")


@query
def build_corpus(spark, sf_dir):
    return I.corpus(spark, sf_dir)


@query
def corpus_by_instalments(spark, sf_dir):
    """The corpus of six instalments in the order of fetch time, each added to a ledger of those before."""
    pages = I.stored(I.clean_pages(spark, sf_dir), "pages")
    ledger, made = ST.shared_dir(spark, "ledger"), []
    for k in range(6):
        part = F.floor(F.col("fetch_time").cast("int") / 166_668) == k
        added = extend_corpus(pages.filter(part), ledger, f"part-{k}", [f"part-{j}" for j in range(k)], blocks=1 << 12)
        made.append(I.stored(added, "added"))
    return reduce(lambda a, b: a.unionByName(b), made)


# Aggregates


@query
def score_documents(spark, sf_dir):
    return rounded(I.scored(spark, sf_dir))


@query
def sentiment_panel(spark, sf_dir):
    return rounded(S.sentiment_panel(I.scored(spark, sf_dir), min_docs=5))


@query
def ideology_panel(spark, sf_dir):
    return rounded(I.panel(spark, sf_dir))


def _parts(spark, frame, measures, topic=None):
    """Parts of the six crawls, added one after the other and merged by domain."""
    base = ST.shared_dir(spark, "parts")
    whole = I.stored(frame, "scored")
    for crawl in I.CRAWLS:
        PT.add_part(ST.for_crawl(whole, crawl), base, crawl, measures, ("domain",), topic)
    return PT.read_parts(spark, base, I.CRAWLS, ("domain",))


@query
def merged_sentiment_panel(spark, sf_dir):
    """Sentiment by domain over all crawls, from stored parts of each."""
    parts = _parts(spark, I.scored(spark, sf_dir), PT.SENTIMENT)
    return rounded(PT.sentiment_panel_of(parts, 5, ("domain",)))


@query
def merged_ideology_panel(spark, sf_dir):
    """Ideology by domain over all crawls, from stored parts of each."""
    parts = _parts(spark, I.joined(spark, sf_dir), PT.IDEOLOGY, "dominant_topic")
    return rounded(PT.ideology_panel_of(parts, I.PANEL_DOCS, ("domain",)))


@query
def domain_features(spark, sf_dir):
    return rounded(I.features(spark, sf_dir))


@query
def domain_features_weighted(spark, sf_dir):
    return rounded(C.domain_features(I.panel(spark, sf_dir), I.DOMAIN_DOCS, weighted=True))


@query
def cluster_summary(spark, sf_dir):
    return rounded(C.cluster_summary(I.clusters(spark, sf_dir)))


def _labelled(spark, sf_dir):
    clusters = I.stored(I.clusters(spark, sf_dir), "clusters")
    return C.label_domains(clusters, C.label_clusters(C.cluster_summary(clusters), k=5))


@query
def label_clusters(spark, sf_dir):
    summary = C.cluster_summary(I.clusters(spark, sf_dir))
    return C.label_clusters(summary, k=5).select("cluster", "domain_count", "ideology_label")


@query
def visible_domains(spark, sf_dir):
    return C.visible_domains(_labelled(spark, sf_dir), I.VIEW_DOCS).select(
        "domain", "cluster", "total_docs", "ideology_label"
    )


@query
def label_summary(spark, sf_dir):
    return rounded(C.label_summary(_labelled(spark, sf_dir), I.VIEW_DOCS))


@query
def polarization_index(spark, sf_dir):
    return C.polarization_index(I.clusters(spark, sf_dir))


@query
def polarization_interval(spark, sf_dir):
    return B.index_interval(I.stored(I.crawl_clusters(spark, sf_dir), "clusters"), ["crawl"])


@query
def polarization_changes(spark, sf_dir):
    return B.index_changes(I.stored(I.crawl_clusters(spark, sf_dir), "clusters"))


@query
def polarization_trend(spark, sf_dir):
    by_crawl = C.polarization_index(I.crawl_clusters(spark, sf_dir), by=["crawl"])
    return rounded(TR.polarization_trend(by_crawl))


@query
def domain_trend(spark, sf_dir):
    return rounded(TR.domain_trend(I.panel(spark, sf_dir), I.DOMAIN_LIST, "avg_sentiment"))


@query
def topic_prevalence(spark, sf_dir):
    return rounded(M.topic_prevalence(I.doc_topics(spark, sf_dir)))


# Joins and unions


@query
def join_scores(spark, sf_dir):
    return rounded(I.topic_and_sentiment(spark, sf_dir))


@query
def build_panel(spark, sf_dir):
    return rounded(G.build_panel(I.panels_by_crawl(spark, sf_dir)))


# Terms and topics


def _tokens(spark, sf_dir):
    return TM.tokens(I.table(spark, sf_dir, "documents").select("doc_id", "text"))


def _joined_tokens(df):
    return df.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def tokenize(spark, sf_dir):
    return _joined_tokens(_tokens(spark, sf_dir))


@query
def remove_stop_words(spark, sf_dir):
    return _joined_tokens(TM.remove_stop_words(_tokens(spark, sf_dir)))


@query
def vocabulary(spark, sf_dir):
    counts = TM.term_counts(TM.remove_stop_words(_tokens(spark, sf_dir)), "doc_id")
    return TM.vocabulary(counts, vocab_size=None)


@query
def tfidf(spark, sf_dir):
    return rounded(TM.tfidf(TM.remove_stop_words(_tokens(spark, sf_dir)), "doc_id", vocab_size=None))


@query
def rank_weights(spark, sf_dir):
    """Display weights of the twenty most frequent terms of each language."""
    source = I.table(spark, sf_dir, "documents").select("lang", "text")
    counts = TM.term_counts(TM.remove_stop_words(TM.tokens(source)), "lang")
    counts = counts.groupBy("lang", "term").agg(F.sum("tf").alias("tf"))
    order = Window.partitionBy("lang").orderBy(F.desc("tf"), "term")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 20)
    return rounded(TM.rank_weights(M.topic_term_lists(ranked.withColumnRenamed("lang", "topic"))))


@query
def dominant_topic(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings").select(
        "vec_id", TP.dominant_topic(F.transform("embedding", F.abs)).alias("dominant_topic")
    )


@query
def topic_ideology(spark, sf_dir):
    mixes = I.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", F.abs).alias("topic_dist_arr"))
    return rounded(G.score_topics(mixes, I.LABELS).select("vec_id", "topic_ideology_score"))


@query
def composite_ideology(spark, sf_dir):
    return rounded(I.joined(spark, sf_dir).select("url", "composite_ideology"))


#: Folders of the stored model and its corpus, by session and tables.
_MODELS: dict[tuple[str, str], tuple[str, str]] = {}


def _model(spark, sf_dir):
    """The model of the study's size, fitted and stored once for all queries about it, and its corpus."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        corpus = ST.shared_dir(spark, "corpus")
        ST.write_stage(I.corpus(spark, sf_dir), corpus)
        path = ST.shared_dir(spark, "topic-model")
        M.save_topic_model(M.fit_topics(spark.read.parquet(corpus)), path)
        _MODELS[key] = (path, corpus)
    path, corpus = _MODELS[key]
    return M.load_topic_model(path), spark.read.parquet(corpus)


@query
def topic_model(spark, sf_dir):
    """Fitted, stored, loaded again: the ten heaviest terms of each topic."""
    return rounded(M.top_terms(_model(spark, sf_dir)[0], 10))


@query
def topic_shares(spark, sf_dir):
    """What must hold of the shares of every document: as many as topics, in all 1, the first largest one named.

    A document without a term of the vocabulary would have shares of 0.
    """
    mixed = M.document_topics(*_model(spark, sf_dir))
    shares = F.col("topic_dist_arr")
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    first = F.array_min(F.filter(F.transform(shares, lambda x, i: F.when(x == F.array_max(shares), i)), lambda i: i.isNotNull()))
    return mixed.select(
        "url", "crawl", F.size(shares).alias("n_topics"), F.round(total, 6).alias("total"),
        (F.col("dominant_topic") == first).alias("first_largest"), (F.array_min(shares) >= 0).alias("none_negative"),
    )


@query
def topic_ranks(spark, sf_dir):
    """What must hold of every topic's terms: ranked from 1, none twice, by falling weight, all of the vocabulary."""
    terms = M.top_terms(_model(spark, sf_dir)[0])
    corpus = spark.read.parquet(_MODELS[spark.sparkContext.applicationId, sf_dir][1])
    # The part of the whole vocabulary that is asked for.
    named = sorted({r["term"] for r in terms.select("term").collect()} - set(TM.stop_words()))
    known = TM.vocabulary(TM.named_counts(TM.tokens(corpus.select("text")), named), None)
    order = Window.partitionBy("topic").orderBy("rank")
    falls = F.coalesce(F.lag("weight").over(order) >= F.col("weight"), F.lit(True))
    checked = terms.withColumn("falls", falls).join(known.select(F.col("term").alias("known")), F.col("term") == F.col("known"), "left")
    return checked.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_terms"), F.countDistinct("term").alias("n_different"), F.max("rank").cast("bigint").alias("last_rank"),
        F.count("known").alias("n_known"), F.bool_and("falls").alias("falling"),
    )


@query
def topic_quality(spark, sf_dir):
    return rounded(M.topic_quality(*_model(spark, sf_dir)))


@query
def topic_coherence(spark, sf_dir):
    """Coherence of the twenty most frequent terms of each language, over all documents."""
    rows = I.table(spark, sf_dir, "documents").select("lang", "text")
    tokens = TM.remove_stop_words(TM.tokens(rows))
    counts = TM.term_counts(tokens, "lang").groupBy("lang", "term").agg(F.sum("tf").alias("tf"))
    order = Window.partitionBy("lang").orderBy(F.desc("tf"), "term")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 20)
    return rounded(CO.topic_coherence(tokens, I.stored(ranked.select(F.col("lang").alias("topic"), "term"), "terms")))


@query
def topic_completion(spark, sf_dir):
    """How well the topics of one half of each document foretell the other."""
    return rounded(CO.completion(*_model(spark, sf_dir)))


@query
def top_terms(spark, sf_dir):
    return rounded(M.top_terms(_model(spark, sf_dir)[0]))


@query
def document_topics(spark, sf_dir):
    mixed = M.document_topics(*_model(spark, sf_dir))
    share = F.round(F.array_max("topic_dist_arr"), DIGITS).alias("top_share")
    return mixed.select("doc_id", "url", "domain", "year_month", "dominant_topic", share)


# Clusters


def _standardized(spark, sf_dir):
    return C.standardize(I.stored(I.features(spark, sf_dir), "features"))


@query
def standardize(spark, sf_dir):
    z = C.scaled_columns(_standardized(spark, sf_dir))
    return rounded(z.select("domain", *[c for c in z.columns if c.startswith("z_")]))


@query
def select_k(spark, sf_dir):
    return rounded(C.select_k(_standardized(spark, sf_dir))[1])


@query
def cluster_domains(spark, sf_dir):
    return C.cluster_domains(_standardized(spark, sf_dir)).select("domain", "total_docs", "cluster")


@query
def project_2d(spark, sf_dir):
    return rounded(C.project_2d(_standardized(spark, sf_dir)).select("domain", "x", "y"))


@query
def select_k_at_once(spark, sf_dir):
    return rounded(KM.select_k_at_once(_standardized(spark, sf_dir))[1])


def _given_centres(spark, sf_dir):
    """Standardized domains, and as the centres of each k the first k of them by name."""
    z = I.stored(_standardized(spark, sf_dir).select("domain", vector_to_array("scaled_features").alias("scaled_features")), "scaled")
    first = [r["scaled_features"] for r in z.orderBy("domain").limit(max(I.GIVEN_K)).collect()]
    return z, {k: np.array(first[:k]) for k in I.GIVEN_K}


@query
def nearest_centres(spark, sf_dir):
    return KM.nearest_centres(*_given_centres(spark, sf_dir))


@query
def silhouette_of_centres(spark, sf_dir):
    """Silhouettes of given centres, from sums; SQL takes them from all pairs."""
    z, centres = _given_centres(spark, sf_dir)
    scores = KM.silhouettes(z.select(F.col("scaled_features").alias("x")), centres)
    return rounded(spark.createDataFrame(sorted(scores.items()), "k int, silhouette double"))


@query
def project_on(spark, sf_dir):
    """Plane coordinates by given loadings."""
    return rounded(C.project_on(_standardized(spark, sf_dir), I.LOADINGS).select("domain", "x", "y"))


@query
def aligned_topics(spark, sf_dir):
    """Term counts of the four languages, numbered one way in even documents and the other way in odd ones."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    number = F.array_position(F.array(*[F.lit(x) for x in I.LANGS]), F.col("lang")).cast("int") - 1

    def terms(half, topic):
        rows = TM.remove_stop_words(TM.tokens(docs.filter((F.col("doc_id") % 2 == half) & F.col("lang").isin(I.LANGS))))
        counts = TM.term_counts(rows.select(topic.alias("topic"), "tokens"), "topic")
        return I.stored(counts.groupBy("topic", "term").agg(F.sum("tf").cast("double").alias("weight")), "terms")

    return rounded(AL.align_topics(terms(0, number), terms(1, len(I.LANGS) - 1 - number)))
