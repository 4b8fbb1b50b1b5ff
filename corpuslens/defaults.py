"""Default parameters.

Everything below the marker is a fixed value: results only agree with published
runs of the same study when these lists and sizes are the same. Every function
takes them as parameters, so a caller may pass others.
"""

# --- fixed values -----------------------------------------------------------

CRAWLS = [
    "CC-MAIN-2022-05",
    "CC-MAIN-2022-27",
    "CC-MAIN-2023-06",
    "CC-MAIN-2023-40",
    "CC-MAIN-2024-10",
    "CC-MAIN-2024-38",
]

DOMAINS = [
    "huffpost.com", "motherjones.com", "thenation.com", "salon.com",
    "slate.com", "vox.com", "jacobin.com", "currentaffairs.org",
    "democracynow.org", "theintercept.com", "msnbc.com",
    "nytimes.com", "washingtonpost.com", "cnn.com", "theatlantic.com",
    "newyorker.com", "theguardian.com", "politico.com", "nbcnews.com",
    "apnews.com", "npr.org", "pbs.org",
    "reuters.com", "axios.com", "thehill.com", "csmonitor.com",
    "realclearpolitics.com", "militarytimes.com",
    "wsj.com", "reason.com", "nationalreview.com", "weeklystandard.com",
    "commentary.org", "city-journal.org",
    "foxnews.com", "nypost.com", "washingtonexaminer.com",
    "dailywire.com", "townhall.com", "powerlineblog.com",
    "breitbart.com", "thegatewaypundit.com", "infowars.com",
    "oann.com", "newsmax.com",
]

URL_KEYWORDS = [
    "/politics/", "/election/", "/congress/", "/senate/",
    "/white-house/", "/government/", "/policy/",
    "/democrat/", "/republican/", "/liberal/", "/conservative/",
    "/immigration/", "/gun-control/", "/abortion/",
    "/supreme-court/", "/2024-election/", "/2022-midterms/",
    "/climate-policy/", "/healthcare-policy/",
]

LEFT_PHRASES = [
    "climate change", "gun control", "reproductive rights", "income inequality",
    "universal healthcare", "systemic racism", "living wage", "affordable housing",
    "undocumented immigrants", "social justice", "police reform", "wealth tax",
    "green new deal", "medicaid expansion", "voting rights",
]

RIGHT_PHRASES = [
    "illegal aliens", "second amendment", "pro-life", "free market",
    "border security", "radical left", "cancel culture", "deep state",
    "election integrity", "school choice", "religious liberty", "energy independence",
    "traditional values", "law and order", "government overreach",
]

EXTRA_STOP_WORDS = [
    "said", "says", "would", "could", "also", "new", "one", "two",
    "year", "years", "time", "day", "people", "us", "like", "just",
    "get", "make", "way", "mr", "ms", "mrs", "dr", "com", "www",
    "click", "subscribe", "newsletter", "advertisement", "sponsored",
    "read", "more", "share", "tweet", "facebook", "twitter",
]

# Negation and degree words of the published rule-based sentiment scheme
# (Hutto & Gilbert, 2014), as in its public implementation.
NEGATORS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]

AMPLIFIERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerable",
    "considerably", "decidedly", "deeply", "effing", "enormous", "enormously",
    "entirely", "especially", "exceptional", "exceptionally", "extreme",
    "extremely", "fabulously", "flipping", "flippin", "frackin", "fracking",
    "fricking", "frickin", "frigging", "friggin", "fully", "fuckin", "fucking",
    "fuggin", "fugging", "greatly", "hella", "highly", "hugely", "incredible",
    "incredibly", "intensely", "major", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "total", "totally", "tremendous",
    "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly",
    "very",
]

DAMPENERS = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof",
    "kind-of", "less", "little", "marginal", "marginally", "occasional",
    "occasionally", "partly", "scarce", "scarcely", "slight", "slightly",
    "somewhat", "sort of", "sorta", "sortof", "sort-of",
]

BOOST = 0.293

# Phrases with a valence of their own in the same scheme.
IDIOMS = {
    "the shit": 3, "the bomb": 3, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2,
    "kiss of death": -1.5, "to die for": 3, "beating heart": 3.1, "broken heart": -2.9,
}

BOILERPLATE_TAGS = [
    "script", "style", "nav", "footer", "header", "aside", "form", "noscript",
    "iframe", "ads", "advertisement",
]

TEXT_TAGS = ["p", "h1", "h2", "h3", "h4", "li", "blockquote"]

CONTENT_CLASS_PATTERN = r"(article|content|post|story|body)"

FEATURES = [
    "ideology_score",
    "avg_sentiment",
    "avg_pos_sentiment",
    "avg_neg_sentiment",
    "avg_partisan_score",
    "avg_topic_ideology",
]

THREE_LABELS = ["Left", "Center", "Right"]
FIVE_LABELS = ["Far Left", "Center-Left", "Center", "Center-Right", "Far Right"]

MIN_PAGE_WORDS = 100
MIN_CORPUS_WORDS = 50
MAX_NON_ASCII_RATIO = 0.15
NUM_TOPICS = 30
TOPIC_ITERATIONS = 20
VOCAB_SIZE = 20_000
MIN_DOC_FREQ = 5
TOP_TERMS = 20
RECORDS_PER_TASK = 100
SEED = 42

# --- own choices ------------------------------------------------------------

# A read is tried so often, and this share of failed records stops a study.
FETCH_ATTEMPTS = 5
MAX_FAILED_SHARE = 0.05
