"""Default word lists and constants. Every operator takes its own list; these are only the defaults."""

# Keyword categories, in the order that breaks ties.
CATEGORY_KEYWORDS = {
    "finance": [
        "stock", "market", "gdp", "inflation", "fed", "interest rate", "bond", "crypto", "bitcoin", "nasdaq",
        "s&p", "earnings", "ipo",
    ],
    "technology": [
        "ai", "machine learning", "software", "hardware", "apple", "google", "microsoft", "startup", "chip",
        "semiconductor", "cyber",
    ],
    "war_conflict": [
        "war", "military", "troops", "attack", "bomb", "missile", "nato", "ukraine", "russia", "israel", "gaza",
        "conflict", "airstrike",
    ],
    "health_medical": [
        "covid", "cancer", "vaccine", "fda", "who", "pandemic", "drug", "clinical trial", "hospital", "disease",
        "health",
    ],
    "climate_environment": [
        "climate", "carbon", "emission", "fossil fuel", "renewable", "solar", "wind energy", "deforestation",
        "flood", "drought",
    ],
    "sports": [
        "football", "basketball", "soccer", "nba", "nfl", "championship", "tournament", "olympic", "athlete",
        "score",
    ],
    "politics": [
        "president", "congress", "senate", "election", "vote", "democrat", "republican", "parliament",
        "minister", "government", "policy",
    ],
    "business": [
        "acquisition", "merger", "revenue", "profit", "ceo", "company", "corporate", "supply chain", "trade",
    ],
    "crime_law": [
        "arrest", "murder", "court", "judge", "trial", "lawsuit", "indicted", "conviction", "investigation",
        "fbi", "police",
    ],
    "energy": ["oil", "gas", "opec", "barrel", "refinery", "lng", "pipeline", "petroleum", "coal"],
    "diplomacy": [
        "sanction", "treaty", "summit", "un ", "united nations", "ambassador", "bilateral", "foreign minister",
    ],
}
FALLBACK_CATEGORY = ("general", 0.5)

# Labels a category model may return.
MODEL_CATEGORIES = [
    "politics", "finance", "technology", "war_conflict", "climate_environment", "health_medical", "science",
    "sports", "entertainment", "business", "crime_law", "social_issues", "energy", "diplomacy",
]

# Sentiment words.
POSITIVE_WORDS = [
    "growth", "rise", "gain", "surge", "recover", "improve", "success", "breakthrough", "achieve", "positive",
    "strong", "boost", "advance",
]
NEGATIVE_WORDS = [
    "fall", "drop", "crash", "decline", "loss", "risk", "crisis", "war", "attack", "threat", "collapse", "fail",
    "concern", "warning", "death",
]

# Sentiment model labels.
SENTIMENT_LABELS = {
    "LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive",
    "negative": "negative", "neutral": "neutral", "positive": "positive",
}

# Tagger label to entity type.
ENTITY_TYPES = {
    "PERSON": "person", "ORG": "organization", "GPE": "country_city", "LOC": "location",
    "NORP": "nationality_group", "MONEY": "financial", "PERCENT": "financial", "DATE": "temporal",
    "EVENT": "event", "PRODUCT": "product", "LAW": "law", "WORK_OF_ART": "media",
}
LINKING_ENTITY_TYPES = ["person", "organization", "country_city", "location"]

# Words never counted as title keywords.
TITLE_STOPWORDS = ["the", "a", "an", "in", "of", "to", "and", "is", "for", "on", "at", "by"]

# Source reputation.
TRUSTED_SOURCES = [
    "reuters", "bbc", "ap news", "associated press", "the guardian", "new york times", "washington post",
    "nature", "science", "nasa", "noaa", "usgs", "who", "cdc", "esa", "nih", "mit", "sciencedirect",
    "new scientist", "scientific american",
]
DISTRUSTED_SOURCES = [
    "daily mail", "the sun", "national enquirer", "infowars", "zerohedge", "naturalnews", "beforeitsnews",
    "superstation95", "worldnewsdailyreport", "empirenews", "huzlers", "theonion",
]

# Phrases that raise or lower content credibility.
CREDIBILITY_BOOSTS = [
    "confirmed by", "verified by", "peer-reviewed", "published in", "official statement",
    "government confirmed", "nasa confirmed", "military confirmed", "multiple witnesses", "video evidence",
    "photographic evidence", "sensor data", "radar confirmed",
]
CREDIBILITY_PENALTIES = [
    "anonymous source", "unverified claim", "rumor", "conspiracy theory", "some say", "people claim",
    "allegedly", "reportedly seen by one", "social media claim", "viral post", "twitter claim",
]

# Unusual-event subcategories as (name, label, base anomaly, hits needed, keywords).
UNUSUAL_EVENT_SIGNALS = [
    (
        "ufo_alien", "UFO / Alien Sighting", 0.55, 1,
        [
            "ufo", "uap", "unidentified aerial phenomenon", "flying saucer", "extraterrestrial", "alien craft",
            "alien sighting", "orb sighting", "gimbal video", "tic-tac ufo", "congressional uap",
            "pentagon uap", "space anomaly", "unexplained object", "non-human intelligence",
        ],
    ),
    (
        "supernatural_paranormal", "Supernatural / Paranormal", 0.40, 1,
        [
            "ghost", "haunted", "poltergeist", "possession", "exorcism", "demonic", "apparition",
            "supernatural", "paranormal", "seance", "cryptid", "bigfoot", "sasquatch", "loch ness",
            "chupacabra", "yeti", "mothman", "unexplained lights",
        ],
    ),
    (
        "unexplained_scientific", "Unexplained Scientific Anomaly", 0.65, 1,
        [
            "unexplained phenomenon", "scientists baffled", "defies explanation", "anomalous signal",
            "mystery signal", "fast radio burst", "oumuamua", "dark matter detected", "gravitational anomaly",
            "magnetic anomaly", "radiation anomaly", "unknown pathogen", "mass die-off unexplained",
            "sudden unexplained", "inexplicable", "contradicts known physics",
        ],
    ),
    (
        "rare_impossible", "Rare / Unprecedented Event", 0.50, 1,
        [
            "rarest ever recorded", "never seen before", "once in a millennium", "statistically impossible",
            "unprecedented event", "broke all records", "completely unexpected", "defied all predictions",
            "zero probability", "freak accident", "simultaneous mass",
        ],
    ),
    (
        "emerging_pattern_signal", "Emerging Pattern Signal", 0.45, 2,
        [
            "coordinated attack", "pattern of incidents", "series of unexplained", "cluster of cases",
            "multiple witnesses", "independently confirmed", "verified by multiple", "corroborated reports",
            "simultaneous occurrences", "non-coincidental timing",
        ],
    ),
]

# Categories that rule insights read as opportunities and as risks.
OPPORTUNITY_CATEGORIES = ["technology", "finance", "energy"]
RISK_CATEGORIES = ["war_conflict", "crime_law", "climate_environment"]
