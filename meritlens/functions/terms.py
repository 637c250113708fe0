"""Word lists, weights and lookup tables that results depend on.

They are data, stated once here; every operator takes them as defaults.
"""

# Listing kinds, in output order.
LISTING_KINDS = ("device", "case", "cable", "charger", "tips", "cleaning", "accessory", "other")

# Order in which the non-device kinds are tried.
KIND_RULE_ORDER = ("cleaning", "tips", "cable", "charger", "case", "accessory")

# Phrases per listing kind, matched as substrings of normalised text.
KIND_PHRASES = {
    "case": ("bumper", "case", "cover", "guard", "pouch", "protector", "shell", "skin", "sleeve"),
    "cable": (
        "3 5mm", "aux", "cable", "cord", "displayport", "ethernet", "hdmi", "lightning",
        "thunderbolt", "usb", "usb c",
    ),
    "charger": (
        "adapter", "charger", "charging station", "charging stand", "dock", "dock station",
        "magsafe charger", "power adapter", "wireless charger",
    ),
    "tips": (
        "earbud tip", "earbud tips", "ear cushion", "ear cushions", "ear hook", "ear hooks",
        "ear pad", "ear pads", "ear tip", "ear tips", "earbud cover", "eartip", "eartips",
        "earpad", "earpads", "earplug", "earplugs",
    ),
    "cleaning": ("brush", "cleaner", "cleaning kit", "cleaning pen", "dust remover"),
    "accessory": (
        "accessories", "accessory", "anti lost", "bundle", "chain", "clip", "decal", "decoration",
        "decorations", "film", "holder", "hook", "kit", "keychain", "lanyard", "mount",
        "replacement", "stand", "sticker", "strap", "tool",
    ),
    "device": (
        "airpod", "airpods", "camera", "camcorder", "console", "dslr", "earbud", "earbuds",
        "earphone", "earphones", "gaming headset", "headphone", "headphones", "headset", "iphone",
        "ipad", "laptop", "macbook", "microphone", "monitor", "notebook", "phone", "pixel",
        "router", "smartphone", "smartwatch", "speaker", "tablet", "watch", "webcam",
    ),
}

# Category phrases per listing kind.
KIND_CATEGORY_HINTS = {
    "case": ("cases", "headphone cases"),
    "cable": ("cables", "cables interconnects", "lightning cables"),
    "charger": ("chargers", "charging stations", "docks"),
    "tips": ("earpads",),
    "device": (
        "camera photo", "cell phones", "earbud headphones", "headphones earbuds",
        "home audio theater", "portable audio accessories",
    ),
}

# Words that mark an accessory when they stand alone in a title.
ACCESSORY_WORDS = (
    "adapter", "band", "cable", "case", "charger", "cord", "cover", "dock", "earpads", "hook",
    "holder", "mount", "protector", "replacement", "skin", "sleeve", "stand", "strap", "tips",
)

# Phrases that mark an accessory wherever they occur.
ACCESSORY_CUES = (
    "anti lost", "adapter for", "case for", "cable for", "charger for", "compatible with",
    "cover for", "protective case", "protector for", "replacement for", "skin for",
)

# Words that confirm an accessory reading.
ACCESSORY_CONTEXT = (
    "anti", "carabiner", "cover", "cute", "dustproof", "earhook", "fashion", "hard", "hook",
    "keychain", "protective", "rugged", "shockproof", "silicone", "soft", "tpu",
)

# Device families an accessory can be made for.
DEVICE_FAMILIES = (
    "airpods", "camera", "console", "earbuds", "galaxy", "headphones", "iphone", "ipad", "kindle",
    "laptop", "macbook", "monitor", "phone", "pixel", "playstation", "speaker", "switch", "tablet",
    "watch", "xbox",
)

# Product types that are goods in their own right.
PRIMARY_TYPES = (
    "camera", "console", "earbud", "earbuds", "headphone", "headphones", "headset", "in ear",
    "laptop", "monitor", "phone", "smartphone", "speaker", "tablet", "watch",
)
PRIMARY_TYPE_WORDS = tuple(dict.fromkeys(w for t in PRIMARY_TYPES for w in t.split()))

# Item-specific keys for brand, model and type, in order of preference.
BRAND_KEYS = ("brand", "manufacturer", "brand name", "make")
GENERIC_BRANDS = ("does not apply", "generic", "unbranded", "unknown")
MODEL_KEYS = ("model", "model name", "product line", "series")
TYPE_KEYS = ("type", "product type")

# Title noise and the accessories whose trailing "with ..." clause is cut.
TITLE_NOISE = ("nib", "bnib", "brand new", "new in box", "open box", "sealed")
REMOVABLE_WITH = (
    "accessories", "bundle", "cable", "case", "charger", "charging case", "cover", "ear tips",
    "keychain", "lanyard", "magsafe", "skin",
)

# Words left out of retrieval tokens and of core identity tokens.
RETRIEVAL_STOP = ("apple", "bluetooth", "earbud", "earbuds", "generation", "in", "the")
CORE_STOP = (
    "1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th", "10th", "bluetooth",
    "generation", "gen", "new", "series", "true", "wireless",
)
VARIANT_WORDS = ("max", "mini", "plus", "pro", "ultra")

# Product kinds and their alias words, in tie-break order.
KIND_ALIASES = {
    "camera": ("camera", "camcorder", "dslr", "mirrorless", "webcam"),
    "console": ("console", "playstation", "switch", "xbox"),
    "earbud": (
        "airpod", "airpods", "earbud", "earbuds", "earphone", "earphones", "earset", "headset",
        "headsets", "iem",
    ),
    "headphone": ("headphone", "headphones"),
    "laptop": ("chromebook", "laptop", "macbook", "notebook"),
    "monitor": ("display", "monitor"),
    "pen": ("pencil", "pen", "stylus"),
    "phone": ("galaxy", "iphone", "phone", "pixel", "smartphone"),
    "speaker": ("soundbar", "speaker", "speakers"),
    "tablet": ("ipad", "tablet"),
    "watch": ("applewatch", "smartwatch", "watch"),
    "charger": ("adapter", "charger", "charging", "dock", "powerbank", "usb"),
}
AUDIO_KINDS = ("earbud", "headphone")

# Title words ignored when two listings are compared feature by feature.
COMPARE_STOP = (
    "the", "and", "for", "with", "new", "original", "official", "authentic", "sale", "free",
    "shipping",
)

# Trust scores and their bucket columns, in model order.
TRUST_SCORES = (
    "claim_trust_score", "signal_trust_score", "heuristic_pressure_score", "competence_score",
    "benevolence_score", "integrity_score", "predictability_score",
)
GRAPH_BUCKETS = (
    "claim_bucket", "signal_bucket", "pressure_bucket", "competence_bucket", "benevolence_bucket",
    "integrity_bucket", "predictability_bucket",
)
LABEL_BUCKETS = (
    "claim_trust_bucket", "signal_trust_bucket", "heuristic_pressure_bucket", "competence_bucket",
    "benevolence_bucket", "integrity_bucket", "predictability_bucket",
)

# Accepted spellings of each annotation score.
SCORE_ALIASES = {
    "claim_trust_score": ("claim_trust_score", "claim_trust", "claim_score"),
    "signal_trust_score": ("signal_trust_score", "signal_trust", "heuristic_signal_trust_score"),
    "heuristic_pressure_score": ("heuristic_pressure_score", "heuristic_pressure", "pressure_score"),
    "competence_score": ("competence_score", "competence"),
    "benevolence_score": ("benevolence_score", "benevolence"),
    "integrity_score": ("integrity_score", "integrity"),
    "predictability_score": ("predictability_score", "predictability"),
    "overall_confidence": ("overall_confidence", "confidence"),
}

# Truth labels given as words.
TRUTH_WORDS = {
    "true": 1, "real": 1, "1": 1, "mostly-true": 1,
    "fake": 0, "false": 0, "0": 0, "pants-fire": 0, "barely-true": 0,
}

# Weights of the value network.
REVIEW_WEIGHTS = {"polarity": 0.80, "strength": 0.12, "volume": 0.08}
QUALITY_WEIGHTS = {
    "trust": 0.4166666666666667, "review": 0.4166666666666667, "rating": 0.12,
    "verified": 0.04666666666666667,
}
VALUE_WEIGHTS = {"quality": 0.60, "price": 0.35, "service": 0.05}
SERVICE_WEIGHTS = {"warranty": 0.55, "returns": 0.45}
PRICE_LEVELS = (0.00, 0.15, 0.35, 0.50, 0.65, 0.82, 1.00)
KERNEL_SHARPNESS = 1.40
VALUE_STEEPNESS = 5.0

# Priors of the evidence nodes, in state order.
PRIORS = {
    "trust": (0.08, 0.17, 0.30, 0.27, 0.18),
    "polarity": (0.08, 0.16, 0.30, 0.26, 0.20),
    "strength": (0.30, 0.45, 0.25),
    "rating": (0.20, 0.35, 0.45),
    "volume": (0.30, 0.40, 0.30),
    "verified": (0.20, 0.35, 0.45),
    "price": (0.04, 0.08, 0.18, 0.40, 0.18, 0.08, 0.04),
    "warranty": (0.25, 0.50, 0.25),
    "returns": (0.20, 0.50, 0.30),
}

# Common English function words left out of word n-grams.
ENGLISH_STOP = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any",
    "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few",
    "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of",
    "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own",
    "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs",
    "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves",
)
