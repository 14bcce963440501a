"""Fixed values.

These must equal the behaviour being reproduced, so they are stated here
plainly, together, in their natural order. Everything else in the package is
derived from them.
"""

# --- fixed values: label vocabulary -------------------------------------
PHISHING = "phishing"
LEGITIMATE = "legitimate"
# class order is alphabetical, so phishing is class index 1
CLASSES = (LEGITIMATE, PHISHING)

# raw label spellings (after strip + lower) and the class they mean
LABEL_SYNONYMS = {
    "spam": PHISHING,
    "ham": LEGITIMATE,
    "1": PHISHING,
    "0": LEGITIMATE,
    "phishing email": PHISHING,
    "safe email": LEGITIMATE,
    "safe": LEGITIMATE,
    "benign": LEGITIMATE,
    "legitimate": LEGITIMATE,
    "phishing": PHISHING,
}

# --- fixed values: keyword groups (substring match on lower-cased text) ---
URGENT_WORDS = ("urgent", "immediately", "suspended", "verify now",
                "action required", "limited time", "warning", "alert")
ACCOUNT_WORDS = ("account", "login", "sign in", "password", "username",
                 "verify", "authentication", "security")
PAYMENT_WORDS = ("payment", "invoice", "bank", "card", "refund",
                 "billing", "transaction", "transfer")

# --- fixed values: engineered feature names, in feature order ------------
ENGINEERED_FEATURES = ("link_count", "has_urgent_words", "has_account_words",
                       "has_payment_words", "exclamation_count", "uppercase_ratio")

# --- fixed values: rule thresholds and texts ------------------------------
EXCLAMATION_LIMIT = 3          # more than this many "!" is a reason
UPPERCASE_LIMIT = 0.30         # a ratio above this is a reason
REASON_UNTRUSTED = "Sender domain is not trusted"
REASON_LINKS = "Email contains links"
REASON_URGENT = "Uses urgent or threatening language"
REASON_ACCOUNT = "Requests account or login information"
REASON_PAYMENT = "Mentions payments or financial information"
REASON_EXCLAIM = "Excessive use of exclamation marks (!)"
REASON_UPPER = "High use of uppercase text"
REASON_FALLBACK = "Model detected suspicious patterns"
REASON_NO_INDICATORS = "No strong phishing indicators detected"
REASON_TRUSTED = "Sender is from a trusted domain"
REASON_SAFE_LANGUAGE = "Email appears safe based on language patterns"

# --- fixed values: serving / message defaults -----------------------------
NO_SUBJECT = "(No subject)"
BODY_LIMIT = 5000              # characters kept from a message body
SHORT_TEXT_LIMIT = 20          # below this no local surrogate explanation
ATTRIBUTION_TOP = 6            # attributions kept per message
SENTENCE_TOP = 4               # feature names quoted in a sentence
ATTRIBUTION_EPS = 1e-9         # attributions smaller than this are dropped
FILLER_TOKENS = ("subject", "from", "body", "com")

# --- fixed values: text model defaults ------------------------------------
MAX_FEATURES = 15000
MIN_DF = 2
NGRAM_MAX = 2
TEST_FRACTION = 0.2
SPLIT_SEED = 42
FOLDS = 5
CURVE_FRACTIONS = (0.1, 0.325, 0.55, 0.775, 1.0)
TOP_COEFFICIENTS = 20

# pandas' default missing-value tokens (read as null by the CSV reader)
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null")

# Spark's own English stop-word list (StopWordsRemover's default). The
# library list of the original pipeline is not available offline; the list is
# a parameter of every text operator.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't
wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split())
