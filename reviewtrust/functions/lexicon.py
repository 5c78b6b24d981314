"""Word lists and patterns of the review rules.

Fixed values: every list and pattern below must stay exactly as it is, because the
published scores depend on them.
"""

POSITIVE = [
    "amazing", "awesome", "excellent", "fantastic", "perfect", "outstanding",
    "superb", "brilliant", "wonderful", "incredible", "flawless", "exceptional",
    "great", "good", "love", "loved", "lovely", "happy", "pleased", "satisfied",
    "recommend", "recommended", "best", "impressive", "impressed", "quality",
    "worth", "beautiful", "solid", "reliable", "comfortable", "fast", "easy",
    "delighted", "thrilled", "phenomenal", "stellar", "top-notch", "premium",
]

NEGATIVE = [
    "terrible", "awful", "horrible", "poor", "bad", "worst", "useless",
    "disappointing", "disappointed", "broken", "broke", "defective", "faulty",
    "cheap", "flimsy", "waste", "refund", "returned", "return", "avoid",
    "uncomfortable", "annoying", "frustrating", "failed", "fails", "stopped",
    "rattle", "creak", "creaky", "leaked", "leaking", "died", "dead",
    "overpriced", "misleading", "regret", "unreliable", "mediocre", "meh",
]

INTENSIFIERS = [
    "very", "really", "extremely", "absolutely", "totally", "completely",
    "highly", "super", "so", "incredibly", "definitely", "certainly",
    "truly", "utterly", "hugely", "massively", "insanely", "perfectly",
]

GENERIC_PRAISE = [
    "great product", "good product", "nice product", "excellent product",
    "highly recommend", "would recommend", "i recommend this",
    "works as expected", "works as described", "as described", "as advertised",
    "value for money", "good value", "great value", "worth every penny",
    "exactly what i needed", "exactly what i wanted", "just what i needed",
    "five stars", "5 stars", "ten out of ten", "10/10",
    "very satisfied", "very happy", "so happy", "love it", "love this",
    "great quality", "good quality", "excellent quality", "amazing quality",
    "fast shipping", "fast delivery", "quick delivery", "arrived quickly",
    "will buy again", "would buy again", "buy it", "must have", "must buy",
    "thank you", "thanks seller", "great seller", "a+", "no complaints",
    "does the job", "does what it says", "no issues", "works great",
    "best purchase", "great purchase", "happy with purchase",
    "strongly recommend", "outstanding quality", "superb quality",
    "rapid shipping", "rapid delivery", "prompt delivery", "well packaged",
    "exceeded my expectations", "beyond my expectations", "top quality",
    "excellent item", "superb item", "great item", "nice item",
]

SPECIFIC_MARKERS = [
    "after a week", "after a month", "after two", "after three", "after six",
    "months later", "weeks later", "years later", "so far", "since then",
    "daily", "every day", "every morning", "commute", "on my desk",
    "first thing", "over the weekend",
    "compared to", "compared with", "instead of", "upgraded from",
    "replaced my", "my old", "previous model", "the older",
    "however", "although", "though", "but ", "downside", "drawback",
    "only issue", "one issue", "the catch", "wish it", "would have liked",
    "not perfect", "on the other hand", "caveat", "except",
    "returned it", "contacted support", "warranty", "customer service",
    "instructions", "manual", "assembly", "setup took", "charge", "battery",
    "washed", "cleaned", "installed",
    "january", "february", "march", "april", "june", "july", "august",
    "september", "october", "november", "december",
    "last summer", "last winter", "over christmas", "black friday",
]

STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "than", "that", "this",
    "these", "those", "is", "are", "was", "were", "be", "been", "being", "am",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
    "my", "your", "his", "its", "our", "their", "mine", "yours",
    "of", "to", "in", "on", "at", "for", "with", "without", "from", "by",
    "about", "into", "over", "after", "before", "up", "down", "out", "off",
    "have", "has", "had", "do", "does", "did", "doing", "done",
    "will", "would", "can", "could", "should", "shall", "may", "might", "must",
    "not", "no", "nor", "so", "as", "just", "also", "too", "very", "much",
    "there", "here", "when", "where", "why", "how", "what", "which", "who",
    "all", "any", "both", "each", "more", "most", "other", "some", "such",
    "only", "own", "same", "get", "got", "one", "two",
]

UNIT_PATTERN = (
    r"\b\d+(?:\.\d+)?\s*"
    r"(?:hours?|hrs?|minutes?|mins?|days?|weeks?|months?|years?|"
    r"gb|tb|mb|mm|cm|inch(?:es)?|in|ft|feet|oz|ml|l|litres?|liters?|"
    r"lbs?|kg|g|w|watts?|v|volts?|mah|hz|khz|ghz|mp|k|"
    r"quarts?|gallons?|pints?|cups?|degrees?|percent|%|"
    r"dollars?|usd|eur|gbp)\b"
)
NUMBER_PATTERN = r"\b\d+(?:\.\d+)?\b"
PRICE_PATTERN = r"(?:[$£€¥₦₹]\s?\d[\d,.]*|\b\d[\d,.]*\s?(?:dollars?|usd|eur|gbp|pounds?)\b)"
IMPRECISE_DATE_PATTERN = r"\b(ago|today|yesterday|just now|recently|last (?:week|month))\b"
