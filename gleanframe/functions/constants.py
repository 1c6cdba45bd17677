"""Values that have to equal the published behaviour; none of them is tunable."""

# fixed values: cell texts a CSV reader takes for missing
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# fixed values: cell texts the trim rule turns into null
CLEAN_NULL_TOKENS = (
    "null", "None", "N/A", "n/a", "undefined", "nan", "NaN", "?", "#N/A", "-", "none",
)

# fixed values: texts that count as missing in the health score
HEALTH_MISSING_TEXTS = ("", "NaN", "null", "None")

# fixed values: header fragments that mark a column as likely personal data
PII_HEADER_KEYWORDS = (
    "email", "phone", "mobile", "ssn", "social_security", "credit_card", "card_number", "passport",
    "password", "ip_address", "first_name", "last_name", "full_name", "address", "zipcode",
)

# fixed values: patterns for personal data, each for a whole cell
PII_PATTERNS = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "phone": r"^\+?[\d\s\-\(\)]{7,15}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}

# fixed values: header fragments that keep value counts out of a summary
SUMMARY_ID_KEYWORDS = (
    "id", "ssn", "uuid", "guid", "token", "key", "password", "email", "phone", "hash", "secret",
)

# fixed values: header fragments of amounts that cannot be negative
NON_NEGATIVE_KEYWORDS = (
    "age", "price", "revenue", "cost", "amount", "salary", "quantity", "score", "count", "val",
    "fee", "total",
)

# fixed values: prompt fragments that are off topic
OFF_TOPIC_KEYWORDS = (
    "joke", "weather", "poem", "recipe", "song", "who is the president", "capital of", "movie",
    "sports", "football", "cricket", "translate to french", "translate to spanish", "who are you",
    "write code for flappy bird", "minecraft", "play game",
)

# fixed values: characters that count as white space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

MASK = "••••••••"
IMPUTED_TEXT = "N/A"
AGE_LIMIT = 120

# fixed values: quotas of the usage summary
TOKEN_LIMIT = 200_000
STORAGE_LIMIT_GB = 2
REPORT_LIMIT = 50
DATASET_LIMIT = 100
