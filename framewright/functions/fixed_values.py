"""Word lists, formats and limits that decide results."""

# Cell texts a delimited file uses for "missing" (exact match, no trimming).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Cell texts a delimited file uses for flags.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# Date formats in the order they are tried: the prefix pattern that gates a
# format, and the Spark pattern that parses it (padded or unpadded).
DATE_FORMATS = [
    (r"\d{4}-\d{2}-\d{2}", "yyyy-M-d"),
    (r"\d{2}/\d{2}/\d{4}", "d/M/yyyy"),
    (r"\d{2}/\d{2}/\d{4}", "M/d/yyyy"),
    (r"\d{4}/\d{2}/\d{2}", "yyyy/M/d"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-M-d H:m:s"),
    (r"\d{2}-\d{2}-\d{4}", "d-M-yyyy"),
    (r"\d{2}-\d{2}-\d{4}", "M-d-yyyy"),
]

# Column-name words.
MONEY_WORDS = ["sales", "revenue", "price", "amount"]
SALES_WORDS = ["sale", "revenue"]
CATEGORY_NAME = "category"
DATE_WORD = "date"
ORDER_WORDS = ["order", "sales", "transaction"]

# Words of an order look-up question.
ORDER_QUESTION = "sales order"
ORDER_RELATIONS = ["belong", "related", "associated"]

# Column names a JSON reader treats as dates, and the smallest epoch it accepts.
JSON_DATE_SUFFIXES = ["_at", "_time"]
JSON_DATE_PREFIXES = ["timestamp"]
JSON_DATE_NAMES = ["modified", "date", "datetime"]
JSON_MIN_EPOCH = 31536000

# Limits and defaults.
PREVIEW_ROWS = 5
SAMPLE_ROWS = 1000
SAMPLE_SEED = 42
HISTOGRAM_BINS = 30
TOP_VALUES = 10
TOP_CATEGORIES = 5
LABEL_MAX_BINARY = 2
ONE_HOT_MAX = 10
DISCRETE_BELOW = 20
BAR_CATEGORIES_BELOW = 15
HISTOGRAM_COLUMNS = 3
GENERIC_CHARTS = 5
ROLE_CHARTS = 3

# Text form of a missing cell.
NULL_TEXT = "nan"
