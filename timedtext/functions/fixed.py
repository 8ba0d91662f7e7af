"""Names, lists and limits that results depend on."""

# --- fixed values -----------------------------------------------------------

# Encoding catalog in order of priority; detection takes the first that fits.
ENCODINGS = [
    "utf-8",
    "utf-8-sig",
    "cp874",
    "tis-620",
    "iso8859-11",
    "cp1250",
    "cp1251",
    "cp1252",
    "cp1253",
    "cp1254",
    "cp1255",
    "cp1256",
    "cp1257",
    "cp1258",
    "cp932",
    "cp936",
    "cp949",
    "cp950",
    "euc-jp",
    "euc-kr",
    "shift_jis",
    "gb2312",
    "big5",
    "iso8859-1",
    "iso8859-2",
    "iso8859-3",
    "iso8859-4",
    "iso8859-5",
    "iso8859-6",
    "iso8859-7",
    "iso8859-8",
    "iso8859-9",
    "iso8859-10",
    "iso8859-13",
    "iso8859-14",
    "iso8859-15",
    "iso8859-16",
]

# Encodings recommended per language, most preferred first.
RECOMMENDED = {
    "th": ["utf-8", "tis-620", "cp874", "iso8859-11"],
    "zh-CN": ["utf-8", "gb2312", "cp936"],
    "zh-TW": ["utf-8", "big5", "cp950"],
    "ja": ["utf-8", "shift_jis", "euc-jp", "cp932"],
    "ko": ["utf-8", "euc-kr", "cp949"],
    "ru": ["utf-8", "cp1251", "koi8-r", "iso8859-5"],
    "ar": ["utf-8", "cp1256", "iso8859-6"],
    "he": ["utf-8", "cp1255", "iso8859-8"],
    "tr": ["utf-8", "cp1254", "iso8859-9"],
    "el": ["utf-8", "cp1253", "iso8859-7"],
    "vi": ["utf-8", "cp1258"],
}
RECOMMENDED_DEFAULT = ["utf-8", "utf-8-sig", "cp1252", "iso8859-1", "iso8859-15"]

# Targets when a job names none, and when the function is called with none.
JOB_TARGETS = ["utf-8", "utf-8-sig", "tis-620", "cp874"]
FANOUT_TARGETS = ["utf-8", "utf-8-sig", "cp874", "tis-620", "iso8859-11"]

# Target languages whose words are separated by spaces, and Chinese targets.
SPACED_LANGUAGES = ["fr", "en", "de", "es", "it", "pt", "ru"]
CHINESE_LANGUAGES = ["zh-CN", "zh-TW"]
CHINESE_LANGUAGES_V0 = ["zh-CN"]
CHINESE_COMMA = "，"

# A detected encoding must give more characters than this.
MIN_DETECT_CHARS = 100
# Characters of one translation request.
REQUEST_CHARS = 3500

# White space and word characters as in Unicode-aware Python patterns.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# Sentence boundary: one white-space character after a terminator, except after
# "x.y."-like runs, "Xx." and (v1 only) a single letter with a dot. The terminator is
# asked for first, so that the search gives up at once at nearly every position.
BOUNDARY = {
    "v1": rf"(?<=[.?!])(?<!{WORD}\.{WORD}.)(?<![A-Z][a-z]\.)(?<!(?<!{WORD})[A-Za-z]\.){SPACE}",
    "v0": rf"(?<=[.?])(?<!{WORD}\.{WORD}.)(?<![A-Z][a-z]\.){SPACE}",
}
# Number of characters before a boundary that the pattern looks at.
BOUNDARY_LOOKBACK = 4

STATUS_SUCCESS = "success"
STATUS_RATE_LIMITED = "rate_limited"
STATUS_ERROR = "error"
STATUS_PARTIAL = "partial"  # written, but not all of it translated or written

# --- end of fixed values ----------------------------------------------------
