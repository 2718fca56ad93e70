"""Formats, word lists and default limits that decide the results.

Everything here is stated as data, in its natural order, so that it can be compared with the log format's and the
service's documentation.
"""

# The Combined Log Format line with an optional trailing response time in microseconds,
#   ip ident user [time] "request" status bytes "referer" "user agent" response_time
# anchored at the line start and open at its end. Possessive quantifiers keep long malformed lines linear.
# The groups, in order: ip; day, month, year, hour, minute, second of a well-formed time (empty otherwise);
# method and target of the request; status; bytes when an integer (empty otherwise); referer; user agent;
# response time.
ACCESS_LINE = (
    r"(?s)^(\S++)\s++\S++\s++\S++\s++"
    r"\[(?:\s*\+?(\d++)\s*/([^/\]]*+)/\s*\+?(\d++)\s*:\s*\+?(\d++)\s*:\s*\+?(\d++)\s*:\s*\+?(\d++)\s* [^ \]]*|[^\]]++)\]\s++"
    r'"\s*+([^"\s]*+)(?:\s++([^"\s]*+))?+[^"]*+"\s++'
    r"(\d{3})\s++"
    r"(?:([+-]?\d++)(?!\S)|\S++)"
    r'(?:\s++"([^"]*+)")?+(?:\s++"([^"]*+)")?+(?:\s++(\d++))?+.*$'
)
ACCESS_LINE_FIELDS = (
    "ip", "day", "month", "year", "hour", "minute", "second",
    "method", "target", "status", "bytes", "referer", "user_agent", "response_time",
)

# Month abbreviations of the log time; any other text counts as January.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Ingest accepts requests between these two wall-clock times, both inclusive.
EARLIEST_REQUEST = "1970-01-01 00:00:00"
LATEST_REQUEST = "2099-12-31 23:59:59"

# Request methods that count; other first tokens are not methods.
HTTP_METHODS = (
    "GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH", "PROPFIND", "PROPPATCH", "MKCOL",
    "COPY", "MOVE", "LOCK", "UNLOCK", "PRI", "SEARCH",
)

# Case-insensitive marks of an automated user agent. The first holds only at a word end.
BOT_WORD_END = "bot"
BOT_MARKS = (
    "crawler", "spider", "slurp", "mediapartners", "googlebot", "bingbot", "baiduspider",
    "yandex", "duckduck", "facebookexternal", "ahrefsbot", "semrushbot", "mj12bot", "petalbot",
    "check_http", "monitoring", "keepaliveclient", "python-requests", "python-urllib",
    "curl/", "wget/", "go-http-client", "java/", "headless", "scrapy", "httpx", "apache-httpclient",
    "okhttp", "heritrix", "archive.org",
)

# Placeholder of an absent field, and referers that are not counted.
ABSENT = "-"
UNCOUNTED_REFERERS = ("-", "http://-")

# File suffixes that are never logs, and the archive and gzip suffixes.
IGNORED_SUFFIXES = ("duckdb", "wal", "db", "json", "bz2", "zip")
ARCHIVE_SUFFIX = ".tar.gz"
GZIP_SUFFIX = ".gz"

# Traffic categories and their report labels.
CATEGORIES = ("all", "human", "bot")
CATEGORY_LABELS = {"all": "All Traffic", "human": "Human", "bot": "Bot"}

# Default limits.
WINDOW_DAYS = 30
RETENTION_DAYS = 1095
COOLDOWN_SECONDS = 300
MTIME_TOLERANCE_SECONDS = 0.001
SUBNET_ALERT_PCT = 20.0
DRILL_PATHS_PER_IP = 20
DRILL_IPS_PER_PATH = 20
ALL_PATHS = 1000
TOP_PATHS = 10
TOP_IPS = 50
TOP_USER_AGENTS = 20
TOP_REFERERS = 20
TOP_COUNTRIES = 30
TOP_CITIES = 30
TOP_SUBNETS = 50
DRILL_ROWS = 20
DRILL_MAP_KEYS = 200
LOG_TAIL = 200
FIRST_YEAR = 1970
LAST_YEAR = 9999
