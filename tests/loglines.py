"""Log lines for tests, rendered from the fields of the log format."""

from datetime import datetime

from hitledger import fixed_values as fixed

BROWSER = "Lynx/2.9 libwww-FM/2.14"
CRAWLER = f"Fetch{fixed.BOT_WORD_END}/4.2 (nightly)"
AS_OF = "2025-03-10"

# Everything between the fields, by what stands before each of them.
LAYOUT = {"ip": "", "user": " - ", "time": " [", "request": '] "', "status": '" ', "size": " ", "referer": ' "', "agent": '" "'}
USUAL = {"ip": "198.51.100.7", "user": "-", "status": "200", "size": "512", "referer": fixed.ABSENT, "agent": BROWSER}


def log_time(ts: datetime) -> str:
    return f"{ts:%d}/{fixed.MONTHS[ts.month - 1]}/{ts:%Y:%H:%M:%S} +0000"


def line(ip=None, path="/start", status=None, at="2025-03-09T11:22:33", method="GET", size=None, agent=None, referer=None, rt=None) -> str:
    given = {"ip": ip, "status": status, "size": size, "agent": agent, "referer": referer}
    fields = USUAL | {k: v for k, v in given.items() if v is not None}
    fields |= {"time": log_time(datetime.fromisoformat(at)), "request": f"{method} {path} HTTP/1.1"}
    text = "".join(before + fields[name] for name, before in LAYOUT.items()) + '"'
    return " ".join([text, *([] if rt is None else [str(rt)])])


def frame(spark, lines, source="a.log"):
    return spark.createDataFrame([(source, x) for x in lines], "source string, line string")
