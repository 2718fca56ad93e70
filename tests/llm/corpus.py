"""Small tables of documents for the operators' tests: every awkward kind of row, and clashing extra columns."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, fingerprint string, part int, "
          "label double, size long, row string")


def table(spark, rows):
    """(doc_id, text, lang, source) rows as documents with extra columns that results of operators are named like."""
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, None, "x", 7, None, -5, "r") for r in rows], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(n, salt=0):
    """``n`` different-looking words."""
    return " ".join(f"w{(i * 7919 + salt * 104729) % 99991:x}" for i in range(n))


LONG = prose(30_000, 5)
EDGES = [
    (0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n\r\x0b\x0c ", None, None), (3, "Hello World", "en", "b"),
    (4, "hello world", "en", "b"), (4, "hello world", "en", "b"), (5, "hello wORLD", "de", "b"), (6, "ÄRGER über Σας", "de", None),
    (7, "ärger ÜBER σας", "de", "c"), (8, prose(60), "en", "c"), (9, prose(60), "fr", "c"), (10, prose(59) + " End", "en", "c"),
    (11, prose(30) + "\n\n\n" + prose(30), "en", "a"), (12, "a b  c\u3000d <|endoftext|> e\n\n", "en", "a"), (13, LONG, "en", "a"),
    (14, "same line here\n" * 40, "en", "a"), (15, "x" * 5000, "en", "b"), (None, "no id", "en", "a"), (None, prose(60), "en", "b"),
    (16, "É é É é \x00 y", "fr", "b"), (-3, prose(45, 2), "en", "a"), (17, prose(45, 2) + " tail", None, "a")]
