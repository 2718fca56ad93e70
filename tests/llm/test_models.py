"""Token counts, toxicity, URL filter and quality rules."""

import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hitledger.llm import quality, queries, token_counts, toxicity, url_filter
from tests.llm.corpus import EDGES, lower, prose, table, words


def test_counts_equal_the_library_s_unigram_model(spark):
    from tokenizers import models
    scores = token_counts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))
    model = models.Unigram([("<unk>", min(scores.values()) - token_counts.UNKNOWN), *scores.items()], 0, False)
    tokens = sorted({token_counts.BEGIN + w for _, text, *_ in EDGES for w in words(text)[:300] if w.isascii() and "\0" not in w} | {
        token_counts.BEGIN + w for w in ("unbelievable", "tokenization", "straße", "1234567", "a", "")})
    assert token_counts.count_sorted(tokens, scores) == [len(model.tokenize(t)) for t in tokens]


def test_counts_of_a_small_vocabulary(spark):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -2.0, "ba": -4.0}
    assert token_counts.count_sorted(["▁", "▁ab", "▁aba", "▁abé", "▁ba"], scores) == [1, 2, 2, 4, 2]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(
        table(spark, [(1, "ab aba ab", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (4, "ba\nba", "en", "a")]), scores).collect()}
    assert got == {1: (3, 6), 2: (0, 0), 3: (0, 0), 4: (2, 4)}
    assert token_counts.token_counts(table(spark, []), scores).count() == 0


def test_counts_query_covers_every_document(spark):
    frame = queries.op3_token_counts(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id")
    assert len(frame) == len(docs)
    scores = token_counts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))
    for row in frame.head(20).itertuples():
        w = words(docs.text[row.doc_id])
        each = dict(zip(sorted(set(w)), token_counts.count_sorted(sorted({token_counts.BEGIN + x for x in w}), scores)))
        assert (row.n_words, row.n_tokens) == (len(w), sum(each[x] for x in w))


def test_sentences_and_noisy_or():
    text, other = "One two. Three four!\nfive\n\n six? seven".encode(), b" \n "
    w, first, owner = toxicity.split_sentences([text, other, b"eight"])
    assert [w[a] for a in first] == [b"one", b"three", b"five", b"six?", b"seven", b"eight"]
    assert owner.tolist() == [0, 0, 0, 0, 0, 2]
    assert np.allclose(toxicity.noisy_or(np.array([0.5, 0.5, 0.1]), np.array([0, 0, 2]), 4), [0.75, 0, 0.1, 0])


def test_toxicity_finds_documents_and_their_sentences(spark):
    draw = random.Random(1)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        sentences = [" ".join(draw.choices(plain, k=8)) + "." for _ in range(6)]
        if i % 5 == 0:
            sentences[i % 6] = " ".join(draw.choices(plain, k=4)) + f" grumpf{'abc'[i % 3]} {draw.choice(plain)}."
        rows.append((i, " ".join(sentences), "en", "a"))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, known = table(spark, [*rows, *[r for r in EDGES if r[0] is None]]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    aside = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((found[i]["score"] >= 0.5) == (i % 5 == 0) for i in aside)
    assert len(aside) > 100 and right / len(aside) > 0.97
    hits = [i for i in aside if i % 5 == 0 and found[i]["sentences"]]
    assert hits and all("grumpf" in " ".join(rows[i][1].split()[found[i]["sentences"][0]["start"]:found[i]["sentences"][0]["end"]]) for i in hits)
    held = {r["doc_id"] for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert held == set(aside)


def test_toxicity_without_labels_or_text(spark):
    docs = table(spark, EDGES)
    for labels in ([], [(3, 1, 0)], [(3, 1, None)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        scores = toxicity.score_documents(docs, model).collect()
        assert len(scores) == len(EDGES) and all(r["score"] == 0 for r in scores)
    assert toxicity.score_documents(table(spark, []), model).count() == 0


def test_toxicity_trains_on_one_text_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: (texts, labels.tolist()))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:10]
    docs = table(spark, [(i, f"text {i} {k}", "en", "a") for i in ids for k in range(50 if i == ids[0] else 1)])
    texts, labels = toxicity.train(docs, spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int"))
    assert sorted(int(t.split()[1]) for t in texts) == ids and sorted(labels) == sorted(i % 2 for i in ids)


def test_toxicity_places_every_offending_sentence(spark):
    weights = np.zeros(toxicity.FEATURES, np.float32)
    weights[toxicity.word_features(b"grumpf.")] = 5.0
    docs = table(spark, [(1, "grumpf. fine. " * 500, "en", "a"), (2, "fine.", "en", "a")])
    found = {r["doc_id"]: r["sentences"] for r in toxicity.score_documents(docs, toxicity.Model(weights, -5.0)).collect()}
    assert [(s["start"], s["end"]) for s in found[1]] == [(2 * i, 2 * i + 1) for i in range(500)] and found[2] == []


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


URLS = [None, "", "net", "http://net", "http://net/", "HTTP://A.NET/x?y", "https://a.example.net/en/", "https://example.net/en", "ftp://notnet/x",
        "http://example.com?u=http://x.net/", "http://example.com/de/#a?b", "http://xexample.com/de/1", "http://É.Org/fr/ä", "a://b://c.net/d",
        "http://x.org/fr/1/2?a=1&b=2", "://net/", "http:///de/", "http://net:80/"] + [f"http://s{i}.example.org/p/{i}" for i in range(30)]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", 3.0) for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, host string, path string, label double")
    found = url_filter.train(pages, queries.URL_RULES)
    rows = {r["page_id"]: r for r in url_filter.judge(pages, found).collect()}
    assert len(rows) == len(URLS) + 1
    for i, url in enumerate(URLS):
        host, path, rule = judged(url, queries.URL_RULES)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule and rule.text), url
        assert rows[i]["verdict"] in ("allow", "block") and (rule is None or rows[i]["verdict"] == rule.verdict)
    assert url_filter.judge(pages.filter("false"), found).count() == 0
    one_kind = url_filter.train(pages, [url_filter.Rule("net/", "block")])
    assert {r["verdict"] for r in url_filter.judge(pages, one_kind).collect()} == {"block"}
    nothing = url_filter.train(pages.filter("false"), queries.URL_RULES)
    assert {r["verdict"] for r in url_filter.judge(pages, nothing).filter("rule IS NULL").collect()} == {"allow"}


def test_trees_learn_held_out_urls(spark):
    """Blocked URLs have long paths of digits and many parameters; unseen hosts of one suffix are told apart by that alone."""
    draw = random.Random(4)

    def url(bad, host):
        return f"http://{host}/{draw.randint(10**9, 10**10) if bad else 'news/' + draw.choice(['a', 'bc', 'def'])}" + ("?a=1&b=2&c=3" if bad else "")
    known = [(i, url(i % 2, f"h{i}.{'bad' if i % 2 else 'good'}.example")) for i in range(600)]
    fresh = [(1000 + i, url(i % 2, f"n{i}.other")) for i in range(200)]
    rules = [url_filter.Rule("bad.example/", "block"), url_filter.Rule("good.example/", "allow")]
    found = url_filter.train(spark.createDataFrame(known, "page_id long, url string"), rules)
    rows = url_filter.judge(spark.createDataFrame(fresh, "page_id long, url string"), found).collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in rows) > 190


def test_url_features(spark):
    """Lexical features of awkward URLs, counted in plain Python."""
    urls = [u for u in URLS if u is not None] + ["http://a-b.example.com/x/9/?p=1&q=&&r#f?s", "://", "http://h/\u00e9\u00e9?x#y", "ftp://1.2.3.4"]
    rows = url_filter.with_features(url_filter.with_parts(spark.createDataFrame([(u,) for u in urls], "url string"))).collect()
    for r in rows:
        u, n = r["url"], max(1, len(r["url"]))
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = lower(host)
        query = re.search(r"\?([^#]*)", u)
        entropy = -sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u))
        want = (len(u), len(host), len(path), len(host.split(".")), path.count("/"), host.count("-"), sum(c in "0123456789" for c in u) / n, entropy,
                query[1].count("&") + 1 if query and query[1] else 0, int("#" in u))
        assert [r[f] for f in url_filter.LEXICAL] == pytest.approx(want), u
        assert (r["suffix"], r["domain"]) == (host.split(".")[-1], ".".join(host.split(".")[-2:]))


def test_suffix_rates_leave_the_own_domain_out(spark):
    domains = [("a.x", "x", 1.0), ("b.x", "x", 0.5), ("c.x", "x", 0.0), ("only.y", "y", 1.0)]
    pages = spark.createDataFrame([("http://h.a.x/",), ("http://new.x/",), ("http://www.only.y/",), ("http://z/",), (None,)], "url string")
    rated = url_filter._with_suffix_rates(url_filter.with_features(url_filter.with_parts(pages)),
                                          spark.createDataFrame(domains, "domain string, suffix string, rate double"), 0.25)
    got = {r["url"]: (r["suffix_rate"], r["suffix_seen"]) for r in rated.collect()}
    five = url_filter.SMOOTHING

    def rate(*others):
        return pytest.approx(((sum(others) + five * 0.25) / (len(others) + five), math.log1p(len(others))))
    assert got["http://h.a.x/"] == rate(0.5, 0.0) and got["http://new.x/"] == rate(1.0, 0.5, 0.0)
    assert got["http://www.only.y/"] == got["http://z/"] == got[None] == rate()


def test_hosts_of_one_suffix_are_told_apart(spark):
    """Held-out URLs under a suffix whose only labelled domain is blocked: their form decides, not the suffix."""
    draw = random.Random(8)

    def url(bad, host):
        return f"http://{host}/" + (f"{draw.randint(10**9, 10**10)}?a=1&b=2" if bad else draw.choice(["news", "about/us", "x"]))
    known = [(i, url(i % 3 == 0, f"h{i}.{('bad.com', 'good.org', 'fine.net')[i % 3]}")) for i in range(900)]
    rules = [url_filter.Rule("bad.com/", "block"), url_filter.Rule("good.org/", "allow"), url_filter.Rule("fine.net/", "allow")]
    fresh = [(2000 + i, url(i % 2, f"n{i}.new.com")) for i in range(200)]
    found = url_filter.train(spark.createDataFrame(known, "page_id long, url string"), rules)
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(fresh, "page_id long, url string"), found).collect()}
    assert sum((verdicts[i] == "block") == bool(i % 2) for i, _ in fresh) > 190


def statistics(text):
    w, windows, covered, seen, repeats = words(text), {}, set(), set(), 0
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    for line in (text or "").split("\n"):
        if words(line):
            repeats += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(covered), failed


def test_quality_statistics(spark):
    rows = [*EDGES, (50, "a b c d e f g h " * 9, "en", "a"), (51, prose(30) + " " + prose(8) + " | # <b> $5 & 100%", "en", "a"),
            (52, " x\n x\nx \n\n\n x", "en", "a")]
    got = quality.with_statistics(table(spark, rows).withColumnRenamed("n_words", "_x")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *[r[n] for n in names]) for r in got), key=repr) == sorted(
        ((doc_id, *statistics(text)) for doc_id, text, *_ in rows), key=repr)


@pytest.mark.parametrize("good", [5, 60, 700])
def test_binomial_test_is_exact(good):
    for risk in (0.01, 0.2):
        for rejected in range(0, good + 1, max(1, good // 30)):
            p = Fraction(risk)
            tail = sum(math.comb(good, k) * p ** k * (1 - p) ** (good - k) for k in range(rejected + 1))
            for error in (0.05, 1e-4):
                assert quality.within_risk(rejected, good, risk, error) == (tail <= Fraction(error) and rejected < good * risk)


def test_cutoffs_hold_their_promise():
    """Draws from a known law: the chosen cutoff's true share of good documents exceeds the risk in few of many samples."""
    draw, law = np.random.default_rng(3), np.array([0.9 * 0.8 ** i for i in range(50)])
    law, broken, used = law / law.sum(), 0, 0
    for _ in range(200):
        good, bad = (np.bincount(draw.choice(50, n, p=p), minlength=50) for n, p in ((800, law), (200, np.full(50, 0.02))))
        levels = quality.choose_cutoffs({("en", "symbols"): list(zip(good.tolist(), bad.tolist()))}, 0.3, 0.05)
        if levels:
            used += 1
            broken += law[levels["en", "symbols"]:].sum() > 0.3 / len(quality.RULES)
    assert used > 100 and broken <= 20


def test_quality_verdicts(spark):
    good = [(100 + i, prose(100, i), ("en", None)[i % 2], "a") for i in range(1400)]
    junk = [(5000 + i, " ".join(w + "###" for w in prose(60, i).split()), ("en", None)[i % 2], "a") for i in range(60)]
    docs = table(spark, [*good, *junk, *EDGES])
    labels = spark.createDataFrame([(d, int(d < 5000)) for d, *_ in [*good, *junk]] + [(3, None), (None, 1)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {d for d, *_ in good} <= ids and not ids & {d for d, *_ in junk} and not ids & {0, 1, 3, 14}
    assert quality.keep_good(table(spark, []), labels).count() == 0
    few = quality.calibrate(quality.with_statistics(docs), labels.limit(0))
    assert few.levels == {}
