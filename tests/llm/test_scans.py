"""URL judgements and model spans of secrets against plain Python."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from quillspark.llm import secrets, urls

from .helpers import ODD, frame


def verdict(url, entries):
    """(host, path, key): the entry of the least rank, the longest, the least of those that fit."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(rank, -len(k), k) for k, rank, _ in entries if (host == (h := k.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(k[len(h) :])]
    return host, path, min(fits)[2] if fits and host else None


def test_urls_of_many_lengths_and_one_hot_url(spark):
    """5,200 lengths of listed paths, a third of all rows with one URL, repeated rows, columns that clash."""
    r = random.Random(6)
    entries = [(f"site{k % 7}.org/{'p' * k}", k % 2, "block") for k in range(5200)] + [("org/", 5, "allow"), ("org/", 5, "block"), ("a.org/x/", 0, "allow"), (None, 0, "block")]
    odd = [None, "", "no scheme", "http://", "https:///p", "ftp://A.ORG/x/?q", "http://b.a.org/x/y#z", "http://aorg/x/", "x://a.org", "http://é.org/é/", "http://site3.org/" + "p" * 6000, "http://SITE4.org/ppp/é"]
    texts = odd + [f"http://s.site{r.randrange(8)}.org/{'p' * r.randrange(5300)}{r.choice(['', '/', '?p', 'q'])}" for _ in range(60)] + ["http://hot.site2.org/" + "p" * 40] * 40
    pages = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "page_id long, url string, row_ int, passed_ string")
    got = urls.judge(pages, spark.createDataFrame(entries, "key string, rank int, verdict string"))
    assert got.columns == [*pages.columns, "host", "path", "best"]
    rows = {x.page_id: x for x in got.collect()}
    listed = [e for e in entries if e[0]]
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.host, x.path, x.best and x.best.key) == verdict(t, listed), t
        assert (x.url, x.row_, x.passed_) == (t, i, "x")
    assert next(x for x in rows.values() if x.url == "x://a.org").best is None
    none = spark.createDataFrame([], "key string, rank int, verdict string")
    assert urls.judge(pages, none).where("best is not null").count() == 0 and urls.judge(pages.limit(0), none).count() == 0


def model_spans(text, table, base):
    """All parts of runs outside the base spans whose score says random, in plain Python."""
    covered = [False] * (len(text) + 1)
    for a, b in base:
        covered[a:b] = [True] * (b - a)
    out = []
    for m in re.finditer(secrets.MODEL, text):
        at = m.start()
        while at < m.end():
            end = at
            while end < m.end() and not covered[end]:
                end += 1
            s = text[at:end]
            if len(s) >= secrets.LEAST:
                codes = [secrets.ALPHABET.find(c) for c in s]
                ratio = sum(table[a * len(secrets.ALPHABET) + b] for a, b in zip(codes, codes[1:])) / (len(s) - 1)
                if ratio > secrets.CUT + secrets.SHORT / len(s):
                    out.append((at, end))
            at = max(end, at + 1)
            while at < m.end() and covered[at]:
                at += 1
    return out


def random_string(r, n):
    return "".join(r.choice(secrets.ALPHABET[:62]) for _ in range(n))


def test_model_spans_against_brute_force(spark):
    """Tokens that no base pattern finds, beside names, paths, addresses and base spans that they touch."""
    r = random.Random(12)
    tokens = [random_string(r, n) for n in (20, 24, 32, 40, 64) for _ in range(8)]
    names = ["user_account_manager_handler", "getElementsByClassNameAndParent", "Donaudampfschifffahrtsgesellschaft", "src/main/java/org/example/service", "internationalization-of-responses", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "----------------------------------", "MAXIMUM_RETRY_COUNT_DEFAULT"]
    digest = hashlib.sha1(b"y").hexdigest()
    texts = ODD + [f"é bearer {t} then {n}" for t in tokens for n in names[:2]] + names + [f"https://h.org/{t}?x=1" for t in tokens]
    texts += [f"{digest}Q{tokens[-1]}", f"password={tokens[-2]} {tokens[-3]}", f"{tokens[-1]}{digest}", " ".join(tokens * 20)]
    table = secrets.train(secrets.samples(spark))
    rows = secrets.scan(frame(spark, texts).withColumn("model", F.lit(1)), table, prefix="found_").orderBy("doc_id").collect()
    hits = 0
    for x, t in zip(rows, texts, strict=True):
        base = [(s.start, s.end) for k in secrets.KINDS[:3] for s in x[f"found_{k}"]]
        got = [(s.start, s.end) for s in x.found_model]
        assert got == model_spans(t or "", table, base) and x.model == 1, t
        assert all(t[s.start : s.end] == s.s for s in x.found_model)
        hits += any(t and tokens[i] in t and any(t[a:b] == tokens[i] for a, b in got) for i in range(len(tokens)))
    assert hits >= 0.9 * (2 * len(tokens))
    plain = dict(zip(texts, rows, strict=True))
    assert not any(plain[n].found_model for n in names)
    assert secrets.scan(frame(spark, [])).count() == 0


def test_training_from_a_labelled_table(spark):
    rows = [("abababababab", 0)] * 20 + [("xzxzxzxzxzxz", 1)] * 20
    table = secrets.train(spark.createDataFrame(rows, "s string, label int"))
    out = secrets.scan(frame(spark, ["xzxzxzxzxzxzxzxzxz abababababababababab"]), table).first()
    assert [(s.start, s.end) for s in out.model] == [(0, 18)] and math.isfinite(sum(table))


def test_false_alarms_on_documents(spark, sf):
    """Ordinary documents of the given table: model spans are rare."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert secrets.scan(docs).where("size(model) > 0").count() <= 0.02 * docs.count()


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i:024x}" for i in range(3000))
    out = secrets.scan(frame(spark, [text])).first()
    assert [(s.start, s.end) for s in out.hex] == [(25 * i, 25 * i + 24) for i in range(3000)]
