import numpy as np

from revlens.llm import urls
from revlens.llm.shared import write_arrays

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.org/fr/x", "block"), (None, "block"), ("", "block"), ("/x", "block"), ("net/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://x.Net", "http://x.net/", "http://example.net/en/a?b", "http://www.example.net/english", "https://badexample.com/de/",
    "https://m.example.com/de/1#x", "HTTP://y.a.org/fr/xyz", "ftp://a.org/fr/y", "http://b.org/fr", "http://x.net:80/", "http://q.net?u=http://w.net/", "http://" + "a." * 200 + "net/" + "p/" * 3000,
    "http://spam-farm.example.org/1", "http://sub.spam-farm.example.org/1", "http://spamfarm.org/", "http://İ.net/",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([len(rest), *[rest.find(c) for c in "/?#" if c in rest]])
    host, rest = rest[:n], rest[n:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([len(rest), *[rest.find(c) for c in "?#" if c in rest]])]
    best = None
    for rule, verdict in RULES:
        if rule and not rule.startswith("/"):
            k = rule.index("/")
            if (host == rule[:k] or host.endswith("." + rule[:k])) and path.startswith(rule[k:]) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
    return host, path, best


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    for segments in (1, 3):
        rules = urls.build(spark.createDataFrame(RULES, "rule string, verdict string"), segments)
        blocked = urls.build(urls.suspect_hosts(pages))
        for r in urls.judge(pages, rules, blocked).collect():
            host, path, best = plain(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
            listed = f"{host}/" if best is None and "spam-farm" in host else None
            assert r["listed"] == listed and r["verdict"] == (best[1] if best else "block" if listed else "allow")


def test_equal_digests_are_confirmed_by_the_string(tmp_path):
    texts = [b"a.net/", b"b.net/"]
    write_arrays(str(tmp_path / "s"), {"digest": np.array([5, 5]), "begin": np.array([0, 6, 12]), "block": np.array([1, 0], np.uint8), "text": np.frombuffer(b"".join(texts), np.uint8)})
    rules = urls.Rules([(5, str(tmp_path / "s"))], [1])
    assert rules.look_up(np.array([5, 5, 5, 4, 6]), ["b.net/", "a.net/", "c.net/", "a.net/", "a.net/"]) == ["allow", "block", None, None, None]


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    none = urls.build(spark.createDataFrame([], "rule string, verdict string"))
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "a.net", "/", None, None, "allow")]
    assert urls.judge(pages.limit(0), none, none).collect() == []
