import re

from tillroll.llm import urls

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x", "http://a.example.net/de/", "http://notexample.net/en/",
        "http://net", "http://net/", "https://x.example.com/de/a#b", "https://example.com/fr/", "http://u.org/fr/x", "http://org?x=/fr/",
        "a://b://net/x", "http://x.de/login", "http://x.de/mylogin", "http://x.de/loginpage", "http://x.de/wp-admin/", "http://casino.de/",
        "http://x.de/a.exe", "http://x.de/search?q=1", "http://x.de/search?a=1&q=2", "http://É.net/x", "http://x.de/CASINO", "http://a.net:80/"]


def _brute(url):
    at = url.find("://") if url else -1
    host = path = ""
    if at >= 0:
        rest = url[at + 3:]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.HOST_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits)[1:]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    hit = url is not None and any(re.search(urls.to_regex(p).replace(r"\z", r"\Z"), low) for p in urls.PATTERNS)
    return host, path, None, "block" if hit else "allow"


def test_equals_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS])] + [(None, "http://a.net/", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, token string, pattern string").repartition(4)
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == _brute(rows[r["page_id"]][1]), rows[r["page_id"]][1]
    assert urls.judge(df.limit(0)).count() == 0


def test_tokens_are_whole_words_of_every_match():
    assert urls.tokens("/wp-admin/*x^foo") == ["admin", "wp"] and urls.tokens("login*") == [] and urls.tokens("^a*b^") == []


def test_patterns_without_token_run_on_all(spark):
    df = spark.createDataFrame([(1, "http://a.de/abcxyz"), (2, "http://a.de/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, (), ["bcx"]).collect()} == {1: "block", 2: "allow"}


def test_index_takes_the_rarest_token(spark):
    df = spark.createDataFrame([(f"http://a.de/common/{i}",) for i in range(5)] + [("http://a.de/rare/1",)], "url string")
    assert urls.pattern_index(df, ["/common/rare/"]).first()["token"] == "rare"
