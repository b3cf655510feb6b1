"""Host rules and the URL filter against plain loops."""

import re
from collections import Counter

from hearthline.llm import host_rules, queries, url_filter


def brute_measure(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeat = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat),
    )


def test_counts_match_loops(tables, rows, spark):
    found = queries.op5_host_rules(spark, tables())
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().toString())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect())
    want = Counter()
    for r in rows:
        m = brute_measure(r[1])
        want[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want
    assert all(not r.kept for r in found.where("base_failed").collect())


def test_hosts_shrink_and_join(docs, empty, spark):
    judged = host_rules.judge(docs)
    assert judged.count() == docs.count() and host_rules.judge(empty).count() == 0
    rows = [(f"h{k}", i < fails) for k, (n, fails) in enumerate([(200, 190), (300, 6), (250, 5), (1, 1), (400, 10)]) for i in range(n)]
    frame = spark.createDataFrame(rows, "host string, failed boolean")
    got = {r.host: r for r in host_rules.host_verdicts(frame).collect()}
    assert got["h0"].rejected and not got["h1"].rejected and not got["h4"].rejected
    assert 0.02 < got["h1"].rate < 0.1 and got["h3"].rate < 1  # a single page says little
    one = host_rules.host_verdicts(spark.createDataFrame([("a", False)], "host string, failed boolean")).first()
    assert not one.rejected


def brute_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


URLS = [
    "http://a.example.com/en/1", "https://WWW.Example.com/en/2?x#y", "http://com", "http://com/", "http://x.net/es/", "http://net/fr/1",
    "http://x.net/de/1", "ftp://x.org", "no scheme", None, "", "http://a.com?u=http://b.net/es/", "http://xcom/", "http://example.com/en",
    "://h.com/p", "http://h.com/a\nb/c", "http://u@h.net:80/es/x", "http://x.net//es/",
] + [f"http://mix.net/es/{i}.html" for i in range(30)] + [f"http://mix.net/en/{i}" for i in range(30)] + [
    f"http://deep.org/{i % 40}x{chr(97 + i % 26)}/a/b/c/d/e/f" for i in range(120)
]


def test_urls_match_loops(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.op10_url_filter(spark, str(tmp_path)).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path, best = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), URLS[r.page_id]
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")


def test_templates_generalise_and_reject(spark):
    urls = [f"http://a.net/es/p{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(100)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (("block", "a.net", "/es/pa"), ("block", "a.net", "/es/pb"), ("allow", "b.net", "/"))
    got = url_filter.judge_urls(pages, rules=rules).collect()
    assert {r.template for r in got} == {"/es/*"}  # a hundred children seen once each are one wildcard
    purity = {r.bad_share for r in got}
    assert len(purity) == 1 and {r.verdict for r in got if r.rule is None} == {"block" if purity.pop() >= 0.8 else "allow"}
    other = pages.unionAll(spark.createDataFrame([(1000 + i, f"http://b.net/x/{i}") for i in range(50)], "page_id long, url string"))
    assert {r.verdict for r in url_filter.judge_urls(other, rules=rules).collect() if r.host == "b.net"} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_unlabelled_templates_go_by_the_nearest_labels(spark):
    """A planted template without a rule is rejected where its branch or host is bad and kept where it is good."""
    rules = (("block", "bad.net", "/x/spam"), ("allow", "good.net", "/x/fine"), ("block", "mix.net", "/a/spam"), ("allow", "mix.net", "/b/fine"))
    urls = [f"http://{h}/{d}/{w}{'abcdefghij'[i % 10]}" for h, d, w in (
        ("bad.net", "x", "spam"), ("bad.net", "x", "new"), ("good.net", "x", "fine"), ("good.net", "x", "new"),
        ("mix.net", "a", "spam"), ("mix.net", "a", "new"), ("mix.net", "b", "fine"), ("mix.net", "b", "new"),
    ) for i in range(60)] + ["http://none.net/x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {(r.host, r.path): r for r in url_filter.judge_urls(pages, rules=rules).collect()}
    verdict = lambda host, path: got[host, path].verdict
    assert verdict("bad.net", "/x/newa") == verdict("mix.net", "/a/newa") == "block"
    assert verdict("good.net", "/x/newa") == verdict("mix.net", "/b/newa") == "allow"
    # by hand: corpus (120 + 1) / (240 + 2); host towards the corpus, first branch towards the host, the leaf has none
    corpus = 121 / 242
    host = (60 + 4 * corpus) / 64
    first = (60 + 4 * host) / 64
    assert abs(got["bad.net", "/x/newa"].bad_share - first) < 1e-12
    assert abs(got["none.net", "/x/y"].bad_share - corpus) < 1e-12
