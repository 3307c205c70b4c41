"""URL rules and language models against plain Python."""

import math
from collections import Counter

import numpy as np

from praxilog.llm import urlfilter
from praxilog.llm.queries import RULES


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    path = path[:stop]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)).name if fits else None


def test_rules(spark):
    urls = ["http://A.Example.COM/en/71?x", "http://example.com/en/8", "https://x.com/en/", "http://com/en/1", "http://notcom/en/", "ftp://b.net/de/9#a", "http://example.net/de/81", "http://q.org/es", "http://q.org/es/1", "http://q.org?/es/", None, "", "no scheme", "a://", "x://ÀB.net/de/é", "http://u.fr/://net/de/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.filter_urls(rows, RULES).collect()}
    assert len(got) == len(urls) * 2
    for i, u in enumerate(urls * 2):
        host, path, rule = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule:
            assert got[i].verdict == ("allow" if next(r for r in RULES if r.name == rule).allow else "block")
    assert urlfilter.filter_urls(rows.limit(0), RULES).count() == 0
    alone = urlfilter.filter_urls(spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string"), RULES).collect()
    assert {r.verdict for r in alone} == {"allow"}


def test_smoothing_and_scores():
    table = urlfilter._table()
    urls = ["http://a.b/1", "http://a.c/22", "HTTP://ab.c/"]
    codes, lengths = urlfilter.grams(urls, table)
    counts = np.bincount(codes, minlength=urlfilter.SIZE**4).astype(float)
    log = urlfilter.log_model(counts)
    seen = Counter()
    for u in urls:
        s = [0, 0, 0] + [int(table[ord(c)]) for c in u]
        for k in range(3, len(s)):
            for d in range(4):
                seen[tuple(s[k - d : k + 1])] += 1

    def p(gram):
        ctx = gram[:-1]
        after = [seen[(*ctx, c)] for c in range(urlfilter.SIZE)]
        shorter = p(gram[1:]) if ctx else 1 / urlfilter.SIZE
        kinds, total = sum(x > 0 for x in after), sum(after)
        return (after[gram[-1]] + kinds * shorter) / (total + kinds) if total else shorter

    rng = np.random.default_rng(0)
    for code in [*codes[:10].tolist(), *rng.integers(0, urlfilter.SIZE**4, 20).tolist()]:
        gram = tuple(code // urlfilter.SIZE**k % urlfilter.SIZE for k in (3, 2, 1, 0))
        assert math.isclose(log[code], math.log(p(gram)), rel_tol=1e-4)
    assert lengths.tolist() == [len(u) for u in urls]


def test_models_tell_hosts_apart(spark):
    rows = [(i, f"http://{'zzz' if i % 2 else 'good'}{i}.com/{'en' if i % 2 else 'x'}/{i}") for i in range(200)]
    rules = (urlfilter.Rule("com", "/en/", False), urlfilter.Rule("com", "/x/", True))
    ask = [(1000, "http://zzz7.com/en2/5"), (1001, "http://good8.com/x2/5")]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(rows + ask, "page_id long, url string"), rules).collect()}
    assert got[1000] == "block" and got[1001] == "allow"
