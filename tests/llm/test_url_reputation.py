import random

import pytest

from tessera.llm import later_queries, url_reputation as U

ROWS = [
    (1, "http://WWW.Example.com/en/a?x#y"), (2, "https://a.example.com/en/"), (3, "http://example.com"), (4, "no scheme"), (5, None), (6, "x://h/http://b.net/es/"), (7, "http://xnet/es/1"),
    (8, "http://a.net/es"), (9, "http://net/fr/"), (10, "http://ÄB.COM/p q\n/r"), (10, "http://ÄB.COM/p q\n/r"), (None, "http://u@www.example.com:80/en/"), (12, "://"), (13, "http://10.0.0.1:8/x"),
    (14, "http://a.b.co.uk/x"), (15, "http://www.example.com/EN/"),
]


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
    stop = min((i for i, c in enumerate(rest) if i >= end and c in "?#"), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]


def plain_rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in later_queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_reputation(pages, outcomes):
    """host -> (mean, spread) by the formulas in turn."""
    known = {}
    for i, bad in outcomes:
        if i is not None and bad is not None:
            known[i] = max(known.get(i, 0), bad)
    hosts = {}
    for i, url in pages:
        k = hosts.setdefault(plain_host_path(url)[0], [0, 0])
        if i in known:
            k[0] += known[i]
            k[1] += 1
    def name(host):
        bare = host.split("@")[-1].rsplit(":", 1)[0] if ":" in host else host.split("@")[-1]
        if bare.replace(".", "").isdigit() and bare.count(".") == 3:
            return bare, ""
        suffix = next((s for s in U.SUFFIXES if bare == s or bare.endswith("." + s)), bare.split(".")[-1])
        head = bare[: -len(suffix) - 1] if len(bare) > len(suffix) + 1 else ""
        return (head.split(".")[-1] + "." + suffix if head else suffix), suffix
    n = sum(v[1] for v in hosts.values())
    share = sum(v[0] for v in hosts.values()) / n if n else 0.0
    def level(units):
        pairs = sum(m * p * (1 - p) * (m - 1) for k, m, p in units.values())
        excess = sum((k - m * p) ** 2 - m * p * (1 - p) for k, m, p in units.values())
        held = U.UNKNOWN if pairs <= 0 else U.STRONGEST if excess / pairs <= 1 / (U.STRONGEST + 1) else max(U.WEAKEST, pairs / excess - 1)
        return {u: ((held * p + k) / (held + m), held + m) for u, (k, m, p) in units.items()}
    def grouped(of):
        out = {}
        for h, (k, m) in hosts.items():
            g = out.setdefault(of(h), [0, 0])
            g[0] += k
            g[1] += m
        return out
    tops = level({s: (k, m, share) for s, (k, m) in grouped(lambda h: name(h)[1]).items()})
    doms = level({d: (k, m, tops[s][0]) for (d, s), (k, m) in grouped(name).items()})
    doms = {d[0] if isinstance(d, tuple) else d: v for d, v in doms.items()}
    return level({h: (k, m, doms[name(h)[0]][0]) for h, (k, m) in hosts.items()})


def frames(spark, pages, outcomes):
    return spark.createDataFrame([(i, u, "z", "w") for i, u in pages], "page_id long, url string, host string, n string"), spark.createDataFrame(outcomes, "page_id long, bad int")


def test_odd_urls_and_rules(spark):
    got = U.judged_urls(*frames(spark, ROWS, []), later_queries.RULES, 0.2, 1.645).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, u in ROWS:
        rule, says = plain_rule(*plain_host_path(u))
        want.append((i, *plain_host_path(u), rule, says or "allow"))  # without outcomes nothing else goes
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(want, key=key)
    assert U.judged_urls(*frames(spark, [], [(1, 1)]), later_queries.RULES, 0.2, 1.645).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_posteriors_match_the_formulas(spark, seed):
    rng = random.Random(seed)
    hosts = ["spam.bad.com", "good.fine.com", "a.fine.com", "one.co.uk", "two.one.co.uk", "10.0.0.1", "u@h.org:80", "", "com"] + [f"h{i}.bad.com" for i in range(12)]
    pages = [(i, f"http://{rng.choice(hosts[:1] * 25 + hosts[1:2] * 25 + hosts)}/p") for i in range(700)] + [(None, "http://com/"), (3, None)]
    outcomes = [(i, int(rng.random() < (0.9 if "bad" in u else 0.1))) for i, u in pages[:500] if rng.random() < 0.6 and i is not None] + [(3, None), (None, 1), (5, 1), (5, 0)]
    rows, marks = frames(spark, pages, outcomes)
    rows = rows.select("page_id", U.host_of(rows.url).alias("host"))
    got = {r.host: r for r in U.reputations(rows, marks).collect()}
    want = plain_reputation(pages, outcomes)
    assert got.keys() == want.keys()
    for h, (mean, weight) in want.items():
        assert got[h]["mean"] == pytest.approx(mean) and got[h].spread == pytest.approx((mean * (1 - mean) / (weight + 1)) ** 0.5), h
    assert sum(r.rows for r in got.values()) == len(pages)
    verdicts = {(r.host, r.verdict) for r in U.judged_urls(spark.createDataFrame(pages, "page_id long, url string"), marks, [], 0.5, 1.645).collect()}
    assert ("spam.bad.com", "block") in verdicts and ("good.fine.com", "allow") in verdicts
