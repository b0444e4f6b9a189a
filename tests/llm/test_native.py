"""Licences, mixing and URL filters against small brute-force versions."""

import itertools
import re
import textwrap

import pytest

from quarry.llm import licenses, mixing, urlfilter


def grams(text):
    w = re.sub("[^A-Za-z0-9]+", " ", text).lower().split()
    return set(zip(w, w[1:]))


def test_licenses(spark):
    mit = licenses._MIT_GRANT
    wrapped = lambda t, mark="": "\n".join(mark + line for line in textwrap.wrap(t, 60))
    full = wrapped(licenses._MIT_GRANT) + "\n\n" + wrapped(licenses._MIT_REST)
    inside = "some code here\n#\n" + wrapped(licenses._BSD_THIRD, "# ") + "\n# \n\nmore code there\n" * 30
    texts = ["MIT License\n\nCopyright (c) 2020 Someone\n\n" + full, inside, "x = 1\n\n" + wrapped(licenses._APACHE_REST, "// ") + "\n\n" + "y = 2\n" * 400, "word " * 200_000 + "\nReleased under the MIT License.", None, "", "Released under the MIT License.", "prose\nreleased under the  mit license\nmore prose " * 3, mit, mit + " And then much more prose follows. " * 40, "Licensed under CC BY-NC 4.0!", "All rights reserved", "nothing here"]
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts)] + [(6, texts[6], "clash", 3), (None, texts[6], "", 1)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string, unit int")).collect()}
    assert len(got) == len(texts) + 1
    for doc_id, text, *_ in rows:
        best = []
        for part in [text, *text.split("\n"), *[b for b in re.split(r"\n[^A-Za-z0-9]*\n", text) if "\n" in b]] if text is not None else []:
            a = grams(part)
            best += [(-2 * len(a & grams(t)) / (len(a) + len(grams(t))), name) for name, t in licenses.NOTICES if a and 2 * len(a & grams(t)) >= 0.8 * (len(a) + len(grams(t)))]
        want = min(best, default=(None, None))
        r = got[doc_id]
        assert r.license == want[1] and (r.dice is None if not best else abs(r.dice + want[0]) < 1e-12), doc_id
    assert [got[i].license for i in range(4)] == ["MIT", "BSD-3-Clause", "Apache-2.0", "MIT"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keywords_stand_in_every_match():
    words = licenses.keywords(licenses.NOTICES, 0.8)
    for _, text in licenses.NOTICES:
        pairs = grams(text)
        assert sum(not set(p) & set(words) for p in pairs) < 0.8 / 1.2 * len(pairs)


def deal(tree, budget, cap):
    """Brute force: share out by weight, fix full children, repeat."""
    open_, out = dict(tree), {}
    budget = min(budget, sum(cap.values()))
    while open_:
        total = sum(open_.values())
        full = [c for c in open_ if cap[c] * total <= budget * open_[c]]
        if not full:
            break
        for c in full:
            out[c] = cap[c]
        budget -= sum(cap[c] for c in full)
        for c in full:
            del open_[c]
    total, rest = sum(open_.values()), budget
    for c in sorted(open_):
        out[c] = budget * open_[c] // total
        rest -= out[c]
    for c in sorted(open_):
        if rest > 0:
            out[c] += 1
            rest -= 1
    return out


def test_budgets_and_prefixes(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), ("a", "b")[i % 2], f"s{i % 5}", ("x", "y", "z")[i % 3]) for i in range(200)] + [(None, "w w", "a", None, None), (900, None, "b", "s1", "x"), (901, "", "a", "s0", "z")]
    rows += [rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    weights = {"domain": {"x": 9, "y": 1}, "lang": {"a": 3}}
    total = sum(len((r[1] or "").split()) for r in rows)
    for share in (0.3, 1.0, 1.7):
        budget = int(total * share)
        got = mixing.mix(df, mixing.F.floor(mixing.F.col("available") * share), weights=weights).collect()
        leaf = {}
        for d, t, lang, source, domain in rows:
            key = (domain or "", lang or "", source or "")
            leaf[key] = leaf.get(key, 0) + len((t or "").split())
        cap = lambda p: sum(2 * n for k, n in leaf.items() if k[: len(p)] == p)
        given = {(): budget}
        for depth, level in enumerate(("domain", "lang", "source")):
            for p in [p for p in given if len(p) == depth]:
                kids = sorted({k[: depth + 1] for k in leaf if k[:depth] == p})
                given.update(deal({c: weights.get(level, {}).get(c[-1], 1) for c in kids}, given[p], {c: cap(c) for c in kids}))
        for key in leaf:
            assert sum(r.taken for r in got if (r.domain, r.lang, r.source) == key) == given[key], key
        assert sum(r.taken for r in got) == min(budget, 2 * total)
        assert all(r.taken <= r.tokens and r.epoch <= 2 for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.com/de/1", "http://x.org/fr/", "http://net/", "http://a.net", "http://b.net?x=/y", "ftp://spam-farm.org/a#b", "http://ok.info/p", "http://ok.info/p", "://h.info/q", "http://internet/a", "http://www.example.com/de"]


def judged(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
        path = re.match(r"[^?#]*", tail).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host and (host in listed or host + path in listed) else "allow"


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_url_verdicts(spark, max_bytes):
    urls = URLS + [f"http://h{i % 40}.info/{i}" for i in range(400)]
    listed = {"spam-farm.org", "h3.info", "h7.info/47", "not.in.corpus"} | {f"h{i % 40}.info/{i}" for i in range(0, 400, 9)}
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    keys = spark.createDataFrame([(k,) for k in sorted(listed)] + [(None,)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, keys, max_bytes=max_bytes).collect()}
    assert got == {i: judged(u, listed) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.limit(0), keys).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, keys.limit(0)).where("rule is null").collect()} == {"allow"}


def test_of_rules_equally_long_the_first_wins(spark):
    url = spark.createDataFrame([("a.b/cd",)], "u string").select(urlfilter.F.lit("a.b").alias("h"), urlfilter.F.lit("/cde").alias("p"))
    rules = [("block", "a.b", "/c"), ("allow", "b", "/cde")]
    for order in (rules, rules[::-1]):
        rule, verdict = urlfilter.matched_rule(urlfilter.F.col("h"), urlfilter.F.col("p"), order)
        assert tuple(url.select(rule, verdict).first()) == (order[0][1] + order[0][2], order[0][0]), order


def test_large_levels_in_shards(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SHARD_WORDS", 16)
    monkeypatch.setattr(urlfilter, "BROADCAST_SHARDS", 0)
    keys = spark.range(4000).selectExpr("cast(id as string) as key")
    levels = urlfilter.cascade(keys, keys.where("cast(key as int) % 3 = 0"), max_bytes=64)
    assert levels[0].shards > 2 and levels[0].words is None and any(x.words is not None for x in levels)
    got = {r.key for r in urlfilter.with_listed(keys, urlfilter.F.col("key"), levels, "listed").where("listed").collect()}
    assert got == {str(i) for i in range(0, 4000, 3)}


def test_cascade_levels_alternate(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) as key")
    levels = urlfilter.cascade(keys, keys.where("cast(key as int) % 7 = 0"))
    assert len(levels) > 1 and [x.number for x in levels] == list(range(1, len(levels) + 1))
    got = {r.key for r in urlfilter.with_listed(keys, urlfilter.F.col("key"), levels, "listed").where("listed").collect()}
    assert got == set(map(str, itertools.islice(range(0, 3000, 7), 3000)))
