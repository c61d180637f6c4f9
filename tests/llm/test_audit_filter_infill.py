"""Source audit, url filter and fill-in-middle against plain versions and SQL, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from floorwright.llm import divergence, infilling, url_filter

ODD = [None, "", " ", "x", "<P> held", "a<S>b", "e\u0301 \U0001f600 ß中文", "line\r\nnext\u2028end", "<", "<<S<M", "$1 \\1 ${a}", "é" * 3000, "word " * 9000, "\x00\x01"]


def cut(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_infilling_equals_a_plain_version(spark):
    texts = ODD + [t for t in ODD if t] * 6 + ["ab\n" * k for k in range(1, 300, 7)]
    rows = [(None if k % 29 == 28 else k, t, 7, "x") for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, whole string")
    got = infilling.fill_in_middle(df).withColumn("again", infilling.restored(F.col("output"), F.col("form"))).collect()
    want = {(d, t): cut(d, t) for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want[r.doc_id, r.text]
        assert r.again == (r.text or "") and r.whole == "x"
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(df.limit(0)).count() == 0


def test_infilling_of_a_very_long_text(spark):
    text = "äb\U0001f600\n" * 500_000
    df = spark.range(12).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    out = infilling.fill_in_middle(df)
    got = out.select("doc_id", "n", "form", "prefix_chars", F.sha2(F.col("output").cast("binary"), 256).alias("o"), F.sha2(infilling.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("r")).collect()
    for r in got:
        n, form, a, _, o = cut(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.o, r.r) == (n, form, a, hashlib.sha256(o.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_infilling_stays_in_the_jvm(spark):
    plan = infilling.fill_in_middle(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def plain_audit(rows, config):
    found = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    texts, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        texts[lang].update(set(found(t)))
        counts[lang, source].update(found(t))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in texts[lang].items() if n >= config.least_texts]
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update({w: counts[lang, s][w] for w in kept})

        def share(c):
            total = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // total for w in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            tops = [(w, p[s][w] - q[w]) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, own in (("pair", pair), ("term", tops)):
                own.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k) for k, (w, v) in enumerate(own, 1) if part == "pair" or k <= config.top]
    return sorted(out)


def audit_rows(seed=0):
    r = random.Random(seed)
    vocab = ["The", "über", "naïve", "中文", "x", "ﬁne", "Ärger", "Z", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90))]
    rows = [(" ".join(r.choice(vocab[: r.choice([8, 30, 98])]) + r.choice(["", ",", "1", "_y"]) for _ in range(r.randrange(60))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", "Ünter", None])) for _ in range(420)]
    rows += [(None, "en", "empty"), ("", "zz", "only"), ("12 ! 3", "yy", "p"), ("12", "yy", "q"), ("\x00a\x7fb" * 9, "en", "a"), ("long" * 200_000 + " the", "en", "b")]
    return rows + rows[:150] + [("same words here", "en", "hot")] * 700


def audited(spark, rows, config):
    df = spark.createDataFrame([(*x, 1, "h") for x in rows], "text string, lang string, source string, n int, h string").repartition(5)
    return sorted(tuple(r) for r in divergence.audit(df, config).collect())


@pytest.mark.parametrize("change", [{}, {"bits": 4}, {"bits": 7, "top": 3}, {"sources": 2, "terms": 10}, {"least_texts": 1, "top": 200}, {"least_texts": 100_000}])
def test_audit_equals_a_plain_version(spark, change):
    """With few bits nearly all digests collide; with small tiles pairs of sources come from several of them."""
    config = replace(divergence.DivergenceConfig(), **change)
    rows = audit_rows()
    assert audited(spark, rows, config) == plain_audit(rows, config)


def test_audit_of_nothing(spark):
    assert audited(spark, [(None, None, None)], divergence.DivergenceConfig()) == []
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0


def test_audit_equals_its_sql(spark):
    rows = audit_rows(3)
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    found = con.execute(divergence.ORACLE)
    names = [c[0] for c in found.description]
    assert names == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(found.fetchall()) == audited(spark, rows, divergence.DivergenceConfig())


RULES = [*url_filter.RULES]


def page(head="", body=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def canonical(url):
    return f'<link href="{url}" rel="canonical">'


def plain_verdicts(pages, rules, redirects):
    """pages: (page_id, url, links); links are absolute."""

    def split(url):
        if not url or "://" not in url:
            return "", ""
        after = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", after)[0]
        return host.translate({k: k + 32 for k in range(65, 91)}), re.match(r"[^?#]*", after[len(host) :])[0]

    def rule(url):
        host, path = split(url)
        fits = [(-len(h + p), -len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return min(fits)[2:] if fits else (None, None)

    def node(url):
        if not url or "://" not in url:
            return None
        url = url.split("#")[0]
        scheme, after = url.split("://", 1)
        host = re.match(r"[^/?]*", after)[0]
        rest = after[len(host) :]
        return f"{scheme.lower()}://{host.lower()}{rest}"

    near = defaultdict(set)
    for a, b in [(u, x) for _, u, links in pages for x in links] + redirects:
        a, b = node(a), node(b)
        if a and b:
            near[a].add(b)
            near[b].add(a)

    def verdict(url):
        text, own = rule(url)[1], rule(url)[0]
        if own:
            return text, own
        seen, todo = set(), [node(url)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        said = {rule(x)[0] for x in seen if x}
        return None, "block" if "block" in said and "allow" not in said else "allow"

    return [(i, *split(u), *verdict(u)) for i, u, _ in pages]


def test_url_filter_equals_a_plain_version(spark):
    r = random.Random(5)
    hosts = ["a.example.net", "example.net", "b.org", "c.example.com", "EXAMPLE.com", "t.co", "u.io", "v.io:80", "xexample.net", "net"]
    paths = ["", "/", "/en/", "/en/x", "/de/", "/de/y?q=1", "/fr/", "/fr/z#t", "?q", "/p"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}{k if k % 3 else ''}" for k in range(90)] + [None, "", "no scheme", "mailto:x@y", "http://", "x://y://z/"]
    pages, rows = [], []
    for k, u in enumerate(urls * 2):
        links = [r.choice(urls[:90])] if r.random() < 0.35 else []
        kind = r.randrange(4)
        head = "".join(canonical(x) if kind < 2 else f"<META content='3; URL={x}' http-equiv=Refresh>" if kind == 2 else f"<link rel='x canonical' href={x}>" for x in links)
        pages.append((k, u, links if u else []))
        rows.append((k, u, page(head + '<!-- <link rel="canonical" href="http://bad.net/"> --><script>"<link rel=canonical href=http://bad.net/>"</script><link rel="alternate" href="http://bad.net/">')))
    redirects = [(r.choice(urls), r.choice(urls)) for _ in range(12)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "page_id long, url string, html string, node string, id int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    again = spark.createDataFrame(redirects, "source string, target string")
    got = url_filter.verdicts(df, rules, again).drop("url").collect()
    want = plain_verdicts(pages, RULES, redirects)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {(x[3] is None, x[4]) for x in want} == {(a, b) for a in (True, False) for b in ("allow", "block")}


def test_url_filter_follows_relative_links_and_chains(spark):
    url = "https://Site.io/dir/page?x=1#top"
    for link, want in [("/other", "https://site.io/other"), ("other", "https://site.io/dir/other"), ("?y=2", "https://site.io/dir/page?y=2"), ("//else.io/a", "https://else.io/a"), ("HTTP://Else.IO?a&amp;b", "http://else.io?a&b"), ("#x", None), ("mailto:a", None)]:
        got = url_filter.link_edges(spark.createDataFrame([(url, page(canonical(link)))], "url string, html string")).collect()
        assert [(x.a, x.b) for x in got] == [("https://site.io/dir/page?x=1", want)]
    chain = [(k, f"http://s{k}.io/", page(canonical(f"http://s{k + 1}.io/") if k < 40 else "")) for k in range(41)]
    hub = [(100 + k, f"http://h{k}.io/", page(canonical("http://far.net/"))) for k in range(400)]  # one very common target, no page itself
    df = spark.createDataFrame([*chain, *hub, (99, "http://bad.net/", page(canonical("http://s7.io/"))), (98, None, None), (97, "http://w.io", "<link rel=canonical href=http://w.io/><!-- <link rel=canonical href=http://bad.net/>")], "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.verdicts(df, rules).collect()}
    assert all(got[k] == (None, "block") for k in [*range(41), *range(100, 500)])
    assert got[99] == ("net/", "block") and got[98] == (None, "allow") and got[97] == (None, "allow")
    assert url_filter.verdicts(df.limit(0), rules).count() == 0
    assert {x.verdict for x in url_filter.verdicts(df, rules.limit(0)).collect()} == {"allow"}
