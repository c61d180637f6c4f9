"""URL filters with redirect equivalence: block decisions reach the aliases of a blocked url.

Urls are nodes; redirects and canonical links (of the pages' own markup, and of a table of redirects if there is one) are
edges, and each connected component of them is a class of aliases. Rules decide first, on every node, a page of its own or
not. An url that no rule fits is blocked if its class holds a blocked url and none that is explicitly allowed; else it is
allowed. So an explicit allow goes before whatever its class says, and a class with both is allowed where no rule speaks.

Components run on the executors over ids; classes are decided by two flags, pre-aggregated, so a class of any size is no
one task's. Only hosts that a rule fits, and only urls that their class blocks, are joined back to the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import dropped, small, table, written
from floorwright.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Links and metas of a page; comments and scripts are passed over whole, closed or not.
_TAGS = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)|\z)|<(?:link|meta)\b[^>]*"
_CANONICAL = r"""(?is)\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical(?![^\s/]))"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
_CONTENT = r"""(?is)\bcontent\s*=\s*(?:"[^"]*?\burl\s*=\s*'?([^"']*)|'[^']*?\burl\s*=\s*"?([^'"]*)|[^\s"']*?\burl=([^\s"']+))"""


def _after(url: Column) -> Column:
    """What follows the first ://; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """The url's host, A-Z lower-cased: what follows the first :// up to /, ?, # or the end."""
    return F.translate(F.regexp_extract(_after(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The url's path: what follows the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url as a node: scheme and host lower-cased, no fragment; null without ://."""
    url = F.regexp_replace(url, F.lit(r"(?s)#.*"), F.lit(""))
    head = F.regexp_extract(url, r"(?s)\A.*?://[^/?]*", 0)
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?]*(.*+)", 1)
    return F.when(head != "", F.concat(F.translate(head, _UPPER, _LOWER), rest))


def _target(link: Column, base: Column) -> Column:
    """A link as an absolute url; null if it leads nowhere else. Dot segments stay as they are."""
    upto = lambda pattern: F.concat(F.regexp_extract(base, r"(?s)\A" + pattern, 0), link)
    site = r".*?://[^/?#]*"
    return (
        F.when((link == "") | F.startswith(link, F.lit("#")), None)
        .when(F.regexp_like(link, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.startswith(link, F.lit("//")), upto(".*?:(?=//)"))
        .when(F.startswith(link, F.lit("/")), upto(site))
        .when(F.startswith(link, F.lit("?")), upto(site + "[^?#]*"))
        .when(F.regexp_like(link, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(F.regexp_like(base, F.lit(r"(?s)\A.*?://[^/?#]*/")), upto(site + "/(?:[^?#]*/)?"))
        .otherwise(F.concat(F.regexp_extract(base, r"(?s)\A" + site, 0), F.lit("/"), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page and of its canonical link or of the url that it sends its readers on to."""
    own = pages.select("url", F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)).alias("tags")).where("url is not null")
    own = own.select("url", F.explode("tags").alias("tag")).where(~F.startswith("tag", F.lit("<!")))
    first = lambda pattern: F.concat(*[F.regexp_extract("tag", pattern, k) for k in (1, 2, 3)])
    is_link = F.regexp_like("tag", F.lit(r"(?i)\A<link\b")) & F.regexp_like("tag", F.lit(_CANONICAL))
    is_meta = F.regexp_like("tag", F.lit(r"(?i)\A<meta\b")) & F.regexp_like("tag", F.lit(_REFRESH))
    own = own.select("url", _once(link=F.when(is_link, first(_HREF)).when(is_meta, first(_CONTENT)))).where("link <> ''")
    own = own.select("url", _once(link=F.trim(F.replace("link", F.lit("&amp;"), F.lit("&")))))
    own = own.select("url", _once(target=_target(F.col("link"), F.col("url"))))
    return own.select(_once(a=node_of(F.col("url")), b=node_of(F.col("target"))))


def _once(**columns: Column) -> Column:
    """The columns, computed once: a filter above isn't pushed below them, with all of their code again."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path and other columns) with rule and decision added: those of the longest rule that fits, null without one.

    rules: host, path, verdict. Of rules of the same length the one with the longer host goes first, then allow. Each
    distinct host meets the rules once; a host's rules travel with it, the longest first.
    """
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict").distinct()
    labels = own.agg(F.max(F.size(F.split("suffix", "\\.")))).first()[0] or 0
    if not labels:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "decision": F.lit(None).cast("string")})
    tails = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    hosts = urls.select("host").distinct().select("host", F.explode(tails).alias("suffix"))
    met = hosts.join(small(own, own.count()), "suffix")
    rank = F.struct((-F.length("suffix") - F.length("start")).alias("less"), (-F.length("suffix")).alias("host_less"), "verdict", F.concat("suffix", "start").alias("rule"), "start")
    fits = written(met.groupBy("host").agg(F.sort_array(F.collect_list(rank)).alias("fits")), "hosts")
    out = urls.join(small(fits, fits.count()), "host", "left").withColumn("fit", F.get(F.filter("fits", lambda x: F.startswith(F.col("path"), x["start"])), 0))
    return out.withColumns({"rule": F.col("fit.rule"), "decision": F.col("fit.verdict")}).drop("fits", "fit")


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node): urls that no rule fits, in a class with a blocked url and no explicitly allowed one."""
    edges = written(edges.where("a is not null and b is not null and a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # the id is written with the url
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}"))
    links = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    classes = components(links).withColumnRenamed("node", "id")
    known = judged(nodes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    known = written(known.select("id", "node", "decision").join(classes, "id"), "known")
    dropped(edges)
    dropped(nodes)
    flags = known.where("decision is not null").groupBy("component").agg(F.max(F.col("decision") == "allow").alias("allow"), F.max(F.col("decision") == "block").alias("block"))
    bad = written(flags.where("block and not allow").select("component"), "classes")
    return known.where("decision is null").join(small(bad, bad.count()), "component", "left_semi").select("node")


def verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for each row of pages (page_id, url, html; other columns are ignored).

    redirects: urls (source, target), such as a crawl's log of redirects; nulls are passed over. Null urls and urls
    without :// have no host, no path, no rule and no aliases: they are allowed, as is all that no rule and no class
    blocks. Null and empty html has no links. Rows that repeat an url each come back with the same verdict.
    """
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    bad = written(blocked_aliases(edges, rules), "aliases")
    out = judged(own, rules).join(small(bad.withColumn("alias", F.lit(True)), bad.count()), "node", "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("decision", F.when(F.col("alias"), "block"), F.lit("allow")).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return verdicts(table(spark, sf_dir, "pages"), rules).drop("url")
