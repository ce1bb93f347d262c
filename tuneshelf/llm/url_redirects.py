"""URL filter with redirect equivalence.

A rule (host and path) judges the urls it fits; the longest wins.  Urls that lead to one
another are aliases: redirects and canonical links are edges between url keys, and the
connected components of these edges, found with distributed contraction, pass a block
decision on to every alias that no rule judges itself.  Allow has precedence: an explicit
allow rule keeps its own url, and a component with an allowed member is not blocked.

A url's key drops what redirects commonly drop: the scheme, the fragment, tracking
parameters, a closing slash and an index file.

Defined cases: a null url or one without ``://`` has empty host and path, no key, and no
rule; a null page gives no edges; a relative target counts from the page's base element or
its url, and one that is no web address or a mere fragment gives no edge; urls and pages of any
length are read whole; rows that repeat are judged alike; no rules: all allowed;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import LOWER, UPPER, components

#: The filter's rules as given: (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: Query parameters that only say where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column, tracking=TRACKING) -> Column:
    """The node of a url in the alias graph; null for a null url or one without a scheme."""
    path = F.regexp_replace(path_of(url), r"/(index\.(html?|php))?$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*tracking))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host_of(url), path, query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that wins for a url as a struct (verdict, rule), null if none fits.  Rules
    are tried from the longest (allow first among equals), so the first that fits wins."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>]+)"""


_BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def resolve(target: Column, base: Column) -> Column:
    """The absolute url of a target as a page at ``base`` names it; null for another kind of
    address (``mailto:``) and for a mere fragment."""
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(base, "://([^/?#]*)", 1))
    path = F.regexp_extract(base, "://[^/?#]*([^?#]*)", 1)
    own, rest = F.regexp_extract(target, "^([^?#]*)", 1), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    # the last step, if it is none of its own, leaves a closing slash
    steps = F.split(F.regexp_replace(whole, r"(^|/)(\.\.?)$", "$1$2/"), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))))
    walked = F.concat(site, F.array_join(kept, "/"), rest)
    other = target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~target.contains("://")
    return (F.when(other | (target == "") | target.startswith("#"), F.lit(None).cast("string"))
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("?"), F.concat(site, path, target)).otherwise(walked))


def page_targets(url: Column, html: Column) -> Column:
    """Absolute urls that a page names as its canonical self or sends its visitors to."""
    raw = F.concat(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    named = F.regexp_extract(html, _BASE, 1)
    base = F.when(named == "", url).otherwise(F.coalesce(resolve(named, url), url))
    found = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda t: resolve(F.replace(t, F.lit("&amp;"), F.lit("&")), base))
    return F.filter(found, lambda t: t.isNotNull())


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, alias (the class of the url's key).

    ``redirects`` (columns ``from_url``, ``to_url``) adds edges, for example from a crawl log.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        url_key(url).alias("node"), page_targets(url, F.col(html_col)).alias("targets"))
    base = cut_lineage(base.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)), "url-base")
    links = base.where(F.size("targets") > 0).select(F.col("node").alias("a"), F.explode("targets").alias("to_url"))
    edges = links.select("a", url_key(F.col("to_url")).alias("b"))
    named_urls = links.select(F.col("to_url").alias("u"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b")))
        named_urls = named_urls.unionByName(redirects.select(F.explode(F.array("from_url", "to_url")).alias("u")))
    labels = components(edges)

    # decisions of the members: pages by their own rule, and targets that are no page here
    def decided(node: Column, own: Column) -> list[Column]:
        return [node.alias("node"), (own["verdict"] == "block").alias("blocked"), (own["verdict"] == "allow").alias("allowed")]

    members = base.where("node is not null and own is not null").select(*decided(F.col("node"), F.col("own")))
    # a target is judged by its url: its key has lost what a rule may ask for
    keys = named_urls.where("u is not null").distinct().select(
        url_key(F.col("u")).alias("k"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules).alias("own")).where("k is not null")
    members = members.unionByName(keys.where("own is not null").select(*decided(F.col("k"), F.col("own"))))
    members = members.groupBy("node").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    classes = (members.join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("alias"))
               .agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed")))
    classes = cut_lineage(classes, "url-classes")

    named = base.join(labels, "node", "left").withColumn("alias", F.coalesce("component", "node"))
    named = named.join(classes, "alias", "left")
    passed_on = F.when(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    return named.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                        F.coalesce(F.col("own.verdict"), passed_on).alias("verdict"), "alias")


def _rule_sql(host: str, path: str, field: int) -> str:
    whens = []
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        h, _, p = rule[1].partition("/")
        whens.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '/{p}') THEN '{rule[field]}'")
    return "CASE " + " ".join(whens) + " END"


def _key_sql(url: str) -> str:
    tracking = ", ".join(f"'{t}'" for t in TRACKING)
    kept = (f"list_sort(list_filter(string_split(regexp_extract({url}, '://[^?#]*\\?([^#]*)', 1), '&'), "
            f"lambda p: p <> '' AND NOT list_contains([{tracking}], split_part(p, '=', 1))))")
    host = f"translate(regexp_extract({url}, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = f"regexp_replace(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '/(index\\.(html?|php))?$', '')"
    return f"CASE WHEN contains({url}, '://') THEN {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, {_key_sql('url')} AS node,
         regexp_extract(html, '<link rel="canonical" href="([^"]+)"', 1) AS target FROM pages),
r AS (SELECT *, {_rule_sql('host', 'path', 1)} AS rule, {_rule_sql('host', 'path', 0)} AS own FROM p),
e AS (SELECT node AS a, {_key_sql('target')} AS b FROM r WHERE contains(target, '://')),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, m) AS (SELECT a, a FROM sym UNION SELECT reach.n, sym.b FROM reach JOIN sym ON reach.m = sym.a),
cls AS (SELECT n, min(m) AS alias FROM reach GROUP BY n),
named AS (SELECT r.*, coalesce(cls.alias, r.node) AS alias FROM r LEFT JOIN cls ON r.node = cls.n),
dec AS (SELECT alias, bool_or(own = 'block') AS blocked, bool_or(own = 'allow') AS allowed FROM named WHERE alias IS NOT NULL GROUP BY alias)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict, named.alias
FROM named LEFT JOIN dec ON named.alias = dec.alias
"""
