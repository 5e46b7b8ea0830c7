"""Operator 3, URL filters over redirect-equivalent urls.

Method: rules (action, host, path) judge urls: a rule fits its host and its subdomains if the
path starts with the rule's; the longest wins. Redirects (``meta refresh``) and canonical links
of the pages are edges between urls; their distributed connected components are classes
of aliases. A url that no rule fits takes the block of an alias, unless a rule allows an alias:
an explicit allow precedes a propagated block. Urls without either are allowed.

Urls are compared in a plain form: host and path without trailing ``/``, query without
``utm_`` parameters, no scheme, no fragment. Link targets are resolved against the page (``//host``,
``/path`` and names beside the page); targets of other schemes are no urls and are dropped.

Native throughout: DataFrame functions, no user code. Pages are read once (html isn't
shuffled); one row per url goes into joins; block decisions are aggregated before joins, so
a host or url with a third of all pages is no hot key for the rules, and the join on urls has plain
tables on both sides, which adaptive execution splits.

Cases: a null url or one without ``://`` has an empty host and path, no rule, and is allowed; null
html has no links; repeated pages are judged alike; links to oneself do nothing; an empty table
gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read, shared_table
from .components import connected_components

#: Fixed values of the query: action, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def plain(url: Column) -> Column:
    """The form in which urls are compared; null without a host."""
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    host, path = host_of(url), F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def judged(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits; null fields if none does. Of
    equally long rules an allow wins."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    rule = action = F.lit(None).cast("string")
    for act, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return F.struct(rule.alias("rule"), action.alias("action"))


def targets(url: Column, html: Column) -> Column:
    """Absolute urls of the canonical links and redirects of a page."""
    text = F.coalesce(html, F.lit(""))
    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(LINK_TAG), F.lit(0)), lambda x: F.regexp_extract(x, HREF, 1)),
        F.transform(F.regexp_extract_all(text, F.lit(META_TAG), F.lit(0)), lambda x: F.regexp_extract(x, REFRESH, 1)))
    beside = F.regexp_replace(path_of(url), r"[^/]*$", "")
    beside = F.when(beside == "", F.lit("/")).otherwise(beside)

    def resolved(x: Column) -> Column:
        return (F.when(x.rlike("^(?i)https?://"), x)
                .when(x.startswith("//"), F.concat(F.lit("http:"), x))
                .when(x.startswith("/"), F.concat(F.lit("http://"), host_of(url), x))
                .when((x == "") | x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | x.startswith("#"), F.lit(None))
                .when(x.startswith("?"), F.concat(F.lit("http://"), host_of(url), path_of(url), x))
                .otherwise(F.concat(F.lit("http://"), host_of(url), beside, x)))

    return F.filter(F.transform(found, resolved), lambda x: x.isNotNull())


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, url, html)`` -> ``page_id, host, path, rule, verdict``."""
    u = F.col("url")
    links = F.when(host_of(u) != "", F.transform(targets(u, F.col("html")), lambda x: F.struct(
        plain(x).alias("key"), judged(host_of(x), path_of(x), rules)["action"].alias("action"))))
    p = pages.select("page_id", host_of(u).alias("host"), path_of(u).alias("path"), plain(u).alias("key"),
                     links.alias("links"))
    p = p.select("*", judged(F.col("host"), F.col("path"), rules).alias("j"))
    p = shared_table(p.select("page_id", "host", "path", "key", "links", "j.rule", "j.action"), "url-pages")
    linked = p.select(F.col("key").alias("a"), F.explode("links").alias("l")).select(
        "a", F.col("l.key").alias("b"), F.col("l.action").alias("action")).where("a is not null and b is not null")
    aliases = cut(connected_components(linked.select("a", "b")))
    decided = (p.select("key", "action").unionByName(linked.select(F.col("b").alias("key"), "action"))
               .where("key is not null and action is not null")
               .groupBy("key").agg(F.max(F.col("action") == "block").alias("block"),
                                   F.max(F.col("action") == "allow").alias("allow")))
    root = F.coalesce("root", "key")
    blocked = cut(decided.join(aliases.withColumnRenamed("node", "key"), "key", "left")
                  .groupBy(root.alias("root")).agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
                  .where("block and not allow").select("root"))
    judged_by_rule = p.where("action is not null or key is null")
    open_ = p.where("action is null and key is not null").drop("links")
    open_ = open_.join(aliases.withColumnRenamed("node", "key"), "key", "left").withColumn("root", root)
    open_ = open_.join(blocked.withColumn("hit", F.lit(True)), "root", "left")
    verdict = F.when(F.col("hit"), "block").otherwise("allow")
    return (judged_by_rule.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
            .unionByName(open_.select("page_id", "host", "path", "rule", verdict.alias("verdict"))))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_parts(url: str) -> str:
    rest = f"(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END)"
    return (f"{_LOWER.format(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} AS host, "
            f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path, "
            f"array_to_string(list_filter(string_split(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '&'), "
            "lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS q")


_KEY = ("CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || "
        "CASE WHEN q <> '' THEN '?' || q ELSE '' END END")


def _sql_rule(column: str) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0]))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
        f"THEN '{h + p if column == 'rule' else act}'" for act, h, p in order) + " END"


_HREF, _REFRESH, _LINK, _META = (x.replace("'", "''").replace('\\"', '"') for x in (HREF, REFRESH, LINK_TAG, META_TAG))

OP3_SQL = f"""
WITH RECURSIVE p0 AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
       {_sql_parts("coalesce(url, '')")} FROM pages),
p AS (SELECT *, {_KEY} AS key, {_sql_rule('rule')} AS rule, {_sql_rule('action')} AS action,
        CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS beside FROM p0),
t0 AS (SELECT key AS a, host AS h, path AS pa, beside, unnest(list_concat(
          list_transform(regexp_extract_all(html, '{_LINK}'), lambda x: regexp_extract(x, '{_HREF}', 1)),
          list_transform(regexp_extract_all(html, '{_META}'), lambda x: regexp_extract(x, '{_REFRESH}', 1)))) AS x
       FROM p WHERE host <> ''),
t1 AS (SELECT a, CASE WHEN regexp_matches(x, '^(?i)https?://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x
          WHEN starts_with(x, '/') THEN 'http://' || h || x
          WHEN x = '' OR regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(x, '#') THEN NULL
          WHEN starts_with(x, '?') THEN 'http://' || h || pa || x
          ELSE 'http://' || h || beside || x END AS target FROM t0),
t2 AS (SELECT a, {_sql_parts("target")} FROM t1 WHERE target IS NOT NULL),
t AS (SELECT a, {_KEY} AS b, {_sql_rule('action')} AS action FROM t2),
e AS (SELECT a, b FROM t WHERE a <> b UNION SELECT b, a FROM t WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
d AS (SELECT coalesce(root, key) AS root, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS hit
      FROM (SELECT key, action FROM p UNION ALL SELECT b, action FROM t) x LEFT JOIN root ON node = key
      WHERE action IS NOT NULL AND key IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN root ON node = key LEFT JOIN d ON d.root = coalesce(root.root, key)
"""
