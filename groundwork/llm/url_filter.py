"""Allow and block lists for urls: a trie over reversed host labels, then path segments.

The trie is broadcast; its size is proven by `MAX_RULES` rules of at most `MAX_RULE_CHARS`
characters. A longer list is judged by joins (`judge_by_join`) with the same results.

A rule fits its host and all subdomains, if the url's path starts with the rule's path. Of
the rules that fit, the one with most host labels wins, then the longest path, then block.

Nulls, urls without `://` and hosts that no rule fits get no rule and the default verdict.
Empty rules lists are allowed. Equal urls are judged alike; further columns stay, but `host`,
`path`, `rule` and `verdict` of the input are replaced.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from groundwork.llm import shared

MAX_RULES = 100_000
MAX_RULE_CHARS = 2_000
#: Verdict where no rule fits.
DEFAULT = "allow"

#: (verdict, host, path) of the registered query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url):
    """Host and path of a url; both empty if it has no `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((at for at in map(rest.find, "/?#") if at >= 0), default=len(rest))
    path = rest[end:]
    stop = min((at for at in map(path.find, "?#") if at >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def build(rules):
    """Nested nodes [children, paths]; a path node is [children, ends], its ends by the last, unfinished segment."""
    root = [{}, None]
    for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):  # block is put in last and so wins a tie
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node[0].setdefault(label, [{}, None])
        node[1] = node[1] or [{}, {}]
        at = node[1]
        *segments, last = path.split("/")
        for segment in segments:
            at = at[0].setdefault(segment, [{}, {}])
        at[1][last] = (host + path, verdict)
    return root


def longest(trie, host, path):
    """(rule, verdict) of the longest match, or (None, None)."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node[0].get(label)
        if node is None:
            break
        best = _path_match(node[1], segments) or best
    return best or (None, None)


def _path_match(at, segments):
    best, depth = None, 0
    while at is not None:
        rest = segments[depth] if depth < len(segments) else None
        if rest is not None:
            # The last segment of a rule is only begun; the end that is the longest prefix wins.
            for size in sorted({len(end) for end in at[1]} if at[1] else (), reverse=True):
                if size <= len(rest) and rest[:size] in at[1]:
                    best = at[1][rest[:size]]
                    break
        at = at[0].get(rest) if rest is not None and depth < len(segments) - 1 else None
        depth += 1
    return best


def judge(pages, rules=RULES, default=DEFAULT):
    """Pages with host, path, rule and verdict."""
    rules = list(rules)
    if len(rules) > MAX_RULES or any(len(host) + len(path) > MAX_RULE_CHARS for _, host, path in rules):
        return judge_by_join(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def judged(urls: pa.Array) -> pa.Array:
        rows = []
        for url in urls.to_pylist():
            host, path = parts(url)
            rule, verdict = longest(trie.value, host, path)
            rows.append((host, path, rule, verdict or default))
        columns = list(zip(*rows)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "path", "rule", "verdict"])

    found = pages.withColumn("__judged", judged.asNondeterministic()(F.col("url").cast("string")))
    return shared.with_columns(found, {n: F.col(f"__judged.{n}") for n in ("host", "path", "rule", "verdict")}).drop("__judged")


def judge_by_join(pages, rules, default=DEFAULT):
    """The same with the rules as a table of any size: one join on each (host suffix, whole path segments) of a url."""
    rules = rules.select("verdict", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"),
                         F.col("path").alias("p"), F.concat("host", "path").alias("rule"))
    rules = rules.select("verdict", "rule", "h", "p", F.regexp_extract("p", "(?s)^(.*/)", 1).alias("whole"),
                         F.struct(F.size(F.split("h", r"\.")), F.length("p"), F.col("verdict") == "block").alias("rank"))
    rest = F.substring_index(F.col("url"), "://", 1)
    rest = F.when(F.col("url").contains("://"), F.expr("substr(url, length(substring_index(url, '://', 1)) + 4)"))
    urls = pages.select(F.col("url").cast("string").alias("url")).distinct().withColumn("rest", rest)
    host = F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    urls = urls.select("url", F.coalesce(host, F.lit("")).alias("host"),
                       F.coalesce(F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    labels = F.split("host", r"\.")
    heads = urls.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("h"))
    pieces = F.split("path", "/")
    heads = heads.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.when(k == 0, F.lit(""))
                         .otherwise(F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/"))))).alias("whole"))
    fits = heads.join(rules, ["h", "whole"]).filter(F.col("path").startswith(F.col("p")))
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("best"))
    known = urls.join(best, "url", "left").select(F.col("url").alias("__url"), "host", "path", "best")
    found = pages.join(known, F.col("url").eqNullSafe(F.col("__url")), "left")
    return shared.with_columns(found, {"host": known["host"], "path": known["path"], "rule": F.col("best.rule"),
                                       "verdict": F.coalesce(F.col("best.verdict"), F.lit(default))}).drop("best", "__url")


def op2_url_filter(spark, sf_dir):
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op2_url_filter": op2_url_filter}

ORACLES = {"op2_url_filter": r"""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""}
