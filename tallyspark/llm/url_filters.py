"""URL filters: host and path rules plus patterns, fetched by their rarest literal token.

Every rule is indexed under one literal token of its own: the one that is rarest among the
tokens of the URLs at hand. A URL looks its tokens up in that index and only the rules found
so are run as regular expressions. A short list of rules (`MAX_INLINE`) travels inside the plan,
so URLs are never shuffled; a longer one, or a table of rules, is joined by token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

#: More rules than this are joined as a table instead of travelling with every task.
MAX_INLINE = 1_000
TOKEN = "[^a-z0-9]+"
#: Where a rule names no path: the host ends.
NO_PATH = r"(?:/|\z)"


def _words(text: str) -> list[str]:
    return [w for w in re.split(TOKEN, text.lower()) if w]


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        # A host holds no slash and a path begins with one, so the first slash parts them.
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path) or NO_PATH}"

    @property
    def literals(self) -> tuple[str, ...]:
        """Tokens that any fitting URL has. A path like /de/ has its own only as whole tokens when it ends at a token's end; otherwise only the host counts."""
        whole = re.search(r"[^A-Za-z0-9]$", self.path)
        return tuple(_words(self.host) + (_words(self.path) if whole else []))


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over host and path, one after the other; `literals` are the tokens that any fitting URL has."""

    verdict: str
    regex: str
    literals: tuple[str, ...]


def host_word(word: str, verdict: str = "block") -> PatternRule:
    """Hosts of which `word` is a part between dots and hyphens."""
    return PatternRule(verdict, rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|\z)", (word,))


def path_segment(name: str, verdict: str = "block") -> PatternRule:
    """Paths with a segment `name`, whatever its ending."""
    return PatternRule(verdict, rf"(?s)^[^/]*/(?:.*/)?{re.escape(name)}(?:[/.].*)?\z", tuple(_words(name)))


def file_ending(ending: str, verdict: str = "block") -> PatternRule:
    return PatternRule(verdict, rf"(?s)^[^/]*/.*\.{ending}\z", (ending,))


#: The patterns of the method, asked only where no host rule fits. Words of hosts that sell or lure, segments of paths that hold no text, endings of files that are none.
HOST_WORDS = (
    "ads adserver adservice adclick banner popunder doubleclick track tracker clicktrack "
    "bet bets betting bingo casino casinos jackpot lottery poker roulette slots "
    "pill pills viagra cialis tramadol xanax "
    "porn porno xxx sex escort escorts camgirls "
    "spam spammer phishing malware warez cracks keygen torrent torrents"
).split()
PATH_SEGMENTS = "cart checkout login logout signin signup register wp-admin wp-login xmlrpc cgi-bin basket unsubscribe".split()
FILE_ENDINGS = "exe msi apk dmg iso zip rar gz jpg jpeg png gif webp svg ico mp3 mp4 avi mov css js woff".split()
PATTERNS = (*map(host_word, HOST_WORDS), *map(path_segment, PATH_SEGMENTS), *map(file_ending, FILE_ENDINGS))

HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs have each of the wanted tokens; at most the tokens of MAX_INLINE rules come back."""
    hit = urls.select(F.explode(F.filter("_tokens", lambda t: t.isin(wanted))).alias("t"))
    return {r.t: r.n for r in hit.groupBy("t").agg(F.count("*").alias("n")).collect()}


#: A rule as it is compared: the largest fitting one wins.
_RULE = "of_host int, length int, host_length int, blocks int, place bigint, rule string, verdict string, regex string"


def _entry(rule, place: int) -> tuple:
    host = isinstance(rule, HostRule)
    if not rule.literals:
        raise ValueError(f"a rule without a literal token: {rule}")
    return int(host), len(rule.name) if host else 0, len(rule.host) if host else 0, int(rule.verdict == "block"), -place, rule.name if host else None, rule.verdict, rule.regex


def judge_urls(urls: DataFrame, url: str = "url", host_rules=HOST_RULES, patterns=PATTERNS, default: str = "allow", max_inline: int = MAX_INLINE) -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls.

    Of the fitting host rules the longest (host and path together) wins; of equally long ones
    the one with the longer host, then `block`. Where none fits, rule is null and the verdict is
    that of the first fitting pattern, `block` before `allow`, else `default`. Null URLs and
    those without `://` have an empty host and path, which no host rule fits. Repeated rows and
    an empty table need no care; columns of urls named like the added ones are replaced, all
    others stay.
    """
    rules = [(_entry(r, i), list(r.literals)) for i, r in enumerate([*host_rules, *patterns])]
    if len(rules) > max_inline:
        spark = urls.sparkSession
        table = spark.createDataFrame([(*e, own) for e, own in rules], _RULE + ", literals array<string>")
        return judge_urls_by_table(urls, table, url, default)
    base = _tokenized(urls, url)
    if not rules:
        return _judged(base.withColumns({"_rule": F.lit(None).cast("string"), "_verdict": F.lit(default)}), urls)
    seen = _token_counts(base, sorted({w for _, own in rules for w in own}))
    index: dict[str, list[Column]] = {}
    for entry, own in rules:
        kinds = [x.split()[:2] for x in _RULE.split(", ")]
        index.setdefault(min(own, key=lambda w: (seen.get(w, 0), w)), []).append(F.struct(*[F.lit(v).cast(k).alias(n) for v, (n, k) in zip(entry, kinds, strict=True)]))
    table = F.create_map(*[x for token, found in index.items() for x in (F.lit(token), F.array(*found))])
    fetched = F.flatten(F.transform(F.filter("_tokens", lambda t: t.isin(list(index))), lambda t: table[t]))
    line = F.concat("_h", "_p")
    base = base.withColumn("_best", F.array_max(F.filter(fetched, lambda r: F.regexp(line, r["regex"]))))
    return _judged(base.withColumns({"_rule": F.col("_best.rule"), "_verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}), urls)


def _tokenized(urls: DataFrame, url: str) -> DataFrame:
    base = urls.withColumns({"_h": url_host(F.col(url)), "_p": url_path(F.col(url))})
    return base.withColumn("_tokens", F.array_distinct(F.split(F.lower(F.concat_ws("/", "_h", "_p")), TOKEN)))


def _judged(base: DataFrame, urls: DataFrame) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return base.select(*kept, F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def judge_urls_by_table(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """judge_urls() for any number of rules: rules has the columns of _RULE and literals, the tokens that any fitting URL has.

    Tokens of URLs meet the index by a join; an index of a checked size is broadcast, a larger
    one is joined by shuffle, and Spark splits what a frequent token gathers.
    """
    base = materialize(_tokenized(urls, url).withColumn("_id", F.monotonically_increasing_id()), "urls")
    tokens = base.select("_id", F.explode("_tokens").alias("_token"))
    own = rules.select("*", F.explode("literals").alias("_token")).drop("literals")
    wanted = materialize(own.select("_token").distinct(), "wanted")
    seen = tokens.join(small_side(wanted), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("_n"))
    names = [x.split()[0] for x in _RULE.split(", ")]
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_token"))
    index = materialize(own.join(seen, "_token", "left").groupBy(*names).agg(rarest.alias("r")).select(*names, F.col("r._token").alias("_token")), "index")
    met = tokens.join(small_side(index), "_token").join(base.select("_id", F.concat("_h", "_p").alias("_line")), "_id").where(F.regexp("_line", F.col("regex")))
    best = met.groupBy("_id").agg(F.max(F.struct(*names)).alias("_best"))
    found = base.join(best, "_id", "left").withColumns({"_rule": F.col("_best.rule"), "_verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
    return _judged(found, urls)
