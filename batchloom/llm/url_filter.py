"""URL rules fetched by their rarest literal token.

Every rule has literal tokens that a fitting URL must contain whole. Over the tokens of all URLs the rarest of
them becomes the rule's index key. A URL's tokens fetch the rules filed under them, and only those rules'
regular expressions run. Matching works on distinct URLs; everything is DataFrame functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules whose index may be broadcast, at most; more are joined by shuffle.
BROADCAST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`text` is host, then path. It fits the host, its subdomains, and paths that start with the path."""

    text: str
    action: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])

    @property
    def regex(self) -> str:
        return r"^(?:[^/]*\.)?" + _quote(self.host) + (_quote(self.path) if self.path else r"(?:/|\z)")

    @property
    def tokens(self) -> list[str]:
        whole = re.findall("[0-9A-Za-z]+", self.host + self.path)
        if self.path and re.search("[0-9A-Za-z]$", self.path):
            whole.pop()  # a path may go on within its last token
        return sorted(set(whole))


@dataclass(frozen=True)
class HostPattern:
    """A pattern of the method's own verdict: `regex` on the host, which must contain the whole `tokens`."""

    regex: str
    tokens: tuple[str, ...]
    action: str = "block"


# Words that a host label is made of where links are sold, and others that make such a label together.
SOLD = ("adult", "bet", "bets", "casino", "gambling", "lottery", "pills", "poker", "porn", "replica", "slots", "spam", "torrent", "viagra", "warez", "xxx")
PAIRED = (("ads", "track"), ("cheap", "meds"), ("click", "farm"), ("link", "farm"), ("payday", "loan"), ("payday", "loans"))


def _label(*words: str) -> str:
    """A host label of hyphenated words, with these side by side among them; never the last label, the top-level domain."""
    return r"(?:^|[.-])" + "-".join(words) + r"(?:-[^./]*)?\."


#: What judges a URL that no rule fits: hosts with such a label are blocked, the rest is allowed.
OWN_PATTERNS = tuple(HostPattern(r"^[^/]*?" + _label(*w), w) for w in (*((w,) for w in SOLD), *PAIRED))


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/_-])", r"\\\1", text)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, path), "[^0-9A-Za-z]+"), lambda t: t != ""))


def judge_urls(pages: DataFrame, rules: list[Rule], patterns: tuple[HostPattern, ...] = OWN_PATTERNS) -> DataFrame:
    """(page_id, url) -> (page_id, host, path, rule, verdict), one row per input row.

    The longest fitting rule decides (host and path together; of equally long ones the greater text). Without one,
    rule is null and the patterns decide: block if any that fits blocks, else allow. A null url or one without ://
    has an empty host and path, fits nothing and is allowed.
    """
    spark = pages.sparkSession
    filed = [(i, r.text, len(r.host + r.path), r.action, r.regex, t) for i, r in enumerate(rules) for t in r.tokens]
    filed += [(len(rules) + i, None, -1, p.action, p.regex, t) for i, p in enumerate(patterns) for t in p.tokens]
    if lost := [r.text for r in rules if not r.tokens] + [p.regex for p in patterns if not p.tokens]:
        raise ValueError(f"rules without a whole literal token: {lost}")
    literal = spark.createDataFrame(filed, "id int, rule string, long int, action string, regex string, token string")
    small = F.broadcast if len(rules) + len(patterns) <= BROADCAST_RULES else (lambda x: x)

    url = F.col("url").cast("string")
    pages = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = pages.where("host <> '' or path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    tokens = seen.select("host", "path", "n", F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    counts = tokens.join(small(literal.select("token").distinct()), "token").groupBy("token").agg(F.sum("n").alias("n"))
    # A token that no URL has is the rarest: its rule can fit nothing and is filed where nothing looks.
    index = (
        literal.join(counts, "token", "left")
        .groupBy("id", "rule", "long", "action", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("key"))
        .select("rule", "long", "action", "regex", F.col("key.token").alias("token"))
    )
    fits = tokens.select("host", "path", "token").join(small(index), "token").where(F.expr("concat(host, path) rlike regex"))
    best = F.max(F.struct("long", F.col("rule"), F.col("action"))).alias("best")
    verdicts = fits.groupBy("host", "path").agg(best).select(F.col("host").alias("host_"), F.col("path").alias("path_"), "best")
    joined = pages.join(verdicts, (F.col("host") == F.col("host_")) & (F.col("path") == F.col("path_")), "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))
