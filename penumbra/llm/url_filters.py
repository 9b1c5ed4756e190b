"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over a URL's address (host and path) with the literal tokens that every
address it fits must hold. Rules are indexed by the one of their tokens that the addresses of the table
hold least often; an address fetches the rules of its own tokens, and only those run their expressions.
Everything is DataFrame functions: the index is a table joined by token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import materialise

_LOWER = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True))
#: Up to so many rules are shipped to every task; more are joined by shuffles.
SHIPPED_RULES = 100_000
#: The token of rules without a literal one: every address holds it.
ANY = ""


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for a host and its subdomains where the path starts with ``path``; the longest host and path wins."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return f"^(?:[^/]*\\.)?{_quoted(self.host)}{_quoted(self.path)}"

    @property
    def tokens(self) -> list[str]:
        # The path's last token counts only if something ends it, as an address may go on.
        return _runs(self.host) + _runs(re.sub(r"[A-Za-z0-9]+$", "", self.path))


@dataclass(frozen=True)
class WordRule:
    """Blocks addresses that hold ``words``, runs of a-z and 0-9 joined by single other characters (``*``: any run), as whole words."""

    words: str

    @property
    def name(self) -> str:
        return self.words

    @property
    def pattern(self) -> str:
        inner = "".join("[A-Za-z0-9]*" if p == "*" else _quoted(p) for p in re.split(r"(\*)", self.words))
        return f"(?i)(?:^|[^A-Za-z0-9]){inner}(?:$|[^A-Za-z0-9])"

    @property
    def tokens(self) -> list[str]:
        return _runs(re.sub(r"[A-Za-z0-9]*\*[A-Za-z0-9*]*", "*", self.words))


#: Words whose pages are blocked where no host rule decides.
BLOCKED_WORDS = [
    WordRule(w)
    for w in (
        "casino", "casinos", "poker", "bets", "betting", "gambling", "jackpot", "pills", "viagra", "cialis", "pharma-online", "spam", "spam-farm",
        "adult", "adult-x", "porn*", "xxx", "sex", "escort", "escorts", "nude", "nudes", "ads", "ads-track", "adserver", "doubleclick", "tracker", "popads",
        "malware", "phishing", "warez", "keygen", "crack", "torrent", "torrents", "free-bets", "cheap-pills", "casino-win", "payday-loan", "replica-watches",
    )
]


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else "\\" + c if c.isascii() else c for c in text)


def _runs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: the host from the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path from
    there up to ``?``, ``#`` or the end. A null URL and one without ``://`` have neither."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    rest = F.when(F.instr(url, "://") > 0, F.split(rest, "[?#]", 2)[0]).otherwise("")
    host = F.split(rest, "/", 2)[0]
    return F.translate(host, "".join(_LOWER), "".join(_LOWER.values())), F.substring(rest, F.length(host) + 1, F.length(rest))


def _tokens(address: Column) -> Column:
    """The different runs of a-z and 0-9 of an address, lower-cased, and the token of rules without one."""
    low = F.translate(address, "".join(_LOWER), "".join(_LOWER.values()))
    return F.array_union(F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != ""), F.array(F.lit(ANY)))


def rule_index(addresses: DataFrame, rules: list[HostRule | WordRule]) -> DataFrame:
    """``token, rule, host_rule, verdict, pattern, length``: every rule under its rarest token among ``addresses(tokens)``.

    Ties go to the smaller token.
    """
    spark = addresses.sparkSession
    rows = [(i, r.name, isinstance(r, HostRule), getattr(r, "verdict", "block"), r.pattern, len(r.name), r.tokens or [ANY]) for i, r in enumerate(rules)]
    schema = "number int, rule string, host_rule boolean, verdict string, pattern string, length int, tokens array<string>"
    listed = spark.createDataFrame(rows, schema).select("*", F.explode("tokens").alias("token")).drop("tokens")
    shipped = F.broadcast if len(rules) <= SHIPPED_RULES else lambda frame: frame
    held = addresses.select(F.explode("tokens").alias("token")).join(shipped(listed.select("token").distinct()), "token")
    counts = held.groupBy("token").agg(F.count("*").alias("held"))
    rarest = F.min(F.struct(F.coalesce("held", F.lit(0).cast("long")), "token"))
    best = listed.join(counts, "token", "left").groupBy("number").agg(rarest["token"].alias("token"))
    return listed.join(best, ["number", "token"]).drop("number")


def judge(
    pages: DataFrame, host_rules: list[HostRule], word_rules: list[WordRule] | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, word`` of every row.

    Of the host rules that fit, the longest decides (of equal lengths the one with the longer host, then the smaller name, then block)
    and ``rule`` is its name. Where none fits, the verdict is block if a word rule fits (``word``: the smallest that does) and allow
    otherwise; a null URL, or one without ``://``, has an empty host and path and is allowed. Null and repeated ids, repeated rows and
    other columns do no harm: a verdict follows from the URL, rows meet it by id and URL. An empty table gives an empty table.
    """
    rules = [*host_rules, *(BLOCKED_WORDS if word_rules is None else word_rules)]
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    address = F.concat("host", "path")
    # Rows that repeat id and address are judged once, so the second join doesn't multiply them.
    asked = rows.distinct().where("host <> '' or path <> ''").withColumn("tokens", _tokens(address))
    index = materialise(rule_index(asked, rules), "rules")
    index = F.broadcast(index) if len(rules) <= SHIPPED_RULES else index
    fetched = asked.select("page_id", "host", "path", F.explode("tokens").alias("token")).join(index, "token")
    fits = fetched.where(F.regexp_like(address, F.col("pattern")))
    longest = F.struct("length", F.length(F.split("rule", "/", 2)[0]).alias("host_length"))
    order = F.when(F.col("host_rule"), F.struct((-longest["length"]).alias("a"), (-longest["host_length"]).alias("b"), F.col("rule"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("c"), "verdict"))
    found = fits.groupBy("page_id", "host", "path").agg(F.min(order).alias("first"), F.min(F.when(~F.col("host_rule"), F.col("rule"))).alias("word"))
    found = found.select(F.col("page_id").alias("id"), F.col("host").alias("h"), F.col("path").alias("p"), "first", "word")
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("host") == F.col("h")) & (F.col("path") == F.col("p"))
    verdict = F.coalesce(F.col("first.verdict"), F.when(F.col("word").isNotNull(), "block").otherwise("allow"))
    return rows.join(found, same, "left").select("page_id", "host", "path", F.col("first.rule").alias("rule"), verdict.alias("verdict"), "word")
