"""URL filter: host and path rules, then a weighted vocabulary of terms found by an Aho-Corasick automaton.

Every term has a weight, and the weights of the different terms of a URL add up: a strict term rejects alone, soft ones once enough
different ones occur. A term only counts between boundaries: the
characters beside it, if any, are neither letters nor digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

STRICT, NEEDED = 2, 2  # the weight of a term that rejects alone; the weight of different terms that rejects

#: Terms and their weights: strict ones weigh STRICT, soft ones 1.
TERMS = {t: STRICT for t in ("spam-farm", "cheap-pills", "free-bets", "porn", "xxx", "hentai", "viagra", "cialis", "warez", "phishing", "porno", "sexcam", "camgirls", "escorts")} | {
    t: 1
    for t in (
        *("spam", "farm", "cheap", "pills", "free", "bets", "casino", "poker", "bonus", "jackpot", "loan", "loans", "adult", "sex", "nude", "escort", "crack", "keygen", "torrent", "payday"),
        *("billig", "pillen", "gratis", "wetten", "kredit", "nackt", "glücksspiel"),
        *("pilules", "gratuit", "crédit", "nue", "loterie"),
        *("barato", "pastillas", "apuestas", "préstamos", "desnuda", "lotería"),
    )
}


def terms_from(table: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, int]:
    """The vocabulary of a table, a bounded list: lower-cased terms with their weights, of a repeated term the largest."""
    rows = table.where(F.col(term).isNotNull() & (F.col(term) != "") & (F.col(weight) > 0)).groupBy(F.lower(F.col(term).cast("string")).alias("t")).agg(F.max(F.col(weight).cast("int")).alias("w"))
    return {r["t"]: r["w"] for r in rows.orderBy("t").collect()}


def automaton(terms: Mapping[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in terms.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def rejects(url: str, terms: ahocorasick.Automaton, needed: int) -> tuple[bool, int, int]:
    """The verdict, and how many different strict and soft terms stand between boundaries."""
    seen: dict[str, int] = {}
    for end, (term, weight) in terms.iter(url) if len(terms) else ():
        start = end - len(term) + 1
        if (start == 0 or not url[start - 1].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
            seen[term] = weight
    strict = sum(w >= STRICT for w in seen.values())
    return sum(seen.values()) >= needed, strict, len(seen) - strict


def rule_column(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits."""

    def fits(rule: str) -> Column:
        name, slash, prefix = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)

    ordered = sorted(rules, key=lambda r: -len(r[0]))
    pick = lambda what: reduce(lambda rest, r: F.when(fits(r[0]), F.lit(what(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return pick(lambda r: r[0]), pick(lambda r: r[1])


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(ascii_lower(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, terms: Mapping[str, int] = TERMS, needed: int = NEEDED) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and the numbers of different strict and soft terms.

    A null url, or one without ://, has empty host and path and fits no rule; null has no terms. A longer rule beats a
    shorter one. Null ids and repeated rows stay; an empty table gives no rows; extra columns, of any name, are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(terms)
        for batch in batches:
            found = [rejects((x or "").lower(), own, needed) for x in batch.column("url").to_pylist()]
            new = [pa.array([f[0] for f in found], pa.bool_()), *(pa.array([f[i] for f in found], pa.int32()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *new], ["id", "url", "rejected", "n_strict", "n_soft"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.mapInArrow(count, "id long, url string, rejected boolean, n_strict int, n_soft int")
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return rows.select(F.col("id").alias("page_id"), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_strict", "n_soft")


def verdict_sql(terms: Mapping[str, int] = TERMS, needed: int = NEEDED) -> str:
    """DuckDB SQL for the result of judged() over the view pages."""
    hit = lambda t: f"CAST(regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') AS INT)"
    count = lambda own: " + ".join(hit(t) for t, w in terms.items() if own(w)) or "0"
    fit = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    case = lambda i: " ".join(f"WHEN {fit(r[0])} THEN '{r[i]}'" for r in ordered)
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, {count(lambda w: w >= STRICT)} AS n_strict, {count(lambda w: w < STRICT)} AS n_soft, {' + '.join(f"{w} * {hit(t)}" for t, w in terms.items())} AS weight FROM p)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE {case(0)} END AS rule,
  coalesce(CASE {case(1)} END, CASE WHEN weight >= {needed} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n_strict AS INT) AS n_strict, CAST(n_soft AS INT) AS n_soft FROM t"""
