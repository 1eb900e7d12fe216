"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch candidates, and only those run their patterns.

A rule is ``host/path``: it fits URLs of the host and all its subdomains whose path starts with the rule's. ``*`` in a rule stands
for any characters. Of the rules that fit, the longest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one broadcast holds; a longer list is applied in parts, and the longest of the parts' winners wins.
MAX_RULES = 200_000
TOKEN = r"[^A-Za-z0-9]+"
_TOKEN = re.compile("[A-Za-z0-9]+")


def host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str | Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    def pattern(self) -> re.Pattern:
        where, _, rest = self.text.partition("/")
        any_ = "(?s:.*)"
        return re.compile(f"(?:{any_}\\.)?{any_.join(map(re.escape, where.split('*')))}\\0/{any_.join(map(re.escape, rest.split('*')))}")

    def literals(self) -> list[str]:
        """Tokens that every URL of the rule holds whole: those between marks, not those cut off by ``*`` or the rule's end."""
        text = "." + self.text
        return [m[0] for m in _TOKEN.finditer(text) if text[m.start() - 1] != "*" and m.end() < len(text) and text[m.end()] != "*"]


def tokens(host_and_path: Column) -> Column:
    return F.array_distinct(F.split(host_and_path, TOKEN))


def _frequencies(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens (never more entries than the rules have tokens)."""
    if not wanted:
        return {}
    spark = urls.sparkSession
    own = spark.createDataFrame([(t,) for t in sorted(wanted)], "token string")
    seen = urls.select(F.explode(tokens(F.concat_ws("/", "host", "path"))).alias("token"))
    return dict(map(tuple, seen.join(F.broadcast(own), "token").groupBy("token").count().collect()))


def _fetch(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token, always = index.value
        compiled: dict[str, re.Pattern] = {}

        def fits(rule: Rule, target: str) -> bool:
            if rule.text not in compiled:
                compiled[rule.text] = rule.pattern()
            return compiled[rule.text].match(target) is not None

        for batch in batches:
            names, verdicts = [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                target = f"{h}\0{p}"
                candidates = {r for t in set(_TOKEN.findall(target)) for r in by_token.get(t, ())} | always
                best = max((r for r in candidates if fits(r, target)), key=lambda r: (len(r.text), r.text), default=None)
                names.append(best and best.text)
                verdicts.append(best and best.verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], [*batch.schema.names, "rule", "verdict"])

    return run


def judged(pages: DataFrame, rules: list[Rule], default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of ``pages`` (page_id, url; other columns are ignored).

    ``rule`` is the longest that fits, of equally long ones the last by code points, else null; ``verdict`` is the rule's, else
    ``default``. A null url or one without ``://`` has an empty host and path and fits no rule but ``*`` ones; repeated rows are judged alike.
    Rules that are given twice with different verdicts raise an error. An empty table gives no rows.
    """
    if len({r.text for r in rules}) < len(set(rules)):
        raise ValueError("a rule has two verdicts")
    spark = pages.sparkSession
    urls = pages.select("page_id", host("url").alias("host"), path("url").alias("path"))
    count = _frequencies(urls, {t for r in rules for t in r.literals()})
    out, schema = urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}), "page_id {}, host string, path string, rule string, verdict string"
    schema = schema.format(dict(urls.dtypes)["page_id"])
    for at in range(0, len(rules), max_rules):
        by_token: dict[str, list[Rule]] = {}
        always = set()
        for r in sorted(set(rules[at : at + max_rules]), key=lambda r: r.text):
            literals = r.literals()
            if literals:
                by_token.setdefault(min(literals, key=lambda t: (count.get(t, 0), -len(t), t)), []).append(r)
            else:
                always.add(r)
        index = spark.sparkContext.broadcast((by_token, always))
        found = out.select("page_id", "host", "path", F.col("rule").alias("old_rule"), F.col("verdict").alias("old_verdict"))
        found = found.mapInArrow(_fetch(index), schema.replace("rule string, verdict", "old_rule string, old_verdict") + ", rule string, verdict string")
        newer = F.col("old_rule").isNull() | (F.length("rule") > F.length("old_rule")) | ((F.length("rule") == F.length("old_rule")) & (F.col("rule") > F.col("old_rule")))
        take = F.col("rule").isNotNull() & newer
        out = found.select("page_id", "host", "path", *[F.when(take, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("rule", "verdict")])
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def allowed(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with their own columns."""
    verdicts = judged(pages.select(F.struct(*pages.columns).alias("page_id"), "url"), rules, default)
    return verdicts.where("verdict = 'allow'").select("page_id.*")
