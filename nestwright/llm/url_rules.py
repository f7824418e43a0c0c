"""URL verdicts from hand-written rules and mined association rules, with DataFrame functions only.

Spark's FP-growth mines combinations of URL tokens together with the label of the page they stand for; rules
"tokens => block" or "tokens => allow" above a confidence and support are kept. A kept rule is dropped when a rule with
fewer of its tokens, the same verdict and no less confidence is there. The rules' number is bounded by the support
threshold, so they travel as a literal: an inverted index from a rule's rarest token to its rules. Each URL looks up
its own tokens, and a rule fires when the URL has all its tokens. The most confident rule decides; without one the
verdict is ``default``.

Hand-written rules come first: host and path prefix, longest rule wins. Labels may be those rules' own verdicts: mined
rules then carry over to pages that no hand-written rule names what the named ones have in common.

Null urls and urls without ``://`` have an empty host and path, match no hand-written rule and carry only the token that
says so. Repeated rows are judged one by one; of mined rules that fire with equal confidence and support the first by
its tokens decides. An empty table gives no row, and no labels give no rules.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def hand_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, "host/path") that fits, else nulls."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = verdict = None
    for says, text in ranked:
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return (rule, verdict) if ranked else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels and suffixes, path words (numbers as ``#``), extension, query keys, fragment."""
    url = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), "[0-9]+", "#")))
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.split_part(F.lower(x), F.lit("="), F.lit(1))))
    return F.array_distinct(
        F.concat(
            F.array(F.when(host == "", F.lit("no host")).otherwise(F.concat(F.lit("scheme:"), F.lower(F.split_part(url, F.lit("://"), F.lit(1)))))),
            F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
            F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("site:"), F.concat_ws(".", F.slice(labels, -2, 2))))).otherwise(F.array().cast("array<string>")),
            words,
            keys,
            F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def mine(labelled: DataFrame, url_col: str, label_col: str, support: float = 0.01, confidence: float = 0.8, train_rows: int = 20_000) -> list[dict]:
    """Rules {tokens, verdict, confidence, support} from rows with label 1 (block) or 0 (allow).

    At most ``train_rows`` rows are mined, those of smallest url hash: the model's cost does not grow with the corpus.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).alias("bad"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "bad").limit(train_rows)
    items = rows.select(F.concat(tokens(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))), F.array(F.when(F.col("bad") == 1, "=block").otherwise("=allow"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    out = model.associationRules.where(F.element_at("consequent", 1).isin("=block", "=allow") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    found = [{"tokens": sorted(r.antecedent), "verdict": r.consequent[0][1:], "confidence": r.confidence, "support": r.support} for r in out.collect()]
    kept: list[dict] = []
    for rule in sorted(found, key=lambda r: (len(r["tokens"]), r["tokens"])):
        own = set(rule["tokens"])
        if not any(set(k["tokens"]) <= own and k["verdict"] == rule["verdict"] and k["confidence"] >= rule["confidence"] for k in kept):
            kept.append(rule)
    return kept


def index_rules(rules: list[dict]) -> Column:
    """Literal map from a token to the rules filed under it; each rule is filed once, under its rarest token."""
    uses: dict[str, int] = {}
    for rule in rules:
        for t in rule["tokens"]:
            uses[t] = uses.get(t, 0) + 1
    filed: dict[str, list[dict]] = {}
    for i, rule in enumerate(sorted(rules, key=lambda r: (-r["confidence"], -r["support"], r["tokens"]))):
        filed.setdefault(min(rule["tokens"], key=lambda t: (uses[t], t)), []).append({"rank": i, "verdict": rule["verdict"], "tokens": rule["tokens"]})
    return F.from_json(F.lit(json.dumps(filed)), "map<string,array<struct<`rank`:int,verdict:string,tokens:array<string>>>>")


def mined_verdict(of: Column, rules: list[dict]) -> Column:
    """Verdict of the best mined rule whose tokens are all among ``of``; null without one."""
    if not rules:
        return F.lit(None).cast("string")
    index = index_rules(rules)

    def best(own: Column) -> Column:
        hits = F.flatten(F.transform(own, lambda t: F.coalesce(F.try_element_at(index, t), F.expr("cast(array() as array<struct<`rank`:int,verdict:string,tokens:array<string>>>)"))))
        return F.array_min(F.filter(hits, lambda r: F.size(F.array_except(r["tokens"], own)) == 0))

    return F.get(F.transform(F.array(of), best), F.lit(0))["verdict"]  # the tokens are made once, not per rule


def judge(pages: DataFrame, hand_rules: list[tuple[str, str]], mined: list[dict], url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep``, host, path, rule, verdict, mined: one row per page, one scan.

    Columns of ``keep`` that are called like one of the others are left out.
    """
    keep = tuple(c for c in keep if c.lower() not in ("host", "path", "rule", "verdict", "mined"))
    url = F.col(f"`{url_col}`").cast("string")
    kept = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep))) if keep else F.lit(None)
    rows = pages.select(kept.alias("kept"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, says = hand_rule(F.col("host"), F.col("path"), hand_rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    rows = rows.withColumn("mined", mined_verdict(tokens(F.col("url"), F.col("host"), F.col("path")), mined))
    return rows.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", F.coalesce("says", "mined", F.lit(default)).alias("verdict"), "mined")


def labelled_by_rules(pages: DataFrame, hand_rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """(url, bad) of the pages that a hand-written rule decides: what the rules say is the page's own label."""
    url = F.col(f"`{url_col}`").cast("string")
    _, says = hand_rule(host_of(url), path_of(url), hand_rules)
    return pages.select(url.alias("url"), F.when(says == "block", 1).when(says == "allow", 0).alias("bad")).where("bad is not null")
