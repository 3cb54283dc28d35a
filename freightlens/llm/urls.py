"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are trained on the URLs that a rule labels, a sample of bounded size chosen by a hash; scoring is one pass of
Spark's own model over all rows. Features are lengths, depth, digit ratio, character entropy, parameter counts and
statistics of host suffixes, which count all labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from freightlens.llm.tables import spare_name
from freightlens.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Trees:
    """sample: expected labelled URLs used for training at most. rounds, depth: of boosting. smooth: weight of the overall
    share in suffix statistics. cut: probability from which a URL is blocked."""

    sample: int = 9_000
    rounds: int = 20
    depth: int = 4
    smooth: float = 20.0
    cut: float = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as struct (rule, verdict), NULL if none: the host is the rule's or a subdomain of it,
    and the path starts with the rule's. Equally long rules go by text. `rules` is a configuration list."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ranked]
    hits = [F.when(f, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for f, r in zip(fits, ranked)]
    return F.coalesce(*hits) if hits else F.lit(None).cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters of a text, in bits; 0 for empty ones."""
    chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
    share = F.transform(chars, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


SUFFIXES = {"top": 1, "domain": 2}


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL alone; all are 0 for NULL and empty ones."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": F.size(F.array_remove(F.split(path, "/"), "")), "labels": F.size(F.array_remove(F.split(host, r"\."), "")),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)), "host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")),
        "entropy": entropy(url), "host_entropy": entropy(host), "parameters": F.size(F.array_remove(F.split(query, "&"), "")),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")), "fragment": F.instr(url, "#") > 0,
        "secure": F.lower(F.substring(url, 1, 8)) == "https://",
    }


def filtered(pages: DataFrame, rules: list[Rule], plan: Trees = Trees(), url: str = "url", key: str = "page_id") -> DataFrame:
    """`pages` with host, path, rule, verdict (allow or block) and score (the trees' probability of block).

    A rule's verdict stands; other URLs, NULL ones too, get that of the trees. If the labelled URLs have one verdict
    alone, all others get it too, and allow if there are none. Rows are never added or dropped; columns of `pages` that are
    called like a result are replaced. `key`, if the table has it, tells rows of the same URL apart where the training
    sample is drawn.
    """
    results = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in pages.columns if c.lower() not in results]
    link, whole = "_url", F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("int").alias(spare_name(pages, "none")))
    frame = pages.select(whole.alias("_row"), F.col(url).alias(link))  # columns of the caller stay in their struct
    frame = frame.withColumns({"host": host_of(F.col(link)), "path": path_of(F.col(link))})
    frame = frame.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    draw = F.pmod(F.xxhash64(link, *[F.col(f"_row.{c}") for c in kept if c == key]), F.lit(1 << 30)) / float(1 << 30)
    labelled = frame.where("_rule IS NOT NULL").select(link, "host", "path", (F.col("_rule.verdict") == BLOCK).cast("double").alias("_label"), draw.alias("_draw"))
    counted = labelled.groupBy(_suffix(F.col("host"), SUFFIXES["domain"]).alias("_domain")).agg(F.sum("_label").alias("s"), F.count("*").alias("n"))
    counted = stage(counted, "urls")  # one row per labelled domain, over all labelled URLs
    total, blocked = counted.agg(F.sum("n"), F.sum("s")).first()
    overall = blocked / total if total else 0.0
    if overall in (0.0, 1.0):
        return _judged(frame, F.lit(overall), plan, kept)
    sample = stage(labelled.where(F.col("_draw") < min(1.0, plan.sample / total)).drop("_draw"), "urls")
    features = lexical(F.col(link), F.col("host"), F.col("path"))
    tables = {}
    for name, labels in SUFFIXES.items():
        stats = counted.groupBy(_suffix(F.col("_domain"), labels).alias(f"_{name}")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        tables[name] = stats.select(f"_{name}", ((F.col("s") + plan.smooth * overall) / (F.col("n") + plan.smooth)).alias(f"_{name}_share"),
                                    F.log1p("n").alias(f"_{name}_seen"))

    def described(rows: DataFrame) -> DataFrame:
        for name, labels in SUFFIXES.items():
            rows = rows.withColumn(f"_{name}", _suffix(F.col("host"), labels)).join(tables[name], f"_{name}", "left")
            rows = rows.withColumns({f"_{name}_share": F.coalesce(f"_{name}_share", F.lit(overall)), f"_{name}_seen": F.coalesce(f"_{name}_seen", F.lit(0.0))})
        rows = rows.withColumns({f"_x_{k}": v.cast("double") for k, v in features.items()})
        inputs = [f"_x_{k}" for k in features] + [f"_{n}_{k}" for n in SUFFIXES for k in ("share", "seen")]
        return VectorAssembler(inputCols=inputs, outputCol="_features").transform(rows)

    train = stage(described(sample).select("_features", "_label").coalesce(1), "urls")  # a bounded sample
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=plan.rounds, maxDepth=plan.depth, seed=7)
    model = trees.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(train)
    scored = model.transform(described(frame))
    return _judged(scored, vector_to_array("_probability")[1], plan, kept)


def _judged(frame: DataFrame, score: Column, plan: Trees, kept: list[str]) -> DataFrame:
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(score >= plan.cut, BLOCK).otherwise(ALLOW))
    return frame.select(*[F.col(f"_row.`{c}`") for c in kept], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
