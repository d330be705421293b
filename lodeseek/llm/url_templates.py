"""URL filters: explicit rules first, then per-host path templates with labelled purity.

Paths form a tree under each host. Level by level, children that look alike
(numbers, hashes, dates, numbered files) and occur in at least two values
become one wildcard, and so do thin crowds of different literals. Sibling
branches are templates that differ in one literal. If the labelled block rates
of those with enough labels agree by a chi-square bound, these are merged, and
siblings without any label with them. A template is rejected if its
smoothed block rate over labelled urls is high; templates without labels of
their own or of merged siblings stay at the prior and are allowed. Labels are
the urls that explicit rules decide.

Counts are combined before every shuffle and no pairs of branches are built:
the chi-square of a family needs sums only, so a host with a third of all urls
is counted like any other.

Edge cases. Null urls and urls without ``://`` have an empty host and path and
no rule; they are allowed. Paths deeper than ``DEPTH`` end in ``**``. Rows that
repeat an id are judged one by one. Further columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

DEPTH = 8
#: Different values from which children of one shape are a wildcard; literals from which a thin crowd is one, and its mean use.
ALIKE, CROWD, THIN = 2, 30, 3
#: Labelled urls that each of two branches needs to be merged.
MERGE_LABELS = 5
PRIOR, STRENGTH, REJECT = 0.5, 10.0, 0.8


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _shape(s: Column) -> Column:
    """The shape of a segment, or null for a literal."""
    return (
        F.when(s.rlike(r"^[0-9]+$"), "{n}")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(s.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "{uuid}")
        .when(s.rlike(r"^(?=.*[0-9])[0-9a-f]{8,}$"), "{hex}")
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"\.[A-Za-z0-9]+$", 0)))
        .when(s.rlike(r"^[A-Za-z_-]+-?[0-9]{2,}$"), F.concat(F.regexp_extract(s, r"^[A-Za-z_-]+", 0), F.lit("{n}")))
    )


def templates(urls: DataFrame, ws: Workspace) -> DataFrame:
    """``urls`` (with host, path) and ``template``."""
    u = urls.withColumn("_s", F.split("path", "/")).withColumn("template", F.lit(""))
    deep = u.agg(F.max(F.size("_s"))).first()[0] or 0
    for d in range(1, min(deep, DEPTH + 1)):
        seg = F.get("_s", F.lit(d))
        u = u.withColumn("_v", seg).withColumn("_c", F.coalesce(_shape(F.col("_v")), F.lit("*")))
        key = ["host", "template", "_c"]
        kinds = u.where("_v is not null and _v <> ''").groupBy(*key, "_v").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("_k"), F.sum("n").alias("_n"))
        wild = kinds.where(F.when(F.col("_c") == "*", (F.col("_k") >= CROWD) & (F.col("_n") < THIN * F.col("_k"))).otherwise(F.col("_k") >= ALIKE)).select(*key, F.lit(True).alias("_wild"))
        u = u.join(wild, key, "left")
        part = F.when(F.col("_v").isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("_wild") & (F.col("_v") != ""), F.col("_c")).otherwise(F.col("_v"))))
        u = ws.table(u.withColumn("template", F.concat("template", part)).drop("_v", "_c", "_wild"), "level")
    return u.withColumn("template", F.when(F.size("_s") > DEPTH + 1, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("_s")


def purities(labelled: DataFrame) -> DataFrame:
    """host, template, purity from rows (host, template, blocked: boolean or null), similar branches merged."""
    t = labelled.groupBy("host", "template").agg(F.sum(F.when(F.col("blocked"), 1).otherwise(0)).alias("b"), F.count("blocked").alias("m"))
    segs = F.split("template", "/")
    # the family of each literal position: the template with a gap there
    family = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda p: F.array_join(F.transform("s", lambda x, i: F.when(i == p, F.lit("?")).otherwise(x)), "/"))
    kin = t.withColumn("s", segs).where("size(s) > 1").select("host", "template", "b", "m", F.explode(F.array_distinct(family)).alias("family"))
    sums = kin.where(F.col("m") >= MERGE_LABELS).groupBy("host", "family").agg(F.count("*").alias("k"), F.sum("b").alias("kin_b"), F.sum("m").alias("kin_m"), F.sum(F.col("b") * F.col("b") / F.col("m")).alias("q"))
    rate = F.col("kin_b") / F.col("kin_m")
    spread = F.when((F.col("kin_b") == 0) | (F.col("kin_b") == F.col("kin_m")), 0.0).otherwise((F.col("q") - F.col("kin_b") * rate) / (rate * (1 - rate)))
    bound = (F.col("k") - 1) + 2 * F.sqrt(2.0 * (F.col("k") - 1))
    alike = sums.where((F.col("k") > 1) & (spread <= bound)).select("host", "family", "kin_b", "kin_m")
    # siblings with a few labels of their own keep to these
    kin = kin.where((F.col("m") >= MERGE_LABELS) | (F.col("m") == 0))
    merged = kin.join(alike, ["host", "family"]).groupBy("host", "template").agg(F.max_by(F.struct("kin_b", "kin_m"), F.struct("kin_m", "family")).alias("f"))
    t = t.join(merged, ["host", "template"], "left")
    b, m = F.coalesce("f.kin_b", "b"), F.coalesce("f.kin_m", "m")
    return t.select("host", "template", ((b + STRENGTH * PRIOR) / (m + STRENGTH)).alias("purity"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ws: Workspace | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages`` (page_id, url)."""
    ws = ws or Workspace(pages.sparkSession, "urls")
    host, path = split_url(F.col("url").cast("string"))
    u = pages.select("page_id", host.alias("host"), path.alias("path"))
    u = u.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"))
    u = templates(u, ws)
    known = ws.table(purities(u.select("host", "template", (F.col("ruled") == "block").alias("blocked"))), "purities")
    u = u.join(known, ["host", "template"], "left")
    by_method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return u.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", "purity")
