"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` reads each text once, takes the measurements and sets one bit for
each rule that fails. Policies are versioned masks over the stored bits, so a
new policy, or leaving a rule out, never reads text again: ``apply_policy`` is
a bitwise test, and ``ablation`` counts documents by bit pattern and derives
from these few counts what every rule alone removes.

Everything about a text is computed within its row: there is no shuffle, and
no group of rows to skew. Repeated 5-word windows compare 64-bit window hashes
of one text.

Edge cases. Null texts have no words. Lines count as duplicates if they hold a
word and equal an earlier line of the text, byte for byte. Rows that repeat an
id are judged one by one. Further columns are carried only on request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rules by bit, from bit 0: name and the condition under which a text fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_words", "n_words > 10000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("exclamations", "2 * n_exclaims > n_words"),
    ("capitals", "10 * n_upper > 5 * word_chars"),
    ("digits", "10 * n_digits > 5 * word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_upper", "n_digits")


@dataclass(frozen=True)
class Policy:
    """A version and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("2024-1", tuple(BIT)), Policy("2024-1-lenient", ("few_words", "repeated_windows", "symbols")))}


def _covered(s: Column, size: int) -> Column:
    """Words under the windows of the sorted (hash, position) pairs that have an equal neighbour."""

    def at(s: Column) -> Column:
        same = lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    return F.element_at(F.transform(F.array(s), lambda s: F.element_at(F.transform(F.array(at(s)), total), 1)), 1)


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, the measurements (long) and ``failed`` (long bitmask, bit k for RULES[k])."""
    t = docs.select("doc_id", *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    t = t.withColumn("_w", F.array_remove(F.split("_t", WS), ""))
    t = t.withColumn("_n", F.size("_w"))
    t = t.withColumn("_g", F.when(F.col("_n") < 6, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.expr("slice(_w, 1, greatest(_n - 4, 0))"), lambda x, i: F.xxhash64(x, *[F.col("_w")[i + k] for k in range(1, 5)]))))
    t = t.withColumn("_same", F.size("_g") - F.size(F.array_distinct("_g")))
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.withColumn("_l", lines)
    t = t.select(
        "doc_id", *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_same") > 0, _covered(pairs, 5)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)), F.lit(0))
    return t.withColumn("failed", bits.cast("long"))


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and the policy's version."""
    return led.withColumn("kept", passes(policy)).withColumn("policy", F.lit(policy.version))


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, documents that no other of its rules fails, and documents kept without it.

    Reads the ledger once; from there on there are at most 2^rules rows.
    """
    counts = led.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("f")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules])
    each = counts.select("f", "n", F.explode(rules).alias("r")).select("f", "n", "r.rule", "r.bit")
    hit = F.col("f").bitwiseAND(F.col("bit")) != 0
    rest = F.col("f").bitwiseAND(F.lit(policy.mask) - F.col("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    ).withColumn("policy", F.lit(policy.version))
