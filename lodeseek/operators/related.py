"""Related records: groups of siblings, values in fragments, words on a page, recovery plans."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.ocr import CONFUSED
from ..functions.plan_decode import strict
from ..shared import small_batches

# --- fixed values ---
PART_FIELD = r"(?i)(?:part|chunk|segment|prefix|suffix)[_-]?(?:\d+)?$"
VALUE = (12, 512)  # characters of a value that is joined from fragments
# --- end of fixed values ---


def _named(records: DataFrame, compat: bool) -> DataFrame:
    """``records`` with the key of their group: _root, _parent, _relation."""
    r = records if compat else records.where("location <> 'document'")
    parent = F.coalesce(F.nullif("grp", F.lit("")), "parent_id", "nested_path")
    relation = F.coalesce(F.nullif("relationship", F.lit("")), F.when(F.col("field_path") != "", "field-sibling").otherwise("position-neighbor"))
    return r.withColumns({"_root": F.col("root_path"), "_parent": parent, "_relation": relation})


KEY = ("_root", "_parent", "_relation")


def _group_id():
    return F.concat(F.lit("G:"), F.substring(F.sha2(F.concat_ws("\0", *KEY), 256), 1, 16))


def groups(records: DataFrame, compat: bool = False, of: DataFrame | None = None) -> DataFrame:
    """Groups of two or more records with one parent and relation, members in natural order.

    group_id, root_path, parent, relation, members array<struct<key, record_id, location, text, context, ...>>, parts, confidence. A text's whole
    ``document`` record is left out unless ``compat``. Groups are siblings within one row, page or object; ``of`` (group_id) names the only ones that are wanted.
    """
    r = _named(records, compat)
    if of is not None:
        r = r.withColumn("group_id", _group_id()).join(of.select("group_id").distinct(), "group_id", "left_semi")
    key = T.natural_key(F.coalesce(F.nullif("field_path", F.lit("")), "location"))
    member = F.struct(key.alias("key"), "record_id", "location", "text", "context", "confidence", "nested_path", F.coalesce("parent_id", F.lit("")).alias("parent_id"))
    part = F.when(F.col("field_path").rlike(PART_FIELD), 1).otherwise(0)
    one = lambda c: F.min(c) == F.max(c)  # noqa: E731 - counts of distinct values would triple the rows
    g = r.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.sum(part).alias("parts"), F.min("confidence").alias("low"), one(F.coalesce("parent_id", F.lit(""))).alias("one_parent"), one("nested_path").alias("one_place"), F.count("*").alias("n"),
    )
    g = g.where((F.col("n") >= 2) & ((F.col("parts") > 0) | (F.col("one_parent") & F.col("one_place"))))
    return g.select(_group_id().alias("group_id"), F.col("_root").alias("root_path"), F.col("_parent").alias("parent"), F.col("_relation").alias("relation"), "members", "parts", (F.col("low") * F.when(F.col("parts") > 0, 0.95).otherwise(0.80)).alias("confidence"))


def fragmented(records: DataFrame, compat: bool = False) -> DataFrame:
    """The records of groups that ``fragments`` can join: every text is a usable fragment, and together they are of a value's length.

    Sizes are summed before anything is gathered, so that only short groups are ever collected into rows.
    """
    r = _named(records, compat).withColumn("_atom", T.fragment_atom(F.col("text")))
    short = r.groupBy(*KEY).agg(F.every(F.col("_atom").isNotNull()).alias("usable"), F.sum(F.length("_atom")).alias("size")).where("usable").where(F.col("size").between(*VALUE)).select(*KEY)
    return r.where("_atom is not null").join(short, [*KEY], "left_semi").select(*records.columns)


def fragments(g: DataFrame) -> DataFrame:
    """Records of values joined from groups whose members are all usable fragments, 12 to 512 characters long."""
    atoms = F.transform("members", lambda m: T.fragment_atom(m["text"]))
    g = g.withColumn("atoms", atoms).where(F.forall("atoms", lambda a: a.isNotNull())).withColumn("value", F.array_join("atoms", "")).where(F.length("value").between(*VALUE))
    null = F.lit(None).cast("string")
    return g.select(
        F.concat(F.lit("F:"), "group_id").alias("record_id"), "root_path", F.col("members")[0]["nested_path"].alias("nested_path"), F.lit("related-group").alias("carrier_type"),
        F.array_join(F.transform("members", lambda m: m["location"]), " + ").alias("location"), F.col("value").alias("text"), F.array_join(F.transform("members", lambda m: m["context"]), " ").alias("context"),
        F.col("group_id").alias("grp"), null.alias("field_path"), F.col("relation").alias("relationship"), "confidence", null.alias("encoding"), F.lit(None).cast("long").alias("byte_offset"), F.lit(None).cast("int").alias("page"),
        null.alias("mime"), F.lit("related-group").alias("detected_type"), null.alias("parent_id"), F.sha2("value", 256).alias("content_sha256"),
    )


def ocr_lines(words: DataFrame, *line: str) -> DataFrame:
    """Lines of words (word, ord, left, top, width, height, conf) for each key ``line``: text, box and mean confidence.

    Words are set apart where the gap to the word before is over 2 and over 0.35 of the line's upper median height.
    """
    w = W.partitionBy(*line).orderBy("ord", "left", "width", "height")
    x = words.withColumns({"_n": F.row_number().over(w), "_gap": F.col("left") - F.lag(F.col("left") + F.col("width")).over(w)})
    member = F.struct("_n", "word", "_gap")
    g = x.groupBy(*line).agg(
        F.sort_array(F.collect_list("height")).alias("_hs"), F.sort_array(F.collect_list(member)).alias("_ws"), F.min("left").alias("box_left"), F.min("top").alias("box_top"), F.max(F.col("left") + F.col("width")).alias("_r"), F.max(F.col("top") + F.col("height")).alias("_b"), F.avg("conf").alias("conf"),
    )
    g = g.withColumn("_least", F.greatest(F.lit(2.0), F.col("_hs")[F.floor(F.size("_hs") / 2).cast("int")] * 0.35))
    text = F.array_join(F.transform("_ws", lambda m, i: F.concat(F.when((i > 0) & (m["_gap"] > F.col("_least")), " ").otherwise(""), m["word"])), "")
    return g.select(*line, text.alias("text"), "box_left", "box_top", (F.col("_r") - F.col("box_left")).alias("box_width"), (F.col("_b") - F.col("box_top")).alias("box_height"), "conf")


def _error(plan: dict, group_id: str, known: dict[str, str], config: Config) -> str | None:
    """Why a plan is refused before it runs, or None."""
    shape = {"version": str, "group_id": str, "record_ids": list, "operations": list, "output_ref": str}
    if set(plan) - {*shape} or any(not isinstance(plan.get(k), t) for k, t in shape.items()) or plan["version"] != "1.0":
        return "plan has another shape"
    ids, ops = plan["record_ids"], plan["operations"]
    if not 1 <= len(ids) <= 16 or len(set(ids)) != len(ids) or any(not isinstance(i, str) or not re.fullmatch(r"[A-Za-z]:?[A-Za-z0-9:+.-]+", i) for i in ids):
        return "record ids are malformed"
    if not 1 <= len(ops) <= min(16, config.limits.max_plan_operations):
        return "operation budget exceeded"
    if plan["group_id"] != group_id or any(i not in known for i in ids):
        return "plan leaves its group"
    fields = {"concat": ({"inputs", "output"}, {"separator"}), "decode": ({"input", "encoding", "output"}, set()), "substitute": ({"input", "positions", "output"}, set())}
    for op in ops:
        need, may = fields.get(op.get("op"), (None, None))
        if need is None or not need <= set(op) - {"op"} <= need | may:
            return "operation has another shape"
    return None


def run_plan(plan: dict, group_id: str, known: dict[str, str], config: Config = Config()) -> str:
    """The value of a validated plan over the texts ``known`` by record id; every output name is assigned once."""
    if (why := _error(plan, group_id, known, config)) is not None:
        raise ValueError(why)
    have = {i: known[i].strip() for i in plan["record_ids"]}
    for op in plan["operations"]:
        sources = op["inputs"] if op["op"] == "concat" else [op["input"]]
        if op["output"] in have or any(s not in have for s in sources):
            raise ValueError("references must be assigned once, before their use")
        value = have[sources[0]]
        if op["op"] == "concat":
            separator = op.get("separator", "")
            if len(separator) > 8:
                raise ValueError("separator is too long")
            value = separator.join(have[s] for s in sources)
        elif op["op"] == "decode":
            value = strict(value, op["encoding"], config.limits.max_plan_output)
        else:
            chars = list(value)
            for at, new in op["positions"].items():
                if not at.isdigit() or int(at) >= len(chars) or len(new) != 1 or new not in CONFUSED.get(chars[int(at)], ""):
                    raise ValueError("substitution is not an optical confusion")
                chars[int(at)] = new
            value = "".join(chars)
        if len(value.encode()) > config.limits.max_plan_output:
            raise ValueError("output budget exceeded")
        have[op["output"]] = value
    if not have.get(plan["output_ref"]):
        raise ValueError("output is missing or empty")
    return have[plan["output_ref"]]


def plans(g: DataFrame, proposed: DataFrame, config: Config = Config()) -> DataFrame:
    """group_id, value, error, confidence for proposed plans (group_id, plan: JSON) over their groups."""

    def outcome(plan: str, group_id: str, ids, texts) -> tuple[str | None, str | None]:
        try:
            return run_plan(json.loads(plan), group_id, dict(zip(ids, texts, strict=True)), config), None
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            return None, str(e)

    def execute(plan: pd.Series, group_id: pd.Series, ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outcome(*x) for x in zip(plan, group_id, ids, texts, strict=True)], columns=["value", "error"], dtype=object)

    small_batches(proposed.sparkSession)
    of = lambda f: F.transform("members", lambda m: m[f])
    low = F.greatest(F.lit(0.35), F.array_min(of("confidence")) - 0.12)
    x = proposed.join(g.select("group_id", of("record_id").alias("ids"), of("text").alias("texts"), low.alias("confidence")), "group_id")
    r = F.pandas_udf(execute, "value string, error string")("plan", "group_id", "ids", "texts")
    return x.select("group_id", r.alias("r"), "confidence").select("group_id", "r.value", "r.error", "confidence")
