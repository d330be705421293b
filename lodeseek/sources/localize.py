"""Localization: files and binary columns to located text records.

Objects are expanded to all depths (archives in archives) where they are read,
in one Arrow-batched pass whose rows are a tagged union of records, objects and
warnings, written once to the shared folder; contents of children are never
moved. The expanded-size budget holds for each root over all levels: children
are admitted in order of their paths while their sizes fit, and every child
beyond it is a warning. Where all children of a root fit, their order doesn't
matter. Roots that hold more are taken again, level by level: the next level
reads the children from the checkpoint of the last, and sums are taken over
paths and sizes.
"""

from __future__ import annotations

import atexit
import os
from collections import namedtuple
from collections.abc import Collection, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Limits
from ..functions import text as T
from ..shared import checkpoint_root, shared_folder, small_batches, spread
from . import carriers
from .detect import HANDLER_OF, detect

OBJECT = "root_path string, nested_path string, name string, depth int, parent_id string, data binary"
FOUND = (
    "tag string, root_path string, nested_path string, name string, depth int, parent_id string, kind string, mime string, structural boolean, size long, carrier_type string, location string, text string, context string, "
    "grp string, field_path string, relationship string, confidence double, encoding string, byte_offset long, data binary, code string, message string"
)
RECORD = ["record_id", "root_path", "nested_path", "carrier_type", "location", "text", "context", "grp", "field_path", "relationship", "confidence", "encoding", "byte_offset", "page", "mime", "detected_type", "parent_id", "content_sha256"]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in FOUND.split(", "))])
_SIZE, _TEXT, _DATA = (_SCHEMA.get_field_index(n) for n in ("size", "text", "data"))
PARTS = frozenset({"record", "object", "warning"})
_Object = namedtuple("_Object", [c.split()[0] for c in OBJECT.split(", ")])


def files(spark: SparkSession, path: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Objects of all files below a path, and warnings: files over the size limit (which are not read), a missing target, a link.

    A target that is a link of the local file system is not followed.
    """
    warning = lambda code, message: spark.createDataFrame([(code, path, message)], "code string, path string, message string")
    none = spark.createDataFrame([], OBJECT)
    if os.path.islink(path.removeprefix("file://")):
        return none, warning("symlink_skipped", "links are not followed")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return none, warning("target_not_found", "there is no such file or folder")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    small = raw.where(F.col("length") <= limits.max_object_size)
    objects = small.select(F.col("path").alias("root_path"), name.alias("nested_path"), name.alias("name"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_id"), F.col("content").alias("data"))
    large = raw.where(F.col("length") > limits.max_object_size).select(F.lit("object_too_large").alias("code"), F.col("path"), F.lit("file is too large").alias("message"))
    return objects, large


def from_columns(df: DataFrame, root, name, data) -> DataFrame:
    """Objects from columns that hold bytes or text. Rows of small tables are dealt over all cores before ``data`` is made of them."""
    return spread(df).select(root.alias("root_path"), name.alias("nested_path"), name.alias("name"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_id"), data.cast("binary").alias("data"))


def _expand(limits: Limits, disabled: frozenset[str], parts: frozenset[str] = PARTS, deep: bool = False):
    """A pass over objects that gives rows of ``parts``: of one level, with its children, or (``deep``) of all that is nested.

    Depth first only a chain of objects is held at a time. One ``spent`` row for each object with children says how much they hold, which is
    what the limit of expanded size is tested on; beyond it an object isn't followed further.
    """
    tested, none = "record" in parts or "warning" in parts, (None,) * 11

    def rows(o) -> Iterator[tuple]:
        data = o.data or b""
        root, nested, place = o.root_path, o.nested_path, (o.name, o.depth, o.parent_id)
        if o.depth > limits.max_depth or len(data) > limits.max_object_size:
            if "warning" in parts:
                code = "max_depth" if o.depth > limits.max_depth else "object_too_large"
                yield ("warning", root, nested, *place, None, None, None, len(data), *none, code, "object is not read")
            return
        d = detect(data, o.name)
        if d.kind in disabled:
            return
        place += (d.kind, d.mime, d.structural, len(data))
        if "object" in parts:
            yield ("object", root, nested, *place, *none, None, None)
        if not tested and d.kind not in carriers.HOLDERS:
            return
        if "warning" in parts and not d.structural and d.kind in carriers.ARCHIVES:
            yield ("warning", root, nested, *place, *none, "structure_inconsistent", f"no {d.kind} structure")
        for x in carriers.read(data, d.kind, nested, limits):
            if isinstance(x, carriers.Record):
                if x.text and "record" in parts:
                    text = x.text.encode("utf-8", "replace").decode()
                    yield ("record", root, nested, *place, x.kind or d.kind, x.location, text, x.context, x.group or nested, x.field_path, x.relationship, max(0.0, min(1.0, x.confidence)), x.encoding, x.byte_offset, None, None, None)
            elif isinstance(x, carriers.Child):
                yield ("child", root, f"{nested}!/{x.name}", x.name, o.depth + 1, nested, d.kind, d.mime, d.structural, len(x.data), *none[:-1], x.data, None, None)
            elif "warning" in parts:
                yield ("warning", root, x.path, *place, *none, x.code, x.message)

    def walk(o) -> Iterator[tuple]:
        stack, spent, held = [rows(o)], 0, False
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif x[0] != "child":
                yield x
            else:
                held, spent = True, spent + x[_SIZE]
                if spent > limits.max_expanded_size:
                    break
                stack.append(rows(_Object(*x[1:6], x[_DATA])))
        if held:
            yield ("spent", o.root_path, o.nested_path, o.name, o.depth, o.parent_id, None, None, None, spent, *none, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of many objects go into one batch: a batch costs as much as a hundred rows
        held, size = [], 0
        for b in batches:
            for o in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for x in (walk if deep else rows)(_Object(*o)):
                    held.append(x)
                    size += x[_SIZE] if x[0] == "child" else len(x[_TEXT] or "")
                    if size > 8 << 20 or len(held) == 2000:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _written(found: DataFrame) -> DataFrame:
    """``found`` as Parquet in the shared folder, read again: readers take only the columns they need. Deleted when Python ends."""
    spark, at = found.sparkSession, shared_folder(found.sparkSession, "localized")
    atexit.register(_delete, spark, at)
    found.write.parquet(at)
    return spark.read.schema(found.schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone; the folder is then left to its owner
        pass


def _by_levels(objects: DataFrame, limits: Limits, disabled: frozenset[str], parts: frozenset[str]) -> DataFrame:
    """Rows of ``objects`` and what is nested in them, level by level, with the children that each root's expanded size admits."""
    levels, frontier, used = [], objects, None
    for _ in range(limits.max_depth + 2):
        found = frontier.mapInArrow(_expand(limits, disabled, parts), FOUND).withColumn("row", F.monotonically_increasing_id()).checkpoint()
        levels.append(found.where("tag <> 'child'").drop("data", "row"))
        frontier = found.where("tag = 'child'")
        if frontier.isEmpty():
            break
        children = frontier.select("row", "root_path", "nested_path", "size").withColumn("spent", F.sum("size").over(W.partitionBy("root_path").orderBy("nested_path", "row")))
        if used is not None:
            children = children.join(used, "root_path", "left").withColumn("spent", F.col("spent") + F.coalesce("used", F.lit(0))).drop("used")
        children = children.checkpoint()
        beyond = children.where(F.col("spent") > limits.max_expanded_size)
        now = children.where(F.col("spent") <= limits.max_expanded_size).groupBy("root_path").agg(F.max("spent").alias("used"))
        used = now if used is None else used.unionByName(now).groupBy("root_path").agg(F.max("used").alias("used"))
        frontier = frontier.select("row", *_Object._fields)
        if beyond.isEmpty():  # nothing to take out: the contents stay where they are
            frontier = frontier.drop("row")
            continue
        if "warning" in parts:
            levels.append(beyond.select("root_path", "nested_path", F.lit("warning").alias("tag"), F.lit("expanded_size_limit").alias("code"), F.lit("object is not read").alias("message")))
        frontier = frontier.join(beyond.select("row"), "row", "left_anti").select(*_Object._fields)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), levels)


def localize(objects: DataFrame, limits: Limits = Limits(), disabled: frozenset[str] = frozenset(), parts: Collection[str] = PARTS) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(records, objects, warnings) of ``objects`` and everything nested in them, to the depth limit.

    Only ``parts`` (record, object, warning) are made, the others are None. Every archive and document that can hold objects is read in any case,
    as what it holds depends on it; other carriers are read where records or warnings are wanted.
    """
    spark, parts, objects = objects.sparkSession, frozenset(parts), objects.select(*_Object._fields)
    checkpoint_root(spark)
    small_batches(spark)
    found = _written(objects.mapInArrow(_expand(limits, disabled, parts, deep=True), FOUND).drop("data"))
    beyond = found.where("tag = 'spent'").groupBy("root_path").agg(F.sum("size").alias("spent")).where(F.col("spent") > limits.max_expanded_size)
    beyond = beyond.select(F.col("root_path").alias("beyond"))
    if not beyond.isEmpty():  # which children these roots may have depends on the order of all: they are taken level by level
        over = F.col("root_path").eqNullSafe(F.col("beyond"))
        again = _by_levels(objects.join(beyond, over, "left_semi"), limits, disabled, parts)
        found = found.join(beyond, over, "left_anti").unionByName(again, allowMissingColumns=True)
    records = found.where("tag = 'record'").withColumns(
        {
            "record_id": record_id(F.col("root_path"), F.col("nested_path"), F.col("location")),
            "page": F.try_to_number(F.nullif(F.regexp_extract("nested_path", r"(?:rendered-)?page-(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"),
            "detected_type": F.col("kind"),
            "content_sha256": F.sha2("text", 256),
        }
    )
    handlers = F.create_map(*[F.lit(x) for kv in HANDLER_OF.items() for x in kv])
    objects = found.where("tag = 'object'").select("root_path", "nested_path", "name", "depth", "parent_id", "size", F.col("kind").alias("detected_type"), "mime", "structural", F.try_element_at(handlers, F.col("kind")).alias("handler_id"))
    warnings = found.where("tag = 'warning'").select("code", F.col("nested_path").alias("path"), "message")
    return records.select(*RECORD) if "record" in parts else None, objects if "object" in parts else None, warnings if "warning" in parts else None


def record_id(root, nested, location):
    return F.concat(F.lit("R:"), F.substring(F.sha2(F.concat_ws("\0", root, nested, location), 256), 1, 16))


def text_records(df: DataFrame, root, nested, text, by_line: bool = True) -> DataFrame:
    """Records of a text column without leaving the JVM: each text as ``document``, and its lines that aren't blank."""
    base = df.select(root.alias("root_path"), nested.alias("nested_path"), text.alias("_t")).where("_t <> ''")
    whole = base.select("root_path", "nested_path", F.lit("document").alias("location"), F.col("_t").alias("text"), F.lit("").alias("context"))
    if by_line:
        lines = base.select("root_path", "nested_path", F.explode(T.lines(F.col("_t"))).alias("l"))
        lines = lines.select("root_path", "nested_path", F.concat(F.lit("line:"), F.col("l.n").cast("string")).alias("location"), F.col("l.line").alias("text"), F.substring("l.line", 1, 256).alias("context"))
        whole = whole.unionByName(lines)
    null = F.lit(None).cast("string")
    return whole.select(
        record_id(F.col("root_path"), F.col("nested_path"), F.col("location")).alias("record_id"), "root_path", "nested_path", F.lit("text").alias("carrier_type"), "location", "text", "context",
        F.col("nested_path").alias("grp"), null.alias("field_path"), null.alias("relationship"), F.when(F.col("location") == "document", 0.95).otherwise(1.0).alias("confidence"), F.lit("utf-8").alias("encoding"),
        F.lit(None).cast("long").alias("byte_offset"), F.lit(None).cast("int").alias("page"), F.lit("text/plain").alias("mime"), F.lit("text").alias("detected_type"), null.alias("parent_id"), F.sha2("text", 256).alias("content_sha256"),
    )


def cell_records(df: DataFrame, table: str, key, columns: list[str]) -> DataFrame:
    """Records of a table's cells, unpivoted natively: one for each non-null cell of ``columns``, grouped by row."""
    cells = df.select(key.cast("string").alias("_k"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).where("x.v is not null and x.v <> ''")
    location = F.concat_ws(":", F.lit("table"), F.lit(table), F.lit("row"), F.col("_k"), F.lit("column"), F.col("x.c"))
    return cells.select(F.lit(f"mem://{table}").alias("root_path"), F.lit(table).alias("nested_path"), F.lit("sqlite").alias("carrier_type"), location.alias("location"), F.col("x.v").alias("text"), F.col("x.c").alias("context"), F.concat_ws(":", F.lit(table), F.lit("row"), F.col("_k")).alias("grp"), F.col("x.c").alias("field_path"))


def json_leaves(df: DataFrame, key, text) -> DataFrame:
    """key, path, value of the non-null scalars of one level of JSON objects, by VARIANT and without Python; invalid JSON gives none."""
    v = df.select(key.alias("_id"), F.try_parse_json(text).alias("_v")).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    e = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return e.select(F.col("_id").alias("key"), F.concat(F.lit("$."), "key").alias("path"), F.col("value").cast("string").alias("value")).where("value is not null")
