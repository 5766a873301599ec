"""Cleaning of nested JSON payloads: every key and every text, at any depth, with the path of each redaction.

A payload is parsed to a VARIANT and walked level by level: a node is a row (payload, position, path, key, value), its position the
array of child numbers that leads to it. Keys and texts are cleaned as columns, all of a level at once. The JSON is put together from
all nodes of a payload in one aggregate: an opening sign sorts before the children, the closing one behind them. The number
of jobs is that of the deepest payload's levels; rows are dealt by payload once.

Names of an object come in the order of their code points before cleaning. Names of one object that clean to the same name are one name, with
the value of the last of them; the others are dropped with all they hold, but what was redacted in them is reported all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sanitize import MAX_FIELD_LENGTH, sanitize_frame
from ..session import ensure_checkpoint_dir

# Fixed value: so much of a name is quoted in its redaction.
SHOWN = 30
UNREADABLE = "unreadable payload"
_LAST = (1 << 31) - 1


def _literal(text: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _note(path: Column, reasons: Column) -> Column:
    return F.concat(path, F.lit(": "), F.array_join(reasons, ","))


def _cleaned(df: DataFrame, col: str, max_length: int) -> DataFrame:
    """``col`` cleaned, with ``_reasons`` and ``_changed``; null stays null."""
    d = sanitize_frame(df.withColumn("_raw", F.col(col)), "_raw", max_length)
    null = F.col("_raw").isNull()
    return (d.withColumns({col: F.when(~null, F.col("clean")), "_changed": ~null & ((F.size("reasons") > 0) | F.col("truncated"))})
            .withColumnRenamed("reasons", "_reasons").drop("clean", "truncated"))


def _children(nodes: DataFrame) -> DataFrame:
    """The children of object and array nodes: (payload, parent, up, gone, pos, key, value)."""
    spark = nodes.sparkSession
    held = nodes.select("payload", "pos", "path", "lost", "value")
    return spark.sql("SELECT payload, h.pos AS parent, h.path AS up, h.lost AS gone, array_append(h.pos, c.pos) AS pos, c.key AS key, c.value AS value FROM {held} h, LATERAL variant_explode(h.value) c", held=held)


def _described(nodes: DataFrame) -> DataFrame:
    """``nodes`` with kind (object, array, text, other)."""
    shape = F.schema_of_variant("value")
    return nodes.withColumn("kind", F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "text").otherwise("other"))


def clean_payloads(df: DataFrame, json_col: str, max_length: int = MAX_FIELD_LENGTH) -> DataFrame:
    """``df`` with ``clean_json`` and ``redactions`` (array of ``path: reasons``, in the order of the payload).

    A path is made of cleaned names and list places (``a.b[3]``); a name's own redaction is ``path.<key:name>: reasons``. What
    is no JSON gives a null ``clean_json`` and one redaction that says so; a null stays null without one. Columns of ``df`` keep their
    names inside a struct while the payloads are walked, and repeated rows are walked one by one. An empty table gives no rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("rec"), F.col(json_col).alias("json"), F.monotonically_increasing_id().alias("payload")).checkpoint()
    roots = base.select("payload", F.try_parse_json("json").alias("value")).where("value IS NOT NULL")
    level = _described(roots.select("payload", F.array().cast("array<int>").alias("parent"), F.array().cast("array<int>").alias("pos"), F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), "value"))
    level = _texts(level.withColumns({"notes": F.array().cast("array<string>"), "first": F.lit(True), "lost": F.lit(False)}), max_length)
    tokens, notes = [], []
    level = _kept(level, tokens, notes)
    while level is not None:
        below = _children(level).repartition("payload")
        below = _cleaned(below, "key", max_length)
        quoted = F.concat(F.when(F.col("up") != "", F.concat("up", F.lit("."))).otherwise(""), F.lit("<key:"), F.substring("_raw", 1, SHOWN), F.lit(">"))
        below = below.withColumn("notes", F.when(F.col("_changed"), F.array(_note(quoted, F.col("_reasons")))).otherwise(F.array().cast("array<string>")))
        twins = Window.partitionBy("payload", "parent", "key")
        below = below.withColumn("lost", F.col("gone") | (F.col("key").isNotNull() & (F.col("pos") < F.max("pos").over(twins))))
        path = F.when(F.col("key").isNull(), F.concat("up", F.lit("["), F.element_at("pos", -1).cast("string"), F.lit("]"))).otherwise(F.concat_ws(".", F.nullif("up", F.lit("")), "key"))
        below = below.withColumn("path", path)
        family = Window.partitionBy("payload", "parent")
        below = below.withColumn("first", F.col("pos") == F.min(F.when(~F.col("lost"), F.col("pos"))).over(family))
        below = below.select("payload", "parent", "pos", "path", "key", "value", "notes", F.coalesce("first", F.lit(False)).alias("first"), "lost")
        level = _kept(_texts(_described(below), max_length), tokens, notes)
    out = tokens[0]
    for t in tokens[1:]:
        out = out.unionByName(t)
    made = out.groupBy("payload").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("clean_json"))
    told = notes[0]
    for n in notes[1:]:
        told = told.unionByName(n)
    told = told.groupBy("payload").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "notes"))), lambda x: x["notes"])).alias("redactions"))
    j = base.join(made, "payload", "left").join(told, "payload", "left")
    unreadable = F.col("json").isNotNull() & F.col("clean_json").isNull()
    return j.select("rec.*", "clean_json", F.when(unreadable, F.array(F.lit(UNREADABLE))).otherwise(F.coalesce("redactions", F.array().cast("array<string>"))).alias("redactions"))


def _texts(nodes: DataFrame, max_length: int) -> DataFrame:
    """``nodes`` with their texts cleaned (``text``) and noted."""
    d = _cleaned(nodes.withColumn("text", F.when(F.col("kind") == "text", F.try_variant_get("value", "$", "string"))), "text", max_length)
    return d.withColumn("notes", F.when(F.col("_changed"), F.array_append("notes", _note(F.col("path"), F.col("_reasons")))).otherwise(F.col("notes"))).drop("_raw", "_reasons", "_changed")


def _kept(nodes: DataFrame, tokens: list[DataFrame], notes: list[DataFrame]) -> DataFrame | None:
    """Write a level; add its tokens and notes; None if it holds no object and no array."""
    nodes = nodes.checkpoint()
    lead = F.concat(F.when(F.col("first"), "").otherwise(","), F.when(F.col("key").isNull(), "").otherwise(F.concat(_literal(F.col("key")), F.lit(":"))))
    body = F.when(F.col("kind") == "object", "{").when(F.col("kind") == "array", "[").when(F.col("kind") == "text", _literal(F.col("text"))).otherwise(F.to_json("value"))
    tokens.append(nodes.where(~F.col("lost")).select("payload", "pos", F.concat(lead, body).alias("token")))
    notes.append(nodes.where(F.size("notes") > 0).select("payload", "pos", "notes"))
    held = nodes.where(F.col("kind").isin("object", "array"))
    if held.isEmpty():
        return None
    tokens.append(held.where(~F.col("lost")).select("payload", F.array_append("pos", F.lit(_LAST)).alias("pos"), F.when(F.col("kind") == "object", "}").otherwise("]").alias("token")))
    return held
