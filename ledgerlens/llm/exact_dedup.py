"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical after every run of white space is replaced by one space. Rows are
grouped by length, then by a hash of a prefix, and only rows that still share both are hashed in full.

* A scan counts the rows of each normalised length. Lengths that occur once drop out.
* The next scan hashes the prefixes of rows whose length repeats. (length, prefix) pairs that occur once drop out.
* The next one hashes in full, with SHA-256, the texts of rows whose pair repeats. Hashes are grouped; of each group one row stays.

Counts are combined before the shuffle, so that a group of any size is one row a task. Only lengths, hashes, ids and row names move, texts
never do. What a scan must know of the one before is told to its tasks if it is small; if it is not, the scan hashes all its rows, which
gives the same groups. Tables of keys are written before each join, so that both sides of it are plain exchanges: then the
engine splits the rows of a hot key over many tasks at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_LIMIT_BYTES, estimated_bytes
from .common import SPACE_CLASS, materialise_table, numbered, text_or_empty, without


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), f"{SPACE_CLASS}+", " ")


def _repeated(keyed: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row."""
    return keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def repeated_lengths(keyed: DataFrame) -> DataFrame:
    return _repeated(keyed, "length")


def repeated_prefixes(keyed: DataFrame) -> DataFrame:
    """(length, prefix) of more than one row, where there is a prefix."""
    return _repeated(keyed.where("prefix is not null"), "length", "prefix")


def _among(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` with ``again``: whether its key is one of ``keys``; true everywhere if these are too many to be told to all tasks."""
    if estimated_bytes(keys) > BROADCAST_LIMIT_BYTES:
        return keyed.withColumn("again", F.lit(True))
    known = F.broadcast(keys.withColumn("again", F.lit(True)))
    return keyed.join(known, keys.columns, "left").withColumn("again", F.coalesce("again", F.lit(False)))


def prefixed(keyed: DataFrame, lengths: DataFrame, prefix: int) -> DataFrame:
    """``keyed`` with the hash of its prefix; null, and not computed, where the length is not among ``lengths``."""
    return _among(keyed, materialise_table(lengths)).withColumn("prefix", F.when(F.col("again"), F.xxhash64(F.substring("norm", 1, prefix)))).drop("again")


def _hashed(rows: DataFrame, prefix: int, digest_all: bool) -> DataFrame:
    """``rows`` (rec, id, row, norm) with ``again`` and ``full_hash``, without the text; written."""
    keyed = rows.withColumn("length", F.length("norm"))
    keyed = prefixed(keyed, repeated_lengths(keyed), prefix)
    keyed = _among(keyed, materialise_table(repeated_prefixes(keyed)))
    digest = F.sha2("norm", 256)
    return materialise_table(keyed.select("rec", "id", "row", "again", (digest if digest_all else F.when(F.col("again"), digest)).alias("full_hash")))


def _groups(flagged: DataFrame) -> DataFrame:
    """Of each full hash the first (none, id, row) and the number of rows."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    return materialise_table(flagged.where("again").groupBy("full_hash").agg(F.min(order).alias("first"), F.count("*").alias("group_size")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None,
                     prefix: int = 256, digest_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``rec`` (struct of ``columns``; default: the id), ``keep_id``,
    ``group_size``, ``kept`` and ``full_hash`` (SHA-256 of the normalised text in lowercase hex).

    ``full_hash`` is null for texts that no other row has, unless ``digest_all``. Of equal texts the row with the smallest id is kept;
    exactly one row, also where the id repeats (any of these) or is null (null ids come last, and ``keep_id`` is null if the kept
    row's is). A null text counts as empty. Columns keep their names inside ``rec`` and so cannot clash. An empty table gives no rows.
    """
    rec = F.struct(*[docs[c] for c in columns or [id_col]]).alias("rec")
    rows = numbered(docs.select(rec, docs[id_col].alias("id"), docs[text_col].alias("text")))
    flagged = _hashed(rows.select("rec.rec", "rec.id", "row", normalised(F.col("rec.text")).alias("norm")), prefix, digest_all)
    single = flagged.where("not again").select("rec", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                               F.lit(True).alias("kept"), "full_hash")
    shown = F.col("full_hash") if digest_all else F.when(F.col("group_size") > 1, F.col("full_hash"))
    shared = flagged.where("again").join(_groups(flagged), "full_hash").select(
        "rec", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), shown.alias("full_hash"))
    return single.union(shared)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, with its columns, whatever their names. The rows that go are taken out by name."""
    rows = numbered(docs)
    rec = F.col("rec")
    flagged = _hashed(rows.select(F.lit(0).alias("rec"), rec[id_col].alias("id"), "row", normalised(rec[text_col]).alias("norm")), 256, False)
    gone = flagged.where("again").join(_groups(flagged), "full_hash").where("row <> first.row")
    return without(rows, gone)
