"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix and written with sentinels.

A text is a sequence of units: a run of non-space characters with the white space before it, or white space that ends the
text. ``regexp_count`` gives their number n. Hashes of the row's key give the two cuts and the form, so that a row is
always formatted alike. The cuts become counted quantifiers of a pattern of the row's own: ``unit{a}`` and
``unit{b-a}``, both possessive, and the rest. One match captures prefix, middle and suffix, and its replacement
writes them with their sentinels. Possessive groups are matched in a loop, with neither recursion nor steps back, so that texts of any
length are safe. Everything is a Spark expression; rows do not move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A unit. No match steps back into an earlier one.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
ADDED = ["n", "form", "output", "prefix_chars", "middle_chars", "suffix_chars"]


@dataclass(frozen=True)
class Sentinels:
    """Three marks; none may be part of another or begin as another ends, or contain ``$`` or a backslash."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        for a in marks:
            if not a or "$" in a or "\\" in a:
                raise ValueError(f"not a sentinel: {a!r}")
            for b in marks:
                if (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"sentinels overlap: {a!r} {b!r}")


def _draw(key: Column, seed: int, i: int) -> Column:
    """The i-th group of 8 hex digits of the key's hash, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 8 * i + 1, 8), 16, 10).cast("long")


def units(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(UNIT)).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80,
              marks: Sentinels = Sentinels()) -> DataFrame:
    """The rows of ``docs`` with ``n`` (units), ``form``, ``output``, and the code points of the three parts (null if plain).

    ``form`` is ``plain`` (the text as it is) for empty texts, texts that contain a sentinel, and ``100 - rate`` of 100 keys; of the
    others ``spm_rate`` of 100 are ``spm`` (suffix, prefix, middle), the rest ``psm``. The cuts are the smaller and the larger of two
    draws from 0 to n, so that each part may be empty. Null texts count as empty; null ids draw like the empty string;
    repeated rows are formatted alike. Columns named like the added ones are replaced. An empty table gives no rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in [*ADDED, "_text", "_a", "_b"]]
    text = text_or_empty(F.col(text_col))
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.contains(text, F.lit(m))
    form = (F.when((F.length(text) == 0) | marked | (_draw(key, seed, 2) % 100 >= rate), "plain")
            .when(_draw(key, seed, 3) % 100 < spm_rate, "spm").otherwise("psm"))
    cuts = [_draw(key, seed, i) % (F.col("n") + 1) for i in (0, 1)]
    rows = docs.select(*kept, text.alias("_text"), units(text).alias("n"), form.alias("form")).withColumns({"_a": F.least(*cuts), "_b": F.greatest(*cuts)})
    pattern = F.concat(F.lit(rf"(?s)\A((?:{UNIT}){{"), F.col("_a"), F.lit(rf"}}+)((?:{UNIT}){{"), F.col("_b") - F.col("_a"), F.lit("}+)(.*+)"))
    written = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, F.when(F.col("form") == "spm", f"{marks.suffix}$3{marks.prefix}$1{marks.middle}$2")
                                                                                       .otherwise(f"{marks.prefix}$1{marks.suffix}$3{marks.middle}$2")))
    rows = rows.withColumn("output", written)
    at = {name: F.locate(mark, F.col("output")) for name, mark in (("p", marks.prefix), ("s", marks.suffix), ("m", marks.middle))}
    ends = {"p": F.when(F.col("form") == "spm", at["m"]).otherwise(at["s"]), "s": F.when(F.col("form") == "spm", at["p"]).otherwise(at["m"]),
            "m": F.length("output") + 1}
    size = {k: F.when(F.col("form") != "plain", (ends[k] - at[k] - len(mark)).cast("long"))
            for k, mark in (("p", marks.prefix), ("s", marks.suffix), ("m", marks.middle))}
    return rows.select(*kept, "n", "form", "output", size["p"].alias("prefix_chars"), size["m"].alias("middle_chars"), size["s"].alias("suffix_chars"))


def restore(output: str | Column, form: str | Column, marks: Sentinels = Sentinels()) -> Column:
    """The exact text, rebuilt from output and form alone."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks.prefix, marks.suffix, marks.middle
    quoted = {k: rf"\Q{k}\E" for k in (p, s, m)}
    return (F.when(form == "psm", F.regexp_replace(out, rf"(?s)\A{quoted[p]}(.*?){quoted[s]}(.*?){quoted[m]}(.*+)", "$1$3$2"))
            .when(form == "spm", F.regexp_replace(out, rf"(?s)\A{quoted[s]}(.*?){quoted[p]}(.*?){quoted[m]}(.*+)", "$2$3$1")).otherwise(out))
