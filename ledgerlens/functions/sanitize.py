"""Prompt-injection cleaning of free-text columns, as column expressions (no UDF).

Per string, in order: strip Unicode format characters (Cf), strip other
control/unassigned characters except newline, tab and carriage return,
redact each injection pattern (in order) to ``[REDACTED:<reason>]``, then
truncate to ``max_length`` characters plus a marker. Each reason is tested on
the text as it stands before that step. The whole text is processed; only the
output is cut at ``max_length`` (that cut is the operator's contract).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (parity with the reference): reasons and patterns, in order.
INJECTION_PATTERNS = [
    ("instruction_override",
     r"(?i)\b(ignore|disregard|forget|override)\s+(prior|previous|all|earlier|the)\s+(instruction|rule|prompt|message|context)"),
    ("role_prefix", r"(?i)^\s*(system|assistant|user)\s*:"),
    ("role_redefinition", r"(?i)\byou\s+are\s+(now|a|an)\b"),
    ("biased_output_directive",
     r"(?i)\b(write|generate|produce|output)\s+a\s+(glowing|positive|favourable|favorable|good|perfect)\s+report"),
    ("prompt_exfiltration", r"(?i)\b(reveal|show|print|output|leak|expose)\s+(your\s+)?(system\s+)?(prompt|instruction|rule)"),
    ("fake_xml_tag", r"<\s*/?\s*(system|instruction|prompt|tool[_-]?use|client[_-]?data)\s*>"),
    ("fake_code_block", r"(?i)```\s*system"),
    ("template_injection", r"\{\{[^}]+\}\}"),
    ("polite_override", r"(?i)\bplease\s+(disregard|ignore)\b"),
]
# The engine's own \s is ASCII only; a no-break space must not hide an injection.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
INJECTION_PATTERNS = [(reason, pattern.replace(r"\s", SPACE)) for reason, pattern in INJECTION_PATTERNS]
MAX_FIELD_LENGTH = 256
TRUNCATION_MARKER = "[…TRUNCATED]"
FORMAT_CHARS = r"\p{Cf}"
CONTROL_CHARS = r"[^\P{C}\n\t\r]"   # any C* character except \n \t \r


def _scoped(pat: str) -> str:
    """A pattern as a group with its own flags, so all patterns can share one alternation."""
    if pat.startswith("(?i)"):
        return "(?i:" + pat[4:] + ")"
    return "(?:" + pat + ")"


# One pass that tells whether any injection pattern can fire (most texts: none). Replacements never
# create a new match (no spaces, braces or angle brackets in them), so a text that fails this test
# needs no further pattern pass.
ANY_INJECTION = "|".join(_scoped(p) for _, p in INJECTION_PATTERNS)


def _redacted(text: Column) -> Column:
    """STRUCT<text, reasons> of a text that some pattern matches: a fold over the patterns, in order.

    Each pattern written out as a step of one projection grows beyond what the engine compiles, and then every text of the stage
    runs interpreted. The fold is one small expression, and it is evaluated for matching texts only.
    """
    steps = F.array(*[F.struct(F.lit(reason).alias("reason"), F.lit(pattern).alias("pattern")) for reason, pattern in INJECTION_PATTERNS])
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("reasons"))

    def step(acc: Column, s: Column) -> Column:
        found = F.rlike(acc["text"], s["pattern"])
        return F.struct(F.when(found, F.regexp_replace(acc["text"], s["pattern"], F.concat(F.lit("[REDACTED:"), s["reason"], F.lit("]")))).otherwise(acc["text"]).alias("text"),
                        F.when(found, F.array_append(acc["reasons"], s["reason"])).otherwise(acc["reasons"]).alias("reasons"))

    return F.aggregate(steps, start, step)


def _cut(text: Column, max_length: int) -> tuple[Column, Column]:
    truncated = F.length(text) > max_length
    return F.when(truncated, F.concat(F.substring(text, 1, max_length), F.lit(TRUNCATION_MARKER))).otherwise(text), truncated


def sanitize(text: Column, max_length: int = MAX_FIELD_LENGTH) -> Column:
    """STRUCT<clean STRING, reasons ARRAY<STRING>, truncated BOOLEAN> (column form, for short strings)."""
    v0 = F.coalesce(text, F.lit(""))
    v1 = F.regexp_replace(v0, FORMAT_CHARS, "")
    v2 = F.regexp_replace(v1, CONTROL_CHARS, "")
    none = F.array().cast("array<string>")
    done = F.when(v2.rlike(ANY_INJECTION), _redacted(v2)).otherwise(F.struct(v2.alias("text"), none.alias("reasons")))
    clean, truncated = _cut(done["text"], max_length)
    stripped = F.array_compact(F.array(F.when(v1 != v0, F.lit("unicode_format_char")), F.when(v2 != v1, F.lit("control_char"))))
    return F.struct(clean.alias("clean"), F.concat(stripped, done["reasons"]).alias("reasons"), truncated.alias("truncated"))


def sanitize_frame(df: DataFrame, col: str, max_length: int = MAX_FIELD_LENGTH) -> DataFrame:
    """Add ``clean``, ``reasons`` and ``truncated`` for a large text column.

    Each step is its own projection and reads the previous step's columns (Spark does not inline an expensive expression that is read
    twice). Texts that fail the combined pattern test carry NULL past the patterns, so they cost no further regex pass.
    """
    d = df.withColumn("_v0", F.coalesce(F.col(col), F.lit("")))
    d = d.withColumn("_v1", F.regexp_replace("_v0", FORMAT_CHARS, ""))
    d = d.withColumn("_v2", F.regexp_replace("_v1", CONTROL_CHARS, ""))
    d = d.withColumn("_w", F.when(F.col("_v2").rlike(ANY_INJECTION), _redacted(F.col("_v2"))))
    d = d.withColumn("_fin", F.coalesce("_w.text", "_v2"))
    stripped = F.array_compact(F.array(F.when(F.col("_v1") != F.col("_v0"), F.lit("unicode_format_char")), F.when(F.col("_v2") != F.col("_v1"), F.lit("control_char"))))
    clean, truncated = _cut(F.col("_fin"), max_length)
    d = d.withColumns({"reasons": F.concat(stripped, F.coalesce("_w.reasons", F.array().cast("array<string>"))), "truncated": truncated, "clean": clean})
    return d.drop("_v0", "_v1", "_v2", "_w", "_fin")


def sanitize_columns(df: DataFrame, cols: list[str], max_length: int = MAX_FIELD_LENGTH) -> DataFrame:
    """Replace each text column by its cleaned value and add ``<col>_reasons``."""
    out = df
    for c in cols:
        s = sanitize(F.col(c), max_length)
        out = out.withColumn(f"_{c}", s).withColumn(c, F.col(f"_{c}.clean")) \
            .withColumn(f"{c}_reasons", F.col(f"_{c}.reasons")).drop(f"_{c}")
    return out


def pseudonym(name: Column, salt: str, prefix: str = "p_") -> Column:
    """Stable salted pseudonym for a name (the mapping table stays inside)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 12))
