"""Number tokens in prose (currency, thousands separators, k/M/B scale, percent)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space by Unicode, spelled out: the engine's own \s is ASCII only.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
# Fixed pattern (parity with the reference): optional currency, 1-3 digits with
# comma groups and decimals, optional scale letter, optional percent sign.
NUMBER_PATTERN = r"([€$£])?(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?)([kKmMbB])?" + SPACE + r"*(%)?"
# strict=True: plain digit runs and a word boundary after the scale letter.
STRICT_PATTERN = r"([€$£])?(-?\d+(?:,\d{3})*(?:\.\d+)?)(?:([kKmMbB])\b)?" + SPACE + r"*(%)?"


def _scale(letter: Column) -> Column:
    lower = F.lower(letter)
    return (F.when(lower == "k", F.lit(1e3)).when(lower == "m", F.lit(1e6))
            .when(lower == "b", F.lit(1e9)).otherwise(F.lit(1.0)))


def number_tokens(text: Column, strict: bool = False) -> Column:
    """ARRAY<STRUCT<pos INT, raw STRING, value DOUBLE, is_pct BOOLEAN>> in text order."""
    pat = STRICT_PATTERN if strict else NUMBER_PATTERN
    matches = F.regexp_extract_all(text, F.lit(pat), 0)

    def parse(m: Column, i: Column) -> Column:
        raw_val = F.regexp_extract(m, pat, 2)
        value = F.regexp_replace(raw_val, ",", "").cast("double") * _scale(F.regexp_extract(m, pat, 3))
        return F.struct((i + 1).alias("pos"), F.trim(m).alias("raw"), value.alias("value"),
                        (F.regexp_extract(m, pat, 4) == "%").alias("is_pct"))

    return F.transform(matches, parse)
