"""Scalar column expressions: directions, labels, sentences, value formats, slugs, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (parity with the reference).
FLAT_BAND_PCT = 3.0
RATIO_NAME_PATTERN = r"(?i)(%|pct|percent|rate|ratio|margin|share|coverage|conversion)"
ROUND_TEXTS = ("0.0", "100.0", "1000.0", "10000.0")
MONEY_WORDS = ("revenue", "sales", "cost", "margin", "profit", "amount")
PCT_WORDS = ("pct", "rate")
SLUG_BREAKS = r"[\s\-/\\]+"


def direction_from_pct(pct: Column, flat_band: float = FLAT_BAND_PCT) -> Column:
    """'flat' inside the band, else 'up'/'down' by sign."""
    return (F.when(F.abs(pct) < flat_band, F.lit("flat"))
            .when(pct > 0, F.lit("up")).otherwise(F.lit("down")))


def fixed(x: Column, digits: int = 1, plus: bool = False) -> Column:
    """The double with so many decimals, from its exact binary value: 0.35 is a little less than that and gives ``0.3``, exact halves go to
    the even digit, and the sign is that of the value before rounding (``-0.0`` for -0.04). ``plus`` writes it for positive values too.

    The product with 10**digits is taken in two parts, whose sum is exact. Values from 1e15 on are left to the formatter.
    """
    a, factor = F.abs(x), float(10 ** digits)
    high = a * 134217729.0 - (a * 134217729.0 - a)  # the upper 26 bits
    scaled = a * factor
    rest = (high * factor - scaled) + (a - high) * factor
    whole = F.floor(scaled)
    over = scaled - whole
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    text = F.concat(F.floor(n / 10 ** digits).cast("string"), F.lit("."), F.lpad((n % 10 ** digits).cast("string"), digits, "0")) if digits else n.cast("string")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("+" if plus else "")
    return F.when(a < 1e15, F.concat(sign, text)).otherwise(F.format_string(f"%{'+' if plus else ''}.{digits}f", x))


def kpi_label(kpi: Column) -> Column:
    """``total_revenue`` -> ``Total Revenue``."""
    return F.initcap(F.regexp_replace(kpi, "_", " "))


def finding_sentence(kpi_id: Column, direction: Column, magnitude: Column, context: Column,
                     label: Column | None = None) -> Column:
    """'<Label> rose 5.6% (context)'; 'was stable' for flat findings."""
    lab = label if label is not None else kpi_label(kpi_id)
    verb = F.when(direction == "up", F.lit("rose")).when(direction == "down", F.lit("fell")) \
        .otherwise(F.lit("was stable"))
    mag = F.when(direction == "flat", F.lit("")).otherwise(
        F.concat(F.lit(" "), F.format_string("%.1f", magnitude), F.lit("%")))
    ctx = F.when(F.coalesce(context, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" ("), context, F.lit(")")))
    return F.concat(lab, F.lit(" "), verb, mag, ctx)


# The wording of a root-cause paragraph.
UNVERIFIED = "Possible contributing factors (unverified from data): "
NO_CAUSE = "[No causal claims could be grounded in the data.]"


def root_cause_prose(rca: Column) -> Column:
    """Claims with their evidence, then the factors that nothing supports; null or empty lists say nothing."""
    claims = F.transform(rca["claims"], lambda c: F.concat(c["claim"], F.lit(" ("), c["evidence_kpi"], F.lit(": "), c["evidence_value"], F.lit(")")))
    factors = F.nullif(F.array_join(rca["unsupported_factors"], "; "), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" ", claims, F.concat(F.lit(UNVERIFIED), factors)), F.lit("")), F.lit(NO_CAUSE))


def _name_has(name: Column, words) -> Column:
    e = F.lit(False)
    for w in words:
        e = e | F.lower(name).contains(w)
    return e


def card_value(kpi: Column, value: Column) -> Column:
    """KPI card: € with thousands for money names, '%' for rates, else thousands."""
    return (F.when(_name_has(kpi, MONEY_WORDS), F.concat(F.lit("€"), F.format_number(value, 0)))
            .when(_name_has(kpi, PCT_WORDS), F.concat(fixed(value), F.lit("%")))
            .otherwise(F.format_number(value, 0)))


def arrow(pct: Column, flat_band: float = FLAT_BAND_PCT) -> Column:
    d = direction_from_pct(pct, flat_band)
    return F.when(d == "up", F.lit("▲")).when(d == "down", F.lit("▼")).otherwise(F.lit("►"))


def slug(text: Column) -> Column:
    """Column-name slug: lower-case words of the text, split at space, ``-``, ``/`` and ``\\``, joined by ``_``; '' -> 'col'."""
    words = F.transform(F.split(F.lower(text), SLUG_BREAKS), lambda w: F.regexp_replace(w, r"(?U)\W", ""))
    words = F.filter(F.split(F.array_join(words, "_"), "_"), lambda w: w != "")
    return F.coalesce(F.nullif(F.array_join(words, "_"), F.lit("")), F.lit("col"))


def client_slug(name: Column) -> Column:
    """Path-safe client slug (never a key: two names may share one)."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def sha16(text: Column) -> Column:
    """First 16 hex digits of SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def is_ratio_name(name: Column) -> Column:
    return name.rlike(RATIO_NAME_PATTERN)


def is_round_number(v: Column) -> Column:
    """One-decimal text of |v| is 0.0, 100.0, 1000.0 or 10000.0."""
    return fixed(F.abs(v)).isin(*ROUND_TEXTS)
