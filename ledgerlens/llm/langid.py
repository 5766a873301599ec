"""Language identification by compression.

Each language has a dictionary: text of a bounded sample of its labelled rows. A text is encoded with zstandard once per
language, with that language's dictionary as raw content, and the language whose dictionary makes it smallest wins. If
the runner-up needs hardly more bytes, the text is not accepted.

Whole texts are encoded, in blocks of ``BLOCK`` bytes, so that the dictionary and not the text's own beginning is what a
long text is measured against. The first block follows a piece of the dictionary itself: alone, a few words would be
stored as they are in every language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL, BLOCK, LEAD = 5, 1024, 400
#: So many times the sample is ranked for each language.
OVERSAMPLE = 8
#: Texts that are learnt from, over all languages; with more languages than that, learning is an error.
SAMPLE = 8192
UNKNOWN = "und"
PREDICTION = "struct<lang_pred:string,score:double,accepted:boolean>"


def _plain(text: str) -> str:
    return " " + text.lower()


def dictionary(samples: list[str], size: int, shared: set[str] | None = None) -> bytes:
    """The samples' lines as one dictionary, each once. Lines in ``shared`` (licences, mottos) say nothing and are left out;
    by default these are the lines that several samples have."""
    lines = [dict.fromkeys(s.split("\n")) for s in samples]
    if shared is None:
        seen = Counter(x for own in lines for x in own)
        shared = {x for x, n in seen.items() if n > 1}
    return "\n".join(_plain(x) for x in dict.fromkeys(x for own in lines for x in own) if x not in shared).encode()[:size]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 128, chars: int = 1024,
          max_languages: int | None = None) -> dict[str, bytes]:
    """A dictionary for each language, the most frequent first; only for the first ``max_languages``, if that is given.

    The sample is bounded: ``per_language`` different texts of each language (those with the smallest hash), fewer if all
    languages together would have more than ``SAMPLE``, and ``chars`` characters from the middle of each text. More than
    ``SAMPLE`` languages raise ValueError: so many values are no languages. Of equal texts one is learnt from, and of equal
    lines of a language one; lines that several languages have are left out. Rows with a null text, language or id are not
    learnt from. No rows give no dictionaries.
    """
    rows = (labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
            .withColumn("hash", F.xxhash64("text")))
    counts = (rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("hash").alias("texts"))
              .orderBy(F.desc("count"), "lang").limit(SAMPLE + 1 if max_languages is None else max_languages).collect())
    langs = [r["lang"] for r in counts]
    if len(langs) > SAMPLE:
        raise ValueError(f"{lang_col} has more than {SAMPLE} different values")
    if not langs:
        return {}
    per_language = min(per_language, SAMPLE // len(langs))
    # only texts whose hash lies so low that a few times the sample is left are ranked, however many a language has
    below = labelled.sparkSession.createDataFrame([(r["lang"], max(1, min(1 << 40, OVERSAMPLE * per_language * (1 << 40) // max(1, r["texts"])))) for r in counts], "lang string, below long")
    first = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 40)), "hash")
    picked = (rows.join(F.broadcast(below), "lang").where(F.pmod("hash", F.lit(1 << 40)) < F.col("below")).groupBy("lang", "hash").agg(F.min("id").alias("id"))
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("lang", "hash", "id"))
    part = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2).cast("int") + 1), F.lit(chars))
    # at most SAMPLE rows on this side, and in what is collected
    texts = rows.join(F.broadcast(picked), ["lang", "hash", "id"]).groupBy("lang", "hash").agg(F.min(part).alias("part")).orderBy("lang", "hash").collect()
    samples: dict[str, list[str]] = {lang: [] for lang in langs}
    for r in texts:
        samples[r["lang"]].append(r["part"])
    seen = Counter(x for own in samples.values() for x in {line for s in own for line in s.split("\n")})
    shared = {x for x, n in seen.items() if n > 1}
    return {lang: dictionary(own, per_language * chars, shared) for lang, own in samples.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], min_margin: float):
        self.min_margin, self.langs = min_margin, []
        for lang, content in dictionaries.items():
            # zstandard takes at least eight bytes of content
            data = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)
            lead = content[-LEAD:]
            self.langs.append((lang, coder, lead, len(coder.compress(lead))))

    def sizes(self, text: str) -> list[int]:
        """Bytes that the text takes with each language's dictionary."""
        data = _plain(text).encode()
        head, rest = data[:BLOCK], [data[i:i + BLOCK] for i in range(BLOCK, len(data), BLOCK)]
        return [max(1, len(coder.compress(lead + head)) - led + sum(len(coder.compress(b)) for b in rest)) for _, coder, lead, led in self.langs]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, margin, accepted). The margin is the share of bytes saved against the runner-up; ties go to the more
        frequent language and have none. Null texts, and texts without a letter, are unknown and not accepted."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1:]
        margin = 1 - sizes[best] / min(others) if others else 1.0
        return self.langs[best][0], margin, margin >= self.min_margin


def predict_column(text: str | Column, dictionaries: dict[str, bytes], min_margin: float = 0.005) -> Column:
    """struct of lang_pred, score (the margin, 0 to 1) and accepted (see Classifier.predict). The dictionaries are bounded
    (see ``learn``) and travel with the function. Margins below ``min_margin`` are narrow: one byte in 200."""

    @F.arrow_udf(PREDICTION)
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(dictionaries, min_margin)
        for texts in parts:
            lang, score, accepted = zip(*(classifier.predict(t.as_py()) for t in texts)) if len(texts) else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["lang_pred", "score", "accepted"])

    return predict(F.col(text) if isinstance(text, str) else text)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = 0.005) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with its columns; learnt from the rows that have a language."""
    dictionaries = learn(docs, id_col, text_col, lang_col)
    return docs.where(predict_column(docs[text_col], dictionaries, min_margin)["accepted"])
