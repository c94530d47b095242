"""Language ID by compression: the language whose dictionary compresses a text best.

Learning takes, per language, a bounded sample of labelled texts, whole, as a raw-content
zstandard dictionary. A prediction compresses the letters of the whole text, in blocks of fixed
size, once with each dictionary, and chooses the smallest total; it is rejected where the
margin to the second is narrow. Languages, sources and ids are never inputs of it.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and are
rejected; ties go to the smallest language name, with score 0; without any labelled
text every row is ``und``; with a single language it wins with score 1. Repeated rows
stay repeated, and equal texts count once in the sample. Very long texts are compressed
block by block. An empty table gives an empty result. Columns to keep may have any names
but those of the results, which are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from desense.llm.common import refuse_clashes, text_slices

UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower case, with one blank for each run of anything but letters: shouting, symbols
    and layout say nothing of a language."""
    return _NO_LETTERS.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """One raw-content dictionary for each language."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)


def fit_language_model(labelled: DataFrame, sample_texts: int = 64, shares: int = 16) -> LanguageModel:
    """Learn from rows (text, lang).

    The bound of the sample is ``sample_texts`` different texts a language, whole: those
    with the smallest text hashes, the same at any partitioning. Hashes are chosen first,
    within ``shares`` shares of each language and then among what these leave, so no task
    gets a whole language, and only chosen texts are moved.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    hashes = rows.select("lang", "h").distinct().withColumn("share", F.pmod("h", F.lit(shares)))
    for group in (["lang", "share"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("h"))
        hashes = hashes.withColumn("place", place).where(F.col("place") <= sample_texts)
    sample = rows.join(F.broadcast(hashes.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts: dict[str, list] = {}
    for lang, h, text in sample.collect():
        texts.setdefault(lang, []).append((h, text))
    return LanguageModel({lang: " ".join(letters_only(t) for _, t in sorted(found)).encode("utf-8", "surrogatepass") for lang, found in sorted(texts.items())})


def predict_language(
    docs: DataFrame, model: LanguageModel, keep: list[str], margin: float = 0.005, block: int = 2048, level: int = 6,
    accepted_only: bool = False,
) -> DataFrame:
    """Rows of ``docs`` as ``keep`` columns plus lang_pred, score, rejected; or, with
    ``accepted_only``, the ``keep`` columns of the rows that are not rejected.

    ``score`` is 1 - smallest / second-smallest compressed size; below ``margin`` the
    prediction is rejected (it is still named).
    """
    if not accepted_only:
        refuse_clashes(keep, ["lang_pred", "score", "rejected"])
    names, contents = list(model.dictionaries), list(model.dictionaries.values())
    carried = docs.select(F.col("text").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep) if c != "text"])
    inner = {c: "_text" if c == "text" else f"_{i}" for i, c in enumerate(keep)}
    schema = ", ".join(f"`{i}` {carried.schema[i].dataType.simpleString()}" for i in inner.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False).compress)

        def judge(text: str | None) -> tuple[str, float, bool]:
            if not coders or text is None or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, True
            raw = letters_only(text).encode("utf-8", "surrogatepass")
            sizes = [sum(len(c(raw[i : i + block])) for i in range(0, len(raw), block)) for c in coders]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            others = sizes[:best] + sizes[best + 1 :]
            score = 1.0 - sizes[best] / min(others) if others else 1.0
            return names[best], score, score < margin

        for batch in text_slices(batches, "_text"):
            judged = [judge(t) for t in batch.column("_text").to_pylist()]
            lang, score, rejected = zip(*judged, strict=True) if judged else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in inner.values()] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*inner.values(), "lang_pred", "score", "rejected"],
            )

    found = carried.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
    own = [F.col(i).alias(c) for c, i in inner.items()]
    return found.where("not rejected").select(*own) if accepted_only else found.select(*own, "lang_pred", "score", "rejected")


def in_holdout(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
