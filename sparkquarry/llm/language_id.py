"""Language identification by prediction by partial matching.

Each language has a context tree of bytes (all 256; A-Z lowered) with its own counts; contexts are those of the
greatest shares of the languages' own texts. A text gets the language whose tree codes all of it in the fewest bits. ``score`` is the posterior of that language
under equal priors. Trees learn from every training row with a text and a language.

Null text, or one without a letter: ``und`` with score 0, also where nothing could be learned. Ties go to
the first language in name order. Equal rows get equal results. Input columns named like a result
column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ppm
from .common import bounded_batches, LOWER, text_blocks

UNKNOWN = "und"
RESULT = {"lang_pred": T.StringType(), "score": T.DoubleType(), "bits_per_byte": T.DoubleType()}


#: Cells (contexts * 256 bytes * languages) that a model may have: with many languages each context weighs more.
MOST_CELLS = 1 << 28


@dataclass
class LanguageModel:
    languages: list[str]
    codes: ppm.Codes | None


def _lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_nodes: int = 30_000) -> LanguageModel:
    """Learns from every row with text and language; ``most_nodes``: contexts of the trie, fewer where MOST_CELLS asks for it."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("text <> '' AND lang IS NOT NULL")
    languages = sorted(r[0] for r in docs.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], None)
    most_nodes = max(2, min(most_nodes, MOST_CELLS // (ppm.SYMBOLS * len(languages))))
    numbered = docs.select("text", (F.array_position(F.lit(languages), F.col("lang")) - 1).cast("int").alias("language"))
    trie = ppm.choose_contexts(numbered, "text", _lowered, "language", most_nodes)
    return LanguageModel(languages, ppm.Codes.of_cells(trie, *ppm.count_cells(numbered, "text", _lowered, "language", trie), len(languages)))


def predict(model: LanguageModel, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte (of the language found; null for und)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [c for c in docs.columns if c not in RESULT and c != "__lettered"]
    lettered = F.coalesce(docs[text_col].cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__lettered")
    # a text that is a column of the result as well goes to the tasks once
    once = text_col in names and docs.schema[text_col].dataType == T.StringType()
    text = text_col if once else "__text"
    source = docs.select(*[docs[c] for c in names], lettered, *([] if once else [docs[text_col].cast("string").alias("__text")]))
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for part, data, offsets in text_blocks(batches, text, ppm.BLOCK):
            lettered = part.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            n = len(lettered)
            if not model.languages:
                pred, score, per_byte = pa.array([UNKNOWN] * n), np.zeros(n), pa.nulls(n, pa.float64())
            else:
                bits = model.codes.lengths(LOWER[data], offsets)
                best = bits.argmin(1)
                least = bits[np.arange(n), best]
                score = np.where(lettered, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), 0.0)
                pred = pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)])
                per_byte = pa.array(least / np.maximum(1, np.diff(offsets)), mask=~lettered)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pred, pa.array(score), per_byte], names=[*names, *RESULT])
        ppm.free_tables()

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(k, v) for k, v in RESULT.items()])
    return source.mapInArrow(run, schema)
