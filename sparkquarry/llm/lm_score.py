"""Language-model scoring by prediction by partial matching.

The model codes a document as a space and the bytes of each word (A-Z lowered), then an end, with
all contexts of up to four bytes of every training document (``gram_table``); the score is the log10
probability of that sequence. Beside it stands a word-unigram base with add-one smoothing. Word counts
cover all training documents. The most frequent grams and the 65,536 most frequent words are looked up in
the tasks, all others of a document meet their code lengths and counts in joins: these bounds change no result.

A null text is empty: one token, the end. Equal rows are scored each for itself, also under one
id; a null id counts as the empty text for the split. Extra columns are ignored. With no training
document N is 0 and the model is uniform.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gram_table, ppm
from .common import _SEPARATOR, bounded_batches, LOWER, shared_table, sums, text_blocks, words

TOP_WORDS = 65_536
_FACTS = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word long, gram long, n int"
_FACT_COLUMNS = [tuple(x.split()) for x in _FACTS.split(", ")]
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}


def _word_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as the model reads them: texts come with a space before and behind; of each gap one
    space is kept before a word, and the last byte becomes the end (256)."""
    separator = _SEPARATOR[data]
    keep = ~separator
    keep[:-1] |= separator[:-1] & ~separator[1:]
    ends = offsets[1:] - 1
    keep[ends] = True
    stream = LOWER[data].astype(np.uint16)
    stream[separator] = 32
    stream[ends] = 256
    kept = np.append(0, np.cumsum(keep))
    return stream[keep], kept[offsets]


def _gram_keys(part, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The grams of texts whose first column tells if they are held out."""
    stream, cut = _word_stream(data, offsets)
    held_out = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return gram_table.grams(stream, cut) + np.repeat(held_out * gram_table.HELD, np.diff(cut))


def _counted_rows(keys: np.ndarray, doc: np.ndarray, rows: np.ndarray, name: str) -> pa.RecordBatch:
    """One row for each (document, key) with its count; ``name``: the column of the keys."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))
    own = {"row": pa.array(rows[doc[first]]), name: pa.array(keys[first]), "n": pa.array(np.diff(np.append(first, len(keys))).astype(np.int32))}
    return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(len(first), _TYPES[t])) for c, t in _FACT_COLUMNS], names=[c for c, _ in _FACT_COLUMNS])


def score_documents(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; ``training``: which rows the model may learn from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.concat(F.lit(" "), F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(" "))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), (~F.coalesce(training, F.lit(False))).alias("held_out"), text.alias("text"))
    learned = source.where("NOT held_out").select("text")

    counts = shared_table(ppm._counted(learned, "text", lambda part, data, offsets: words(data, offsets)[0].view(np.int64)), "word-counts")
    n_docs = learned.count()
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    v, n = v + (n_docs > 0), n + n_docs  # the end is a token too
    top = counts.orderBy(F.desc("n"), "key").limit(TOP_WORDS).toArrow()
    top_words, top_counts = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(top_words)
    top_words, top_logs = top_words[order], np.log10(top_counts[order] + 1.0)

    lengths = gram_table.lengths_table(ppm._counted(source.select("held_out", "text"), "text", _gram_keys))
    model = spark.sparkContext.broadcast((gram_table.TopGrams.of(lengths), top_words, top_logs))
    end_log, norm = float(np.log10(n_docs + 1.0)), float(np.log10(n + v + 1.0))

    def facts(batches):
        top_grams, top_words, top_logs = model.value
        row = TaskContext.get().partitionId() << 33
        for part, data, offsets in text_blocks(batches, "text", ppm.BLOCK):
            n_docs = part.num_rows
            rows = np.arange(row, row + n_docs)
            row += n_docs
            stream, cut = _word_stream(data, offsets)
            grams = gram_table.grams(stream, cut)
            bits, is_known = top_grams.look_up(grams)
            score = sums(bits, cut) * -np.log10(2.0)
            hashes, doc, tokens = words(data, offsets)
            hashes = hashes.view(np.int64)
            at = np.minimum(np.searchsorted(top_words, hashes), max(0, len(top_words) - 1))
            is_top = top_words[at] == hashes if len(top_words) else np.zeros(len(hashes), bool)
            base = np.bincount(doc[is_top], top_logs[at[is_top]] if len(top_words) else None, n_docs) + end_log - (tokens + 1) * norm
            known = np.bincount(doc[is_top], minlength=n_docs) + (end_log > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), part.column(0), part.column(1), pa.array(tokens + 1), pa.array(known), pa.array(base), pa.array(score), pa.nulls(n_docs, pa.int64()), pa.nulls(n_docs, pa.int64()), pa.nulls(n_docs, pa.int32())],
                names=[c for c, _ in _FACT_COLUMNS],
            )
            if not is_top.all():
                yield _counted_rows(hashes[~is_top], doc[~is_top], rows, "word")
            if not is_known.all():
                rest = np.flatnonzero(~is_known)
                yield _counted_rows(grams[rest], np.searchsorted(cut, rest, "right") - 1, rows, "gram")

    found = shared_table(source.mapInArrow(facts, _FACTS), "lm-facts")
    rare = (
        found.where("word IS NOT NULL").select("row", "word", F.col("n").alias("times"))
        .join(counts, F.col("word") == F.col("key"))
        .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    )
    rest = (
        found.where("gram IS NOT NULL").select("row", "gram", F.col("n").alias("times"))
        .join(lengths.select("gram", "bits"), "gram")
        .groupBy("row").agg((F.sum(F.col("times") * F.col("bits")) * -math.log10(2.0)).alias("more_score"))
    )
    return (
        found.where("word IS NULL AND gram IS NULL").select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score")
        .join(rare, "row", "left").join(rest, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
        )
    )
