"""Quality classifier: random-indexing word vectors, pooled by document, under a two-layer network in numpy.

Word vectors: each word and each run of marks has a sparse index vector of +1 and -1 that follows from its hash; its context vector is the sum of
the index vectors of the two words before and the two behind it, at every place where it stands in any document. These sums cover
all texts; Spark adds them up by word. The ``words`` most frequent words have context vectors of their own; a rarer word has that of its shape
(letter case, digits or marks, length, whether it repeats the word before), which is learned in the same sums. Vectors are freed of
their common mean, brought to length 1 and weighted by a / (a + share of all words).

A document is the mean of its words' vectors beside the mean of its shapes' index vectors. A network of one hidden layer of tanh units
and a logistic output is trained on at most ``labelled`` rows of each label, chosen by hash of the id; one fifth of them is kept out of
the training and fits the temperature that the logits are divided by, so that scores are calibrated.

Null or empty texts and those of blanks only are all zeros and get the network's score for that. With labels of one kind or none the
score is their smoothed share. A label whose id is null or null itself is left out; an id with several labels counts with the
smallest. Equal texts get equal scores. An empty table stays empty. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, _SEPARATOR, bounded_batches, mix64, shared_table, span_hashes, spans, sums, text_blocks
from .lexical_search import _TERM_BYTE
from .ppm import _counted

BLOCK_BYTES = 1 << 20
DIMENSIONS = 64
#: Entries of an index vector that are not 0.
ENTRIES = 4
#: Neighbours on each side.
REACH = 2
SMOOTHING = 1e-3
HIDDEN = 32
_KIND = np.where(_SEPARATOR, 0, np.where(_TERM_BYTE == 1, 1, 2)).astype(np.uint8)
_CASES, _LENGTHS = 5, (4, 8, 13)
SHAPES = _CASES * (len(_LENGTHS) + 1) * 2
#: Parts in which the labelled rows of a label are first thinned, so that no window meets all of them.
PARTS = 64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and document of each word or run of marks."""
    start, end, doc = spans(_KIND[data], offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), doc
    hashes = span_hashes(data, start, end)
    length = end - start
    capital, digit = (sums(x.astype(np.int64), np.append(start, len(data)))[: len(start)] for x in ((LOWER[data] != data), (data >= 48) & (data <= 57)))
    # sums run to the next word, but between two words there are blanks or the other one's bytes, which start there
    marks = _KIND[data[start]] == 2
    first = LOWER[data[start]] != data[start]
    case = np.select([marks, 2 * digit >= length, (capital > 1) & (2 * capital >= length), first], [4, 3, 2, 1], 0)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    return hashes, (case * (len(_LENGTHS) + 1) + np.searchsorted(_LENGTHS, length, "right")) * 2 + again, doc


def _index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vector of each hash (n x ENTRIES)."""
    at, sign = [], []
    for i in range(ENTRIES):
        x = mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
        at.append((x % np.uint64(DIMENSIONS)).astype(np.int64))
        sign.append(1.0 - 2.0 * (x >> np.uint64(63)).astype(np.float64))
    return np.stack(at, 1), np.stack(sign, 1)


def _index_vectors(hashes: np.ndarray) -> np.ndarray:
    at, sign = _index_entries(hashes)
    out = np.zeros((len(hashes), DIMENSIONS))
    np.add.at(out, (np.arange(len(hashes))[:, None], at), sign)
    return out


_SHAPE_VECTORS = _index_vectors(np.arange(SHAPES, dtype=np.uint64)).astype(np.float32) / np.float32(ENTRIES**0.5)


def _rows_of(vocabulary: np.ndarray, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The row of each word's vector: its own, or behind those that of its shape."""
    if not len(vocabulary):
        return shapes
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary) + shapes)


@dataclass
class WordVectors:
    vocabulary: np.ndarray  # sorted hashes
    vectors: np.ndarray  # of the words, then of the shapes

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The features of each text."""
        hashes, shapes, doc = tokens(data, offsets)
        n_docs = len(offsets) - 1
        ptr = np.searchsorted(doc, np.arange(n_docs + 1))
        n = np.maximum(1, np.diff(ptr))[:, None]
        rows = _rows_of(self.vocabulary, hashes, shapes)
        out = np.empty((n_docs, 2 * DIMENSIONS))
        out[:, :DIMENSIONS] = _sums_of(self.vectors, rows, ptr) / n
        out[:, DIMENSIONS:] = _sums_of(_SHAPE_VECTORS, shapes, ptr) / n
        return out


def _sums_of(vectors: np.ndarray, rows: np.ndarray, ptr: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """Sums of vectors by text, over distinct rows times their counts, for some texts at a time."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    cells, times = np.unique(doc * len(vectors) + rows, return_counts=True)
    doc, rows = np.divmod(cells, len(vectors))
    cut = np.searchsorted(doc, np.arange(len(ptr)))
    out, at = np.zeros((len(ptr) - 1, vectors.shape[1])), 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + most, "right")) - 1)
        a, b = cut[at], cut[to]
        out[at:to] = sums(vectors[rows[a:b]].astype(np.float64) * times[a:b, None], cut[at : to + 1] - a)
        at = to
    return out


def fit_vectors(texts: DataFrame, words: int) -> WordVectors:
    """Context vectors from every row of ``texts`` (one column, text)."""
    spark = texts.sparkSession
    counts = shared_table(_counted(texts, "text", lambda part, data, offsets: tokens(data, offsets)[0].view(np.int64)), "quality-words")
    n_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.orderBy(F.desc("n"), "key").limit(words).toArrow()
    vocabulary, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(vocabulary)
    vocabulary, n = vocabulary[order], n[order]
    n_rows = len(vocabulary) + SHAPES
    held = spark.sparkContext.broadcast(vocabulary)

    def contexts(batches):
        """Sums of index vectors by row of the table, over all texts of the task."""
        total, times = np.zeros(n_rows * DIMENSIONS), np.zeros(n_rows, np.int64)
        for _, data, offsets in text_blocks(batches, "text", BLOCK_BYTES):
            hashes, shapes, doc = tokens(data, offsets)
            rows = _rows_of(held.value, hashes, shapes)
            times += np.bincount(rows, minlength=n_rows)
            at, sign = _index_entries(hashes)
            for step in range(1, REACH + 1):
                near = np.flatnonzero(doc[step:] == doc[:-step])
                for own, other in ((near, near + step), (near + step, near)):
                    cells = rows[own][:, None] * DIMENSIONS + at[other]
                    total += np.bincount(cells.ravel(), sign[other].ravel(), len(total))
        total = total.reshape(n_rows, DIMENSIONS).astype(np.int64)
        seen = np.flatnonzero(times)
        for a in range(0, len(seen), 4096):
            some = seen[a : a + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(times[some]), *[pa.array(np.ascontiguousarray(total[some, d])) for d in range(DIMENSIONS)]],
                names=["row", "n", *[f"d{d}" for d in range(DIMENSIONS)]],
            )

    columns = [f"d{d}" for d in range(DIMENSIONS)]
    schema = "row long, n long, " + ", ".join(f"{c} long" for c in columns)
    added = texts.mapInArrow(contexts, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]).toArrow()
    vectors, times = np.zeros((n_rows, DIMENSIONS)), np.zeros(n_rows)
    rows = added.column("row").to_numpy()
    vectors[rows] = np.stack([added.column(c).to_numpy() for c in columns], 1)
    times[rows] = added.column("n").to_numpy()
    vectors = vectors / np.maximum(1, times)[:, None]
    vectors -= (vectors * times[:, None]).sum(0) / max(1, times.sum())
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1))[:, None]
    share = np.append(n / max(1, n_all), np.zeros(SHAPES))  # a word beyond the table is rare, whatever its shape
    vectors *= (SMOOTHING / (SMOOTHING + share))[:, None] * (times > 0)[:, None]
    return WordVectors(vocabulary, vectors.astype(np.float32))


@dataclass
class Network:
    """Scaling of the features, hidden layer, output layer, temperature."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Each row for itself in one order of sums, so that equal rows get equal logits whatever lies beside them."""
        z, total = (x - self.mean) / self.scale, np.tile(self.hidden_bias, (len(x), 1))
        for column, weights in zip(z.T, self.hidden, strict=True):
            total += column[:, None] * weights
        return (np.tanh(total) * self.out).sum(1) + self.out_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def constant(share: float) -> Network:
    """The same score for every text."""
    n = 2 * DIMENSIONS
    return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, rate: float = 0.01, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> Network:
    """Adam on the logistic loss, with the rate falling to 0."""
    pick = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    values = [pick.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), pick.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    steps, t = rounds * -(-len(z) // batch), 0
    for _ in range(rounds):
        order = pick.permutation(len(z))
        for at in range(0, len(z), batch):
            own = order[at : at + batch]
            a = np.tanh(z[own] @ values[0] + values[1])
            off = (1 / (1 + np.exp(-np.clip(a @ values[2] + values[3], -500, 500))) - y[own]) / len(own)
            back = off[:, None] * values[2] * (1 - a * a)
            slopes = [z[own].T @ back + decay * values[0], back.sum(0), a.T @ off + decay * values[2], np.array([off.sum()])]
            t += 1
            for v, g, m, s in zip(values, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, *values[:3], float(values[3][0]))


def calibrated(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature of the least logistic loss on rows that the network was not trained on, among steps of a fifth of an octave."""
    steps = 2.0 ** (np.arange(-10, 21) / 5)
    logits = network.logits(x)
    loss = [np.logaddexp(0, np.where(y == 1, -logits, logits) / t).mean() for t in steps]
    network.temperature = float(steps[int(np.argmin(loss))])
    return network


@dataclass
class QualityModel:
    vectors: WordVectors
    network: Network


def _features(rows: DataFrame, vectors: WordVectors, kept: list[str]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for part, data, offsets in text_blocks(batches, "text", BLOCK_BYTES):
            x = held.value.pooled(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], lists], names=[*kept, "x"])

    return rows.select(*kept, "text").mapInArrow(run, T.StructType([rows.schema[c] for c in kept] + [T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fit(
    docs: DataFrame, labels: DataFrame, may_learn: Column, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    words: int = 32_768, labelled: int = 10_000,
) -> QualityModel:
    """Vectors from all ``docs``; the network from the ``labels`` (0 or 1) of documents where ``may_learn`` holds, of which at most ``labelled``
    rows of each label are taken."""
    bounded_batches(docs.sparkSession)
    vectors = fit_vectors(docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), words)
    known = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("label")).where("label_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("label_id").agg(F.min("label").alias("label")).withColumn("turn", F.xxhash64("label_id"))
    own = docs.where(may_learn).select(docs[id_col].alias("own_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # texts move only for the rows that are taken
    able = known.join(own.select("own_id").where("own_id IS NOT NULL").distinct(), F.col("label_id") == F.col("own_id"), "left_semi")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("turn", "label_id"))
    able = able.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(PARTS))).withColumn("nth", nth("label", "part")).where(F.col("nth") <= labelled)
    able = able.withColumn("nth", nth("label")).where(F.col("nth") <= labelled).select("label_id", "label", "turn")
    # at most 2 * labelled rows, so the broadcast has a bound; of copies under one id one is taken
    sample = own.join(F.broadcast(able), F.col("own_id") == F.col("label_id")).select("turn", "label", "text")
    found = _features(sample, vectors, ["turn", "label"]).groupBy("turn").agg(F.min(F.struct("label", "x")).alias("own")).select("turn", "own.label", "own.x").toArrow()
    order = np.argsort(found.column("turn").to_numpy(), kind="stable")
    y = found.column("label").to_numpy()[order].astype(np.float64)
    if len(set(y)) < 2:
        return QualityModel(vectors, constant((y.sum() + 1) / (len(y) + 2)))
    lists = found.column("x").combine_chunks()
    x = lists.flatten().to_numpy().reshape(len(y), -1)[order]
    kept_out = np.arange(len(y)) % 5 == 4
    network = train(x[~kept_out], y[~kept_out])
    if len(set(y[kept_out])) == 2:
        network = calibrated(network, x[kept_out], y[kept_out])
    return QualityModel(vectors, network)


RESULT = {"quality_score": T.DoubleType()}


def predict(model: QualityModel, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score, the probability of label 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [c for c in docs.columns if c not in RESULT]
    once = text_col in names and docs.schema[text_col].dataType == T.StringType()
    name = text_col if once else "__text"
    source = docs.select(*[docs[c] for c in names], *([] if once else [docs[text_col].cast("string").alias(name)]))
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for part, data, offsets in text_blocks(batches, name, BLOCK_BYTES):
            score = held.value.network.scores(held.value.vectors.pooled(data, offsets))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(score)], names=[*names, *RESULT])

    return source.mapInArrow(run, T.StructType([docs.schema[c] for c in names] + [T.StructField(k, v) for k, v in RESULT.items()]))
