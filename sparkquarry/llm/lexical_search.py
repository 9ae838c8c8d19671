"""Ranked lexical search over a clustered index of documents in bisection order.

1. Every text becomes the counts of the queries' terms in it and its number of terms; no other term can change a score.
2. A tree of graph bisections (``graph_bisection``) is fitted on at most ``sample`` documents; all documents are sent down it to their
   cluster. A cluster is dealt to shards of about equal postings by a hash, and each shard is ordered by recursive bisection and cut
   into blocks. A block holds its postings with their impacts and the largest impact of each term, a cluster the largest of its blocks.
3. The bound of a cluster for a query is the sum of its terms' weights times the cluster's largest impacts. Clusters are visited
   from the highest bound down, in a few waves of 1, 3, 12, ... clusters a query. A query stops as soon as no bound reaches its k-th score; a
   bound equal to it is still visited, as a smaller id would win there. Blocks are passed over by the same test. What is not visited can't
   hold a result, so results are exact whatever the tree or the sample.

Score: sum over the query's terms, repeats included, of w * ((10**9 * tf) div (1000 * tf + 8 * m)), with w = floor(1000 * ln((2N+2) / (2df+1))) and
m = 25 + (75 * n * N) div L; N documents with a term, L terms in all, n terms of the document. Terms: runs of ASCII letters, digits and
characters beyond ASCII, A-Z lowered, over whole texts of any length.

Equal scores go by ascending id, null ids last; rows of one id are ranked each for itself. Null or empty texts and those without a term take no
part; queries without a term or a match get no rows; equal query texts are searched once and each row gets the results. Empty tables give an
empty result. Other columns are ignored. Distinct query texts are taken ``batch`` at a time: their terms and weights go to all tasks.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, shared_table, span_hashes, spans, sums, text_blocks
from .graph_bisection import Tree, order

BLOCK_BYTES = 1 << 20
#: Documents of a block of the index.
BLOCK_DOCS = 128
#: Postings of a shard, about: what one task orders at a time.
SHARD_POSTINGS = 1 << 20
#: Cells (nodes * terms) of the tree that goes to all tasks, at most: beyond that it has fewer levels.
TREE_CELLS = 1 << 24

_TERM_BYTE = np.zeros(256, np.uint8)
_TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every term."""
    start, end, doc = spans(_TERM_BYTE[data], offsets)
    return span_hashes(data, start, end), doc


@dataclass
class Queries:
    """Query texts as counts of their terms."""

    keys: list[str]
    vocabulary: np.ndarray  # sorted hashes
    ptr: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(keys: list[str], texts: list[str]) -> Queries:
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(b) for b in raw])).astype(np.int64)
        hashes, query = terms_of(data, offsets)
        vocabulary, term = np.unique(hashes, return_inverse=True)
        cells, times = np.unique(query * max(1, len(vocabulary)) + term, return_counts=True)
        query, term = np.divmod(cells, max(1, len(vocabulary)))
        return Queries(keys, vocabulary, np.searchsorted(query, np.arange(len(raw) + 1)), term, times)


@dataclass
class Scoring:
    """What turns counts into impacts: documents with a term, their terms in all, and a weight for each query term."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _lists(values: np.ndarray, ptr: np.ndarray, kind=np.int32) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values.astype(kind)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ptr = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[ptr[0] : ptr[-1]], ptr - ptr[0]


def postings(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``terms`` are places in the queries' vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches):
        vocabulary = held.value
        for part, data, offsets in text_blocks(batches, "text", BLOCK_BYTES):
            hashes, doc = terms_of(data, offsets)
            n = np.bincount(doc, minlength=part.num_rows)
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[at] == hashes
            cells, tf = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
            doc, term = np.divmod(cells, len(vocabulary))
            kept = np.flatnonzero(n)
            ptr = np.searchsorted(doc, np.append(kept, part.num_rows))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(kept)), pa.array(n[kept]), _lists(term, ptr), _lists(tf, ptr)], names=["doc_id", "n", "terms", "tfs"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _term_sums(table: DataFrame, schema: str, counted) -> dict[str, np.ndarray]:
    """Counts by key that each task adds up first; ``counted``: batch to keys and counts."""

    def run(batches):
        for batch in batches:
            keys, n = counted(batch)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    found = table.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return {c: found.column(c).to_numpy() for c in ("key", "n")}


def scoring(table: DataFrame, queries: Queries) -> Scoring | None:
    """Counts over all documents; None where no document has a term."""
    n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    found = _term_sums(table.select("terms"), "key long, n long", lambda b: np.unique(_flat(b.column(0))[0], return_counts=True))
    df = np.zeros(len(queries.vocabulary), np.int64)
    df[found["key"]] = found["n"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    return Scoring(n_docs, int(n_terms), weights)


def fit_tree(table: DataFrame, queries: Queries, sample: int, depth: int, n_docs: int) -> Tree:
    """Bisections of at most ``sample`` documents, taken by a hash."""
    share = min(1.0, 2 * sample / n_docs)
    chosen = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    terms, ptr = _flat(table.where(chosen).select("terms").limit(sample).toArrow().column("terms"))
    depth = max(0, min(depth, int(math.log2(TREE_CELLS / len(queries.vocabulary))), int(math.log2(max(1, len(ptr) - 1)))))
    return Tree(ptr, terms, len(queries.vocabulary), depth)


def build_index(table: DataFrame, queries: Queries, law: Scoring, tree: Tree) -> DataFrame:
    """Blocks of the index, in folders by cluster."""
    spark = table.sparkSession
    held = spark.sparkContext.broadcast(tree)

    def leaves(batch):
        terms, ptr = _flat(batch.column(0))
        return held.value.leaves(ptr, terms), np.diff(ptr) + 1

    sizes = _term_sums(table.select("terms"), "key long, n long", leaves)
    n_clusters = 2**tree.depth
    postings_of = np.zeros(n_clusters, np.int64)
    postings_of[sizes["key"]] = sizes["n"]
    # a cluster with far more than its share is dealt to several shards
    most = max(1, min(SHARD_POSTINGS, int(postings_of.sum()) // n_clusters))
    shards = np.maximum(1, -(-postings_of // most))
    first_shard = np.append(0, np.cumsum(shards))

    def routed(batches):
        for batch in batches:
            n, chance = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            (terms, ptr), (tf, _) = _flat(batch.column(2)), _flat(batch.column(3))
            leaf = held.value.leaves(ptr, terms)
            impacts = law.impacts(tf.astype(np.int64), np.repeat(n, np.diff(ptr)))
            shard = first_shard[leaf] + chance % shards[leaf]
            full = pa.array(np.diff(ptr) > 0)  # without a query term: no score
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(leaf), batch.column(0), batch.column(2), _lists(impacts, ptr)], names=["shard", "cluster", "doc_id", "terms", "impacts"]
            ).filter(full)

    chance = F.pmod(F.xxhash64("doc_id", "n", "terms", F.monotonically_increasing_id()), F.lit(1 << 40)).alias("chance")
    rows = table.select("doc_id", "n", "terms", "tfs", chance).mapInArrow(routed, "shard long, cluster long, doc_id long, terms array<int>, impacts array<int>")
    n_terms = len(queries.vocabulary)

    def blocks(group: pa.Table) -> pa.Table:
        (terms, ptr), (impacts, _) = _flat(group.column("terms")), _flat(group.column("impacts"))
        ids = group.column("doc_id").combine_chunks()
        place = order(ptr, terms, n_terms, BLOCK_DOCS)
        doc = np.repeat(np.argsort(place), np.diff(ptr))
        by = np.argsort(doc, kind="stable")
        doc, terms, impacts = doc[by], terms[by], impacts[by]
        edge = np.arange(0, len(place) + BLOCK_DOCS, BLOCK_DOCS).clip(max=len(place))
        edge = edge[: -(-len(place) // BLOCK_DOCS) + 1]
        cut = np.searchsorted(doc, edge)
        top = [np.unique(terms[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        best = []
        for t, a, b in zip(top, cut[:-1], cut[1:], strict=True):
            most = np.zeros(len(t), np.int64)
            np.maximum.at(most, np.searchsorted(t, terms[a:b]), impacts[a:b])
            best.append(most)
        top_ptr = np.append(0, np.cumsum([len(t) for t in top]))
        ids = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), ids.take(pa.array(place)))
        return pa.table({
            "cluster": pa.array(np.full(len(edge) - 1, group.column("cluster")[0].as_py())), "ids": ids, "docs": _lists(doc % BLOCK_DOCS, cut),
            "terms": _lists(terms, cut), "impacts": _lists(impacts, cut), "top_terms": _lists(np.concatenate(top), top_ptr), "top_impacts": _lists(np.concatenate(best), top_ptr),
        })

    schema = "cluster long, ids array<long>, docs array<int>, terms array<int>, impacts array<int>, top_terms array<int>, top_impacts array<int>"
    found = rows.groupBy("shard").applyInArrow(blocks, schema)
    path = f"{shared_dir(spark)}/lexical-index-{uuid.uuid4().hex}"
    found.write.partitionBy("cluster").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def cluster_bounds(index: DataFrame, queries: Queries, law: Scoring, n_clusters: int) -> np.ndarray:
    """The highest score that a query could have in a cluster (queries x clusters)."""
    n_terms = len(queries.vocabulary)
    most = (
        index.select("cluster", F.explode(F.arrays_zip("top_terms", "top_impacts")).alias("t")).groupBy("cluster", "t.top_terms")
        .agg(F.max("t.top_impacts").alias("most")).toArrow()
    )
    table = np.zeros((n_clusters, n_terms), np.int64)
    cluster, term, impact = (c.to_numpy() for c in most.columns)
    table[cluster, term] = impact
    worth = queries.times * law.weights[queries.terms]
    return np.stack([sums(row[queries.terms] * worth, queries.ptr) for row in table], 1)


def _visit(index: DataFrame, queries: Queries, law: Scoring, wanted: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` of each query in each task among the clusters that it wants, with scores of at least its floor."""
    n_terms, n_queries = len(queries.vocabulary), len(queries.keys)
    worth = queries.times * law.weights[queries.terms]
    held = index.sparkSession.sparkContext.broadcast((queries.ptr, queries.terms, worth, wanted, floor))
    # sums of whole numbers in doubles are exact below 2**53
    number = np.float64 if n_queries == 0 or sums(worth, queries.ptr).max(initial=0) < 2**53 // 1_000_000 else np.int64

    def run(batches):
        ptr, q_terms, worth, wanted, floor = held.value
        least = floor.copy()  # what a result must reach
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * n_queries
        query = np.repeat(np.arange(n_queries), np.diff(ptr))
        place = np.full(n_terms, -1)
        for batch in batches:
            flat = {c: _flat(batch.column(i)) for i, c in enumerate(batch.schema.names) if c != "cluster" and c != "ids"}
            id_column = batch.column(batch.schema.get_field_index("ids"))
            for i, cluster in enumerate(batch.column(batch.schema.get_field_index("cluster")).to_numpy()):
                own = {c: v[p[i] : p[i + 1]] for c, (v, p) in flat.items()}
                top = np.zeros(n_terms, np.int64)
                top[own["top_terms"]] = own["top_impacts"]
                bound = sums(top[q_terms] * worth, ptr)
                alive = np.flatnonzero(wanted[:, cluster] & (bound >= least))
                if not len(alive):
                    continue
                ids = id_column[i].values
                used = own["top_terms"]
                place[used] = np.arange(len(used))
                cells = np.zeros((len(ids), len(used)), number)
                cells[own["docs"], place[own["terms"]]] = own["impacts"]
                weights = np.zeros((len(used), len(alive)), number)
                rank = np.full(n_queries, -1)
                rank[alive] = np.arange(len(alive))
                mine = (rank[query] >= 0) & (place[q_terms] >= 0)
                weights[place[q_terms[mine]], rank[query[mine]]] = worth[mine]
                place[used] = -1
                scores = (cells @ weights).astype(np.int64)
                no_id = np.asarray(ids.is_null())
                numbers = ids.fill_null(0).to_numpy()
                for j in np.flatnonzero(scores.max(0) >= least[alive]):
                    q = alive[j]
                    hits = np.flatnonzero(scores[:, j] >= least[q])
                    new = (scores[hits, j], no_id[hits], numbers[hits])
                    s, none, own_ids = new if best[q] is None else (np.concatenate(x) for x in zip(best[q], new, strict=True))
                    chosen = np.lexsort((own_ids, none, -s))[:k]
                    best[q] = (s[chosen], none[chosen], own_ids[chosen])
                    if len(chosen) == k:
                        least[q] = max(least[q], int(s[chosen[-1]]))
        for q, found in enumerate(best):
            if found is not None:
                s, none, own_ids = found
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q)), pa.array(own_ids, mask=none), pa.array(s)], names=["query", "doc_id", "score"])

    clusters = np.flatnonzero(wanted.any(0)).tolist()
    return index.where(F.col("cluster").isin(clusters)).mapInArrow(run, "query long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _search(docs: DataFrame, queries: Queries, k: int, sample: int, depth: int) -> DataFrame | None:
    """(query, rank, doc_id, score) for one batch of queries."""
    if not len(queries.vocabulary):
        return None
    table = shared_table(postings(docs, queries), "lexical-postings")
    law = scoring(table, queries)
    if law is None:
        return None
    tree = fit_tree(table, queries, sample, depth, law.n_docs)
    index = build_index(table, queries, law, tree)
    bounds = cluster_bounds(index, queries, law, 2**tree.depth)
    turn = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
    floor = np.ones(len(queries.keys), np.int64)  # a score of 0 is no result
    found, low, high = None, 0, 1
    while low < bounds.shape[1]:
        wanted = (turn >= low) & (turn < high) & (bounds >= floor[:, None])
        if not wanted.any():
            break  # bounds fall with the turn, so nothing later can reach the floor either
        new = shared_table(_visit(index, queries, law, wanted, floor, k), "lexical-hits")
        found = new if found is None else found.unionByName(new)
        last = _ranked(found, k).where(F.col("rank") == k).select("query", "score").toArrow()
        floor[last.column("query").to_numpy()] = last.column("score").to_numpy()
        low, high = high, 4 * high
    return None if found is None else _ranked(found, k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", sample: int = 8_192, depth: int = 6, batch: int = 5_000,
) -> DataFrame:
    """The ``k`` best documents of each row of ``items``: its id, rank (from 1), doc_id, score. The tree is fitted on at most ``sample``
    documents and has at most 2**``depth`` clusters; every document is in the index."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text <> ''")
    items = items.select(items[item_col].alias(item_col), items[item_text_col].cast("string").alias("query_text")).where("query_text <> ''")
    texts = shared_table(items.select(F.sha2("query_text", 256).alias("key"), "query_text").groupBy("key").agg(F.first("query_text").alias("query_text")), "lexical-queries")
    parts = -(-texts.count() // batch)
    answers = None
    for part in range(parts):
        own = texts.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).orderBy("key").toArrow()
        queries = Queries.of(own.column("key").to_pylist(), own.column("query_text").to_pylist())
        found = _search(docs, queries, k, sample, depth)
        if found is not None:
            keys = F.from_json(F.lit(str(queries.keys).replace("'", '"')), "array<string>")
            found = found.select(F.get(keys, F.col("query").cast("int")).alias("key"), "rank", "doc_id", "score")
            answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return items.select(item_col, F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return items.select(item_col, F.sha2("query_text", 256).alias("key")).join(answers, "key").select(item_col, "rank", "doc_id", "score")
