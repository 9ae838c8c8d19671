"""N-gram Jaccard join on prefix trees: components of documents whose word-shingle sets are alike.

Two sets link when 100 * |intersection| >= 100 * similarity * |union|. Sets are ordered globally: shingles by the level of
their document frequency (rare ones first, told by a fixed-size sketch), then by hash. Linked sets share a shingle
among their first n - ceil(similarity * n) + 1 (the prefix), so only sets that meet in a prefix shingle of two or more
sets take part.

1. Tries find links. Each set goes, with all its shingles, to the groups of a few of its shared prefix shingles. A task
   puts the sets of a group one by one into a trie and walks the trie with each: the overlap with a path that sets share
   is counted once, a subtree is left when the overlap so far plus what can remain is short of the need of its smallest set,
   or when all its sets are in the component of the walking set. Groups of many sets are dealt over tasks; a few anchors
   go to each part. What this step does not meet is left to the next.
2. The rest is exact. Only prefix shingles that still hold several components matter. Their members outside the largest
   component are compared with the members of other components by length, position and parity signatures (a few
   words a set), and each pair that these leave is tested on a trie of the candidates of one set.

So a group of near copies is never paired out, and no pair that could link and lies in two components goes untested:
components are exact. Links are not counted: that needs every linked pair, the square of a group of near copies.

Documents with equal sets share a set id (64 bits of a hash, as shingles have). Null texts and texts
without words have empty sets and link with nothing. With fewer words than a shingle has, the whole
sequence is the one shingle. Equal rows are linked unless empty. A null id is never the smallest of its component
unless all its ids are null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, mix64, shared_table, sums, text_blocks, words

SKETCH, CHUNK = 1 << 20, 1 << 16
#: What a sketch bucket holds beyond the mean, in standard deviations plus a constant, before its shingles go behind all others; level by level eight times that.
HEAVY_SIGMAS, HEAVY_LEAST, LEVELS = 6, 32, 3
#: Sets, and shingles of sets, that one trie holds.
TREE_SETS, TREE_SHINGLES = 256, 1 << 20
#: Groups that a set goes to in the first step, and anchors of a group that is dealt over tasks.
KEYS, ANCHORS = 3, 3
#: Members of a prefix shingle that one task compares with at a time.
MEMBERS = 2048
BLOCK = 1 << 20
#: Tasks for labels of few enough nodes to be broadcast.
FEW_TASKS = 8
#: 64-bit words of a set's parity signature.
SIGNS = 8
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (hash, text), ordered by text and hash."""
    word, doc, count = words(data, offsets)
    n = len(word)
    value = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        value += word[j : n - k + 1 + j] * _FACTORS[j]
    full = np.flatnonzero(doc[: len(value)] == doc[k - 1 :][: len(value)])
    hashes, of = mix64(value[full]), doc[full]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        whole = count[short].astype(np.uint64) * _FACTORS[7]
        for j in range(k - 1):
            has = count[short] > j
            whole[has] += word[first[short[has]] + j] * _FACTORS[j]
        hashes, of = np.append(hashes, mix64(whole)), np.append(of, short)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    keep = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))[: len(hashes)]
    return hashes[keep], of[keep]


def set_ids(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set of ``n`` shingles."""
    total = sums(mix64(hashes ^ _FACTORS[0]).view(np.int64), np.append(0, np.cumsum(n)))
    return mix64(total.view(np.uint64) + n.astype(np.uint64) * _FACTORS[1]).view(np.int64)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def _ordered(hashes: np.ndarray, of: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In the global order: by level, then by hash; the level takes the two highest bits."""
    ranks = (hashes >> np.uint64(2)) | (levels[_buckets(hashes)].astype(np.uint64) << np.uint64(62))
    order = np.lexsort((ranks, of))
    return ranks[order], of[order]


def signatures(hashes: np.ndarray, of: np.ndarray, n_sets: int) -> np.ndarray:
    """Bits (sets, SIGNS) that tell of each of 64 * SIGNS buckets whether a set has an odd number of shingles
    there. Where two sets' bits differ, so do the sets, so the distance bounds the symmetric difference."""
    at = of * (64 * SIGNS) + ((hashes >> np.uint64(23)) % np.uint64(64 * SIGNS)).astype(np.int64)
    odd = (np.bincount(at, minlength=n_sets * 64 * SIGNS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_sets, -1), axis=1).view("<i8")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Of each document its set's id, size and signature (kind 0), and of each task its sketch of document frequencies (kind 1)."""

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        names = ["kind", "doc_id", "t1", "t2", "sid", "n", "chunk", "counts", *[f"s{i}" for i in range(SIGNS)]]
        for part, data, offsets in text_blocks(batches, "text", BLOCK):
            hashes, of = shingles(data, offsets, k)
            np.add.at(sketch, _buckets(hashes), 1)
            n = np.bincount(of, minlength=part.num_rows)
            sid = set_ids(hashes, n)
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), part.column(0), part.column(1), part.column(2), pa.array(sid), pa.array(n), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), *map(pa.array, np.ascontiguousarray(signatures(hashes, of, m).T))], names=names)
        for c in range(SKETCH // CHUNK):
            counts = sketch[c * CHUNK : (c + 1) * CHUNK]
            if counts.any():
                one = [pa.array([1], pa.int32())] + [pa.nulls(1, pa.int64()) for _ in range(5)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([c], pa.int32()), pa.array([counts.astype("<i4").tobytes()], pa.binary()), *[pa.nulls(1, pa.int64())] * SIGNS], names=names)

    return docs.select("doc_id", "t1", "t2", "text").mapInArrow(run, "kind int, doc_id long, t1 long, t2 long, sid long, n long, chunk int, counts binary" + "".join(f", s{i} long" for i in range(SIGNS)))


def _levels(sketches: DataFrame, mean: float) -> np.ndarray:
    """The level of each of the SKETCH buckets, 0 for most; the result has a fixed size."""
    beyond = HEAVY_SIGMAS * mean**0.5 + HEAVY_LEAST

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_py(), "<i4")
        level = sum((total >= mean + beyond * 8**i).astype(np.uint8) for i in range(LEVELS))
        return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(SKETCH, np.uint8)
    for r in sketches.groupBy("chunk").applyInArrow(add, "chunk int, levels binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out


class PrefixTree:
    """Ordered sets as the paths of a trie; a node holds the shingles up to the next fork."""

    __slots__ = ("part", "below", "ends", "least", "most", "one")

    def __init__(self, part: np.ndarray, size: int, number: int):
        self.part, self.below, self.ends = part, {}, []
        self.least = self.most = size  # sizes of the smallest and the largest set below
        self.one: int | None = number  # a set of the component that holds all sets below, if it is known that one does

    def add(self, own: np.ndarray, number: int, root) -> None:
        """Adds an ordered set; ``root``: the component of a set number."""
        node, depth, n = self, 0, len(own)
        while True:
            m = min(len(node.part), n - depth)
            differs = np.flatnonzero(node.part[:m] != own[depth : depth + m])
            m = int(differs[0]) if len(differs) else m
            if m < len(node.part):  # a fork
                rest = PrefixTree(node.part[m:], node.least, number)
                rest.below, rest.ends, rest.most, rest.one = node.below, node.ends, node.most, node.one
                node.part, node.below, node.ends = node.part[:m], {int(rest.part[0]): rest}, []
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.one is not None and root(node.one) != root(number):
                node.one = None
            depth += m
            if depth == n:
                node.ends.append(number)
                return
            after = node.below.get(int(own[depth]))
            if after is None:
                node.below[int(own[depth])] = leaf = PrefixTree(own[depth:], n, number)
                leaf.ends.append(number)
                return
            node = after

    def links(self, probe: np.ndarray, percent: int, passed_over=lambda number: False, root=lambda number: number):
        """Numbers of the sets that link with ``probe``; those for which ``passed_over`` holds are left out as soon as it does."""
        n = len(probe)
        stack = [(self, 0, 0, 0)]  # node, depth, overlap of the path to it, shingles of the probe that lie before it
        while stack:
            node, depth, overlap, before = stack.pop()
            if 100 * node.most < percent * n or 100 * n < percent * node.least:
                continue
            if node.one is None:
                kinds = {root(x) for x in node.ends} | {None if x.one is None else root(x.one) for x in node.below.values()}
                node.one = kinds.pop() if len(kinds) == 1 else None
            if node.one is not None and passed_over(node.one):
                continue
            need = -(-percent * (max(node.least, -(-percent * n // 100)) + n) // (100 + percent))
            for at in range(0, len(node.part), 128):
                if overlap + min(n - before, node.most - depth - at) < need:
                    break
                step = node.part[at : at + 128]
                place = np.searchsorted(probe, step)
                hit = (place < n) & (probe[np.minimum(place, n - 1)] == step)
                overlap += int(np.count_nonzero(hit))
                before = int(place[-1]) + int(hit[-1])
            else:
                depth += len(node.part)
                if overlap + min(n - before, node.most - depth) < need:
                    continue
                for number in node.ends:
                    if (100 + percent) * overlap >= percent * (depth + n) and not passed_over(number):
                        yield number
                stack += [(x, depth, overlap, before) for x in node.below.values()]


def clustered(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each ordered set the number of a set of its component, by walks of a growing trie."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree = None
    for i, own in enumerate(sets):
        if tree is None:
            tree = PrefixTree(own[:0], len(own), i)
        else:
            for j in tree.links(own, percent, lambda x, i=i: root(x) == root(i), root):
                parent[root(j)] = root(i)
        tree.add(own, i, root)
    return [root(i) for i in range(len(sets))]


def _dealt(rows: DataFrame, texts, k: int, levels, each, schema: str) -> DataFrame:
    """What ``each`` gives for the sets of a group: ``rows`` (key, salt, role, sid) meet their texts; ``texts`` gives (sid, text) of a table of sids.

    ``each``: (roles, sids, ordered sets) to rows (a, b). A group beyond TREE_SETS sets or
    TREE_SHINGLES shingles comes in parts, each with the sets of role 0.
    """
    rows = shared_table(rows, "sides")
    # while the rows are few, the texts stay where they are read and only those asked for move
    found = texts(rows.select("sid").distinct()).join(bounded(rows), "sid").select("key", "salt", "role", "sid", "text")

    def run(batches):
        at, held, size, pairs = None, [], 0, []

        def flush(again: bool):
            nonlocal held, size
            if any(role for role, _, _ in held):
                pairs.extend(each(*map(list, zip(*held, strict=True))))
            held = [x for x in held if again and x[0] == 0][: TREE_SETS // 4]
            size = sum(len(x[2]) for x in held)

        def sent():
            a, b = zip(*pairs, strict=True)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for part, data, offsets in text_blocks(batches, "text", BLOCK):
            ranks, of = _ordered(*shingles(data, offsets, k), levels.value)
            cut = np.searchsorted(of, np.arange(part.num_rows + 1))
            keys = zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
            for i, (key, salt, role, sid) in enumerate(keys):
                if (key, salt) != at:
                    flush(False)
                    at = (key, salt)
                elif len(held) >= TREE_SETS or size >= TREE_SHINGLES:
                    flush(True)
                held.append((role, sid, ranks[cut[i] : cut[i + 1]].copy()))
                size += int(cut[i + 1] - cut[i])
            if pairs:
                yield sent()
        flush(False)
        if pairs:
            yield sent()

    return found.repartition("key", "salt").sortWithinPartitions("key", "salt", "role").mapInArrow(run, schema)


def _signed(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """``rows`` with the signatures of their sets."""
    columns = [f"s{i}" for i in range(SIGNS)]
    return rows.join(bounded(signs.select("sid", *columns)), "sid").select(*rows.columns, *columns)


def _signs(table: pa.Table, first: int) -> np.ndarray:
    return np.stack([table.column(first + i).to_numpy() for i in range(SIGNS)], axis=1).view(np.uint64)


def _groups_of(batches, keys: int, most: int = 50_000):
    """Tables of whole groups of batches that are sorted by their first ``keys`` columns, each with where its groups begin, and their end."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, most
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.num_rows
        if size and (batch is None or size >= enough):
            table = pa.Table.from_batches(held).combine_chunks()
            first = np.append(True, np.logical_or.reduce([np.diff(table.column(i).to_numpy()) != 0 for i in range(keys)]))
            edge = np.append(np.flatnonzero(first), len(first))
            if batch is not None:
                held = table.slice(int(edge[-2])).to_batches()  # the last group may go on
                edge = edge[:-1]
            size = len(first) - int(edge[-1])
            enough = max(most, 2 * size)
            if len(edge) > 1:
                yield table, edge


def _screened(rows: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The rows (key, salt, role, sid) that sizes and signatures let link with another of their part; role 0 always stays."""

    def run(batches):
        for table, edge in _groups_of(batches, 2):
            n, sign, keep = table.column(4).to_numpy(), _signs(table, 5), table.column(2).to_numpy() == 0
            for b, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                for at in range(b, e, 4 * TREE_SETS):  # parts are about TREE_SETS sets
                    m = slice(at, min(e, at + 4 * TREE_SETS))
                    for i in range(m.start, m.stop):
                        if not keep[i]:
                            apart = np.bitwise_count(sign[m] ^ sign[i]).sum(1, dtype=np.int64)
                            sizes = n[m] + n[i]
                            near = ((100 + percent) * (sizes - apart) >= 2 * percent * sizes) & (100 * n[m] >= percent * n[i]) & (100 * n[i] >= percent * n[m])
                            near[i - at] = False
                            keep[m] |= near
                            keep[i] |= near.any()
            if keep[: edge[-1]].any():
                yield from table.slice(0, int(edge[-1])).filter(pa.array(keep[: edge[-1]])).select(range(4)).to_batches()

    sized = _signed(rows.join(bounded(signs.select("sid", "size")), "sid").select("key", "salt", "role", "sid", "size"), signs)
    return sized.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, "key long, salt int, role int, sid long")


def _first_links(postings: DataFrame, signs: DataFrame, texts, k: int, percent: int, levels) -> DataFrame:
    """Links (a, b) between sets that meet in one of the KEYS groups of each, enough of them to join what a group joins."""
    chosen = postings.groupBy("sid").agg(F.array_distinct(F.array(*[F.min_by("token", F.xxhash64("token", F.lit(i))) for i in range(KEYS)])).alias("keys"))
    keyed = shared_table(chosen.select("sid", F.explode("keys").alias("key")), "set-keys")
    turn = [F.min_by("sid", F.xxhash64("sid", F.lit(i))) for i in range(ANCHORS)]
    groups = keyed.groupBy("key").agg(F.count("*").alias("m"), F.array_distinct(F.array(*turn)).alias("anchors")).where("m > 1")
    groups = groups.select("key", "anchors", F.ceil(F.col("m") / (TREE_SETS - ANCHORS)).cast("int").alias("salts"))
    joined = keyed.join(groups, "key")
    own = joined.where((F.col("salts") == 1) | ~F.array_contains("anchors", F.col("sid")))
    own = own.select("key", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "sid")
    parts = groups.where("salts > 1").select("key", "anchors", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    anchors = parts.select("key", "salt", F.lit(0).alias("role"), F.explode("anchors").alias("sid"))

    def each(roles, sids, sets):
        return [(sid, sids[to]) for sid, to in zip(sids, clustered(sets, percent), strict=True) if sid != sids[to]]

    return _dealt(_screened(own.unionByName(anchors), signs, percent), texts, k, levels, each, "a long, b long")


def _tested(pairs: DataFrame, texts, k: int, percent: int, levels) -> DataFrame:
    """The pairs (a, b) that link. The candidates of a set b are dealt over as many tasks as they need."""
    salts = pairs.groupBy(F.col("b").alias("key")).agg(F.ceil(F.count("*") / (4 * TREE_SETS)).cast("int").alias("salts"))
    rows = (
        pairs.join(salts, F.col("b") == F.col("key")).select("key", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("a").alias("sid"))
        .unionByName(salts.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("key").alias("sid")))
    )

    def each(roles, sids, sets):
        tree = PrefixTree(sets[1][:0], len(sets[1]), 1)
        for i in range(1, len(sets)):
            tree.add(sets[i], i, lambda x: x)
        return [(sids[i], sids[0]) for i in tree.links(sets[0], percent)]

    return _dealt(rows, texts, k, levels, each, "a long, b long")


def _candidates(held: DataFrame, groups: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that all bounds leave. ``held``: token, sid, n, pos, label; ``groups``:
    token, main (its largest component), all (its members).

    Up to the end of the prefix that ends first all common shingles are in both prefixes, where their number, met, is
    counted; behind it that set has at most ceil(percent * n / 100) - 1.
    """
    rows = held.join(bounded(groups), "token").withColumn("salts", F.ceil(F.col("all") / MEMBERS).cast("int")).withColumn("home", F.pmod(F.xxhash64("sid"), "salts").cast("int"))
    everywhere = F.when(F.col("label") != F.col("main"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("home"))
    rows = _signed(rows.select("token", F.explode(everywhere).alias("salt"), "home", "sid", "n", "pos", "label", "main"), signs)

    def run(batches):
        for table, edge in _groups_of(batches, 2):
            token, salt, home, sid, n, pos, label, main = (table.column(i).to_numpy() for i in range(8))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            sign, found = _signs(table, 8), []
            for b, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                mine = b + np.flatnonzero(home[b:e] == salt[b])
                for p in (b + np.flatnonzero(label[b:e] != main[b])).tolist():
                    m = mine[(label[mine] != label[p]) & ((label[mine] == main[p]) | (sid[p] > sid[mine]))]
                    m = m[(100 * n[m] >= percent * n[p]) & (100 * n[p] >= percent * n[m])]
                    rest, before = np.minimum(n[m] - pos[m], n[p] - pos[p]), np.minimum(pos[m], pos[p])
                    m = m[(100 + percent) * (rest + before) >= percent * (n[m] + n[p])]
                    apart = np.bitwise_count(sign[m] ^ sign[p]).sum(1, dtype=np.int64)
                    m = m[(100 + percent) * (n[m] + n[p] - apart) >= 2 * percent * (n[m] + n[p])]
                    if len(m):
                        found.append(np.stack([np.maximum(sid[m], sid[p]), np.minimum(sid[m], sid[p]), n[m] + n[p], np.maximum(n[m], n[p])], axis=1))
            if found:
                pairs, met = np.unique(np.concatenate(found), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, i]) for i in range(4)), pa.array(met)], names=["a", "b", "both", "larger", "met"])

    met = rows.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(run, "a long, b long, both long, larger long, met long")
    met = met.groupBy("a", "b", "both", "larger").agg(F.sum("met").alias("met"))
    rest = F.ceil(percent * F.col("larger") / 100) - 1
    return met.where((100 + percent) * (F.col("met") + rest) >= percent * F.col("both")).select("a", "b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of the nodes of the edges (a, b); label: the smallest node of the component.

    Least labels go over edges and along labels, so distances halve from round to round. While the edges,
    counted, are few enough, labels are broadcast, a round shuffles once and few tasks write.
    """
    few = edges.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
    kept = lambda df, name: shared_table(df.coalesce(FEW_TASKS) if few else df, name)
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        known = F.broadcast(labels) if few else labels
        over = both.join(known, both["b"] == known["node"]).groupBy("a").agg(F.min("label").alias("least"))
        near = over.join(known, known["node"] == over["a"]).select("node", "label", F.least("label", "least").alias("next"))
        far = known.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        far = F.broadcast(far) if few else far
        stepped = near.join(far, near["next"] == far["via"], "left").select("node", "label", F.least("next", F.coalesce("beyond", "next")).alias("next"))
        new = kept(stepped, "labels")
        changed = new.where("next < label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("components did not converge")


def text_hashes(text: Column) -> tuple[Column, Column]:
    """With the id, the key of a row."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def join_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return keyed_components(docs, **options).select("doc_id", "n_shingles", "component_id")


def keyed_components(docs: DataFrame, *, words_per_shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``join_components`` has, with each row's text hashes t1 and t2 and the label of its component.

    The label tells components apart that share an id or have none; it is null for rows without a shingle.
    """
    spark, k = docs.sparkSession, words_per_shingle
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", *text_hashes(docs["text"]), "text")
    found = shared_table(_sets(docs, k), "shingle-sets")
    sets = found.where("kind = 0").select("doc_id", "t1", "t2", "sid", "n")
    n_tokens = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = spark.sparkContext.broadcast(_levels(found.where("kind = 1").select("chunk", "counts"), n_tokens / SKETCH))

    def with_sid(batches):
        for part, data, offsets in text_blocks(batches, "text", BLOCK):
            hashes, of = shingles(data, offsets, k)
            n = np.bincount(of, minlength=part.num_rows)
            sid = set_ids(hashes, n)
            ranks, of = _ordered(hashes, of, levels.value)
            pos = np.arange(len(of)) - (np.cumsum(n) - n)[of]
            first = np.zeros(part.num_rows, bool)  # of equal sets in a block one is enough
            first[np.unique(sid, return_index=True)[1]] = True
            keep = first[of] & (pos <= n[of] - -(-percent * n[of] // 100))
            yield pa.RecordBatch.from_arrays([pa.array(ranks[keep].view(np.int64)), pa.array(sid[of[keep]]), pa.array(n[of[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["token", "sid", "n", "pos"])

    prefixes = docs.select("text").mapInArrow(with_sid, "token long, sid long, n int, pos int")
    live = prefixes.select("token", "sid").groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("token")
    postings = shared_table(prefixes.join(live, "token", "left_semi").distinct(), "postings")
    rep = found.where("kind = 0").groupBy("sid").agg(F.min(F.struct("doc_id", "t1", "t2", *[f"s{i}" for i in range(SIGNS)], F.col("n").alias("size"))).alias("rep"))
    candidates = shared_table(postings.select("sid").distinct().join(rep, "sid").select("sid", "rep.*"), "candidates")
    repeated = not sets.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()

    def texts(sids: DataFrame) -> DataFrame:
        wanted = shared_table(candidates.join(bounded(sids), "sid", "left_semi").select("sid", "doc_id", "t1", "t2"), "wanted").alias("w")
        same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.t1") == F.col("w.t1")) & (F.col("d.t2") == F.col("w.t2"))
        got = docs.alias("d").join(bounded(wanted), same).select("w.sid", "d.text")
        return got.dropDuplicates(["sid"]) if repeated else got  # one of the rows equal in id and text

    links = shared_table(_first_links(postings, candidates, texts, k, percent, levels), "first-links")
    labels = components(links)
    held = postings.join(bounded(labels), postings["sid"] == labels["node"], "left").select("token", "sid", "n", "pos", F.coalesce("label", "sid").alias("label"))
    by_label = held.groupBy("token", "label").agg(F.count("*").alias("m"))
    groups = by_label.groupBy("token").agg(F.sum("m").alias("all"), F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("most")).where("all > most").select("token", "main", "all")
    pairs = shared_table(_candidates(held, shared_table(groups, "groups"), candidates, percent), "pairs")
    more = shared_table(_tested(pairs, texts, k, percent, levels), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    placed = sets.join(bounded(labels), sets["sid"] == labels["node"], "left").select("doc_id", "t1", "t2", "n", F.coalesce("label", "sid").alias("label"))
    least = placed.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "t1", "t2", F.when(F.col("n") > 0, F.col("label")).alias("label"),
    )
