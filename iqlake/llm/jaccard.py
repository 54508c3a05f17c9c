"""N-gram Jaccard join with signature trees.

Documents are sets of word n-grams; those that reach the threshold are linked, and the result is the classes of linked
documents. Exact at every step:

1. A link leaves at most (1 - t) of a set's n-grams unshared. Chunks ask about one third of their n-grams (by fingerprint)
   in how many chunks they occur; a document with more unshared ones than that allows has no link.
2. Of the others, equal sets become one node. Nodes that share an n-gram of their prefixes (rarest first, long enough that
   any link shares one) are candidates; connected candidates form a group.
3. A group's nodes become the leaves of a signature tree: inner nodes hold OR-combined bitmaps of their n-grams and the range
   of their sizes. The tree is traversed against itself, and a pair of inner nodes is dropped when the largest overlap that
   their bitmaps allow is below the least that their sizes need, or when all below are in one class already. Leaves that are
   left are compared exactly.

A group of more than ``BLOCK`` nodes is dealt over blocks, bounded in nodes and bytes, by the rarest shared n-gram, so that
like nodes mostly meet in one. Each block is joined with itself, classes are joined by their pivots, and a node that is then
not in the group's largest class goes to just those other blocks that hold a node with an n-gram of its prefix and a size
that it can link with, where it meets their trees. No task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.llm.chunks import ask, bounds_of, chunk_rows, chunk_texts, cut, joined, make_chunks, read_answers, save_answers, total_bytes, with_answers
from iqlake.llm.common import Scratch, hottest, split_join
from iqlake.llm.components import components
from iqlake.llm.substring import _columns
from iqlake.llm.textcore import U, Texts, mix, tidy, window_docs, windows_hash

WIDTH, PERCENT = 5, 80
BLOCK, FAN, BITS = 1024, 4, 1 << 15
#: Bytes of sets in a block.
BLOCK_BYTES = 16 << 20
PER_BUCKET = 32 << 20
_THIRD = U((1 << 64) // 3)


def shingles(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram fingerprints of each document, ascending within it, and where each document's begin (and the end)."""
    t.lower_ascii()
    t.words()
    h = t.hashes()
    n = np.diff(t.at)
    starts, doc = window_docs(t.at, width)
    keys = windows_hash(h, width)[starts] if len(starts) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.array([int(mix(windows_hash(h[t.at[d] : t.at[d + 1]], int(n[d])) ^ U(0xA5A5 + int(n[d])))[0]) for d in short], np.uint64)
        keys, doc = np.concatenate([keys, whole]), np.concatenate([doc, short])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(n) + 1))


def allowed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many n-grams of a set of n may be missing from a linked one."""
    return n - -(-n * percent // 100)


class Tree:
    """A signature tree over sets: levels[0] are the sets, levels[k] cover FAN ** k of them."""

    def __init__(self, sets: list[np.ndarray], longest: np.int64 = np.int64(0)) -> None:
        self.sets = sets
        n = np.array([len(s) for s in sets])
        bits = min(BITS, 1 << max(6, (8 * max(longest, n.max())).item().bit_length()))
        flag = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(sets):
            b = np.zeros(bits, bool)
            b[(s & U(bits - 1)).astype(np.int64)] = True
            flag[i] = np.packbits(b)
        maps = flag.view(np.uint64)
        lost = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, n, n, lost)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))

    def spans(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return i * FAN**level, np.minimum((i + 1) * FAN**level, len(self.sets))


class Classes:
    """Union-find over indices, kept flat."""

    def __init__(self, labels: np.ndarray) -> None:
        self.label = labels

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)

    def uniform(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The class of each range if it is one, else -1."""
        change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        return np.where(change[high - 1] == change[low], self.label[low], -1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def traverse(x: Tree, y: Tree, offset: int, classes: Classes, percent: int, found: Callable[[int, int], None]) -> None:
    """Links between leaves of ``x`` and of ``y`` (the same tree if offset is 0) whose classes differ; ``y``'s leaves are classed from ``offset``."""
    level = max(len(x.levels), len(y.levels)) - 1
    i = np.zeros(1, np.int64)
    j = np.zeros(1, np.int64)
    while len(i):
        lx, ly = min(level, len(x.levels) - 1), min(level, len(y.levels) - 1)
        mx, lowx, highx, lostx = x.levels[lx]
        my, lowy, highy, losty = y.levels[ly]
        ax, bx = x.spans(lx, i)
        ay, by = y.spans(ly, j)
        one = classes.uniform(ax, bx)
        other = classes.uniform(ay + offset, by + offset)
        keep = ((one != other) | (one < 0)) & (100 * highx[i] >= percent * lowy[j]) & (100 * highy[j] >= percent * lowx[i])
        if offset == 0:
            keep &= ~((lx == 0) & (i == j))
        i, j = i[keep], j[keep]
        # 100 both >= percent (a + b - both), so both >= percent (a + b) / (100 + percent).
        need = -(-percent * (lowx[i] + lowy[j]) // (100 + percent))
        most = np.empty(len(i), np.int64)
        for k in range(0, len(i), 2048):
            most[k : k + 2048] = np.bitwise_count(mx[i[k : k + 2048]] & my[j[k : k + 2048]]).sum(1, dtype=np.int64)
        keep = most + np.minimum(lostx[i], losty[j]) >= need
        i, j = i[keep], j[keep]
        if level == 0:
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if classes.label[p] != classes.label[q + offset] and linked(x.sets[p], y.sets[q], percent):
                    classes.join(p, q + offset)
                    found(p, q)
            return
        kids = []
        for tree, at, node in ((x, lx, i), (y, ly, j)):
            if at == level:
                kid = node[:, None] * FAN + np.arange(FAN)[None, :]
                kids.append((kid, kid < len(tree.levels[at - 1][0])))
            else:
                kids.append((node[:, None], np.ones((len(node), 1), bool)))
        (kx, okx), (ky, oky) = kids
        ii = np.repeat(kx[:, :, None], ky.shape[1], 2)
        jj = np.repeat(ky[:, None, :], kx.shape[1], 1)
        ok = okx[:, :, None] & oky[:, None, :]
        if offset == 0:
            ok &= ii <= jj
        i, j = ii[ok], jj[ok]
        level -= 1


def join_self(keys: list[bytes], sets: list[np.ndarray], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Each key with the least key of its class."""
    order = sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), len(sets[k])))
    sets = [sets[k] for k in order]
    classes = Classes(np.arange(len(sets)))
    pivot = 0
    for k in range(1, len(sets)):
        # Neighbours by least fingerprint are often alike; so are many and one pivot.
        for p in {k - 1, pivot}:
            if classes.label[p] != classes.label[k] and linked(sets[p], sets[k], percent):
                classes.join(p, k)
        if k % 64 == 0:
            pivot = int(np.argmax(np.bincount(classes.label)))
    tree = Tree(sets)
    traverse(tree, tree, 0, classes, percent, lambda p, q: None)
    least: dict[int, bytes] = {}
    for k, c in enumerate(classes.label.tolist()):
        least[c] = min(least.get(c, keys[order[k]]), keys[order[k]])
    for k, c in enumerate(classes.label.tolist()):
        yield keys[order[k]], least[c]


def join_two(left: list[tuple], right: list[tuple], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links that join the classes of ``left`` and ``right``, lists of (key, label, set)."""
    names: dict[bytes, int] = {}
    labels = np.array([names.setdefault(r[1], len(names)) for r in left + right])
    classes, out = Classes(labels), []
    longest = np.int64(max(len(r[2]) for r in left + right))
    traverse(Tree([r[2] for r in left], longest), Tree([r[2] for r in right], longest), len(left), classes, percent, lambda p, q: out.append((left[p][0], right[q][0])))
    yield from out


def _tasks(task: Callable[[list[tuple]], Iterator[tuple[bytes, bytes]]], n_key: int):  # noqa: ANN202
    """For rows sorted by their first ``n_key`` columns: (a, b) pairs of each run of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def pack() -> pa.RecordBatch:
            pairs = list(task(rows))
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:n_key] != key:
                    if rows:
                        yield pack()
                    key, rows = row[:n_key], []
                rows.append(row[n_key:])
        if rows:
            yield pack()

    return run


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _blocks() -> Column:
    """How many blocks the counted nodes (n, bytes) make."""
    return F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("long")


def _placed(nodes: DataFrame, groups: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, block, k, size, set, prefix) of groups of one block, and of larger ones."""
    named = groups.select(F.col("node").alias("k"), F.col("label").alias("g"))
    # The same set from several chunks meets here, where the join has dealt it already.
    one = nodes.join(named, "k").groupBy("k").agg(*[F.first(c).alias(c) for c in ("set", "prefix", "g")])
    one = scratch.save(one.select("g", "k", F.octet_length("set").alias("size"), "set", "prefix"), "grouped")
    sizes = one.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select("g", "n", _blocks().alias("blocks"))
    sizes = scratch.save(sizes, "sizes")
    large = sizes.filter("blocks > 1").select("g", "blocks")
    if large.isEmpty():
        one = one.withColumn("block", F.lit(0).cast("long"))
        return one, one.limit(0)
    sized = split_join(one, large, "g", "left")
    small = sized.filter("blocks is null").drop("blocks").withColumn("block", F.lit(0).cast("long"))
    many = scratch.save(sized.filter("blocks is not null").withColumn("t", F.xxhash64("g", F.get("prefix", F.lit(0)))), "many")
    # Nodes of one rarest n-gram stay together unless they fill blocks by themselves.
    alike = many.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select("t", _blocks().alias("parts"))
    dealt = split_join(many, alike.filter("parts > 1"), "t", "left")
    block = F.when(F.col("parts").isNull(), F.pmod("t", F.col("blocks") * 2)).otherwise(F.xxhash64("t", F.pmod(F.xxhash64("k"), F.col("parts"))))
    return small, scratch.save(dealt.withColumn("block", block).drop("t", "blocks", "parts"), "dealt")


def _links(nodes: DataFrame, groups: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) whose components are the classes of ``nodes`` (k, set, prefix; a k may repeat) in ``groups`` (node, label)."""
    small, large = _placed(nodes, groups, scratch)

    def own(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        return join_self([r[0] for r in rows], [_set(r[1]) for r in rows], percent)

    def self_join(df: DataFrame) -> DataFrame:
        dealt = df.select("g", "block", "k", "set").repartition("g", "block").sortWithinPartitions("g", "block")
        return dealt.mapInArrow(tidy(_tasks(own, 2)), "a binary, b binary")

    columns = ["g", "block", "k", "set"]
    stars = scratch.save(self_join(small.select(*columns).union(large.select(*columns))), "stars")
    if large.isEmpty():
        return stars
    pivots = scratch.save(large.join(stars.select(F.col("b").alias("k")).distinct(), "k", "left_semi"), "pivots")
    count = pivots.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select("g", _blocks().alias("n"))
    again = scratch.save(self_join(split_join(pivots, count, "g").select("g", F.pmod(F.xxhash64("k", F.lit(1)), F.col("n")).alias("block"), "k", "set")), "again")
    links = stars.union(again)
    labels = components(links.filter("a <> b"), scratch, "inner")
    labelled = large.join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    labelled = scratch.save(labelled, "labelled")
    sizes = labelled.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    major = sizes.groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("major"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0").select("g", "major")
    open_ = scratch.save(split_join(labelled, major, "g"), "open")
    routes = scratch.save(_routes(open_, percent), "routes")
    parts = routes.groupBy("g", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select("g", "block", _blocks().alias("parts"))
    sent = routes.join(parts, ["g", "block"]).select("k", "g", "block", F.pmod(F.xxhash64("k", F.lit(2)), F.col("parts")).alias("part"))
    few = sent.join(open_.select("k", "label", "set"), "k").select("g", "block", "part", F.lit(0).alias("side"), "k", "label", "set")
    met = open_.join(parts, ["g", "block"]).select("g", "block", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(1).alias("side"), "k", "label", "set")

    def across(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        left, right = ([(k, label, _set(raw)) for side, k, label, raw in rows if side == s] for s in (0, 1))
        return join_two(left, right, percent) if left and right else iter(())

    dealt = few.union(met).repartition("g", "block", "part").sortWithinPartitions("g", "block", "part", "side")
    return links.union(scratch.save(dealt.mapInArrow(tidy(_tasks(across, 3)), "a binary, b binary"), "across"))


def _routes(nodes: DataFrame, percent: int) -> DataFrame:
    """(k, size, g, block): for nodes outside their group's largest class, the other blocks that hold a node they may link with.

    Linked sets share an n-gram of their prefixes and differ in size by no more than the threshold allows, so a block is left
    out if no node in it has one of these n-grams at a size in range. N-grams meet block by block, not node by node.
    """
    words = nodes.select("g", "block", "k", "size", "label", "major", F.explode("prefix").alias("token"))
    held = words.groupBy("token", "g", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    few = words.filter("label <> major").select("token", "g", F.col("block").alias("own"), "k", "size")
    near = (100 * F.col("size") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("size"))
    return few.join(held, ["token", "g"]).filter((F.col("own") != F.col("block")) & near).select("k", "size", "g", "block").distinct()


def jaccard_classes(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id.

    A text's set: its distinct sequences of ``width`` words, A-Z lower-cased; with fewer words, the whole sequence. Two rows
    link when their sets' Jaccard similarity is at least ``percent`` per cent; component_id is the smallest id that links
    reach, the row's own included. Null, empty and blank texts have no set and link with nothing. A null id is never a
    component's smallest unless all are null; repeated rows are linked with each other. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "jaccard")
    _, rows = _classes(df.select(id_col, text_col), scratch, width, percent, id_col, text_col)
    out = scratch.keep(rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id")))
    scratch.drop()
    return out


def keep_one(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each class, its columns unchanged.

    It is the row with the smallest id (null is largest), and of several rows with that id any one. A row is judged by its own
    text, whatever other texts have its id. Rows without words are classes of their own. Columns may have any names.
    """
    scratch = Scratch(df.sparkSession, "jaccard")
    chunks, rows = _classes(df, scratch, width, percent, id_col, text_col)
    gone = rows.filter((F.col("chunk") != F.col("first.chunk")) | (F.col("place") != F.col("first.place"))).groupBy("chunk").agg(F.collect_list("place").alias("gone"))
    gone = scratch.save_by(gone, "gone", "chunk")
    scratch.only("chunks", "gone")
    return chunk_rows(chunks.join(gone.hint("shuffle_hash"), "chunk", "left"), df, text_col, "gone")


def _classes(df: DataFrame, scratch: Scratch, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``df``, and for each row (chunk, place, id, n, first), first being (none, id, chunk, place) of its class's least row."""
    kind = df.schema[id_col].dataType.simpleString()
    chunks = make_chunks(df, scratch, id_col, text_col)
    buckets = max(1, -(-total_bytes(chunks) // PER_BUCKET))

    def third(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(keys[keys < _THIRD], return_counts=True)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, texts, n_bytes in _columns(batch, "chunk", "sizes", "texts", "n_bytes"):
                keys, _ = third(shingles(chunk_texts(sizes, texts, n_bytes), width)[0])
                at = bounds_of(keys * U(3), buckets)
                full = np.flatnonzero(np.diff(at) > 0)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "keys": pa.array([cut(keys[at[b] : at[b + 1]], 6) for b in full], pa.binary())})

    def how_many(_: list[int], rows: list[tuple]) -> list[np.ndarray]:
        _, back, count = np.unique(joined([r[0] for r in rows], 6), return_inverse=True, return_counts=True)
        rare = np.searchsorted([2, 4, 16, 64], count, "right").astype(np.uint8)
        return np.split(rare[back], np.cumsum([len(r[0]) // 6 for r in rows])[:-1])

    slim = chunks.select("chunk", "sizes", "texts", "n_bytes")
    shared = save_answers(ask(slim.mapInArrow(tidy(asked), "bucket int, chunk long, keys binary"), buckets, how_many, ["keys"]), scratch, "shared")

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_at = batch.column(batch.schema.get_field_index(f"c_{id_col}"))
            for row, (chunk, sizes, texts, n_bytes, told) in enumerate(_columns(batch, "chunk", "sizes", "texts", "n_bytes", "shared")):
                keys, at = shingles(chunk_texts(sizes, texts, n_bytes), width)
                n = np.diff(at)
                known, count = third(keys)
                rank = read_answers(told)
                rank = np.where(rank > 0, rank, count > 1).astype(np.int64) if len(rank) else (count > 1).astype(np.int64)
                inside = keys < _THIRD
                cls = np.full(len(keys), 9)
                cls[inside] = rank[np.searchsorted(known, keys[inside])]
                lonely = np.concatenate([[0], np.cumsum(cls == 0)])
                spare = allowed(n, percent)
                alive = (n > 0) & (lonely[at[1:]] - lonely[at[:-1]] <= spare)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys * U(c)))]) for c in (3, 5)]
                k = np.stack([mix(s[at[1:]] - s[at[:-1]] + n.astype(np.uint64)) for s in sums], 1).astype("<u8")
                names = [x.tobytes() for x in k]
                first: set[bytes] = set()
                prefix: list = []
                sets: list = []
                for d in range(len(n)):
                    if not alive[d] or names[d] in first:
                        prefix.append(None)
                        sets.append(None)
                        continue
                    first.add(names[d])
                    own, c = keys[at[d] : at[d + 1]], cls[at[d] : at[d + 1]]
                    head = np.lexsort((own, c))[: int(spare[d]) + 1]
                    prefix.append(own[head[c[head] > 0]].view(np.int64))
                    sets.append(own.astype("<u8").tobytes())
                ids = ids_at[row].values
                # A name only for those that may be linked; others are alone.
                for lo in range(0, len(n), 2048):
                    hi = min(len(n), lo + 2048)
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * (hi - lo), pa.int64()), "place": pa.array(range(lo, hi), pa.int32()), "id": ids.slice(lo, hi - lo), "n": pa.array(n[lo:hi], pa.int64()), "k": pa.array([x if y else None for x, y in zip(names[lo:hi], alive[lo:hi], strict=True)], pa.binary()), "prefix": pa.array(prefix[lo:hi], pa.list_(pa.int64())), "set": pa.array(sets[lo:hi], pa.binary())})

    told = with_answers(chunks.select("chunk", "sizes", "texts", "n_bytes", f"c_{id_col}"), shared, "shared")
    docs = scratch.save(told.mapInArrow(tidy(survivors), f"chunk long, place int, id {kind}, n long, k binary, prefix array<long>, set binary"), "docs")
    scratch.drop("shared")
    # Equal sets have equal prefixes: ranks of n-grams are global. Sets themselves move only if they are in a group.
    tokens = docs.select("k", F.explode("prefix").alias("token"))
    shared_by = tokens.groupBy("token").agg(F.min("k").alias("m"), F.max("k").alias("x"), F.count(F.lit(1)).alias("n")).filter("m <> x")
    shared_by = scratch.save(shared_by.select("token", "m", "n"), "tokens")
    pairs = split_join(tokens, shared_by.select("token", "m"), "token", hot=hottest(shared_by, "token", "n"))
    groups = components(pairs.filter("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b")).distinct(), scratch, "candidates")
    links = _links(docs.filter("set is not null").select("k", "set", "prefix"), groups, scratch, percent).filter("a <> b")
    labels = components(links, scratch, "classes")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "chunk", "place")
    best = docs.filter("k is not null").groupBy("k").agg(F.min(row).alias("low"), F.count(F.lit(1)).alias("rows"))
    classed = best.join(labels.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    classed = scratch.save(classed, "classed")
    least = classed.groupBy("label").agg(F.min("low").alias("first"))
    by_key = scratch.save(split_join(classed, least, "label").select("k", "first", "rows"), "by_key")
    columns = ["chunk", "place", "id", "n"]
    alone = docs.filter("k is null").select(*columns, row.alias("first"))
    others = split_join(docs.filter("k is not null").select(*columns, "k"), by_key.select("k", "first"), "k", hot=hottest(by_key, "k", "rows"))
    return chunks, alone.union(others.select(*columns, "first"))
