"""SentencePiece encoding and decoding through a relational lattice.

Text is cut into units that no piece can span: between two characters that are next to each other in no piece. The distinct
units of the whole table are segmented once: their substrings of bounded length are exploded and equi-joined to the piece
table (a vocabulary, broadcast under a checked bound), which gives the edges of each unit's lattice; the edges are grouped by
unit and folded from left to right with a higher-order ``aggregate`` that keeps one state, with its back pointer, for each
boundary. The grouping needs no shuffle, as units are already dealt. Chunks of documents then fetch the ids of their units.

The fold is Viterbi. For a unigram model an edge relaxes the state of its end if its score is better. A BPE model's own
segmentation is not that of the best sum of scores, so its relaxation is another: an edge may follow the last edge of the
state where it starts if no merge would have crossed the boundary between the two first. A segmentation is the model's if
and only if that holds for each two neighbours, so exactly one edge into each boundary passes, and the path is the model's.
When a merge happens inside a piece is known from the piece alone (``spines``); a crossing merge is an edge of the lattice.

An edge is one BIGINT: its end, 255 less its length (so that longer edges into a boundary come first), its piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iqlake.llm.chunks import ask, by_bucket, chunk_parts, make_chunks, total_bytes, with_answers
from iqlake.llm.common import Scratch
from iqlake.llm.substring import _columns
from iqlake.llm.textcore import Texts, distinct, eights, ragged, spans_hash

SPACE = "▁"
MOST_PIECES = 1 << 20
#: The rank of a merge that never happens.
NEVER = (1 << 31) - 1
#: The piece of an edge over a character that is no piece.
UNKNOWN = (1 << 24) - 1
#: Edges of a block of the fold, and steps of a block of its way back.
EDGES, STEPS = 64, 256
#: Text whose units one bucket answers.
PER_BUCKET = 16 << 20
#: Bytes of distinct units in a partition, and units whose edges a task groups by hash; beyond it Spark sorts them.
PER_PARTITION, HASHED_UNITS, MOST_PARTITIONS = 1 << 18, 50_000, 100_000


@dataclass(frozen=True)
class Model:
    """What a SentencePiece model file says: pieces with scores, ids of byte pieces, and the kind of fold."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    unknown: int = 0

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError("only the identity normaliser with a dummy prefix is known")
        if m.trainer_spec.model_type not in (1, 2) or m.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in m.pieces):
            raise ValueError("an unknown kind of model")
        return Model([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 2, next(i for i, p in enumerate(m.pieces) if p.type == 2))

    def plain(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1}

    def byte_ids(self) -> list[int] | None:
        got = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == 6}
        return [got[f"<0x{b:02X}>"] for b in range(256)] if len(got) == 256 else None

    def spelled(self) -> list[bytes]:
        """The bytes that each id decodes to, spaces as spaces; control pieces are empty."""
        of_byte = {i: b for b, i in enumerate(self.byte_ids() or [])}
        return [bytes([of_byte[i]]) if i in of_byte else b" \xe2\x81\x87 " if k == 2 else p.replace(SPACE, " ").encode() if k == 1 else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]


def _ranks(model: Model) -> dict[str, int]:
    plain = model.plain()
    order = {s: k + 1 for k, s in enumerate(sorted({model.scores[i] for i in plain.values()}, reverse=True))}
    return {p: order[model.scores[i]] for p, i in plain.items()}


def spines(model: Model) -> dict[str, tuple[list[int], list[int]]]:
    """For each piece that a BPE model reaches: by length of a prefix, and of a suffix, the rank of the merge that ends it.

    A prefix counts if it is a symbol at some time while the piece is built (the piece itself is never ended); 0 elsewhere.
    """
    plain, rank = model.plain(), _ranks(model)
    out: dict[str, tuple[list[int], list[int]]] = {}
    for piece in plain:
        left, right = [0] * len(piece), [0] * len(piece)
        parts, last = [(k, k + 1) for k in range(len(piece))], 0
        while len(parts) > 1:
            best = min(((rank[piece[x[0] : y[1]]], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if piece[x[0] : y[1]] in rank), default=None)
            if best is None:
                break
            r, k = best
            if r < last:
                raise ValueError("merges of a piece are not in the order of their scores")
            last = r
            if k == 0:
                left[parts[0][1] - 1] = r
            if k == len(parts) - 2:
                right[len(piece) - parts[-1][0] - 1] = r
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]
        if len(parts) == 1:
            left[-1] = right[-1] = NEVER
            out[piece] = left, right
    return out


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    plain = model.plain()
    if model.bpe:
        plain = {p: plain[p] for p in spines(model)}
    if len(plain) > MOST_PIECES:
        raise ValueError("the piece table is too large to broadcast")
    return spark.createDataFrame(pd.DataFrame({"piece": list(plain), "id": list(plain.values())}), "piece string, id int")


def _numbers(values: list, kind: str = "int") -> Column:
    """A constant array, folded once when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def piece_facts(model: Model) -> Column:
    """What the fold knows of pieces, by id: scores, or ranks and where a piece's spines begin in the arrays ``left`` and ``right``."""
    if not model.bpe:
        worst = min(model.scores) - 10.0  # an unknown character scores below any path of pieces
        return F.struct(_numbers([repr(x) for x in [*model.scores, worst]], "double").alias("score"))
    ranks, plain, of = _ranks(model), model.plain(), spines(model)
    rank, start, left, right = [NEVER] * len(model.pieces), [0] * (len(model.pieces) + 1), [], []
    # The last one stands for an unknown character, which merges with nothing.
    for piece, i in [*plain.items(), (None, len(model.pieces))]:
        if piece is None or piece in of:
            start[i] = len(left)
            one, two = of[piece] if piece is not None else ([NEVER], [NEVER])
            left += one
            right += two
            if piece is not None:
                rank[i] = ranks[piece]
    return F.struct(_numbers(rank).alias("rank"), _numbers(start).alias("start"), _numbers(left).alias("left"), _numbers(right).alias("right"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though lambdas in it read it many times."""
    return F.transform(F.array(value), use)[0]


def _edge(j: Column, size: Column, piece: Column) -> Column:
    return F.shiftleft(j.cast("long"), 32) + F.shiftleft((255 - size).cast("long"), 24) + piece


def _end(e: Column) -> Column:
    return F.shiftright(e, 32).cast("int")


def _size(e: Column) -> Column:
    return 255 - F.shiftright(e, 24).bitwiseAND(F.lit(255)).cast("int")


def _piece(e: Column) -> Column:
    return e.bitwiseAND(F.lit(UNKNOWN)).cast("int")


def _slot(e: Column, unknown: int) -> Column:
    """Where the facts of an edge's piece are."""
    return F.least(_piece(e), F.lit(unknown))


def _from(e: Column) -> Column:
    """Where an edge starts, plus 255: quicker than the difference of its fields."""
    return F.shiftright(e, 32) + F.shiftright(e, 24).bitwiseAND(F.lit(255))


def _start(e: Column) -> Column:
    return _end(e) - _size(e)


def _single(e: Column) -> Column:
    """Whether an edge has one character."""
    return e.bitwiseAND(F.lit(255 << 24)) == F.lit(254 << 24)


def _follows(prev: Column, e: Column, near: Column, facts: Column, unknown: int) -> Column:
    """Whether edge ``e`` may follow edge ``prev``: no edge of ``near`` merges a suffix of one and a prefix of the other while both last.

    Lambdas share no subexpressions, and structs are slow to make in them. So an edge that crosses is first told by numbers: it
    is less than ``e`` (of edges with one end the longer are the lesser), not below any that ends behind the boundary, and
    starts before it. Only then are the edge before and ranks read.
    """

    def place(start: Column) -> Column:
        at = (start - 255).cast("int")

        def test(lowest: Column) -> Column:
            def crosses(c: Column) -> Column:
                def both(p: Column) -> Column:
                    right, left = F.get(facts["start"], _slot(p, unknown)), F.get(facts["start"], _piece(e))
                    rank = F.get(facts["rank"], _piece(c))
                    before = rank < F.get(facts["right"], right + at - 1 - _start(c))
                    return (at - _start(c) <= _size(p)) & before & (rank <= F.get(facts["left"], left - at - 1 + _end(c)))

                return (c < e) & (c >= lowest) & (_from(c) < start) & F.exists(F.array(prev), both)

            return ~F.exists(near, crosses)

        return F.exists(F.array(F.shiftleft(start - 254, 32)), test)

    return F.exists(F.array(_from(e)), place)


def fold(edges: Column, n: Column, model: Model, longest: int) -> Column:
    """The path through the ascending ``edges`` of a unit of ``n`` characters, as edges.

    States of boundaries are kept for as long as an edge may start there; what is behind moves on to ``done`` a block at a
    time, so that a long unit costs no more a character than a short one (but for the copies of ``done``, one a block).
    """
    unknown = len(model.pieces)
    behind, ahead = longest * longest, 2 * longest * longest
    first = F.expr("array(0L)" if model.bpe else "array(struct(0L AS e, cast(0 as double) AS score))")
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("done"), first.alias("tail"), F.lit(0).alias("base"))
    plain = (lambda x: x) if model.bpe else (lambda x: F.transform(x, lambda y: y["e"]))

    def whole(facts: Column) -> Column:
        def merged(near: Column, base: Column | None = None) -> Callable[[Column, Column], Column]:
            def step(tail: Column, e: Column) -> Column:
                # Longer edges come first; if none of them passes, the single character does.
                sure = _single(e) | (_from(e) == 255)
                follows = _follows(F.get(tail, _start(e) if base is None else _start(e) - base), e, near, facts, unknown)
                known = F.size(tail) > (_end(e) if base is None else _end(e) - base)
                return F.when(known, tail).when(sure | follows, F.array_append(tail, e)).otherwise(tail)

            return step

        def block(state: Column, b: Column) -> Column:
            base = state["base"]

            def relax(near: Column) -> Column:
                def scored(tail: Column, e: Column) -> Column:
                    score = F.get(tail, _end(e) - _size(e) - base)["score"] + F.get(facts["score"], _slot(e, unknown))
                    new = F.struct(e.alias("e"), score.alias("score"))
                    known = F.size(tail) > _end(e) - base
                    better = score > F.get(tail, F.size(tail) - 1)["score"]
                    return F.when(~known, F.array_append(tail, new)).when(better, F.array_append(F.slice(tail, F.lit(1), F.size(tail) - 1), new)).otherwise(tail)

                return F.aggregate(F.slice(edges, b * EDGES + 1, F.lit(EDGES)), state["tail"], merged(near, base) if model.bpe else scored)

            def moved(tail: Column) -> Column:
                gone = F.greatest(F.lit(0), F.size(tail) - (longest + 1))
                return F.struct(F.concat(state["done"], F.slice(plain(tail), F.lit(1), gone)).alias("done"), F.slice(tail, gone + 1, F.lit(longest + 1)).alias("tail"), (base + gone).alias("base"))

            if not model.bpe:
                return _bound(relax(F.lit(0)), moved)
            about = F.slice(edges, F.greatest(F.lit(1), b * EDGES + 1 - behind), F.lit(EDGES + ahead))
            return _bound(_bound(F.filter(about, lambda e: ~_single(e)), relax), moved)

        blocks = F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / EDGES).cast("int"))
        blocked = F.aggregate(blocks, start, block, lambda s: F.concat(s["done"], plain(s["tail"])))
        if not model.bpe:
            return blocked
        # Most units are one block.
        short = _bound(F.filter(edges, lambda e: ~_single(e)), lambda near: F.aggregate(edges, first, merged(near)))
        return F.when(F.size(edges) <= EDGES, short).otherwise(blocked)

    return _bound(_bound(piece_facts(model), whole), lambda states: _path(states, n))


def _path(states: Column, n: Column) -> Column:
    """Follows the back pointers from the last boundary; the edges, first to last."""
    empty = F.expr("cast(array() as array<bigint>)")

    def back(s: Column, _: Column) -> Column:
        e = F.get(states, s["at"])
        return F.when(s["at"] <= 0, s).otherwise(F.struct((s["at"] - _size(e)).alias("at"), F.array_append(s["path"], e).alias("path")))

    def some(s: Column, _: Column) -> Column:
        one = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(STEPS))), F.struct(s["at"].alias("at"), empty.alias("path")), back)
        return F.when(s["at"] <= 0, s).otherwise(_bound(one, lambda x: F.struct(x["at"].alias("at"), F.concat(s["path"], x["path"]).alias("path"))))

    last = F.struct(n.alias("at"), empty.alias("path"))
    short = F.aggregate(F.sequence(F.lit(1), n), last, back, lambda s: F.reverse(s["path"]))
    blocked = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / STEPS).cast("int")), last, some, lambda s: F.reverse(s["path"]))
    return F.when(n <= STEPS, short).otherwise(blocked)


def lattice_ids(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of distinct ``units``, of any length but not empty; dealt by unit, they are not shuffled again."""
    spark = units.sparkSession
    longest = max(map(len, model.plain()))
    bytes_ = model.byte_ids()
    first_byte = bytes_[0] if bytes_ else 0
    if bytes_ and bytes_ != list(range(first_byte, first_byte + 256)):
        raise ValueError("byte pieces must be numbered in order")
    if longest > 255 or len(model.pieces) >= UNKNOWN:
        raise ValueError("a piece is too long, or there are too many")
    ends = units.withColumn("n", F.char_length("unit")).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n"))))
    spans = ends.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.col("j"), F.lit(longest)))))
    # What is computed below the join is compiled, what the grouping's argument holds is not.
    subs = spans.select("unit", "size", _edge(F.col("j"), F.col("size"), F.lit(0)).alias("place"), F.substring("unit", F.col("j") - F.col("size") + 1, F.col("size")).alias("sub"))
    found = subs.join(F.broadcast(piece_table(spark, model)), F.col("sub") == F.col("piece"), "left").filter((F.col("size") == 1) | F.col("id").isNotNull())
    edge = F.col("place") + F.coalesce("id", F.lit(UNKNOWN))
    grouped = found.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))

    def spelled(e: Column) -> Column:
        c = F.substring("unit", _end(e), F.lit(1))
        hexed = F.hex(F.encode(c, "UTF-8"))
        one = F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda b: F.conv(F.substring(hexed, b * 2 + 1, F.lit(2)), 16, 10).cast("int") + first_byte) if bytes_ else F.array(F.lit(model.unknown))
        return F.when(_piece(e) != UNKNOWN, F.array(_piece(e))).otherwise(one)

    path = fold(F.col("edges"), F.char_length("unit"), model, longest)
    ids = _bound(path, lambda p: F.when(F.exists(p, lambda e: _piece(e) == UNKNOWN), F.flatten(F.transform(p, spelled))).otherwise(F.transform(p, _piece)))
    return grouped.select("unit", ids.alias("ids"))


class Alphabet:
    """Which characters may be next to each other in a piece."""

    def __init__(self, model: Model) -> None:
        pairs = {(p[k].replace(SPACE, " "), p[k + 1].replace(SPACE, " ")) for p in model.plain() for k in range(len(p) - 1)}
        chars = sorted({c for pair in pairs for c in pair})
        #: The number of a character that is in a pair, else 0.
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        of = {c: k for k, c in enumerate(chars, 1)}
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.together[of[a], of[b]] = True
        #: For two bytes: both are ASCII characters, and not together.
        ascii_ = self.number[:128]
        apart = np.zeros((256, 256), bool)
        apart[:128, :128] = ~self.together[ascii_[:, None], ascii_[None, :]]
        self.apart = apart.reshape(-1)


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


class Units:
    """The units of some documents: bounds in ``t.data`` and where each document's begin (and the end)."""

    def __init__(self, parts: list, alphabet: Alphabet) -> None:
        mark = SPACE.encode()
        parts = [b" " + p if len(p) else b"" for p in map(bytes, parts)]
        if any(mark in p for p in parts) or not _valid(b"".join(parts)):
            parts = [p.decode("utf-8", "replace").encode().replace(mark, b" ") for p in parts]
        self.t = Texts(parts)
        d = self.t.data
        cut = np.zeros(len(d) + 1, bool)
        # Pairs of ASCII by a table, then those with a longer character.
        cut[1 : len(d)] = alphabet.apart[d[:-1].astype(np.uint16) << 8 | d[1:]] if len(d) else False
        lead = np.flatnonzero(d >= 0xC0)
        if len(lead):
            size = 2 + (d[lead] >= 0xE0) + (d[lead] >= 0xF0)
            point = d[lead].astype(np.int64) & (0xFF >> (size + 1))
            for k in (1, 2, 3):
                point = np.where(size > k, point << 6 | (d[np.minimum(lead + k, len(d) - 1)] & 0x3F), point)
            own = alphabet.number[point]
            before = np.where(d[lead - 1] < 0x80, alphabet.number[d[lead - 1]], np.concatenate([own[:1], own[:-1]]))
            cut[lead] = ~alphabet.together[before, own]
            after = lead + size
            plain = d[after] < 0x80
            cut[after[plain]] = ~alphabet.together[own[plain], alphabet.number[d[after[plain]]]]
        cut[self.t.starts] = True
        last = self.t.starts[1:] - 1  # the newline that closes a document
        cut[last] = True
        edge = np.flatnonzero(cut)
        closing = np.zeros(len(d) + 1, bool)
        closing[last] = True
        closing[len(d)] = True
        begins = ~closing[edge]
        self.a, self.b = edge[begins], edge[np.flatnonzero(begins) + 1]
        self.at = np.searchsorted(self.a, self.t.starts)

    def distinct(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Different units by bucket and first bytes, where each bucket's begin (and the end), and each unit's number among them."""
        keys, first, back = distinct(self.t.data, self.a, self.b)
        bucket = bucket_of(keys, buckets)
        # Like spellings next to each other compress well.
        order = np.lexsort((eights(self.t.data)[self.a[first]].byteswap(), bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        raw, at = self.t.raw, first[order]
        return [raw[a:b] for a, b in zip(self.a[at].tolist(), self.b[at].tolist(), strict=True)], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[back]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    edge = ((np.arange(1, buckets, dtype=object) << 64) // buckets).astype(np.uint64)
    return np.searchsorted(edge, keys, "right")


def packed_lists(*lists: np.ndarray | list[bytes]) -> bytes:
    """Arrays of numbers, and lists of bytes with their lengths, compressed."""
    parts: list[bytes] = []
    for x in lists:
        if isinstance(x, list):
            parts += [np.array([len(x), *map(len, x)], "<u4").tobytes(), b"".join(x)]
        else:
            kind = next(k for k in ("<u1", "<u2", "<u4") if x.max(initial=0) <= np.iinfo(k).max)
            parts += [np.array([len(x), int(kind[2])], "<u4").tobytes(), x.astype(kind).tobytes()]
    raw = b"".join(parts)
    return np.array([len(raw)], "<u4").tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked_lists(blob: bytes, *kinds: type) -> list:
    raw = pa.Codec("zstd").decompress(memoryview(blob)[4:], int(np.frombuffer(blob[:4], "<u4")[0]), asbytes=True)
    pos, out = 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, "<u4", 1, pos)[0])
        if kind is list:
            size = np.frombuffer(raw, "<u4", n, pos + 4).astype(np.int64)
            ends = pos + 4 + 4 * n + np.cumsum(size)
            out.append([raw[e - k : e] for e, k in zip(ends.tolist(), size.tolist(), strict=True)])
            pos = int(ends[-1]) if n else pos + 4
        else:
            wide = int(np.frombuffer(raw, "<u4", 1, pos + 4)[0])
            out.append(np.frombuffer(raw, f"<u{wide}", n, pos + 8).astype(np.int64))
            pos += 8 + wide * n
    return out


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of ``df``: id, n_pieces, ids (array<int>), lossless (decoding the ids gives the text back).

    Null and empty texts have no pieces. Ids equal those of the library. A text that holds U+2581 decodes with spaces in its
    place, as the library's does, and is not lossless. Null ids and repeated rows are encoded like others; other columns are
    not read. With ``digest`` ids are replaced by ids_crc32 (little-endian uint32) and decoded_sha256.
    """
    spark = df.sparkSession
    model = Model.load(path)
    scratch = Scratch(spark, "pieces")
    kind = df.schema[id_col].dataType.simpleString()
    chunks = make_chunks(df.select(id_col, text_col), scratch, id_col, text_col)
    buckets = max(1, -(-total_bytes(chunks) // PER_BUCKET))
    slim = chunks.select("chunk", "sizes", "texts", "n_bytes")
    alphabet = Alphabet(model)
    schema = "bucket int, chunk long, units binary, ids binary"

    def rows(chunk: int, at: np.ndarray, units: list[bytes], size: np.ndarray | None = None, ids: np.ndarray | None = None) -> pa.RecordBatch:
        full = np.flatnonzero(np.diff(at) > 0).tolist()
        end = None if size is None else np.concatenate([[0], np.cumsum(size)])
        told = [b"" if end is None else packed_lists(size[at[b] : at[b + 1]], ids[end[at[b]] : end[at[b + 1]]]) for b in full]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "units": pa.array([packed_lists(units[at[b] : at[b + 1]]) for b in full], pa.binary()), "ids": pa.array(told, pa.binary())})

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, texts, n_bytes in _columns(batch, "chunk", "sizes", "texts", "n_bytes"):
                units, at, _ = Units(chunk_parts(sizes, texts, n_bytes), alphabet).distinct(buckets)
                yield rows(chunk, at, units)

    def meet(_: int, __: list[int], sent: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = sorted(set().union(*[unpacked_lists(r[0], list)[0] for r in sent]))
        for lo in range(0, len(names), 50_000):
            yield pa.RecordBatch.from_pydict({"unit": pa.array([x.decode().replace(" ", SPACE) for x in names[lo : lo + 50_000]], pa.string())})

    units = scratch.save(by_bucket(slim.mapInArrow(asked, schema), buckets, ["units"], meet, "unit string"), "units")
    # So many partitions that the edges of one's units fit in memory: they are grouped by hash, without a sort that spills.
    n_bytes = units.agg(F.coalesce(F.sum(F.octet_length("unit")), F.lit(0))).first()[0]
    dealt = units.repartition(min(MOST_PARTITIONS, max(1, -(-n_bytes // PER_PARTITION))), "unit")
    table = scratch.save(lattice_ids(dealt, model), "table", {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(HASHED_UNITS)})
    scratch.drop("units")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = [x.encode().replace(SPACE.encode(), b" ") for x in batch.column(0).to_pylist()], batch.column(1)
            end = np.cumsum([len(x) for x in names])
            bucket = bucket_of(spans_hash(np.frombuffer(b"".join(names), np.uint8), end - np.array([len(x) for x in names]), end), buckets) if names else np.zeros(0, int)
            order = np.argsort(bucket, kind="stable")
            off = lists.offsets.to_numpy().astype(np.int64)
            size = np.diff(off)[order]
            yield rows(-1, np.searchsorted(bucket[order], np.arange(buckets + 1)), [names[k] for k in order.tolist()], size, lists.values.to_numpy()[ragged(off[:-1][order], size)])

    def answer(chunk: list[int], sent: list[tuple]) -> list[np.ndarray]:
        where: dict[bytes, int] = {}
        sizes, ids = [], []
        for c, r in zip(chunk, sent, strict=True):
            if c < 0:
                where.update(zip(names := unpacked_lists(r[0], list)[0], range(len(where), len(where) + len(names))))
                one, two = unpacked_lists(r[1], int, int)
                sizes.append(one)
                ids.append(two)
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        lo = np.cumsum(size) - size
        out = []
        for c, r in zip(chunk, sent, strict=True):
            at = np.array([where[x] for x in unpacked_lists(r[0], list)[0]] if c >= 0 else [], np.int64)
            out.append(np.frombuffer(packed_lists(size[at], flat[ragged(lo[at], size[at])]), np.uint8))
        return out

    questions = slim.mapInArrow(asked, schema).union(table.mapInArrow(known, schema))
    answers = ask(questions, buckets, answer, ["units", "ids"]).filter("chunk >= 0")
    spelled = model.spelled()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        sound, sound_n = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled])
        sound_at = np.cumsum(sound_n) - sound_n
        for batch in batches:
            ids_at = batch.column(batch.schema.get_field_index(f"c_{id_col}"))
            for row, (sizes, texts, n_bytes, told) in enumerate(_columns(batch, "sizes", "texts", "n_bytes", "answers")):
                parts = chunk_parts(sizes, texts, n_bytes)
                u = Units(parts, alphabet)
                got = [unpacked_lists(x["bits"], int, int) for x in sorted(told or [], key=lambda x: x["bucket"])]
                size = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
                ids = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
                _, _, back = u.distinct(buckets)
                n = size[back]
                flat = ids[ragged((np.cumsum(size) - size)[back], n)]
                end = np.concatenate([[0], np.cumsum(n)])[u.at]
                # Decoding: the pieces' bytes, without the space that was put in front.
                long = sound_n[flat]
                said = sound[ragged(sound_at[flat], long)].tobytes()
                said_at = np.concatenate([[0], np.cumsum(long)])[end]
                texts_ = [said[min(a + 1, b) : b] for a, b in zip(said_at[:-1].tolist(), said_at[1:].tolist(), strict=True)]
                out = {"id": ids_at[row].values, "n_pieces": pa.array(np.diff(end), pa.int64())}
                if digest:
                    raw = memoryview(flat.astype("<u4").tobytes())
                    out["ids_crc32"] = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)], pa.int64())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts_])
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(flat, pa.int32()))
                out["lossless"] = pa.array([x == bytes(p) for x, p in zip(texts_, parts, strict=True)])
                yield pa.RecordBatch.from_pydict(out)

    told = with_answers(chunks.select("chunk", "sizes", "texts", "n_bytes", f"c_{id_col}"), answers, "answers")
    out = told.mapInArrow(finish, f"id {kind}, n_pieces long, {'ids_crc32 long, decoded_sha256 string' if digest else 'ids array<int>'}, lossless boolean")
    out = out.withColumnRenamed("id", id_col)
    if digest:
        out = scratch.keep(out)
        scratch.drop()
    return out


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` (array<int>); null stays null. Invalid UTF-8 of byte pieces becomes U+FFFD."""
    spelled = Model.load(path).spelled()

    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else b"".join([spelled[i] for i in x]).decode("utf-8", "replace")[1 if len(x) else 0 :])

    text.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(text, "string")(ids_col))

