"""Operator 11: alignment of the tokens of two tokenizers by coalescing
their byte intervals.

The tokens of both sides of a slice of texts lie on one line of bytes.  All of
them are sorted by their start (a stable sort of two ascending runs, which is a
merge; the first side goes first), the ends get a running maximum, and a new
group begins wherever a start reaches the maximum before it.  Within a group
every distinct start begins a stretch that one token of each side covers: these
stretches are the overlaps, one link each.

Links are counted over the corpus in two passes.  The first encodes the texts
once and leaves, for each block of texts, the distinct id pairs with their
counts (rows) and the pairs of each document (packed, as places in the block's
pairs).  Spark sums the pairs, finds the largest count of each id of the second
side, and joins both back to the blocks' pairs.  The second pass meets each
block with the answers to its own pairs.  A pair that half of the corpus holds is
one row of a block, a block has a bounded size, and nothing is broadcast but the
vocabularies.

Defined results: null and empty texts, and texts that either side doesn't give
back byte for byte (after the space in front), have no tokens: zeros and an
empty digest; ties of a count are all the best; repeated rows are counted each;
a text is held whole by its task; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressferry.llm.common import slices, written
from pressferry.llm.pitman_yor import pack, unpack


# --- tokenizers ---------------------------------------------------------------

def level_bytes() -> dict[str, int]:
    """The bytes of the characters that stand for them in byte-level files:
    printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a tokenizers file.  Where the merges make the ids in
    order, texts of one- and two-byte characters go by the faster rank coder of
    the same table; others always by the file's own library (its letter classes
    may be of another Unicode version)."""

    def __init__(self, file: str, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True
        given = json.loads(file)
        model, to_byte = given["model"], level_bytes()
        vocabulary = model["vocab"]
        added = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.bytes = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(to_byte[c] for c in token) if token not in added else token.encode()
        self.ranks = None
        made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        before = given["pre_tokenizer"] or {}
        if pattern and given["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") \
                and made == list(range(256, 256 + len(made))):
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in added}
            self.ranks = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        slow = [i for i, t in enumerate(texts) if self.ranks is None or (not t.isascii() and max(t) >= "\u0800")]
        for i, found in zip(slow, self.tokenizer.encode_batch([" " + texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, dtype=np.int64)
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.ranks.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64)
        return out


class Pieces:
    """A sentencepiece model (which puts a space in front itself)."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.model.get_piece_size()
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.model.encode(texts, num_threads=1)
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=sum(map(len, found)))
        return np.split(flat, np.cumsum([len(f) for f in found])[:-1])


# --- intervals -----------------------------------------------------------------

def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start (equal starts as given) and, in that
    order, the number of each one's group: a group ends where a start reaches
    the running maximum of the ends."""
    order = np.argsort(starts, kind="stable")
    running = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = starts[order][1:] >= running[:-1]
    return order, np.cumsum(fresh) - 1


@dataclass
class Aligned:
    """The tokens, groups and links of a slice of texts, text after text."""

    kept: np.ndarray  # rows that have tokens
    a: np.ndarray  # ids
    b: np.ndarray
    a_cuts: np.ndarray  # first token of each kept text, and the end
    b_cuts: np.ndarray
    a_group: np.ndarray  # group of each token
    b_group: np.ndarray
    link_a: np.ndarray  # token of each link
    link_b: np.ndarray

    def per_text(self) -> tuple[np.ndarray, ...]:
        """Tokens of either side, groups and links of each kept text."""
        first = np.append(self.a_group[self.a_cuts[:-1]], self.a_group[-1] + 1 if len(self.a_group) else 0)
        links = np.searchsorted(self.link_a, self.a_cuts)
        return np.diff(self.a_cuts), np.diff(self.b_cuts), np.diff(first), np.diff(links)


class Aligner:
    """Encodes and aligns slices of texts."""

    def __init__(self, left, right):
        self.sides = (left, right)
        self.sizes = tuple(np.array([len(t) for t in s.bytes], dtype=np.int64) for s in self.sides)
        self.tokens = tuple(pa.array(s.bytes, pa.large_binary()) for s in self.sides)
        self.n_right = len(right.bytes)
        if len(left.bytes) * self.n_right >= 1 << 40:
            raise ValueError("the vocabularies are too large: a pair of ids has 40 bits")
        decimal = [np.array([str(i) for i in range(len(s.bytes))], dtype=object) for s in self.sides]
        self.written_ids = pa.array([d + mark for ids, marks in zip(decimal, ((",", "|"), (",", ";", "")), strict=True) for mark in marks for d in ids], pa.large_string())

    def align(self, texts: list[str | None]) -> Aligned:
        rows = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
        raw = [(" " + texts[i]).encode() for i in rows]
        length = np.array([len(r) for r in raw], dtype=np.int64)
        given = [texts[i] for i in rows]
        found = [s.encode(given) if given else [] for s in self.sides]
        good = np.ones(len(rows), dtype=bool)
        for ids, size in zip(found, self.sizes, strict=True):
            good &= np.array([int(size[x].sum()) for x in ids], dtype=np.int64) == length if len(rows) else good
        sides = [np.concatenate([x for x, g in zip(ids, good, strict=True) if g] or [np.zeros(0, dtype=np.int64)]) for ids in found]
        if not good.all():
            rows, length, raw = rows[good], length[good], [r for r, g in zip(raw, good, strict=True) if g]
        counts = [np.array([len(x) for x, g in zip(ids, good, strict=True) if g], dtype=np.int64) for ids in found]
        line = np.frombuffer(b"".join(raw), dtype=np.uint8)
        until = np.cumsum(length)
        same = np.ones(len(rows), dtype=bool)
        for ids, tokens in zip(sides, self.tokens, strict=True):
            if len(ids):
                joined = np.frombuffer(tokens.take(pa.array(ids)).buffers()[2], dtype=np.uint8)[:len(line)]
                same[np.searchsorted(until, np.flatnonzero(joined != line), "right")] = False
        if not same.all():
            sides = [ids[np.repeat(same, c)] for ids, c in zip(sides, counts, strict=True)]
            rows, counts = rows[same], [c[same] for c in counts]
        return self._coalesced(rows, sides, [np.concatenate(([0], np.cumsum(c))) for c in counts])

    def _coalesced(self, rows: np.ndarray, sides: list[np.ndarray], cuts: list[np.ndarray]) -> Aligned:
        ends = [np.cumsum(size[ids]) for ids, size in zip(sides, self.sizes, strict=True)]
        starts = [e - size[ids] for e, ids, size in zip(ends, sides, self.sizes, strict=True)]
        n = len(sides[0])
        start, end = np.concatenate(starts), np.concatenate(ends)
        order, group = coalesce(start, end)
        own = np.empty(len(order), dtype=np.int64)
        own[order] = group
        first = np.cumsum(order < n) - 1  # the last token of either side that has begun
        last = np.ones(len(order), dtype=bool)
        last[:-1] = np.diff(start[order]) > 0
        place = np.flatnonzero(last)
        return Aligned(rows, sides[0], sides[1], cuts[0], cuts[1], own[:n], own[n:], first[place], place - first[place] - 1)

    def written_groups(self, x: Aligned) -> pa.Array:
        """a1,a2|b1;a3|b2 of each kept text, in ASCII."""
        na, nb = len(self.sides[0].bytes), self.n_right
        ends_group = lambda g: np.append(np.diff(g) > 0, np.ones(min(1, len(g)), dtype=bool))
        a_text = x.a + na * ends_group(x.a_group)
        b_text = 2 * na + x.b + nb * ends_group(x.b_group)
        b_text[x.b_cuts[1:] - 1] += nb
        order = np.argsort(np.concatenate((2 * x.a_group, 2 * x.b_group + 1)), kind="stable")
        strings = self.written_ids.take(pa.array(np.concatenate((a_text, b_text))[order]))
        _, offsets, data = strings.buffers()  # one after the other: a text's groups are a stretch of them
        cuts = np.frombuffer(offsets, dtype=np.int64)[x.a_cuts + x.b_cuts] if len(strings) else np.zeros(len(x.a_cuts), dtype=np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x.kept), [None, pa.py_buffer(cuts), data])


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner_for(files: tuple[str, bytes, str | None]) -> Aligner:
    """One aligner per Python worker and pair of vocabularies."""
    key = tuple(hash(f) for f in files)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(ByteLevel(files[0], files[2]), Pieces(files[1]))
    return _ALIGNERS[key]


def load(byte_level: str, pieces: str, pattern: str | None = None) -> tuple[str, bytes, str | None]:
    """The two vocabulary files, and the pattern by which the rank coder splits."""
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        return a.read(), b.read(), pattern


# --- over a corpus -----------------------------------------------------------

def token_groups(docs: DataFrame, files: tuple[str, bytes, str | None], id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """id, a_ids, b_ids, a_sizes, b_sizes of every text: the tokens of both sides
    and how many of each make up each group, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # vocabulary files: their size doesn't grow with the data
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(shared.value)
        for batch in slices(batches, "text", slice_bytes):
            x = aligner.align(batch.column("text").to_pylist())
            columns: list[list] = [[[]] * batch.num_rows for _ in range(4)]
            for k, row in enumerate(x.kept):
                (a, a_end), (b, b_end) = x.a_cuts[k:k + 2], x.b_cuts[k:k + 2]
                base = x.a_group[a]
                columns[0][row], columns[1][row] = x.a[a:a_end], x.b[b:b_end]
                columns[2][row], columns[3][row] = np.bincount(x.a_group[a:a_end] - base), np.bincount(x.b_group[b:b_end] - base)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], [id_col, "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {id_type}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


_INFO = ("n_a", "n_b", "n_groups", "n_links")


def encoded_blocks(docs: DataFrame, files: tuple[str, bytes, str | None], id_col: str, text_col: str, slice_bytes: int, block_bytes: int) -> DataFrame:
    """Rows of blocks.  One with the documents: ids, ``_INFO``, digests, the
    number of pairs of each and, packed, the place and count of each; and one
    for each distinct pair: its place in the block, the pair, its count."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # vocabulary files
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["block", "place", "pair", "n", "ids", *_INFO, "digests", "sizes", "places", "times"]
    int_lists = pa.list_(pa.int64())
    schema = (f"block bigint, place int, pair bigint, n bigint, ids array<{id_type}>, {', '.join(f'{c} array<bigint>' for c in _INFO)}, "
              "digests array<string>, sizes array<bigint>, places binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part = aligner_for(shared.value), TaskContext.get().partitionId()
        block, held, seen = part << 32, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            every = np.concatenate([h["pairs"] for h in held])
            times = np.concatenate([h["times"] for h in held])
            pairs = np.unique(every)
            place = np.searchsorted(pairs, every)
            total = np.bincount(place, times, len(pairs)).astype(np.int64)
            none = lambda t, n: pa.nulls(n, t)
            list_of = lambda values, kind: pa.array([values], pa.list_(kind))
            ids = pa.concat_arrays([h["ids"] for h in held])
            info = [np.concatenate([h["info"][k] for h in held]) for k in range(len(_INFO))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), none(pa.int32(), 1), none(pa.int64(), 1), none(pa.int64(), 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *(list_of(x, pa.int64()) for x in info), list_of(list(chain.from_iterable(h["digests"] for h in held)), pa.string()),
                 list_of(np.concatenate([h["sizes"] for h in held]), pa.int64()), pa.array([pack(place.astype(np.uint32))]), pa.array([pack(times.astype(np.uint32))])], names)
            for at in range(0, len(pairs), 1 << 16):
                k = min(1 << 16, len(pairs) - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, block)), pa.array(np.arange(at, at + k), pa.int32()), pa.array(pairs[at:at + k]), pa.array(total[at:at + k]),
                     none(pa.list_(ids.type), k), *(none(int_lists, k) for _ in _INFO), none(pa.list_(pa.string()), k), none(int_lists, k),
                     none(pa.binary(), k), none(pa.binary(), k)], names)

        for batch in slices(batches, "text", slice_bytes):
            texts = batch.column("text").to_pylist()
            x = aligner.align(texts)
            counts = x.per_text()
            text = np.repeat(np.arange(len(x.kept)), counts[3])
            key = np.sort(text << 40 | (x.a[x.link_a] * aligner.n_right + x.b[x.link_b]))
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
            sizes, digests, info = np.zeros(batch.num_rows, dtype=np.int64), [""] * batch.num_rows, np.zeros((len(_INFO), batch.num_rows), dtype=np.int64)
            info[:, x.kept] = counts
            sizes[x.kept] = np.bincount(key[new] >> 40, minlength=len(x.kept))
            for row, groups in zip(x.kept.tolist(), aligner.written_groups(x), strict=True):
                digests[row] = hashlib.sha256(groups.as_buffer()).hexdigest()
            held.append({"ids": batch.column("id").take(pa.array(np.arange(batch.num_rows))), "info": info, "digests": digests, "sizes": sizes,
                         "pairs": key[new] & ((1 << 40) - 1), "times": np.diff(np.append(new, len(key)))})
            seen += sum(map(len, filter(None, texts)))
            if seen >= block_bytes:
                yield from finished()
                block, held, seen = block + 1, [], 0
        if held:
            yield from finished()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def alignment_counts(docs: DataFrame, files: tuple[str, bytes, str | None], id_col: str = "doc_id", text_col: str = "text",
                     slice_bytes: int = 2 << 20, block_bytes: int = 24 << 20) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every
    text: how its tokens align, and how common its links are in the corpus."""
    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = written(encoded_blocks(docs, files, id_col, text_col, slice_bytes, block_bytes), "aligned", "zstd")
    n_right = len(Pieces(files[1]).bytes)
    pairs = blocks.filter("pair IS NOT NULL").select("block", "place", "pair", "n")
    total = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    most = total.groupBy((F.col("pair") % n_right).alias("right")).agg(F.max("count").alias("most"))
    known = total.withColumn("right", F.col("pair") % n_right).join(most, "right").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = pairs.select(F.col("block").alias("of"), "place", "pair").join(known, "pair").select("of", "place", "count", "best")
    documents = blocks.filter("pair IS NULL").drop("place", "pair", "n")

    def add(key: tuple, given: pa.Table, answer: pa.Table) -> pa.Table:
        rows = given.to_pylist()
        n = answer.num_rows
        place = answer.column("place").to_numpy()
        count, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        count[place], best[place] = answer.column("count").to_numpy(), answer.column("best").to_numpy()
        tables = []
        for row in rows:  # one
            sizes = np.array(row["sizes"], dtype=np.int64)
            places = unpack(row["places"], int(sizes.sum()), "u4").astype(np.int64)
            times = unpack(row["times"], int(sizes.sum()), "u4").astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[places])))[cuts]) for x in (best, count)]
            tables.append(pa.table([pa.array(row["ids"], id_arrow(given)), *(pa.array(row[c], pa.int64()) for c in _INFO), *sums, pa.array(row["digests"], pa.string())],
                                   [id_col, *_INFO, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], t) for t in (id_arrow(given), *[pa.int64()] * 6, pa.string())],
                                                                [id_col, *_INFO, "n_best", "count_sum", "groups_sha256"])

    def id_arrow(given: pa.Table) -> pa.DataType:
        return given.schema.field("ids").type.value_type

    return documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        add, f"`{id_col}` {id_type}, {', '.join(f'{c} bigint' for c in _INFO)}, n_best bigint, count_sum bigint, groups_sha256 string")
