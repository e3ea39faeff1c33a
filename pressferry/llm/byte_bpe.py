"""Operator 9: byte-level BPE encoding and decoding by merge replay.

Each task takes its part of the corpus in blocks.  The distinct words of a
block are laid out as one array of byte symbols with links to the neighbours;
an inverted index maps a mergeable token pair (named by the id it merges into)
to the word positions where it occurs.  Merges are then applied in rank order;
each one touches only its positions and their two neighbours, whose new pairs
join the index.  A word's ids depend on the word alone, so replaying block by
block gives what a replay over the whole corpus gives, with bounded memory and
no shuffle.

Defined results: null text is empty (no ids); empty text has no ids; ties
(one pair at several places of a word) merge from the left; repeated rows are
encoded each; an empty table gives no rows; other columns of the input are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressferry.llm.common import slices

_SHIFT = 20  # token ids are below 2 ** 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (base64 token, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes words by replaying the merges of a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 1 << _SHIFT:
            raise ValueError("token ids must be below 2 ** 20")
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError("every single byte must be a token")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left << _SHIFT | right] = rank
        self.byte_pair = np.full(65536, -1, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pair[a << 8 | b] = ranks.get(bytes([a, b]), -1)

    def plain(self, word: bytes) -> list[int]:
        """One word by itself, the pair of the lowest rank first, from the left
        (used where the replay meets a pair of a lower rank than the merge that
        made it).  Pairs wait in a heap, so a long run costs n log n."""
        if word in self.ranks:
            return [self.ranks[word]]
        ids = [int(self.byte_id[b]) for b in word]
        n, merged = len(ids), self.merged.get
        following, previous = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := merged(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = following[at]
            if ids[at] < 0 or right < 0 or merged(ids[at] << _SHIFT | ids[right]) != rank:
                continue  # one of the two was merged meanwhile
            ids[at], ids[right] = rank, -1
            after, before = following[right], previous[at]
            following[at] = after
            if after >= 0:
                previous[after] = at
                if (r := merged(rank << _SHIFT | ids[after])) is not None:
                    heapq.heappush(heap, (r, at))
            if before >= 0 and (r := merged(ids[before] << _SHIFT | rank)) is not None:
                heapq.heappush(heap, (r, before))
        return [i for i in ids if i >= 0]

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word; the words of one call share one replay."""
        out: list[tuple[int, ...] | None] = [None] * len(words)
        todo = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = (whole,)
            elif not word:
                out[i] = ()
            else:
                todo.append(i)
        if not todo:
            return out
        raw = np.frombuffer(b"".join(words[i] for i in todo), dtype=np.uint8)
        ends = np.cumsum([len(words[i]) for i in todo])
        starts = ends - [len(words[i]) for i in todo]
        n = len(raw)
        symbol = self.byte_id[raw].tolist()
        following = np.arange(1, n + 1)
        following[ends - 1] = -1
        previous = np.arange(-1, n - 1)
        previous[starts] = -1
        following, previous = following.tolist(), previous.tolist()

        pair = np.full(n, -1, dtype=np.int64)
        pair[:-1] = self.byte_pair[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        pair[ends - 1] = -1
        places = np.flatnonzero(pair >= 0)
        places = places[np.argsort(pair[places], kind="stable")]
        found, first = np.unique(pair[places], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(found, np.split(places, first[1:]), strict=True)} if len(found) else {}
        heap = sorted(index)
        late: set[int] = set()
        merged = self.merged.get
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank)
            positions.sort()
            for at in positions:
                right = following[at]
                if right < 0 or symbol[at] < 0 or merged(symbol[at] << _SHIFT | symbol[right]) != rank:
                    continue
                symbol[at], symbol[right] = rank, -1
                after, before = following[right], previous[at]
                following[at] = after
                if after >= 0:
                    previous[after] = at
                    new = merged(rank << _SHIFT | symbol[after])
                    if new is not None:
                        if new < rank:
                            late.add(at)
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(heap, new)
                if before >= 0:
                    new = merged(symbol[before] << _SHIFT | rank)
                    if new is not None:
                        if new < rank:
                            late.add(at)
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heapq.heappush(heap, new)
        final = np.array(symbol, dtype=np.int64)
        alive = np.flatnonzero(final >= 0)
        cuts = np.searchsorted(alive, starts)
        ids = final[alive].tolist()
        bounds = [*cuts.tolist(), len(ids)]
        for k, i in enumerate(todo):
            out[i] = tuple(ids[bounds[k]:bounds[k + 1]])
        for k in {int(np.searchsorted(ends, at, "right")) for at in late}:
            out[todo[k]] = tuple(self.plain(words[todo[k]]))
        return out


class TextCoder:
    """Splits texts by ``pattern`` and encodes each match.  The ids of short
    words are kept between blocks, in one array.  After ``max_words`` words a new
    array begins, which takes over what is still in use from the one before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_words: int = 240_000):
        import regex

        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.max_words = max_words
        self.known: dict[str, int] = {}  # the place of a word in starts
        self.starts, self.flat = array("q", [0]), array("i")
        self.before: tuple = ({}, self.starts, self.flat)
        size = max(self.replay.token) + 1
        self.token_bytes = pa.array([self.replay.token.get(i, b"") for i in range(size)], pa.large_binary())
        self.decimal = pa.array([f"{i} " for i in range(size)], pa.large_string())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the first of each text
        with the end."""
        split = [self.find(t) for t in texts]
        counts = [len(words) for words in split]
        words = list(chain.from_iterable(split))
        del split
        if len(self.known) > self.max_words:
            self.before = (self.known, self.starts, self.flat)
            self.known, self.starts, self.flat = {}, array("q", [0]), array("i")
        known, (old, old_starts, old_flat) = self.known, self.before
        place = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(place < 0).tolist()
        new = dict.fromkeys(map(words.__getitem__, missing))
        for word in [w for w in new if w in old]:
            known[word] = len(self.starts) - 1
            self.flat.extend(old_flat[old_starts[old[word]]:old_starts[old[word] + 1]])
            self.starts.append(len(self.flat))
        new = [w for w in new if w not in known]
        kept, size = len(self.starts), len(self.flat)
        new.sort(key=len)  # long words last, so that they can be dropped
        for word, ids in zip(new, self.replay.encode([w.encode() for w in new]), strict=True):
            known[word] = len(self.starts) - 1
            self.flat.extend(ids)
            self.starts.append(len(self.flat))
            if len(word) <= 64:
                kept, size = len(self.starts), len(self.flat)
        place[missing] = np.fromiter(map(known.__getitem__, map(words.__getitem__, missing)), dtype=np.int64, count=len(missing))
        starts, flat = np.array(self.starts, dtype=np.int64), np.array(self.flat, dtype=np.int32)
        for word in new[kept - len(self.starts) or len(new):]:
            del known[word]
        del self.starts[kept:], self.flat[size:]
        sizes = (starts[1:] - starts[:-1])[place]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(starts[place] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.token.__getitem__, ids))

    def joined(self, ids: np.ndarray, cuts: np.ndarray, strings: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The strings of all ids, one after the other, and the first byte of
        each text's with the end."""
        taken = strings.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        return memoryview(data).cast("B") if data is not None else memoryview(b""), np.frombuffer(offsets, dtype=np.int64)[cuts] if len(ids) else np.zeros(len(cuts), dtype=np.int64)


_CODERS: dict[tuple, TextCoder] = {}


def coder_for(ranks: dict[bytes, int], pattern: str) -> TextCoder:
    """One coder per Python worker and vocabulary."""
    key = (pattern, len(ranks), hash(frozenset(list(ranks.items())[-1000:])))
    if key not in _CODERS:
        _CODERS[key] = TextCoder(ranks, pattern)
    return _CODERS[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False, block_bytes: int = 1 << 20) -> DataFrame:
    """Encode every text and decode its ids again: id, n_tokens, ids_sha256,
    decoded_sha256, round_trip (decoded bytes equal the text's), and with
    ``with_ids`` the ids.  ``block_bytes``: text of one replay."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: its size doesn't grow with the data
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * with_ids
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(shared.value, pattern)
        for batch in slices(batches, text_col, block_bytes):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            ids, cuts = coder.encode(texts)
            decoded, at = coder.joined(ids, cuts, coder.token_bytes)
            written, w = coder.joined(ids, cuts, coder.decimal)
            digest = lambda x: hashlib.sha256(x).hexdigest()
            columns = [batch.column(id_col), pa.array(np.diff(cuts)), pa.array([digest(written[i:max(i, j - 1)]) for i, j in zip(w[:-1], w[1:], strict=True)]),
                       pa.array([digest(decoded[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]),
                       pa.array([decoded[i:j] == t.encode() for i, j, t in zip(at[:-1], at[1:], texts, strict=True)])]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = (f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
              + ", ids array<int>" * with_ids)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
