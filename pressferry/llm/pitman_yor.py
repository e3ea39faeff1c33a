"""Operator 4: language-model scoring with a hierarchical Pitman-Yor model.

Every word is a context restaurant whose customers are the tokens that follow
it; a table of such a restaurant is a customer of the one parent restaurant
that all contexts share, and that one's base is uniform over the known words
and one unknown word.  Seatings are sampled by Gibbs sweeps.  A sweep seats the
customers of every dish one after the other (an old table with weight
customers - discount * tables, a new one with weight (strength + discount *
tables of the restaurant) * the dish's probability in the parent), given what
the sweep before left elsewhere, so all restaurants go in parallel; the parent
is then seated anew.  The score averages the predictive probabilities of the
sampled seatings.

The work is exchanged in packed vectors.  The corpus is cut into blocks that
hold their texts as word numbers.  A block sends the hashes of its distinct
word pairs, in ascending order, to the parts of the hash range; a part sums the
counts and answers each block in the order asked, naming one block the owner of
each pair.  Words are exchanged in the same way in every sweep.  Pairs and words
are pre-aggregated in their block, so a word or pair with a third of all
tokens is one number of each block.  A seating is drawn from hashes of the
pair, so every block that holds a pair draws the same one, and only its owner
counts it.  Nothing but a few totals is collected.

Word hashes have 64 bits; pair hashes 40 bits inside a part (more parts for
more data): two pairs in a million share a count by chance.

Defined results: null text is empty and has one token, the end; equal rows are
scored each (and learned from each); a null id isn't held out; with nothing to
learn every probability is that of the unknown word, 1; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressferry.llm.common import mix, shuffle_partitions, slices, word_codes, word_hashes, written

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_K = np.uint64(0x9E3779B97F4A7C15)


# --- packed vectors ---------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Bytes of equal rank together, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(kind).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n, "u8"), dtype=np.uint64)


def spread(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The first place of each part's range in ascending hashes, with the end."""
    part = ((hashes >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(48)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def inside(hashes: np.ndarray, parts: int) -> np.ndarray:
    """40 bits of a hash within its part, in the same order."""
    return ((hashes >> np.uint64(16)) * np.uint64(parts) & np.uint64((1 << 48) - 1)) >> np.uint64(8)


# --- seating ----------------------------------------------------------------

def seat(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes after seating all their customers.  ``weight``: that of
    a new table beside old ones.  Beyond 32 customers they come in
    groups of a sixteenth, at the probability of the group's first."""
    tables = np.minimum(customers, 1).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    order = order[:int((customers > 1).sum())]
    left = customers[order].astype(np.float64)
    t, w, k = tables[order], weight[order], keys[order]
    seated, step = 1.0, 0
    while len(left):
        group = np.minimum(max(1.0, seated // 16), left - seated)
        p = w / (w + np.maximum(seated - discount * t, 1e-9))
        draw = (mix(k + np.uint64((sweep * 1_000_003 + step) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) / 2.0 ** 53
        t += np.minimum(group, np.floor(group * p + draw))
        seated += max(1.0, seated // 16)
        step += 1
        more = int(np.searchsorted(-left, -seated, "left"))  # dishes with more customers than are seated
        if more < len(left):
            tables[order[more:]] = t[more:]
            order, left, t, w, k = order[:more], left[:more], t[:more], w[:more], k[:more]
    return tables


@dataclass
class Totals:
    """What the whole corpus says."""

    tokens: int
    words: int
    discount: float
    strength: float
    root_discount: float
    root_strength: float
    customers: list[float]  # of the parent, after each sweep
    tables: list[float]

    def parent(self, sweep: int, dish: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words in the parent restaurant after a sweep."""
        c, t = self.customers[sweep], self.tables[sweep]
        return (dish - self.root_discount * tables + (self.root_strength + self.root_discount * t) / (self.words + 1)) / (self.root_strength + c)


# --- blocks -----------------------------------------------------------------

class Block:
    """A block of the corpus, from its stored row."""

    def __init__(self, row: dict):
        self.words = unpack_sorted(row["words"], row["n_words"])
        self.codes = unpack(row["codes"], row["n_tokens"], "u4").astype(np.int64)
        self.cuts = np.array(row["cuts"], dtype=np.int64)
        self.learn = ~np.array(row["held"], dtype=bool)
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.cuts[:-1]] = np.searchsorted(self.words, START)
        n = len(self.words)
        self.pairs, self.of_token = np.unique(before * n + self.codes, return_inverse=True)
        self.context, self.dish = self.pairs // n, self.pairs % n
        hashes = mix(mix(self.words[self.context] * _K) + self.words[self.dish])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def learned(self) -> np.ndarray:
        """Learned tokens of each pair."""
        use = np.repeat(self.learn, np.diff(self.cuts))
        return np.bincount(self.of_token, use, len(self.pairs)).astype(np.uint32)


def corpus_blocks(docs: DataFrame, id_type: str, block_bytes: int) -> DataFrame:
    """Rows of blocks from the columns id, held, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", block_bytes):
            offsets, codes, words = word_codes(batch.column("text"))
            held = np.array(batch.column("held").to_pylist(), dtype=bool)
            hashes, place = np.unique(np.concatenate((word_hashes(words), [END, START])), return_inverse=True)
            docs_n = len(offsets) - 1
            cuts = offsets + np.arange(docs_n + 1)
            flat = np.empty(int(cuts[-1]), dtype=np.int64)
            ends = np.zeros(len(flat), dtype=bool)
            ends[cuts[1:] - 1] = True
            flat[ends], flat[~ends] = place[-2], place[codes]
            use = np.repeat(~held, np.diff(cuts))
            counts = np.bincount(flat, use, len(hashes))
            counts[place[-1]] = (~held).sum()  # customers of the start's restaurant
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k]), pa.array([batch.column("id").to_pylist()], pa.list_(batch.column("id").type)), pa.array([held.tolist()]),
                 pa.array([cuts.tolist()], pa.list_(pa.int64())), pa.array([len(flat)]), pa.array([len(hashes)]), pa.array([pack(flat.astype(np.uint32))]),
                 pa.array([pack_sorted(hashes)]), pa.array([pack(counts.astype(np.uint32))])],
                ["block", "ids", "held", "cuts", "n_tokens", "n_words", "codes", "words", "counts"])
            k += 1

    return docs.mapInArrow(run, f"block bigint, ids array<{id_type}>, held array<boolean>, cuts array<bigint>, n_tokens bigint, n_words bigint, "
                                "codes binary, words binary, counts binary")


_MAIL = "part int, block bigint, kind int, n bigint, keys binary, a binary, b binary, c binary"
_MAIL_NAMES = [f.split()[0] for f in _MAIL.split(", ")]


def _mail(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _MAIL_NAMES)


def _rows(batch: pa.RecordBatch | pa.Table) -> list[dict]:
    return batch.to_pylist()


def pair_requests(blocks: DataFrame, parts: int) -> DataFrame:
    """The pair hashes and learned counts of each block, cut by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _rows(batch.slice(i, 1))[0]
                block = Block(row)
                counts, cuts, keys = block.learned()[block.order], spread(block.hashes, parts), inside(block.hashes, parts)
                yield _mail([(p, row["block"], -1, int(b - a), pack_sorted(keys[a:b]), pack(counts[a:b]), None, None)
                             for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b])

    return blocks.select("block", "held", "cuts", "n_tokens", "n_words", "codes", "words").mapInArrow(run, _MAIL)


def answer_pairs(requests: DataFrame) -> DataFrame:
    """For each block and part: twice the learned count of each pair, plus one
    for the owner (the first block that learned it)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(_rows(table), key=lambda r: r["block"])
        keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
        counts = np.concatenate([unpack(r["a"], r["n"], "u4") for r in rows])
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
        group = np.cumsum(new) - 1
        total = np.bincount(group, counts[order]).astype(np.int64)
        learned = np.flatnonzero(counts[order] > 0)
        owner = np.zeros(len(keys), dtype=np.uint32)
        if len(learned):
            firsts = learned[np.concatenate(([True], group[learned][1:] != group[learned][:-1]))]
            owner[order[firsts]] = 1
        answer = np.empty(len(keys), dtype=np.uint32)
        answer[order] = (total[group] * 2).astype(np.uint32)
        answer |= owner
        out, at = [], 0
        for r in rows:
            out.append((r["part"], r["block"], -1, r["n"], None, pack(answer[at:at + r["n"]]), None, None))
            at += r["n"]
        return pa.Table.from_batches([_mail(out)])

    return requests.groupBy("part").applyInArrow(run, _MAIL)


def _pair_totals(block: Block, mail: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Learned count of each pair over the corpus, and where the block owns it."""
    answers = [unpack(r["a"], r["n"], "u4") for r in sorted((r for r in mail if r["kind"] == -1), key=lambda r: r["part"])]
    merged = np.concatenate(answers) if answers else np.zeros(0, dtype=np.uint32)
    out = np.empty(len(merged), dtype=np.uint32)
    out[block.order] = merged
    return (out >> np.uint32(1)).astype(np.int64), (out & np.uint32(1)).astype(bool)


def word_requests(block: int, words: np.ndarray, parts: int, kind: int, *values: np.ndarray) -> list[tuple]:
    cuts = spread(words, parts)
    packed = lambda a, b: [pack(v[a:b].astype(np.uint32)) for v in values] + [None] * (3 - len(values))
    return [(p, block, kind, int(b - a), pack_sorted(words[a:b]), *packed(a, b)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]


def answer_words(requests: DataFrame, root_weight: float, root_discount: float, sweep: int) -> DataFrame:
    """Sums each word's tables as a context (a) and as a dish (b); seats the
    parent; answers (context tables, customers of the dish in the parent, its tables)."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
        words, back = np.unique(keys, return_inverse=True)
        sums = [np.bincount(back, np.concatenate([unpack(r[c], r["n"], "u4") for r in rows]), len(words)) for c in ("a", "b")]
        tables = seat(sums[1].astype(np.int64), np.full(len(words), root_weight), root_discount, words, sweep)
        out, at = [], 0
        for r in rows:
            here = back[at:at + r["n"]]
            out.append((r["part"], r["block"], sweep, r["n"], None, *(pack(v[here].astype(np.uint32)) for v in (*sums, tables))))
            at += r["n"]
        # One row more with the part's totals.
        out.append((rows[0]["part"], -1, sweep, 2, None, pack(np.array([sums[1].sum(), tables.sum()], dtype=np.float64)), None, None))
        return pa.Table.from_batches([_mail(out)])

    return requests.groupBy("part").applyInArrow(run, _MAIL)


def count_words(requests: DataFrame) -> DataFrame:
    """Answers each word's learned tokens (kind -2)."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
        words, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, np.concatenate([unpack(r["a"], r["n"], "u4") for r in rows]), len(words))
        out, at = [], 0
        for r in rows:
            out.append((r["part"], r["block"], -2, r["n"], None, pack(total[back[at:at + r["n"]]].astype(np.uint64)), None, None))
            at += r["n"]
        known = total[words != START]
        out.append((rows[0]["part"], -1, -2, 2, None, pack(np.array([known.sum(), (known > 0).sum()], dtype=np.float64)), None, None))
        return pa.Table.from_batches([_mail(out)])

    return requests.groupBy("part").applyInArrow(run, _MAIL)


def _sums(answers: DataFrame) -> np.ndarray:
    """The totals of all parts (one row each)."""
    found = [unpack(bytes(r["a"]), r["n"], "f8") for r in answers.filter("block = -1").select("a", "n").collect()]
    return np.sum(found, axis=0) if found else np.zeros(2)


def _by_word(mail: list[dict], kind: int, n: int, column: str = "a", form: str = "u4") -> np.ndarray:
    rows = sorted((r for r in mail if r["kind"] == kind), key=lambda r: r["part"])
    return np.concatenate([unpack(r[column], r["n"], form) for r in rows]).astype(np.float64) if rows else np.zeros(n)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 2,
          strength: float = 1.0, root_discount: float = 0.75, root_strength: float = 1.0, block_bytes: int = 12 << 20) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity of every row; learns from the rows that aren't held out."""
    spark = docs.sparkSession
    parts = min(65_535, shuffle_partitions(spark))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    blocks = written(corpus_blocks(rows, id_type, block_bytes), "blocks")

    def count_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _mail(word_requests(row["block"], unpack_sorted(row["words"], row["n_words"]), parts, -2, unpack(row["counts"], row["n_words"], "u4")))

    counted = written(count_words(blocks.select("block", "n_words", "words", "counts").mapInArrow(count_requests, _MAIL)), "counts")
    tokens, words = _sums(counted)
    pair_mail = written(answer_pairs(pair_requests(blocks, parts)), "pairs")

    # What a block owns: pairs with several customers, and for each word its single ones.
    own_schema = "block bigint, n_words bigint, words binary, n bigint, context binary, dish binary, customers binary, as_context binary, as_dish binary, ones bigint, twos bigint"
    own_names = [f.split()[0] for f in own_schema.split(", ")]

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        mail = _rows(right)
        for row in _rows(left):
            block = Block(row)
            total, mine = _pair_totals(block, mail)
            single, several = mine & (total == 1), mine & (total > 1)
            n = len(block.words)
            out.append((row["block"], n, row["words"], int(several.sum()), pack(block.context[several].astype(np.uint32)), pack(block.dish[several].astype(np.uint32)),
                        pack(total[several].astype(np.uint32)), pack(np.bincount(block.context[single], minlength=n).astype(np.uint32)),
                        pack(np.bincount(block.dish[single], minlength=n).astype(np.uint32)), int(single.sum()), int((total[several] == 2).sum())))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) if out else [[]] * 11
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], own_names)

    stored = blocks.select("block", "held", "cuts", "n_tokens", "n_words", "codes", "words")
    owned = written(stored.groupBy("block").cogroup(pair_mail.groupBy("block")).applyInArrow(own, own_schema), "owned")
    shape = owned.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    ones, twos = shape["ones"] or 0, shape["twos"] or 0
    discount = float(min(0.95, max(0.1, ones / max(1, ones + 2 * twos))))
    totals = Totals(int(tokens), int(words), discount, strength, root_discount, root_strength, [], [])
    root_weight = (root_strength + root_discount * words) / (words + 1)

    def seated(row: dict, mail: list[dict], sweep: int) -> Iterator[tuple]:
        """The owned tables of one block after a sweep, as word requests."""
        n, m = row["n_words"], row["n"]
        context, dish, customers = (unpack(row[c], m, "u4").astype(np.int64) for c in ("context", "dish", "customers"))
        names = unpack_sorted(row["words"], n)
        if sweep:
            weight = _new_table_weight(totals, mail, sweep - 1, n)
            tables = seat(customers, weight(context, dish), discount, mix(mix(names[context] * _K) + names[dish]), sweep)
        else:
            tables = np.ones(m)
        by = lambda places, single: np.bincount(places, tables, n) + unpack(row[single], n, "u4")
        yield from word_requests(row["block"], names, parts, sweep, by(context, "as_context"), by(dish, "as_dish"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield _mail(list(seated(row, [], 0)))

    def next_sweep(sweep: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            mail = _rows(right)
            return pa.Table.from_batches([_mail([x for row in _rows(left) for x in seated(row, mail, sweep)])])

        return run

    answers: list[DataFrame] = []
    for sweep in range(sweeps + 1):
        if sweep:
            requests = owned.groupBy("block").cogroup(answers[-1].groupBy("block")).applyInArrow(next_sweep(sweep), _MAIL)
        else:
            requests = owned.mapInArrow(begin, _MAIL)
        answered = written(answer_words(requests, root_weight, root_discount, sweep), "words")
        customers, tables = _sums(answered)
        totals.customers.append(float(customers))
        totals.tables.append(float(tables))
        answers.append(answered)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        mail, out = _rows(right), []
        for row in _rows(left):
            out.append(_scored(Block(row), row, mail, totals, sweeps))
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not out:
            return pa.Table.from_arrays([pa.array([], t) for t in (id_arrow(left), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)], names)
        columns = [[x for part in column for x in part] for column in zip(*out, strict=True)]
        kinds = (id_arrow(left), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def id_arrow(table: pa.Table) -> pa.DataType:
        return table.schema.field("ids").type.value_type

    mail = pair_mail.unionByName(counted)
    for answered in answers:
        mail = mail.unionByName(answered)
    scored = (blocks.select("block", "ids", "held", "cuts", "n_tokens", "n_words", "codes", "words").groupBy("block")
              .cogroup(mail.filter("block >= 0").groupBy("block"))
              .applyInArrow(finish, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _new_table_weight(totals: Totals, mail: list[dict], sweep: int, n: int):
    """(strength + discount * tables of the context) * the dish's probability."""
    restaurant = _by_word(mail, sweep, n, "a")
    parent = totals.parent(sweep, _by_word(mail, sweep, n, "b"), _by_word(mail, sweep, n, "c"))
    return lambda context, dish: (totals.strength + totals.discount * restaurant[context]) * parent[dish]


def _scored(block: Block, row: dict, mail: list[dict], totals: Totals, sweeps: int) -> tuple[list, ...]:
    """Columns of the documents of one block."""
    n = len(block.words)
    total, _ = _pair_totals(block, mail)
    count = _by_word(mail, -2, n, "a", "u8")
    several = np.flatnonzero(total > 1)
    keys = mix(mix(block.words[block.context[several]] * _K) + block.words[block.dish[several]])
    probability = np.zeros(len(block.pairs))
    for sweep in range(1, sweeps + 1):
        tables = np.minimum(total, 1).astype(np.float64)
        drawn = _new_table_weight(totals, mail, sweep - 1, n)
        tables[several] = seat(total[several], drawn(block.context[several], block.dish[several]), totals.discount, keys, sweep)
        weight = _new_table_weight(totals, mail, sweep, n)(block.context, block.dish)
        probability += np.maximum(total - totals.discount * tables, 0) + weight
    probability /= sweeps * (totals.strength + count[block.context])
    starts = block.cuts[:-1]
    by_doc = lambda values: np.add.reduceat(values, starts)
    known = count[block.codes]
    base = np.log10((known + 1) / (totals.tokens + totals.words + 1))
    docs = len(starts)
    return (row["ids"], row["held"], np.diff(block.cuts).tolist(), by_doc((known > 0).astype(np.int64)).tolist(), [totals.tokens] * docs,
            by_doc(base).tolist(), by_doc(np.log10(probability)[block.of_token]).tolist())


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32 of the id isn't 2 modulo 7."""
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
