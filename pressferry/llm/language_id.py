"""Operator 1: language identification with interpolated Kneser-Ney character
models, one per language, kept in sorted hash arrays.

Texts are lower-cased and every run of non-letters becomes one space.  The
counts of all four-character grams of every language come from one distributed
aggregate over all learning texts; lower orders use continuation counts of
those grams.  Each order's table is an array of 64-bit hashes in ascending
order with a directory over their leading bits, so that a whole block of
positions is looked up at once; a row holds the log probabilities under every
language, with the back-off worked in.  The language with the lowest cross
entropy per character wins (the first by name in a tie).  ``score`` is the
calibrated probability that it is right: a logistic curve of the evidence,
fitted on learning documents kept out of the counts; ``accepted`` rejects texts
below ``min_score`` or with a cross entropy unlike the language's own texts.

Every gram of every language counts: the continuation counts of the lower
orders and the discounts are aggregates over all grams, and all of them are in
the tables.  Tables of more than ``max_cells`` probabilities are cut into shards
by language and, within a language, by the unit before the last: whatever a
position needs of a language, rows of all orders and back-off weights, has that
unit.  Each shard is held by itself and gives its positions' part of a text's
sum, so a shard bounds memory and loses nothing (one language's grams over a
256th of the units are never cut).  Calibration uses about ``max_calibration``
documents.

Defined results: null text or a text without a letter is ``und`` with score 0;
null languages are not learned from; with nothing to learn every text is
``und``; repeated rows are predicted each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from pressferry.llm.common import fit_logistic, slices, written

ORDER = 4
UNKNOWN = "und"
#: Groups of units (by their last eight bits) that shards of one language are made of.
BUCKETS = 256
_SPACE = 0x20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _folding() -> np.ndarray:
    """What each UTF-16 unit becomes: lower-case letters, marks and surrogate
    halves stay, all else is a space."""
    table = np.full(65536, _SPACE, dtype=np.uint16)
    for code in range(65536):
        if 0xD800 <= code < 0xE000:
            table[code] = code
        elif unicodedata.category(chr(code))[0] in "LM":
            low = chr(code).lower()
            table[code] = ord(low) if len(low) == 1 and ord(low) < 65536 else code
    return table


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def text_units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded units of all texts, each with a space before and after, runs of
    spaces collapsed, and the first unit of each text with the end."""
    encoded = [(" " + t + " ").encode("utf-16-le", "surrogatepass") for t in texts]
    units = _folding()[np.frombuffer(b"".join(encoded), dtype=np.uint16)]
    starts = np.concatenate(([0], np.cumsum([len(e) // 2 for e in encoded]))).astype(np.int64)
    again = np.zeros(len(units), dtype=bool)
    again[1:] = (units[1:] == _SPACE) & (units[:-1] == _SPACE)
    again[starts[:-1]] = False
    kept = np.concatenate(([0], np.cumsum(~again)))
    return units[~again], kept[starts]


def grams(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each unit the gram that ends there: ORDER units in one number, with
    spaces before the beginning of a text."""
    out = np.zeros(len(units), dtype=np.uint64)
    for back in range(ORDER - 1, -1, -1):
        part = np.full(len(units), _SPACE, dtype=np.uint64)
        part[back:] = units[:len(units) - back]
        if back:
            for b in range(back):  # the units before a text's first are spaces
                at = starts[:-1] + b
                part[at[at < starts[1:]]] = _SPACE
        out |= part << np.uint64(16 * back)
    return out


class HashArray:
    """Sorted hashes of distinct 64-bit keys with a directory over their
    leading bits."""

    def __init__(self, keys: np.ndarray):
        hashes = keys * _MULTIPLIER  # odd multiplier: distinct keys stay distinct
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.bits = max(1, int(len(keys) * 4).bit_length())
        lead = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.directory = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        hashes = keys * _MULTIPLIER
        lead = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.directory[lead], self.directory[lead + 1]
        out = np.full(len(keys), -1, dtype=np.int32)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.hashes[at] == hashes[left]
            out[left[same]] = at[same]
            at += 1
            more = ~same & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out


def discount_of(ones: int, twos: int) -> float:
    """The discount of an order from how many of its grams count 1 and 2."""
    return min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))


Level = tuple[np.ndarray, np.ndarray]


class KneserNey:
    """Interpolated Kneser-Ney models of several languages from their gram
    counts: ``counts`` has (grams, counts) by language."""

    def __init__(self, counts: dict[str, Level]):
        levels: dict[str, list[Level]] = {}
        for lang in sorted(counts):
            keys, n = counts[lang]
            tower = [(keys.astype(np.uint64), n.astype(np.float64))]
            for order in range(ORDER - 1, 0, -1):
                shorter = tower[0][0] & np.uint64((1 << 16 * order) - 1)
                tower.insert(0, tuple(np.unique(shorter, return_counts=True)))  # continuation counts
            levels[lang] = tower
        symbols = len(np.unique(np.concatenate([t[0][0] for t in levels.values()]))) + 1
        self._fill(levels, {x: [discount_of((n == 1).sum(), (n == 2).sum()) for _, n in t] for x, t in levels.items()}, symbols, None)

    @classmethod
    def shard(cls, levels: dict[str, list[Level]], discounts: dict[str, list[float]], symbols: int, buckets: np.ndarray | None) -> KneserNey:
        """The part of larger models that has the given buckets (None: all) of
        the languages of ``levels``: sorted grams and (continuation) counts from
        order 1 up; order 1 is whole."""
        model = cls.__new__(cls)
        model._fill(levels, discounts, symbols, buckets)
        return model

    def _fill(self, towers: dict[str, list[Level]], discounts: dict[str, list[float]], symbols: int, buckets: np.ndarray | None) -> None:
        self.languages = sorted(towers)
        self.buckets = buckets
        levels = [towers[x] for x in self.languages]
        self.floor = float(-np.log(symbols))
        self.tables: list[tuple[HashArray, np.ndarray]] = []  # log probability of each gram, by order
        self.weights: list[tuple[HashArray, np.ndarray]] = []  # log back-off weight of each history, by order
        for k in range(ORDER):
            keys = np.unique(np.concatenate([t[k][0] for t in levels]))
            below = self._lower(keys, k)
            table = np.empty((len(keys), len(self.languages)), dtype=np.float64)
            histories = np.unique(keys >> np.uint64(16))
            weight = np.zeros((len(histories), len(self.languages)), dtype=np.float64)
            for i, tower in enumerate(levels):
                own, n = tower[k]
                n = n.astype(np.float64)
                discount = discounts[self.languages[i]][k]
                at = np.searchsorted(histories, own >> np.uint64(16))
                total = np.bincount(at, n, len(histories))
                kinds = np.bincount(at, minlength=len(histories))
                seen = total > 0
                back = np.ones(len(histories))
                back[seen] = discount * kinds[seen] / total[seen]
                weight[:, i] = np.log(back)
                p = np.exp(below[:, i]) * back[np.searchsorted(histories, keys >> np.uint64(16))]
                p[np.searchsorted(keys, own)] += (n - discount) / total[at]
                table[:, i] = np.log(p)
            for store, name, values in ((self.tables, keys, table), (self.weights, histories, weight)):
                array = HashArray(name)
                store.append((array, values[array.order].astype(np.float32)))

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log probabilities of the keys' last k units under each language."""
        if k == 0:
            return np.full((len(keys), len(self.languages)), self.floor)
        return self.log_p(keys & np.uint64((1 << 16 * k) - 1), k).astype(np.float64)

    def log_p(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log probability of each gram's last unit, by language."""
        array, values = self.tables[order - 1]
        at = array.find(keys)
        out = values[at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            missing = keys[lost]
            if order > 1:
                rest = self.log_p(missing & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            else:
                rest = np.full((len(lost), len(self.languages)), self.floor, dtype=np.float32)
            histories, weight = self.weights[order - 1]
            known = histories.find(missing >> np.uint64(16))
            rest = rest + np.where((known >= 0)[:, None], weight[known], np.float32(0))
            out[lost] = rest
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per unit of each text under each language; the unit counts."""
        total, n = self.totals(texts)
        return -total / np.maximum(n, 1)[:, None], n

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text under each language (in a shard: of the
        positions of its buckets); the unit counts."""
        sums, sizes = [], []
        chunk: list[str] = []
        length = 0
        for text in [*texts, None]:
            if chunk and (text is None or length + len(text) > 1 << 20):
                units, starts = text_units(chunk)
                sums.append(self._sum(units, starts))
                sizes.append(np.diff(starts))
                chunk, length = [], 0
            if text is not None:
                chunk.append(text)
                length += len(text)
        n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        total = np.concatenate(sums) if sums else np.zeros((0, len(self.languages)))
        return total, n

    def _of_shard(self, keys: np.ndarray) -> np.ndarray:
        """log_p of the positions that are this shard's, 0 of the others."""
        if self.buckets is None:
            return self.log_p(keys)
        out = np.zeros((len(keys), len(self.languages)), dtype=np.float32)
        own = np.flatnonzero(self.buckets[(keys >> np.uint64(16)) & np.uint64(BUCKETS - 1)])
        out[own] = self.log_p(keys[own])
        return out

    def _sum(self, units: np.ndarray, starts: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        keys = grams(units, starts)
        out = np.zeros((len(starts) - 1, len(self.languages)))
        for a in range(0, len(keys), step):
            b = min(len(keys), a + step)
            first = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, b, "left")) - 1
            cuts = np.maximum(starts[first:last + 1], a) - a
            out[first:last + 1] += np.add.reduceat(self._of_shard(keys[a:b]), cuts, axis=0, dtype=np.float64)
        return out


class Identifier:
    """The shards of a model with their calibration."""

    def __init__(self, languages: list[str], min_score: float = 0.5):
        self.languages, self.min_score = languages, min_score
        self.shards: list[tuple[list[str], Broadcast]] = []  # languages and tables
        self.curve = (0.0, 1.0)
        self.limit = np.full(len(languages), np.inf)

    def evidence(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The winner, its cross entropy, and the log of its lead in nats."""
        best = entropy.argmin(axis=1) if len(entropy) else np.zeros(0, dtype=np.int64)
        ordered = np.sort(entropy, axis=1)
        lead = (ordered[:, 1] - ordered[:, 0]) * n if entropy.shape[1] > 1 else n.astype(float)
        return best, ordered[:, 0], np.log1p(lead)

    def calibrate(self, best: np.ndarray, entropy: np.ndarray, lead: np.ndarray, langs: list[str]) -> None:
        """Fit the score curve (logistic) and each
        language's highest usual cross entropy to the evidence of texts whose
        languages are known."""
        if not len(best):
            return
        truth = np.array([self.languages.index(x) if x in self.languages else -1 for x in langs])
        right = (best == truth).astype(float)
        x = np.concatenate((lead, [0.0, 0.0]))  # without a lead it is a coin toss
        y = np.concatenate((right, [0.0, 1.0]))
        start, slope = fit_logistic(x, y, 0.01)
        self.curve = (start, max(1e-3, slope))
        for i in range(len(self.languages)):
            own = entropy[(best == i) & (truth == i)]
            if len(own) >= 20:
                self.limit[i] = own.mean() + 6 * own.std()

    def predict(self, entropy: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        best, least, lead = self.evidence(entropy, n)
        score = 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * lead, -30, 30)))
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
        score = np.where(letters, score, 0.0)
        return names, score, least, letters & (score >= self.min_score) & (least <= self.limit[best])


def _with_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and has_letter(t) for t in texts], dtype=bool)


def judged(rows: DataFrame, identifier: Identifier, keep: list[str], text_col: str, results: str, finish: Callable[..., list]) -> DataFrame:
    """The kept columns and ``results``, which ``finish`` makes of the
    identifier, the cross entropies, the unit counts and whether there is a letter."""
    names = [*keep, *[f.split()[0] for f in results.split(", ")]]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), results])
    slim = Identifier(identifier.languages, identifier.min_score)
    slim.curve, slim.limit = identifier.curve, identifier.limit
    shards = identifier.shards

    def out(batch: pa.RecordBatch, *found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x) for x in finish(slim, *found))], names)

    if len(shards) == 1:
        whole = shards[0][1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col, 4 << 20):
                texts = batch.column(text_col).to_pylist()
                yield out(batch, *whole.value.cross_entropy([t or "" for t in texts]), _with_letter(texts))

        return rows.select(*keep, text_col).mapInArrow(run, schema)

    def partial(part: int, shared: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col, 4 << 20):
                texts = batch.column(text_col).to_pylist()
                total, n = shared.value.totals([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), pa.array([part] * len(n), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary()), pa.array(n), pa.array(_with_letter(texts))],
                    ["_row", "_part", "_sums", "_n", "_letters"])
        return run

    numbered = written(rows.select(*keep, text_col).withColumn("_row", F.monotonically_increasing_id()), "texts")
    sums = reduce(DataFrame.unionByName, [
        numbered.select("_row", text_col).mapInArrow(partial(k, shared), "_row bigint, _part int, _sums binary, _n bigint, _letters boolean")
        for k, (_, shared) in enumerate(shards)])
    met = sums.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_part", "_sums"))).alias("_parts"), F.first("_n").alias("_n"), F.first("_letters").alias("_letters"))
    places = [np.array([slim.languages.index(x) for x in langs]) for langs, _ in shards]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = np.zeros((batch.num_rows, len(slim.languages)))
            for i, parts in enumerate(batch.column("_parts").to_pylist()):
                for part in parts:
                    total[i, places[part["_part"]]] += np.frombuffer(part["_sums"], dtype=np.float64)
            n = batch.column("_n").to_numpy()
            yield out(batch, -total / np.maximum(n, 1)[:, None], n, batch.column("_letters").to_numpy(zero_copy_only=False))

    return numbered.drop(text_col).join(met, "_row").select(*keep, "_parts", "_n", "_letters").mapInArrow(gather, schema)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id is in fold 0)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0))


def gram_counts(learn: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, gram, n over all given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held[lang]]), len(keys)).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            keys, n = merged(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in slices(batches, text_col, 2 << 20):
            langs = np.array(batch.column(lang_col).to_pylist(), dtype=object)
            texts = batch.column(text_col).to_pylist()
            for lang in dict.fromkeys(langs):
                units, starts = text_units([t for t, x in zip(texts, langs, strict=True) if x == lang])
                held.setdefault(lang, []).append(np.unique(grams(units, starts), return_counts=True))
                if len(held[lang]) >= 8:
                    held[lang] = [merged(lang)]
                if sum(len(k) for k, _ in held[lang]) > 1 << 21:
                    yield out(lang)
                    held[lang] = []
        for lang in [x for x in held if held[x]]:
            yield out(lang)

    return (learn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        lambda b: run(pa.RecordBatch.from_arrays(x.columns, [lang_col, text_col]) for x in b), "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def plan_shards(rows: dict[str, np.ndarray], max_cells: int) -> list[tuple[list[str], np.ndarray | None]]:
    """(languages, their buckets or None for all) of each shard, from the rows
    of each language and bucket: every language and bucket is in one.  A row
    has a cell for each language of its shard, four at least (its hash and its
    entries of the directory)."""
    shards: list[tuple[list[str], np.ndarray | None]] = []
    group: list[str] = []
    held = 0
    for lang in sorted(rows):
        n = int(rows[lang].sum())
        if group and (held + n) * max(4, len(group) + 1) > max_cells:
            shards.append((group, None))
            group, held = [], 0
        if n * 4 <= max_cells:
            group.append(lang)
            held += n
            continue
        own, size = np.zeros(BUCKETS, dtype=bool), 0
        for bucket in range(BUCKETS):
            more = int(rows[lang][bucket])
            if size and (size + more) * 4 > max_cells and more:
                shards.append(([lang], own))
                own, size = np.zeros(BUCKETS, dtype=bool), 0
            own[bucket] = True
            size += more
        shards.append(([lang], own))
    return [*shards, (group, None)] if group else shards


def train(learn: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
          max_cells: int = 1 << 24, max_calibration: int = 4000, min_score: float = 0.5) -> Identifier | None:
    """Learn from the rows with text and language; None if there are none."""
    known = learn.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = known.count()
    rate = min(0.1, max_calibration / max(total, 1))
    # By id and text: of the rows that share an id (or have none) a part is drawn.
    aside = (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("calibration")), F.lit(1 << 20)) < int(rate * (1 << 20)))
    levels = [written(gram_counts(known.filter(~aside), lang_col, text_col), "grams")]
    for order in range(ORDER - 1, 0, -1):  # continuation counts, of all grams
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")
        levels.insert(0, written(levels[0].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n")), "grams"))
    bucket = F.when(F.col("k") == 0, -1).otherwise(F.shiftright("gram", 16).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    every = reduce(DataFrame.unionByName, [df.withColumn("k", F.lit(k)) for k, df in enumerate(levels)]).withColumn("bucket", bucket)
    # A few rows for each language: how many grams each order and bucket has, how many of them count 1 and 2.
    sizes = every.groupBy("lang", "k", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()
    langs = sorted({r["lang"] for r in sizes})
    if not langs:
        return None
    symbols = levels[0].select("gram").distinct().count() + 1
    seen = {x: np.zeros((ORDER, 2), dtype=np.int64) for x in langs}
    rows = {x: np.zeros(BUCKETS, dtype=np.int64) for x in langs}
    for r in sizes:
        seen[r["lang"]][r["k"]] += (r["ones"], r["twos"])
        if r["k"]:
            rows[r["lang"]][r["bucket"]] += r["rows"]
    discounts = {x: [discount_of(int(a), int(b)) for a, b in seen[x]] for x in langs}
    identifier = Identifier(langs, min_score)
    for some, buckets in plan_shards(rows, max_cells):
        part = every.filter(F.col("lang").isin(some))
        if buckets is not None:
            part = part.filter((F.col("k") == 0) | F.col("bucket").isin(np.flatnonzero(buckets).tolist()))
        model = KneserNey.shard(_towers(part.select("lang", "k", "gram", "n").toArrow(), some), {x: discounts[x] for x in some}, symbols, buckets)
        identifier.shards.append((model.languages, learn.sparkSession.sparkContext.broadcast(model)))
        del model

    # Rows of equal id and text are drawn together: one of them is enough.
    drawn = (known.filter(aside).groupBy(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(lang_col)).agg(F.first(text_col).alias(text_col)))
    seen_aside = judged(drawn, identifier, [lang_col], text_col, "best bigint, entropy double, lead double",
                        lambda own, entropy, n, letters: list(own.evidence(entropy, n))).toPandas()
    identifier.calibrate(*(seen_aside[c].to_numpy() for c in ("best", "entropy", "lead")), seen_aside[lang_col].tolist())
    return identifier


def _towers(rows: pa.Table, langs: list[str]) -> dict[str, list[Level]]:
    """Sorted grams and counts by language, from order 1 up."""
    out: dict[str, list[Level]] = {}
    for lang in langs:
        out[lang] = []
        for k in range(ORDER):
            own = rows.filter(pc.and_(pc.equal(rows.column("lang"), lang), pc.equal(rows.column("k"), k)))
            keys = own.column("gram").to_numpy().astype(np.int64).view(np.uint64)
            at = np.argsort(keys)
            out[lang].append((keys[at], own.column("n").to_numpy()[at]))
    return out


def identify(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, lang_pred, score, cross_entropy, accepted of every row."""
    if identifier is None:
        return docs.select(id_col, *keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("cross_entropy"), F.lit(False).alias("accepted"))
    return judged(docs, identifier, [id_col, *keep], text_col, "lang_pred string, score double, cross_entropy double, accepted boolean",
                  lambda own, entropy, n, letters: list(own.predict(entropy, n, letters)))


def held_out_prediction(docs: DataFrame) -> DataFrame:
    """Learn from the folds other than 2 of 4, predict every document."""
    held_out = fold(F.col("doc_id"), 4) == 2
    identifier = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), identifier, keep=("held_out",))
