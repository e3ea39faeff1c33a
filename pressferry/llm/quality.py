"""Operator 10: quality classifier by hierarchical empirical Bayes.

Two verdicts, quality (good or bad) and toxicity, go through the same steps.

1. Document evidence.  A text shows a set of signs: its distinct words, hashed
   to 2 ** 18 places, and the levels of a few shape measures (capitals, marks,
   repeated words, word length).  One grouped aggregate over all labelled
   documents counts each sign by label.  A sign counts as evidence where its
   frequencies differ by more than chance (``min_z``).  The weights of these
   signs are fitted by a ridge logistic regression on a bounded sample of
   labelled documents (``max_fit``); a text's evidence is their sum.
2. Sites.  Hosts and paths below them collect the labels of their documents,
   and the document probability where a label is missing, in grouped
   aggregates.  A host's rate shrinks to the global one and a path's to its
   host's; how much comes from how far sites differ (method of moments).
3. The document's log odds against the global rate add to the log odds of its
   path.

A document is rejected when it is more likely bad than good, or more likely
toxic than not.

Defined results: null or empty text shows no sign, so its site decides; null
labels are not counted; several labels of one id count each (a document with
many labels keeps one row: the labels are averaged); null hosts or paths form
a site of their own; without labels every document is kept with the prior 0.5;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pressferry.llm.common import slices, whole_texts, word_codes, word_hashes, written

PLACES = 1 << 18
LEVELS = 12
HEADS = ("quality", "toxic")
#: Labelled documents up to which the label table is sent to every executor.
SMALL_LABELS = 2_000_000

_CAPITAL, _MARK, _DIGIT, _INK = (np.zeros(256, dtype=bool) for _ in range(4))
_CAPITAL[65:91] = True
_DIGIT[48:58] = True
_INK[33:] = True
_MARK[33:127] = True
for _span in ((48, 58), (65, 91), (97, 123)):
    _MARK[slice(*_span)] = False


def signs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every sign: words below PLACES, measures above."""
    texts = whole_texts(texts)
    offsets, codes, words = word_codes(texts)
    n_docs = len(texts)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), size)
    kinds = max(1, len(words))
    pairs = np.unique(doc * kinds + codes)
    of_doc, code = pairs // kinds, pairs % kinds
    place = (word_hashes(words) >> np.uint64(64 - 18)).astype(np.int64) if len(words) else np.zeros(0, dtype=np.int64)

    cuts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n_docs + 1] if n_docs else np.zeros(1, dtype=np.int64)
    # Only these texts: the buffer is that of the whole batch.
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[cuts[0]:cuts[-1]]
    cuts = cuts - cuts[0]
    counted = lambda kind: np.diff(np.concatenate(([0], np.cumsum(kind[raw], dtype=np.int64)))[cuts])
    ink = np.maximum(counted(_INK), 1)
    distinct = np.bincount(of_doc, minlength=n_docs)
    same = np.zeros(len(codes), dtype=bool)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    measures = (counted(_CAPITAL) / ink, counted(_MARK) / ink, counted(_DIGIT) / ink, distinct / np.maximum(size, 1),
                np.bincount(doc, same, n_docs) / np.maximum(size, 1), np.minimum(1, ink / np.maximum(size, 1) / 24))
    full = np.flatnonzero(size)
    out_doc, out_place = [of_doc], [place[code] if len(code) else code]
    for i, measure in enumerate(measures):
        level = np.minimum(LEVELS - 1, (np.sqrt(measure[full]) * LEVELS).astype(np.int64))
        out_doc.append(full)
        out_place.append(PLACES + i * LEVELS + level)
    all_doc, all_place = np.concatenate(out_doc), np.concatenate(out_place)
    width = PLACES + len(measures) * LEVELS
    both = np.unique(all_doc * width + all_place)  # two words in one place are one sign
    return both // width, both % width


WIDTH = PLACES + 6 * LEVELS


def sign_counts(labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """place, and for each head and label value the number of labelled
    documents that show it; place -1 counts the documents."""
    columns = [f"{h}_{v}" for h in HEADS for v in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), WIDTH + 1))
        some = False
        for batch in slices(batches, text_col, 1 << 20):
            some = True
            doc, place = signs(batch.column(text_col))
            for i, head in enumerate(HEADS):
                label = pc.fill_null(batch.column(head), -1.0).to_numpy(zero_copy_only=False)
                for v in (0, 1):
                    weight = np.where(label < 0, 0.0, label if v else 1.0 - label)
                    total[2 * i + v, :WIDTH] += np.bincount(place, weight[doc], WIDTH)
                    total[2 * i + v, WIDTH] += weight.sum()
        if some:
            shown = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(shown == WIDTH, -1, shown)), *(pa.array(t[shown]) for t in total)], ["place", *columns])

    schema = "place bigint, " + ", ".join(f"{c} double" for c in columns)
    partial = labelled.select(text_col, *HEADS).mapInArrow(run, schema)
    return partial.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns])


def _logit(p: float | np.ndarray) -> float | np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def weights(counts: np.ndarray, places: np.ndarray, min_z: float = 4.0, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of every sign for each head (zero unless significant), and
    the heads' global rates.  ``counts``: rows of place, columns by head and value."""
    out, rates = np.zeros((WIDTH, len(HEADS)), dtype=np.float32), np.full(len(HEADS), 0.5)
    at = places >= 0
    if not (places < 0).any():
        return out, rates
    totals = counts[places < 0][0]
    for i in range(len(HEADS)):
        n0, n1 = totals[2 * i], totals[2 * i + 1]
        rates[i] = (n1 + 1) / (n0 + n1 + 2)
        if not n0 or not n1:
            continue
        a0, a1 = counts[at, 2 * i], counts[at, 2 * i + 1]
        seen = a0 + a1
        base = seen / (n0 + n1)
        p0, p1 = (a0 + prior * base) / (n0 + prior), (a1 + prior * base) / (n1 + prior)
        z = (a1 / n1 - a0 / n0) / np.sqrt(np.maximum(base * (1 - base), 1e-12) * (1 / n0 + 1 / n1))
        out[places[at], i] = np.where((np.abs(z) > min_z) & (seen >= 5), np.clip(np.log(p1 / p0), -6, 6), 0.0)
    return out, rates


def fit_weights(doc: np.ndarray, place: np.ndarray, y: np.ndarray, start: float, ridge: float = 1e-6,
                rounds: int = 40, inner: int = 40, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the places and intercept of a ridge logistic regression on
    documents given by their signs (doc, place).  Documents that are copies of
    each other share their signs, so the signs they have by chance compete for
    the same few residuals instead of adding up.  ``ridge`` is that of the mean
    loss, so few labels aren't shrunk more than many.  Newton steps (each solved
    by conjugate gradients, halved until the loss falls) until the gradient is
    ``tolerance`` of the first."""
    shown, column = np.unique(place, return_inverse=True)
    n, k = len(y), len(shown)
    penalty = np.append(np.full(k, max(ridge * n, 1e-4)), 0.0)
    w = np.zeros(k + 1)
    w[-1] = start
    margin = lambda v: np.bincount(doc, v[column], n) + v[-1]
    back = lambda r: np.append(np.bincount(column, r[doc], k), r.sum())
    loss = lambda v, m: float((np.logaddexp(0, m) - y * m).sum() + (penalty * v * v).sum() / 2)
    m = margin(w)
    now, first = loss(w, m), None
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        g = back(p - y) + penalty * w
        size = float(np.linalg.norm(g))
        first = first or size
        if size <= tolerance * first:
            break
        curve = np.maximum(p * (1 - p), 1e-10)
        scale = np.append(np.bincount(column, curve[doc], k), curve.sum()) + penalty + 1e-8
        step, r = np.zeros(k + 1), -g
        z = r / scale
        d, rz, rest = z.copy(), float(r @ z), min(0.1, np.sqrt(size / first)) * size
        for _ in range(inner):
            h = back(curve * margin(d)) + penalty * d + 1e-8 * d
            a = rz / max(float(d @ h), 1e-300)
            step, r = step + a * d, r - a * h
            if np.linalg.norm(r) <= rest:
                break
            z = r / scale
            rz, old = float(r @ z), rz
            d = z + rz / old * d
        far, t = margin(step), 1.0
        while t > 1e-6 and (new := loss(w + t * step, m + t * far)) >= now:
            t /= 2
        if t <= 1e-6:
            break
        w, m = w + t * step, m + t * far
        if now - new < 1e-7 * max(1.0, new):
            break
        now = new
    out = np.zeros(WIDTH, dtype=np.float32)
    out[shown] = w[:-1]
    return out, float(w[-1])


class Classifier:
    """Sign weights, global rates and the curve of each head."""

    def __init__(self, sign_weights: np.ndarray, rates: np.ndarray):
        self.weights, self.rates = sign_weights, rates
        self.curves = np.stack((_logit(rates), np.zeros(len(rates))), axis=1)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        doc, place = signs(texts)
        return np.stack([np.bincount(doc, self.weights[place, i], len(texts)) for i in range(len(HEADS))], axis=1)

    def fit(self, places: list[np.ndarray], labels: np.ndarray) -> None:
        """Fit the weights of the significant signs to labelled documents."""
        doc = np.repeat(np.arange(len(places)), [len(p) for p in places])
        place = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        fitted = np.zeros_like(self.weights)
        for i in range(len(HEADS)):
            use = labels[:, i] >= 0 if len(labels) else np.zeros(0, dtype=bool)
            entry = use[doc] & (self.weights[place, i] != 0)
            if not use.any() or not entry.any():
                continue
            rank = np.cumsum(use) - 1
            fitted[:, i], start = fit_weights(rank[doc[entry]], place[entry], labels[use, i], float(_logit(self.rates[i])))
            self.curves[i] = start, 1.0
        self.weights = fitted

    def log_odds(self, evidence: np.ndarray) -> np.ndarray:
        """Log odds of each head from the text alone."""
        return np.clip(self.curves[:, 0] + self.curves[:, 1] * evidence, -30, 30)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_fit: int = 20_000) -> tuple[Classifier, DataFrame]:
    """The classifier, and the label of each id (one row an id)."""
    spark = docs.sparkSession
    by_id = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
             .agg(*[F.avg(F.when(F.col(h).isin(0, 1), F.col(h).cast("double"))).alias(h) for h in HEADS]))
    by_id = written(by_id, "labels")
    n = by_id.count()
    side = F.broadcast(by_id) if n <= SMALL_LABELS else by_id
    text = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"))
    labelled = text.join(side, F.col("own_id") == F.col("label_id")).select("label_id", "text", *HEADS)
    rows = sign_counts(labelled).toArrow()  # at most one row for each of WIDTH places, and the number of documents
    places = rows.column("place").to_numpy()
    counts = np.stack([rows.column(i).to_numpy() for i in range(1, rows.num_columns)], axis=1) if rows.num_rows else np.zeros((0, 4))
    classifier = Classifier(*weights(counts, places.astype(np.int64)))
    wanted = spark.sparkContext.broadcast(classifier.weights.any(axis=1))  # WIDTH flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            doc, place = signs(batch.column("text"))
            kept = wanted.value[place]
            cuts = np.searchsorted(doc[kept], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), pa.array(place[kept].astype(np.int32))),
                                              *(pc.fill_null(batch.column(h), -1.0) for h in HEADS)], ["places", *HEADS])

    # Drawn by id and text, at a rate of the labelled rows: an id that many rows
    # share is drawn in part.  Equal rows come together, so each text is taken once.
    total = float(counts[places < 0][0].reshape(-1, 2).sum(axis=1).max()) if (places < 0).any() else 0.0
    rate = min(1.0, max_fit / max(total, 1))
    drawn = labelled.filter(F.pmod(F.xxhash64(F.col("label_id").cast("string"), "text", F.lit("fit")), F.lit(1 << 20)) < int(rate * (1 << 20)))
    drawn = drawn.groupBy("label_id", F.xxhash64("text").alias("_h")).agg(*[F.first(c).alias(c) for c in ("text", *HEADS)]).drop("_h")
    seen = drawn.mapInArrow(run, "places array<int>, quality double, toxic double").toArrow().combine_chunks()
    lists = seen.column("places").to_pandas().to_list() if seen.num_rows else []
    classifier.fit([np.asarray(x, dtype=np.int64) for x in lists], np.stack([seen.column(h).to_numpy() for h in HEADS], axis=1))
    return classifier, by_id


def _shrunk(sites: DataFrame, head: str, prior: Column, strength: float) -> DataFrame:
    return sites.withColumn(f"{head}_rate", (F.col(f"{head}_sum") + strength * prior) / (F.col("n") + strength))


def _strength(sites: DataFrame, head: str, prior: Column) -> float:
    """Prior count by the method of moments: how far the sites' rates spread
    beyond what their sizes explain."""
    mean = F.col(f"{head}_sum") / F.col("n")
    row = sites.agg(F.sum(F.col("n") * (mean - prior) ** 2).alias("spread"), F.sum(prior * (1 - prior)).alias("noise"),
                    F.sum("n").alias("n"), F.sum(F.col("n") * prior * (1 - prior)).alias("inner")).first()
    if not row["n"]:
        return 100.0
    between = (row["spread"] - row["noise"]) / row["n"]
    inner = row["inner"] / row["n"]
    return float(min(1e4, max(1.0, inner / between - 1))) if between > 1e-9 else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
             text_col: str = "text", max_fit: int = 20_000) -> DataFrame:
    """id, text_hash, host, path, text_quality and text_toxic (from the text
    alone), host and path rates, p_quality, p_toxic, keep, of every row."""
    classifier, by_id = train(docs, labels, id_col, text_col, max_fit)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = shared.value.log_odds(shared.value.evidence(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "text_hash", "host", "path")), pa.array(found[:, 0]), pa.array(found[:, 1])],
                                             ["id", "text_hash", "host", "path", "text_quality", "text_toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
                       F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    scored = written(rows.mapInArrow(run, f"id {id_type}, text_hash bigint, host string, path string, text_quality double, text_toxic double"), "evidence")
    odds = lambda p: F.log(p / (1 - p))
    probability = lambda x: 1 / (1 + F.exp(-x))

    known = scored.join(by_id, scored["id"] == by_id["label_id"], "left")
    paths = known.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.coalesce(F.col(h), probability(F.col(f"text_{h}")))).alias(f"{h}_sum") for h in HEADS])
    paths = written(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"{h}_sum").alias(f"{h}_sum") for h in HEADS])
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"{h}_sum").alias(h) for h in HEADS]).first()
    for h in HEADS:
        rate = F.lit((total[h] + 1) / (total["n"] + 2) if total["n"] else 0.5)
        hosts = _shrunk(hosts, h, rate, _strength(hosts, h, rate))
    hosts = hosts.select("host", *[F.col(f"{h}_rate").alias(f"host_{h}") for h in HEADS])
    paths = paths.join(hosts, "host")
    for h in HEADS:
        paths = _shrunk(paths, h, F.col(f"host_{h}"), _strength(paths, h, F.col(f"host_{h}")))
    paths = paths.select("host", "path", *[f"host_{h}" for h in HEADS], *[F.col(f"{h}_rate").alias(f"path_{h}") for h in HEADS])
    joined = scored.join(paths, ["host", "path"])
    for i, h in enumerate(HEADS):
        joined = joined.withColumn(f"p_{h}", probability(F.col(f"text_{h}") - F.lit(float(_logit(classifier.rates[i]))) + odds(F.col(f"path_{h}"))))
    return joined.select(F.col("id").alias(id_col), "text_hash", "host", "path", *[probability(F.col(f"text_{h}")).alias(f"text_{h}") for h in HEADS],
                         *[f"{level}_{h}" for level in ("host", "path") for h in HEADS], *[f"p_{h}" for h in HEADS],
                         ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") <= 0.5)).alias("keep"))


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sites of ``documents``: the source is the host, a language's part of
    it the path."""
    return classify(docs, labels, F.col("source"), F.col("lang"))
