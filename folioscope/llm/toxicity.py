"""Toxicity scores from averaged subword-bag embeddings under a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed to a fixed number of rows) and of the word
itself; a span of ``SPAN`` consecutive words is the mean of its words; a linear softmax over the span gives the
chance of label 1. Embeddings and softmax are trained jointly in numpy. A document is as toxic as its most
toxic span, so long documents aren't diluted. Labels belong to documents: spans start with their document's label,
and between rounds the spans of toxic documents that score low are taken out, except the highest of each.

Misspelt words share n-grams, and so vectors, with the words learned from. At scoring time a word's part of the
logit is one number, found once per distinct word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_slices, unused_name

#: The bound of the training sample: labelled rows of each label, learned from whole.
SAMPLE_DOCS = 1000
BUCKETS = 1 << 18
DIMENSIONS = 4
SPAN = 16
GRAMS = (3, 4, 5)
#: Rounds of fitting, steps in each, and the share of the sample (one in so many) kept for calibration.
ROUNDS, STEPS, CALIBRATE = 4, 25, 4
#: Toxic documents at which a subword row has half its weight.
TRUST = 3
#: A subword row in one of so many other documents has half its weight.
FREQUENT = 50
CACHED = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' subwords, word after word, and where each word's begin.

    A word is lower-cased and loses punctuation at its ends; its subwords are itself and the n-grams of <word>.
    """
    cores = [w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—\n") for w in words]
    points = np.frombuffer("".join([f"<{c}>" for c in cores]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(c) + 2 for c in cores], np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # characters from each one to its word's end
    at, rows = [np.arange(len(cores))], [np.array([zlib.crc32(c.encode("utf-8", "surrogatepass")) for c in cores], np.uint64) * _MULTIPLIER]
    owner = np.repeat(np.arange(len(cores)), sizes)
    for n in GRAMS:
        starts = np.nonzero(left >= n)[0]
        h = np.full(len(starts), n, np.uint64)
        for k in range(n):
            h = (h ^ points[starts + k]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        at.append(owner[starts])
        rows.append(h * _MULTIPLIER)
    at, rows = np.concatenate(at), (np.concatenate(rows) >> np.uint64(40)).astype(np.int64) % BUCKETS
    order = np.argsort(at, kind="stable")
    return rows[order], np.searchsorted(at[order], np.arange(len(cores)))


def spans_of(n: int) -> np.ndarray:
    """Starts of the spans of n words: each of SPAN words, the last of the rest; a rest under half joins it."""
    starts = np.arange(0, max(n, 1), SPAN)
    return starts[:-1] if len(starts) > 1 and n - starts[-1] < SPAN // 2 else starts


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, between ASCII white space, for training and scoring alike."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class ToxicityModel:
    """bias, and the number that each subword row adds to a word's logit."""

    def __init__(self, rows: np.ndarray, bias: float):
        self.rows, self.bias, self.known = rows.astype(np.float32), float(bias), {}

    def words(self, words: list[str]) -> list[float]:
        """Each word's part of the logit: the mean of its subwords'."""
        if not words:
            return []
        grams, starts = subwords(words)
        return (np.add.reduceat(self.rows[grams], starts) / np.diff(np.concatenate([starts, [len(grams)]]))).tolist()

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of the most toxic span of each text; the bias for a text without words."""
        split = [words_of(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in self.known})
        if len(self.known) + len(new) > CACHED:
            self.known = {}
            new = list({w for ws in split for w in ws})
        self.known.update(zip(new, self.words([w.decode("utf-8", "replace") for w in new])))
        get, out = self.known.__getitem__, np.full(len(texts), self.bias)
        for i, ws in enumerate(split):
            if ws:
                starts = spans_of(len(ws))
                sums = np.add.reduceat(np.fromiter(map(get, ws), np.float64, len(ws)), starts)
                out[i] += (sums / np.diff(np.append(starts, len(ws)))).max()
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Chances of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -60, 60)))


def _csr_by_column(starts: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries regrouped by column: (row of each entry, columns present, their starts)."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(columns, kind="stable")
    present, at = np.unique(columns[order], return_index=True)
    return rows[order], present, at


def train(texts: list[str], labels: list[int], seed: int = 5) -> ToxicityModel:
    """Fit to labelled texts. With one label only (or none), every score is the share of label 1, smoothed.

    One text in CALIBRATE is kept back; the logit's scale and bias are fitted to these by logistic regression.
    """
    y_all = np.array(labels, np.float64)
    prior = (y_all.sum() + 0.5) / (len(y_all) + 1) if len(y_all) else 0.01
    flat = ToxicityModel(np.zeros(BUCKETS), np.log(prior / (1 - prior)))
    nth = np.zeros(len(y_all), np.int64)
    for k in (0, 1):
        nth[y_all == k] = np.arange((y_all == k).sum())
    held = nth % CALIBRATE == CALIBRATE - 1
    if not (0 < y_all[held].sum() < held.sum()):
        held[:] = False  # too few to calibrate on others than those learned from
    if not 0 < y_all[~held].sum() < (~held).sum():
        return flat
    model = _fit([t for t, h in zip(texts, held) if not h], y_all[~held], seed)
    check = held if held.any() else ~held
    x, y = model.logits([t for t, c in zip(texts, check) if c]), y_all[check]
    center, spread = x.mean(), x.std() or 1.0
    x = (x - center) / spread
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    if (x * (y - 0.5)).sum() <= 0:
        return model  # no use for calibration
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = weight * (p - y)
        a, b = max(1e-3, a - 4 * ((g * x).sum() + 1e-4 * a)), b - 4 * g.sum()
    return ToxicityModel(model.rows * (a / spread), b + a * (model.bias - center) / spread)


def _fit(texts: list[str], y_doc: np.ndarray, seed: int) -> ToxicityModel:
    index: dict[str, int] = {}
    tokens, starts, span_doc, at = [], [], [], 0
    for d, text in enumerate(texts):
        words = [w.decode("utf-8", "replace") for w in words_of(text)]
        if words:
            tokens.extend(index.setdefault(w, len(index)) for w in words)
            s = spans_of(len(words))
            starts.extend(at + s)
            span_doc.extend([d] * len(s))
            at += len(words)
    if not tokens:
        return ToxicityModel(np.zeros(BUCKETS), 0.0)
    tokens, span_starts, span_doc = np.array(tokens), np.array([*starts, at]), np.array(span_doc)
    grams, bag_starts = subwords(list(index))
    bag_starts = np.append(bag_starts, len(grams))
    bag_size, span_size = np.diff(bag_starts)[:, None].astype(np.float32), np.diff(span_starts)[:, None].astype(np.float32)
    by_word, by_gram = _csr_by_column(span_starts, tokens), _csr_by_column(bag_starts, grams)

    # a row counts the less, the fewer toxic documents know it (what one document happens to say isn't learned), and,
    # as in subsampling of frequent words, the more of the others do
    of_doc = np.repeat(span_doc, np.diff(span_starts))

    def documents_with(label: int) -> np.ndarray:
        seen = np.unique((of_doc * len(index) + tokens)[y_doc[of_doc] == label])
        sizes = np.diff(bag_starts)[seen % len(index)]
        places = np.repeat(bag_starts[seen % len(index)] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pairs = np.unique(np.repeat(seen // len(index), sizes) * BUCKETS + grams[places])
        return np.bincount(pairs % BUCKETS, minlength=BUCKETS)

    toxic, others = documents_with(1), documents_with(0)
    trust = toxic / (toxic + TRUST) / (1 + FREQUENT * others / max(1, (y_doc == 0).sum()))
    trust = trust.astype(np.float32)[:, None]

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moving, power = [np.zeros_like(p) for p in params], [0.0] * 3
    # Adam with one second moment for each array: rows move in proportion to their gradient, so a row that only
    # a few spans know stays small beside one that many toxic spans share
    rates = (30.0, 0.1, 0.05)
    y = y_doc[span_doc]
    active = np.ones(len(y), bool)
    n_toxic, t = y_doc.sum(), 0

    def forward() -> tuple[np.ndarray, np.ndarray]:
        word = np.add.reduceat((params[0] * trust)[grams], bag_starts[:-1]) / bag_size
        hidden = np.add.reduceat(word[tokens], span_starts[:-1]) / span_size
        z = hidden @ params[1] + params[2]
        return hidden, 1 / (1 + np.exp(-np.clip(z[:, 1] - z[:, 0], -60, 60)))

    for round_ in range(ROUNDS):
        for _ in range(STEPS):
            t += 1
            hidden, p = forward()
            # toxic documents weigh alike, whatever their number of spans; hard spans of the others weigh more
            in_doc = np.bincount(span_doc, weights=active, minlength=len(texts))
            positive = np.where((y == 1) & active, 0.5 / n_toxic / np.maximum(in_doc[span_doc], 1), 0)
            hard = np.where(y == 0, p, 0)
            weight = positive + np.where(y == 0, 0.25 / max(1, (y == 0).sum()), 0) + 0.25 * hard / max(hard.sum(), 1e-9)
            dz = (weight * (p - y)).astype(np.float32)[:, None] * np.array([[-1, 1]], np.float32)
            d_hidden = (dz @ params[1].T) / span_size
            d_word = np.zeros((len(index), DIMENSIONS), np.float32)
            d_word[by_word[1]] = np.add.reduceat(d_hidden[by_word[0]], by_word[2])
            d_word /= bag_size
            d_rows = np.zeros_like(params[0])
            d_rows[by_gram[1]] = np.add.reduceat(d_word[by_gram[0]], by_gram[2])
            d_rows *= trust
            for k, g in enumerate((d_rows, hidden.T @ dz, dz.sum(axis=0))):
                moving[k] += 0.1 * (g - moving[k])
                power[k] += 0.05 * (float((g * g).sum()) - power[k])
                size = np.sqrt(power[k] / (1 - 0.95**t)) + 1e-12
                params[k] -= rates[k] * (1 - 0.8 * t / (ROUNDS * STEPS)) * (moving[k] / (1 - 0.9**t)) / size
        if round_ < ROUNDS - 1:
            hidden = forward()[0]
            z = hidden @ (params[1][:, 1] - params[1][:, 0])
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, span_doc, z)
            active = (y == 0) | (z >= top[span_doc] - 0.25 * np.abs(top[span_doc]))
    way = params[1][:, 1] - params[1][:, 0]
    return ToxicityModel((params[0] * trust) @ way, params[2][1] - params[2][0])


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[int]]:
    """At most max_docs rows of each label, in order of a hash of their id, come to the driver with their whole texts.

    docs(doc_id, text), labels(doc_id, toxic): rows with a null id, label or text aren't used; of several labels of one
    id the greatest counts, of several texts the least.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # at most 2 * max_docs rows
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = sorted((r["doc_id"], r["toxic"], r["text"]) for r in rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    return [f[2] for f in found], [int(f[1]) for f in found]


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            for part, texts in text_slices(batch, batch.num_columns - 1):
                scores = score(texts)
                columns = [*part.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (all but the text) with score (0 to 1) and predicted (1 if score >= 0.5).

    Whole texts are scored, and nothing but the text is looked at. Null and empty texts have the score of the
    model's bias; very long texts are split into spans like others. Repeated rows get equal scores; an empty table gives an empty result. Kept columns named like the
    new ones are left out. The model goes to the tasks as a broadcast of BUCKETS numbers.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c.lower() not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias(unused_name(docs, "text_")))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scored(sent), f"{kept}score double, predicted int")
