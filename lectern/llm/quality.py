"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad.  Emissions are linear in the line's own features (cut into
bins) and in those of the lines before and after it; transitions tie neighbours.
A document's score is the mean probability of "good" over its lines, weighted by
their lengths, from the forward-backward marginals, on a logistic scale fitted to the labels.

Labels are those of documents; what its lines are is latent.  A document is labelled good with probability
CLEAN * SPARED ** (its number of bad lines).  Fitting starts with each line by itself, as good as its document, then
goes on by expectation and gradient steps: the expected line labels, and pairs of them, given features and
label are what the field is drawn to.  They are exact: given the label "good" every bad line weighs SPARED;
given "bad", they are what is left of all labellings without those.  So a bad document may have good lines, and
switches between good and bad are learned.

The model is fitted on a bounded sample of labelled documents (SAMPLE_DOCS documents, DOC_LINES lines of
one, SAMPLE_LINES lines in all); scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, distinct_in_groups, mix, slices, text_buffers

#: Labelled documents that the model is fitted on, lines of one document, and lines in all, at most.
SAMPLE_DOCS, DOC_LINES, SAMPLE_LINES = 8000, 256, 250_000
THRESHOLD = 0.7
#: Of labels, those with crc32(id as text) mod 4 in this remainder are held out.
FOLDS, HELD_OUT = 4, 2
BINS = 10
BATCH_BYTES = 1 << 20
#: Lines of a run, where a long document gives some runs of lines.
RUN_LINES = 64
#: Probability that a document without bad lines is labelled good, and that a bad line leaves its label good.
CLEAN, SPARED = 0.95, 0.6
_U = np.uint64

_FLAGS = np.zeros((9, 256), bool)
_FLAGS[0, 65:91] = True  # capitals
_FLAGS[1, 97:123] = True  # small letters
_FLAGS[2, 48:58] = True  # digits
_FLAGS[3, [33, 63]] = True  # exclamation and question marks
_FLAGS[4, [ord(c) for c in "|<>{}[]=\\^~_`"]] = True
_FLAGS[5, [ord(c) for c in "#$%&*@+/"]] = True
_FLAGS[6, [ord(c) for c in ".,;:'\"()-"]] = True
_FLAGS[7, 128:192] = True  # bytes that continue a code point
_FLAGS[8, 192:] = True
NAMES = ("length", "capitals", "small", "digits", "shouts", "bars", "signs", "stops", "foreign", "word_length", "spread", "short", "marked", "doubled", "distinct", "repeated", "common")


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, len(NAMES)), length of each line in code points, and first line of each text.

    Every text has a line at least, the empty one has one empty line.
    """
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # A break that ends a text opens an empty line before the next text begins; keep both in order.
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    first = np.searchsorted(breaks, offsets[:-1], "left") + np.arange(len(offsets) - 1)
    first = np.r_[first, len(starts)]
    n = len(starts)
    sums = np.empty((len(_FLAGS), n))
    for k, flags in enumerate(_FLAGS):
        total = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        sums[k] = total[ends] - total[starts]
    size = (ends - starts).astype(float)
    points = size - sums[7]
    some = np.maximum(points, 1)
    letters = np.maximum(sums[0] + sums[1] + sums[8], 1)

    words = Words(data, np.r_[starts, len(data)])
    line = words.doc
    count = np.bincount(line, minlength=n).astype(float)
    per = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(line, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(line, length**2, n) / per - mean**2, 0))
    short = np.bincount(line, length <= 3, n) / per
    tail = data[words.end - 1] if len(line) else np.zeros(0, np.uint8)
    marked = np.bincount(line, (_FLAGS[3] | _FLAGS[4] | _FLAGS[5])[tail], n) / per
    twin = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])) + 1
    doubled = np.bincount(line[twin], minlength=n) / per
    group, hashes = distinct_in_groups(line, words.hash)
    distinct = np.bincount(group, minlength=n) / per
    place = np.arange(len(line)) - words.first[line]
    whole = np.zeros(n, _U)
    if len(line):
        heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        whole[line[heads]] = np.add.reduceat(mix(words.hash + place.astype(_U) * _U(0x9E3779B97F4A7C15)), heads)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = mix(whole + doc.astype(_U) * _U(0xBF58476D1CE4E5B9))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = np.where(count > 0, np.minimum(times[inverse] - 1, 3), 0)
    # Words of the text that several of its lines share with this line, by occurrence.
    pair = mix(hashes + doc[group].astype(_U) * _U(0x94D049BB133111EB))
    _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
    common = np.bincount(group, times[inverse] > 1, n) / np.maximum(np.bincount(group, minlength=n), 1)

    table = np.stack([np.log1p(points), sums[0] / letters, sums[1] / some, sums[2] / some, sums[3] / some, sums[4] / some, sums[5] / some, sums[6] / some, sums[8] / some, mean, spread, short, marked, doubled, distinct, repeated, common], axis=1)
    return table, points, first


@dataclass
class CrfModel:
    """Cuts of the bins, emission weights of (good - bad), and log potentials of transitions."""

    cuts: np.ndarray  # (features, BINS - 1)
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray  # (2, 2), from and to, bad first
    start: np.ndarray
    scale_: tuple[float, float] = (1.0, 0.0)  # slope and offset of the documents' log odds

    def design(self, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Binned own features, standardised features of both neighbours, and whether they exist."""
        n, f = table.shape
        own = np.zeros((n, f, BINS), np.float32)
        rows = np.arange(n)
        for k in range(f):
            own[rows, k, np.searchsorted(self.cuts[k], table[:, k], "left")] = 1
        plain = np.clip((table - self.mean) / self.scale, -3, 3).astype(np.float32)
        before, after = np.zeros_like(plain), np.zeros_like(plain)
        before[1:], after[:-1] = plain[:-1], plain[1:]
        heads, tails = first[:-1], first[1:] - 1
        before[heads], after[tails] = 0, 0
        edge = np.zeros((n, 3), np.float32)
        edge[heads, 0], edge[tails, 1], edge[:, 2] = 1, 1, 1
        return np.concatenate([own.reshape(n, -1), before, after, edge], axis=1)

    def emission(self, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each line alone: the design's product with the weights, without the design."""
        n, f = table.shape
        own = self.weights[: f * BINS].reshape(f, BINS)
        before, after, edge = self.weights[f * BINS : f * (BINS + 1)], self.weights[f * (BINS + 1) : f * (BINS + 2)], self.weights[f * (BINS + 2) :]
        out = np.full(n, edge[2])
        for k in range(f):
            out += own[k, np.searchsorted(self.cuts[k], table[:, k], "left")]
        plain = np.clip((table - self.mean) / self.scale, -3, 3)
        heads, tails = first[:-1], first[1:] - 1
        left, right = np.r_[0, (plain @ before)[:-1]], np.r_[(plain @ after)[1:], 0]
        left[heads], right[tails] = edge[0], edge[1]
        # A text of one line is head and tail.
        out += left + right
        return out

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of "good" for each line; emission is the log odds of a line alone."""
        return _forward_backward(emission, first, self.transition, self.start)[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        table, points, first = line_features(data, offsets)
        slope, offset = self.scale_
        return 1 / (1 + np.exp(-np.clip(slope * self.log_odds(table, points, first) + offset, -40, 40)))

    def log_odds(self, table: np.ndarray, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each document, the log odds of its lines' mean marginal."""
        good = self.marginals(self.emission(table, first), first)
        weight = points + 1e-6
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        mean = np.bincount(doc, good * weight, len(first) - 1) / np.bincount(doc, weight, len(first) - 1)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))


def _forward_backward(emission, first, transition, start):
    """Marginals, pair marginals (2 x 2 for each line but a chain's first, whose are zero) and log normaliser of each chain; chains step together, longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    head = first[:-1][order]
    alive = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(1, sizes.max() + 1), "left")
    move = np.exp(transition)
    clipped = np.clip(emission, -30, 30)
    local = np.stack([np.ones(len(emission)), np.exp(clipped)], axis=1)
    alpha, beta = np.empty_like(local), np.empty_like(local)
    norm = np.empty(len(local))
    for t, k in enumerate(alive):
        at = head[:k] + t
        x = local[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ move)
        norm[at] = x.sum(axis=1)
        alpha[at] = x / norm[at][:, None]
    beta[first[1:] - 1] = 1
    for t in range(len(alive) - 2, -1, -1):
        at = head[: alive[t + 1]] + t
        beta[at] = (local[at + 1] * beta[at + 1]) @ move.T / norm[at + 1][:, None]
    gamma = alpha * beta
    pairs = np.zeros((len(emission), 2, 2))
    pairs[1:] = move * alpha[:-1, :, None] * (local * beta / norm[:, None])[1:, None, :]
    pairs[first[:-1]] = 0
    return gamma[:, 1] / gamma.sum(axis=1), pairs, np.add.reduceat(np.log(norm), first[:-1])


def expected_lines(emission, first, labels, transition, start):
    """Expected line labels and summed pairs, free and given the documents' labels, from two passes.

    Weights of SPARED for each bad line make the first pass's normaliser the chance of a good label, up
    to CLEAN; what isn't a good label is a bad one.
    """
    sizes = np.diff(first)
    free, free_pairs, free_norm = _forward_backward(emission, first, transition, start)
    spared, spared_pairs, spared_norm = _forward_backward(emission - np.log(SPARED), first, transition, start)
    good = np.minimum(CLEAN * np.exp(np.minimum(spared_norm + sizes * np.log(SPARED) - free_norm, 0)), CLEAN)
    of_free = np.repeat(np.where(labels == 1, 0.0, 1 / (1 - good)), sizes)
    of_spared = np.repeat(np.where(labels == 1, 1.0, -good / (1 - good)), sizes)
    told = of_free * free + of_spared * spared
    pairs = np.tensordot(of_free, free_pairs, 1) + np.tensordot(of_spared, spared_pairs, 1)
    return free, free_pairs.sum(axis=0), told, pairs


def fit(table: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 2e-4) -> CrfModel:
    """Maximum likelihood by Adam; labels are those of documents, of lines latent after the first third of the rounds."""
    quantiles = np.quantile(table, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(table) else np.zeros((len(NAMES), BINS - 1))
    scale = table.std(axis=0)
    model = CrfModel(quantiles, table.mean(axis=0), np.where(scale > 1e-9, scale, 1), np.zeros(0), np.zeros((2, 2)), np.zeros(2))
    design = model.design(table, first)
    w = design.shape[1]
    as_document = np.repeat(labels, np.diff(first)).astype(float)
    # What ties a line to others stays out at first.
    linked = np.r_[len(NAMES) * BINS : w - 3, w : w + 6]
    values = np.zeros(w + 6)
    m, v = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, rounds + 1):
        emission = (design @ values[:w].astype(np.float32)).astype(float)
        if step <= rounds // 3:
            grad = np.r_[design.T @ (as_document - 1 / (1 + np.exp(-np.clip(emission, -30, 30)))).astype(np.float32), np.zeros(6)]
        else:
            good, pairs, told, told_pairs = expected_lines(emission, first, labels, values[w : w + 4].reshape(2, 2), values[w + 4 :])
            begun = (told - good)[first[:-1]].sum()
            grad = np.concatenate([design.T @ (told - good).astype(np.float32), (told_pairs - pairs).ravel(), [-begun, begun]])
        grad = grad / len(as_document) - decay * values
        if step <= rounds // 3:
            grad[linked] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        values = values + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.transition, model.start = values[:w], values[w : w + 4].reshape(2, 2), values[w + 4 :]
    if len(np.unique(labels)) > 1:
        model.scale_ = calibrate(model.log_odds(table, np.expm1(table[:, 0]), first), labels)
    return model


def calibrate(odds: np.ndarray, labels: np.ndarray, rounds: int = 60, decay: float = 1e-4) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one number, by Newton steps."""
    x = np.stack([odds, np.ones_like(odds)], axis=1)
    share = 1 / len(labels)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        slope = share * x.T @ (labels - p) - decay * (b - [1.0, 0.0])
        bend = share * (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(2)
        b = b + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return float(max(b[0], 0.1)), float(b[1])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_docs: int = SAMPLE_DOCS) -> CrfModel:
    """Fits on at most ``sample_docs`` labelled documents outside the held-out fold.

    The sample is the first ones in the order of a hash of the id, as far as their lines are SAMPLE_LINES together.  Of a
    longer document DOC_LINES lines count, in runs of RUN_LINES spread evenly over it; their
    features are those of the whole text.  Labels that are
    null, or whose id is, are left out; of several labels of one id the least counts, and of several texts the least.
    """
    ident = F.col(id_column)
    usable = labels.where(ident.isNotNull() & F.col(label_column).isin(0, 1)).where(F.pmod(F.crc32(ident.cast("string")), F.lit(FOLDS)) != HELD_OUT)
    usable = usable.groupBy(ident.alias("id")).agg(F.min(label_column).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    rows = docs.select(ident.alias("id"), F.col(text_column).cast("string").alias("body")).join(F.broadcast(chosen), "id")  # at most sample_docs rows of two numbers
    # Rows that repeat an id meet before anything is gathered.
    rows = rows.groupBy("id", "label").agg(F.min("body").alias("body")).select("id", "body", "label")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                table, _, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                packed = [_spread_lines(table[a:b]).astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(packed, pa.binary())], names=["id", "label", "lines"])

    found = rows.mapInArrow(run, "id long, label int, lines binary").withColumn("turn", F.xxhash64("id")).collect()  # at most sample_docs * DOC_LINES lines
    found = sorted(found, key=lambda r: (r.turn, r.id, r.label, bytes(r.lines)))
    total = np.cumsum([len(r.lines) // (4 * len(NAMES)) for r in found])
    found = found[: max(1, int(np.searchsorted(total, SAMPLE_LINES, "right")))]
    tables = [np.frombuffer(r.lines, np.float32).reshape(-1, len(NAMES)) for r in found]
    if not tables:  # nothing to learn from: every text gets the same score
        return fit(np.zeros((1, len(NAMES))), np.array([0, 1]), np.array([1]), rounds=0)
    found_labels = np.array([r.label for r in found])
    first = np.cumsum([0, *map(len, tables)])
    return fit(np.concatenate(tables).astype(float), first, found_labels)


def _spread_lines(table: np.ndarray) -> np.ndarray:
    """A document's lines, or of many DOC_LINES in runs."""
    if len(table) <= DOC_LINES:
        return table
    runs = DOC_LINES // RUN_LINES
    starts = np.linspace(0, len(table) - RUN_LINES, runs).astype(int)
    return table[(starts[:, None] + np.arange(RUN_LINES)).ravel()]


def label_lines(docs: DataFrame, model: CrfModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, line, good): every line of every text, from 0, with the probability that it is good.

    Null and empty texts are one empty line.  Repeated rows give their lines again; null ids and extra columns
    change nothing; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("body"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                table, _, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts = np.diff(first)
                line = np.arange(len(table)) - np.repeat(first[:-1], counts)
                ids = batch.column(0).take(pa.array(i + np.repeat(np.arange(j - i), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(line), pa.array(model.marginals(model.emission(table, first), first))], names=["id", "line", "good"])

    return rows.mapInArrow(run, "id long, line long, good double")


def score_quality(docs: DataFrame, model: CrfModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, payload: list[str] | None = None) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (score >= threshold) and ``payload`` columns.

    Null and empty texts are one empty line and score as such; a very long text is scored whole, with some
    hundred bytes of memory a line.  Only the text counts;
    null ids, repeated rows and extra columns change nothing; an empty table gives an
    empty result.
    """
    payload = payload or []
    kinds = dict(docs.dtypes) | {text_column: "string"}
    others = [c for c in payload if c != text_column]
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_body"), *[F.col(c) for c in others])
    schema = ", ".join(["id long", "score double", "predicted int", *(f"`{c}` {kinds[c]}" for c in payload)])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            found = [model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, BATCH_BYTES)]
            score = np.concatenate(found) if found else np.zeros(0)
            carried = [batch.column(1 if c == text_column else 2 + others.index(c)) for c in payload]
            columns = [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *carried]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "predicted", *payload])

    return rows.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
