"""Toxicity: a linear-chain conditional random field with two states (plain, toxic) tags the words of a text.

Labels are given per document, so words are labelled first: over a bounded sample, the words and word beginnings that
stand in several toxic texts (copies count once) and next to never in clean ones. Their occurrences are the labelled
tokens. The field is fitted to them by maximum likelihood: emission weights per hashed
word and per hashed word beginning, transition weights between states, gradients from forward-backward marginals.

Scoring reads whole texts. Forward and backward run over blocks of words at once: the 2x2 step matrices of each block
are multiplied first, a short scan joins the blocks, and a second pass fills in the places between. A document's score is a
logistic function, fitted on the same sample, of its largest marginal and of the sum and density of its marginals;
offending spans are runs of words with a marginal of 0.5 or more.

Defined cases: null, empty and word-free texts get the score of a text without evidence; repeated rows are scored each; a repeated label counts once,
with its larger value; without labelled rows every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cashlens.llm.common import LETTERS, LOWER, U64, code_points, labelled_sample, mix, span_hashes, text_slices, word_spans

BUCKETS = 1 << 18
#: Beginnings of words, in bytes, that are features beside the whole word. Bucket 0 stands for "no such beginning".
BEGINNINGS = (4, 5, 6, 7, 8)


@dataclass
class Field:
    """log weights: emission of the toxic state by hashed word, steps [from, to], and the start of a text."""

    emission: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    document: np.ndarray  # weights of a text's evidence and, last, of 1


def words_of(raw: np.ndarray, at: np.ndarray):
    """Row, first byte, end byte and feature buckets (one line per word) of the words."""
    low = LOWER[raw]
    rows, starts, ends = word_spans(low, at, LETTERS)
    columns = [span_hashes(low, starts, ends)]
    for size in BEGINNINGS:
        longer = ends - starts > size
        part = np.zeros(len(starts), U64)
        part[longer] = span_hashes(low, starts[longer], starts[longer] + size) ^ U64(size * 0x9E3779B97F4A7C15 % 2**64)
        columns.append(part)
    buckets = np.stack(columns, 1) % U64(BUCKETS - 1) + U64(1)
    buckets[np.stack(columns, 1) == 0] = 0
    return rows, starts, ends, buckets.astype(np.int32)


def matrices(field: Field, rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Step matrix into each word, (n, 2, 2). The first word of a row does not see what stood before."""
    emit = np.stack([np.zeros(len(buckets)), field.emission[buckets].sum(1)], 1)
    step = np.broadcast_to(field.steps, (len(buckets), 2, 2)).copy()
    step[np.r_[True, rows[1:] != rows[:-1]]] = field.start
    step += emit[:, None, :]
    step -= step.max((1, 2), keepdims=True)
    return np.exp(step)


def prefix_vectors(steps: np.ndarray, begin: np.ndarray, block: int = 64) -> np.ndarray:
    """v_t = v_(t-1) M_t for all t, each scaled to sum 1; (n, 2)."""
    n = len(steps)
    blocks = -(-n // block)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(2), (blocks * block - n, 2, 2))]).reshape(blocks, block, 2, 2)
    whole = padded[:, 0]
    for k in range(1, block):
        whole = whole @ padded[:, k]
        whole = whole / whole.sum((1, 2), keepdims=True)
    heads = np.empty((blocks, 2))
    a, b = begin
    for k, ((p, q), (r, s)) in enumerate(whole.tolist()):
        heads[k] = a, b
        a, b = a * p + b * r, a * q + b * s
        total = a + b
        a, b = a / total, b / total
    out = np.empty((blocks, block, 2))
    v = heads
    for k in range(block):
        v = (v[:, None, :] @ padded[:, k])[:, 0]
        v = v / v.sum(1, keepdims=True)
        out[:, k] = v
    return out.reshape(-1, 2)[:n]


def forward_backward(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors of all words."""
    ahead = prefix_vectors(steps, np.array([0.5, 0.5]))
    # b_t = M_(t+1) b_(t+1): the same scan over transposed matrices, from the end
    turned = np.concatenate([steps[1:], np.eye(2)[None]])[::-1].transpose(0, 2, 1)
    back = prefix_vectors(turned, np.array([0.5, 0.5]))[::-1]
    return ahead, back


def marginals(field: Field, rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Probability of the toxic state per word."""
    if not len(buckets):
        return np.zeros(0)
    ahead, back = forward_backward(matrices(field, rows, buckets))
    both = ahead * back
    return both[:, 1] / both.sum(1)


# ---------------------------------------------------------------- training


def label_words(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, purity: float = 0.75, least: int = 5) -> np.ndarray:
    """Features that stand in ``least`` or more groups of toxic texts, beyond chance, and in few clean ones (``purity``).

    Texts with the same smallest hash of three words in a row form a group, so that copies of one text count once.
    """
    head = np.full(len(toxic), np.iinfo(np.int64).max)
    word = buckets[:, 0].astype(U64)
    three = mix(word[:-2] * U64(BUCKETS) ** U64(2) + word[1:-1] * U64(BUCKETS) + word[2:]) >> U64(1)
    np.minimum.at(head, rows[2:], three.astype(np.int64))
    group = np.unique(np.stack([head, toxic], 1), axis=0, return_inverse=True)[1].ravel()
    bad = np.zeros(group.max() + 1, bool)
    bad[group[toxic]] = True
    # one group's features at a time: nothing as large as all words is held beside the words
    bad_count, count = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    first = np.searchsorted(rows, np.arange(len(toxic) + 1))
    members = np.argsort(group, kind="stable")
    for texts in np.split(members, np.flatnonzero(np.diff(group[members])) + 1):
        word = np.unique(np.concatenate([buckets[first[k] : first[k + 1]].ravel() for k in texts]))
        count[word] += 1
        if bad[group[texts[0]]]:
            bad_count[word] += 1
    # beyond chance: the likelihood ratio against the share of toxic groups, for as many words as could be tested
    base, share = min(max(bad.mean(), 1e-6), 1 - 1e-6), bad_count / np.maximum(count, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base)))
    sure = count * gain >= 3 + np.log(max(1, (count >= least).sum()))
    chosen = (bad_count >= least) & (bad_count >= purity * count) & sure
    chosen[0] = False
    return np.flatnonzero(chosen)


def training_chains(rows: np.ndarray, truth: np.ndarray, reach: int = 24, stretch: int = 32, one_in: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The words that the field is fitted on, and what each counts.

    Words near a labelled one count once. Of all others, wherever they stand in a text, one stretch in ``one_in`` is
    taken by a hash of its place and counts for that many, so that the whole texts stay what is fitted.
    """
    near = np.zeros(len(rows) + 1, np.int64)
    at = np.flatnonzero(truth)
    np.add.at(near, np.maximum(at - reach, 0), 1)
    np.add.at(near, np.minimum(at + reach + 1, len(rows)), -1)
    near = np.cumsum(near)[:-1] > 0
    with np.errstate(over="ignore"):
        chosen = mix((np.arange(len(rows)) // stretch).astype(np.uint64)) % np.uint64(one_in) == 0
    kept = np.flatnonzero(near | chosen)
    return kept, np.where(near[kept], 1.0, float(one_in))


def fit(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, rounds: int = 40, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Maximum likelihood of the labelled tokens; ``rows`` ascending document numbers of the words."""
    start = np.zeros((2, 2))
    # a word that no sample holds is rather plain
    field = Field(np.full(BUCKETS, -0.3), np.zeros((2, 2)), start, np.array([0.0, 0.0, 0.0, -6.0]))
    if not len(buckets) or not toxic.any():
        field.start[:, 1] = field.steps[:, 1] = -30.0  # nothing is toxic
        return field
    every_row, every_word = rows, buckets
    labelled = np.zeros(BUCKETS, bool)
    labelled[label_words(rows, buckets, toxic)] = True
    truth = np.zeros(len(buckets), np.int64)
    for k in range(buckets.shape[1]):
        truth |= labelled[buckets[:, k]]
    kept, weight = training_chains(rows, truth)
    chain = np.cumsum(np.r_[True, (np.diff(kept) > 1) | (np.diff(rows[kept]) > 0)])
    buckets, truth = buckets[kept], truth[kept]
    inner = chain[1:] == chain[:-1]
    seen_steps, seen_start = np.zeros((2, 2)), np.zeros(2)
    head = np.r_[True, ~inner]
    np.add.at(seen_steps, (truth[:-1][inner], truth[1:][inner]), weight[1:][inner])
    np.add.at(seen_start, truth[head], weight[head])
    flat, width = buckets.ravel(), buckets.shape[1]
    scale = np.maximum(np.bincount(flat, weights=np.repeat(weight, width), minlength=BUCKETS), 1) + 1.0
    within = max(1.0, weight[1:][inner].sum())
    for _ in range(rounds):
        steps = matrices(field, chain, buckets)
        ahead, back = forward_backward(steps)
        both = ahead * back
        p = both[:, 1] / both.sum(1)
        joint = ahead[:-1, :, None] * steps[1:] * back[1:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        # mean residual per feature, so that rare and common words learn alike
        residual = np.bincount(flat, weights=np.repeat(weight * (truth - p), width), minlength=BUCKETS) / scale
        field.emission += 4 * rate * residual - ridge * field.emission
        field.steps += 4 * rate * (seen_steps - (weight[1:, None, None] * joint)[inner].sum(0)) / within
        expected = np.array([(weight * (1 - p))[head].sum(), (weight * p)[head].sum()])
        field.start += 4 * rate * (seen_start - expected) / weight[head].sum()
        np.clip(field.emission, -12, 12, out=field.emission)
        field.emission[0] = 0
    # evidence of all texts, some texts at a time
    cuts = np.unique(np.searchsorted(every_row, every_row[:: 1 << 17]))
    parts = [evidence(every_row[a:b], marginals(field, every_row[a:b], every_word[a:b]), len(toxic)) for a, b in zip(cuts, [*cuts[1:], len(every_row)], strict=True)]
    field.document = fit_document(np.stack([join_evidence(parts, k) for k in range(3)] + [np.ones(len(toxic))], 1), toxic)
    return field


def evidence(rows: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """What a text's marginals add up to: the largest, the log of their sum, and their density; (n, 4) with a 1."""
    best = np.zeros(n)
    np.maximum.at(best, rows, p)
    strong = np.where(p >= 0.1, p, 0.0)  # thousands of plain words are no evidence together
    total = np.bincount(rows, weights=strong, minlength=n)
    size = np.bincount(rows, minlength=n)
    return np.stack([best, np.log1p(total), np.log1p(200 * total / (size + 20.0)), np.ones(n)], 1)


def join_evidence(parts: list[np.ndarray], column: int) -> np.ndarray:
    """Evidence of texts that stand in one part each; elsewhere it is 0."""
    return np.max([p[:, column] for p in parts], 0)


def fit_document(x: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = document_score(x, w)
        gradient = x.T @ (toxic - p) / len(x) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, gradient)
    return w


def document_score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 3000) -> Field:
    """Fit on up to ``max_rows`` labelled documents outside the held-out fold (a bounded sample, on the driver)."""
    sample = labelled_sample(documents, labels, "toxic", max_rows).select("text", "value").toArrow()
    toxic = sample["value"].to_numpy() > 0 if len(sample) else np.zeros(0, bool)
    rows, buckets = [np.zeros(0, np.int32)], [np.zeros((0, 1 + len(BEGINNINGS)), np.int32)]
    for first, _, raw, at in text_slices(sample["text"]):
        own, _, _, numbers = words_of(raw, at)
        rows.append((own + first).astype(np.int32))
        buckets.append(numbers)
    del sample
    every_row, every_word = np.concatenate(rows), np.concatenate(buckets)
    rows.clear(), buckets.clear()
    return fit(every_row, every_word, toxic)


# ---------------------------------------------------------------- scoring


def score(documents: DataFrame, field: Field, carry: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, score and toxic_spans (offending characters) of each row; with ``carry`` the text and those columns too."""
    documents = documents.select("doc_id", "text", *(carry or ()))
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kept = [f for f in documents.schema.fields if carry is not None or f.name == "doc_id"]
    schema = T.StructType(list(kept)).add("score", T.DoubleType()).add("toxic_spans", spans_type)
    names = [f.name for f in schema.fields]
    indices = [documents.columns.index(f.name) for f in kept]
    shared = documents.sparkSession.sparkContext.broadcast(field)
    pair_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in text_slices(batch.column(1), 1 << 19):
                rows, starts, ends, buckets = words_of(raw, at)
                p = marginals(shared.value, rows, buckets)
                scores = document_score(evidence(rows, p, end - first), shared.value.document)
                spans: list[list[dict]] = [[] for _ in range(end - first)]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    chars = code_points(raw, at)
                    last = -2
                    for k in hit.tolist():
                        row, base = int(rows[k]), chars[at[rows[k]]]
                        if k == last + 1 and rows[last] == row:
                            spans[row][-1]["end"] = int(chars[ends[k]] - base)
                        else:
                            spans[row].append({"start": int(chars[starts[k]] - base), "end": int(chars[ends[k]] - base)})
                        last = k
                columns = [batch.column(k).slice(first, end - first) for k in indices]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array(spans, pair_type)], names=names)

    return documents.mapInArrow(run, schema)
