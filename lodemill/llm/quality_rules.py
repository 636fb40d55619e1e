"""Quality rules: counts of junk, and lines labelled content or boilerplate by a linear-chain CRF.

Each line that has a word is described by a few numbers (length, symbols, capitals, digits, pipes, how it
ends, whether an earlier line equals it). A two-state conditional random field scores the lines and their
changes of state; Viterbi decoding gives the best labelling of the whole sequence, and a document is kept if
lines labelled content hold at least MIN_CONTENT of its words and no base rule rejects it.

The CRF is trained on a sample of at most TRAIN_DOCS labelled documents with at most TRAIN_LINES lines between them
(what documents do it is picked by a hash of the id, so reruns agree; 72 bytes a line come to the driver): first every line has its document's label, then lines of rejected documents
that look like content by themselves are content, and the changes of state are learned anew. Applying it
needs no shuffle; a text is read whole, by one task, in time proportional to its length.

Defined cases: a null or empty text has no words, all counts 0, and fails (too few words); ties of the two
states are content; repeated rows are judged alike; an empty table gives an empty table; without labels of
both kinds every line is content; a labelled document of more than TRAIN_LINES lines trains nothing (it is judged as any
other); columns other than doc_id and text are not read, and keep() passes them on, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill.llm.common import beside, bounded_sample, text_of, training_set, whole, word_hashes

LEAST_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
MIN_CONTENT = 0.5
#: Labelled documents that the CRF is trained on, at most, and their lines in all.
TRAIN_DOCS, TRAIN_LINES = 2_000, 400_000
STEPS, RATE, L2 = 120, 0.15, 1e-3
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Characters of texts whose lines are described at a time.
CHUNK = 1_000_000
N_FEATURES = 9
#: Lines of documents, padded to the longest of their batch, that the fit holds marginals of at a time.
CELLS = 500_000

_PLACES = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(chars.encode())] = 1
    return table


_SPACE = _flags(SPACES).astype(bool)
_SYMBOL = _flags("#*$%&|<>!~^=@{}[]\\")
_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _flags("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _PIPE, _ENDING = _flags("0123456789"), _flags("|"), _flags(".?!")


@dataclass(frozen=True)
class Crf:
    """weights: of a line's features for content; change: scores of (boilerplate, content) rows to the same columns."""

    weights: np.ndarray
    change: np.ndarray

    @classmethod
    def all_content(cls) -> Crf:
        return cls(np.zeros(N_FEATURES), np.zeros((2, 2)))


def described(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, words, text number) of all lines with a word of some texts, in order."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
    b = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    of = np.repeat(np.arange(len(texts)), counts)
    lines = data.split(b"\n")[:-1]
    seen: set[bytes] = set()
    again = np.zeros(len(lines), dtype=bool)
    at = 0
    for n in counts.tolist():
        seen.clear()
        for i in range(at, at + n):
            if lines[i] in seen:
                again[i] = True
            else:
                seen.add(lines[i])
        at += n
    space = _SPACE[b]
    begins = ~space & np.concatenate(([True], space[:-1]))
    total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    words = total(begins)
    held = np.flatnonzero(words > 0)
    w = np.maximum(words, 1)
    solid, letters = np.maximum(total(~space), 1), np.maximum(total(_LETTER[b]), 1)
    place = np.where(~space, np.arange(len(b)), -1)
    last = np.maximum(np.maximum.reduceat(place, starts), 0)
    f = np.stack(
        [np.ones(len(lines)), np.log1p(words) / 4, np.minimum(total(_SYMBOL[b]) / w, 1.5), total(_UPPER[b]) / letters, total(_DIGIT[b]) / solid,
         np.minimum(total(_PIPE[b]) / w, 1.0), _ENDING[b[last]].astype(float), again.astype(float), np.minimum(solid / w / 10, 2.0)], axis=1,
    )
    return f[held], words[held], of[held]


def decode(emission: list[float], change: np.ndarray) -> list[bool]:
    """The best labelling: for each line whether it is content. emission: content's score over boilerplate's."""
    (bb, bc), (cb, cc) = change.tolist()
    back: list[tuple[bool, bool]] = []
    b, c = 0.0, 0.0
    for t, e in enumerate(emission):
        if t:
            to_b, to_c = c + cb >= b + bb, c + cc >= b + bc
            back.append((to_b, to_c))
            b, c = (c + cb if to_b else b + bb), (c + cc if to_c else b + bc) + e
        else:
            c = e
    state = c >= b
    out = [state]
    for to_b, to_c in reversed(back):
        state = to_c if state else to_b
        out.append(state)
    return out[::-1] if emission else []


def _marginals(e: np.ndarray, change: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(content) of each line and the expected number of changes of each kind; e: documents by longest line count, padded."""
    n, most = e.shape
    score = np.stack([np.zeros_like(e), e], axis=2)
    fore, aft = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    fore[:, 0] = score[:, 0]
    for t in range(1, most):
        k = int((lengths > t).sum())  # longest first
        fore[:k, t] = np.logaddexp(fore[:k, t - 1, :1] + change[0], fore[:k, t - 1, 1:] + change[1]) + score[:k, t]
    pairs = np.zeros((2, 2))
    z = np.logaddexp(*fore[np.arange(n), lengths - 1].T)
    for t in range(most - 2, -1, -1):
        k = int((lengths > t + 1).sum())
        after = score[:k, t + 1] + aft[:k, t + 1]
        aft[:k, t] = np.logaddexp(change[:, 0] + after[:, :1], change[:, 1] + after[:, 1:])
        joint = fore[:k, t, :, None] + change + after[:, None, :] - z[:k, None, None]
        pairs += np.exp(joint).sum(axis=0)
    p = np.exp(fore[:, :, 1] + aft[:, :, 1] - z[:, None])
    return p, pairs


def _fitted(sequences: list[np.ndarray], labels: list[np.ndarray]) -> Crf:
    """Maximum likelihood with a small L2 penalty, by Adam over all sequences."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    d, n_lines = sequences[0].shape[1], sum(map(len, sequences))
    seen, batches, at = np.zeros((2, 2)), [], 0
    while at < len(order):
        own = order[at : at + max(1, CELLS // len(sequences[order[at]]))]
        at += len(own)
        lengths = np.array([len(sequences[i]) for i in own])
        inside = np.arange(lengths[0]) < lengths[:, None]
        y = np.zeros(inside.shape)
        y[inside] = held = np.concatenate([labels[i] for i in own])
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] += ((y[:, :-1] == a) & (y[:, 1:] == b) & inside[:, 1:]).sum()
        batches.append((np.concatenate([sequences[i] for i in own]), held, inside, lengths))
    theta, m, v = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    for step in range(1, STEPS + 1):
        change = theta[d:].reshape(2, 2)
        grad = np.concatenate([np.zeros(d), seen.ravel()])
        for flat, y, inside, lengths in batches:
            e = np.zeros(inside.shape)
            e[inside] = flat @ theta[:d]
            p, pairs = _marginals(e, change, lengths)
            grad += np.concatenate([flat.T @ (y - p[inside]), -pairs.ravel()])
        grad = grad / n_lines - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[:d], theta[d:].reshape(2, 2))


def train(sequences: list[np.ndarray], kept: list[bool]) -> Crf:
    """A CRF from documents' line features and labels."""
    if not any(kept) or all(kept):
        return Crf.all_content()
    first = _fitted(sequences, [np.full(len(s), float(k)) for s, k in zip(sequences, kept, strict=True)])
    return _fitted(sequences, [np.ones(len(s)) if k else (s @ first.weights > 0).astype(float) for s, k in zip(sequences, kept, strict=True)])


def _described(text: str) -> tuple[int, bytes]:
    features, _, _ = described([text])
    return len(features), features.tobytes()


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Crf:
    """A CRF from labels(doc_id, quality); only line features of the sampled documents come to the driver."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") > 0).cast("int").alias("label"))
    found = training_set(docs, bounded_sample(known, ["doc_id"], train_docs), _described, train_lines)
    return train([np.frombuffer(f).reshape(-1, N_FEATURES) for _, f in found], [bool(k) for k, _ in found])


KINDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("content_words", pa.int64())]


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of WINDOW words that the text has twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    total = hashes[:n] * _PLACES[0]
    for i in range(1, WINDOW):
        total += hashes[i : i + n] * _PLACES[i]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def judged(texts: list[str], crf: Crf) -> list[tuple[int, ...]]:
    """KINDS of each text."""
    features, words, of = described(texts)
    emission = features @ crf.weights
    borders = np.searchsorted(of, np.arange(len(texts) + 1))
    dup = np.bincount(of[features[:, 7] > 0], minlength=len(texts)) if len(of) else np.zeros(len(texts), dtype=np.int64)
    out = []
    for i, t in enumerate(texts):
        own = slice(borders[i], borders[i + 1])
        content = int(words[own][np.array(decode(emission[own].tolist(), crf.change), dtype=bool)].sum()) if borders[i] < borders[i + 1] else 0
        w = t.encode("utf-8", "surrogatepass").split()
        out.append((len(w), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), int(dup[i]), repeated_words(word_hashes(w)), content))
    return out


def judge(text: str | Column, crf: Crf) -> Column:
    """A struct of KINDS for a text column: the base counts, and the words in lines labelled content."""

    def counts(column: pa.Array) -> pa.Array:
        rows: list[tuple[int, ...]] = []
        held: list[str] = []
        size = 0
        for x in column:
            held.append(x.as_py())
            size += len(held[-1])
            if size >= CHUNK:
                rows += judged(held, crf)
                held, size = [], 0
        if held:
            rows += judged(held, crf)
        columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, (_, k) in zip(columns, KINDS, strict=True)], names=[n for n, _ in KINDS])

    return F.arrow_udf(counts, "struct<" + ",".join(f"{n}:bigint" for n, _ in KINDS) + ">")(text_of(text))


def base_failed(j: str) -> Column:
    return (F.col(f"{j}.n_words") < LEAST_WORDS) | (100 * F.col(f"{j}.n_repeat_words") > REPEATED_PERCENT * F.col(f"{j}.n_words"))


def kept(j: str) -> Column:
    return ~base_failed(j) & (F.col(f"{j}.content_words") >= MIN_CONTENT * F.col(f"{j}.n_words"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected rows; columns as in docs."""
    return whole(beside(docs, judged=judge("text", fit(docs, labels))).where(kept("judged")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crf = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = docs.select("doc_id", judge("text", crf).alias("j"))
    base = [F.col(f"j.{n}").alias(n) for n, _ in KINDS[:-1]]
    return found.select("doc_id", *base, base_failed("j").alias("base_failed"), kept("j").alias("kept"), F.col("j.content_words").alias("content_words"))
