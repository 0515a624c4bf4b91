"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features say which hashed character n-grams its lower-cased words hold (each word with the spaces around it). Fitting
takes the ratio r of an n-gram's smoothed share among toxic and other texts, and then a logistic regression on r
times presence, with an L1 penalty: an n-gram that tells nothing has a small r, so its weight is dear and stays 0.
What remains is a short table of n-grams, and the score of a text of any length is a sum over those that it holds.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, seeded

BITS = 20
ORDERS = (3, 4, 5, 6)
SPACES = np.zeros(256, bool)
SPACES[list(b" \t\n\v\f\r")] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[SPACES] = 32
AT_ONCE = 1 << 20


def ngrams(text: str | None, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of bytes of the whole text, in blocks; n-grams reach across one space but not two words' ends."""
    raw = FOLD[np.frombuffer(f" {text or ''} ".encode("utf-8", "surrogatepass"), np.uint8)]
    for at in range(0, len(raw), AT_ONCE):
        block = raw[at : at + AT_ONCE + max(orders) - 1].astype(np.uint32)
        inner = np.concatenate(([0], np.cumsum(block == 32)))
        rolled = np.zeros(len(block), np.uint32)
        for n in range(1, max(orders) + 1):
            size = len(block) - n + 1
            if size < 1:
                break
            rolled = rolled[:size] * np.uint32(0x01000193) ^ block[n - 1 :]
            if n in orders:
                spaces_inside = inner[n - 1 : n - 1 + size] - inner[1 : 1 + size] if n > 1 else np.zeros(size, int)
                mixed = (rolled ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                yield (mixed ^ mixed >> np.uint32(15))[spaces_inside == 0] >> np.uint32(32 - bits)


@dataclass(frozen=True)
class Model:
    """`slot` says which weight, from 1, each hash has, or 0 for none."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS

    def score(self, text: str | None) -> float:
        held = np.zeros(len(self.weights), bool)
        for h in ngrams(text, self.orders, self.bits):
            held[self.slot[h]] = True
        held[0] = False
        z = self.bias + float(self.weights[held].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list[str | None], labels: list[int], smoothing: float = 1.0, l1: float = 2.0, least_texts: int = 3, rounds: int = 300, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Model:
    """Fit on labelled texts in memory. With one label only, or none, every score is that label's share or one half."""
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(1 << bits, np.int32), np.zeros(1), float(np.log(share / (1 - share))), bits, orders)
    rows = [np.unique(np.concatenate([np.zeros(0, np.uint32), *ngrams(t, orders, bits)])) for t in texts]
    texts_with = np.zeros((2, 1 << bits))
    for r, label in zip(rows, labels, strict=True):
        texts_with[int(label), r] += 1
    p, q = (texts_with[k] + smoothing for k in (1, 0))
    ratio = np.log(p / (y.sum() + 2 * smoothing)) - np.log(q / (len(y) - y.sum() + 2 * smoothing))
    # a gap of two standard deviations in the log ratio, else the n-gram can't be told from chance
    used = np.flatnonzero((texts_with.sum(0) >= least_texts) & (np.abs(ratio) > 2 * np.sqrt(1 / p + 1 / q)))
    number = np.full(1 << bits, -1, np.int64)
    number[used] = np.arange(len(used))
    own = [n[n >= 0] for n in (number[r] for r in rows)]
    row = np.repeat(np.arange(len(own)), [len(n) for n in own])
    col = np.concatenate([np.zeros(0, np.int64), *own])
    value = ratio[used][col]
    w, bias = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
    # accelerated proximal gradient on the summed loss; the step follows from a power iteration on the features
    v = np.ones(len(used)) / max(1, len(used)) ** 0.5
    top = 1.0
    for _ in range(20 if len(used) else 0):
        v = np.bincount(col, value * np.bincount(row, value * v[col], len(own))[row], len(used))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * (1.1 * top + len(own)))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        z = np.bincount(row, value * ahead[col], len(own)) + ahead_bias
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        raw = ahead - step * np.bincount(col, value * miss[row], len(used))
        new = np.sign(raw) * np.maximum(np.abs(raw) - step * l1, 0)
        new_bias = ahead_bias - step * miss.sum()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    kept = np.flatnonzero(w)
    slot = np.zeros(1 << bits, np.int32)
    slot[used[kept]] = np.arange(1, len(kept) + 1)
    return Model(slot, np.concatenate(([0.0], (w * ratio[used])[kept])), float(bias), bits, orders)


def held_out(doc_id: str, folds: int = 5):
    """Whether the row's labels may not be learnt from: crc32 of doc_id as text leaves no remainder; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit_table(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 3000, most_chars: int = 15_000_000, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the labelled rows outside the held-out fold.

    The sample is bounded: the `most_rows` labelled ids of least seeded rank, and of those whole texts in that order
    that hold at most `most_chars` characters in all; one that no longer fits is passed over and the next are tried. A
    sample of one label only gives a warning. Labels other than 0 and 1 are left out; of an id labelled
    or texted more than once the largest label and the first text count.
    """
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_label IN (0, 1)")
    named = named.where(~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label"))
    chosen = named.orderBy(seeded(seed, "_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(chosen, "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    texts = durable(texts)
    fits, held = [], 0
    for r in texts.select("_id", F.coalesce(F.length("_text"), F.lit(0)).alias("n")).orderBy(seeded(seed, "_id"), "_id").collect():  # at most most_rows lengths
        if held + r["n"] <= most_chars:
            held += r["n"]
            fits.append(r["_id"])
    rows = texts.where(F.col("_id").isin(fits)).orderBy(seeded(seed, "_id"), "_id").collect()  # at most most_chars characters
    x, y = [r["_text"] for r in rows], [r["_label"] for r in rows]
    if y and min(y) == max(y):
        warnings.warn(f"all {len(y)} labelled texts of the sample have the label {y[0]}: every text gets one score", stacklevel=2)
    return fit(x, y)


def scored(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """`docs` with the score of each whole text, from 0 to 1. Null texts score as empty ones; repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 bytes for each of the 2**bits hashes

    @F.pandas_udf("double")
    def score(texts):
        m = shared.value
        return texts.map(m.score, na_action=None).astype("float64")

    return docs.withColumn(to, score(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", cut: float = 0.5, **sample: int) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row; predicted is 1 from a score of `cut` on.

    Null texts count as empty, null ids as held out, ties and repeated rows score alike, other columns are left aside,
    and empty tables give an empty result (without labels every score is one half).
    """
    model = fit_table(docs, labels, label, doc_id=doc_id, text=text, **sample)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return scored(own, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
