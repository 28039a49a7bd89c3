"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import give_back, small_batches
from .shingles import U, mix, word_hashes

#: The bounded sample of labelled rows, by hash of the id.
SAMPLE = 6000
WORD_BUCKETS = 1 << 14
FACTORS = 8
EPOCHS, STEP, DECAY, BATCH = 6, 0.1, 1e-5, 32
THRESHOLD = 0.3
BINS = 12
STATS = ("upper", "digit", "punct", "symbol", "pipe", "space", "other", "word_len", "distinct", "again", "ends_odd", "line_again", "line_len", "size")
_PUNCT = np.array([chr(i) in ".,;:!?'\"()-" for i in range(256)])
_SYMBOL = np.array([chr(i) in "#$%&*+/<=>@[\\]^_`{|}~" for i in range(256)])
_ODD_END = np.array([chr(i) in "#$%&*!|" for i in range(256)])
N_META = 24


def n_features(metadata: int) -> int:
    return WORD_BUCKETS + len(STATS) * BINS + metadata * N_META


def _stats(text: str, words: np.ndarray) -> list[float]:
    """Each 0 to 1; an empty text has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return [0.0] * len(STATS)
    c = np.bincount(raw, minlength=256)
    n, letters, w = len(raw), max(1, int(c[65:91].sum() + c[97:123].sum())), max(1, len(words))
    space = np.concatenate([(raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
    ends = raw[np.flatnonzero(~space[:-1] & space[1:])]
    lines = [x for x in text.split("\n") if x]
    return [
        c[65:91].sum() / letters, c[48:58].sum() / n, min(1, 4 * c[_PUNCT].sum() / n), min(1, 2 * c[_SYMBOL].sum() / n), min(1, 8 * c[124] / n), c[32] / n, c[128:].sum() / n,
        min(1, n / w / 24), len(np.unique(words)) / w, float((words[1:] == words[:-1]).sum()) / w, float(_ODD_END[ends].sum()) / w, 1 - len(set(lines)) / max(1, len(lines)), min(1, np.log2(1 + n / max(1, len(lines))) / 16), min(1, np.log2(1 + n) / 24),
    ]


def features(texts: list[str], metadata: list[list[float | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text (indices, values): words by hash with damped counts of norm 1, a bin of each statistic, a bin of each metadatum."""
    with np.errstate(over="ignore"):
        words, counts = word_hashes(texts)
    out, at = [], 0
    for text, n, meta in zip(texts, counts.tolist(), metadata, strict=True):
        own = words[at : at + n]
        at += n
        bucket, times = np.unique((own % U(WORD_BUCKETS)).astype(np.int64), return_counts=True)
        x = np.log1p(times)
        x = x / max(1e-9, float(np.sqrt((x * x).sum())))
        s = np.array(_stats(text, own))
        binned = WORD_BUCKETS + np.arange(len(STATS)) * BINS + np.minimum(BINS - 1, (s * BINS).astype(np.int64))
        base = WORD_BUCKETS + len(STATS) * BINS
        extra = [base + i * N_META + (0 if m is None or m != m else 1 + min(N_META - 2, int(np.log2(1 + abs(m))))) for i, m in enumerate(meta)]
        dense = np.concatenate([binned, np.array(extra, np.int64)])
        out.append((np.concatenate([bucket, dense]), np.concatenate([x, np.full(len(dense), 0.3)])))
    return out


class Machine:
    """w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the last in linear time: for each factor half of
    (sum v x)**2 - sum (v x)**2."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    def margin(self, idx: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[idx] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[idx] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(idx, x), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad on small batches; without labels every score is a half."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    if len(rows):
        rate = np.clip(labels.mean(), 0.01, 0.99)
        w0 = float(np.log(rate / (1 - rate)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            y = labels[order[at : at + BATCH]]
            idx = np.concatenate([p[0] for p in part])
            x = np.concatenate([p[1] for p in part])
            cut = np.cumsum([0, *(len(p[0]) for p in part)])[:-1]
            own = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            vx = v[idx] * x[:, None]
            s = np.add.reduceat(vx, cut)
            m = w0 + np.add.reduceat(w[idx] * x, cut) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), cut))
            err = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y
            g0 += err.sum() ** 2
            w0 -= STEP * err.sum() / np.sqrt(g0)
            e = (err[own] * x)[:, None]
            which, back = np.unique(idx, return_inverse=True)
            dv, dw = np.zeros((len(which), FACTORS)), np.bincount(back, (e[:, 0]), len(which))
            np.add.at(dv, back, e * (s[own] - vx))
            dv, dw = dv + DECAY * v[which], dw + DECAY * w[which]
            gv[which] += dv * dv
            gw[which] += dw * dw
            v[which] -= STEP * dv / np.sqrt(gv[which])
            w[which] -= STEP * dw / np.sqrt(gw[which])
    return Machine(w0, w, v)


def _batches(pdf: pd.DataFrame, metadata: int) -> Iterator[tuple[slice, list[tuple[np.ndarray, np.ndarray]]]]:
    texts = pdf["text"].tolist()
    meta = pdf[[f"m{i}" for i in range(metadata)]].to_numpy(float).tolist() if metadata else [[]] * len(texts)
    at = 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars < 1_000_000):
            chars += len(texts[stop])
            stop += 1
        yield slice(at, stop), features(texts[at:stop], meta[at:stop])
        at = stop


def _extract(metadata: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, rows in _batches(b, metadata):
                yield pd.DataFrame({"label": b["label"].iloc[s].to_numpy(), "rank": b["rank"].iloc[s].to_numpy(), "idx": [r[0].astype(np.int32).tobytes() for r in rows], "x": [r[1].astype(np.float32).tobytes() for r in rows]})

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE) -> Machine:
    """Learns from at most sample labelled rows, the first by a hash of their id; of repeated labels the largest counts, and of
    documents with one id the text with the smallest hash.

    The ids are chosen from labels alone, so that only their texts meet the broadcast sample. Null labels and ids teach
    nothing; no labels give a machine that scores a half. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = chosen.withColumn("rank", F.xxhash64("id")).orderBy("rank", "id").limit(sample)
    known = _rows(docs, id_col, text_col, metadata).join(F.broadcast(chosen), "id")
    rest = [c for c in known.columns if c not in ("id", "label", "rank")]
    one = known.groupBy("id", "label", "rank").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *rest)).alias("x")).select("id", "label", "rank", "x.*").drop("h")
    got = one.mapInPandas(_extract(len(metadata)), "label double, rank long, idx binary, x binary").toPandas().sort_values(["rank", "idx"])
    parts = [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float)) for i, x in zip(got["idx"], got["x"], strict=True)]
    return fit(parts, got["label"].to_numpy(float), n_features(len(metadata)))


def _score(shared, metadata: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Machine(*shared.value)
        for b in batches:
            for s, rows in _batches(b, metadata):
                score = [m.score(*r) for r in rows]
                yield pd.DataFrame({"id": b["id"].iloc[s].to_numpy(), "score": score, "predicted": [int(x >= threshold) for x in score]})

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 from the threshold on). Whole texts; no shuffle.

    Null texts are empty ones and are scored; null metadata have a bin of their own; null and repeated ids pass through;
    an empty table gives an empty result. The model has a fixed size (features * (factors + 1) numbers) and is broadcast.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))
    got = _rows(docs, id_col, text_col, metadata).mapInPandas(_score(shared, len(metadata), threshold), "id string, score double, predicted int")
    return got.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score at or above the threshold. Only the text and the metadata go to Python, so no
    other value changes. Null texts are empty ones and are scored, null metadata have a bin of their own, repeated rows
    stay or go together, and an empty table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    @F.pandas_udf("boolean")
    def good(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = Machine(*shared.value)
        for text, *meta in batches:
            own = pd.DataFrame({"text": text} | {f"m{i}": x for i, x in enumerate(meta)})
            keep = np.zeros(len(own), bool)
            for s, rows in _batches(own, len(metadata)):
                keep[s] = [m.score(*r) >= threshold for r in rows]
            yield pd.Series(keep)
        give_back()

    return docs.filter(good(F.coalesce(F.col(text_col), F.lit("")), *(F.col(c).cast("double") for c in metadata)))
