"""Benchmark decontamination: n-gram seeds find places, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_name, rows_with_keys, write_table
from .files import give_back, small_batches

SEED_WORDS = 5
#: Words of benchmark items that are looked up at once; more items take more passes over the texts.
BLOCK_WORDS = 2_000_000
#: A task remembers so many alignments, so that copies are aligned once; then it starts anew.
REMEMBERED = 20_000
#: Least alignment score as a share of a perfect one.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Seeds:
    """The n-grams of a block of items: word numbers, and for each n-gram its (item, place) list. Items are numbered, as two of
    them may have one id; names has the ids."""

    def __init__(self, items: list[tuple[str, str]], n: int = SEED_WORDS) -> None:
        self.vocab: dict[str, int] = {}
        self.names = [name for name, _ in items]
        self.items: dict[int, np.ndarray] = {}
        self.grams: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for item, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in tokens(text)]
            if ids:
                self.items[item] = np.array(ids, np.int32)
                size = min(n, len(ids))
                for i in range(len(ids) - size + 1):
                    self.grams.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), []).append((item, i))
        #: n-grams of a length by the hash of their first two words (or one), for a vectorised test
        self.firsts = {n: np.unique([self._pair(g[0], g[1] if n > 1 else 0) for g in own]) for n, own in self.grams.items()}

    @staticmethod
    def _pair(a, b):
        return a * (1 << 31) + b

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item -> (place in the text, place in the item) of every seed in a text of word numbers (0: a word of no item)."""
        out: dict[int, list[tuple[int, int]]] = {}
        for n, own in self.grams.items():
            if len(ids) < n:
                continue
            known = ids > 0
            whole = known[: len(ids) - n + 1].copy()
            for j in range(1, n):
                whole &= known[j : len(ids) - n + 1 + j]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            second = ids[at + 1].astype(np.int64) if n > 1 else np.zeros(len(at), np.int64)
            pair = self._pair(ids[at].astype(np.int64), second)
            firsts = self.firsts[n]
            at = at[firsts[np.minimum(np.searchsorted(firsts, pair), len(firsts) - 1)] == pair]
            for i in at.tolist():
                for item, place in own.get(tuple(ids[i : i + n].tolist()), ()):
                    out.setdefault(item, []).append((i, place))
        return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman by words: (score as a share of the item's perfect one, start and end in the window)."""
    n, m = len(item), len(window)
    steps = np.arange(m + 1) * -GAP
    h, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    for w in item.tolist():
        diag = h[:-1] + np.where(window == w, MATCH, MISMATCH)
        from_up = h[1:] + GAP
        cand = np.concatenate([[0], np.maximum(np.maximum(diag, from_up), 0)])
        came = np.concatenate([[0], np.where(diag >= from_up, origin[:-1], origin[1:])])
        came = np.where(cand > 0, came, np.arange(m + 1))
        lifted = cand + steps  # a gap along the window: the best cell to the left, less a gap for each step
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(m + 1), 0))
        h = run - steps
        origin = came[source]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(origin[j]), j)
    return best[0] / (MATCH * n), best[1], best[2]


def _find(shared, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds: Seeds = shared.value
        number = seeds.vocab.get
        aligned: dict[tuple[int, bytes], tuple[float, int, int]] = {}
        for b in batches:
            rows = []
            for doc, key, text in zip(b["id"].tolist(), b["key"].tolist(), b["text"].tolist(), strict=True):
                words = tokens(text)
                ids = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
                for item, found in seeds.hits(ids).items():
                    own = seeds.items[item]
                    size, found = len(own), sorted(found, key=lambda x: x[0] - x[1])
                    regions: list[list[tuple[int, int]]] = []
                    for i, place in found:  # seeds of one place have nearly the same offset
                        if regions and i - place - (regions[-1][-1][0] - regions[-1][-1][1]) <= size // 2 + 4:
                            regions[-1].append((i, place))
                        else:
                            regions.append([(i, place)])
                    for r in regions:
                        lo = max(0, min(i - p for i, p in r) - size // 2 - 4)
                        hi = min(len(ids), max(i - p for i, p in r) + size + size // 2 + 4)
                        window = ids[lo:hi]
                        # an alignment matches no more words than the window has of the item, so this loses nothing
                        if np.isin(own, window).sum() / size < threshold:
                            continue
                        pair = (item, window.tobytes())
                        if pair not in aligned:
                            if len(aligned) >= REMEMBERED:
                                aligned.clear()
                            aligned[pair] = align(own, window)
                        score, start, end = aligned[pair]
                        if score >= threshold:
                            rows.append((doc, key, seeds.names[item], score, lo + start, lo + end))
            yield pd.DataFrame(rows, columns=["id", "key", "item_id", "score", "start_word", "end_word"])
        give_back()

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    held, words = [], 0
    for item, text in benchmark.toLocalIterator():
        held.append((item, text))
        words += len(text) // 2 + 1
        if words >= BLOCK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Contaminated documents: rows (id, item_id, score, start_word, end_word, row_key), the best place of each document and item.

    Words are runs of letters and digits, lower-cased. Seeds are the items' n-grams of five words (of shorter items, the
    whole item). An edited copy with one intact seed is aligned, however many texts have the seed, unless its words show
    that the threshold can't be met, and reported when its score reaches the threshold. What is rare saves work, but never
    decides: a window, of which common seeds give many alike, is aligned once by a task. Null texts, items without id or
    text, and items without words match nothing; items with one id and several texts count for each text; rows with null
    or repeated ids are told apart by row_key (a hash of id and text), and equal rows are one. Empty documents or an empty
    benchmark give no rows; other columns are not read. Ids may have any type. The benchmark goes through in
    blocks of bounded size, each broadcast; the documents are read once a block and never shuffle, only what was found does.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(row_name(id_col, text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("row.id", "row.key", "text")
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).distinct().orderBy("item", "text")
    out = spark.createDataFrame([], "id string, key long, item_id string, score double, start_word long, end_word long")
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(Seeds(block))
        got = write_table(rows.mapInPandas(_find(shared, threshold), out.schema), "hits")
        shared.unpersist()
        best = got.groupBy("id", "key", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("start"), (-F.col("end_word")).alias("end"))).alias("b"))
        out = out.union(best.select("id", "key", "item_id", "b.score", (-F.col("b.start")).alias("start_word"), (-F.col("b.end")).alias("end_word")))
    kind = lambda df, c: df.schema[c].dataType
    return out.select(F.col("id").cast(kind(docs, id_col)).alias(id_col), F.col("item_id").cast(kind(benchmark, item_col)).alias("item_id"), "score", "start_word", "end_word", F.col("key").alias("row_key"))


def keep_clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that aren't among the found ones of the same docs; only rows that a Bloom filter lets
    through shuffle. Rows are told apart by id and text, so rows without id go too if they were found, and a repeated id
    loses none of its clean texts. Nothing found, or empty docs: docs as they are."""
    if "__row" in docs.columns:
        raise ValueError("reserved column: __row")
    bad = write_table(found.select(F.struct(F.col(id_col).cast("string").alias("id"), F.col("row_key").alias("key")).alias("__row")).distinct(), "found")
    flagged, free = rows_with_keys(docs.withColumn("__row", row_name(id_col, text_col)), bad, "__row", max(1, bad.count()))
    columns = [f"`{c}`" for c in docs.columns]
    return free.select(columns).unionByName(flagged.join(bad, "__row", "left_anti").select(columns))
