"""Language ID by compression: the language whose zstandard raw-content dictionary makes a text smallest."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from .files import small_batches

#: The bounded sample: so many texts of a language, so many characters of each, so many bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 400, 1500, 96 * 1024
#: A text is compressed in pieces of so many bytes, or else its own beginning would replace the dictionary.
PIECE = 4096
LEVEL = 3
#: Predictions with a lower margin are marked as rejected.
MARGIN = 0.02
UNKNOWN = "und"
_NOISE = re.compile(r"[\W\d_]+")


_FAR = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=None)
def _odd_numbers(first: int, last: int) -> re.Pattern:
    """Fractions, superscripts, Roman numerals and the like: neither letters nor digits of ``_NOISE``."""
    return re.compile("[" + "".join(c for c in map(chr, range(first, last + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")


def plain(text: str) -> str:
    """Letters (as str.isalpha has them) only, lower-case, runs of anything else as one space."""
    out = _NOISE.sub(" ", text.lower())
    if not out.isascii():
        out = _odd_numbers(0x80, 0xFFFF).sub(" ", out)  # in one plane a set is a table, which is quick
        if _FAR.search(out):
            out = _odd_numbers(0x10000, sys.maxunicode).sub(" ", out)
    return out.strip()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: F.Column | None = None) -> dict[str, bytes]:
    """Language -> dictionary, from the SAMPLE_DOCS different texts of each language that come first by the order column (a hash
    of the text unless given), of each its first SAMPLE_CHARS characters; of these the last DICT_BYTES bytes stay.

    First the places of the sample are found among distinct hashes, so that copies don't take several; then their texts are
    fetched. Null texts or languages teach nothing; an empty table gives no language.
    """
    rank = F.xxhash64(text_col) if order is None else order
    held = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), rank.alias("rank"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
    top = InternalFunction.collect_top_k(F.col("rank"), SAMPLE_DOCS, True)  # the smallest
    last = held.select("lang", "rank").distinct().groupBy("lang").agg(F.array_max(top).alias("last"))
    few = held.join(F.broadcast(last), "lang").filter("rank <= last").groupBy("lang", "rank").agg(F.min("text").alias("text"))
    texts: dict[str, list[tuple]] = {}
    for row in few.collect():  # SAMPLE_DOCS a language at most
        texts.setdefault(row["lang"], []).append((row["rank"], row["text"]))
    out = {}
    for lang, own in texts.items():
        if sample := " ".join(p for p in (plain(t) for _, t in sorted(own)) if p):
            out[lang] = sample.encode("utf-8", "surrogatepass")[-DICT_BYTES:]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.sizes = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.sizes.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): margin is how much larger the second best is; no letters: UNKNOWN."""
        raw = plain(text or "").encode("utf-8", "surrogatepass")
        if not raw or not self.langs:
            return UNKNOWN, 0.0, 0.0
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        cost = sorted((sum(len(f(p)) for p in pieces) - 5 * len(pieces), k) for k, f in enumerate(self.sizes))
        best = cost[0][0]
        margin = (cost[1][0] - best) / max(1, cost[1][0]) if len(cost) > 1 else 1.0
        return self.langs[cost[0][1]], 1 - math.exp(-8 * margin), margin


_built: dict[int, Classifier] = {}


def _classify(dictionaries: dict[str, bytes], margin: float):
    name = hash(tuple(sorted(dictionaries.items())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built[name] = Classifier(dictionaries)
        for b in batches:
            got = [_built[name](t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "rejected": [x[0] == UNKNOWN or x[2] < margin for x in got]})

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), rejected (narrow margin). No shuffle.

    Whole texts, in pieces. A text that is null or without letters is `und`; ties go to the first language by name; null
    and repeated ids pass through; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    got = rows.mapInPandas(_classify(dictionaries, margin), "id string, lang_pred string, score double, rejected boolean")
    return got.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
