"""N-gram Jaccard join: universe partition with pigeonhole keys by size band, exact verification, components.

The universe of shingles is hashed into m segments. Two sets with a symmetric difference of at most H agree in one of
m > H segments, or, where a segment is also matched through one-element deletions (worth two), already with fewer segments.
Keys depend on the size band of the smaller set alone, so both partners know them. Sets that share a key are screened by
parity bitmaps, of a bit or two a shingle: two bitmaps never differ in more places than their sets, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, drop_table, join_groups, rows_with_keys, uid, write_table
from .files import give_back, small_batches
from .shingles import U, mix, shingle_sets

#: Shingles (at least 200 a set) of a verification block; two blocks meet in one task.
BLOCK_WEIGHT, LEAST_WEIGHT = 300_000, 200
#: The same for the bitmaps, in bits, and comparisons of a tile.
SCREEN_WEIGHT, LEAST_BITS, TILE = 8_000_000, 256, 500_000
#: Keys that a task holds before it writes them out, and those of a bucket, which one task sorts.
FLUSH_KEYS, FLUSH_NODES, BUCKET_KEYS = 4_000_000, 60_000, 3_000_000
#: What a needless candidate (a comparison of bitmaps) costs against a key, how often two lone shingles of unlike sets agree, and for how many sets
#: of a band the allocation is made: fixed, so that keys grow as the input.
PAIR_COST, LONE_SHARE, POPULATION = 0.1, 0.01, 2500


@lru_cache(maxsize=None)
def band_edge(k: int, num: int, den: int) -> int:
    """The least size of band k: the partners of a set of band k are in the bands k - 1 to k + 1."""
    e = 1
    for _ in range(k):
        e = e * den // num + 1
    return e


@lru_cache(maxsize=None)
def band_of(n: int, num: int, den: int) -> int:
    k = 0
    while band_edge(k + 1, num, den) <= n:
        k += 1
    return k


def n_keys(n: int, num: int, den: int) -> int:
    """About how many keys a set of n has."""
    k, out = band_of(n, num, den), 0
    for scheme in (k, k - 1):
        if scheme == k or (scheme >= 0 and n <= (band_edge(k, num, den) - 1) * den // num):
            m, n2, _, _ = allocation(scheme, num, den)
            out += m + n2 * n // m
    return out


@lru_cache(maxsize=None)
def allocation(k: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(m, n2, H, largest partner) of band k: m segments of which the first n2 also match by one deletion.

    m + n2 is over H, with some slack for segments that happen to be empty; of no, half or all segments with deletions the
    cheapest is taken, by the number of keys and the candidates that small segments bring.
    """
    small, least = band_edge(k + 1, num, den) - 1, band_edge(k, num, den)
    large = small * den // num
    both = small + large
    h = both - 2 * -(-num * both // (num + den))
    best = None
    for share in (0.0, 0.5, 1.0):
        m = max(1, math.ceil((h + 1) / (1 + share)))
        empty = m * math.exp(-least / m)
        m += math.ceil(empty + 2 * math.sqrt(empty)) if m > 1 else 0
        n2 = min(m, math.ceil(m * share))
        while m + n2 < h + 1:
            m += 1
        each = least / m
        lone = math.exp(-each) * (1 + each) if m > 1 else 0.0
        cost = m + n2 * each + PAIR_COST * POPULATION * m * lone**2 * LONE_SHARE * (1 - share / 2)
        if best is None or cost < best[0]:
            best = (cost, m, n2)
    return best[1], best[2], h, large


def keys_of(s: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
    """The set's keys in the scheme of band k.

    Keys of empty segments are left out, as they would match everywhere. That loses nothing for a set whose other segments
    still outweigh H; a set without that property (few do) gives them too, so two such sets meet there.
    """
    m, n2, h, _ = allocation(k, num, den)
    with np.errstate(over="ignore"):
        tag = mix(np.array([k * 0x1F123BB5 + m], U))[0]
        v = mix(s ^ tag)
        seg = ((v >> U(32)) * U(m) >> U(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, v = seg[order], mix(v[order] * U(0xD6E8FEB86659FD93))
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sums, where = np.add.reduceat(v, first), seg[first]
        size = np.diff(np.concatenate([first, [len(seg)]]))
        worth = np.where(where < n2, np.minimum(2, size), 1).sum()
        sparse = worth <= h
        salt = mix(np.arange(m, dtype=U) * U(0xA0761D6478BD642F) + tag)
        parts = [mix(sums + salt[where])]
        if n2:
            run = np.repeat(np.arange(len(first)), size)
            one = (where[run] < n2) & (sparse | (size[run] > 1))
            parts.append(mix((sums[run] - v + salt[where[run]])[one]))
        if sparse:
            none = np.ones(m, bool)
            none[where] = False
            parts.append(mix(salt[none]))
        return np.concatenate(parts)


def all_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys as the smaller set (or of the same band) and as a partner of the band below."""
    k = band_of(len(s), num, den)
    parts = [keys_of(s, k, num, den)]
    if k and len(s) <= (band_edge(k, num, den) - 1) * den // num:
        parts.append(keys_of(s, k - 1, num, den))
    return np.concatenate(parts)


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets are one node."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s).sum(dtype=U, keepdims=True) + U(len(s)) * U(0x8EBC6AF09C88C6E3)).view(np.int64)[0])


def bitmap_width(k: int, num: int, den: int) -> int:
    """Bits of the bitmap of a set of band k: a power of two, so that a wider bitmap folds to a narrower one."""
    return max(64, 1 << (band_edge(k + 1, num, den) - 2).bit_length())


def bitmap(s: np.ndarray, num: int, den: int) -> bytes:
    """Of each place the parity of the shingles there."""
    width = bitmap_width(band_of(len(s), num, den), num, den)
    odd = np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Forest:
    """Components of rows in one task; keeps the edges that joined two of them."""

    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        labels, at = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.edges += [(i, j) for j in others[at[new]].tolist()]
            self.label[np.isin(self.label, labels[new])] = self.label[i]


def stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The components of edges as edges of each node to its component's smallest: what one task knows, in as few rows as possible."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[x], label[y])
        for side in (before[x], before[y]):
            np.minimum.at(label, side, low)
        while (label != label[label]).any():
            label = label[label]
    far = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[far], "b": nodes[label[far]]}, dtype="int64")


def screen(n: np.ndarray, bits: list[bytes], width: int, left: np.ndarray, right: np.ndarray, num: int, den: int, forest: Forest) -> None:
    """Joins the rows i of left and j of right whose bitmaps, folded to width, allow a link."""
    same = left is right
    left = left[np.argsort(n[left], kind="stable")]
    right = left if same else right[np.argsort(n[right], kind="stable")]

    def folded(rows: np.ndarray) -> np.ndarray:
        return np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], U).reshape(-1, width // 64), axis=0) for i in rows.tolist()])

    x = folded(left)
    y = np.ascontiguousarray((x if same else folded(right)).T)
    n_left, n_right, a = n[left], n[right], 0
    step = max(1, TILE // len(right))
    while a < len(left):
        b = min(len(left), a + step)
        c, d = np.searchsorted(n_right, -(-n_left[a] * num // den)), np.searchsorted(n_right, n_left[b - 1] * den // num, "right")
        c = max(c, a) if same else c
        if c < d:
            differ = np.zeros((b - a, d - c), np.uint16 if width < 1 << 16 else np.uint32)
            for w in range(width // 64):
                differ += np.bitwise_count(x[a:b, w, None] ^ y[w, None, c:d])
            both = n_left[a:b, None] + n_right[None, c:d]
            most = both + 2 * (-num * both // (num + den))
            hits = np.maximum(differ, np.abs(n_left[a:b, None] - n_right[None, c:d])) <= most
            for r in np.flatnonzero(hits.any(1)).tolist():
                forest.join(int(left[a + r]), right[c:d][hits[r]])
        a = b


def _chunks(b: pd.DataFrame) -> Iterator[tuple[slice, list[str]]]:
    texts, at = b["text"].tolist(), 0
    while at < len(texts):
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars < 1_000_000):
            chars += len(texts[stop])
            stop += 1
        yield slice(at, stop), texts[at:stop]
        at = stop


def _names(words: int, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, texts in _chunks(b):
                sets = shingle_sets(texts, words)
                out = b[["id", "row_key"]].iloc[at].reset_index(drop=True)
                out["n"] = [len(s) for s in sets]
                out["node"] = pd.array([node_of(s) if len(s) else None for s in sets], "Int64")
                out["n_keys"] = [n_keys(len(s), num, den) if len(s) else 0 for s in sets]
                out["bits"] = [bitmap(s, num, den) if len(s) else None for s in sets]
                yield out
        give_back()

    return run


def _index(words: int, num: int, den: int, buckets: int):
    """Rows of keys (bucket, blob): of each task and bucket the keys are in one blob."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        held: list[np.ndarray] = []
        n_keys = 0

        def flush() -> pd.DataFrame:
            nonlocal n_keys
            nodes = np.array(list(seen), np.int64)
            keys = np.concatenate(held)
            idx = np.repeat(np.arange(len(held)), [len(k) for k in held])
            b = (keys % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            keys, idx, b = keys[order] // U(buckets), idx[order], b[order]
            cuts = np.searchsorted(b, np.arange(buckets + 1))
            blobs = []
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                k, own = keys[cuts[i] : cuts[i + 1]], idx[cuts[i] : cuts[i + 1]]
                which, local = np.unique(own, return_inverse=True)
                head = np.array([len(which), len(k)], np.uint32)
                blobs.append((i, b"".join(x.tobytes() for x in (head, nodes[which], (k & U(0xFFFFFFFF)).astype(np.uint32), (k >> U(32) & U(0xFFFF)).astype(np.uint16), local.astype(np.uint16)))))
            seen.clear()
            held.clear()
            n_keys = 0
            return pd.DataFrame(blobs, columns=["bucket", "blob"])

        for b in batches:
            for _, texts in _chunks(b):
                for s in shingle_sets(texts, words):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen[node] = len(seen)
                        held.append(all_keys(s, num, den))
                        n_keys += len(held[-1])
                if n_keys >= FLUSH_KEYS or len(seen) >= FLUSH_NODES:
                    yield flush()
        if held:
            yield flush()
        give_back()

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: nodes that share keys, directly or through others, as stars (candidates only)."""
    keys, nodes = [], []
    for blob in pdf["blob"]:
        n, m = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
        names = np.frombuffer(blob, np.int64, n, 8)
        at = 8 + 8 * n
        hi = np.frombuffer(blob, np.uint16, m, at + 4 * m).astype(U) << U(32)
        keys.append(np.frombuffer(blob, np.uint32, m, at).astype(U) | hi)
        nodes.append(names[np.frombuffer(blob, np.uint16, m, at + 6 * m)])
    key, node = np.concatenate(keys), np.concatenate(nodes)
    by = np.argsort(key, kind="stable")
    key, node = key[by], node[by]
    same = key[1:] == key[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    key, node = key[many], node[many]
    if not len(key):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return stars(node, np.repeat(node[first], np.diff(np.concatenate([first, [len(key)]]))))


def linked(sets: list[np.ndarray], num: int, den: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (i, j), i of left and j of right, with den * |A & B| >= num * |A | B|; exact.

    Intersections are products of the 0/1 matrix of the shingles that several sets have, in slices of columns.
    """
    sizes = np.array([len(s) for s in sets])
    tokens, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    df = np.bincount(col, minlength=len(tokens))
    keep = df[col] > 1
    rank = np.cumsum(df > 1) - 1
    row, col = row[keep], rank[col[keep]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    n_cols, width = int((df > 1).sum()), 4096
    common = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for c in range(0, n_cols, width):
        a, b = np.searchsorted(col, [c, c + width])
        r, q = row[a:b], col[a:b] - c
        x = np.zeros((len(left), min(width, n_cols - c)), np.float32)
        x[place_l[r][place_l[r] >= 0], q[place_l[r] >= 0]] = 1
        y = x
        if left is not right:
            y = np.zeros((len(right), min(width, n_cols - c)), np.float32)
            y[place_r[r][place_r[r] >= 0], q[place_r[r] >= 0]] = 1
        common += x @ y.T
    shared = np.rint(common).astype(np.int64)
    joint = sizes[left][:, None] + sizes[right][None, :] - shared
    hit_l, hit_r = np.nonzero((den * shared >= num * joint) & (shared > 0))
    forest = Forest(len(sets))
    rows, first = np.unique(hit_l, return_index=True)
    for r, own in zip(rows.tolist(), np.split(hit_r, first[1:])[: len(rows)], strict=True):
        forest.join(int(left[r]), right[own])
    return forest.edges


def small_bytes(s: np.ndarray) -> bytes:
    """The upper 48 bits of each shingle: a pair of sets of thousands has a chance collision once in some hundred millions."""
    return (s >> U(16)).astype(np.uint32).tobytes() + (s >> U(48)).astype(np.uint16).tobytes()


def from_small(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, np.uint32, n).astype(U) | np.frombuffer(b, np.uint16, n, 4 * n).astype(U) << U(32)


def _verify(num: int, den: int):
    """A group holds a small candidate cluster (band -1), or of a large one a block of band ka and one of ka or ka + 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for (_, ka, i, kb, j), g in pdf.drop_duplicates(["root", "ka", "i", "kb", "j", "node"]).groupby(["root", "ka", "i", "kb", "j"], sort=False):
            if len(g) < 2:
                continue
            sets = [from_small(x) for x in g["shingles"]]
            band, block, nodes = g["band"].to_numpy(), g["block"].to_numpy(), g["node"].to_numpy()
            left = np.flatnonzero((band == ka) & (block == i))
            right = left if (ka, i) == (kb, j) else np.flatnonzero((band == kb) & (block == j))
            for x, y in linked(sets, num, den, left, right) if len(left) and len(right) else ():
                a.append(nodes[x])
                b.append(nodes[y])
        return stars(np.array(a, np.int64), np.array(b, np.int64))

    return run


def _screen(num: int, den: int):
    """As _verify, by bitmaps: the pairs that may link, as a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for (_, ka, i, kb, j), g in pdf.groupby(["root", "ka", "i", "kb", "j"], sort=False):
            if len(g) < 2:
                continue
            n, nodes, bits = g["n"].to_numpy(), g["node"].to_numpy(), g["bits"].tolist()
            bands = np.array([band_of(x, num, den) for x in n.tolist()])
            block = g["block"].to_numpy()
            forest = Forest(len(g))
            if ka < 0:
                pairs = [(k, bands == k, x, bands == x) for k in np.unique(bands).tolist() for x in (k, k + 1)]
            else:
                pairs = [(ka, (bands == ka) & (block == i), kb, (bands == kb) & (block == j))]
            for k, is_left, x, is_right in pairs:
                left = np.flatnonzero(is_left)
                right = left if k == x and (ka < 0 or i == j) else np.flatnonzero(is_right)
                if len(left) and len(right):
                    screen(n, bits, bitmap_width(k, num, den), left, right, num, den, forest)
            a += [nodes[x] for x, _ in forest.edges]
            b += [nodes[x] for _, x in forest.edges]
        return stars(np.array(a, np.int64), np.array(b, np.int64))

    return run


PLACES = "array<struct<key: long, root: long, ka: int, i: long, kb: int, j: long, band: int, block: long>>"
PLACED = "node long, shingles binary, key long, root long, ka int, i long, kb int, j long, band int, block long"


def _sets_again(words: int):
    """Each candidate's set, once for every group that it is in; of equal rows that come to a task, the first."""
    columns = [x.split()[0] for x in PLACED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            b = b[~b["node"].isin(seen)].drop_duplicates("node")
            for at, texts in _chunks(b):
                rows = []
                for s, node, places in zip(shingle_sets(texts, words), b["node"].iloc[at], b["places"].iloc[at], strict=True):
                    if len(s) and node_of(s) == node:  # unequal rows may have one key
                        seen.add(node)
                        data = small_bytes(s)
                        rows += [(node, data, *(p[c] for c in columns[2:])) for p in places]
                yield pd.DataFrame(rows, columns=columns)

    return run


def meetings(nodes: DataFrame, weight: F.Column, limit: int, all_weight: int) -> DataFrame:
    """The rows (node, root, n, band and others) with the places, each a group of one task, where they meet the others of their root.

    A root up to the limit is one group; such groups are packed into bins, of which there are enough for the weight of all
    nodes. A larger one is cut into blocks of each band, and a block meets those of its own band and of the next.
    """
    rest = [c for c in nodes.columns if c not in ("root", "band", "at")]
    zero = F.lit(0).cast("long")
    bins = max(-(-all_weight // limit), 2 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a root has one row per band here, a few dozen at most
    parts = nodes.groupBy("root", "band").agg(F.sum(weight).alias("weight"))
    of_root = W.partitionBy("root")
    by_band = of_root.orderBy("band")
    parts = parts.withColumn("blocks", F.ceil(F.col("weight") / limit)).withColumn("small", F.sum("weight").over(of_root) <= limit)
    beside = lambda f, step: F.coalesce(F.when(f("band").over(by_band) == F.col("band") + step, f("blocks").over(by_band)), zero)
    parts = parts.select(F.struct("root", "band").alias("at"), "small", "blocks", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    placed = join_groups(nodes.withColumn("at", F.struct("root", "band")), parts, "at").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def place(ka: F.Column, i: F.Column, kb: F.Column, j: F.Column) -> F.Column:
        key = F.lit(bins) + F.pmod(F.xxhash64("root", ka, i, kb, j), F.lit(1 << 40))
        return F.struct(key.alias("key"), F.col("root"), ka.alias("ka"), i.alias("i"), kb.alias("kb"), j.alias("j"), F.col("band"), F.col("block"))

    def upto(n: str) -> F.Column:
        return F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    band, block = F.col("band"), F.col("block")
    own = F.transform(upto("blocks"), lambda x: place(band, F.least(block, x), band, F.greatest(block, x)))
    up = F.transform(upto("above"), lambda x: place(band, block, band + 1, x))
    down = F.transform(upto("below"), lambda x: place(band - 1, x, band, block))
    alone = F.struct(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("key"), F.col("root"), F.lit(-1).alias("ka"), zero.alias("i"), F.lit(-1).alias("kb"), zero.alias("j"), F.lit(-1).alias("band"), zero.alias("block"))
    places = F.when(F.col("small"), F.array(alone).cast(PLACES)).otherwise(F.concat(own, up, down).cast(PLACES))
    return placed.select(*rest, places.alias("places"))


def jaccard_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, itself included), row_key (a
    hash of id and text), keeps (true for the row of the component with the smallest id, null ids last, then smallest row_key).

    Two documents link when their sets of distinct word shingles have a Jaccard similarity of num / den or more; every link
    counts, none is sampled or capped. Null texts and texts without words have no shingles, link with nothing and keep; repeated
    rows are copies, equal in row_key too. Rows without id take part as the others do; the component_id of a component of only
    such rows is null. Ids are whole numbers or strings of such. Other columns are not read; an empty table gives no rows.

    1. One pass over the texts names the sets, one more makes their keys (cheaper than to store either). 2. Per bucket of
    keys: stars of candidates, no pairs. 3. Components of candidates; in each the bitmaps are compared (`meetings`), which
    leaves the components of pairs that may link. 4. In these the sets, read again, are verified exactly, each task
    returning stars. 5. Components of verified links.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("id", "text"))
    as_text = rows.withColumn("id", F.col("id").cast("string"))  # long ids beside nulls would become floats in Python
    listed = write_table(as_text.mapInPandas(_names(words, num, den), "id string, row_key long, n long, node long, n_keys long, bits binary").withColumn("id", F.col("id").cast("long")), "sets")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row_key").alias("row_key"))).alias("best")
    nodes = write_table(listed.filter("node is not null").groupBy("node").agg(best, F.first("n").alias("n"), F.first("n_keys").alias("n_keys"), F.first("bits").alias("bits")), "nodes")
    of = lambda least: F.greatest(F.col("n"), F.lit(least))
    most, keys, weight, screen_weight, total = (x or 1 for x in nodes.agg(F.max("n"), F.sum("n_keys"), F.sum(of(LEAST_WEIGHT)), F.sum(of(LEAST_BITS)), F.count(F.lit(1))).first())

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS))
    maybe = rows.select("text").mapInPandas(_index(words, num, den, buckets), "bucket int, blob binary").groupBy("bucket").applyInPandas(_meet, "a long, b long")
    maybe = components(maybe)
    edges = F.array(*(F.lit(band_edge(k, num, den)) for k in range(1, band_of(most, num, den) + 1)))
    nodes_in_bands = nodes.withColumn("band", F.size(F.filter(edges, lambda x: x <= F.col("n"))).cast("int") if most > 1 else F.lit(0))
    candidates = write_table(maybe.join(nodes_in_bands, "node").select("node", "root", "n", "bits", "band"), "candidates")
    first = meetings(candidates, of(LEAST_BITS), SCREEN_WEIGHT, screen_weight)
    first = first.select("node", "n", "bits", F.explode("places").alias("p")).select("node", "n", "bits", "p.*")
    likely = components(first.groupBy("key").applyInPandas(_screen(num, den), "a long, b long"))
    drop_table(candidates)
    second = write_table(likely.join(nodes_in_bands, "node").select("node", "root", "n", F.struct("best.id", "best.row_key").alias("row"), "band"), "likely")
    places = write_table(meetings(second, of(LEAST_WEIGHT), BLOCK_WEIGHT, weight).select("row", "node", "places"), "places")
    drop_table(second)

    texts, _ = rows_with_keys(rows.select(F.struct("id", "row_key").alias("row"), "text"), places, "row", total)
    met = texts.join(places.hint("shuffle_hash"), "row").select("text", "node", "places").mapInPandas(_sets_again(words), PLACED)
    parts = components(met.groupBy("key").applyInPandas(_verify(num, den), "a long, b long"))
    drop_table(places)

    linked_nodes = write_table(parts.join(nodes.select("node", "best"), "node").select("node", "root", "best"), "linked")
    least = linked_nodes.groupBy("root").agg(F.min("best").alias("least"))
    named = join_groups(linked_nodes, least, "root").select("node", "least")
    names = nodes.join(named, "node", "left").select("node", F.coalesce("least", "best").alias("best"))
    out = join_groups(listed.select("id", "row_key", "n", "node"), names, "node")
    alone = F.col("node").isNull()
    keeps = alone | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("row_key") == F.col("best.row_key")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"), "row_key", keeps.alias("keeps"))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every class (of `jaccard_classes` of the same docs) one row, with all its columns: that which keeps. Rows are told apart
    by id and text, so a repeated id loses none of its other texts, and rows without id are treated as the others.

    Only rows that a Bloom filter of the rows to drop, and of those that occur several times, lets through shuffle. Of equal
    rows (same id and text, with words) one stays; rows without words all stay. An empty table gives no rows.
    """
    clash = [c for c in ("__row", "__drop") if c in docs.columns]
    if clash:
        raise ValueError(f"reserved columns: {clash}")
    columns = [f"`{c}`" for c in docs.columns]
    row = F.struct(F.col(id_col).cast("long").alias("id"), F.col("row_key"))
    held = classes.filter("n_shingles > 0").groupBy(row.alias("__row")).agg(F.max(~F.col("keeps")).alias("__drop"), F.count(F.lit(1)).alias("n"))
    checked = write_table(held.filter("__drop or n > 1").select("__row", "__drop"), "checked")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumn("__row", F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row_key")))
    flagged, free = rows_with_keys(own, checked, "__row", max(1, checked.count()))
    met = flagged.join(checked, "__row", "left").filter("__drop is null or not __drop")
    kept = met.withColumn("__drop", F.when(F.col("__drop").isNull(), uid())).dropDuplicates(["__row", "__drop"])
    return free.select(columns).unionByName(kept.select(columns))
