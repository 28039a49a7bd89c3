"""Token-ID / binary output: ids packed in the minimum vocabulary bits, in blocks with offsets, unpacked by numpy."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, write_table
from .files import give_back, read_file, small_batches, write_file

MAGIC = b"VTOKENS1"
#: ids of a block; a multiple of 8, so that each block starts at a byte.
BLOCK_IDS = 4096
#: A file is closed after the document that brings it to so many ids.
FILE_IDS = 2_000_000
#: Chunks that a worker keeps the ids of, and characters of a batch, of which each chunk is looked up once.
KNOWN, BATCH_CHARS = 400000, 4_000_000
#: New chunks that the library gets at once: it holds some hundred bytes a token meanwhile.
AT_ONCE = 20_000
_HEAD = struct.Struct("<8sBQQQ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing: id k takes the bits k * bits to (k + 1) * bits - 1."""
    n = len(ids)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    v = np.zeros(-(-n // 8) * 8, np.uint64)
    v[:n] = ids
    v = v.reshape(-1, 8)
    out = np.zeros((len(v), bits), np.uint8)
    for k in range(8):
        at = k * bits
        for byte in range(at // 8, (at + bits + 7) // 8):
            shift = byte * 8 - at
            out[:, byte] |= ((v[:, k] >> np.uint64(shift) if shift >= 0 else v[:, k] << np.uint64(-shift)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    raw = np.zeros((-(-n // 8), bits), np.uint8)
    raw.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    out = np.zeros((len(raw), 8), np.uint64)
    for k in range(8):
        at = k * bits
        for byte in range(at // 8, (at + bits + 7) // 8):
            shift = byte * 8 - at
            b = raw[:, byte].astype(np.uint64)
            out[:, k] |= b << np.uint64(shift) if shift >= 0 else b >> np.uint64(-shift)
    return (out & np.uint64((1 << bits) - 1)).reshape(-1)[:n].astype("<u4")


def to_file(doc_ids: list[int | None], ends: list[int], ids: np.ndarray, bits: int) -> bytes:
    """head, doc ids (int64), null flags (uint8), end of each document (uint64), block offsets (uint64), blocks."""
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([
        _HEAD.pack(MAGIC, bits, len(doc_ids), len(ids), len(blocks)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(ends, "<u8").tobytes(), offsets.tobytes(), *blocks,
    ])


class TokenFile:
    """A file's documents, each readable alone: only the blocks that it touches are unpacked."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, n, self.n_ids, n_blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = [None if null else int(d) for d, null in zip(np.frombuffer(data, "<i8", n, at), np.frombuffer(data, np.uint8, n, at + 8 * n), strict=True)]
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n).astype(np.int64)
        self.body = memoryview(data)[at + 17 * n + 8 * (n_blocks + 1) :]

    def slice(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK_IDS, (stop - 1) // BLOCK_IDS
        held = min(self.n_ids, (last + 1) * BLOCK_IDS) - first * BLOCK_IDS
        ids = unpack(bytes(self.body[self.offsets[first] : self.offsets[last + 1]]), held, self.bits)
        return ids[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]

    def doc(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def docs(self, ids: int = 1 << 18) -> Iterator[np.ndarray]:
        """All documents in order; about so many ids are unpacked at a time, so that no block is unpacked for each of its documents."""
        start, a, held = 0, 0, self.slice(0, 0)
        for stop in self.ends.tolist():
            if stop > a + len(held):
                a, held = start, self.slice(start, min(self.n_ids, max(stop, start + ids)))
            yield held[start - a : stop - a]
            start = stop


class Encoder:
    """Texts to ids as the tokenizer gives them; each chunk of a batch is encoded once, and remembered.

    A byte-level BPE with the common pre-tokenisation never joins what stands on both sides of a space or line feed that
    follows another character than white space. So a text without other white space, and without two of these in a row, is cut
    before each of them, and the library gets the new chunks of a whole batch as one text: a token that begins with a space or
    a line feed then begins a chunk. Other texts, and other tokenizers, are encoded whole.
    """

    letters = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
    #: Signs that end a chunk of letters as a pre-token of their own.
    closing = ".,;:!?)"
    #: Stands before a text's first chunk, which no space opens.
    opens = "\x01"

    def __init__(self, path: str, known: int = KNOWN) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        pre = said.get("pre_tokenizer") or {}
        odd = [t for t in said.get("added_tokens", []) if re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or self.letters.fullmatch(t["content"].rstrip(self.closing))]
        self.by_chunk = said.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and said["model"]["type"] == "BPE" and not odd
        self.most, self.known = known, {}
        if self.by_chunk:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[[i for t, i in vocabulary.items() if t[:1] in "\u0120\u010a"]] = True  # the byte-level alphabet's space and line feed
            self.closed = {c: self._whole(c) for c in self.closing}

    @property
    def bits(self) -> int:
        return max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Parts are chunks without the space that opens them; a line feed, or the mark of a text's beginning, is there."""
        new, ended = {}, []
        for p in parts:
            if p[:1] == self.opens:
                self.known[p] = self._whole(p[1:])
            elif p[-1] in self.closed and self.letters.fullmatch(p, 0, len(p) - 1):
                ended.append(p)
                if p[:-1] not in self.known:
                    new[p[:-1]] = None
            else:
                new[p] = None
        new = list(new)
        for at in range(0, len(new), AT_ONCE):
            own = new[at : at + AT_ONCE]
            text = (" " + " ".join(own)).replace(" \n", "\n")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(own):
                raise ValueError("chunks don't begin where they should")
            held, cuts = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
            self.known.update(zip(own, [held[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        for p in ended:
            self.known[p] = self.known[p[:-1]] + self.closed[p[-1]]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.frombuffer(self._whole(t), "<u4") for t in texts]
        out, cut = [], []
        for i, t in enumerate(texts):
            plain = t.replace("\n", " ")
            if plain.isprintable() and plain[:1] != " " and plain[-1:] != " " and "  " not in plain:
                cut.append(i)
                out.append(None)
            else:  # white space of other kinds, or several in a row
                out.append(np.frombuffer(self._whole(t), "<u4"))
        if cut:
            parts = pc.split_pattern(pa.array([self.opens + texts[i].replace("\n", " \n") for i in cut], pa.string()), " ")
            coded = parts.values.dictionary_encode()
            # one string and its split are quicker than a value at a time; no part has a space
            names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
            own = list(map(self.known.get, names))
            if new := [i for i, ids in enumerate(own) if ids is None]:
                self._learn([names[i] for i in new])
                for i in new:
                    own[i] = self.known[names[i]]
            if len(self.known) > self.most:  # the batch's chunks, and so the frequent ones, stay
                self.known = dict(zip(names, own, strict=True))
            size = np.fromiter(map(len, own), np.int64, len(own)) // 4
            place, which = np.cumsum(size) - size, coded.indices.to_numpy()
            n = size[which]
            ends = np.cumsum(n)
            ids = np.frombuffer(b"".join(own), "<u4")[np.repeat(place[which] - (ends - n), n) + np.arange(int(n.sum()))]
            for i, own_ids in zip(cut, np.split(ids, ends[parts.offsets.to_numpy()[1:] - 1])[:-1], strict=True):
                out[i] = own_ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, known: int = KNOWN) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = known
    return _encoders[path]


def _packed(out: str, tokenizer: str, end_id: int, file_ids: int, known: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        enc, seq, docs, ends, held, n = encoder(tokenizer, known), 0, [], [], [], 0
        last = np.array([end_id], "<u4")

        def close() -> pd.DataFrame:
            nonlocal seq, docs, ends, held, n
            name = f"{out}/part-{task:06d}-{seq:06d}-{attempt}.vtok"
            write_file(name, to_file(docs, ends, np.concatenate(held), enc.bits))
            row = pd.DataFrame({"task": [task], "seq": [seq], "file": [name], "n_docs": [len(docs)], "n_ids": [n]})
            seq, docs, ends, held, n = seq + 1, [], [], [], 0
            return row

        for b in batches:
            texts, ids = b["text"].tolist(), b["id"].tolist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars < BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                for d, got in zip(ids[at:stop], enc.batch(texts[at:stop]), strict=True):
                    held += [got, last]
                    n += len(got) + 1
                    docs.append(None if d is None or d != d else int(d))
                    ends.append(n)
                    if n >= file_ids:
                        yield close()
                at = stop
        if docs:
            yield close()
        give_back()

    return run


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if _encoders:  # the writing is over, and the worker needs its encoder no more
        _encoders.clear()
        give_back()
    for b in batches:
        for name, base in zip(b["file"], b["base"], strict=True):
            f = TokenFile(read_file(name))
            starts = [0, *f.ends[:-1].tolist()]
            crc = [zlib.crc32(ids.tobytes()) for ids in f.docs()]
            yield pd.DataFrame({"id": pd.array(f.doc_ids, "Int64"), "start": [base + s for s in starts], "n_tokens": np.diff([0, *f.ends.tolist()]), "ids_crc32": crc})


def write_token_files(docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_ids: int = FILE_IDS, known: int = KNOWN) -> DataFrame:
    """Writes every whole text, in ascending id order, as token files under out; returns the manifest: one row per file,
    in order (task, seq): file, n_docs, n_ids, base (ids in all files before it).

    Ids are whole numbers, or strings of such. Null texts are empty (only the end id); null ids come first; repeated ids are
    ordered by the text's hash; equal rows are documents of their own. An empty table gives no file. Other columns are not read. The order comes from a range partitioning by (id, hash), which also splits a repeated id.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select(F.col("id").cast("string").alias("id"), "text")
    made = write_table(rows.mapInPandas(_packed(out, tokenizer, end_id, file_ids, known), "task long, seq long, file string, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("task", "seq").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from its file: id, start, n_tokens (with the end id), ids_crc32."""
    n = max(1, manifest.count())
    files = manifest.select("file", "base").repartition(min(n, 100_000))
    return files.mapInPandas(_read_back, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_binary(docs: DataFrame, tokenizer: str, **kw: object) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer, scratch_path(docs.sparkSession, "tokens"), **kw))
