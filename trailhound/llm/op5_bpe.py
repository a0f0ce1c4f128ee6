"""Byte-level BPE encoding and decoding by a contiguous rank array.

A word is held as a list of part boundaries with the merge rank of each adjacent pair of parts beside it. The smallest
rank is found by a scan, its inner boundary is deleted, and the two neighbouring ranks are looked up again, until no pair
has a rank. Words of more than ``SHORT`` bytes, where repeated scans would cost the square of the length, keep the same
parts as a linked list with their ranks in a heap: the same merges in the same order.

The vocabulary file is read once on the driver and travels to the executors as a broadcast of fixed size; texts are
encoded where they are scanned, without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trailhound.llm.common import table, texts, tidied

#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same with its three classes as plain sets of characters below U+10000, which ``re`` looks up in a bit map.
PLAIN_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"""
#: Characters that the sets do not hold.
ASTRAL = re.compile("[\U00010000-\U0010ffff]").search
#: Words of up to so many bytes are merged by repeated scans.
SHORT = 64
#: Encoded words that a worker remembers before it starts afresh, some 350 MB; forgetting only costs time.
REMEMBERED = 1_500_000
NO_RANK = 1 << 62


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_find(limit: int) -> Callable[[str], list[str]]:
    """``findall`` of ``PATTERN`` for texts whose characters all lie below ``limit``, at most U+10000."""
    every = "".join(map(chr, range(limit)))

    def members(kind: str) -> str:
        return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in regex.findall(kind + "+", every))

    sets = {"L": members(r"\p{L}"), "N": members(r"\p{N}"), "S": members(r"\s")}
    pattern = PLAIN_PATTERN
    for name, characters in sets.items():
        pattern = pattern.replace("{%s}" % name, characters)
    return re.compile(pattern).findall


class Words(dict):
    """Encoded words by their text: ids as little-endian 32-bit numbers."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec
        self.limit = REMEMBERED

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self.codec.merge(word.encode("utf-8", "surrogatepass"))
        out = self[word] = struct.pack("<%dI" % len(ids), *ids)
        return out


class Codec:
    """Encoder and decoder of one vocabulary file in the ``tokenizers`` JSON form."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model, of = spec["model"], byte_characters()
        vocabulary = model["vocab"]
        self.single = [0] * 256
        self.pieces: dict[int, bytes] = {}
        for text, number in vocabulary.items():
            self.pieces[number] = bytes(of[c] for c in text)
            if len(text) == 1:
                self.single[of[text]] = number
        self.merges: dict[tuple[int, int], int] = {}  # rank, and in the low 32 bits the id that the merge gives
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocabulary[left], vocabulary[right]), rank << 32 | vocabulary[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.find_any, self.find_plain, self.find_ascii = regex.compile(PATTERN).findall, plain_find(1 << 16), plain_find(1 << 7)
        self.words = Words(self)
        self.decimal: dict[int, str] = {}

    def find(self, text: str) -> list[str]:
        """The words of a text."""
        if text.isascii():
            return self.find_ascii(text)
        return self.find_any(text) if ASTRAL(text) else self.find_plain(text)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.single[b] for b in word]
        if len(parts) > SHORT:
            return self.merge_long(parts)
        rank_of = self.merges.get
        ranks = [rank_of(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, leftmost of the least rank first, with a heap in place of the scan."""
        n, merges = len(parts), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in merges]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n:
                continue
            found = merges.get((parts[i], parts[j]))
            if found != rank:
                continue  # the pair has changed since it was put here
            parts[i], alive[j], after[i] = found & 0xFFFFFFFF, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (parts[a], parts[b]) in merges:
                    heapq.heappush(heap, (merges[parts[a], parts[b]], a))
        return [p for p, x in zip(parts, alive) if x]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; a special token's own string becomes its id."""
        if self.split is None or not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(self.words.__getitem__, self.find(text))), "<u4")
        out = []
        for k, part in enumerate(self.split.split(text)):
            out.append(np.array([self.special[part]], "<u4").tobytes() if k % 2 else
                       b"".join(map(self.words.__getitem__, self.find(part))))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec_of(source: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    key = hash(source)
    if key not in _codecs:
        _codecs[key] = Codec(source)
    return _codecs[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of ints). Null text has no ids. A column ``ids`` of the input is replaced."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kept = docs.drop("ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for batch in batches:
            ids = [codec.encode(x).astype(np.int32) for x in texts(batch.column(text)).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*batch.schema.names, "ids"])

    return kept.mapInArrow(tidied(run), schema)


def decode(rows: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` in place of the ids; null ids give null."""
    source = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kept = [f for f in rows.schema.fields if f.name not in (ids, "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for batch in batches:
            out = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(out, pa.string())],
                                             [*[f.name for f in kept], "decoded"])

    return rows.select(*[f.name for f in kept], ids).mapInArrow(
        run, T.StructType([*kept, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Token count and digests of ids and decoded text per document, in one pass and without holding ids in the JVM."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    id_type = docs.schema["doc_id"]
    schema = T.StructType([id_type, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        decimal = [str(i) for i in range(max(codec.pieces) + 1)]
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for value in texts(batch.column("text")):
                ids = codec.encode(value.as_py())
                counts.append(len(ids))
                listed = ",".join(map(decimal.__getitem__, ids.tolist()))
                id_digests.append(hashlib.sha256(listed.encode()).hexdigest())
                text_digests.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(text_digests, pa.string())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Whole ``documents`` encoded and decoded. Null text counts as empty: no tokens, digests of nothing."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))
