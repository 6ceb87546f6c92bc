"""Byte-pair encoding and decoding with a public vocabulary.

Pieces of one pre-token are merged with a priority queue of merge ranks over a
doubly linked list of symbols; queue entries whose symbols have changed since
are skipped when they come up.  Decoding joins the vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import text_of

DEFAULT = "byte_bpe_50k.json"
#: White space as the pre-tokenizer's \s sees it.
WS = "\t-\r \x85\xa0  -     　"
#: A run of white space and the run of other characters behind it: pre-tokens never cross its ends.
CHUNK = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
#: Entries that a worker remembers between texts, in each of two generations.
REMEMBER = 200_000


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


@lru_cache(maxsize=1)
def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    """A bounded memo: two generations, the older is dropped when the newer is full."""

    def __init__(self, make, most: int = REMEMBER):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None):
        with open(vocabulary_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in byte_symbols().items()}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = [vocab[byte_symbols()[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # a pair of ids as one number, to its rank times 2 ** 32; the id that a rank makes
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a] << 32 | vocab[b]] = rank << 32
            self.made.append(vocab[a + b])
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.packed = {i: i.to_bytes(4, "little") for i in self.strings}
        self.pieces, self.chunks = Remembered(self._piece), Remembered(self._chunk)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token.  An entry of the queue is a rank and, below it, the place of the pair's first symbol."""
        get, made, pop, push = self.ranks.get, self.made, heapq.heappop, heapq.heappush
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        # the entry of the pair that begins at each place now; None if it doesn't merge or the place is gone
        now, queue, b = [None] * n, [], ids[0] if n else 0
        for i in range(n - 1):
            a, b = b, ids[i + 1]
            if (found := get(a << 32 | b)) is not None:
                now[i] = entry = found | i
                queue.append(entry)
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            if now[i] != entry:
                continue  # stale: one of the two has been merged since
            j = after[i]
            ids[i] = new = made[entry >> 32]
            ids[j], now[j] = -1, None
            after[i] = k = after[j]
            now[i] = None
            if k < n:
                before[k] = i
                if (found := get(new << 32 | ids[k])) is not None:
                    now[i] = entry = found | i
                    push(queue, entry)
            h = before[i]
            if h >= 0:
                if (found := get(ids[h] << 32 | new)) is not None:
                    now[h] = entry = found | h
                    push(queue, entry)
                else:
                    now[h] = None
        return [x for x in ids if x >= 0]

    def pre_tokens(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk)

    def _piece(self, piece: str) -> tuple[int, bytes, bytes]:
        ids = self.merge(piece.encode())
        return len(ids), b"".join([self.packed[i] for i in ids]), self.join(ids)

    def _chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        pieces = self.pieces
        found = [pieces[p] for p in self.pre_tokens(chunk)]
        if len(found) == 1:
            return found[0]
        return sum([f[0] for f in found]), b"".join([f[1] for f in found]), b"".join([f[2] for f in found])

    def sections(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at odd places."""
        return self.split_special.split(text) if self.split_special and "<" in text else [text]

    def join(self, ids) -> bytes:
        return b"".join([self.strings[i] for i in ids])

    def encode_bytes(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.sections(text)):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                chunks = self.chunks
                out += [chunks[c][1] for c in CHUNK.findall(part)]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        return self.join(ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(n_tokens, sha256 of the ids, sha256 of the decoded text); chunk by chunk, so no list of all ids is made."""
        n, ids, back = 0, hashlib.sha256(), []
        for k, part in enumerate(self.sections(text)):
            if k % 2:
                found = [(1, np.array([self.special[part]], "<u4").tobytes(), self.strings[self.special[part]])]
            else:
                chunks = self.chunks
                found = [chunks[c] for c in CHUNK.findall(part)]
            n += sum([f[0] for f in found])
            ids.update(b"".join([f[1] for f in found]))
            back += [f[2] for f in found]
        text_back = b"".join(back).decode("utf-8", "replace")
        return n, ids.hexdigest(), hashlib.sha256(text_back.encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    return Codec(path)


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Null text counts as empty: no ids.  Special strings inside a text become
    their special ids, as the library does by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = [c.digest(t) for t in batch.column(1).to_pylist()]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array) of every row; null text gives an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.frombuffer(c.encode_bytes(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and text; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
