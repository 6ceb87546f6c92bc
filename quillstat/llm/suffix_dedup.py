"""Removal of byte strings that an earlier document holds, by suffix arrays.

Every byte under a 50-byte string that also starts in a document with a smaller
id is removed.  A suffix array of the whole corpus is cut into independent ones:

1. Anchors.  A window of WIDTH consecutive K-byte strings, which is LENGTH bytes,
   picks its K-byte string of least hash.  Equal windows pick the same one, so
   windows need comparing only within groups of equal anchors.  Texts are dealt
   to parts of some megabytes; each part sends the hashes of its anchors, packed,
   to slices of the hash range, whose number grows with the corpus, and gets back
   those that two documents have: a semi-join, exact but for equal 48-bit hashes.
   The rest can't take part in a match.
2. Regions.  The bytes around a shared anchor that its windows cover.  A part
   sends a region once, with its least document; later documents of the part with
   the same region are decided on the spot.  An anchor of more than HOT_DOCS
   documents sends single windows, dealt by their own bytes, so that no bucket
   gets all that surrounds it.
3. Buckets of anchors build the suffix array of their distinct regions by
   two-stage sorting: suffixes smaller than their successors are sorted
   directly, the others are induced by one scan over the byte buckets; common
   prefixes of neighbours give the classes of equal windows and their least
   document.
4. The marked window starts of each document are cut from its text.

The three steps that read texts ask for them dealt by the same part, so Spark
shuffles the texts once and reuses the exchange.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import U64, mix64, text_of, with_fields

LENGTH, K = 50, 16
WIDTH = LENGTH - K + 1
REGION = WIDTH - 1 + LENGTH
HASH_BITS = 48
#: Text of a part, of a slice's share and of a bucket's.
PART_BYTES, SLICE_BYTES, BUCKET_BYTES = 1 << 23, 1 << 26, 1 << 21
PASS_BYTES = 1 << 20
#: An anchor of more documents is compared window by window.
HOT_DOCS = 100_000
ALL = U64((1 << WIDTH) - 1)
NONE = np.iinfo(np.int64).max
_POS = U64((1 << 28) - 1)
_BYTES = mix64(np.arange(1, 257, dtype=U64))
_MUL = 0x9E3779B97F4A7C15


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of texts laid end to end; ends are the texts' ends."""
    ok = np.zeros(len(buf), bool)  # starts whose window ends inside their text
    start = 0
    for end in ends.tolist():
        if end - start >= LENGTH:
            ok[start : end - LENGTH + 1] = True
        start = end
    found = [_anchors(buf[i : i + PASS_BYTES + LENGTH - 1], ok[i : i + PASS_BYTES]) for i in range(0, len(buf), PASS_BYTES)]
    h, at = ([f[j] for f in found] for j in (0, 1))
    at = [x + i * PASS_BYTES for i, x in enumerate(at)]
    if not at:
        return np.empty(0, U64), np.empty(0, np.int64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return np.concatenate(h)[first], at


def _anchors(buf: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows that start at places that are ok; arrays of many bytes for each byte of buf."""
    n = len(buf)
    if n < LENGTH or not ok.any():
        return np.empty(0, U64), np.empty(0, np.int64)
    h, span, mul = _BYTES[buf], 1, _MUL
    while span < K:  # the hash of 2s bytes from two of s bytes
        h[:-span] = h[:-span] * U64(mul) + h[span:]
        mul, span = mul * mul & (1 << 64) - 1, 2 * span
    h = mix64(h)
    least = (h & ~_POS) | np.arange(n, dtype=U64)
    span = 1
    while 2 * span <= WIDTH:
        np.minimum(least[:-span], least[span:], out=least[:-span])
        span *= 2
    if WIDTH > span:
        np.minimum(least[: span - WIDTH], least[WIDTH - span :], out=least[: span - WIDTH])
    at = np.unique((least[: len(ok)][ok] & _POS).astype(np.int64))
    return mix64(h[at]), at  # least hashes are small; mixed again they spread over all buckets


def _passes(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of texts of about so many bytes together."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= most or j + 1 == len(texts):
            yield i, j + 1
            i, size = j + 1, 0


def _found(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, ends, anchor hashes, places, text numbers)."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    h, at = anchors(buf, ends)
    return buf, ends, h, at, np.searchsorted(ends, at, "right")


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    return h >> U64(64 - HASH_BITS)


def _pack_hashes(h: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending hashes as differences and small numbers beside them, byte by byte plane, compressed."""
    d = np.diff(h, prepend=U64(0))
    planes = np.concatenate([d.view(np.uint8).reshape(-1, 8), n.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(12, -1).T
    return np.cumsum(np.ascontiguousarray(planes[:, :8]).view(U64).ravel(), dtype=U64), np.ascontiguousarray(planes[:, 8:]).view("<u4").ravel().astype(np.int64)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[at], (np.add.reduceat(n, at) if len(at) else np.empty(0, np.int64))


def shared_anchors(texts: DataFrame, n_slices: int) -> DataFrame:
    """(part, blob): the hashes of a part's anchors that two rows of the corpus have, with the number of those rows."""

    def gather(table: pa.Table) -> pa.Table:
        held = []
        rows = _known(table)[1]
        for i, j in _passes(rows, PASS_BYTES):
            _, _, h, _, doc = _found(rows[i:j])
            pairs = np.unique(np.stack([_short(h), doc.astype(U64)], axis=1), axis=0)[:, 0] if len(h) else _short(h)
            held.append(_summed(pairs, np.ones(len(pairs), np.int64)))
        h, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.empty(0, U64), np.empty(0, np.int64))
        if not len(h):
            return pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())]).empty_table()
        slices = _bucket_of(h << U64(64 - HASH_BITS), n_slices)
        cuts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]])
        blobs = [_pack_hashes(h[x:y], n[x:y]) for x, y in zip(cuts, [*cuts[1:], len(h)], strict=True)]
        return pa.table({"slice": pa.array(slices[cuts], pa.int64()), "part": pa.array([table.column("part")[0].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        parts = [_unpack_hashes(b) for b in table.column("blob").to_pylist()]
        total, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        out = []
        for h, _ in parts:
            at = np.searchsorted(total, h)
            ok = n[at] > 1
            out.append(_pack_hashes(h[ok], np.minimum(n[at[ok]], 2**32 - 1)) if ok.any() else None)
        return pa.table({"part": table.column("part"), "blob": pa.array(out, pa.binary())}).filter(pa.array([b is not None for b in out], pa.bool_()))

    rows = texts.groupBy("part").applyInArrow(gather, "slice long, part int, blob binary")
    return rows.groupBy("slice").applyInArrow(meet, "part int, blob binary")


def _known(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """(ids, texts) of the rows that have an id."""
    rows = [(i, b"" if t is None else t) for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True) if i is not None]
    return [i for i, _ in rows], [t for _, t in rows]


_COLUMNS = np.dtype([("doc", "<i8"), ("crc", "<i8"), ("at", "<i8"), ("region", "<i4"), ("part", "<i4")])


def _pack(regions: np.ndarray, rows: np.ndarray) -> bytes:
    head = np.array([len(regions)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + regions.tobytes() + rows.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    cut = 8 + n * (REGION + 2)
    return np.frombuffer(data[8:cut], f"V{REGION + 2}"), np.frombuffer(data[cut:], _COLUMNS)


def _regions(buf: np.ndarray, ends: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The bytes of each anchor's windows, and behind them the first and last window that lies in the text."""
    starts = np.r_[0, ends[:-1]][doc]
    wide = np.concatenate([np.zeros(WIDTH, np.uint8), buf, np.zeros(REGION, np.uint8)])
    begin = at - (WIDTH - 1)
    out = np.empty((len(at), REGION + 2), np.uint8)
    out[:, :REGION] = wide[(begin + WIDTH)[:, None] + np.arange(REGION)]
    first = np.maximum(0, starts - begin)
    last = np.minimum(WIDTH - 1, ends[doc] - LENGTH - begin)
    out[:, REGION], out[:, REGION + 1] = first, last
    place = np.arange(REGION)
    stop = np.minimum(REGION, ends[doc] - begin)
    out[:, :REGION][(place < first[:, None]) | (place >= stop[:, None])] = 0
    return out


def two_stage_order(text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wanted suffixes in order of their first LENGTH bytes, and the common prefixes of neighbours, up to LENGTH.

    A suffix is of type A if it is greater than its successor by its first byte,
    else of type B.  Only type B is sorted; type A is induced: scanning buckets
    of first bytes upward, the predecessor of each suffix found so far goes to
    the next free place of its own bucket, ahead of that bucket's type B.  The
    text must go on for LENGTH + 1 bytes behind the last wanted suffix.
    """
    is_a = np.r_[text[:-1] > text[1:], False]
    need = wanted.copy()
    step = need & is_a
    while step.any():  # what a wanted type A follows from
        step = np.r_[False, step[:-1]] & ~need
        need |= step
        step = need & is_a & step
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(at: np.ndarray, k: int) -> np.ndarray:
        return np.ascontiguousarray(words[at + 8 * k]).view(">u8").ravel().astype(U64)

    b = np.flatnonzero(need & ~is_a)
    key = word(b, 0)
    order = np.argsort(key, kind="stable")
    b, key = b[order], key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(b) else np.empty(0, bool)
    for k in range(1, 7):  # refine ties by the next eight bytes
        tied = ~new | ~np.r_[new[1:], True]
        if not tied.any():
            break
        slots = np.flatnonzero(tied)
        group = np.cumsum(new)[slots]
        w = word(b[slots], k)
        order = np.lexsort((w, group))
        b[slots], w = b[slots][order], w[order]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (w[1:] != w[:-1])]
        new[slots] |= fresh
    first = text[b]
    cuts = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket = np.concatenate([*induced[c], b[cuts[c] : cuts[c + 1]]])
        induced[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[need[before] & is_a[before]]
        if len(before):
            target = text[before]
            turn = np.argsort(target, kind="stable")
            before, target = before[turn], target[turn]
            at = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            for t, part in zip(target[at].tolist(), np.split(before, at[1:]), strict=True):
                induced[t].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    order = order[wanted[order]]
    common = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k in range(7):
        if not len(open_):
            break
        x = word(order[open_], k) ^ word(order[open_ - 1], k)
        same = np.zeros(len(x), np.int64)
        for byte in range(8):
            same[(x >> U64(56 - 8 * byte) == 0)] = byte + 1
        common[open_] += same
        open_ = open_[same == 8]
    return order, np.minimum(common, LENGTH)


def least_documents(regions: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each region and window, the least document with an equal window in any of the regions."""
    raw = np.frombuffer(regions.tobytes(), np.uint8).reshape(len(regions), REGION + 2)
    windows = np.arange(WIDTH)
    valid = (windows >= raw[:, REGION : REGION + 1]) & (windows <= raw[:, REGION + 1 :])
    wanted = np.zeros((len(regions), REGION), bool)
    wanted[:, :WIDTH] = valid
    text = np.concatenate([raw[:, :REGION].ravel(), np.zeros(LENGTH + 1, np.uint8)])
    order, common = two_stage_order(text, np.r_[wanted.ravel(), np.zeros(LENGTH + 1, bool)])
    out = np.full((len(regions), WIDTH), NONE, np.int64)
    if len(order):
        region, window = order // REGION, order % REGION
        starts = np.flatnonzero(common < LENGTH)
        least = np.minimum.reduceat(docs[region], starts)
        out[region, window] = np.repeat(least, np.diff(np.r_[starts, len(order)]))
    return out


_BITS = (U64(1) << np.arange(WIDTH, dtype=U64))


def _windows_apart(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(regions of one window each, hash of its bytes, number of the region it comes from)."""
    inside = (np.arange(WIDTH) >= raw[:, REGION][:, None]) & (np.arange(WIDTH) <= raw[:, REGION + 1][:, None])
    number, window = np.nonzero(inside)
    out = np.zeros((len(number), REGION + 2), np.uint8)
    rows, places = np.arange(len(number))[:, None], window[:, None] + np.arange(LENGTH)
    out[rows, places] = raw[number[:, None], places]
    out[:, REGION] = out[:, REGION + 1] = window
    h = np.zeros(len(number), U64)
    for j in range(LENGTH):
        h = h * U64(_MUL) + _BYTES[out[rows[:, 0], places[:, j]]]
    return out, mix64(h), number


def window_marks(texts: DataFrame, shared: DataFrame, n_buckets: int, hot: int) -> DataFrame:
    """(part, doc_id, crc, at, mask): bit j says that the window at ``at + j`` of the document is to go; crc is the text's."""

    def spread(table: pa.Table, blobs: pa.Table) -> pa.Table:
        ids, rows = _known(table)
        held = []
        if blobs.num_rows and rows:
            part = table.column("part")[0].as_py()
            known, n_docs = _summed(*(np.concatenate(x) for x in zip(*map(_unpack_hashes, blobs.column("blob").to_pylist()), strict=True)))
            for i, j in _passes(rows, PASS_BYTES):
                buf, ends, h, at, doc = _found(rows[i:j])
                place = np.minimum(np.searchsorted(known, _short(h)), len(known) - 1)
                ok = known[place] == _short(h)
                h, at, doc, often = h[ok], at[ok], doc[ok], n_docs[place[ok]] > hot
                if not len(h):
                    continue
                begin = at - (WIDTH - 1) - np.r_[0, ends[:-1]][doc]
                crc = np.array([zlib.crc32(t) for t in rows[i:j]], np.int64)
                raw, doc_id = _regions(buf, ends, at, doc), np.array(ids[i:j], np.int64)[doc]
                crc = crc[doc]
                if often.any():
                    single, window_hash, of = _windows_apart(raw[often])
                    both = lambda x: np.concatenate([x[~often], x[often][of]])  # noqa: B023, E731
                    h, raw = np.concatenate([h[~often], window_hash]), np.concatenate([raw[~often], single])
                    doc_id, crc, begin = both(doc_id), both(crc), both(begin)
                held.append((h, doc_id, crc, begin, raw))
        if not held:
            return _MARK_SCHEMA.empty_table()
        h, doc, crc, begin, raw = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        distinct, number = _distinct(raw)
        least = np.full(len(distinct), NONE)
        np.minimum.at(least, number, doc)
        here = doc > least[number]
        out = []
        if here.any():
            inside = (np.arange(WIDTH) >= raw[here, REGION][:, None]) & (np.arange(WIDTH) <= raw[here, REGION + 1][:, None])
            mask = (inside * _BITS).sum(axis=1, dtype=U64)
            bucket = -1 - doc[here] % n_buckets  # dealt by document, so that no task gets them all
            n = len(mask)
            out.append(pa.table([pa.array(bucket), pa.nulls(n, pa.binary()), pa.array(np.full(n, part, np.int32)), *map(pa.array, (doc[here], crc[here], begin[here], mask.view(np.int64)))], schema=_MARK_SCHEMA))
        first = ~here
        bucket = _bucket_of(h[first], n_buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, d, x, a, r = bucket[order], doc[first][order], crc[first][order], begin[first][order], number[first][order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        blob = []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            mine, local = np.unique(r[lo:hi], return_inverse=True)
            cols = np.empty(hi - lo, _COLUMNS)
            cols["doc"], cols["crc"], cols["at"], cols["region"], cols["part"] = d[lo:hi], x[lo:hi], a[lo:hi], local, part
            blob.append(_pack(distinct[mine], cols))
        out.append(pa.table([pa.array(bucket[cuts]), pa.array(blob, pa.binary()), pa.nulls(len(cuts), pa.int32()), *[pa.nulls(len(cuts), pa.int64())] * 4], schema=_MARK_SCHEMA))
        return pa.concat_tables(out)

    def solve(table: pa.Table) -> pa.Table:
        blobs = [b for b in table.column("blob").to_pylist() if b is not None]
        if not blobs:
            return table.select(_NAMES[2:])
        parts = [_unpack(b) for b in blobs]
        raw = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0, *[len(p[0]) for p in parts]])
        rows = np.concatenate([p[1] for p in parts])
        number = np.concatenate([p[1]["region"] + s for p, s in zip(parts, shift[:-1], strict=True)])
        distinct, same = _distinct(np.frombuffer(raw.tobytes(), np.uint8).reshape(len(raw), REGION + 2))
        number = same[number]
        least = np.full(len(distinct), NONE)
        np.minimum.at(least, number, rows["doc"])
        found = least_documents(distinct, least)
        gone = (found[number] < rows["doc"][:, None]) * _BITS
        mask = gone.sum(axis=1, dtype=U64)
        some = mask != 0
        return pa.table([*(pa.array(np.ascontiguousarray(rows[c][some])) for c in ("part", "doc", "crc", "at")), pa.array(mask[some].view(np.int64))], _NAMES[2:])

    rows = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(spread, "bucket long, blob binary, part int, doc_id long, crc long, at long, mask long")
    return rows.groupBy("bucket").applyInArrow(solve, "part int, doc_id long, crc long, at long, mask long")


_NAMES = ["bucket", "blob", "part", "doc_id", "crc", "at", "mask"]
_MARK_SCHEMA = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("part", pa.int32()), *[(c, pa.int64()) for c in _NAMES[3:]]])


def _distinct(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes, and the number of each row's."""
    flat = np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel()
    codes, first = pd.factorize(np.array(list(map(bytes, flat)), object))
    return np.frombuffer(b"".join(first), f"V{raw.shape[1]}"), codes


def _cut(text: bytes, at: np.ndarray, mask: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what stays)."""
    start = (at[:, None] + np.arange(WIDTH))[(mask[:, None] & _BITS) != 0]
    change = np.zeros(len(text) + 1, np.int32)
    start = np.unique(start)
    np.add.at(change, start, 1)
    np.add.at(change, start + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False, carry: list[str] | None = None, part_bytes: int = PART_BYTES, hot: int = HOT_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per row of ``df``; with ``with_text`` also the rest.

    The rest is returned as text; a cut inside a UTF-8 character leaves bytes
    that are dropped from the text (not from the hash).  Null text is empty.  A
    very long text is hashed in passes of a megabyte and is whole in its part.
    Rows with a null id neither remove nor lose anything.  Rows of equal id
    never remove from each other, and each loses what a smaller id holds: such
    rows are told apart by their text when marks are applied.  An empty table
    gives an empty result.  ``carry`` names further columns to return, other
    columns are left out, whatever their names; a carried column that has the
    name of a result is not returned.
    """
    carry = carry or []
    extra = [f"__c{i}" for i in range(len(carry))]
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, extra, strict=True)])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(8, -(-total // part_bytes))
    texts = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).cast("int"))
    shared = shared_anchors(texts, max(64, -(-total // SLICE_BYTES)))
    marks = window_marks(texts, shared, max(64, -(-total // BUCKET_BYTES)), hot)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def apply(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, crc, at, mask = (found.column(c).to_numpy() for c in ("doc_id", "crc", "at", "mask"))
        order = np.argsort(ids, kind="stable")
        ids, crc, at, mask = ids[order], crc[order], at[order], mask[order].view(U64)
        rows = []
        for d, t in zip(texts.column("doc_id").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True):
            lo, hi = (0, 0) if d is None else (np.searchsorted(ids, d), np.searchsorted(ids, d, "right"))
            mine = slice(lo, hi) if hi == lo else lo + np.flatnonzero(crc[lo:hi] == zlib.crc32(t))
            n, runs, rest = _cut(t, at[mine], mask[mine]) if len(at[mine]) else (0, 0, t)
            rows.append((d, len(t), n, runs, hashlib.sha256(rest).hexdigest()) + (rest.decode("utf-8", "ignore"),) * with_text)
        kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.table([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *texts.select(extra).columns], [*names, *extra])

    rows = texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(apply, with_fields(out, docs, extra))
    return rows.withColumnsRenamed({k: c for k, c in zip(extra, carry, strict=True) if c not in names})
