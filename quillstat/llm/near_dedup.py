"""Near-duplicate detection: one-permutation MinHash, banded buckets, star-shaped candidates.

A text is the set of its distinct shingles.  One hash per shingle places it in
one of BINS bins; the least hash of each bin is the signature.  Empty bins are
filled by optimal densification: each bin walks the others in an order of its
own and takes the first that is not empty, which keeps bins independent.  Bands
of ROWS bins are bucket keys: two texts of similarity 0.75 share none of the
BANDS keys with probability (1 - 0.75**6)**64 = 4e-6.

Within a bucket only star edges are candidates: the least node with every other
one.  Candidates are confirmed on full sets.  Buckets that still hold several
components afterwards are completed: small ones by their remaining pairs (a
bounded number), large ones by comparing blocks of texts, which gives a link
only where it joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import U64, binary_lists, mix64, text_of, with_fields, written
from quillstat.llm.graph import components, merged

WORDS, PERCENT = 5, 75
BINS, ROWS, BANDS = 384, 6, 64
MUL = U64(0x9E3779B97F4A7C15)
SMALL_BUCKET = 16
BLOCK = 1000


class _WordHash(dict):
    """64-bit hashes of words; forgets all when it holds a hundred thousand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _word_hash() -> _WordHash:
    return _WordHash()


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text; empty without a word."""
    tokens = data.lower().split()
    if not tokens:
        return np.empty(0, U64)
    of = _word_hash()
    h = np.fromiter([of[w] for w in tokens], U64, len(tokens))
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, U64)
    for j in range(n):
        s = s * MUL + h[j : len(h) - n + 1 + j]
    return np.unique(mix64(s))


@lru_cache(maxsize=1)
def _walks() -> np.ndarray:
    """For each bin, the place of every bin in its walk."""
    rng = np.random.default_rng(20240501)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.uint16)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS values: the least hash of each bin, empty bins filled from their walk."""
    bins = ((shingles >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    source = np.empty(BINS, np.int64)
    source[full] = np.arange(len(full))
    if len(full) < BINS:
        empty = np.ones(BINS, bool)
        empty[full] = False
        source[empty] = _walks()[np.ix_(empty, full)].argmin(axis=1)
    return shingles[first][source]


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(ROWS):
        h = mix64(h * MUL + rows[:, j])
    return h.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        n, keys, bands = [], [], []
        for data in binary_lists(batch, "text"):
            s = shingle_set(data)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            bands.append(band_keys(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *batch.columns[2:]], ["doc_id", "n", "key", "bands", *batch.schema.names[2:]]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        sets = [shingle_set(x) for x in binary_lists(part, "text")]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yes = []
        for i in range(0, batch.num_rows, 500):
            x, y = (batch.column(j).slice(i, 500).to_pylist() for j in (2, 3))
            yes += [linked(np.frombuffer(p, U64), np.frombuffer(q, U64)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(yes, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are linked."""
    joined = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return written(joined.mapInArrow(_confirm, "a long, b long"), "confirmed")


def _tile(table: pa.Table) -> pa.Table:
    """Links between texts of different components in one pair of blocks; one that joins two of them is enough."""
    node = table.column("node").to_numpy()
    sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    _, root = np.unique(table.column("component").to_numpy(), return_inverse=True)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(ids, kind="stable")
    owners, ends = owner[order], np.cumsum(np.bincount(ids))
    starts = np.r_[0, ends[:-1]]
    at = np.r_[0, np.cumsum(size)]
    out = []
    for i in range(len(sets)):
        mine = ids[at[i] : at[i + 1]]
        common = np.bincount(np.concatenate([owners[a:b] for a, b in zip(starts[mine], ends[mine], strict=True)]), minlength=len(sets))
        yes = (100 * common >= PERCENT * (size + size[i] - common)) & (root != root[i])
        for j in np.flatnonzero(yes):
            if root[j] != root[i]:
                out.append((node[i], node[j]))
                root[root == root[j]] = root[i]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _complete_large(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that stars missed in large buckets, found block against block."""
    clusters = components(members.select(F.col("center").alias("a"), F.col("node").alias("b"))).select("node", F.col("component").alias("cluster"))
    nodes = members.select("node", "comp").distinct().join(clusters, "node")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    nodes = nodes.join(blocks, "cluster").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    tiles = nodes.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "cluster", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", F.col("comp").alias("component")
    )
    return written(tiles.join(sets, "node").groupBy("cluster", "i", "j").applyInArrow(_tile, "a long, b long"), "completed")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and representative, one row per row of ``df``.

    Words are lower-cased in A-Z and cut at ASCII white space.  Fewer than five
    words make one shingle of all of them; null and empty texts have no shingle,
    link with nothing and are kept.  component_id is the least doc_id of a row's
    component; kept says that it is the row's own, so of repeated rows all with
    that id are kept.  Null ids count for no minimum; a component of null ids
    only has a null component_id and its rows are kept.  ``representative`` is
    true for exactly one row of a component.  ``carry`` names columns of ``df``
    to return as well, as carried_NAME.
    """
    carry = carry or []
    kept_as = [f"__c{i}" for i in range(len(carry))]
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, kept_as, strict=True)])
    # what a row is found by again: its id, or without one its text
    docs = docs.withColumn("__pick", F.coalesce("doc_id", F.xxhash64("text"))).select("doc_id", "text", "__pick", *kept_as)
    schema = with_fields("doc_id long, n long, key binary, bands array<long>", docs, ["__pick", *kept_as])
    sig = written(docs.mapInArrow(_signatures, schema).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # equal sets are one node; its best row is that of the least id
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keyed = sig.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min(best).alias("best"), F.min("__pick").alias("low"))
    nodes = written(keyed, "nodes")
    rows = sig.select(F.col("row").alias("node"), "n", "bands").join(nodes.select("node"), "node").select("node", "n", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("least")).where("size > 1")
    members = written(rows.join(buckets, "band").select("band", "node", "n", "size", F.col("least.node").alias("center"), F.col("least.n").alias("center_n")), "members")
    near = (F.col("node") != F.col("center")) & (100 * F.least("n", "center_n") >= PERCENT * F.greatest("n", "center_n"))

    # full sets of the nodes in any shared bucket, found again by their least document
    wanted = members.select("node").distinct().join(nodes, "node")
    texts = docs.join(wanted.select("low").distinct(), F.col("__pick") == F.col("low"), "left_semi").select("text")
    found = texts.mapInArrow(_sets, "key binary, shingles binary").dropDuplicates(["key"])
    sets = written(found.join(wanted.select("key", "node"), "key").select("node", "shingles"), "sets")

    def with_components(comp: DataFrame) -> DataFrame:
        of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp"))
        m = members.join(of("node"), "node", "left").join(of("center"), "center", "left")
        return m.withColumns({"comp": F.coalesce("node_comp", "node"), "center_comp": F.coalesce("center_comp", "center")})

    # the star edge to the least center first, then those that still join two components
    first = members.where(near).groupBy("node").agg(F.min("center").alias("center"))
    comp = merged(None, confirmed(first.select(F.col("center").alias("a"), F.col("node").alias("b")), sets))
    more = with_components(comp).where(near & (F.col("comp") != F.col("center_comp"))).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    more = more.join(first.select(F.col("center").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_anti")
    comp = merged(comp, confirmed(more, sets))

    # what stars can't see: pairs of leaves whose components are still apart
    m = with_components(comp).select("band", "node", "n", "size", "center", "comp")
    split = m.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    rest = written(m.join(split, "band"), "rest")
    small = rest.where((F.col("size") <= SMALL_BUCKET) & (F.col("node") != F.col("center")))
    few = small.groupBy("band").agg(F.collect_list(F.struct("node", "n", "comp")).alias("l"))
    pairs = few.select(F.explode("l").alias("p"), "l").select("p", F.explode("l").alias("q")).where(
        "p.node < q.node AND p.comp <> q.comp AND 100 * least(p.n, q.n) >= 75 * greatest(p.n, q.n)"
    )
    links = confirmed(pairs.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), sets)
    large = rest.where(F.col("size") > SMALL_BUCKET)
    if not large.isEmpty():
        links = links.union(_complete_large(large, sets))

    final = merged(comp, links).join(nodes.select("node", "best"), "node")
    bests = final.groupBy("component").agg(F.min("best").alias("least"))
    per_node = nodes.join(final.select("node", "component"), "node", "left").join(bests, "component", "left")
    per_key = per_node.select("key", F.coalesce("least", "best").alias("least"))
    out = sig.drop("bands", "__pick").join(per_key, "key", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        ((F.col("n") == 0) | (F.col("row") == F.col("least.row"))).alias("representative"),
        *[F.col(k).alias(f"carried_{c}") for c, k in zip(carry, kept_as, strict=True)],
    )
