"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. Every text is cut into pre-tokens; distinct ones are gathered with their
   frequencies, and each is given to the tokenizer library once.
2. Per document, pre-token frequencies are joined to those counts and summed.

The join is split by frequency: the pre-tokens above a frequency that at most
``common`` of them reach travel as a broadcast of that proven size; all others
are rare by construction, so their shuffle join has no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.bpe import CHUNK, Codec, Remembered, codec, vocabulary_path
from quillstat.llm.common import text_of, written

COMMON = 300_000
FLUSH = 200_000
REMEMBER = 100_000


def special_and_chunks(text: str, c: Codec) -> tuple[list[str], list[str]]:
    """(special strings, chunks) of a text; pre-tokens never cross the ends of a chunk."""
    parts = c.sections(text)
    return parts[1::2], [x for part in parts[::2] for x in CHUNK.findall(part)]


def pre_token_counts(text: str, path: str | None = None) -> Counter:
    """Frequencies of the pre-tokens; special strings count as they are."""
    c = codec(path)
    special, chunks = special_and_chunks(text, c)
    return Counter(special) + Counter(p for x in chunks for p in c.pre_tokens(x))


def distinct_pre_tokens(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(piece, freq) over all texts, gathered in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        chunks: Counter = Counter()
        found: Counter = Counter()

        def rows():
            for x, n in chunks.items():  # each chunk is cut once
                for p in c.pre_tokens(x):
                    found[p] += n
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["piece", "freq"])
            found.clear()
            chunks.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                special, own = special_and_chunks(t, c)
                found.update(special)
                chunks.update(own)
                if len(chunks) >= FLUSH:
                    yield rows()
        yield rows()

    return df.select(text_of(text).alias("text")).mapInArrow(run, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def count_pieces(pre_tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Adds n_pieces, by the tokenizers library: once for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(vocabulary_path(path))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n = []
            for i in range(0, len(texts), 2000):
                n += [len(e.ids) for e in t.encode_batch(texts[i : i + 2000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], ["piece", "freq", "n_pieces"])

    return pre_tokens.mapInArrow(run, "piece string, freq long, n_pieces long")


def common_threshold(table: DataFrame, common: int) -> int:
    """The least power of two that at most ``common`` pre-tokens reach in frequency."""
    per = {int(r[0]): r[1] for r in table.groupBy(F.floor(F.log2("freq")).alias("b")).count().collect()}
    total, at = 0, 63
    for b in range(63, -1, -1):
        total += per.get(b, 0)
        if total > common:
            break
        at = b
    return 1 << at


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = 1024, path: str | None = None, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, one row per row of ``df``.

    Null text counts as empty (0 bytes, 0 tokens).  Rows are told apart by a row
    number, so null and repeated ids keep their rows.
    """
    spark = df.sparkSession
    table = written(count_pieces(distinct_pre_tokens(df, text, path), path), "pieces")
    least = common_threshold(table, common)
    top = table.where(F.col("freq") >= least).select("piece", "n_pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, get = codec(path), known.value.get

        def count(chunk: str) -> int | None:
            """Tokens of a chunk all of whose pre-tokens are common."""
            n = [get(p) for p in c.pre_tokens(chunk)]
            return None if None in n else sum(n)

        counts = Remembered(count, REMEMBER)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out: list[list] = [[], [], [], [], [], []]
                for row, doc, t in zip(*(part.column(j).to_pylist() for j in range(3)), strict=True):
                    special, chunks = special_and_chunks(t, c)
                    n_known = [counts[x] for x in chunks]
                    rest = Counter(special)
                    if None in n_known:
                        rest.update(p for x, n in zip(chunks, n_known, strict=True) if n is None for p in c.pre_tokens(x))
                        n_known = [n for n in n_known if n is not None]
                    base = sum(n_known)
                    for piece, n in rest.items():
                        if (k := get(piece)) is not None:
                            base += k * n
                        else:
                            for to, x in zip(out, (row, None, None, n, piece, 0), strict=True):
                                to.append(x)
                    for to, x in zip(out, (row, doc, len(t.encode()), base, str(row), 1), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    names, kinds = ["row", "doc_id", "n_bytes", "n", "piece", "kind"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(
        run, "row long, doc_id long, n_bytes long, n long, piece string, kind int"
    )
    # rows of kind 1 hold what a document has so far; their key is the row's own and meets nothing
    rare = table.where(F.col("freq") < least).select("piece", F.lit(0).alias("kind"), "n_pieces")
    n_tokens = F.sum(F.col("n") * F.when(F.col("kind") == 1, 1).otherwise(F.col("n_pieces")))
    out = rows.join(rare, ["piece", "kind"], "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
