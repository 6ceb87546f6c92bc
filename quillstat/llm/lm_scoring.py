"""Language-model scores by online logistic context mixing.

A text is the byte string of its lower-cased words, each followed by a space,
and a line feed as the end.  Each bit of a byte is predicted by one predictor
per order 1 to 5: the counter of zeros and ones behind a hashed context, which
is the last bytes and the bits of this byte so far.  Their log odds are combined
by weights that a gate selects (the highest order that knows the context and the
bits so far; and the previous byte), learned online by the coding error.  An
adaptive table over the mixed probability refines the result.

A counter that moves by 1/n at its n-th bit ends, in whatever order it meets the
bits, at the ratio of the ones to all.  So counters are summed by a shuffle: they
are a table of distinct six-byte strings, which grows with the corpus, has no
fixed number of slots and clips no count.  The hash of the last three bytes deals
the strings to parts.  A part holds all that orders 3 to 5 need; orders 1 and 2
are tables of at most 2**16 and 2**24 strings (some four million in valid UTF-8)
and are broadcast.  Weights pass over the parts online, in minibatches, and are
averaged over parts; a string's own occurrence is left out of its counters
meanwhile.  Each distinct string is then scored once, in its part, and texts are
joined to those scores: the most frequent ``COMMON_GRAMS`` by broadcast, all
others by shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import U64, binary_lists, mix64, sharded, text_of, written
from quillstat.llm.token_counts import common_threshold

ORDERS = 5
#: Orders up to this one are broadcast; the others are complete inside a part.
LOW_ORDERS = 2
PRIOR, RATE, BATCH = 0.4, 0.3, 8192
INPUTS = ORDERS + 1
GATE_A, GATE_B = (ORDERS + 1) * 256, 256 * 8
LEVELS, PRIOR_MASS = 33, 30.0
#: Words and strings whose figures are broadcast: at most so many, the most frequent; words of at most COMMON_BYTES.
COMMON, COMMON_BYTES, COMMON_GRAMS = 400_000, 64, 2_000_000
PART_GRAMS = 300_000
FLUSH = 300_000
PASS_BYTES = 1 << 20
MUL = U64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[ \t-\r]")
BEFORE = b"\n" * 5


def lines(data: bytes, most: int = PASS_BYTES) -> Iterator[tuple[list[bytes], bytes]]:
    """(tokens, five bytes before and the bytes) of a text in pieces of about so many bytes, cut at white space."""
    data, before, at = data.lower(), BEFORE, 0
    while True:
        cut = _SPACE.search(data, at + most) if len(data) - at > most else None
        t = data[at : cut.start() if cut else len(data)].split()
        line = before + (b" ".join(t) + b" " if t else b"") + (b"" if cut else b"\n")
        if len(line) > 5:
            yield t, line
        if not cut:
            return
        before, at = line[-5:], cut.start()


def six_grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(six-byte strings as integers, number per piece): each byte with the five before it."""
    buf = np.frombuffer(b"".join(pieces), np.uint8).astype(U64)
    key = np.zeros(len(buf), U64)
    for k in range(6):
        key[k:] |= buf[: len(buf) - k] << U64(8 * k)
    n = np.array([len(x) - 5 for x in pieces])
    keep = np.ones(len(buf), bool)
    first = np.cumsum(n + 5) - n - 5
    keep[(first[:, None] + np.arange(5)).ravel()] = False
    return key[keep], n


def hashed(key: np.ndarray, order: int) -> np.ndarray:
    """A 55-bit hash of the ``order`` bytes before the last one, above eight zero bits."""
    context = key >> U64(8) & U64((1 << 8 * order) - 1)
    return mix64(context * MUL + U64(order)) >> U64(9) << U64(8)


@dataclass
class Table:
    """How often each byte follows each hashed context of one order."""

    at: np.ndarray  # hash with the byte, ascending
    upto: np.ndarray  # occurrences of all before

    @staticmethod
    def of(key: np.ndarray, c: np.ndarray, order: int) -> Table:
        at, back = np.unique(hashed(key, order) | key & U64(0xFF), return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, back, c)
        return Table(at, np.r_[0, np.cumsum(total)])

    def before(self, v: np.ndarray) -> np.ndarray:
        return self.upto[np.searchsorted(self.at, v)]


def bit_counts(key: np.ndarray, tables: list[Table]) -> Iterator[np.ndarray]:
    """For each bit of the last byte: (strings x orders x 2) counts of zeros and ones behind the context and the bits before."""
    base = [hashed(key, o + 1) for o in range(ORDERS)]
    low = [t.before(b) for t, b in zip(tables, base, strict=True)]
    high = [t.before(b + U64(256)) for t, b in zip(tables, base, strict=True)]
    last = key & U64(0xFF)
    for bit in range(8):
        half = (last >> U64(8 - bit) << U64(8 - bit)) + U64(1 << 7 - bit)
        one = (last >> U64(7 - bit) & U64(1)).astype(bool)
        n = np.empty((len(key), ORDERS, 2), np.int64)
        for o, t in enumerate(tables):
            m = t.before(base[o] + half)
            n[:, o, 0], n[:, o, 1] = m - low[o], high[o] - m
            low[o], high[o] = np.where(one, m, low[o]), np.where(one, high[o], m)
        yield n


@dataclass
class Mixer:
    a: np.ndarray  # GATE_A x INPUTS
    b: np.ndarray  # GATE_B x INPUTS
    refine: np.ndarray  # 256 x LEVELS x 2

    @staticmethod
    def start() -> Mixer:
        a = np.zeros((GATE_A, INPUTS), np.float32)
        a[:, :ORDERS] = 0.3
        return Mixer(a, np.zeros((GATE_B, INPUTS), np.float32), np.zeros((256, LEVELS, 2), np.float32))

    @staticmethod
    def inputs(key: np.ndarray, bit: int, n: np.ndarray, leave_out: bool = False):
        """(inputs, gate a, gate b, bits so far, the bit)."""
        y = (key >> U64(7 - bit) & U64(1)).astype(np.int64)
        if leave_out:
            n = n.copy()
            n[np.arange(len(key)), :, y] = np.maximum(n[np.arange(len(key)), :, y] - 1, 0)
        x = np.empty((len(key), INPUTS), np.float32)
        odds = np.log(n.astype(np.float32) + np.float32(PRIOR))
        x[:, :ORDERS] = odds[:, :, 1] - odds[:, :, 0]
        x[:, ORDERS] = 0.3
        highest = ((n.sum(axis=2) > 0) * np.arange(1, ORDERS + 1)).max(axis=1)
        so_far = ((key & U64(0xFF) | U64(0x100)) >> U64(8 - bit)).astype(np.int64)
        return x, highest * 256 + so_far, (key >> U64(8) & U64(0xFF)).astype(np.int64) * 8 + bit, so_far, y

    def mixed(self, x, ga, gb) -> np.ndarray:
        odds = np.einsum("ij,ij->i", x, self.a[ga] + self.b[gb])
        return 1 / (1 + np.exp(-np.clip(odds, -12, 12)))

    @staticmethod
    def level(p: np.ndarray) -> np.ndarray:
        return np.clip(np.round((np.log(p / (1 - p)) + 12) / 24 * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int64)

    def refined(self, p, so_far) -> np.ndarray:
        n = self.refine[so_far, self.level(p)]
        out = (n[:, 1] + PRIOR_MASS * p) / (n.sum(axis=1) + PRIOR_MASS)
        return np.clip((p + out) / 2, 1e-6, 1 - 1e-6)

    def log10(self, key: np.ndarray, tables: list[Table]) -> np.ndarray:
        """log10 of the probability of the last byte of each string, given the five before it."""
        out = np.zeros(len(key))
        for bit, n in enumerate(bit_counts(key, tables)):
            x, ga, gb, so_far, y = self.inputs(key, bit, n)
            p = self.refined(self.mixed(x, ga, gb), so_far)
            out += np.log10(np.where(y == 1, p, 1 - p))
        return out


def _summed(grams: list) -> tuple[np.ndarray, ...]:
    """Distinct strings of several (strings, training occurrences, all occurrences), summed."""
    key, c, n = (np.concatenate(x) for x in zip(*grams, strict=True))
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.add.reduceat(c[order], at), np.add.reduceat(n[order], at)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts and six-byte strings of all texts with their frequencies, summed in the task."""
    words: Counter = Counter()
    grams: list = []
    n_grams, size, lists = 0, 0, {True: [], False: []}

    def gram_rows(key, c, n):
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.binary()), pa.array(key.view(np.int64)), pa.array(c, pa.int64()), pa.array(n, pa.int64())], _GATHERED)

    def word_rows():
        c = pa.array(words.values(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), c, c], _GATHERED)
        words.clear()
        return out

    def count():
        nonlocal size, n_grams
        for held, pieces in lists.items():
            if pieces:
                key = np.sort(six_grams(pieces)[0])
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                n = np.diff(np.r_[at, len(key)])
                grams.append((key[at], n * (not held), n))
                n_grams += len(at)
                pieces.clear()
        size = 0

    for batch in batches:
        for data, held in zip(binary_lists(batch, "text"), batch.column(1).to_pylist(), strict=True):
            for t, line in lines(data):
                if not held:
                    words.update(t)
                lists[held].append(line)
                size += len(line)
                if size >= PASS_BYTES:
                    count()
                    if n_grams > 3_000_000:
                        grams[:] = [_summed(grams)]
                        n_grams = len(grams[0][0])
                        if n_grams > 1_500_000:
                            yield gram_rows(*grams.pop())
                            n_grams = 0
                if len(words) >= FLUSH:
                    yield word_rows()
    count()
    if grams:
        yield gram_rows(*_summed(grams))
    if words:
        yield word_rows()


_GATHERED = ["word", "gram", "c", "n"]


def _part(batches: Iterator[pa.RecordBatch], low: list[Table]):
    """(strings, training occurrences, all occurrences, tables) of a part, strings in an order that is a function of themselves."""
    parts = [[b.column(0).to_numpy().view(U64), *(b.column(i).to_numpy() for i in (1, 2))] for b in batches if b.num_rows]
    if not parts:
        return None
    key, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(mix64(key))
    key, c, n = key[order], c[order], n[order]
    known = c > 0
    return key, c, n, [*low, *(Table.of(key[known], c[known], o) for o in range(LOW_ORDERS + 1, ORDERS + 1))]


def _learn(batches: Iterator[pa.RecordBatch], low: list[Table]) -> Iterator[pa.RecordBatch]:
    """Weights after one online pass over a part, each with the weight of what taught it."""
    part = _part(batches, low)
    if part is None:
        return
    key, c, _, tables = part
    key, c = key[c > 0], c[c > 0]
    m = Mixer.start()
    taught = {"a": np.zeros(GATE_A), "b": np.zeros(GATE_B)}
    for i in range(0, len(key), BATCH):
        k, w = key[i : i + BATCH], c[i : i + BATCH].astype(float)
        for bit, counts in enumerate(bit_counts(k, tables)):
            x, ga, gb, _, y = m.inputs(k, bit, counts, leave_out=True)
            err = (y - m.mixed(x, ga, gb)) * w
            for name, gate, size in (("a", ga, GATE_A), ("b", gb, GATE_B)):
                n = np.bincount(gate, weights=w, minlength=size)
                taught[name] += n
                seen = n > 0
                table = getattr(m, name)
                for j in range(INPUTS):
                    step = np.bincount(gate, weights=err * x[:, j], minlength=size)
                    table[seen, j] += RATE * step[seen] / n[seen]
    for name, table in (("a", m.a), ("b", m.b)):
        gate = np.arange(table.size) // INPUTS
        n = taught[name][gate]
        some = n > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * int(some.sum())), pa.array(np.arange(table.size)[some]), pa.array((table.ravel() * n)[some]), pa.array(n[some])], ["mixer", "at", "total", "n"]
        )


def _refine(batches: Iterator[pa.RecordBatch], low: list[Table], model: Mixer) -> Iterator[pa.RecordBatch]:
    part = _part(batches, low)
    if part is None:
        return
    key, c, _, tables = part
    key, c = key[c > 0], c[c > 0]
    out = np.zeros(256 * LEVELS * 2)
    for i in range(0, len(key), BATCH * 4):
        k, w = key[i : i + BATCH * 4], c[i : i + BATCH * 4].astype(float)
        for bit, counts in enumerate(bit_counts(k, tables)):
            x, ga, gb, so_far, y = model.inputs(k, bit, counts, leave_out=True)
            at = (so_far * LEVELS + model.level(model.mixed(x, ga, gb))) * 2 + y
            out += np.bincount(at, weights=w, minlength=len(out))
    some = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["at", "n"])


def _score(batches: Iterator[pa.RecordBatch], low: list[Table], model: Mixer) -> Iterator[pa.RecordBatch]:
    part = _part(batches, low)
    if part is None:
        return
    key, _, n, tables = part
    for i in range(0, len(key), BATCH * 4):
        k = key[i : i + BATCH * 4]
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n[i : i + BATCH * 4]), pa.array(model.log10(k, tables).astype(np.float32))], ["gram", "n", "score"])


def low_tables(grams: DataFrame) -> list[Table]:
    """The tables of the broadcast orders: at most 2**16 and 2**24 strings, however large the corpus is."""
    out = []
    for order in range(1, LOW_ORDERS + 1):
        short = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        t = grams.where("c > 0").groupBy(short.alias("gram")).agg(F.sum("c").alias("c")).toArrow()
        out.append(Table.of(t.column("gram").to_numpy().view(U64), t.column("c").to_numpy(), order))
    return out


def score_grams(grams: DataFrame, rows: int) -> DataFrame:
    """(gram, n, score) from (gram, c, n): training and all occurrences; ``rows`` is the number of strings.

    Without any training occurrence every bit has one half.
    """
    sc = grams.sparkSession.sparkContext
    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 24) - 1)).alias("context")
    parts = sharded(grams.select("gram", "c", "n", context), "context", PART_GRAMS, rows).select("gram", "c", "n")
    low = sc.broadcast(low_tables(grams))
    learned = (
        parts.mapInArrow(lambda it: _learn(it, low.value), "mixer string, at long, total double, n double")
        .groupBy("mixer", "at").agg((F.sum("total") / F.sum("n")).alias("w")).toArrow()
    )
    model = Mixer.start()
    for name, at, w in zip(*(learned.column(i).to_pylist() for i in range(3)), strict=True):
        getattr(model, name).flat[at] = w
    weights = sc.broadcast(model)
    refined = parts.mapInArrow(lambda it: _refine(it, low.value, weights.value), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    for at, n in zip(refined.column(0).to_pylist(), refined.column(1).to_pylist(), strict=True):
        model.refine.flat[at] = n
    final = sc.broadcast(model)
    return parts.mapInArrow(lambda it: _score(it, low.value, final.value), "gram long, n long, score float")


class Known:
    """Scores of the most frequent strings: a direct-mapped table, and a sorted one for those that lost their place in it."""

    BITS = 22
    WIDE = U64((1 << 48) - 1)

    def __init__(self, key: np.ndarray, n: np.ndarray, score: np.ndarray):
        order = np.argsort(n, kind="stable")  # of strings with one place the most frequent is written last
        key, score = key[order], score[order]
        place, tag = self.place(key)
        self.tags = np.zeros(1 << self.BITS, np.uint32)
        self.scores = np.full(1 << self.BITS, np.nan, np.float32)
        self.tags[place], self.scores[place] = tag, score
        lost = np.flatnonzero(self.tags[place] != tag)
        lost = lost[np.argsort(key[lost])]
        self.other, self.other_scores = key[lost], score[lost]

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An odd factor permutes the 48-bit numbers: the high bits are the place, the low ones tell the strings of a place apart."""
        x = key * MUL & self.WIDE
        return (x >> U64(48 - self.BITS)).astype(np.int64), (x & U64((1 << 48 - self.BITS) - 1)).astype(np.uint32)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Scores, NaN for strings that aren't known."""
        place, tag = self.place(key)
        out = np.where(self.tags[place] == tag, self.scores[place], np.float32(np.nan)).astype(float)
        miss = np.flatnonzero(np.isnan(out))
        if len(miss) and len(self.other):
            at = np.minimum(np.searchsorted(self.other, key[miss]), len(self.other) - 1)
            hit = self.other[at] == key[miss]
            out[miss[hit]] = self.other_scores[at[hit]]
        return out


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text leaves 1 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def lm_scores(df: DataFrame, id_col: str = "doc_id", text: str = "text", common: int = COMMON, common_grams: int = COMMON_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, one row per row of ``df``.

    Learns from rows that are not held out; scores all.  Null and empty texts are
    the end token alone.  Very long texts go through in pieces of a megabyte, cut
    at white space, and give one row.  base_score is the unigram score of the
    tokens; score is the model's log10 probability of the byte string of the same
    tokens.  Without training rows every count is zero; an empty table gives an
    empty result.  Rows are told apart by a row number, so null and repeated ids
    keep their rows.  Other columns of ``df``, whatever their names, are left out.
    """
    spark = df.sparkSession
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text).alias("text"))
    gathered = docs.select("text", "held_out").mapInArrow(_gather, "word binary, gram long, c long, n long")
    counted = written(gathered.groupBy("word", "gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "counted")
    ends = docs.where("NOT held_out").count()
    words = counted.where("word IS NOT NULL").select("word", "c")
    totals = counted.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("c"))), F.count("word"), F.count("gram")).first()
    n_train, distinct = (totals[0] or 0) + ends, totals[1] + (1 if ends else 0)
    grams = written(score_grams(counted.where("gram IS NOT NULL").select("gram", "c", "n"), totals[2]), "scored")

    short = F.octet_length("word") <= COMMON_BYTES
    least = common_threshold(words.where(short).select(F.col("c").alias("freq")), common)
    top = words.where(short & (F.col("c") >= least)).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    least_gram = common_threshold(grams.select(F.col("n").alias("freq")), common_grams)
    often = grams.where(F.col("n") >= least_gram).toArrow()
    scores = spark.sparkContext.broadcast(Known(often.column("gram").to_numpy().view(U64), often.column("n").to_numpy(), often.column("score").to_numpy()))
    del top, often
    below = float(np.log10(n_train + 0.5 * (distinct + 1)))
    unseen = float(np.log10(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, scored = known.value.get, scores.value.get
        logs = {}
        out: list[list] = [[] for _ in _NAMES]

        def add(*row):
            for to, v in zip(out, row, strict=True):
                to.append(v)

        def log(c: int) -> float:
            if c not in logs:
                logs[c] = float(np.log10(c + 0.5))
            return logs[c]

        def flush(pieces: list) -> pa.RecordBatch:
            """Rows of pieces: what each has so far, and what is left to the join."""
            nonlocal out
            key, n = six_grams([p[-1] for p in pieces])
            values = scored(key)
            miss = np.flatnonzero(np.isnan(values))
            if len(miss):
                ends_ = np.cumsum(n)
                for k, i in Counter(zip(np.searchsorted(ends_, miss, "right").tolist(), key[miss].tolist(), strict=True)).items():
                    add(pieces[k[0]][0], None, None, i, None, None, None, str(k[1]).encode(), 2, None)
                values[miss] = 0
            total = np.add.reduceat(values, np.cumsum(n) - n)
            for k, (row, doc, held, t, last, _) in enumerate(pieces):
                seen, base = (int(ends > 0), log(ends)) if last else (0, 0.0)
                for w, c in Counter(t).items():
                    if (x := get(w)) is not None:
                        seen += c
                        base += c * log(x)
                    else:
                        add(row, None, None, c, None, None, None, w, 0, None)
                add(row, doc, held, len(t) + last, seen, base, float(total[k]), str(row).encode(), 1, int(n[k]))
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _KINDS, strict=True)], _NAMES)
            out = [[] for _ in _NAMES]
            return got

        for batch in batches:
            pieces, size = [], 0
            for row, doc, held, data in zip(*(batch.column(i).to_pylist() for i in range(3)), binary_lists(batch, "text"), strict=True):
                for t, line in lines(data):
                    pieces.append((row, doc, held, t, line.endswith(b"\n"), line))
                    size += len(line)
                    if size >= PASS_BYTES:
                        yield flush(pieces)
                        pieces, size = [], 0
            if pieces:
                yield flush(pieces)

    rows = docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, _SCHEMA)
    rare_words = words.where(~short | (F.col("c") < least)).select(F.col("word").alias("key"), F.lit(0).alias("kind"), F.log10(F.col("c") + 0.5).alias("value"))
    rare_grams = grams.where(F.col("n") < least_gram).select(F.col("gram").cast("string").cast("binary").alias("key"), F.lit(2).alias("kind"), F.col("score").cast("double").alias("value"))
    # rows of kind 1 hold what a piece of a text has so far; their key is the row's own and meets nothing
    own, word, found = F.col("kind") == 1, F.col("kind") == 0, F.col("value").isNotNull()
    joined = rows.join(rare_words.union(rare_grams), ["key", "kind"], "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum(F.when(own, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(own, F.col("seen")).otherwise(F.when(word & found, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.when(own, F.col("base")).when(word, F.col("n") * F.coalesce("value", F.lit(unseen))).otherwise(0.0)).alias("base"),
        F.sum(F.when(own, F.col("score")).when(word, 0.0).otherwise(F.col("n") * F.col("value"))).alias("score"),
        F.sum("n_bytes").alias("n_bytes"),
    )
    return joined.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(below)).alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


_SCHEMA = "row long, doc_id long, held_out boolean, n long, seen long, base double, score double, key binary, kind int, n_bytes long"
_NAMES = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.int64()]
