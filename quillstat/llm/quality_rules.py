"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean expression over a few statistics of a text.  A cascade
is one nested CASE: as soon as a rule rejects, later rules are not evaluated.
``plan_cascade`` measures on a bounded sample how long each rule takes and what
share of the rows it rejects, and orders rules by rejection per cost.  The set
of rejected rows does not depend on the order, so reruns agree.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import SPACES, text_of, words

SYMBOLS = "#*$%&|<>"
#: A rule rejects a text for which it is true; it gets the Statistics of the text.
Rule = Callable


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = _lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _windows(ws: Column) -> Column:
    """(hash of a 3-word window, its place), ordered by hash, then place."""
    at = F.when(F.size(ws) >= 3, F.sequence(F.lit(1), F.size(ws) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(
        F.transform(
            at,
            lambda i: F.struct(
                F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)).alias("h"), i.alias("p")
            ),
        )
    )


def _repeated_at(windows: Column) -> Column:
    """Places of the windows that stand next to an equal one, ascending."""
    return F.array_sort(
        F.transform(
            F.filter(
                windows,
                lambda x, i: F.coalesce(F.get(windows, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(windows, i + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["p"],
        )
    )


def _covered(places: Column) -> Column:
    """Words under 3-word windows that begin at these ascending places."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_repeat_words(text: Column) -> Column:
    return _let(words(text), lambda w: _let(_windows(w), lambda g: _covered(_repeated_at(g))))


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Null text counts as empty and gives zeros.  Lines without a word are not
    counted.  Windows are compared by 64-bit hashes of three words within one
    text; a very long text is sorted whole in its row.  An empty table stays
    empty.  Columns of ``df`` keep their names; the six are replaced if present.
    """
    t = text_of(text)
    step = df.withColumns({"__w": words(t), "__l": _lines(t)}).withColumn("__g", _windows(F.col("__w")))
    step = step.withColumn("__p", _repeated_at(F.col("__g")))
    lines = F.size("__l").cast("long")
    return step.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": word_chars(t),
            "n_symbols": n_symbols(t),
            "n_lines": lines,
            "n_dup_lines": lines - F.size(F.array_distinct("__l")),
            "n_repeat_words": _covered(F.col("__p")),
        }
    ).drop("__w", "__l", "__g", "__p")


#: The columns of text_statistics, for rules to read where they are there already.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


class Statistics:
    """Statistics of one text as columns; those already computed are taken from ``known``."""

    def __init__(self, text: Column, known: dict[str, Column] | None = None):
        self.text, self.known = text, known or {}

    def __getattr__(self, name: str) -> Column:
        return self.known[name] if name in self.known else MEASURES[name](self.text)


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long")


MEASURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_letters": n_letters}

BASE_RULES: dict[str, Rule] = {
    "few_words": lambda s: s.n_words < 50,
    "repeated_windows": lambda s: 100 * s.n_repeat_words > 50 * s.n_words,
}
METHOD_RULES: dict[str, Rule] = {
    "symbols": lambda s: 100 * s.n_symbols > 25 * s.word_chars,
    "long_words": lambda s: s.word_chars > 40 * s.n_words,
    "short_words": lambda s: 10 * s.word_chars < 15 * s.n_words,
    "repeated_lines": lambda s: (100 * s.n_dup_lines > 60 * s.n_lines) & (s.n_lines >= 4),
    "few_letters": lambda s: 100 * s.n_letters < 30 * s.word_chars,
}
#: The base rules over columns of text_statistics, where those are already there.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def plan_cascade(df: DataFrame, rules: dict[str, Rule], text: str = "text", sample_rows: int = 2000, have_statistics: bool = False) -> list[str]:
    """Rule names by rejection per second, best first.

    Measured on at most ``sample_rows`` rows drawn at random.  A rule costs what
    it adds to a pass over the sample (the better of two passes each); with
    ``have_statistics`` the columns of text_statistics are there beforehand, so
    only what remains is timed.  One hit in one more row is added to every rule,
    so that rules without a hit are ordered by their cost.  Only the order of
    evaluation depends on all this, never a verdict.
    """
    # a share that few times the wanted rows pass, so that no task gets more than those
    share = 3 * sample_rows / max(1, df.count())
    sample = df.select(text_of(text).alias("t")).where(F.rand(11) < share).limit(sample_rows)
    known = {}
    if have_statistics:
        sample, known = text_statistics(sample, "t"), {c: F.col(c) for c in STATISTICS}
    sample = sample.cache()
    try:
        rows = sample.count()
        s = Statistics(F.col("t"), known)

        def measured(rule: Column) -> tuple[int, float]:
            took = []
            for _ in range(2):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(rule)).first()[0]
                took.append(time.perf_counter() - began)
            return hits, min(took)

        idle = measured(F.length("t") < 0)[1]
        found = {name: measured(rule(s)) for name, rule in rules.items()}
    finally:
        sample.unpersist()
    gain = {name: (hits + 1) / (rows + 1) / max(1e-4, took - idle) for name, (hits, took) in found.items()}
    return sorted(rules, key=lambda r: (-gain[r], r))


def cascade(order: list[str], rules: dict[str, Rule], text: Column, known: dict[str, Column] | None = None) -> Column:
    """Name of the first rule that rejects, else null; later rules aren't evaluated.

    The number of words and of their characters, which most rules need, is
    computed once per text if it is not ``known``.
    """

    def chain(words_: Column, chars: Column) -> Column:
        s = Statistics(text, (known or {}) | {"n_words": words_, "word_chars": chars})
        out = F.lit(None).cast("string")
        for name in reversed(order):
            out = F.when(F.coalesce(rules[name](s), F.lit(False)), F.lit(name)).otherwise(out)
        return out

    s = Statistics(text, known)
    if known and {"n_words", "word_chars"} <= set(known):
        return chain(s.n_words, s.word_chars)
    return _let(F.struct(s.n_words.alias("w"), s.word_chars.alias("c")), lambda v: chain(v["w"], v["c"]))


def rejection(df: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None, sample_rows: int = 2000) -> Column:
    """The name of a rule that rejects a row of ``df``, null for rows to keep."""
    rules = rules or BASE_RULES | METHOD_RULES
    return cascade(plan_cascade(df, rules, text, sample_rows), rules, text_of(text))


def quality_filter(df: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Adds ``rejected_by``: the rule that rejects a row, null for rows to keep.

    Null and empty texts fail ``few_words``.  A very long text is judged whole.
    An empty table stays empty; repeated rows are judged alike.  Other columns
    stay; a column of that name is replaced.  Which of several rejecting rules is
    named depends on the measured order; whether a row is rejected does not.
    """
    return df.withColumn("rejected_by", rejection(df, text, rules, sample_rows))
