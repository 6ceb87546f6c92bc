import random

from quillstat.llm import bpe


def test_a_pre_token_is_merged_once_whatever_stands_behind_it(monkeypatch):
    c, seen = bpe.Codec(None), []
    real = c.merge
    monkeypatch.setattr(c, "merge", lambda data: seen.append(data) or real(data))
    c.digest("a thlyouble, thlyouble. thlyouble! thlyouble; thlyouble")
    assert seen.count(b" thlyouble") == 1


def test_merges_are_those_of_the_lowest_rank_first():
    c, rng = bpe.Codec(None), random.Random(3)
    rank = lambda ids, i: c.ranks.get(ids[i] << 32 | ids[i + 1])
    for _ in range(400):
        data = "".join(rng.choice(["a", "l", "th", "e", "ing", "ß", "o", "oo", "1", "中"]) for _ in range(rng.randrange(14))).encode()
        ids = [c.of_byte[b] for b in data]
        while found := min(((rank(ids, i), i) for i in range(len(ids) - 1) if rank(ids, i) is not None), default=None):
            i = found[1]
            ids[i : i + 2] = [c.made[found[0] >> 32]]
        assert c.merge(data) == ids
