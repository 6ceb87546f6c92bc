import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstat.llm import bpe, media, token_counts

TEXTS = [None, "", " ", "  two  spaces\n\n\n tail ", "it's we'll I'd 123,456 <|endoftext|> x<|endoftext|>", "\u00a0nbsp \u3000wide\u2003em\x1cfs\x85", "añb é ü 漢字かな 🙂🙃", "a" * 30_000, "\t\r\n \x0b\x0c", "<|endoftext", "ſ'S K'LL"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcAB 12'sтé漢\n\t \u00a0\u2003.,!?<|>endoftxt🙂\x1c\x85")), max_size=60))
def test_codec_is_the_library(text):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json")) if not hasattr(test_codec_is_the_library, "lib") else test_codec_is_the_library.lib
    test_codec_is_the_library.lib = lib
    c = bpe.codec(None)
    ids = lib.encode(text, add_special_tokens=False).ids
    assert c.encode(text) == ids
    assert c.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_bpe_rows(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2), (3, TEXTS[3], 3)], "doc_id long, text string, n_tokens int")
    want = sorted((t or "", hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for _, t, _ in df.collect())
    got = bpe.bpe_digests(df).collect()
    assert sorted(r.ids_sha256 for r in got) == sorted(w for _, w in want) and len(got) == len(TEXTS) + 2
    for r in got:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    enc = bpe.encode_documents(df)
    back = {r.doc_id: r.text for r in bpe.decode_documents(enc).where("doc_id IS NOT NULL").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.bpe_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("common", [300_000, 3])
def test_token_counts(spark, library, common):
    texts = TEXTS + ["common words " * 5, "common rare" + "x" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "common"), (4, texts[4])], "doc_id long, text string").selectExpr("*", "'c' AS n_tokens", "1 AS piece", "2 AS row", "3 AS freq")
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, common=common).collect())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), n(r.text), n(r.text) > 1024) for r in df.collect())
    assert got == want
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_media_round_trip(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(0, None, "c")], "doc_id long, text string, feature string")
    out = media.media_columns(df).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        data = (TEXTS[r.doc_id] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert media.from_wav(bytes(r.media)) == payload and r.payload_bytes == len(payload) and r.n_bytes == len(data)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        assert len(r.pair_codes) == len(r.pair_times) and r.feature.startswith(f"{len(r.pair_codes)}:")
    assert len({r.feature for r in out if not TEXTS[r.doc_id]}) == 1
    assert media.media_columns(df.limit(0)).count() == 0


def brute_pairs(payload):
    """Pairs by a plain transform of each frame."""
    hop, size, ahead = media.HOP, media.FRAME, media.AHEAD
    n = -(-len(payload) // hop) + 1
    x = np.full((n + ahead - 1) * hop + size, 128.0)
    x[hop : hop + len(payload)] = list(payload)
    wave = np.exp(-2j * np.pi * np.outer(np.arange(size), np.arange(size // 2 + 1)) / size)
    peaks = []
    for i in range(n + ahead):
        power = np.abs(((x[i * hop : i * hop + size] - 128) * np.hanning(size)) @ wave) ** 2
        peaks.append([a + int(power[a:b].argmax()) for a, b in media.BANDS])
    return sorted((t, peaks[t][k] << 10 | peaks[t + dt][(k + 1) % len(peaks[t])] << 2 | dt) for t in range(n) for dt in range(1, ahead + 1) for k in range(len(media.BANDS)))


@pytest.mark.parametrize("size", [64, 320, 448, 5056])
def test_fingerprint_reads_every_sample(size):
    rng = np.random.default_rng(size)
    payload = rng.integers(32, 127, size).astype(np.uint8).tobytes()
    codes, times = media.fingerprint(payload)
    n = -(-size // media.HOP) + 1
    loud = [p for p in brute_pairs(payload) if p[0] + media.AHEAD < n - 1]  # frames of silence are ties
    assert loud == sorted(p for p in zip(times.tolist(), (codes & (1 << 18) - 1).tolist(), strict=True) if p[0] + media.AHEAD < n - 1)
    for i in range(0, size, 8 if size < 1000 else 104):
        changed = [np.array_equal(codes, media.fingerprint(payload[:i] + bytes(rng.integers(0, 256, 8).astype(np.uint8)) + payload[i + 8 :])[0]) for _ in range(40)]
        assert not all(changed), i


def test_short_texts_have_distinct_fingerprints():
    texts = [b"", b"hello", b"x" * 320, b"x" * 300, b"y" * 320, b"hello world", b"ab" * 30, b"The quick brown fox jumps over the lazy dog", *(bytes(np.random.default_rng(i).integers(97, 122, 20 + i).astype(np.uint8)) for i in range(200))]
    assert len({media.feature_string(*media.fingerprint(media.padded(t))) for t in texts}) == len(texts)


def test_fingerprint_finds_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / media.RATE)).astype(np.uint8).tobytes()
    codes, times = media.fingerprint(tone)
    assert (codes >> 10 & 255 == 32).any() and (np.diff(times) >= 0).all()  # 1000 Hz is bin 32 of 256 at 8000 Hz


def test_memo_is_bounded():
    made = []
    memo = bpe.Remembered(lambda k: made.append(k) or k * 2, most=10)
    assert [memo[i] for i in range(50)] == [2 * i for i in range(50)] and len(memo) <= 10 and len(memo.old) <= 10
