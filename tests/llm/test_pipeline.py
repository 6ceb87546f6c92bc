import random
from collections import Counter

import pytest

import corpus_pipeline
from quillstat.llm.common import tables_made

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rejected_by string, n_bytes long, n_removed int, size string, `taken.words` string, component_id string, part int"


def rows(n=40, seed=1):
    rng = random.Random(seed)
    prose = lambda k: " ".join("".join(rng.choice("aeioustrnlm") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    texts = [prose(rng.randrange(60, 200)) for _ in range(n)]
    texts += [texts[0], texts[1] + " and one more", prose(70) + " " + texts[2][:300] + " " + prose(70), None, "", "too short", "| * " * 400, prose(30_000)]
    out = [(i, t, "en", "abc"[i % 3], len(t or ""), "kept", -1, -2, "s", "t", "c", 7) for i, t in enumerate(texts)]
    out += [out[3], (None, prose(90), None, None, None, None, None, None, None, None, None, None), (900, texts[5], None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS)


def test_each_stage_returns_the_columns_it_got_and_does_its_work(spark, docs):
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        for r in got:  # the other columns are as they were
            before = given[r.doc_id]
            assert [r[c] for c in docs.columns if c not in ("text", "n_chars")] == [before[c] for c in docs.columns if c not in ("text", "n_chars")], name
        ids = Counter(r.doc_id for r in got)
        if name == "quality rules":
            assert set(ids) == set(range(40)) | {40, 41, 42, 47, None, 900} and ids[3] == 2
        elif name == "near duplicates":
            assert ids[0] == ids[1] == ids[3] == ids[5] == 1 and not {40, 41, 900} & set(ids) and {42, 43, 44, 47, None} <= set(ids)
        elif name == "suffix array":
            text = {r.doc_id: r.text for r in got}
            assert 40 not in ids and 900 not in ids and text[0] == given[0].text and given[2].text[:300] not in text[42] and len(text[42]) > 500
            assert all(r.n_chars == len(r.text) for r in got)
        else:
            assert all(r.text == given[r.doc_id].text for r in got) and not {43, 44} & set(ids)
        assert stage(spark, docs.limit(0), "").count() == 0


def test_the_run_is_its_stages_and_leaves_no_working_tables(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline.quality_rules, "plan_cascade", lambda df, rules, *_, **__: list(rules))
    started = tables_made()
    got = sorted(tuple(map(str, r)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
    assert got == sorted(tuple(map(str, r)) for r in step.collect()) and len(got) > 40
    from quillstat.sources import tables

    assert sum(map(bool, tables._made[started : started + 12])) <= 1
