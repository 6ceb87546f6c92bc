import hashlib
import random
import re

from pyspark.sql import functions as F

from quillstat.llm import chat_format, mixing, quality_rules, url_filter

TEXTS = [None, "", " \t\n", "one", "a b c a b c", "x\nx\n\n y\nx", "é ü " * 30, "| " * 80 + "word", "same line\n" * 40, "w%d " * 3 + " ".join(f"v{i}" for i in range(20_000))]


def brute_statistics(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    cover = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_text_statistics(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "clash"), (None, "null id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality_rules.text_statistics(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.text)
    again = df.select("text", quality_rules.n_repeat_words(F.coalesce("text", F.lit(""))).alias("n")).collect()
    assert [r.n for r in again] == [brute_statistics(r.text)[4] for r in again]


def test_cascade_order_changes_no_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rules = quality_rules.BASE_RULES | quality_rules.METHOD_RULES
    kept = set()
    for order in (list(rules), list(reversed(rules))):
        hit = quality_rules.cascade(order, rules, F.coalesce("text", F.lit("")))
        kept.add(tuple(r[0] for r in df.select(hit.isNull()).collect()))
    assert len(kept) == 1
    out = quality_rules.quality_filter(df)
    assert out.count() == len(TEXTS) and out.where("text IS NULL").first().rejected_by is not None
    assert quality_rules.quality_filter(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "[TURN user]x</s>", "\u001bc\u001be\u001b", "", "plain ] text", "<|im_end|></s></s>", "a\nb", "<</SYS>><s>[INST]", "<\u001bc/s>", "é" * 3000]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "hello"), (2, 0, "user", "hello"), (2, None, None, None), (None, 1, "sys]tem", "x"), (3, 5, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    out = {r.conv_id: r for r in chat_format.format_chats(df).withColumn("loss", chat_format.loss_text(F.col("recovered"))).collect()}
    assert [(t.role, t.text) for t in out[1].recovered] == [(r[2], r[3]) for r in rows[: len(nasty)]]
    assert out[1].level > 0 and out[2].level == 0 and out[3].level == 0
    assert [(t.role, t.text) for t in out[2].recovered] == [("", ""), ("user", "hello"), ("user", "hello")]
    assert out[None].recovered[0].role == "sys]tem"
    assert out[1].loss == "".join(t for i, t in enumerate(nasty) if i % 2 == 0)
    assert out[1].formatted.count("</s>") == len(nasty)  # no control string but the template's
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_texts_are_read_back_from_the_formatted_string_alone(spark):
    pieces = [*chat_format.CONTROLS, chat_format.ESC, "c", "e", "<", "[", "/", "s>", "]", "|", "INST]", "TURN ", " a"]
    texts = ["".join(random.Random(i).choices(pieces, k=i % 9)) for i in range(3000)]
    df = spark.createDataFrame([(i // 3, i % 3, texts[-i], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    alone = chat_format.format_chats(df).select("conv_id", "level", "formatted")
    for r in alone.withColumn("read", chat_format.parse(F.col("formatted"))).collect():
        want = [(texts[-i], texts[i]) for i in range(3 * r.conv_id, 3 * r.conv_id + 3)]
        assert [(t.role, t.text) for t in r.read] == want
        assert r.formatted.count("</s>") == 3 and r.formatted.count("[TURN ") == 3


def test_mixing(spark):
    rows = [(i, f"s{i % 4}" if i % 4 else None, "word " * (i % 37)) for i in range(600)] + [(7, "s3", "dup dup"), (7, "s3", "dup dup"), (None, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df, slice_rows=50).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    sources = sorted((s for s in out.source.unique() if s is not None)) + [None]
    total = out["size"].sum()
    targets = {}
    for s in sources:
        part = out[out.source.isna()] if s is None else out[out.source == s]
        targets[s] = part.target.iloc[0]
        assert part.target.nunique() == 1 and abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()
        assert part.target.iloc[0] <= 3 * part["size"].sum() + 1e-6
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    again = mixing.mix(df, slice_rows=7).toPandas()
    key = lambda d: sorted(map(tuple, d[["size", "taken"]].to_numpy().tolist()))
    assert key(out) == key(again)  # the cuts into slices change nothing
    assert mixing.mix(df.limit(0)).count() == 0


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for v, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def test_url_rules_and_model(spark):
    urls = ["http://a.Example.NET/en/x?y=1#z", "https://example.com/de/", "example.com/de/", None, "", "x://", "http://notexample.com/de/q", "http://q.org/fr/a", "http://net/", "http://a.net?x", "http://é.org/fr/" + "p/" * 5000, "a://b://c.net/x"]
    urls += [f"http://h{i}.net/a/{i}" for i in range(60)] + [f"http://h{i}.org/fr/{i}" for i in range(60)]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = url_filter.filter_urls(df).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path, best = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else ("block" if r.block_probability >= 0.5 else "allow"))
    one = url_filter.filter_urls(df.where("url LIKE '%.net/a/%'")).collect()
    assert {r.verdict for r in one} == {"block"}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_model_learns_held_out(spark):
    rows = [(f"http://shop{i % 7}.example/{'x' * (i % 5)}/{i}?id={i * 7919}&ref={i}", 1.0) for i in range(400)] + [(f"http://news.example/story/about-the-{w}-{i % 3}", 0.0) for i, w in enumerate(["town", "river", "school", "garden"] * 100)]
    df = spark.createDataFrame(rows, "url string, label double").dropDuplicates(["url"])
    split = F.pmod(F.xxhash64("url"), F.lit(3)) == 0
    out = url_filter.predict(df.where(split), url_filter.train(df.where(~split)))
    assert out.select(F.avg(((F.col("block_probability") >= 0.5) == (F.col("label") == 1)).cast("int"))).first()[0] > 0.95


def test_cascade_is_ordered_by_rejection_per_cost_and_stops_early(spark):
    df = spark.createDataFrame([(f"w{i} " * 3000,) for i in range(60)], "text string")
    dear = lambda s: F.length(F.regexp_replace(F.regexp_replace(s.text, r"(\\w+) (?=.*)", "$1"), r"[^\\d]+", "")) < 0
    rules = {"a_dear_without_hits": dear, "b_cheap_without_hits": lambda s: F.length(s.text) < 0, "c_often": lambda s: F.length(s.text) > 5}
    assert quality_rules.plan_cascade(df, rules) == ["c_often", "b_cheap_without_hits", "a_dear_without_hits"]
    order = ["c_often", "fails"]
    hit = quality_rules.cascade(order, rules | {"fails": lambda s: F.raise_error(F.lit("was evaluated")).cast("boolean")}, F.col("text"))
    assert {r[0] for r in df.select(hit).collect()} == {"c_often"}
    shared = quality_rules.plan_cascade(df, quality_rules.METHOD_RULES, have_statistics=True)
    assert sorted(shared) == sorted(quality_rules.METHOD_RULES)


def test_digest_of_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(df).first()
    text = "".join(f"{t.role}\n{t.text}\n" for t in r.recovered)
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()


def test_url_suffixes_count_all_labels_and_join_alike(spark, monkeypatch):
    rows = [(f"http://h{i}.org/s{i % 90}/{i}", float(i % 90 < 45)) for i in range(400)] + [(f"http://h{i}.org/hot/{i}", 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "url string, label double")
    fitted = url_filter.train(df, rows=40)
    got = {r.suffix: (r.s_bad, r.s_n) for r in fitted[1].collect()}
    assert len(got) == 91 and sum(n for _, n in got.values()) == 500 and got["org/hot"] == (100.0, 100)
    asked = df.unionByName(spark.createDataFrame([("http://new.org/unknown/", None)] * 30, "url string, label double"))
    read = lambda: sorted((r.url, r.block_probability) for r in url_filter.predict(asked, fitted).collect())
    want = read()
    for name, value in (("STATS_ROWS", 0), ("HOT_SHARE", 20)):
        monkeypatch.setattr(url_filter, name, value)
    assert len(want) == 530 and read() == want
