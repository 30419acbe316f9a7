"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annalist.llm import chat, common, decontaminate, jaccard, langid, lm, mixing, substrings, toxicity, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, node string, key string, spans string, score double, size long, words string, block int"
LONG = " ".join(f"w{k % 7919}" for k in range(60_000))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, "x", "y", "z", 0.5, 3, "v", 9)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, "the cat sat on the mat and the dog ran away"), row(2, "the cat sat on the mat and the dog ran away", None, None), row(3, None), row(4, ""), row(5, " \t\n"),
            row(6, "1234 !!! 5678"), row(7, LONG), row(8, LONG + " tail", "de", "t"), row(9, "le chat est sur la table et le chien dort", "fr", "t"), row(9, "le chat est sur la table et le chien dort", "fr", "t"),
            row(None, "nobody knows the number of this one"), row(11, "x" * 3000, None, None), row(12, "a\x00b é 😀 İ word")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


def test_all_rows_come_back(spark, docs):
    n = docs.count()
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran"), (2, None), (3, ""), (4, "Chat")], BENCH)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (7, 0, 1), (9, 1, 0), (None, 1, 1)], LABELS)
    for found in (langid.identify(docs), toxicity.score_toxicity(docs, labels), jaccard.jaccard_components(docs), substrings.substring_dedup(docs), mixing.mix(docs), lm.score_documents(docs, 50), decontaminate.contamination(docs, bench)):
        assert len(found.collect()) == n


def test_empty_tables(spark, none):
    bench, labels = spark.createDataFrame([], BENCH), spark.createDataFrame([], LABELS)
    for found in (langid.identify(none), toxicity.score_toxicity(none, labels), jaccard.jaccard_components(none), substrings.substring_dedup(none), substrings.remove_repeated(none), mixing.mix(none), lm.score_documents(none),
                  decontaminate.contamination(none, bench), vectors.range_join(spark.createDataFrame([], "vec_id long, embedding array<float>")), chat.read_back(chat.format_chat(chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))):
        assert found.collect() == []


def test_language_of_texts_without_letters(docs):
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 4, 5, 6))
    assert found[9].lang_pred in ("en", "de", "fr")


def test_jaccard_defaults(docs):
    found = {r.doc_id: r for r in jaccard.jaccard_components(docs).collect()}
    assert found[2].component_id == 1 and found[8].component_id == 7
    assert all((found[i].n_shingles, found[i].component_id) == (0, i) for i in (3, 4, 5))
    assert found[11].n_shingles == 1


def test_substrings(docs):
    found = {r.doc_id: r for r in substrings.substring_dedup(docs).collect()}
    assert (found[8].n_words, found[8].n_removed, found[8].kept_sha256) == (60_001, 60_000, hashlib.sha256(b"tail").hexdigest())
    assert found[2].n_removed == 0 and found[7].n_removed == 0


def test_pipeline_stages(spark, docs, tmp_path):
    now = docs
    spark.createDataFrame([(1, "le chat est sur la table et le chien dort")], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = now, stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert now.columns == before.columns
    kept = {r.doc_id for r in now.collect()}
    assert kept == {1, 7, 11, 12, None}  # 2 and 8 are near copies, 3 to 6 have no language, 9 is in the benchmark


def brute_pipeline(spark, kept, bench):
    """doc_id and words of what the stages after language ID leave, by plain loops over the rows it kept."""
    words = {i: (t or "").encode().split() for i, t in kept}
    lower = {i: (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split() for i, t in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in lower.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = sorted(i for i in sets if find(i) == i)
    first = {}
    for i in left:
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    texts = {}
    for i in left:
        w = words[i]
        keep = [True] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                keep[p : p + 50] = [False] * 50
        if all(keep):
            texts[i] = dict(kept)[i]
        elif any(keep):
            texts[i] = b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()
    grams = set()
    for _, t in bench:
        w = decontaminate.bench_words((t or "").encode())
        grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    clean = {}
    for i, t in texts.items():
        w = decontaminate.bench_words((t or "").encode())
        if not any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1)):
            clean[i] = len((t or "").encode().split())
    return clean


def test_pipeline_against_loops(spark, tmp_path):
    """All stages at once on a small table: what language ID keeps goes through plain loops; two runs at a time."""
    data = "/root/testdata/sf0.001"
    first = corpus_pipeline.run(spark, data)
    second = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[0][1](spark, docs, data).collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_pipeline(spark, kept, bench)
    got = sorted(map(tuple, first.collect()), key=str)
    assert {r[0]: r[2] for r in got} == want and len(got) == len(want)
    sizes = {}
    for _, source, size, *_ in got:
        sizes[source] = sizes.get(source, 0) + size
    assert all(r[3] == sizes[r[1]] and 0 <= r[5] <= 2 * r[2] for r in got)
    for source in sizes:
        mine = [r for r in got if r[1] == source]
        assert 0 <= mine[0][4] - sum(r[5] for r in mine) < 1
    assert sorted(map(tuple, second.collect()), key=str) == got  # the first run's tables aren't the second's


def test_pipeline_of_no_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", BENCH)):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, None])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[3] == (2, 1, False)
    assert all(found[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11))


PAGES = "page_id long, url string, html string, cut int, payload string"


@pytest.mark.parametrize("hot", [10_000, 2])
def test_warc(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "hot_keys", lambda rows, key: common.hot_keys(rows, key, hot))
    big = "é" * 600
    rows = [(1, "u", big, 0, ""), (2, None, big, 0, ""), (3, "a\r\nb", None, 0, ""), (4, "u", "", 0, ""), (5, "u", "x\r\n\r\ny", 0, ""), (None, "u", big, 0, ""), (1, "u", big, 0, ""), (6, "u", "z" * 999, 0, ""), (7, "u", "z" * 999, 0, "")]
    rows += [(k, "e", "", 0, "") for k in range(100, 140)]
    warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    parsed = warc.parse_records(records).collect()
    found = {r.page_id: r for r in parsed}
    assert len(parsed) == len(rows)
    assert (found[1].record_type, found[1].refers_to, found[2].record_type, found[2].refers_to, found[None].record_type) == ("revisit", 2, "response", None, "revisit")
    assert bytes(found[1].payload) == big.encode() and found[5].payload_bytes == 6 and found[3].payload_digest == hashlib.sha1(b"").hexdigest()
    assert found[6].record_type == found[7].record_type == "response"
    warc.export_warc(records, str(tmp_path / "w"))
    seen = []
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        while data:  # a reader of WARC files
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n") and {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= set(fields)
            assert (fields[b"WARC-Type"] == b"revisit") == (b"WARC-Profile" in fields)
            n = int(fields[b"Content-Length"])
            seen.append((fields[b"WARC-Type"], rest[:n].partition(b"\r\n\r\n")[2]))
            assert rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]
    assert sorted(seen) == sorted((r.record_type.encode(), bytes(r.payload) if r.record_type == "response" else b"") for r in parsed)


def test_warc_of_no_pages_and_altered_bytes(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.parse_records(warc.read_archive(spark, str(tmp_path / "none"))).collect() == []
    warc.write_archive(spark.createDataFrame([(1, "u", "x", 0, "")], PAGES), str(tmp_path / "a"))
    p = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    p.select("sha256", F.lit("y").cast("binary").alias("payload")).write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "headers")).write.parquet(str(tmp_path / "b" / "headers"))
    with pytest.raises(Exception, match="payload missing or altered"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_vectors_of_clashing_columns_and_many_components(spark):
    rows = [(k, [float(x == k % 3) for x in range(900)], 0, 0.0, "k", True) for k in range(7)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int, n double, key string, home boolean")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.range_join(d).collect()}
    assert found == {k: (len(range(k % 3, 7, 3)) - 1, k % 3) for k in range(7)}


def test_chat_layouts(spark):
    rows = [(1, '{"prompt":"p","response":"r"}', "prompt_response"), (2, '{"instruction":"i","output":"o"}', "instruction_output"), (3, '{"messages":[{"role":"user","content":"u"},{"role":"assistant","content":"<|im_end|>\\\\"}]}', "messages"),
            (4, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', "from_value"), (5, '{"other":1}', None), (6, "no json", None), (7, None, None)]
    found = {r.conv_id: r for r in chat.canonical_json(spark.createDataFrame(rows, "conv_id long, payload string, want string")).collect()}
    assert [found[i].layout for i in range(1, 8)] == [r[2] for r in rows]
    assert [tuple(t) for t in found[4].turns] == [("user", "h"), ("assistant", "g")]
    wide = spark.createDataFrame([(1, "q", "a", 5)], "conv_id long, question string, answer string, turn long")
    assert [tuple(t) for t in chat.canonical_turns(wide).first().turns] == [("user", "q"), ("assistant", "a")]


@pytest.mark.parametrize("text", ["", "<", "<|", "<\\|", "<\\\\|", "a<|im_end|>\n<|im_start|>b", "<<|\\<\\", "\n\n", "<\\n"])
def test_chat_round_trip(spark, text):
    d = spark.createDataFrame([(1, 0, "r\n<|o", text), (1, 1, "assistant", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.format_chat(chat.canonical_turns(d)).first()
    assert chat.parse_chat(row.formatted) == [("r\n<|o", text), ("assistant", text), ("assistant", text)]
    back = chat.read_back(chat.format_chat(chat.canonical_turns(d))).first()
    assert (back.loss_chars, back.loss_sha256, back.formatted_chars) == (2 * len(text), hashlib.sha256((2 * text).encode()).hexdigest(), len(row.formatted))


def test_mix_is_exact_and_stable(spark):
    rows = [row(i, " ".join(["w"] * (1 + i % 9)), "en", "abc"[i % 3] if i % 7 else None) for i in range(300)]
    d = spark.createDataFrame(rows, SCHEMA)
    first, again = sorted(mixing.mix(d).collect(), key=lambda r: r.doc_id), sorted(mixing.mix(d.repartition(7)).collect(), key=lambda r: r.doc_id)
    assert first == again
    total = sum(r.size for r in first)
    by = {}
    for r in first:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert 0 <= rs[0].target - sum(r.taken for r in rs) < 1 and rs[0].target <= 2 * rs[0].source_size
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6


def test_words_at_the_ends_are_counted(spark):
    texts = {"f hello f": 3, "f": 1, "ff": 1, "hello\x0c": 1, "\x0chello f\x0c": 2, "\x0c": 0, " \t\n\x0b\x0c\r": 0, "\x0b a\rb\t": 2}
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count().alias("n")).collect()
    assert {r.text: r.n for r in found} == texts


def test_lexicon_and_votes_use_all_rows(spark, monkeypatch):
    rows = [(i, "a calm word" if i % 2 else "a zorbly word") for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, 1 - i % 2) for i, _ in rows], LABELS)
    told, entries, model, learned = [], [], toxicity.label_model, toxicity.learned_entries
    monkeypatch.setattr(toxicity, "label_model", lambda patterns, prior: told.append(patterns.toPandas()) or model(patterns, prior))
    monkeypatch.setattr(toxicity, "learned_entries", lambda *a: entries.extend(learned(*a)) or entries)
    assert toxicity.score_toxicity(docs, labels, sample=4).count() == 200
    assert told[0]["n"].sum() == 200
    gold = labels.where(~toxicity.held_out()).select("doc_id", F.col("toxic").alias("gold"))
    n = [gold.where(f"gold = {y}").count() for y in (0, 1)]
    lift = {r["entry"]: r["lift"] for r in entries}["zorbly"]
    assert abs(lift - (n[1] + 0.5) / (3 * n[1] + 1) / (0.5 / (3 * n[0] + 1))) < 1e-9


def test_label_model_finds_accuracies_and_correlations(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    sure = np.where(rng.random((20_000, toxicity.VOTERS)) < 0.8, y[:, None], ~y[:, None])
    sure[:, 3] = np.where(rng.random(20_000) < 0.95, sure[:, 7], sure[:, 3])  # a voter that mostly repeats another
    votes = ["".join(np.where(r, "t", "c")) for r in sure]
    patterns = spark.createDataFrame([(v, 1) for v in votes], "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    model, counts = toxicity.label_model(patterns, 0.2)
    assert model.parents[7] == 3 or model.parents[3] == 7
    found = model.correlations(counts)
    assert found[3, 7] > 0.8 and abs(found[1, 2]) < 0.1
    q = model.posterior(toxicity.LabelModel.codes(votes))
    assert ((q > 0.5) == y).mean() > 0.99
