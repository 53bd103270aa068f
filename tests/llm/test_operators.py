"""Operators on small fixtures: edge cases, and brute force where SQL has no form."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronocohort.llm import byte_bpe, cotraining, decontaminate, jaccard, licenses, merge_counts, posting_lists, recompression, toxicity, url_models
from chronocohort.llm.queries import URL_RULES
from chronocohort.llm.registry import vocabulary
from chronocohort.llm.words import words

WORDS = [f"w{i}" for i in range(400)]
EDGE = [None, "", "   ", "one", "the the the " * 40, "Ünïcode\x1cglue\x85x ’s don't  two\n\n three", "x" * 5000, " " * 9000 + "end"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with exact and near copies, shared passages, runs, nulls, empty and long ones."""
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [prose(rng, rng.choice([3, 12, 13, 14, 80, 300])) for _ in range(60)] + EDGE
    texts += [base] * 5 + [passage + " " + prose(rng, 30) for _ in range(12)] + [prose(rng, 20000)]
    for k in range(25):
        own = base.split()
        for _ in range(k % 6):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        texts.append(" ".join(own).upper() if k % 7 == 0 else " ".join(own))
    return texts


def documents(spark, texts):
    rows = [(i, t, f"noise{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int").repartition(3)


def plain_words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_words_match_plain_split(monkeypatch):
    from chronocohort.llm import words as module

    monkeypatch.setattr(module, "_BLOCK", 300)
    texts = corpus()
    w = words(pa.array(texts, pa.string()), lower=False)
    got = [bytes(w.data[s:e]) for s, e in zip(w.start, w.end)]
    assert got == [x for t in texts for x in plain_words(t)]
    hashes = {}
    assert all(hashes.setdefault(x, h) == h for x, h in zip(got, w.hash))
    assert len(set(hashes.values())) == len(hashes)


def test_recompression_against_brute_force(spark):
    texts = corpus()
    first = {}
    split = [plain_words(t) for t in texts]
    for d, ws in enumerate(split):
        for p in range(len(ws) - 12):
            first.setdefault(tuple(ws[p : p + 13]), d)
    want = {}
    for d, ws in enumerate(split):
        gone = {q for p in range(len(ws) - 12) if first[tuple(ws[p : p + 13])] < d for q in range(p, p + 13)}
        kept = b" ".join(x for q, x in enumerate(ws) if q not in gone)
        want[d] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    got = recompression.dedup(documents(spark, texts), rows_per_chunk=20, keep=["score"]).collect()
    assert {r["key"]: (r["n_words"], r["n_removed"], hashlib.sha256(b" ".join(plain_words(r["kept"]))).hexdigest()) for r in got} == want
    assert all(r["row"]["score"] == f"noise{r['key']}" for r in got)


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (None, "a b"), (3, None)], [(1, "x " * 30), (1, "x " * 30), (2, "x " * 30)]])
def test_repeats_of_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["key"] is not None, r["key"] or 0, r["n_removed"]) for r in recompression.dedup(df).collect())
    assert len(got) == len(rows)
    if rows and rows[0][0] == 1:
        assert got == [(True, 1, 0), (True, 1, 0), (True, 2, 30)]


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = plain_words(t, True)
        sets.append(set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in enumerate(sets)}


def test_jaccard_against_brute_force(spark):
    texts = corpus()
    got = jaccard.join(documents(spark, texts), rows_per_chunk=20).collect()
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in got} == brute_jaccard(texts)


def test_jaccard_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "A b  c"), (4, "A b  c"), (9, "a b c"), (5, None)], "doc_id long, text string")
    got = sorted((r["key"] or -1, r["n_shingles"], r["component"]) for r in jaccard.join(df).collect())
    assert got == [(-1, 1, 4), (4, 1, 4), (4, 1, 4), (5, 0, 5), (9, 1, 4)]
    assert jaccard.join(df.limit(0)).collect() == []


def test_byte_bpe_round_trip_and_library(spark):
    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    codec = byte_bpe.encoding(ranks, pattern)
    rng = random.Random(3)
    texts = EDGE + ["".join(rng.choice("ab '  \n\té漢.1") for _ in range(5000)) for _ in range(5)] + [" " * 300_000, "\n " * 5000 + "x"]
    df = spark.createDataFrame([(i, t, b"old") for i, t in enumerate(texts)], "doc_id long, text string, Token_Ids binary")
    got = byte_bpe.decode(byte_bpe.encode(df, ranks, pattern), ranks, pattern).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        assert r["decoded"] == (text or "").encode()
        if len(text or "") < 100_000:
            assert list(np.frombuffer(r["token_ids"], "<u4")) == codec.encode_ordinary(text or "")
    assert isinstance(codec, tiktoken.Encoding)
    assert byte_bpe.encode(df.limit(0), ranks, pattern).count() == 0


def test_merge_counts_equal_the_library(spark):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = EDGE + ["".join(rng.choice("ab '  \n\té漢.1\x1c\x85\xa0!<|endoftext|>") for _ in range(200)) for _ in range(60)] + ["a<|endoftext|> b", prose(rng, 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS int")
    got = {r["doc_id"]: r["n_tokens"] for r in merge_counts.token_counts(df, path, keep=["doc_id", "N_TOKENS"]).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_url_rules_and_models(spark):
    urls = [None, "", "no scheme", "http://A.Net/x?q#f", "https://blog.EXAMPLE.net/en/1", "http://example.net", "x://b.org/fr/", "http://xnet/en/", "http://example.com/de/7", "http://good.org/es/" + "a" * 3000]
    df = spark.createDataFrame([(i, u, "kept", "gone") for i, u in enumerate(urls * 2)], "page_id long, url string, __x string, verdict string")
    got = url_models.judge(df, URL_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got[:10]] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.net", "/x", "net/"), ("blog.example.net", "/en/1", "example.net/en/"), ("example.net", "", None),
        ("b.org", "/fr/", "org/fr/"), ("xnet", "/en/", None), ("example.com", "/de/7", "example.com/de/"), ("good.org", "/es/" + "a" * 3000, None),
    ]
    assert [r["verdict"] for r in got if r["rule"]] == ["block", "allow", "allow", "block"] * 2
    assert all(r["verdict"] in ("allow", "block") and math.isfinite(r["score"]) for r in got)
    assert [r["score"] for r in got[:10]] == [r["score"] for r in got[10:]]
    assert url_models.judge(df.limit(0), URL_RULES).count() == 0


def test_url_models_tell_hosts_apart(spark):
    rows = [(i, f"http://{'shop' if i % 2 else 'read'}{i}.{'net/a' if i % 2 else 'org/fr/a'}") for i in range(400)]
    rows += [(1000 + i, f"http://{'shop' if i % 2 else 'read'}{i}.com/x") for i in range(50)]
    got = url_models.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("page_id >= 1000").collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got]) > 0.9


def test_licenses(spark):
    texts = [None, "", "MIT License mit license", "x\nLicensed under the Apache License, Version 2.0.\nmore", "licensed under cc by nc 4 0", "mit der license", "the " * 5000, "a general public license é"]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(2)
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    pick = lambda *names: [tuple(got[i][n] for n in names) for i in range(len(texts))]
    assert pick("n_words", "n_base", "first_word", "last_word") == [(0, 0, None, None), (0, 0, None, None), (4, 2, 0, 2), (10, 1, 4, 4), (7, 0, None, None), (3, 0, None, None), (5000, 0, None, None), (5, 1, 1, 1)]
    assert pick("base_labels", "labels") == [("", ""), ("", ""), ("mit", "mit"), ("apache", "apache"), ("", "cc-by-nc"), ("", ""), ("", ""), ("gpl", "gpl")]
    assert got[0]["score"] == 0 and got[2]["score"] == 1 and 0.8 <= got[4]["score"] <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_join_is_exact(spark):
    rng = random.Random(2)
    template = licenses.tokens_of(licenses.TEMPLATES[5][1])
    lines = [" ".join(rng.sample(template, rng.randint(1, len(template))) + rng.sample(WORDS, 5)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: "bsd" in r["labels"] for r in licenses.scan(df).collect()}
    assert got == {i: len(set(t.split()) & set(template)) >= math.ceil(0.8 * len(template) - 1e-9) for i, t in enumerate(lines)}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    vectors = [(centres[i % 20] + 0.3 * rng.normal(size=16)).tolist() for i in range(3000)]
    vectors[100:900] = [vectors[100]] * 800
    rows = [(i, v) for i, v in enumerate(vectors)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0]), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = posting_lists.nearest(df, F.col("vec_id") % 50 == 0, block_rows=100).collect()
    unit = np.array([r[1] for r in rows[:3000]], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -2
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-12 for r in mine)
        found += sum(r["score"] >= np.sort(score)[-5] - 1e-12 for r in mine)
        if 100 <= q < 900:
            assert [r["vec_id"] for r in mine] == [i for i in range(100, 107) if i != q][:5]
    assert found / (60 * 5) >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 3000, 50))
    assert posting_lists.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    weights = rng.random((500, 12)) * (rng.random((500, 12)) < 0.3)
    weights = weights[weights.sum(axis=1) > 0]
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    index = toxicity.Neighbours.of(weights)
    for _ in range(50):
        terms = rng.choice(12, 3, replace=False)
        query = rng.random(3)
        query /= np.linalg.norm(query)
        rows, cosine = index.nearest(terms, query, 7)
        whole = np.round(weights[:, terms] @ query, 12)
        want = np.lexsort((np.arange(len(whole)), -whole))[:7]
        assert list(rows) == [i for i in want if whole[i] > 0]


def test_toxicity_finds_marked_words(spark):
    rng = random.Random(4)
    bad = ["nasty", "vile", "awful"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        ws = [rng.choice(WORDS) for _ in range(40)]
        if toxic:
            for _ in range(3):
                ws[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(ws))
        labels.append((i, int(toxic)))
    texts += [None, ""]
    docs = documents(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert set(bad) <= set(model.terms)
    got = {r["key"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels) and all(0 <= s <= 1 for s in got.values())
    assert got[600] == got[601] < 0.5
    for keep in (["doc_id", "text", "score"], ["text"], ["n_words"]):
        rows = [r["row"].asDict() for r in toxicity.score(docs, model, keep=keep).collect()]
        assert sorted(rows, key=str) == sorted((r.asDict() for r in docs.select(keep).collect()), key=str)
    assert toxicity.fit(docs, marks.limit(0)).without == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_of_rare_words_and_few_labels(spark):
    rng = random.Random(5)
    bad = [f"slur{i}" for i in range(150)]  # each in about four toxic examples
    texts = [" ".join([*prose(rng, 30).split(), *(rng.sample(bad, 6) if i % 6 == 0 else [])]) for i in range(600)]
    docs = documents(spark, texts + [prose(rng, 30) + " nextword"])
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    seen = {r["doc_id"] for r in marks.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    assert set(model.terms) == {w for i in seen for w in texts[i].split()}
    got = {r["key"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i not in seen]
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.95
    few = toxicity.fit(docs, marks.where("doc_id < 25"))
    assert len(few.ids) and {i for i in few.ids if i % 6 == 0} == {i for i in seen if i < 25 and i % 6 == 0}
    ranked = {r["key"]: r["evidence"] for r in toxicity.score(docs, few).collect()}
    assert all(ranked[i] for i in range(600))


def test_postings_are_searched_exactly():
    rng = np.random.default_rng(2)
    weights = rng.random((1500, 300)) * (rng.random((1500, 300)) < 0.05)
    weights[700:760] = weights[700]
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-9)
    index = toxicity.Neighbours.of(weights)
    for size in (1, 5, 60):
        for k in (1, 15, 2000):
            terms = rng.choice(300, size, replace=False)
            query = rng.random(size)
            query /= np.linalg.norm(query)
            rows, cosine = index.nearest(terms, query, k)
            whole = np.round(weights[:, terms] @ query, 12)
            want = [i for i in np.lexsort((np.arange(1500), -whole))[:k] if whole[i] > 0]
            assert list(rows) == want and np.allclose(cosine, whole[want])


def test_index_needs_few_bytes_a_weight_beside_it():
    rng = np.random.default_rng(1)
    n_rows, n_terms = 2000, 50_000
    term = np.sort(rng.integers(0, n_terms, (n_rows, 300)), axis=1).ravel().astype(np.int32)
    row, weight = np.repeat(np.arange(n_rows, dtype=np.int32), 300), rng.random(n_rows * 300)
    tracemalloc.start()
    index = toxicity.Neighbours.build(row, term, weight, n_rows, n_terms)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (most - index.often.nbytes) / len(row) < 24


def test_examples_are_in_order_of_key_label_and_content():
    rows = [(5, 1, [2, 7], [1, 1]), (3, 0, [], []), (5, 0, [1], [4]), (5, 1, [2], [9]), (5, 1, [2, 7], [1, 1]), (5, 1, [2, 3], [1, 2])]
    lists = pa.list_(pa.int32())
    schema = pa.schema([("key", pa.int64()), ("y", pa.int64()), ("term", lists), ("count", lists)])
    parts = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[s]], schema) for s in (slice(0, 2), slice(2, 2), slice(2, 6))]
    key, y, size, term, count = toxicity._examples(pa.Table.from_batches(parts, schema))
    assert list(zip(key, y, size)) == [(3, 0, 0), (5, 0, 1), (5, 1, 1), (5, 1, 2), (5, 1, 2), (5, 1, 2)]
    assert term.tolist() == [1, 2, 2, 3, 2, 7, 2, 7] and count.tolist() == [4, 9, 1, 2, 1, 1, 1, 1]
    assert [len(x) for x in toxicity._examples(pa.Table.from_batches([], schema))] == [0] * 5


def test_alignment_and_leaks(spark):
    assert decontaminate.align(np.array([1, 2, 3]), np.array([9, 1, 2, 3, 9])) == (6, 4)
    rng = random.Random(6)
    items = [prose(rng, 40) for _ in range(5)] + [None, "", "two words"]
    edited = items[1].split()
    for k in (5, 15, 25, 35):
        edited[k] = "changed"
    texts = [prose(rng, 200) for _ in range(20)] + EDGE + [prose(rng, 50) + " " + items[0].upper() + ", " + prose(rng, 50), prose(rng, 30) + " " + " ".join(edited)]
    docs = documents(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for per_block in (5000, 2):
        got = {(r["key"], r["item"]): r for r in decontaminate.matches(docs, bench, items_per_block=per_block).collect()}
        assert set(got) == {(len(texts) - 2, 0), (len(texts) - 1, 1)}
        assert got[len(texts) - 2, 0]["score"] == 1 and (got[len(texts) - 2, 0]["word_start"], got[len(texts) - 2, 0]["word_end"]) == (50, 90)
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_edited_leaks_against_brute_force(spark):
    rng = random.Random(31)
    items = [prose(rng, 26 + 3 * i) for i in range(8)]

    def edited(item, places):
        return " ".join(f"other{k}" if k in places else word for k, word in enumerate(items[item].split()))

    leaks = [(i, edited(i, range(step - 1, 60, step))) for i in range(4) for step in (5, 6)]  # no full copy of these items
    leaks += [(i, edited(i, rng.sample(range(26), round(26 * share)))) for i in range(4, 8) for share in (0.15, 0.2, 0.25, 0.3)]
    leaks += [(i, items[i]) for i in range(4, 8) for _ in range(3)]
    half = items[5].split()
    leaks += [(5, " ".join([*half[:16], *(f"inside{k}" for k in range(14)), *half[16:]]))]
    texts = [prose(rng, rng.randrange(5, 40)) + " " + leak + " " + prose(rng, rng.randrange(5, 40)) for _, leak in leaks] + [prose(rng, 150) for _ in range(20)] + EDGE
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    code = {w: i for i, w in enumerate(sorted({w for t in [*texts, *items] if t for w in plain_words(t, lower=True)}))}
    for key, text in enumerate(texts):
        for item, words_of in enumerate(items):
            whole = np.array([code[w] for w in plain_words(text or "", lower=True)])
            own = np.array([code[w] for w in plain_words(words_of, lower=True)])
            best = decontaminate.align(own, whole)[0] / (2 * len(own))
            if best >= 0.5:
                want[key, item] = best
    assert {(key, item) for key, (item, _) in enumerate(leaks)} <= set(want)
    got = {(r["key"], r["item"]): r["score"] for r in decontaminate.matches(documents(spark, texts), bench).collect()}
    assert got == want


def test_co_training(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        good = i % 4 != 0
        text = prose(rng, 60) if good else " ".join(w + "###" for w in prose(rng, 60).split())
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 3:
            labels.append((i, int(good)))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = cotraining.fit(docs, marks)
    got = {r["key"]: r["score"] for r in cotraining.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in range(900)]) > 0.97
    assert set(got) >= {1000, 1001} and all(0 <= s <= 1 for s in got.values())
    assert cotraining.fit(docs, marks.limit(0)).rate == 0.5
