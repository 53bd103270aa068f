"""Odd rows, odd names and planted groups for the operators."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronocohort.llm import byte_bpe, cotraining, decontaminate, licenses, merge_counts, posting_lists, url_models
from chronocohort.llm.queries import URL_RULES
from chronocohort.llm.registry import vocabulary

CLASHES = ["row", "source", "n", "done", "key", "__u", "__rule", "__codes", "__model", "__s", "__score", "__padded", "__words", "__shares", "__blocks", "__starts", "__source", "a.b"]


def with_clashes(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


def same_clashes(rows):
    return rows and all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in rows)


def test_extra_columns_may_have_any_name(spark):
    pages = spark.createDataFrame([(1, "https://a.org/fr/x"), (2, None), (3, "http://b.net/")], "page_id long, url string")
    judged = url_models.judge(with_clashes(pages), URL_RULES).collect()
    assert same_clashes(judged) and {r["page_id"]: r["rule"] for r in judged} == {1: "org/fr/", 2: None, 3: "net/"}
    docs = spark.createDataFrame([(1, "under the MIT License"), (2, None), (3, "")], "doc_id long, text string")
    found = licenses.scan(with_clashes(docs)).collect()
    assert same_clashes(found) and {r["doc_id"]: r["labels"] for r in found} == {1: "mit", 2: "", 3: ""}
    counted = merge_counts.token_counts(with_clashes(docs), vocabulary("byte_bpe_50k.json")).collect()
    assert same_clashes(counted) and [r["n_tokens"] > 0 for r in sorted(counted)] == [True, False, False]
    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.decode(byte_bpe.encode(with_clashes(docs), ranks, pattern), ranks, pattern).collect()
    assert same_clashes(decoded) and {r["doc_id"]: bytes(r["decoded"]).decode() for r in decoded} == {1: "under the MIT License", 2: "", 3: ""}


def test_empty_tables_have_the_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert merge_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")).collect() == []
    assert merge_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), keep=[]).columns == ["n_tokens"]
    assert byte_bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).columns == ["doc_id", "text", "token_ids"]


def test_leaks_of_a_null_key(spark):
    item = "the quick brown fox jumps over the lazy dog while nine small birds sing in the old apple tree"
    docs = spark.createDataFrame([(None, item), (1, item), (2, None), (3, "nothing of the kind")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    found = decontaminate.matches(docs, bench).collect()
    assert 1 in {r["key"] for r in found} and not {2, 3} & {r["key"] for r in found}


def brute_force(ids, vectors, query, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = unit @ unit[ids == query].T
    best = {}
    for i, s in zip(ids, score.max(axis=1)):
        if i != query:
            best[i] = max(s, best.get(i, -2))
    return sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]


def test_planted_triples_have_all_their_neighbours(spark):
    rng = np.random.default_rng(3)
    cone = rng.normal(size=(2000, 24)) * 0.35 + np.eye(24)[0] * 3
    far = np.repeat(rng.normal(size=(40, 24)) - np.eye(24)[0] * 2, 3, axis=0)
    vectors = np.concatenate([cone, far]).astype(np.float32).astype(float)
    ids = np.arange(len(vectors))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    asked = [*range(0, 2000, 50), *range(2000, 2120, 3)]
    got = posting_lists.nearest(df, F.col("vec_id").isin(asked), list_rows=40).collect()
    hit = {"cone": 0, "far": 0}
    for q in asked:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        want = brute_force(ids, vectors, q, 5)
        hit["far" if q >= 2000 else "cone"] += sum(r[2] >= want[-1][1] - 1e-9 for r in mine)
    assert hit["far"] / 200 >= 0.9 and hit["cone"] / 200 >= 0.9


@pytest.mark.parametrize("n", [1, 3, 5, 6])
def test_fewer_candidates_than_asked(spark, n):
    rng = np.random.default_rng(n)
    # One id stands on several rows, which count as one candidate.
    ids = np.array([*range(n), n - 1, n - 1])
    vectors = rng.normal(size=(len(ids), 8)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    got = posting_lists.nearest(df, F.col("vec_id") == 0, list_rows=2, least_rows=1).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for i, _ in brute_force(ids, vectors, 0, 5)]
    assert len(got) == min(5, n - 1)


def quality_rows(n):
    """Good and bad texts; source s9 holds bad texts only and has no label."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = " ".join(f"w{j}" if good else f"w{j}##!" for j in rng.integers(0, 400, 50))
        source = "s9" if not good and i % 90 == 0 else f"s{i % 5 if good else 5 + i % 2}"
        rows.append((i, text, "en", source, len(text)))
        if source != "s9" and i % 4 == 0:
            labels.append((i, int(good)))
    return rows, labels


def test_co_training_sums_over_all_rows(spark):
    rows, labels = quality_rows(1800)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = cotraining.fit(docs, marks)
    # The same rounds with all rows in memory.
    marked = dict(labels)
    import pyarrow as pa

    def views(some):
        codes = cotraining.meta_codes([r[3] for r in some], [r[2] for r in some], [r[4] for r in some])
        return [cotraining.text_features(pa.array([r[1] for r in some])), cotraining.meta_features(*codes)]

    learned = [r for r in rows if r[0] in marked and cotraining.zlib.crc32(str(r[0]).encode()) % 5]
    free = views([r for r in rows if r[0] not in marked])
    want = cotraining.co_train(views(learned), np.array([float(marked[r[0]]) for r in learned]), lambda work, size: work(free), 5, 0.5)
    for mine, other in zip(model.views, want):
        assert np.allclose(mine.weights, other.weights, atol=1e-6)
    scored = {r["key"]: r for r in cotraining.score(docs, model).collect()}
    assert np.mean([(scored[i]["score"] >= 0.5) == (i % 3 != 0) for i in range(1800)]) > 0.97
    # The metadata view learned a source without labels from the text view.
    assert all(scored[r[0]]["meta_score"] < 0.5 for r in rows if r[3] == "s9")


def test_co_training_of_odd_tables(spark):
    rows, labels = quality_rows(120)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([*rows, *rows[:40], (None, None, None, None, None), (None, "", "", "", 0)], schema)
    marks = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int")
    scored = cotraining.score(docs, cotraining.fit(docs, marks)).collect()
    assert len(scored) == 162 and all(0 <= r["score"] <= 1 for r in scored)
    alike = {}
    for r in scored:
        alike.setdefault(r["key"], set()).add(r["score"])
    assert all(len(v) == 1 for k, v in alike.items() if k is not None)
    assert cotraining.fit(docs, marks.where("quality = 1")).rate == 1.0
    assert cotraining.fit(docs.limit(0), marks).rate == 0.5
    assert cotraining.score(docs.limit(0), cotraining.fit(docs, marks)).collect() == []
    # Every row labelled: nothing to exchange. One class among the held-out labels: no calibration on training rows.
    whole = spark.createDataFrame([(r[0], int(r[0] % 3 != 0)) for r in rows], "doc_id long, quality int")
    model = cotraining.fit(docs.where("doc_id is not null"), whole.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) | (F.col("quality") == 1)))
    assert list(model.combined.weights) == [0.0, 0.5, 0.5]


MIT_WRAPPED = """Permission is hereby granted, free of charge,
to any person obtaining a copy of this software
and associated documentation files"""
BSD_WRAPPED = """Redistribution and use in source and binary
forms, with or without modification, are
permitted provided that the following
conditions are met:"""


def test_wrapped_notices_and_lookalikes(spark):
    filler = " ".join(f"w{i}" for i in range(500))
    texts = {
        1: (f"{filler}\n{MIT_WRAPPED}\n{filler}", "mit"),
        2: (f"# code\n{BSD_WRAPPED}", "bsd"),
        3: ("Licensed under the Mozilla Public License, Version 2.0", ""),
        4: ("Licensed under CC BY 4.0.", ""),
        5: (f"The license was released {filler} under the", ""),
        6: (f"released by mit {filler} under the license", ""),
        7: ("Released under\nthe MIT\nLicense", "mit"),
        8: (f"{MIT_WRAPPED} {BSD_WRAPPED}", "bsd,mit"),
        9: ("copyright all rights " + filler, ""),
        10: (filler * 400 + " licensed under the apache license version 2 0", "apache"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()} == {i: want for i, (_, want) in texts.items()}


def test_license_blocks_against_brute_force(spark):
    rng = np.random.default_rng(9)
    templates = [licenses.Template("a", "one two three four five six", ("three",)), licenses.Template("b", "two two seven eight"), licenses.Template("c", "nine")]
    pool = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    texts = []
    for i in range(150):
        words = [str(rng.choice(pool)) if rng.random() < 0.45 else f"x{rng.integers(9)}" for _ in range(rng.integers(0, 60))]
        texts.append(" ".join(w for w in words if w != "nine" or i % 3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, text in enumerate(texts):
        words, labels, best = text.split(), set(), 0.0
        for t in templates:
            own, n = set(t.text.split()), len(t.text.split())
            for at in range(0, len(words), n):
                block = set(words[at : at + 2 * n])
                if len(block & own) >= -(-4 * len(own) // 5) and block >= set(t.names):
                    labels.add(t.label)
                    best = max(best, len(block & own) / len(own))
        want[i] = (",".join(sorted(labels)), round(best, 9))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(df, phrases={"no such phrase": "z"}, templates=templates).collect()}
    assert got == want and len({w for w, _ in want.values()}) > 3
