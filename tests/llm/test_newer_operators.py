"""Spelling variants, the Merkle manifest and odd sketches against brute force, with edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronocohort.llm import merkle, odd_sketches, spelling
from tests.llm.test_operators import EDGE, WORDS, documents, plain_words, prose

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `at` string, `group` int, `key` string, block int, sig int, n int, word string"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, "z") for r in rows], SCHEMA).repartition(3)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=2):
    form, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if near(w, o))
        form[w] = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = [form[w], n, len(others), counts[form[w]] if form[w] else None]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def variants_of(df, **options):
    return {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in spelling.variants(df, **options).collect()}


@pytest.mark.parametrize("max_bytes,in_slice", [(64 << 20, 1 << 14), (600, 1 << 14), (2000, 30)])
def test_variants_against_brute_force(spark, monkeypatch, max_bytes, in_slice):
    monkeypatch.setattr(spelling, "SLICE", in_slice)
    rng = random.Random(3)
    counts = {"".join(rng.choice("abcé") for _ in range(rng.choice([5, 5, 6, 7, 8]))): rng.randrange(3, 200) for _ in range(250)}
    counts |= {"z" * 3000: 5, "z" * 2999 + "y": 50, "z" * 2999: 9, "aaaaa": 7, "aaaaaa": 7, "aaaab": 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert variants_of(df, max_bytes=max_bytes) == plain_variants(counts)


def test_filters_hold_every_word_and_few_others():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    shards = spelling.Shards({9: 1}).load([(9, 0, spelling.filter_of(9, h))])
    assert len(shards.hit(9, h)) == len(h)
    assert len(shards.hit(9, rng.integers(0, 1 << 63, 100_000, dtype=np.uint64))) < 600
    assert len(shards.hit(8, h)) == 0


def test_vocabulary_of_edge_texts(spark):
    rng = random.Random(8)
    texts = [None, "", "1234 ...", "x" * 60000] + ["Übung Straße naïve COLOUR colour colours " * 3, "l'été d’Été\ndon't stop stopped"] * 4
    texts += [" ".join("".join(rng.choice("abÉé") for _ in range(6)) for _ in range(300)) for _ in range(4)] * 2
    rows = [(i if i % 5 else None, "s", "en", 1, t) for i, t in enumerate(texts)]
    rows += rows[5:8]
    counts = Counter()
    for key, *_, text in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    vocabulary = spelling.vocabulary(table(spark, rows), "doc_id", "text", damage=97)
    assert {r["word"]: r["n"] for r in vocabulary.collect()} == want
    assert variants_of(vocabulary) == plain_variants(want)
    assert spelling.variants(vocabulary.limit(0)).collect() == []


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, g, n, t: h("".join(map(value, (d, s, g, n, t))))

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = [(d is not None, d or 0, leaf(d, s, g, n, t), leaf(d, s, g, n + 1, t) if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0 else None) for d, s, k, n, t in rows if k == g]
        own.sort(key=lambda r: r[:3])
        trees[g] = own, levels([r[2] for r in own])
    top = levels([trees[g][1][-1][0] for g in groups])
    out = []
    for i, g in enumerate(groups):
        own, tree = trees[g]
        for k, (known, d, a, b) in enumerate(own):
            node, siblings = b or a, []
            for level, at in ((tree, k), (top, i)):
                for row in level[:-1]:
                    other = at ^ 1
                    siblings += row[other : other + 1]
                    node = h(node) if other >= len(row) else h(row[other] + node) if other < at else h(node + row[other])
                    at >>= 1
            out.append((d if known else None, a, tree[-1][0], top[-1][0], h("".join(siblings)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(df, **options):
    changed = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = merkle.leaves(df, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": F.col("n_chars") + 1}, changed)
    return merkle.manifest(leaves, **options)


COLUMNS = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_against_brute_force(spark, levels):
    rng = random.Random(1)
    rows = [(i, rng.choice(["s", None, "ü"]), rng.choice(["en"] * 30 + ["de", "é", "", None]), rng.choice([i, None]), rng.choice(EDGE)) for i in range(150)]
    rows += [(1000, "s", "lone", 7, "one"), (None, "s", "en", 5, "no id"), (None, None, None, None, None)] + rows[:4] * 2
    got = [tuple(r) for r in manifest_of(table(spark, rows), levels=levels).select(COLUMNS).collect()]
    assert sorted(got, key=str) == plain_manifest(rows)


def test_manifest_versions_share_all_but_their_path(spark):
    rows = [(i, "s", "en" if i < 600 else "de", i, f"text {i}") for i in range(700)]
    detailed = manifest_of(table(spark, rows), detail=True)
    found = {r["key"]: r for r in detailed.collect()}
    changed = [i for i in range(700) if zlib.crc32(str(i).encode()) % 7 == 0]
    assert [i for i in found if found[i]["copied"]] and sorted(i for i in found if not found[i]["verified"]) == changed
    nodes = Counter(r["key"] for r in merkle.versions(detailed).collect())
    # Ten levels of 600 leaves or seven of 100, one on top, and the leaf itself.
    assert nodes == {i: (12 if i < 600 else 9) for i in changed}
    assert all(found[i]["copied"][-1] == found[i]["folded_root"] and h("".join(found[i]["siblings"])) == found[i]["proof_sha256"] for i in changed)
    for few in (0, 1):
        assert manifest_of(table(spark, rows).orderBy("doc_id").limit(few)).count() == few
    lone = manifest_of(table(spark, rows[1:2])).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] and lone["proof_sha256"] == h("")


def plain_groups(rows, size, percent):
    sets = []
    for _, text in rows:
        ws = plain_words(text, lower=True)
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set()))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (key, _), g in zip(rows, group):
        if key is not None:
            least[g] = min(key, least.get(g, key))
    return Counter((key, len(s), None if key is None else least[g], key is None or key == least[g]) for (key, _), s, g in zip(rows, sets, group))


def test_odd_sketches_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(odd_sketches, "CELL", 8)
    monkeypatch.setattr(odd_sketches, "GROUP", 64)
    rng = random.Random(9)
    base = [prose(rng, n).split() for n in (5, 40, 120, 300)]
    texts = EDGE + [" ".join(b) for b in base] + [prose(rng, 60) for _ in range(30)] + ["one two", "two one", "One  TWO"]
    for k in range(140):  # edits from none to beyond the threshold, so that groups are chains and not all pairs link
        own = list(base[k % 4])
        for _ in range(k % 24 * len(own) // 160):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        texts.append(" ".join(own).upper() if k % 5 == 0 else "\n".join(own))
    rows = [(None if i % 40 == 39 else 1000 - i, t) for i, t in enumerate(texts)]
    rows += rows[10:14]
    df = table(spark, [(k, "s", "en", 1, t) for k, t in rows])
    got = Counter((r["key"], r["n_shingles"], r["component"], r["kept"]) for r in odd_sketches.dedup(df).collect())
    assert got == plain_groups(rows, 2, 80)
    assert odd_sketches.dedup(df.limit(0)).collect() == []
    some = documents(spark, ["a b c d e f"] * 3 + [None])
    assert sorted((r["key"], r["component"]) for r in odd_sketches.dedup(some).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    sketch = odd_sketches.Sketch(200, 16)
    most = sketch.most_bits(0.8, 1e-6)
    for share, lost in ((0.8, False), (0.9, False), (0.45, True)):
        common = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        n = int(1000 * (1 - share) / (2 * share))  # each side's own tokens
        for _ in range(20):
            sides = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, n, dtype=np.uint64)])) for _ in range(2)]
            token, first = np.concatenate(sides), np.array([0, 1000 + n, 2000 + 2 * n])
            one, two = sketch.of(odd_sketches.minhash(token, first, 200))
            assert (np.bitwise_count(one ^ two).sum() > most) == lost
