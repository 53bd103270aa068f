"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronocohort.llm import (
    byte_bpe, cotraining, decontaminate, jaccard, licenses, merge_counts, merkle, odd_sketches, posting_lists, recompression, spelling, toxicity, url_models,
)
from chronocohort.llm.oracles import OP11_SQL, OP12_SQL
from chronocohort.llm.registry import ORACLES, QUERIES, query, table, vocabulary  # noqa: F401

# The rules that op1 is asked to apply.
URL_RULES = [
    url_models.Rule("net/", False),
    url_models.Rule("example.net/en/", True),
    url_models.Rule("example.com/de/", False),
    url_models.Rule("org/fr/", True),
]

OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, p, list_slice(words, p, p + 12) AS win FROM w, unnest(range(1, len(words) - 11)) AS t(p) WHERE len(words) >= 13),
least AS (SELECT win, min(doc_id) AS first_doc FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN least USING (win) WHERE doc_id > first_doc),
gone_of AS (SELECT doc_id, list(q) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words
              ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END AS left_over
  FROM w LEFT JOIN gone_of USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(left_over, ' ')) AS kept_sha256
FROM kept
"""

LOWERED = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"


def jaccard_sql(size: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of documents linked by the Jaccard similarity of their word shingles."""
    places, last = f"range(1, len(words) - {size - 2})", f"p + {size - 1}"
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= {size} THEN list_transform({places}, lambda p: array_to_string(list_slice(words, p, {last}), ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_have JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""


OP13_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({jaccard_sql(2, 80)})"

_WORDS6 = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_NOTICES = ", ".join(f"('{t.label}', {licenses.tokens_of(t.text)}, {list(t.names)}::VARCHAR[], {len(licenses.words_of(t.text))})" for t in licenses.TEMPLATES)
_PLACES = ", ".join(
    "list_filter(range(len(words)), lambda i: " + " AND ".join(f"words[i + {k}] = '{part}'" for k, part in enumerate(phrase.split(" "), 1)) + f") AS p_{label}"
    for phrase, label in licenses.PHRASES.items()
)
_BASE = "list_concat(" * (len(licenses.PHRASES) - 1) + "{0}" + "".join(f", {{{k}}})" for k in range(1, len(licenses.PHRASES)))

OP6_SQL = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS lowered FROM documents),
w AS (SELECT doc_id, {_WORDS6.format('lowered')} AS words FROM t),
p AS (SELECT doc_id, len(words)::BIGINT AS n_words, {_PLACES} FROM w),
b AS (
  SELECT doc_id, n_words, {_BASE.format(*(f'p_{x}' for x in licenses.PHRASES.values()))} AS places,
         {_BASE.format(*(f"CASE WHEN len(p_{x}) > 0 THEN ['{x}'] ELSE [] END" for x in licenses.PHRASES.values()))} AS base FROM p),
notice AS (SELECT * FROM (VALUES {_NOTICES}) AS v(label, tokens, names, n)),
block AS (
  SELECT doc_id, label, tokens, names, list_distinct(list_slice(words, s + 1, s + 2 * n)) AS own FROM w, notice, unnest(range(0, len(words), n)) AS t(s)),
met AS (
  SELECT doc_id, label, len(list_intersect(own, tokens)) AS common, len(tokens) AS size FROM block
  WHERE len(list_intersect(own, tokens)) >= ceil(0.8 * len(tokens) - 1e-9) AND len(list_intersect(own, names)) = len(names)),
alike AS (SELECT doc_id, list(DISTINCT label) AS labels, max(common / size) AS share FROM met GROUP BY 1)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN alike USING (doc_id)
"""


@query("op1_url_filters")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_models.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "score", "word_start", "word_end")


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    cut = recompression.dedup(table(spark, folder, "documents"))
    # Where nothing went, the operator gives the text as it was; the digest is of its words joined by one space.
    words = F.btrim(F.regexp_replace(F.coalesce("kept", F.lit("")), "[ \\x09-\\x0D]+", " "), F.lit(" "))
    return cut.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


@query("op4_ngram_jaccard", jaccard_sql(5, 75))
def op4(spark: SparkSession, folder: str) -> DataFrame:
    joined = jaccard.join(table(spark, folder, "documents"))
    return joined.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return posting_lists.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_license_scans", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.drop("text")


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = merge_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = cotraining.score(docs, cotraining.fit(docs, table(spark, folder, "labels")))
    return scored.select(F.col("key").alias("doc_id"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("keep"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select(
        F.col("key").alias("doc_id"), toxicity.held_out(F.col("key")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence",
    )


@query("op10_byte_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, folder, "documents"), ranks, pattern, keep=["doc_id"])
    decoded = byte_bpe.decode(encoded, ranks, pattern)
    return decoded.select(
        "doc_id", byte_bpe.n_tokens().alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents"), "doc_id", "text", damage=97))


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0) & F.col("n_chars").isNotNull()
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(merkle.leaves(docs, "doc_id", "lang", columns, {"n_chars": F.col("n_chars") + 1}, tampered))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_odd_sketches", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = odd_sketches.dedup(table(spark, folder, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
