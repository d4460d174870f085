"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe, collocations, conversations, decontamination, language_id, packing, paragraph_dedup, pii, pseudo_likelihood, quality_rules, simhash_dedup,
    suffix_dedup, url_filter,
)
from tidemark.llm.scratch import materialise

#: Tokenizer file of the packing query; the operator takes any path.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The rules of the URL query, and the host names whose pages make up its list of URLs.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BAD_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the list holds the canonical URLs of pages on hosts with a bad name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    listed = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, BAD_NAMES)))).select(url_filter.canonical(host, path).alias("u"))
    return url_filter.judge(pages, listed, RULES).drop("possible")


_OP3_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
u AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS u,
    list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS bad FROM p),
r(rule, name, start, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
    ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
b AS (SELECT page_id, host, path, u, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS by_rule
    FROM u LEFT JOIN r ON (u.host = r.name OR ends_with(u.host, '.' || r.name)) AND starts_with(u.path, r.start) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN u IN (SELECT u FROM u WHERE bad) THEN 'block' ELSE 'allow' END) AS verdict FROM b
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document; the counts are those of the base spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(pii.labelled_table()))

    def listed(col):
        return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def order(x):
        place = F.array_position(F.array(*map(F.lit, pii.KINDS)), x["kind"])
        return F.struct(place.alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))

    every = F.sort_array(F.transform(F.concat("base", "added"), order))
    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *map(count, pii.KINDS),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all documents."""
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.train_and_score(docs)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the fixed limits, and the verdict of the robust outlier rule."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("distance")


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its paragraphs, the repeated passages removed, and their paragraphs and words."""
    docs = table(spark, sf_dir, "documents")
    found = paragraph_dedup.repeated_passages(docs)
    total = lambda name: F.aggregate("passages", F.lit(0).cast("long"), lambda a, x: a + x[name])
    counts = {"n_paragraphs": F.col("n_paragraphs"), "n_removed": total("paragraphs"), "n_words_removed": total("n_words")}
    text = F.array_join(F.transform("passages", lambda x: F.concat_ws(":", x["first"], x["n_words"])), ",")
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(found.select("doc_id", *(c.alias(n) for n, c in counts.items()), text.alias("passages")), "doc_id", "left").select(
        "doc_id", *(F.coalesce(n, zero).alias(n) for n in counts), F.coalesce("passages", F.lit("")).alias("passages")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of the documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


_OP11_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(s, '[\x20\x09]+') if x <> ''] AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
gram AS (SELECT lang, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS p
    FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, p, count(*) AS c, len(string_split(p, ' ')) AS k FROM gram GROUP BY lang, p HAVING count(*) >= 100),
sub AS (SELECT lang, c, unnest([array_to_string(string_split(p, ' ')[i:i + m - 1], ' ') for i in range(1, k - m + 2)]) AS p
    FROM f, (SELECT unnest(range(2, 5)) AS m) WHERE m < k),
cand AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = f.lang AND sub.p = f.p AND 100 * sub.c >= 100 * f.c)),
cut AS (SELECT lang, p, c, unnest(range(1, k)) AS j, string_split(p, ' ') AS w FROM cand),
scored AS (SELECT cut.lang, cut.p, cut.c AS a, j, lf.c AS l, rf.c AS r, n,
        1000::HUGEINT * cut.c * n // (lf.c::HUGEINT * rf.c) AS score
    FROM cut JOIN total ON total.lang = cut.lang JOIN f lf ON lf.lang = cut.lang AND lf.p = array_to_string(w[1:j], ' ')
    JOIN f rf ON rf.lang = cut.lang AND rf.p = array_to_string(w[j + 1:], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM least)
SELECT lang, rank, p AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and the digest of the text decoded from them."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, the cheapest edits and the digest of the repaired rows of every conversation, after damage."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversations.damaged(given)
    audits = materialise(conversations.audit(rows), "audits")
    found = audits.join(conversations.digests(conversations.repair(rows, audits)).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    every = given.select(F.col("conv_id").alias("c")).distinct()
    joined = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("c").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repeats, op2_decontamination, op3_urls, op4_pii, op5_language, op6_lm_score, op7_simhash, op8_quality, op9_packing, op10_paragraphs,
        op11_collocations, op12_bpe, op13_conversations,
    )
}

ORACLES: dict[str, str] = {"op3_urls": _OP3_SQL, "op11_collocations": _OP11_SQL}
