"""The registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernspan.llm.tables import let
from kernspan.llm.tables import words as words_of
from kernspan.llm import (
    crossentropy,
    editcounts,
    histogramtopk,
    mixing,
    multiindex,
    packing,
    pagetext,
    periodicruns,
    quality,
    simhash,
    substrings,
    toolcalls,
    turnrepair,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op2_quality_rules(spark, sf):
    """Statistics and verdict of every document, rules learned from all labels."""
    scored, _ = quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return scored.select(*first, "base_failed", "kept")


@query
def op3_substring_dedup(spark, sf):
    """Every text without the words of 13-word windows that start in a document of smaller id."""
    return substrings.substring_dedup(table(spark, sf, "documents"))


@query
def op5_simhash_dedup(spark, sf):
    """Fingerprint and component of every document, linked at two or fewer bits."""
    return simhash.simhash_components(table(spark, sf, "documents"))


def source_domain() -> Column:
    """The domain a source belongs to, by the number in its name; others are ``misc``."""
    number = F.regexp_extract(F.col("source"), r"(\d+)$", 1).try_cast("int")
    domains = F.array(*map(F.lit, ("web", "books", "code", "forum")))
    return F.coalesce(F.get(domains, F.pmod(number, F.lit(4))), F.lit("misc"))


#: target weights by level; siblings without an entry have weight 1
DOMAIN_WEIGHTS = {"web": 2.0, "books": 4.0, "code": 3.0, "forum": 1.0}
LANGUAGE_WEIGHTS = {"en": 5.0, "fr": 2.0, "de": 2.0}
#: share of one epoch's tokens that the mixture has
BUDGET_SHARE = 0.8


def target_weights() -> dict[str, Column]:
    def by(column: str, weights: dict[str, float]) -> Column:
        out = None
        for key, weight in weights.items():
            hit = F.col(column) == key
            out = F.when(hit, weight) if out is None else out.when(hit, weight)
        return out.otherwise(1.0)

    return {
        "domain": by("domain", DOMAIN_WEIGHTS),
        "lang": by("lang", LANGUAGE_WEIGHTS),
        "source": F.lit(1.0),
    }


def mixture_budget() -> Column:
    return F.sum("supply") * BUDGET_SHARE


@query
def op9_source_mixing(spark, sf):
    """The token prefix that each document gives to the mixture, over up to two epochs."""
    docs = table(spark, sf, "documents")
    return mixing.mix(docs, source_domain(), target_weights(), mixture_budget(), max_epochs=2)


@query
def op10_cost_packing(spark, sf):
    """Where each piece of every document lies in the packed sequences."""
    return packing.pack_documents(table(spark, sf, "documents"))


@query
def op4_page_text(spark, sf):
    """The main text of every page."""
    return pagetext.main_text(table(spark, sf, "pages"))


@query
def op7_inverted_multi_index(spark, sf):
    """The 5 nearest vectors by cosine of every vector whose id 50 divides."""
    return multiindex.nearest(table(spark, sf, "embeddings"))


#: edits a document gets in ``op1_edit_token_counts``
EDITS_PER_DOCUMENT = 3


def derived_edits() -> Column:
    """Edits of a document that follow from its id: a place, up to 40 characters that go,
    and up to 30 characters from elsewhere in the text that come in."""

    def draw(k: int, what: int, below: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(k), F.lit(what)), below.cast("long")).cast("int")

    size = F.length(F.coalesce("text", F.lit("")))
    return F.array(
        *[
            F.struct(
                draw(k, 0, size + 1).alias("at"),
                draw(k, 1, F.lit(41)).alias("removed"),
                F.substring(F.col("text"), draw(k, 2, size + 1) + 1, draw(k, 3, F.lit(31))).alias("inserted"),
            )
            for k in range(EDITS_PER_DOCUMENT)
        ]
    )


@query
def op1_edit_token_counts(spark, sf):
    """Tokens of every document before and after its edits, and what was encoded again."""
    docs = table(spark, sf, "documents").select("doc_id", "text", derived_edits().alias("edits"))
    done = editcounts.apply_edits(editcounts.count_tokens(docs), keep_text=False)
    return done.select(
        "doc_id", "n_tokens_before", "n_tokens", "n_chars", "n_reencoded",
        F.col("leaf_count").cast("long").alias("n_leaves"),
    )


#: the tools that the derived calls of ``op6_tool_calls`` name
SCHEMAS: toolcalls.Schemas = {
    "ask": {"query": ("string", True), "words": ("integer", True)},
    "follow_up": {"query": ("string", True), "words": ("integer", True)},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as tool traffic: each user turn is an assistant's call with the
    turn before the last one as what it needs, each assistant turn the result of the call
    at the turn before it. Other turns stay."""
    turn = F.col("turn").cast("long")

    def call(at: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), at.cast("string"))

    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))
    arguments = F.struct(
        F.when(turn >= 2, F.array(call(turn - 2))).alias("after"), F.col("text").alias("query"), size.alias("words")
    )
    asked = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    call(turn).alias("id"),
                    F.when(turn < 2, "ask").otherwise("follow_up").alias("name"),
                    arguments.alias("arguments"),
                )
            ).alias("tool_calls")
        )
    )
    answered = F.to_json(F.struct(call(turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.col("role")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(role == "user", "assistant").when(role == "assistant", "tool").otherwise(role).alias("role"),
        F.when(role == "user", asked).when(role == "assistant", answered).otherwise(F.col("text")).alias("text"),
    )


@query
def op6_tool_calls(spark, sf):
    """The linked tool calls of every conversation, read as tool traffic."""
    return toolcalls.link_tool_calls(tool_messages(table(spark, sf, "conversations")), SCHEMAS)


@query
def op8_cross_entropy_difference(spark, sf):
    """Losses of every document under models of the good documents and of all."""
    return crossentropy.score_against_good(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op11_histogram_topk(spark, sf):
    """The 5 highest integer inner products of every row whose id 50 divides, over all rows."""
    is_query = F.col("vec_id") % 50 == 0
    return histogramtopk.top_k(table(spark, sf, "embeddings"), is_query, k=5)


SQL["op11_histogram_topk"] = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
        FROM e AS q JOIN e ON q.r <> e.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
    PARTITION BY r ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scored) WHERE rank <= 5
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with every fifth row damaged (by the checksum of its place):
    dropped (``copies`` is 0), emptied, without sentence ends, repeated (``copies`` is 2)
    or said by the user. Nulls are one space."""

    def said(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    place = F.concat_ws(":", said("conv_id"), said("turn"))
    kind = F.crc32(place.cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


@query
def op12_turn_repair(spark, sf):
    """The cheapest repair of every conversation after damage."""
    rows = damaged(table(spark, sf, "conversations"))
    return turnrepair.repair_conversations(rows, F.col("copies"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text (by the checksum of its doc_id) made periodic from
    some word on; a row without doc_id stays as it is."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(checksum / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        times = (3 + F.pmod(g, F.lit(8))).cast("int")
        p = (1 + F.floor((n - a) / times)).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")

    words = let(words_of("text"), lambda w: F.when(F.size(w) > 0, periodic(w)))
    return docs.withColumn("text", F.when(checksum % 10 == 0, words).otherwise(F.col("text")))


@query
def op13_periodic_runs(spark, sf):
    """Runs of repeating words of every document and digests of what is left without them."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return periodicruns.with_digests(periodicruns.periodic_runs(with_repeats(docs)))


# each word's windows, the smallest document of each, and the words that stay
SQL["op3_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
        coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    g AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (
        SELECT r, doc_id, ws, unnest(range(1, greatest(1, len(ws) - 11))) AS i FROM d)),
    least AS (SELECT gram, min(doc_id) AS owner FROM g GROUP BY gram),
    gone AS (SELECT DISTINCT r, i + k AS p FROM g JOIN least USING (gram),
        (SELECT unnest(range(0, 13)) AS k) WHERE owner < doc_id),
    words AS (SELECT r, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM d),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS said, count(*) AS n
        FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
