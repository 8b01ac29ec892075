"""The operators applied to their whole tables, and the same results as SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.byte_bpe import encode_documents
from contestry.llm.common import id_remainder, table
from contestry.llm.conversation_trie import prefix_trie, turn_sequences, with_heads
from contestry.llm.embedding_neighbors import near_vectors
from contestry.llm.exact_dedup import exact_groups
from contestry.llm.language import fit_languages, identify, read_pieces
from contestry.llm.line_dedup import dedup_lines, let
from contestry.llm.ngram_join import similar_texts
from contestry.llm.packing import pack_documents
from contestry.llm.periodic_runs import find_runs
from contestry.llm.sentence_spans import remove_repeated_spans
from contestry.llm.suffix_dedup import remove_repeats
from contestry.llm.top_products import scaled, top_products
from contestry.llm.toxicity import fit_toxicity, score_toxicity


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=False,
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        end_id=2,
        capacity=1024,
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    fitted = fit_toxicity(docs, labels, ~held_out)
    scored = score_toxicity(docs, fitted)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    languages, probabilities = fit_languages(docs, pieces, ~held_out)
    found = identify(docs, pieces, languages, probabilities)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def _planted(doc_id: Column, text: Column) -> Column:
    """The text, every tenth one by its id with a repeat planted from some word to its end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        turned = lambda s: F.transform(
            at, lambda i: F.get(words, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))
        )
        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), p.alias("p")), turned), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    # Of equal exponents the first run in their order stays: smallest start, then period.
    higher = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), higher)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    thousands = F.col("best.length") * 1000
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        ((thousands - thousands % F.col("best.period")) / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = turn_sequences(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    return prefix_trie(with_heads(own, conv - conv % 100, id_remainder(conv, 6), most=5))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding"), 64.0).alias("embedding"))
    return top_products(whole, F.col("vec_id") % 20 == 0, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language": op7_language,
    "op8_embeddings": op8_embeddings,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_top_products": op13_top_products,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS raw FROM d),
k AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
f AS (
  SELECT line, min(struct_pack(a := doc_id, b := no)) AS place, strlen(line) AS n
  FROM k WHERE line <> '' GROUP BY line),
near AS (
  SELECT DISTINCT t.line FROM f t JOIN f s
  ON t.n >= 10 AND s.n >= 10 AND t.n - s.n BETWEEN -2 AND 2 AND s.place < t.place
  AND levenshtein(s.line, t.line) <= 2),
m AS (
  SELECT k.*, coalesce(near.line IS NOT NULL OR struct_pack(a := doc_id, b := no) > f.place, false) AS gone
  FROM k LEFT JOIN f USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
FROM m GROUP BY doc_id""",
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
}
