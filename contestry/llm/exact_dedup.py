"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is normalised and cut into chunks at places its own content decides. Each chunk has a
verified identifier: its 64-bit hash, and a rank where several different chunks share that
hash. The ordered identifier list of a text is its recipe; texts are equal when their recipes
are. Chunk text is shuffled once, pre-aggregated by task, to verify the hashes; after that
only lists of identifiers move, so a long document is never moved as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import texts_of
from contestry.session import cut_lineage

SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: A chunk ends between two words of which the first ends in a character with a code of 3
#: modulo 8 and the next begins with one of 1 modulo 4. Such places are far apart beside
#: MIN_CHUNK, so texts that differ in front fall into step again soon. Where none comes, a
#: chunk has MAX_CHUNK characters.
CUT_AFTER = "[#+3;CKS\\[cks{] (?=[!%)\\-159=AEIMQUYaeimquy}])"
MIN_CHUNK, MAX_CHUNK = 64, 4096


def normalized(text: Column) -> Column:
    """Text with each run of ASCII white space replaced by one blank."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks whose concatenation is ``text``; the empty text has none."""
    pattern = f"(?s).{{{least},{most}}}?{CUT_AFTER}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_hash(chunk: Column, hash_bits: int = 64) -> Column:
    """Hash of a chunk; fewer bits make collisions likely, for tests."""
    full = F.xxhash64(chunk)
    return full if hash_bits == 64 else full.bitwiseAND(F.lit((1 << hash_bits) - 1))


def shared_hashes(chunked: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``_hash`` values that different chunks share; as a rule there are none.

    Every chunk of every text is compared byte for byte with those of its hash. A task sends
    one row for each different chunk, so a chunk that fills the corpus is no hot key.
    """
    each = chunked.select(F.explode("_chunks").alias("_chunk"))
    different = each.groupBy(chunk_hash(F.col("_chunk"), hash_bits).alias("_hash"), "_chunk").agg(
        F.lit(1).alias("_one")
    )
    return different.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")


def ranked_rivals(chunked: DataFrame, shared: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Chunks of shared hashes: ``_hash``, ``_chunk``, ``_rank`` from 0 within the hash."""
    each = chunked.select(F.explode("_chunks").alias("_chunk"))
    each = each.withColumn("_hash", chunk_hash(F.col("_chunk"), hash_bits))
    rivals = each.join(shared, "_hash", "left_semi").distinct()
    # Rank among rivals of one hash without a window: how many of them sort before.
    other = rivals.select(F.col("_hash").alias("_h2"), F.col("_chunk").alias("_c2"))
    return (
        rivals.join(other, (F.col("_hash") == F.col("_h2")) & (F.col("_c2") < F.col("_chunk")), "left")
        .groupBy("_hash", "_chunk")
        .agg(F.count("_c2").alias("_rank"))
    )


def recipes(texts: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``_id``, ``_sha`` (of the normalised text) and ``_recipe``, its verified identifiers.

    Takes ``_id`` and ``_text``. Without collisions, which are counted over the whole corpus,
    a recipe is computed in its own row. Texts with a colliding chunk look up the ranks.
    """
    chunked = texts.select("_id", normalized(F.col("_text")).alias("_norm")).select(
        "_id", F.sha2("_norm", 256).alias("_sha"), chunks_of(F.col("_norm")).alias("_chunks")
    )
    hashes = F.transform("_chunks", lambda c: chunk_hash(c, hash_bits))
    shared = cut_lineage(shared_hashes(chunked, hash_bits))
    if shared.isEmpty():
        return chunked.select("_id", "_sha", hashes.alias("_recipe"))
    placed = chunked.select(
        "_id", "_sha", F.posexplode_outer("_chunks").alias("_at", "_chunk")
    ).withColumn("_hash", chunk_hash(F.col("_chunk"), hash_bits))
    collisions = cut_lineage(ranked_rivals(chunked, shared, hash_bits))
    ranked = placed.join(collisions, ["_hash", "_chunk"], "left")
    step = F.struct("_at", "_hash", F.coalesce("_rank", F.lit(0)).alias("_rank"))
    # Two numbers for a chunk: its hash and its rank, flat, so that the list stays a list of longs.
    return (
        ranked.groupBy("_id", "_sha")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("_at").isNotNull(), step))).alias("_steps"),
            F.count("*").alias("_rows"),
        )
        # Rows repeated with one id and text met in one group; they come apart again.
        .withColumn("_copies", (F.col("_rows") / F.greatest(F.size("_steps"), F.lit(1))).cast("int"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(
            "_id",
            "_sha",
            F.flatten(F.transform("_steps", lambda s: F.array(s["_hash"], s["_rank"]))).alias("_recipe"),
        )
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after every ASCII white-space run became one blank; the row
    with the smallest id stays. Null text is empty text, and all empty texts are equal. A null
    id is never the smallest: its row stays only where its whole group has null ids, and then
    ``keep_id`` is null. Rows repeated with one id are all counted and share their ``kept``.
    An empty table gives no rows. Other columns of ``docs`` are not read.

    Groups are counted with partial sums before the shuffle; the join back has one row per
    recipe on the right side, so AQE can split a recipe that a third of all rows have.
    """
    told = recipes(texts_of(docs, id_col, text_col), hash_bits)
    groups = told.groupBy("_recipe").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
    return told.join(groups, "_recipe").select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the later copies; columns as in ``docs``."""
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
