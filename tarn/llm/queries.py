"""Queries of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarn.llm import boilerplate, bpe, leakage, neighbours, pii, spam, splitting
from tarn.session import checkpoint_dir, table


def _vocabulary(spark):
    """The public vocabulary file: the setting spark.tarn.vocabulary, else where such files lie by default."""
    return spark.conf.get("spark.tarn.vocabulary", bpe.VOCABULARY)


def p2_found(spark, d):
    """The nodes that are not main body."""
    return boilerplate.boilerplate_nodes(table(spark, d, "page_nodes"), table(spark, d, "fetch_log"))


def p2_main(spark, d):
    """The main body of every page."""
    return boilerplate.main_body(table(spark, d, "page_nodes"), table(spark, d, "fetch_log"))


def p3_found(spark, d):
    """Each personal item in the questions and node texts."""
    return pii.found(table(spark, d, "golden_set"), table(spark, d, "corpus_docs"), words=_vocabulary(spark))


def p3_masked(spark, d):
    """The questions and node texts with each personal item replaced by a placeholder of its kind."""
    return pii.masked(pii.records(table(spark, d, "golden_set"), table(spark, d, "corpus_docs")), "text", words=_vocabulary(spark))


def p4_found(spark, d):
    """Pairs of cosine 0.80 or more of which one is among the five most similar vectors of the other."""
    return neighbours.similar_pairs(table(spark, d, "chunk_vectors"))


def p4_neighbours(spark, d):
    """The five most similar other vectors of every usable vector."""
    return neighbours.neighbours(table(spark, d, "chunk_vectors"))


def _items(spark, d):
    return splitting.items(table(spark, d, "corpus_docs"), table(spark, d, "retrieved_chunks"))


def p5_found(spark, d):
    """The items of more than 400 tokens."""
    return splitting.oversized(_items(spark, d), ["src", "item_id"])


def p5_pieces(spark, d):
    """Every item cut into pieces of at most 400 tokens."""
    return splitting.split_column(_items(spark, d), ["src", "item_id"], "text")


def p5_files(spark, d):
    """The texts of documents as large files, cut by byte ranges; with the part number of the file."""
    files = splitting.text_files(table(spark, d, "documents"), "text", f"{checkpoint_dir(spark)}/p5-files-{uuid.uuid4().hex}")
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part")
    return splitting.split_files(files).select(part, "piece_no", "byte_start", "byte_end", "n_tokens", "piece")


def p6_ids(spark, d):
    """doc_id and token ids of every document."""
    return bpe.document_ids(table(spark, d, "documents"), vocabulary=_vocabulary(spark))


def p7_found(spark, d):
    """The documents in which at least half of an evaluation passage stands, with the passage."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark, d):
    """The documents without those in which a passage leaked."""
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    """The documents most of whose words are keywords, tags or links."""
    return spam.spam_pages(table(spark, d, "documents"))


def p8_shares(spark, d):
    """The share of words outside prose and records of every document."""
    return spam.page_shares(table(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p2_main": p2_main, "p3_found": p3_found, "p3_masked": p3_masked, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_files": p5_files, "p6_ids": p6_ids, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found, "p8_shares": p8_shares}

ORACLES = {
    "p5_found": r"""
        with items as (
            select 'corpus_docs' as src, cast(page_id as varchar) || '#' || cast(n.node_order as varchar) as item_id, n.text as text
            from (select page_id, unnest(nodes) as n from corpus_docs)
            union all
            select 'retrieved_chunks', cast(retrieved_id as varchar), text from retrieved_chunks)
        select distinct src, item_id from items
        where text is not null and item_id is not null
          and greatest(1, floor(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}A-Za-z0-9]')) * 1.3)) > 400""",
}
