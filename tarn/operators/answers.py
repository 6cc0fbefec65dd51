"""Entities, conversation context, extraction, grounding and evaluation over batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.session import kept


def name_variants(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, variant, first, words): the first two or more words of each name, six characters at least, without stop words."""
    words = X.terms(F.col(name))
    rows = names.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("key"), words.alias("w")).where(F.size("w") >= 2).distinct()
    cut = rows.select("key", "w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("n")).select("key", F.array_join(F.slice("w", 1, F.col("n")), " ").alias("variant"), F.element_at("w", 1).alias("first"), F.col("n").alias("words"))
    return cut.where(F.length("variant") >= 6).distinct()


def longest_entities(texts: DataFrame, ident: str, text: str, variants: DataFrame) -> DataFrame:
    """(ident, key, variant): for each text and entity the longest variant it names, on word boundaries.

    Texts meet variants by the variant's first two words, not each with each: a hash join on two-word windows.
    """
    rows = texts.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident), X.terms(F.col(text)).alias("w")).where(F.size("w") >= 2)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))
    seen = rows.select(ident, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t"), F.explode_outer(pairs).alias("pair"))  # outer: no inferred filter that would build the pairs twice
    keyed = variants.withColumn("pair", F.array_join(F.slice(F.split("variant", " "), 1, 2), " "))
    hits = seen.join(keyed, "pair").where(F.contains("t", F.concat(F.lit(" "), F.col("variant"), F.lit(" "))))
    return hits.groupBy(ident, "key").agg(F.max(F.struct(F.length("variant").alias("n"), F.col("variant").alias("v"))).alias("b")).select(ident, "key", F.col("b.v").alias("variant"))


def remembered(messages: DataFrame, conversation: str, order: list[str], entity: str, reach: int = 10) -> DataFrame:
    """messages with `context`: the own entity, else the last one within the `reach` messages before.

    Messages are range-partitioned by conversation and order, so a conversation of any length is spread over tasks;
    what a task needs of those before it is the last `reach` entities of each, a small table.
    """
    spark = messages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(messages.repartitionByRange(tasks, conversation, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(conversation, "_part").orderBy(*order)
    back = Window.partitionBy(conversation, "_part").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = rows.withColumn("_b", F.row_number().over(back)).where(F.col("_b") <= reach).groupBy(conversation, "_part").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("n"), F.col(entity).alias("e")))), lambda x: x["e"]).alias("_tail"))
    earlier = Window.partitionBy(conversation).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    halo = tails.withColumn("_halo", F.flatten(F.collect_list("_tail").over(earlier))).select(F.col(conversation).alias("_c"), F.col("_part").alias("_p"), "_halo")
    numbered = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_near", F.last(entity, ignorenulls=True).over(inside.rowsBetween(-reach, -1)))
    joined = numbered.join(halo, numbered[conversation].eqNullSafe(halo["_c"]) & (numbered["_part"] == halo["_p"]), "left")
    open_places = F.greatest(F.lit(0), reach + 1 - F.col("_n"))
    seen = F.filter(F.slice("_halo", F.greatest(F.lit(1), F.size("_halo") - open_places + 1), open_places), lambda e: e.isNotNull())
    far = F.when((open_places > 0) & (F.size("_halo") > 0), F.try_element_at(seen, F.lit(-1)))
    return joined.withColumn("context", F.coalesce(F.col(entity), F.col("_near"), far)).select(*messages.columns, "context")


def missing_numbers(asked: DataFrame, texts: DataFrame, key: str, question: str, text: str) -> DataFrame:
    """(key, missing): the numbers of each question that none of the key's texts states, sorted; none if it has no text.

    Numbers meet by a join on (key, number), so a key with very many texts is spread and pre-aggregated, never gathered.
    """
    stated = texts.where(F.col(text).isNotNull()).select(key, F.explode(X.numbers(F.col(text))).alias("_n")).distinct()
    has_text = texts.where(F.col(text).isNotNull()).select(key).distinct()
    wanted = asked.select(key, F.explode(X.numbers(F.col(question))).alias("_n"))
    lacking = wanted.join(has_text, key, "left_semi").join(stated, [key, "_n"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("_n")).alias("missing"))
    return asked.select(key).join(lacking, key, "left").select(key, F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def ungrounded(answer: Column, context: Column) -> Column:
    """The numbers of the answer that its context does not have, sorted; none if there is no context."""
    return F.when(context.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(X.numbers(answer), X.numbers(context))))


def extraction_score(question: Column, text: Column) -> Column:
    """Points of a chunk for a question: shared content terms, a fact's form, less for a bare date."""
    shared = F.size(F.array_intersect(X.content_terms(question), F.array_distinct(X.terms(text))))
    return shared * 1.5 + F.when(X.label_half(text) != "", 1.0).otherwise(0.0) - F.when(X.is_date_only(X.value_half(text)), 2.0).otherwise(0.0)


def rendered(text: Column) -> Column:
    """A chunk as an answer: `Label: value.` or the first two sentences, quoted."""
    label, value = X.label_half(text), X.value_half(text)
    row = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1_000), F.lit(": "), value)
    return X.quote(F.when((label != "") & (F.length(text) <= 120), row).otherwise(X.clip_sentences(text, 2)))


def rate(flag: Column) -> Column:
    """Per cent of the flags that are not null, one decimal."""
    return F.round(100 * F.avg(flag.cast("double")), 1)


def best_chunk(ranked: DataFrame, question: str, text: str, ident: str) -> DataFrame:
    """The chunk of the highest extraction score of each question; the smaller id wins ties."""
    scored = ranked.withColumn("points", F.round(extraction_score(F.col(question), F.col(text)), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("points"), ident)
    return scored.withColumn("place", F.row_number().over(order))


def source_rollup(fetches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fetches, pages and distinct labels of each publisher."""
    labels = nodes.where("label is not null").select("page_id", "label").distinct()
    return fetches.select("page_id", "publisher").distinct().join(labels, "page_id", "left").groupBy("publisher").agg(F.count_distinct("page_id").alias("pages"), F.count_distinct("label").cast("int").alias("labels"))
