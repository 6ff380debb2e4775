"""License texts found by an exact set-similarity join of text blocks with templates. DataFrame operations only.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The blocks of a text for a template
are all runs of one and a half times the template's words, over line ends: a wrapped notice is one block,
and a long line is not. A block matches if it holds at least ``threshold`` of the template's distinct words.
Only blocks that begin with a word of the template are looked at; no other holds more of its words.

The join is exact. A text is first taken as one set of words, which no block of it exceeds:

* words of templates are ranked by the number of texts of the whole corpus that hold them, rare ones
  first; texts are reduced to their ranked template words, which leaves every overlap as it was;
* length: a text with fewer template words than the overlap a template needs can't match it;
* prefix: of a template with ``t`` words that needs ``a``, one of its ``t - a + 1`` rarest must be among the
  text's first ``b - a + 1``, so only those are joined on;
* position: a shared word at places ``i`` and ``j`` leaves at most ``min(t - i, b - j)`` further ones;
* the overlap of the pairs left is computed.

Then the blocks of each pair left are counted, by a range of words in a window over the places of
template words. Prefix words are rare by construction, and a text enters the join once per prefix word, so
a word that very many texts share is no group of its own; equal sets are joined once.

Every matched block labels its text, save where one that begins less than a block's width away holds all
its matched words and is matched better (a greater share, or as great and more words): so ``cc by nc 4.0``
is no ``cc by 4.0``, and a text with several notices has all their labels.

Phrases are places where words stand consecutively in the text. Null and empty texts have no words, no
places and no labels. Repeated rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.operators.ordered import join_hot, null_safe_join
from keystride.params import MAX_BROADCAST_ROWS
from keystride.session import materialize

THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 20_000  # distinct words of all templates, which are held in one array

# Phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Sentences of public licenses and license notices, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2.0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4.0", "cc-by"),
    ("licensed under cc by sa 4.0", "cc-by-sa"),
    ("licensed under cc by nc 4.0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4.0 international license", "cc-by"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)

# The class of characters that are in no word, A-Z aside.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text with one space around each, letters as they are."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, BETWEEN, " ")), F.lit(" "))


def split_words(text: Column) -> Column:
    words = F.split(F.trim(F.translate(F.regexp_replace(text, BETWEEN, " "), UPPER, LOWER)), " ")
    return F.filter(words, lambda w: w != "")


def count_words(text: Column) -> Column:
    """Without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("bigint")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts, from 0, of a phrase among words."""
    wanted = phrase.split(" ")
    last = F.size(words) - len(wanted)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        met = F.get(words, i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            met = met & (F.get(words, i + k) == w)
        return met

    return F.filter(starts, here)


def phrase_columns(docs: DataFrame, text: str, phrases: Sequence[tuple[str, str]]) -> DataFrame:
    """Add ``n_words, n_base, first_word, last_word, base`` (array of labels)."""
    t = F.col(f"`{text}`")
    # Only texts that hold the last word of a phrase are cut into words. (?i) is for A-Z only.
    ends = sorted({p.split(" ")[-1] for p, _ in phrases})
    may = F.coalesce(t.rlike("(?i)" + "|".join(ends)), F.lit(False))
    none = F.array().cast("array<int>")
    out = docs.withColumn("n_words", count_words(t)).withColumn(
        "_words", F.when(may, split_words(t)).otherwise(F.array().cast("array<string>")))
    places = [F.when(F.size("_words") > 0, phrase_places(F.col("_words"), p)).otherwise(none) for p, _ in phrases]
    out = out.withColumn("_places", F.array(*places)).drop("_words")
    all_places = F.flatten("_places")
    labels = F.filter(
        F.array(*[F.when(F.size(F.col("_places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]),
        lambda x: x.isNotNull())
    return out.withColumns({
        "n_base": F.size(all_places).cast("bigint"), "first_word": F.array_min(all_places).cast("bigint"),
        "last_word": F.array_max(all_places).cast("bigint"), "base": F.array_sort(F.array_distinct(labels)),
    }).drop("_places")


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(t).alias("text"), F.lit(label).alias("label"))
                     for i, (t, label) in enumerate(templates)])
    return spark.range(1).select(F.inline(rows))


def width_of(template: str | Column) -> Column:
    """Words of a template's blocks: one and a half times its own."""
    n = F.size(split_words(F.lit(template) if isinstance(template, str) else template))
    return n + F.floor(n / 2).cast("int")


def need_of(size: Column, threshold: float) -> Column:
    """How many of a template's ``size`` distinct words a block must hold."""
    return F.greatest(F.ceil(size * F.lit(threshold) - 1e-9).cast("int"), F.lit(1))


def similarity_join(blocks: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``blocks`` has ``words`` (distinct, any order); returns ``words, template, label, containment, size``.

    ``templates``: ``template, text, label``. Equal word sets are joined once; join back on ``words``.
    """
    # A template's words; templates are a short list, so its tables are small.
    parts = materialize(templates.select("template", "label", F.explode(F.array_distinct(split_words(F.col("text")))).alias("word")))
    # Partial sums leave at most one row per template word and task.
    held = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    order = [F.coalesce("n", F.lit(0)), F.col("word")]
    known = parts.select("word").distinct().join(held, "word", "left")
    if known.count() > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} distinct words")
    ranks = materialize(known.select("word", F.row_number().over(Window.orderBy(*order)).cast("int").alias("rank")))
    ranked = parts.join(ranks, "word").groupBy("template", "label").agg(F.array_sort(F.collect_list("rank")).alias("t"))
    sized = materialize(ranked.withColumn("need", need_of(F.size("t"), threshold)))
    least = sized.agg(F.min("need")).first()[0] or 1
    sets = blocks.where(F.size("words") >= least).select(F.array_sort("words").alias("words")).distinct()
    # Words become ranks by their place in one constant array; template words are few and are arguments.
    in_order = F.split(F.lit(" ".join(r.word for r in ranks.orderBy("rank").collect())), " ")
    placed = materialize(sets.withColumn(
        "b", F.array_sort(F.transform("words", lambda w: F.array_position(in_order, w).cast("int")))))
    block_side = placed.select("words", "b", F.posexplode(F.slice("b", 1, F.size("b") - least + 1)).alias("j", "rank"))
    prefix = F.slice("t", 1, F.size("t") - F.col("need") + 1)
    template_side = sized.select("template", "label", "t", "need", F.posexplode(prefix).alias("i", "rank"))
    fits = F.least(F.size("t") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need")
    long = F.size("b") >= F.col("need")
    met = block_side.join(F.broadcast(template_side), "rank").where(long & fits)
    overlap = F.size(F.array_intersect("t", "b"))
    # A pair meets once for each prefix word it shares.
    return met.where(overlap >= F.col("need")).select(
        "words", "template", "label", (overlap / F.size("t")).alias("containment"), F.size("t").alias("size")).distinct()


def matched_blocks(texts: DataFrame, pairs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, row, start, label, containment`` of the blocks that match and are not part of a better match.

    ``texts`` has ``doc_id, row, text`` (equal rows once), ``pairs`` the ``template`` numbers each text may match.
    """
    table = templates.select(
        "template", "label", F.array_distinct(split_words(F.col("text"))).alias("t"), width_of(F.col("text")).alias("width"))
    table = materialize(table.withColumn("need", need_of(F.size("t"), threshold)))
    widest = table.agg(F.max("width")).first()[0] or 1
    wanted = null_safe_join(pairs, table, ["template"], small=True)  # templates are an argument, so few
    words = table.select(F.explode("t").alias("w")).distinct().agg(F.collect_set("w").alias("all"))
    # A word's place stands beside it; only template words are kept.
    placed = texts.join(F.broadcast(words)).select("doc_id", "row", F.posexplode(F.transform(
        split_words(F.col("text")), lambda w: F.when(F.array_contains(F.col("all"), w), w))).alias("start", "w")).where("w is not null")
    by = ["doc_id", "row"]
    listed = wanted.groupBy(*by).agg(F.collect_list(F.struct("template", "label", "t", "width", "need")).alias("_wanted"))
    met = null_safe_join(placed, listed, by).select(*by, "start", "w", F.explode("_wanted").alias("x")).select(*by, "start", "w", "x.*").where(F.array_contains("t", F.col("w")))
    # In millionths of the template's block, so that one range serves templates of all lengths.
    block = Window.partitionBy(*by, "template").orderBy(F.expr("start * 1000000L div width")).rangeBetween(
        Window.currentRow, 1_000_000 - 500_000 // widest)
    hits = met.withColumn("m", F.collect_set("w").over(block)).where(F.size("m") >= F.col("need")).select(
        *by, "start", F.struct("start", "width", "label", "m", (F.size("m") / F.size("t")).alias("c"), F.size("t").alias("size")).alias("hit"))

    def better(a: Column, b: Column) -> Column:
        more = (b["c"] > a["c"]) | ((b["c"] == a["c"]) & (b["size"] > a["size"]))
        return more & (F.abs(b["start"] - a["start"]) < a["width"]) & (F.size(F.array_except(a["m"], b["m"])) == 0)

    # A hit per template and place at most, in two blocks' width.
    around = Window.partitionBy(*by).orderBy("start").rangeBetween(-widest, widest)
    seen = hits.withColumn("around", F.collect_list("hit").over(around))
    return seen.where(~F.exists("around", lambda b: better(F.col("hit"), b))).select(
        *by, "start", F.col("hit.label").alias("label"), F.col("hit.c").alias("containment"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
         threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document its counts and labels, and the matched blocks.

    First: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``; second:
    ``doc_id, start, label, containment``, ``start`` being the block's first word.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # A row is told by its id and this; rows of one id and text have the same answer.
    rows = rows.withColumn("row", F.xxhash64("text"))
    by = ["doc_id", "row"]
    table = template_table(spark, templates)
    vocabulary = F.array_distinct(F.flatten(F.array(*[split_words(F.lit(t)) for t, _ in templates])))
    sets = rows.select(*by, F.array_sort(F.array_intersect(split_words(F.col("text")), vocabulary)).alias("words"))
    sets = materialize(sets.where(F.size("words") > 0))
    found = materialize(similarity_join(sets, table, threshold).groupBy("words").agg(F.collect_set("template").alias("may")))
    # Equal word sets may be a third of all texts.
    pairs = materialize(join_hot(sets, found, ["words"]).select(*by, "may").distinct())
    few = pairs.count() <= MAX_BROADCAST_ROWS
    texts = null_safe_join(rows, pairs, by, small=few).dropDuplicates(by).select(*by, "text")
    blocks = matched_blocks(texts, pairs.select(*by, F.explode("may").alias("template")), table, threshold)
    blocks = materialize(blocks)
    per_row = materialize(blocks.groupBy(*by).agg(F.collect_set("label").alias("more"), F.max("containment").alias("most")))
    base = phrase_columns(rows, "text", phrases).drop("text")
    # A text may be a third of all rows, under one id.
    joined = join_hot(base, per_row, by, "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    answer = joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), score.alias("score"))
    return answer, blocks.select("doc_id", "start", "label", "containment")
