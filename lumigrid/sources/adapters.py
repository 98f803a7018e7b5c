"""Data-set adapters: raw question-answering rows to evaluation entries (id, question, answer, paragraphs).

Distractors are drawn in the order of a hash of (query, paragraph), which is a fixed sample whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .corpus import ENTRY, PARAGRAPHS


def _paragraph(idx: Column, title: Column, text: Column, gold: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), title.alias("title"), text.alias("paragraph_text"), gold.cast("boolean").alias("is_supporting"))


def valid(entries: DataFrame) -> DataFrame:
    """Entries with a question and at least one paragraph."""
    return entries.where("id is not null and trim(coalesce(question, '')) != '' and size(paragraphs) > 0")


def counts(entries: DataFrame) -> DataFrame:
    """One row: queries, distinct paragraphs, distinct gold paragraphs."""
    p = entries.select("id", F.explode("paragraphs").alias("p"))
    distinct = p.groupBy("p.title", "p.paragraph_text").agg(F.max(F.col("p.is_supporting").cast("int")).alias("gold"))
    return distinct.agg(F.count("*").alias("n_paragraphs"), F.sum("gold").alias("n_gold")).crossJoin(entries.agg(F.count("*").alias("n_queries")))


def supporting_facts(raw: DataFrame) -> DataFrame:
    """HotpotQA and 2Wiki: a paragraph is gold if its title is among the supporting facts' titles."""
    titles = F.transform("supporting_facts", lambda s: s["title"])
    made = F.transform("context", lambda c, i: _paragraph(i, c["title"], F.array_join(c["sentences"], " "), F.array_contains(titles, c["title"])))
    return raw.select(F.col("id").cast("string").alias("id"), "question", "answer", made.alias("paragraphs"))


def passthrough(raw: DataFrame) -> DataFrame:
    """MuSiQue: valid entries as they are."""
    return valid(raw)


def nonempty(raw: DataFrame) -> DataFrame:
    """PopQA and NQ: paragraphs without text go, and questions without any."""
    return valid(raw.withColumn("paragraphs", F.filter("paragraphs", lambda p: F.trim(F.coalesce(p["paragraph_text"], F.lit(""))) != "")))


def beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, most_gold: int = 5, most_other: int = 15) -> DataFrame:
    """BEIR: up to 5 relevant documents of a query and the first 15 others in corpus order.

    The others of a query are among the first most_other + (its relevant documents) of the corpus, so only that
    prefix, of a size the relevance judgements bound, meets the queries.
    """
    gold = qrels.where("score > 0").join(corpus, qrels["doc_id"] == corpus["_id"]).select("query_id", "doc_id", "title", "text")
    kept = gold.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    bound = gold.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    prefix = corpus.orderBy("_id").limit(most_other + bound)
    others = queries.select(F.col("_id").alias("query_id")).crossJoin(prefix).join(gold.select("query_id", F.col("doc_id").alias("_id")), ["query_id", "_id"], "left_anti")
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("_id"))).where(F.col("r") <= most_other)
    every = kept.where(F.col("r") <= most_gold).select("query_id", F.lit(0).alias("part"), "r", "title", "text").union(others.select("query_id", F.lit(1).alias("part"), "r", "title", "text"))
    lists = every.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "r", "title", "text"))).alias("p"))
    made = F.transform("p", lambda x, i: _paragraph(i, x["title"], x["text"], x["part"] == 0))
    return queries.join(lists, queries["_id"] == lists["query_id"]).select("query_id", F.col("text").alias("question"), made.alias("paragraphs")).select(F.col("query_id").alias("id"), "question", F.lit("").alias("answer"), "paragraphs")


def with_distractors(rows: DataFrame, most: int = 19, seed: int = 42, shares: int = 64) -> DataFrame:
    """Belebele, COVID-QA, DROP: each (id, question, answer, passage) with other passages of its share as distractors.

    Passages are dealt into shares by hash; a query draws from its own share, so no query meets all passages.
    """
    passages = rows.select("passage").distinct()
    shares = F.lit(shares)
    pool = passages.withColumn("share", F.pmod(F.crc32(F.col("passage").cast("binary")), shares))
    asked = rows.withColumn("share", F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), "id").cast("binary")), shares))
    pairs = asked.join(pool.withColumnRenamed("passage", "other"), "share").where("other != passage")
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "other"), "other"))).where(F.col("r") <= most)
    lists = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "other"))).alias("o"))
    made = F.concat(F.array(_paragraph(F.lit(0), F.lit("gold"), F.col("passage"), F.lit(True))), F.transform(F.coalesce("o", F.array().cast("array<struct<r:int,other:string>>")), lambda x: _paragraph(x["r"], F.lit("distractor"), x["other"], F.lit(False))))
    return rows.join(lists, "id", "left").select("id", "question", "answer", made.alias("paragraphs"))


def pubmed(raw: DataFrame) -> DataFrame:
    """PubMedQA: every context is gold if the decision is yes."""
    made = F.transform(F.col("context.contexts"), lambda c, i: _paragraph(i, F.lit(""), c, F.col("final_decision") == "yes"))
    return raw.select(F.col("pubid").cast("string").alias("id"), "question", F.col("long_answer").alias("answer"), made.alias("paragraphs"))


def bioasq(raw: DataFrame) -> DataFrame:
    """BioASQ: distinct snippets; gold if the answer is in the snippet, else the best word overlap of 30 %, else all."""
    low = F.lower("answer")
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3))
    share = lambda s: F.size(F.filter(words, lambda w: F.contains(F.lower(s), w))) / F.greatest(F.size(words), F.lit(1))
    base = raw.withColumn("snippets", F.array_distinct("snippets"))
    base = base.withColumn("inside", F.exists("snippets", lambda s: F.contains(F.lower(s), low))).withColumn("best", F.array_max(F.transform("snippets", share)))
    gold = lambda s: F.when(F.col("inside"), F.contains(F.lower(s), low)).when(F.col("best") >= 0.3, share(s) == F.col("best")).otherwise(True)
    return base.select(F.col("id").cast("string").alias("id"), "question", "answer", F.transform("snippets", lambda s, i: _paragraph(i, F.lit(""), s, gold(s))).alias("paragraphs"))


def chunks(raw: DataFrame, size: int = 5000) -> DataFrame:
    """DocFinQA: chunks of fixed size; gold if they hold the answer; questions whose document lacks it go."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length("context") - 1) / size).cast("int"), F.lit(0))), lambda i: F.substring(F.col("context"), i * size + 1, F.lit(size)))
    made = F.transform(parts, lambda c, i: _paragraph(i, F.lit(""), c, F.contains(c, F.col("answer"))))
    return raw.select(F.col("id").cast("string").alias("id"), "question", "answer", made.alias("paragraphs")).where(F.exists("paragraphs", lambda p: p["is_supporting"]))


def narrative(raw: DataFrame, most: int = 5, each: int = 2) -> DataFrame:
    """NarrativeQA: passages by document; gold if a longer word of the answer occurs, else the first; and distractors.

    raw is (id, question, answer, doc, passages); distractors are the first passages of the next documents by hash.
    """
    words = F.filter(F.split(F.lower("answer"), r"\s+"), lambda w: F.length(w) > 3)
    hit = lambda p: F.exists(words, lambda w: F.contains(F.lower(p), w))
    made = F.transform("passages", lambda p, i: _paragraph(i, F.col("doc"), p, F.when(F.exists("passages", hit), hit(p)).otherwise(i == 0)))
    docs = raw.groupBy("doc").agg(F.first("passages").alias("p")).withColumn("key", F.xxhash64("doc"))
    w = Window.partitionBy(F.pmod("key", F.lit(64))).orderBy("key", "doc")
    ahead = -(-most // each)
    following = docs.select("doc", F.slice(F.flatten(F.filter(F.array(*[F.slice(F.lead("p", k).over(w), 1, each) for k in range(1, ahead + 1)]), lambda x: x.isNotNull())), 1, most).alias("others"))
    extra = F.transform(F.coalesce("others", F.array().cast("array<string>")), lambda p, i: _paragraph(1000 + i, F.lit("distractor"), p, F.lit(False)))
    return raw.join(following, "doc", "left").select(F.col("id").cast("string").alias("id"), "question", "answer", F.concat(made, extra).alias("paragraphs"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "hotpotqa": supporting_facts, "2wiki": supporting_facts, "musique": passthrough, "popqa": nonempty, "nq": nonempty, "beir": beir, "belebele": with_distractors, "covidqa": with_distractors, "drop": with_distractors,
    "pubmedqa": pubmed, "bioasq": bioasq, "docfinqa": chunks, "narrativeqa": narrative,
}


def adapter(name: str) -> Callable[..., DataFrame]:
    """The adapter of a data set; an unknown name is an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown data set {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


__all__ = ["ENTRY", "PARAGRAPHS", "REGISTRY", "adapter", "beir", "bioasq", "chunks", "counts", "narrative", "nonempty", "passthrough", "pubmed", "supporting_facts", "valid", "with_distractors"]
