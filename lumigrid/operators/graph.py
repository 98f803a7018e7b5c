"""Text to knowledge graph: chunks, triples, graph tables, the progress log."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def chunked(documents: DataFrame, target: int = 400, overlap: float = 0.1, least: int = 200, most: int = 2000) -> DataFrame:
    """(doc_id, chunk, text, n_tokens): whole sentences up to a target of estimated tokens.

    A chunk starts again with sentences from the last one's tail within the overlap; a small last chunk joins the
    one before it if that stays within `most`. Documents are streamed, so a partition holds one at a time.
    """
    size = lambda s: len(s) // 4

    def cut(text: str) -> list[str]:
        import re

        parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        out: list[list[str]] = []
        now: list[str] = []
        for s in parts:
            if now and sum(map(size, now)) + size(s) > target:
                out.append(now)
                tail: list[str] = []
                for t in reversed(now):
                    if sum(map(size, tail)) + size(t) > target * overlap:
                        break
                    tail.insert(0, t)
                now = tail
            now = [*now, s]
        if now:
            if out and sum(map(size, now)) < least and sum(map(size, out[-1])) + sum(map(size, now)) <= most:
                out[-1] = out[-1] + [s for s in now if s not in out[-1]]
            else:
                out.append(now)
        return [" ".join(c) for c in out]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, c, size(c)) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, c in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text", "n_tokens"])

    return documents.select("doc_id", "text").mapInPandas(work, f"doc_id {dict(documents.dtypes)['doc_id']}, chunk int, text string, n_tokens int")


def similar(a: Column, b: Column) -> Column:
    """Ratio of matching subsequences of two lower-cased strings."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x.fillna(""), y.fillna(""), strict=True)], dtype=float)

    return ratio(a, b)


def parsed_triples(answers: DataFrame) -> DataFrame:
    """(source_chunk_id, subject, predicate, object, confidence) of JSON lists, or of {triples: [...]} or {data: [...]}; blank parts go."""
    item = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"
    wrapped = F.from_json("answer", f"struct<triples:{item},data:{item}>")
    listed = F.when(F.ltrim("answer").startswith("["), F.from_json("answer", item)).otherwise(F.coalesce(wrapped["triples"], wrapped["data"]))
    rows = answers.select("source_chunk_id", F.explode(listed).alias("t")).select("source_chunk_id", "t.*")
    return rows.where("trim(coalesce(subject, '')) != '' and trim(coalesce(predicate, '')) != '' and trim(coalesce(object, '')) != ''").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def deduplicated(triples: DataFrame) -> DataFrame:
    """Triples by lower-cased key: the first spelling, the iterative pairwise mean of confidences in order, all chunks."""
    key = [F.lower(F.trim(c)).alias(k) for k, c in (("ks", "subject"), ("kp", "predicate"), ("ko", "object"))]
    rows = F.array_sort(F.collect_list(F.struct("seq", "subject", "predicate", "object", "confidence", "source_chunk_id")))
    grouped = triples.groupBy(*key).agg(rows.alias("r"))
    mean = F.aggregate(F.slice("r", 2, F.greatest(F.size("r"), F.lit(1))), F.get("r", 0)["confidence"], lambda m, x: (m + x["confidence"]) / 2)
    first = F.get("r", 0)
    return grouped.select(first["subject"].alias("subject"), first["predicate"].alias("predicate"), first["object"].alias("object"), mean.alias("confidence"), F.array_sort(F.array_distinct(F.transform("r", lambda x: x["source_chunk_id"]))).alias("source_chunks"))


def graph_tables(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct entities, and one edge per (src, rel_type, dst) with the last confidence."""
    nodes = triples.select(F.explode(F.array(T.entity(F.col("subject")), T.entity(F.col("object")))).alias("name")).distinct()
    edges = triples.select(T.entity(F.col("subject")).alias("src"), T.relation_type(F.col("predicate")).alias("rel_type"), T.entity(F.col("object")).alias("dst"), "confidence", "seq")
    return nodes, edges.groupBy("src", "rel_type", "dst").agg(F.max_by("confidence", "seq").alias("confidence"), F.count("*").alias("n"))


def log_summary(log: DataFrame) -> DataFrame:
    """(status, n): log lines by status."""
    return log.groupBy("status").agg(F.count("*").alias("n"))


def unprocessed(items: DataFrame, log: DataFrame, key: str, done: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """The items without a line of a final status."""
    return items.join(log.where(F.col("status").isin(*done)).select(key).distinct(), key, "left_anti")


def last_status(log: DataFrame, key: str, at: str) -> DataFrame:
    """(key, status): each key's last status."""
    return log.groupBy(key).agg(F.max_by("status", at).alias("status"))


def sections(documents: DataFrame, most: int = 2000) -> DataFrame:
    """(doc_id, section, title, text): headed sections, in document order; long ones are cut at paragraph ends."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    heading = F.col("line").rlike(r"^(#{1,6}\s+\S|\d+(\.\d+)*\.?\s+\p{Lu}|[\p{Lu}\d][\p{Lu}\d\s]{3,60}$)")
    w = Window.partitionBy("doc_id").orderBy("at")
    numbered = lines.withColumn("section", F.sum(heading.cast("int")).over(w)).withColumn("size", F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id", "section").orderBy("at")))
    numbered = numbered.withColumn("part", F.floor((F.col("size") - 1) / most).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("doc_id", "section", "part").agg(body.alias("text"), F.min("at").alias("at"))
