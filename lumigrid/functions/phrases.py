"""Phrase normalisation by rules: tags from word forms, lemmas, structure. Distinct phrases go through it once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text import ACRONYMS, STOP_WORDS

#: Irregular lemmas and closed-class words of the rule tagger.
IRREGULAR = {"children": "child", "men": "man", "women": "woman", "people": "person", "mice": "mouse", "feet": "foot", "teeth": "tooth", "data": "data", "analyses": "analysis", "indices": "index"}
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "some", "any", "each", "every")
VERBS = ("is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "can", "will", "would", "should", "may", "might", "must", "go", "goes", "went", "make", "makes", "made", "take", "takes", "took", "use", "uses")


def tag(word: str) -> str:
    """A part of speech from the word's form: DT, VB, VBG, VBN, RB, JJR, JJ or NN."""
    if word in DETERMINERS:
        return "DT"
    if word in VERBS:
        return "VB"
    for end, kind in (("ing", "VBG"), ("ed", "VBN"), ("ly", "RB"), ("est", "JJR"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ic", "JJ")):
        if word.endswith(end) and len(word) > len(end) + 2:
            return kind
    return "NN"


def lemma(word: str, kind: str = "NN") -> str:
    """A word's base form by rules."""
    if word in IRREGULAR or kind not in ("NN", "VB"):
        return IRREGULAR.get(word, word)
    for end, new in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh")):
        if word.endswith(end) and len(word) > len(end) + 1:
            return word[: -len(end)] + new
    if word.endswith("s") and not word.endswith(("ss", "us", "is")) and len(word) > 3:
        return word[:-1]
    return word


def valid_structure(kinds: list[str]) -> bool:
    """Not verbs or adverbs alone; several words end with a noun."""
    if not kinds or all(k in ("VB", "RB") for k in kinds):
        return False
    return len(kinds) == 1 or kinds[-1] in ("NN", "VBG")


def normalise(phrase: str | None) -> str | None:
    """A phrase without determiners, stop words and punctuation, in base forms; null if a verb or the structure rules it out."""
    words = [w.strip("\"'.,;:!?()[]{}") for w in (phrase or "").lower().split()]
    kept: list[tuple[str, str]] = []
    for w in words:
        kind = tag(w)
        if kind == "VB":
            return None
        if w and kind != "DT" and (w in ACRONYMS or w not in STOP_WORDS):
            kept.append((w, "JJ" if kind == "JJR" else kind))
    if not valid_structure([k for _, k in kept]):
        return None
    return " ".join(lemma(w, k) for w, k in kept)


def normalised(phrases: DataFrame, column: str) -> DataFrame:
    """phrases with `normal`: each distinct phrase is normalised once and joined back."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({column: batch[column], "normal": [normalise(p) for p in batch[column]]})

    mapped = phrases.select(column).distinct().mapInPandas(work, f"{column} string, normal string")
    return phrases.join(mapped, column, "left")


def detected(text: Column, terms: list[str]) -> Column:
    """Glossary terms in a text, the longest first, each consuming what it covers."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            low, out = (t or "").lower(), []
            for term in ordered:
                if term in low:
                    out.append(term)
                    low = low.replace(term, "\0")
            return out

        return texts.map(one)

    return find(text)


def glossary_candidates(phrases: DataFrame, column: str, most: int = 500) -> DataFrame:
    """Distinct lower-case phrases of three and more characters; if there are more than `most`, those of most words, then longest."""
    low = phrases.select(F.lower(F.trim(column)).alias("phrase")).where(F.length("phrase") >= 3).distinct()
    spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    return low.orderBy(F.desc(spaces), F.desc(F.length("phrase")), "phrase").limit(most)


def corpus_expanded(documents: DataFrame, glossary: DataFrame) -> DataFrame:
    """(doc_id, text): documents that have a variant of a glossary group get the group's missing variants appended.

    glossary is (canonical, synonym), a stated list that is held against all documents.
    """
    variants = glossary.select("canonical", F.col("synonym").alias("variant")).union(glossary.select("canonical", F.col("canonical").alias("variant"))).distinct()
    groups = variants.groupBy("canonical").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    low = F.lower("text")
    hit = documents.join(groups, F.exists("variants", lambda v: F.contains(low, v)))
    missing = hit.select("doc_id", F.explode(F.filter("variants", lambda v: ~F.contains(low, v))).alias("v")).groupBy("doc_id").agg(F.array_sort(F.collect_set("v")).alias("added"))
    return documents.join(missing, "doc_id", "left").select("doc_id", F.concat_ws(" ", "text", F.array_join("added", " ")).alias("joined")).select("doc_id", F.rtrim("joined").alias("text"))
