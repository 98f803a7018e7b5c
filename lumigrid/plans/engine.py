"""The engine: index a corpus, search whole query sets, evaluate. Steps are DataFrames; step boundaries can be Parquet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bm25, evaluate, fingerprints as fp, fusion, index, query as Q, similarity


@dataclass
class Settings:
    """Parameters of indexing and searching."""

    grid_size: int = 64
    sigma: float = 0.0
    min_df: int = 2
    max_df: int = 0
    phrase_words: int = 2
    spreading_steps: int = 1
    decay: float = 0.5
    doc_norm: str = "sqrt_nnz"
    fusion: str = "rrf"
    top_k: int = 10
    signal_k: int = 100


@dataclass
class Index:
    """The tables of an index."""

    documents: DataFrame
    vocabulary: DataFrame
    postings: DataFrame
    coordinates: DataFrame
    phrases: DataFrame
    fingerprints: DataFrame
    settings: Settings = field(default_factory=Settings)


class Engine:
    """Index, search and evaluate with one session."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, folder: str | None = None):
        self.spark, self.settings, self.folder = spark, settings or Settings(), folder

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        if not self.folder:
            return df
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def index(self, documents: DataFrame, coordinates: DataFrame | None = None) -> Index:
        """An index of (doc_id, text). Without coordinates documents are placed by a hash of their rarest phrase."""
        s = self.settings
        postings = index.phrase_postings(documents, s.phrase_words)
        vocab = self._step(index.vocabulary(postings, s.min_df, s.max_df), "vocabulary")
        kept = self._step(postings.join(vocab.select("phrase"), "phrase", "left_semi"), "postings")
        if coordinates is None:
            coordinates = self.hashed_places(kept, vocab)
        phrases = self._step(index.phrase_fingerprints(kept, coordinates, s.grid_size, s.sigma), "phrases")
        prints = self._step(index.document_fingerprints(kept, phrases), "fingerprints")
        return Index(documents, vocab, kept, coordinates, phrases, prints, s)

    def hashed_places(self, postings: DataFrame, vocab: DataFrame) -> DataFrame:
        """(doc_id, x, y): documents whose rarest phrase is the same share a cell; a placement in one pass."""
        g = self.settings.grid_size
        rare = postings.join(vocab, "phrase").groupBy("doc_id").agg(F.min(F.struct("df", "phrase")).alias("r"))
        cell = F.pmod(F.crc32(F.col("r.phrase").cast("binary")), F.lit(g * g))
        return rare.select("doc_id", (cell % g).cast("int").alias("x"), F.floor(cell / g).cast("int").alias("y"))

    def query_prints(self, built: Index, queries: DataFrame) -> DataFrame:
        """Fingerprints of (qid, text) queries: their phrases in the vocabulary, spread."""
        s = self.settings
        words = queries.select(F.col("qid").alias("doc_id"), "text")
        phrases = index.phrase_postings(words, s.phrase_words).select(F.col("doc_id").alias("qid"), "phrase", F.lit(1.0).alias("downweight"))
        prints = Q.query_fingerprints(phrases, built.phrases)
        return fp.spread(prints, s.grid_size, s.spreading_steps, s.decay) if s.spreading_steps else prints

    def search(self, built: Index, queries: DataFrame, name: str | None = None) -> DataFrame:
        """(qid, doc_id, score, rank): the fingerprint ranking fused with BM25, for all queries in one plan."""
        s = self.settings
        sparse = similarity.ranked(self.query_prints(built, queries), built.fingerprints, s.doc_norm, 1e-12, s.signal_k)
        lexical = bm25.scores(built.documents, queries, query_id="qid")
        lexical = similarity.top(lexical.withColumn("score", F.round("score", 6)), "qid", "score", "doc_id", s.signal_k)
        return fusion.fused(sparse.withColumn("score", F.round("score", 6)).select("qid", "doc_id", "score"), lexical.select("qid", "doc_id", "score"), name or s.fusion, s.top_k)

    def evaluate(self, ranking: DataFrame, gold: DataFrame) -> DataFrame:
        """Metrics of each query."""
        return evaluate.per_query(ranking, gold)


__all__ = ["Engine", "Index", "Settings"]
