"""Readers and writers: corpora, vocabularies, entries, fingerprints, graphs. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

PARAGRAPHS = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
ENTRY = f"id string, question string, answer string, paragraphs {PARAGRAPHS}"
PHRASE_TABLE = "phrase string, fingerprint_vector array<float>, grid_size int, frequency int, context_count int, metadata string"
DOCUMENT_TABLE = "context_id string, title string, text string, fingerprint_vector array<float>, grid_size int, matched_phrases int, total_phrases int, coverage float, metadata string"


def parsed_corpus(lines: DataFrame) -> DataFrame:
    """(doc_id, text) of `id, text` lines (value); lines without a comma go."""
    return lines.where(F.col("value").contains(",")).select(F.trim(F.split("value", ",", 2)[0]).alias("doc_id"), F.trim(F.split("value", ",", 2)[1]).alias("text"))


def read_corpus(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """A corpus file; with last_wins the last line of each id in file order stays."""
    lines = spark.read.text(path)
    if not last_wins:
        return parsed_corpus(lines)
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    parsed = placed.where(F.col("value").contains(",")).select(F.trim(F.split("value", ",", 2)[0]).alias("doc_id"), F.trim(F.split("value", ",", 2)[1]).alias("text"), "file", "at")
    return parsed.groupBy("doc_id").agg(F.max_by("text", F.struct("file", "at")).alias("text"))


def joined_lines(lines: DataFrame, start: str = r"^doc_[^,]*,") -> DataFrame:
    """(doc_id, text) of lines (file, at, value) in which a document goes on until the next line that starts one."""
    w = Window.partitionBy("file").orderBy("at")
    numbered = lines.withColumn("n", F.sum(F.col("value").rlike(start).cast("int")).over(w)).where("n > 0")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: F.trim(x["value"])), " ")
    return parsed_corpus(numbered.groupBy("file", "n").agg(parts.alias("value")).select("value"))


def read_vocabulary(spark: SparkSession, path: str, min_freq: int = 0) -> DataFrame:
    """(phrase, df) of a two-column CSV; short or malformed rows go."""
    raw = spark.read.csv(path, schema="phrase string, df bigint", header=True, mode="DROPMALFORMED")
    return raw.where(F.col("phrase").isNotNull() & F.col("df").isNotNull() & (F.col("df") >= min_freq))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """vocabulary as CSV, most frequent first (a range-partitioned sort)."""
    vocab.orderBy(F.desc("df"), "phrase").write.csv(path, header=True, mode="overwrite")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation entries of JSON lines."""
    return spark.read.schema(ENTRY).json(path)


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a BEIR folder."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, score int")
    return corpus, queries, qrels


def packed_fingerprints(fingerprints: DataFrame, size: int) -> DataFrame:
    """(id, packed): fingerprints as JSON of coordinates and values; empty ones go."""
    from ..functions import grid

    pair = F.struct(grid.morton_x(F.col("cell")).alias("x"), grid.morton_y(F.col("cell")).alias("y"), F.col("val").alias("v"))
    rows = F.array_sort(F.collect_list(pair))
    return fingerprints.where("val != 0").groupBy("id").agg(rows.alias("r")).select("id", F.to_json(F.struct(F.transform("r", lambda p: F.array(p["x"], p["y"])).alias("coordinates"), F.transform("r", lambda p: p["v"]).alias("values"))).alias("packed"))


def unpacked_fingerprints(packed: DataFrame) -> DataFrame:
    """(id, cell, val) of packed fingerprints."""
    from ..functions import grid

    parsed = packed.select("id", F.from_json("packed", "coordinates array<array<int>>, values array<double>").alias("p"))
    rows = parsed.select("id", F.explode(F.arrays_zip("p.coordinates", "p.values")).alias("z"))
    return rows.select("id", grid.morton(F.get(F.col("z.coordinates"), 0), F.get(F.col("z.coordinates"), 1)).alias("cell"), F.col("z.values").alias("val"))


def document_rows(documents: DataFrame) -> DataFrame:
    """(context_id, title, text): the title stands before the first colon and space."""
    at = F.instr("text", ": ")
    return documents.select(F.col("doc_id").cast("string").alias("context_id"), F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise("").alias("title"), F.when(at > 0, F.substring(F.col("text"), at + 2, F.length("text"))).otherwise(F.col("text")).alias("text"))


def store_table(rows: DataFrame, path: str, schema: str) -> None:
    """Rows as Parquet of a declared schema."""
    declared = T._parse_datatype_string(schema)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in declared.fields]).write.mode("overwrite").parquet(path)


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of tables, and their total."""
    every = None
    for name, t in tables.items():
        row = t.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        every = row if every is None else every.unionByName(row)
    return every.unionByName(every.agg(F.lit("total").alias("name"), F.sum("n").alias("n")))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id) of a JSON map {qid: [doc ids]}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("qid", "ids")).select("qid", F.explode("ids").alias("doc_id"))


def write_results(results: DataFrame, path: str) -> None:
    """[{query, results, metadata}] as JSON lines."""
    rows = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("results"))
    rows.select(F.col("qid").alias("query"), F.transform("results", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["score"].alias("score"))).alias("results")).write.mode("overwrite").json(path)


def merged_settings(defaults: dict, dataset: dict, drop: tuple[str, ...] = ("description", "max_queries")) -> dict:
    """Defaults overridden by a data set's settings, without what describes it."""
    return {**defaults, **{k: v for k, v in dataset.items() if v is not None and k not in drop}}


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The texts whose sha-256 is not in the cache (key, ...)."""
    return texts.withColumn("key", F.sha2("text", 256)).join(cache.select("key"), "key", "left_anti")
