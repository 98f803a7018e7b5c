"""Benchmark decontamination by training suffix arrays.

Each block of documents (a shard) gets the suffix array of its words, sorted by prefix doubling as deep as
the longest test item. Every suffix of every item is then binary-searched in it: the interval of training
suffixes that agree with it is narrowed word by word until it is empty, which yields the longest verbatim
match and, at the depth of a window, all places where the window occurs. A document lies in one shard, so
no text is shuffled. The test set is read in blocks of bounded size; each block takes one pass, and what several
passes find is put together by row.

Edge cases: null and empty texts have no words and no hit; a very long text is a shard of its own; an item
without words or with a null id has no window; an item of fewer words than a window is one window; repeated
items of one id count once; repeated documents, documents without an id and documents that share an id each get
their own row; of longest matches of one length (ties) the last item by name and then the last place is told;
an empty table gives an empty result; other columns of documents are ignored (`clean` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._flat import ALNUM, LOWER, blocks, flat, ranges, runs, word_hashes, word_spans
from ._shared import small_batches, table

WINDOW = 8
#: Bytes of test text in one block, and so in one broadcast.
TEST_BLOCK = 16_000_000
#: Bytes of documents in one shard (a longer document is a shard of its own).
SHARD = 4_000_000
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, longest int, longest_item string, longest_at bigint, hits array<struct<start:bigint,end:bigint>>"


class SuffixArray:
    """The suffixes of a shard's documents in word order, correct for their first `depth` words."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, depth: int):
        n = len(words)
        self.order = np.argsort(words)
        ordered = words[self.order]
        head = np.ones(n, bool)
        head[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(head)
        self.known = ordered[heads]  #: distinct words, sorted
        place = np.repeat(heads, np.diff(np.append(heads, n)))
        rank = np.empty(n, np.int64)
        rank[self.order] = place
        self.bounds = np.append(heads, n)
        self.ids = np.empty(n + depth + 1, np.int64)  #: number of the word at each position, -1 beyond the end
        self.ids[n:] = -1
        self.ids[self.order] = np.repeat(np.arange(len(heads)), np.diff(self.bounds))
        self.stop = np.repeat(offsets[1:], np.diff(offsets))  #: end of the position's document
        size = np.diff(self.bounds)
        tied = np.repeat(size > 1, size)
        step = 1
        while step < depth and tied.any():
            at = np.flatnonzero(tied)
            who = self.order[at]
            nxt = who + step
            follow = np.where(nxt < self.stop[who], rank[np.minimum(nxt, n - 1)] + 1, 0)
            key = rank[who] * (n + 1) + follow
            sort = np.argsort(key)
            who, key = who[sort], key[sort]
            self.order[at] = who
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(at)))
            rank[who] = np.repeat(at[first], count)
            tied[at] = np.repeat(count > 1, count)
            step *= 2

    def word_at(self, position: np.ndarray, ahead: int) -> np.ndarray:
        """Number of the word `ahead` words after each position, -1 beyond its document."""
        out = self.ids[position + ahead]
        out[position + ahead >= self.stop[position]] = -1
        return out

    def bound(self, low: np.ndarray, high: np.ndarray, ahead: int, target: np.ndarray) -> np.ndarray:
        """For each interval of suffixes, the first one whose word `ahead` is not less than the target."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.word_at(self.order[middle], ahead) < target[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


class TestBlock:
    """Word hashes of a block of items, end to end, and their suffixes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends, self.offsets = word_spans(data, offsets, ALNUM)
        self.names = np.array([i for i, _ in items], object)
        self.order = np.unique(self.names.astype(str), return_inverse=True)[1] if items else np.zeros(0, np.int64)
        self.words = word_hashes(data, starts, ends)
        sizes = np.diff(self.offsets)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.left = np.repeat(self.offsets[1:], sizes) - np.arange(len(self.words))  #: words of each suffix
        need = np.minimum(sizes, window)
        self.need = np.repeat(need, sizes)  #: words of the item's window
        self.depth = int(sizes.max(initial=1))


def search(array: SuffixArray, test: TestBlock) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, suffixes, low, high): after each word, the test suffixes that still occur and where."""
    place = np.searchsorted(array.known, test.words)
    found = np.zeros(len(test.words), bool)
    inside = place < len(array.known)
    found[inside] = array.known[place[inside]] == test.words[inside]
    number = np.where(found, place, -2)
    who = np.flatnonzero(found)
    low, high = array.bounds[place[who]], array.bounds[place[who] + 1]
    depth = 1
    while len(who):
        yield depth, who, low, high
        go = test.left[who] > depth
        who, low, high = who[go], low[go], high[go]
        target = number[who + depth]
        go = target >= 0
        who, low, high, target = who[go], low[go], high[go], target[go]
        low = array.bound(low, high, depth, target)
        high = array.bound(low, high, depth, target + 1)
        go = low < high
        who, low, high = who[go], low[go], high[go]
        depth += 1


def _rows(ids: list, data: np.ndarray, offsets: np.ndarray, test: TestBlock) -> dict[str, list]:
    starts, ends, words_of = word_spans(data, offsets, ALNUM)
    words = word_hashes(data, starts, ends)
    n, docs = len(words), len(ids)
    cover = np.zeros(n + 1, np.int64)
    doc_of = np.repeat(np.arange(docs), np.diff(words_of))
    longest, what, where = np.zeros(docs, np.int64), np.full(docs, -1), np.zeros(docs, np.int64)
    pairs = [np.zeros(0, np.int64)]
    if n and len(test.words):
        array = SuffixArray(words, words_of, test.depth)
        for depth, who, low, high in search(array, test):
            go = depth >= test.need[who]
            who, low, count = who[go], low[go], (high - low)[go]
            place, item = array.order[ranges(low, count)], np.repeat(test.item[who], count)
            window = np.repeat(test.need[who] == depth, count)
            at = place[window]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + depth, -1)
            pairs.append(np.unique(doc_of[at] * len(test.names) + item[window]))
            # The last of a document's places stays.
            last = np.lexsort((place, test.order[item], doc_of[place]))
            inside = doc_of[place[last]]
            longest[inside], what[inside], where[inside] = depth, item[last], place[last] - words_of[inside]
    hit = np.cumsum(cover[:-1]) > 0
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[words_of[1:]] - sums[words_of[:-1]]
    pair = np.unique(np.concatenate(pairs))
    names: list[list[str]] = [[] for _ in ids]
    for d, i in zip(*np.divmod(pair, max(1, len(test.names))), strict=True):
        names[d].append(test.names[i])
    hits: list[list[dict]] = [[] for _ in ids]
    for d in np.flatnonzero(n_hit):
        a, b = runs(hit[words_of[d] : words_of[d + 1]])
        hits[d] = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
    return {
        "doc_id": ids, "n_words": np.diff(words_of).tolist(), "n_hit": n_hit.tolist(), "items": [sorted(set(x)) for x in names],
        "longest": longest.tolist(), "longest_item": [test.names[w] if w >= 0 else None for w in what], "longest_at": [int(x) if w >= 0 else None for x, w in zip(where, what, strict=True)], "hits": hits,
    }


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The items with an id, in blocks of at most `most` bytes of text."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(f"`{id_col}` is not null and `{text_col}` is not null")
    for item, text in rows.toLocalIterator():
        n = len(text.encode()) + 64
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def matches(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, test_block: int = TEST_BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: its words, hit words, the items whose windows occur, the hit runs and the longest match.

    `longest` is the number of words of the longest verbatim match of a test suffix that is at least a window,
    with its item and the word position in the document.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = test_blocks(benchmark, item_col, item_text, test_block) if benchmark is not None else iter(())
    first, second = next(tests, []), next(tests, None)
    if second is None:
        return _passed(docs, first, window)
    # A row is known by its number in a table, whatever its id.
    rows = table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    sizes = table(_passed(rows, [], window, True).select("row", "doc_id", "n_words"), "sizes")
    found = []
    for items in chain((first, second), tests):
        found.append(table(_passed(rows, items, window, True).where("n_hit > 0").drop("doc_id", "n_words"), "hits"))
    return _merged(sizes, found)


def clean(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, test_block: int = TEST_BLOCK, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of any item occurs; one pass for each block of items."""
    spark = documents.sparkSession
    small_batches(spark)
    at = documents.columns.index(text_col)
    out = documents
    for items in test_blocks(benchmark, item_col, item_text, test_block):
        shipped = spark.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            test = TestBlock(shipped.value, window)
            for batch in batches:
                data, offsets = flat(batch.column(at))
                keep = [np.zeros(0, bool)]
                for a, b in blocks(offsets, SHARD):
                    part = LOWER[data[offsets[a] : offsets[b]]]
                    keep.append(np.array(_rows(list(range(a, b)), part, offsets[a : b + 1] - offsets[a], test)["n_hit"]) == 0)
                yield batch.filter(pa.array(np.concatenate(keep)))

        # Each pass is written, so that no task holds more than one block of items.
        out = (out if out is documents else table(out, "clean")).mapInArrow(work, documents.schema)
    return out


def _passed(rows: DataFrame, items: list[tuple[str, str]], window: int, numbered: bool = False) -> DataFrame:
    """One pass of a block of items over rows (doc_id, text, and their `row` if numbered)."""
    shipped = rows.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestBlock(shipped.value, window)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_item", pa.string()), ("longest_at", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] + [("row", pa.int64())] * numbered)
        for batch in batches:
            ids, numbers = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist() if numbered else []
            data, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets, SHARD):
                part = LOWER[data[offsets[a] : offsets[b]]]
                found = _rows(ids[a:b], part, offsets[a : b + 1] - offsets[a], test)
                yield pa.RecordBatch.from_pydict(found | ({"row": numbers[a:b]} if numbered else {}), schema)

    return rows.mapInArrow(work, SCHEMA + ", row bigint" * numbered)


def _merged(sizes: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The rows of `sizes` (row, doc_id, n_words) with what all passes found in them."""
    every = found[0]
    for p in found[1:]:
        every = every.unionByName(p)
    joined = every.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max(F.struct("longest", "longest_item", "longest_at")).alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("spans"),
    )
    # A text's hit runs are at most an eighth of its words, which one row holds anyway.
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) -> "
        "case when size(acc) > 0 and element_at(acc, -1).end >= x.start then "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) "
        "else concat(acc, array(x)) end)"
    )
    whole = sizes.join(joined.withColumn("hits", merged).drop("spans"), "row", "left")
    return whole.select(
        "doc_id", "n_words", F.coalesce(F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.start)"), F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("best.longest"), F.lit(0)).alias("longest"), F.col("best.longest_item").alias("longest_item"), F.col("best.longest_at").alias("longest_at"), F.coalesce("hits", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hits"),
    )


def digest(items: Column) -> Column:
    """sha256 of the sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def contamination(documents: DataFrame, benchmark: DataFrame, *, least_items: int = 2, **options) -> DataFrame:
    """`matches` as counts and digests, and `contaminated`: windows of at least `least_items` items occur."""
    return matches(documents, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest(F.col("items")).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"), "longest", "longest_item", "longest_at"
    )
