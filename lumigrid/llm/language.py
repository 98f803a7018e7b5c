"""Language identification by a linear-chain conditional random field over words.

Each word gets a label by forward-backward. Emissions are sums of weights of its character n-grams with the
word's edges in them (so prefixes and suffixes are features of their own), of longer affixes, and of a lexicon
of training words; transitions between languages are learned with them. A document's language is the one
with the largest mean posterior over its words, which is also its score, so that code-switched text shows as
a mixture; `label_words` returns the words' own labels as runs.

Training: a bounded sample of labelled rows (`PER_LANGUAGE` documents of each language, `WORDS` consecutive
words each, chosen by hashes and cut out before anything reaches the driver). Sequences are spliced from stretches of these documents,
so that transitions are seen within and between languages. Weights are fitted on the driver by Adam on the
exact conditional likelihood; its gradient comes from the same forward-backward.

Forward-backward over documents of any length runs by blocks of `STEPS` words: products of the transfer
matrices of each block, then messages across the blocks of a document, then within all blocks at once.

Edge cases: null texts and texts without a letter are `und` with score 0; very long texts are gone through in
blocks of words; of languages with equal posteriors (ties) the first by name is taken; an empty training table
labels everything `und`; an empty table gives an empty result; null ids stay null and are not trained on;
repeated rows get equal rows; other columns are ignored (`accepted` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._flat import U, blocks, flat, ranges, word_hashes, word_spans
from ._shared import small_batches

PER_LANGUAGE, WORDS = 250, 300
#: Characters of a sampled text at most, on average for each of its words.
WORD_CHARS = 20
SEQUENCES, LENGTH, ROUNDS = 1600, 64, 60
STEPS = 64
BLOCK = 1_000_000
UNKNOWN = "und"

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
PAIRS, TRIPLES, AFFIXES, LEXICON = 1 << 16, 1 << 17, 1 << 15, 1 << 17


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        second = data[1:]
        out[1:][(data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


@dataclass
class Words:
    """The words of a block of documents: bytes between single spaces, and hashes."""

    data: np.ndarray
    firsts: np.ndarray  #: place of each word's first byte; the byte before is a space
    lengths: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        data = lower(data)
        starts, ends, words_of = word_spans(data, offsets, LETTERS)
        lengths = ends - starts
        firsts = np.cumsum(lengths + 1) - lengths
        out = np.full(int(lengths.sum()) + len(lengths) + 3, 0x20, np.uint8)
        out[ranges(firsts, lengths)] = data[ranges(starts, lengths)]
        return Words(out, firsts, lengths, word_hashes(data, starts, ends), words_of)


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, triple) code at each byte place from a word's space on; (prefix, suffix) code of each word."""
    d = words.data.astype(np.uint32)
    pair = d[:-2] << 8 | d[1:-1]
    triple = ((d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 17)
    n, last = words.firsts, words.firsts + words.lengths - 1
    prefix = (d[n] << 16 | d[n + 1] << 8 | d[n + 2]) * np.uint32(0x9E3779B1) >> np.uint32(32 - 14)
    suffix = (d[last] << 16 | d[np.maximum(last - 1, 0)] << 8 | d[np.maximum(last - 2, 0)]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 14)
    return pair, triple, prefix, suffix + np.uint32(AFFIXES // 2)


@dataclass
class Model:
    """Weights by label of every feature table, transitions and starts."""

    names: list[str]
    pair: np.ndarray
    triple: np.ndarray
    affix: np.ndarray
    lexicon: np.ndarray
    known: np.ndarray  #: full hash of the training word in each lexicon slot, 0 if none
    transition: np.ndarray
    start: np.ndarray

    @property
    def labels(self) -> int:
        return len(self.start)

    def emissions(self, words: Words) -> np.ndarray:
        """(words, labels) scores."""
        if not len(words.firsts):
            return np.zeros((0, self.labels), np.float32)
        pair, triple, prefix, suffix = features(words)
        each = self.pair[pair]
        each += self.triple[triple]
        out = np.add.reduceat(each, words.firsts - 1, axis=0)
        out += self.affix[prefix]
        out += self.affix[suffix]
        slot = (words.hashes & U(LEXICON - 1)).astype(np.int64)
        known = np.flatnonzero(self.known[slot] == words.hashes)
        out[known] += self.lexicon[slot[known]]
        return out


def posteriors(emissions: np.ndarray, offsets: np.ndarray, transition: np.ndarray, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """(words, labels) marginals of the chain of each document, by forward-backward."""
    n, labels = emissions.shape
    if not n:
        return emissions
    psi = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float32)
    first = offsets[:-1][np.diff(offsets) > 0]
    go = np.exp(transition - transition.max()).astype(np.float32)
    psi[first] *= np.exp(start - start.max())
    sizes = np.diff(offsets)
    held = -(-sizes // steps)
    total = int(held.sum())
    head = np.cumsum(held) - held  # first block of each document
    doc = np.repeat(np.arange(len(sizes)), held)
    index = np.arange(total) - head[doc]
    begin = offsets[:-1][doc] + index * steps
    filled = np.minimum(steps, offsets[1:][doc] - begin)
    by_step = np.argsort(-filled, kind="stable")  # fuller blocks first: at each step a prefix is live
    live = np.searchsorted(-filled[by_step], -np.arange(steps), "left")
    begin, is_first = begin[by_step], index[by_step] == 0
    # Products of transfer matrices; a document's first word takes no transition.
    product = np.broadcast_to(np.eye(labels, dtype=np.float32), (total, labels, labels)).copy()
    for t in range(steps):
        k = live[t]
        if not k:
            break
        now = product[:k] @ go
        if t == 0:
            now[is_first[:k]] = product[:k][is_first[:k]]
        now *= psi[begin[:k] + t][:, None, :]
        now /= now.max(axis=(1, 2), keepdims=True)
        product[:k] = now
    place = np.empty(total, np.int64)
    place[by_step] = np.arange(total)
    # Messages across the blocks of each document, the longest documents first.
    into = np.ones((total, labels), np.float32)
    back = np.ones((total, labels), np.float32)
    order = np.argsort(-held, kind="stable")
    counts = held[order]
    for j in range(1, int(counts[0]) if len(counts) else 0):
        k = int(np.searchsorted(-counts, -j, "left"))
        b = place[head[order[:k]] + j]
        p = place[head[order[:k]] + j - 1]
        message = (into[p][:, None, :] @ product[p])[:, 0]
        into[b] = message / message.max(axis=1, keepdims=True)
    for j in range(int(counts[0]) - 2 if len(counts) else -1, -1, -1):
        k = int(np.searchsorted(-counts, -(j + 1), "left"))
        b = place[head[order[:k]] + j]
        p = place[head[order[:k]] + j + 1]
        message = (product[p] @ back[p][:, :, None])[:, :, 0]
        back[b] = message / message.max(axis=1, keepdims=True)
    out = np.empty((n, labels), np.float32)
    state = into
    for t in range(steps):
        k = live[t]
        if not k:
            break
        now = state[:k] @ go
        if t == 0:
            now[is_first[:k]] = 1
        now *= psi[begin[:k] + t]
        now /= now.max(axis=1, keepdims=True)
        state[:k] = now
        out[begin[:k] + t] = now
    backward = np.ascontiguousarray(go.T)
    state = back
    for t in range(steps - 1, -1, -1):
        k = live[t]
        if not k:
            continue
        at = begin[:k] + t
        out[at] *= state[:k]
        now = (state[:k] * psi[at]) @ backward
        now /= now.max(axis=1, keepdims=True)
        state[:k] = now
    out /= out.sum(axis=1, keepdims=True)
    return out


def _batch_gradient(e: np.ndarray, y: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the mean log likelihood of sequences (count, length) by emissions, transitions and starts."""
    count, length, labels = e.shape
    psi, go = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(transition)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    now = psi[:, 0] * np.exp(start)
    for t in range(length):
        if t:
            now = (now @ go) * psi[:, t]
        now = now / now.sum(axis=1, keepdims=True)
        alpha[:, t] = now
    for t in range(length - 2, -1, -1):
        now = (beta[:, t + 1] * psi[:, t + 1]) @ go.T
        beta[:, t] = now / now.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    onehot = np.eye(labels)[y]
    right = beta[:, 1:] * psi[:, 1:]
    joint = alpha[:, :-1, :, None] * go * right[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    return onehot - gamma, (seen - joint.sum(axis=(0, 1))) / count, (onehot[:, 0] - gamma[:, 0]).sum(axis=0) / count


def train(rows: list[tuple[str, str]], *, sequences: int = SEQUENCES, length: int = LENGTH, rounds: int = ROUNDS, words_each: int = WORDS, seed: int = 7) -> Model:
    """A model of labelled texts (text, language)."""
    names = sorted({name for _, name in rows})
    labels = max(1, len(names))
    zero = lambda n: np.zeros((n, labels), np.float32)
    model = Model(names, zero(PAIRS), zero(TRIPLES), zero(AFFIXES), zero(LEXICON), np.zeros(LEXICON, U), np.zeros((labels, labels)), np.zeros(labels))
    data, offsets = flat(pa.array([t for t, _ in rows], pa.large_string()))
    words = Words.of(data, offsets)
    random = np.random.RandomState(seed)
    n = np.diff(words.offsets)
    use = np.flatnonzero(n > 0)
    if len(names) < 2 or not len(use):
        return model
    # A stretch of at most words_each words of each document; sequences are spliced from parts of them.
    begin = words.offsets[:-1] + (random.rand(len(n)) * np.maximum(n - words_each, 0)).astype(np.int64)
    size = np.minimum(n, words_each)
    label = np.array([names.index(name) for _, name in rows])
    by_label = [use[label[use] == k] for k in range(labels)]
    by_label = [x for x in by_label if len(x)]
    at, y = np.empty((sequences, length), np.int64), np.empty((sequences, length), np.int64)
    for s in range(sequences):
        filled = 0
        while filled < length:
            d = random.choice(by_label[random.randint(len(by_label))])
            take = min(length - filled, int(random.randint(4, length + 1)), int(size[d]))
            from_ = begin[d] + random.randint(size[d] - take + 1)
            at[s, filled : filled + take] = np.arange(from_, from_ + take)
            y[s, filled : filled + take] = label[d]
            filled += take
    known, first, inverse = np.unique(words.hashes[at.ravel()], return_index=True, return_inverse=True)
    chosen = at.ravel()[first]
    own = Words(words.data, words.firsts[chosen], words.lengths[chosen], known, np.array([0, len(chosen)]))
    pair, triple, prefix, suffix = features(own)
    places = ranges(own.firsts - 1, own.lengths + 1)
    heads = np.cumsum(own.lengths + 1) - own.lengths - 1
    owner = np.repeat(np.arange(len(chosen)), own.lengths + 1)
    slot = (known & U(LEXICON - 1)).astype(np.int64)
    common = np.bincount(inverse.ravel(), minlength=len(known)) > 1
    model.known[slot[common]] = known[common]
    in_lexicon = model.known[slot] == known
    columns = [(model.pair, pair[places], owner), (model.triple, triple[places], owner), (model.affix, prefix, None), (model.affix, suffix, None), (model.lexicon, slot[in_lexicon], np.flatnonzero(in_lexicon))]
    tables = [model.pair, model.triple, model.affix, model.lexicon, model.transition, model.start]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in tables]
    for step in range(1, rounds + 1):
        e = np.add.reduceat(model.pair[pair[places]] + model.triple[triple[places]], heads, axis=0)
        e += model.affix[prefix] + model.affix[suffix]
        e[in_lexicon] += model.lexicon[slot[in_lexicon]]
        by_word, by_pair, by_start = _batch_gradient(e[inverse.ravel()].reshape(sequences, length, labels).astype(np.float64), y, model.transition, model.start)
        each = np.stack([np.bincount(inverse.ravel(), by_word[:, :, k].ravel(), len(known)) for k in range(labels)], axis=1) / sequences
        gradients = {id(t): np.zeros(t.shape) for t in tables}
        gradients[id(model.transition)], gradients[id(model.start)] = by_pair, by_start
        for table, code, who in columns:
            g = each if who is None else each[who]
            for k in range(labels):
                gradients[id(table)][:, k] += np.bincount(code, g[:, k], len(table))
        for t, (m, v) in zip(tables, moments, strict=True):
            g = gradients[id(t)] - 1e-4 * t
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def sample(documents: DataFrame, *, per_language: int = PER_LANGUAGE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Stretches of at most `words` words of at most per_language labelled documents of every language, by order of a hash of the id.

    Of rows that repeat an id and a language, one stretch is taken.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    keyed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("key"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    ids = keyed.withColumn("place", place).where(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    # At most per_language ids of each language, so they may be broadcast.
    chosen = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    spaced = F.split("text", r"[\x20\x09-\x0D]+")
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.size("spaced") - words, F.lit(0)) + 1).cast("int")
    cut = F.substring(F.array_join(F.slice("spaced", begin + 1, words), " "), 1, words * WORD_CHARS)
    stretches = chosen.select("doc_id", "lang", spaced.alias("spaced")).groupBy("lang", "doc_id").agg(F.min(cut).alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(stretches, key=lambda r: (r.lang, r.doc_id))]


def fit(documents: DataFrame, **options) -> Model:
    """A model of a bounded sample of labelled documents."""
    return train(sample(documents, **options))


def predict(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, n_switches (changes of label between its words)."""
    return _apply(documents, model, id_col, text_col, False)


def label_words(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`predict` with `runs`: for each stretch of words of one label its first word, words and language."""
    return _apply(documents, model, id_col, text_col, True)


def _judged(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, posteriors, whether spelled, label, score) of a block of documents; labels past the last are `und`."""
    docs = len(offsets) - 1
    words = Words.of(data, offsets)
    gamma = posteriors(model.emissions(words), words.offsets, model.transition, model.start)
    n = np.diff(words.offsets)
    spelled = _has_letter(data, offsets) & (len(model.names) > 0)
    sums = np.zeros((docs, model.labels))
    full = np.flatnonzero(n)
    if len(full):
        sums[full] = np.add.reduceat(gamma, words.offsets[:-1][full], axis=0, dtype=np.float64)
    best = sums.argmax(axis=1)
    score = np.where(spelled, sums[np.arange(docs), best] / np.maximum(n, 1), 0.0).clip(0, 1)
    return words, gamma, spelled, np.where(spelled, best, len(model.names)), score


def accepted(documents: DataFrame, model: Model, *, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that have a language with at least this score.

    A model of no language (no document had a label) judges none: every document that has a letter stays.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            data, offsets = flat(batch.column(at))
            keep = []
            for a, b in blocks(offsets, BLOCK):
                if not m.names:
                    keep.append(_has_letter(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    continue
                _, _, spelled, _, score = _judged(m, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep.append(spelled & (score >= least))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(work, documents.schema)


def _apply(documents: DataFrame, model: Model, id_col: str, text_col: str, with_runs: bool) -> DataFrame:
    spark = documents.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    run = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_switches", pa.int64())] + [("runs", pa.list_(run))] * with_runs)
    ddl = "doc_id bigint, lang_pred string, score double, n_switches bigint" + ", runs array<struct<first_word:bigint,words:bigint,lang:string>>" * with_runs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names = np.array([*m.names, UNKNOWN], object)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets, BLOCK):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, gamma, spelled, best, score = _judged(m, part, own)
                n = np.diff(words.offsets)
                full = np.flatnonzero(n)
                label = gamma.argmax(axis=1) if len(gamma) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(b - a), n)
                change = np.flatnonzero((label[1:] != label[:-1]) & (doc[1:] == doc[:-1])) + 1
                switches = np.bincount(doc[change], minlength=b - a) if len(change) else np.zeros(b - a, np.int64)
                columns = [batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score), pa.array(switches.astype(np.int64))]
                if with_runs:
                    heads = np.unique(np.concatenate((words.offsets[:-1][full], change)))
                    ends = np.append(heads[1:], len(label))
                    lists: list[list[dict] | None] = [[] for _ in range(b - a)]
                    for h, e in zip(heads, ends, strict=True):
                        if spelled[doc[h]]:
                            lists[doc[h]].append({"first_word": int(h - words.offsets[doc[h]]), "words": int(e - h), "lang": m.names[label[h]]})
                    columns.append(pa.array(lists, pa.list_(run)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, ddl)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain = np.concatenate(([0], np.cumsum(LETTERS[data] & (data < 0x80))))[offsets]
    wide = np.concatenate(([0], np.cumsum(data >= 0x80)))[offsets]
    out = plain[1:] > plain[:-1]
    for d in np.flatnonzero(~out & (wide[1:] > wide[:-1])):
        out[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode())
    return out
