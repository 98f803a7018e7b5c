"""Adapters, phrases, query-side and graph operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lumigrid.functions import phrases
from lumigrid.operators import evaluate, fingerprints as fp, fusion, graph, index, query as Q, rerank, similarity as S, stats
from lumigrid.sources import adapters, corpus


@pytest.mark.parametrize(
    ("phrase", "want"),
    [("the red cars", "red car"), ("Studies", "study"), ("is going", None), ("quickly", None), ("running quickly", None), ("", None), (None, None), ("children", "child"), ("a glass of wine", "glass wine"), ("GPU!", "gpu")],
)
def test_normalise(phrase, want):
    assert phrases.normalise(phrase) == want


def test_phrase_tables(spark):
    df = spark.createDataFrame([("The red cars",), ("The red cars",), ("is going",)], "p string")
    assert sorted(str(r.normal) for r in phrases.normalised(df, "p").collect()) == ["None", "red car", "red car"]
    found = spark.createDataFrame([("new york city and york",), (None,)], "t string").select(phrases.detected(F.col("t"), ["york", "new york city"]).alias("d")).collect()
    assert [r.d for r in found] == [["new york city", "york"], []]
    docs = spark.createDataFrame([(1, "a Car here"), (2, "none"), (3, None)], "doc_id int, text string")
    glossary = spark.createDataFrame([("car", "auto"), ("car", "vehicle")], "canonical string, synonym string")
    assert {r.doc_id: r.text for r in phrases.corpus_expanded(docs, glossary).collect()} == {1: "a Car here auto vehicle", 2: "none", 3: ""}


def test_distractors(spark):
    rows = spark.createDataFrame([(str(i), f"q{i}", "a", f"passage {i}") for i in range(300)], "id string, question string, answer string, passage string")
    out = adapters.with_distractors(rows, 3, shares=8)
    for r in out.collect():
        gold = [p.paragraph_text for p in r.paragraphs if p.is_supporting]
        assert gold == [f"passage {r.id}"] and len(r.paragraphs) == 4 and len({p.paragraph_text for p in r.paragraphs}) == 4
    assert out.orderBy("id").collect() == adapters.with_distractors(rows.repartition(7), 3, shares=8).orderBy("id").collect()
    c = adapters.counts(out).first()
    assert (c.n_queries, c.n_gold) == (300, 300)


def test_question_sets(spark):
    raw = spark.createDataFrame([("1", "q", "yes indeed", ["It is yes indeed so", "no", "no"])], "id string, question string, answer string, snippets array<string>")
    assert [p.is_supporting for p in adapters.bioasq(raw).first().paragraphs] == [True, False]
    raw = spark.createDataFrame([("1", "q", "words matter greatly", ["some words matter", "no"])], "id string, question string, answer string, snippets array<string>")
    assert [p.is_supporting for p in adapters.bioasq(raw).first().paragraphs] == [True, False]
    raw = spark.createDataFrame([("1", "q", "42", "x" * 5000 + " 42 end"), ("2", "q", "none", "x")], "id string, question string, answer string, context string")
    out = adapters.chunks(raw).collect()
    assert len(out) == 1 and [p.is_supporting for p in out[0].paragraphs] == [False, True]
    raw = spark.createDataFrame([("1", "q", "l", "yes", (["a", "b"],)), ("2", "q", "l", "no", (["a"],))], "pubid string, question string, long_answer string, final_decision string, context struct<contexts:array<string>>")
    assert {r.id: [p.is_supporting for p in r.paragraphs] for r in adapters.pubmed(raw).collect()} == {"1": [True, True], "2": [False]}
    raw = spark.createDataFrame([("1", "q", "the whale", "d1", ["a whale swims", "other"]), ("2", "q", "zzzz", "d2", ["first", "second"])], "id string, question string, answer string, doc string, passages array<string>")
    got = {r.id: [p.is_supporting for p in r.paragraphs if p.title != "distractor"] for r in adapters.narrative(raw).collect()}
    assert got == {"1": [True, False], "2": [True, False]}
    p = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    e = spark.createDataFrame([("1", "q", "a", [(0, "T", "x", True), (1, "U", " ", False)]), ("2", " ", "a", [(0, "T", "x", True)]), ("3", "q", "a", [])], f"id string, question string, answer string, paragraphs {p}")
    assert [(r.id, len(r.paragraphs)) for r in adapters.nonempty(e).collect()] == [("1", 1)] and adapters.passthrough(e).count() == 1


def test_query_side(spark):
    queries = spark.createDataFrame([(1, "the car stops"), (2, "nothing")], "qid int, text string")
    glossary = spark.createDataFrame([("car", "auto", 0.5), ("car", "vehicle", 0.5), ("stops", "halts", 0.5), ("stops", "car", 0.5), ("stops", "ends", 0.5)], "canonical string, synonym string, weight double")
    got = {r.qid: (r.expanded, r.added) for r in Q.glossary_expanded(queries, glossary).collect()}
    assert got == {1: ("the car stops auto vehicle ends", ["auto", "vehicle", "ends"]), 2: ("nothing", [])}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], "parent string, child string")
    assert {(r.related, r.distance) for r in Q.tree_related(spark.createDataFrame([("a",)], "term string"), edges).collect()} == {("b", 1), ("e", 1)}
    direct = spark.createDataFrame([(1, "x")], "qid int, phrase string")
    more = spark.createDataFrame([(1, "x", 1.0), (1, "y", 0.5)], "qid int, phrase string, similarity double")
    assert {r.phrase: round(r.weight, 6) for r in Q.merged_weights(direct, more).collect()} == {"x": 1.0, "y": 0.15}
    steps = spark.createDataFrame([(3, 1), (8, 1), (15, 5), (40, 5)], "w int, s int").select(Q.spreading_steps(F.col("w"), F.col("s")).alias("n"))
    assert [r.n for r in steps.collect()] == [3, 2, 2, 1]


def test_fingerprint_tables(spark):
    a = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 4.0), ("b", 5, 1.0)], "id string, cell bigint, val double")
    assert {(r.id, r.cell): r.val for r in fp.normalised(a).collect()} == {("a", 0): 0.6, ("a", 1): 0.8, ("b", 5): 1.0}
    assert {r.val for r in fp.normalised(a, "binary").collect()} == {1.0}
    with pytest.raises(ValueError):
        fp.normalised(a, "max")
    assert {r.cell: r.val for r in fp.merged(a, F.lit("m"), F.lit(2.0)).collect()} == {0: 6.0, 1: 8.0, 5: 2.0}
    assert [r.cell for r in fp.sparsified(a.where("id = 'a'"), 1).collect()] == [1]
    bad = spark.createDataFrame([("z", 99, -1.0)], "id string, cell bigint, val double")
    assert tuple(fp.validity(bad, 8).first())[1:] == (False, False, False)
    x = spark.createDataFrame([("q", [float(i % 3) for i in range(64)])], "id string, vector array<double>")
    y = spark.createDataFrame([("d", [float((i + 1) % 3) for i in range(64)])], "id string, vector array<double>")
    assert 0 < S.block_attention(x, y, 8).first().score < 1
    d = S.distances(a.where("id = 'a'"), a.where("id = 'a'"), 8).first()
    assert (d.euclidean, d.hamming, d.ruzicka) == (0.0, 1.0, 1.0)


def test_numbering_and_sections(spark):
    rows = spark.createDataFrame([(f"k{i:04}",) for i in range(500)], "k string").repartition(6)
    got = sorted((r.k, r.number) for r in evaluate.numbered_by(rows, "k").collect())
    assert got == [(f"k{i:04}", i) for i in range(500)]
    docs = spark.createDataFrame([(1, "intro text\n# First\nbody one\n2. Second part\nbody two")], "doc_id int, text string")
    out = [r.text for r in graph.sections(docs).orderBy("section", "part").collect()]
    assert out == ["intro text", "# First\nbody one", "2. Second part\nbody two"]


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("f", 0, "doc_1, a"), ("f", 1, " goes on"), ("f", 2, "doc_2, b")], "file string, at int, value string")
    assert {tuple(r) for r in corpus.joined_lines(lines).collect()} == {("doc_1", "a goes on"), ("doc_2", "b")}
    rows = corpus.document_rows(spark.createDataFrame([(1, "Title: the text: more"), (2, "no title")], "doc_id int, text string"))
    assert {(r.title, r.text) for r in rows.collect()} == {("Title", "the text: more"), ("", "no title")}
    vocab = spark.createDataFrame([("a b", 3), ("c", 9)], "phrase string, df bigint")
    corpus.write_vocabulary(vocab, str(tmp_path / "v"))
    assert {tuple(r) for r in corpus.read_vocabulary(spark, str(tmp_path / "v"), 4).collect()} == {("c", 9)}
    (tmp_path / "c.json").write_text('{"0": ["x", "y"], "1": ["z"]}')
    assert corpus.read_candidates(spark, str(tmp_path / "c.json")).count() == 3
    assert corpus.merged_settings({"a": 1, "b": 2}, {"b": 3, "description": "x", "a": None}) == {"a": 1, "b": 3}
    assert {r.name: r.n for r in corpus.table_counts(v=vocab).collect()} == {"v": 2, "total": 2}
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    cache = texts.where("text = 'a'").select(F.sha2("text", 256).alias("key"))
    assert [r.text for r in corpus.cache_misses(texts, cache).collect()] == ["b"]


def test_learning_rows(spark):
    f = spark.createDataFrame([(i, j, float((i + j) % 2)) for i in range(12) for j in range(6)], "qid int, doc_id int, x double")
    gold = f.where("x = 1").select("qid", "doc_id")
    rows = rerank.training_set(f, gold)
    model = rerank.train_ranker(rows, ["x"])
    best = rerank.rerank(model, rows, ["x"], 3)
    assert best.join(gold, ["qid", "doc_id"]).count() == best.count() == 36


def test_candidates_and_pool(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "qid int, doc_id string, rank int")
    listed = spark.createDataFrame([(1, "b")], "qid int, doc_id string")
    assert {tuple(r) for r in evaluate.within(ranking, listed).select("qid", "doc_id", "rank").collect()} == {(1, "b", 1), (2, "c", 1)}
    lists = spark.createDataFrame([(1, "l", "a", 2.0), (1, "l", "b", 1.0), (1, "m", "b", 5.0)], "qid int, list string, doc_id string, score double")
    assert {r.doc_id: round(r.score, 6) for r in fusion.multi_rrf(lists).collect()} == {"a": round(1 / 61, 6), "b": round(1 / 62 + 1 / 61, 6)}


def test_score_operators(spark):
    s = spark.createDataFrame([(1, f"d{i}", float(i)) for i in range(8)] + [(2, "x", 0.0)], "qid int, doc_id string, score double")
    by = {}
    for r in stats.calibrated(s).where("qid = 1").collect():
        by.setdefault(r.method, []).append(r.score)
    assert sum(by["softmax"]) == pytest.approx(1) and sum(by["rank_gauss"]) == pytest.approx(0, abs=1e-9) and max(by["minmax"]) == 1
    assert max(by["rank_gauss"]) == pytest.approx(1.5341, abs=1e-3)
    flips = stats.sign_flip(spark.createDataFrame([("a", float(v)) for v in (1, 2, 1.5, 2.5, 1, 2)], "op string, delta double"), "op", 2000).first()
    assert flips.p < 0.06 and flips.low > 0


def test_cooccurrences(spark):
    docs = spark.createDataFrame([(1, "beta alpha gamma"), (2, "alpha beta xy"), (3, None)], "doc_id int, text string")
    assert {tuple(r) for r in index.cooccurrences(docs).collect()} == {("alpha", "beta", 2)}


def test_magnitude_conditions(spark):
    from lumigrid.plans import experiments

    lost = {}
    for r in experiments.q_magnitude_conditions(spark, "").collect():
        lost.setdefault(r.condition, set())
        if not r.a_above_b and r.op != "l2":
            lost[r.condition].add(r.op)
    sized = {"linear", "zscore", "minmax"}
    assert lost == {
        "large_45_12": set(), "large_40_15": set(), "med_35_20": set(), "small_30_25": sized, "tiny_21_19": sized,
        "rev_12_45": sized | {"rrf", "combsum", "combmnz", "borda"}, "rev_18_30": sized | {"combsum", "combmnz"},
    }


def test_classes_hold_every_link(spark):
    """Links of the whole graph follow from the classes: their pairs, weights and each document's number."""
    import random

    random.seed(1)
    counts = spark.createDataFrame([(p, d, random.choice([1, 1, 1, 2, 7])) for d in range(60) for p in ("x", "y") if random.random() < 0.7] + [("x", 3, 1), ("y", None, 5)], "phrase string, doc_id bigint, n bigint")
    want = {(r.a, r.b): round(r.weight, 9) for r in index.legacy_graph(counts).collect()}
    rows = index.legacy_classes(counts).collect()
    of = {r.a: r.b for r in rows if r.kind == "member"}
    link = {(r.a, r.b): r for r in rows if r.kind == "link"}
    got = {}
    for a in of:
        for b in of:
            pair = tuple(sorted((of[a], of[b])))
            if a < b and pair in link:
                got[a, b] = round(link[pair].weight, 9)
    assert got == want and sum(r.n for r in link.values()) == len(want)
    assert {r.a: r.n for r in rows if r.kind == "member"} == {d: sum(d in pair for pair in want) for d in of}
    assert len(rows) < len(want)
