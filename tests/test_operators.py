"""Operators on fixtures whose results follow by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lumigrid.functions import grid, text as T
from lumigrid.operators import bm25, evaluate, fingerprints as fp, fusion, graph, index, query as Q, rerank, similarity as S, stats
from lumigrid.plans.engine import Engine, Settings
from lumigrid.sources import adapters, corpus
from lumigrid.streaming import ingest


def test_morton(spark):
    points = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (0, 1, 2), (1, 1, 3), (5, 3, 27), (7, 7, 63)], "x int, y int, code bigint")
    for r in points.select("*", grid.morton(F.col("x"), F.col("y")).alias("got"), grid.morton_x(F.col("code")).alias("gx"), grid.morton_y(F.col("code")).alias("gy")).collect():
        assert (r.got, r.gx, r.gy) == (r.code, r.x, r.y)
    with pytest.raises(ValueError):
        grid.check_size(12)


@pytest.fixture(scope="module")
def lists(spark):
    a = spark.createDataFrame([(1, "d1", 3.0), (1, "d2", 2.0), (1, "d3", 1.0)], "qid int, doc_id string, score double")
    b = spark.createDataFrame([(1, "d1", 1.0), (1, "d2", 5.0)], "qid int, doc_id string, score double")
    return a, b


def test_fusion(lists):
    want = {
        "rrf": (1 / 61 + 1 / 62, 1 / 62 + 1 / 61, 2 / 63), "borda": (5, 5, 1), "combsum": (4, 7, 1), "combmnz": (8, 14, 1), "linear": (0.3, 0.85, 0),
    }
    got = {(r.op, r.doc_id): r.score for r in fusion.all_fused(*lists).collect()}
    for op, scores in want.items():
        for d, s in zip(("d1", "d2", "d3"), scores, strict=True):
            assert got[op, d] == pytest.approx(s), (op, d)
    with pytest.raises(ValueError):
        fusion.operator("none such")


def test_constant_lists(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 2.0)], "qid int, doc_id string, score double")
    row = a.select(*[fusion.normaliser(h).cast("double").alias(h) for h in ("max", "minmax", "zscore", "l2")]).first()
    assert (row["max"], row["minmax"], row["zscore"]) == (1.0, 0.0, 0.0) and row["l2"] == pytest.approx(1 / math.sqrt(2))


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id int, text string")
    for text, want in (("a", math.log(2)), ("a a", 2 * math.log(2))):
        q = spark.createDataFrame([(9, text)], "item_id int, text string")
        assert {r.doc_id: round(r.score, 6) for r in bm25.scores(docs, q).collect()} == {1: round(want, 6)}


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, d, i) for i, d in enumerate(["x", "g1", "y", "g2"], 1)] + [(2, "g1", 1)], "qid int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "g1"), (1, "g2"), (2, "g1"), (3, "g1")], "qid int, doc_id string")
    rows = {r.qid: r for r in evaluate.per_query(ranking, gold).collect()}
    r = rows[1]
    assert (r.found_at, r.mrr, r.ap, r.p_1, r.p_2, r.r_2, r.p_5) == (2, 0.5, 0.5, 0.0, 0.5, 0.5, 0.4)
    assert rows[2].ndcg_ref_1 == 0.5 and rows[2].ndcg_1 == 1.0 and rows[3].mrr == 0.0 and rows[3].found_at is None


def test_spreading_and_kernel(spark):
    corner = spark.createDataFrame([("a", 0, 1.0)], "id string, cell bigint, val double")
    assert {r.cell: r.val for r in fp.spread(corner, 8).collect()} == {0: 1.0, 1: 0.5, 2: 0.5, 3: 0.5}
    assert {r.cell: r.val for r in fp.spread(corner, 64).collect()} == {0: 1.0}
    got = {r.cell: r.val for r in fp.geometric(corner, 8).collect()}
    assert got[0] == 2.25
    blurred = fp.blurred(corner, 8, 1.0)
    assert blurred.agg(F.sum("val")).first()[0] == pytest.approx(1.0)


def test_set_metrics(spark):
    q = spark.createDataFrame([("q", c, 1.0) for c in (1, 2, 3)], "id string, cell bigint, val double")
    d = spark.createDataFrame([("d", c, 1.0) for c in (2, 3, 4, 5)], "id string, cell bigint, val double")
    r = S.set_metrics(q, d).first()
    assert (r.both, r.dice, r.overlap, r.jaccard, r.containment, r.coverage) == (2, 4 / 7, 2 / 3, 2 / 5, 2 / 3, 0.5)
    far = spark.createDataFrame([("e", 60, 1.0)], "id string, cell bigint, val double")
    assert {(x.doc_id, x.score > 0) for x in S.ranked(q, d.union(far)).collect()} == {("d", True), ("e", False)}


def test_sdr_keeps_its_bits(spark):
    v = [(f"v{k}", c, float((c * 7 + k) % 11)) for k in range(3) for c in range(64)]
    out = fp.sdr(spark.createDataFrame(v, "id string, cell bigint, val double"), 8, 0.1).groupBy("id").agg(F.count("*").alias("n"), F.min("val").alias("least"))
    assert all(0 < r.n <= 64 and r.least > 0 for r in out.collect())


def test_text(spark):
    df = spark.createDataFrame([("A-b one. Two! Three? four",)], "t string")
    t = F.col("t")
    r = df.select(T.hyphens_opened(t).alias("h"), T.sentences(t).alias("s"), T.tokens(t).alias("w"), T.ngrams(T.tokens(t), 1, 2).alias("g"), T.negation(F.lit("All except Him and her now?")).alias("n"), T.is_multi_hop(F.lit("Who is the father of him?")).alias("m"), T.decomposed(F.lit("Who is the spouse of Ada Lovelace?")).alias("d"), T.json_list(F.lit('```json\n["a", "b"]\n```')).alias("j"), T.relation_type(F.lit("is located in")).alias("p")).first()
    assert r.h == "A b one. Two! Three? four" and r.s == ["A-b one.", "Two!", "Three?", "four"] and r.w == ["a", "b", "one", "two", "three", "four"]
    assert len(r.g) == 11 and r.n == ("exclusion", [], ["Him", "and", "her"]) and r.m and r.d == ["What is ada lovelace?", "What is the spouse of ada lovelace?"] and r.j == ["a", "b"] and r.p == "IS_LOCATED_IN"


@pytest.mark.parametrize(("n", "starts"), [(2, [0]), (3, [0]), (6, [0, 2, 3]), (7, [0, 2, 4])])
def test_snippets(spark, n, starts):
    parts = F.array(*[F.lit(f"s{i}") for i in range(n)])
    got = spark.range(1).select(T.snippets(parts).alias("s")).first().s
    assert got == [" ".join(f"s{i}" for i in range(s, min(n, s + 3))) for s in starts]


def test_collisions(spark):
    c = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "doc_id int, x int, y int")
    assert {tuple(r) for r in index.collisions_resolved(c, 8).collect()} == {(1, 0, 0), (2, 0, 1)}


def test_holm_kendall_auc(spark):
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p double")
    assert {r.name: round(r.adjusted, 6) for r in stats.holm(p, "family").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    both = spark.createDataFrame([(1, "x", 3.0, 3.0), (1, "y", 2.0, 1.0), (1, "z", 1.0, 2.0)], "qid int, doc_id string, a double, b double")
    assert stats.kendall(both).first().tau == pytest.approx(1 / 3) and stats.spearman(both).first().rho == pytest.approx(0.5)
    s = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    r = stats.auc(s).first()
    assert (r.auc_ref, r.auc) == (0.75, 0.875)


def test_ols(spark):
    rows = spark.createDataFrame([(float(x), float(y), 1.0 + 2 * x - 3 * y) for x in range(5) for y in range(4)], "x double, y double, z double")
    beta, r2, _ = stats.ols(rows, "z", ["x", "y"])
    assert beta == pytest.approx([1, 2, -3]) and r2 == pytest.approx(1)


def test_rrf_is_invariant_to_monotone_transforms(spark, lists):
    a, b = lists
    ranks = lambda x: {r.doc_id: r["rank"] for r in fusion.fused(x, b, "rrf").collect()}
    assert ranks(a) == ranks(a.withColumn("score", F.exp("score")))


def test_triples(spark):
    t = spark.createDataFrame([(1, "A", "r", "B", 1.0, "c1"), (2, "a", "R", "b", 0.5, "c2"), (3, "A", "r", "B", 1.0, "c3")], "seq int, subject string, predicate string, object string, confidence double, source_chunk_id string")
    r = graph.deduplicated(t).first()
    assert r.confidence == 0.875 and r.source_chunks == ["c1", "c2", "c3"] and r.subject == "A"
    answers = spark.createDataFrame([("k", '{"triples": [{"subject": "x", "predicate": "p", "object": "y"}, {"subject": " ", "predicate": "p", "object": "y"}]}'), ("l", '[{"subject": "u", "predicate": "p", "object": "v", "confidence": 0.5}]')], "source_chunk_id string, answer string")
    assert {(x.subject, x.confidence) for x in graph.parsed_triples(answers).collect()} == {("x", 1.0), ("u", 0.5)}
    assert spark.range(1).select(graph.similar(F.lit("Berlin"), F.lit("berlin")).alias("s")).first().s == 1.0


def test_chunks_cover_every_sentence(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(400))
    rows = graph.chunked(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), target=100).collect()
    joined = " ".join(r.text for r in rows)
    assert all(f"number {i} has" in joined for i in range(400)) and {r.doc_id for r in rows} == {1}


def test_expansion(spark):
    prints = spark.createDataFrame([("red", 1, 1.0), ("red", 2, 1.0), ("crimson", 1, 1.0), ("crimson", 2, 0.9), ("blue", 9, 1.0)], "id string, cell bigint, val double")
    out = Q.expanded(spark.createDataFrame([("red blue",)], "term string"), prints, 8).collect()
    assert [(r.term, r.phrase) for r in out] == [("red blue", "crimson")]


def test_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("doc_1, one, two\nno comma\ndoc_1, last\n")
    assert {tuple(r) for r in corpus.read_corpus(spark, str(tmp_path / "c.txt")).collect()} == {("doc_1", "one, two"), ("doc_1", "last")}
    assert [tuple(r) for r in corpus.read_corpus(spark, str(tmp_path / "c.txt"), last_wins=True).collect()] == [("doc_1", "last")]
    prints = spark.createDataFrame([("a", 3, 0.5), ("a", 27, 1.0)], "id string, cell bigint, val double")
    assert {tuple(r) for r in corpus.unpacked_fingerprints(corpus.packed_fingerprints(prints, 8)).collect()} == {("a", 3, 0.5), ("a", 27, 1.0)}


def test_adapters(spark):
    raw = spark.createDataFrame([("1", "q?", "a", [("T", ["s1", "s2"]), ("U", ["s3"])], [("T", 0)])], "id string, question string, answer string, context array<struct<title:string,sentences:array<string>>>, supporting_facts array<struct<title:string,sent_id:int>>")
    p = adapters.supporting_facts(raw).first().paragraphs
    assert [(x.title, x.paragraph_text, x.is_supporting) for x in p] == [("T", "s1 s2", True), ("U", "s3", False)]
    c = spark.createDataFrame([(f"d{i:02}", "", f"t{i}") for i in range(30)], "_id string, title string, text string")
    q = spark.createDataFrame([("q1", "what")], "_id string, text string")
    rel = spark.createDataFrame([("q1", "d03", 1), ("q1", "d04", 0)], "query_id string, doc_id string, score int")
    p = adapters.beir(c, q, rel).first().paragraphs
    assert [x.paragraph_text for x in p if x.is_supporting] == ["t3"] and len(p) == 16
    with pytest.raises(ValueError):
        adapters.adapter("none such")


def test_combined_corpus(spark):
    p = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
    e = spark.createDataFrame([("1", "q", "a", [(0, "T", "x", True), (1, "U", "y", False)]), ("2", "r", "b", [(0, "T", "x", False)])], f"id string, question string, answer string, paragraphs {p}")
    docs, gold = evaluate.combined_corpus(e)
    assert {tuple(r) for r in docs.collect()} == {("doc_000000", "T", "x"), ("doc_000001", "U", "y")}
    assert gold.count() == 3


def test_engine(spark):
    docs = spark.createDataFrame([(i, f"alpha beta word{i % 3} gamma{i % 2}") for i in range(12)], "doc_id int, text string")
    engine = Engine(spark, Settings(grid_size=8, top_k=3))
    built = engine.index(docs)
    ranking = engine.search(built, spark.createDataFrame([(1, "word1 gamma1"), (2, "unknown")], "qid int, text string"))
    rows = ranking.collect()
    assert {r.qid for r in rows} == {1} and len(rows) == 3 and all(r.doc_id % 3 == 1 or r.doc_id % 2 == 1 for r in rows)


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    prints = spark.createDataFrame([("beta", 1, 1.0)], "id string, cell bigint, val double")
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), prints, str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/fingerprints")).count() == 2


def test_rerank(spark):
    near = "without " + "x" * 41 + " tower"
    df = spark.createDataFrame([("Paris without the Tower", ["tower"]), ("the tower", ["tower"]), ("nothing", ["tower"]), (near, ["tower"]), ("x" + near, ["tower"]), ("without", ["without"]), ("not a but b", ["b", "q"]), (None, ["a"]), ("a", [])], "t string, w array<string>")
    cues = F.array(F.lit("without"), F.lit("not"))
    assert [round(r.f, 9) for r in df.select(rerank.negation_factor(F.col("t"), F.col("w"), cues).alias("f")).collect()] == [1.3, 0.5, 1.0, 1.3, 1.3, 0.5, 1.3, 1.0, 1.0]


def test_negation(spark):
    said = {
        "Which of the following is not in France today?": ("which_not", [], ["in", "france", "today"]), "What has wings except birds and bats?": ("exclusion", [], ["birds", "and", "bats"]),
        "It does not contain water and is not a lake": ("negated_concept", ["does not", "is not", "not"], ["contain", "water", "and", "a", "lake"]), "A notable case": ("none", [], []), "Without doubt": ("negated_concept", ["without"], ["doubt"]),
        "I cannot": ("negated_concept", ["cannot"], []), "": ("none", [], []), "lack of sleep or neither": ("negated_concept", ["lack of", "neither"], ["sleep", "or", "neither"]),
    }
    df = spark.createDataFrame([(t,) for t in [*said, None]], "t string")
    got = {r.t: r.n for r in df.select("t", T.negation(F.col("t")).alias("n")).collect()}
    assert {t: tuple(got[t]) for t in said} == said and got[None].kind == "none"
    marked = {r.t: r.m for r in df.select("t", T.negation_marked(F.col("t")).alias("m")).collect()}
    assert marked["It does not contain water and is not a lake"] == "It does not_neg_neg contain water and is not_neg a lake" and marked["A notable case"] == "A notable case"


def test_multi_hop_and_decomposition(spark):
    hops = ["what is the capital of X", "where is the old tower located", "when did the long war end", "why does smoking cause harm", "how do drugs affect sleep", "which of the many rivers and lakes but which", "who wrote it"]
    df = spark.createDataFrame([(t,) for t in hops], "t string")
    assert [r.m for r in df.select(T.is_multi_hop(F.col("t")).alias("m")).collect()] == [True] * 5 + [True, False]
    asked = spark.createDataFrame([("Who was the parent of the founder of Y?",), ("the top of it",), ("plain",), (None,)], "t string")
    assert [r.d for r in asked.select(T.decomposed(F.col("t")).alias("d")).collect()] == [["What is the founder of y?", "What is the parent of the founder of y?"], ["the top of it"], ["plain"], [None]]


def test_label_separation(spark):
    vectors = {1: ("a", {0: 1.0}), 2: ("a", {0: 3.0, 1: 4.0}), 3: ("b", {1: 2.0}), 4: ("b", {}), 101: ("c", {2: 5.0}), 5: (None, {0: 1.0, 2: 1.0})}
    cells = spark.createDataFrame([(i, c, v) for i, (_, x) in vectors.items() for c, v in x.items()], "id bigint, cell bigint, val double")
    labels = spark.createDataFrame([(i, k) for i, (k, _) in vectors.items()], "id bigint, label string")

    def cosine(a, b):
        dot = sum(v * b.get(c, 0.0) for c, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0

    want = {}
    for i, (k, x) in vectors.items():
        for j, (m, y) in vectors.items():
            if i != j:
                want.setdefault(None if None in (k, m) else k == m, []).append(cosine(x, y))
    got = {r.same_label: (r.n, r.mean_cosine) for r in S.label_separation(cells, labels).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == len(c) and got[k][1] == pytest.approx(sum(c) / len(c)) for k, c in want.items())
    assert S.label_separation(cells.limit(0), labels.limit(0)).count() == 0


def test_wilcoxon_and_gain(spark):
    rows = [("x", v) for v in (0.5, -0.25, 0.25, 0.0, 1.0, -0.125)] + [("y", 0.0)]
    got = stats.wilcoxon(spark.createDataFrame(rows, "op string, delta double"), "op").collect()
    # Sizes 0.125, 0.25, 0.25, 0.5, 1.0 have the ranks 1, 2.5, 2.5, 4, 5.
    assert [(r.op, r.n, r.w_plus, r.w_minus) for r in got] == [("x", 5, 11.5, 3.5)] and abs(got[0].z - (3.5 - 7.5) / (5 * 6 * 11 / 24 - 6 / 48) ** 0.5) < 1e-9
    a = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 12, 1.0)], "qid int, doc_id int, score double")
    b = spark.createDataFrame([(1, 12, 9.0), (1, 13, 8.0)], "qid int, doc_id int, score double")
    gold = spark.createDataFrame([(1, 12)], "qid int, doc_id int")
    c = stats.complementarity(a, b, gold).first()
    # Ranks (1, 999), (2, 999), (3, 1), (999, 2): of six pairs one side ties once.
    assert (c.mrr_a, c.mrr_b, c.gold_rank_gap, c.first_differs) == (1 / 3, 1.0, 2, True) and abs(c.tau - (1 - 4) / (6 * 5) ** 0.5) < 1e-9 and abs(c.top3_overlap - 1 / 3) < 1e-9
    g = stats.pair_geometry(a, b, gold).first()
    assert (g.a_d12, g.a_d15, g.b_d12, g.gold_d13_a, g.gold_rank_a, g.gold_rank_b, g.cross_gold_margin) == (1.0, 0.0, 1.0, 0.0, 3, 1, -8.0) and abs(g.kappa - 12 / 23) < 1e-9
    assert abs(g.joint_margin - 0.5 * ((1 - 3) / 3 + (9 - 8) / 9)) < 1e-9
    gains = stats.fusion_gain(spark.createDataFrame([("rrf", 1, 0.5)], "op string, qid int, mrr double"), stats.complementarity(a, b, gold)).collect()
    assert [(r.op, r.gain) for r in gains] == [("rrf", -0.5)]
