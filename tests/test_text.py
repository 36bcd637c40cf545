import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from balancier.functions import text as T
from balancier.operators import corpus as C
from balancier.operators import retrieval as V


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr("c")).first()[0]


def test_tokens(spark):
    assert one(spark, "Le Ratio, le RATIO de l'été-2024 a 7 ok_no", T.tokens) == ["ratio", "été-2024", "ok", "no"]
    assert one(spark, " ", T.tokens) == [] and one(spark, None, T.tokens) == []


def test_codes_are_whole_words(spark):
    expr = lambda c: T.spotted(c, T.RATIO_CODES)
    assert one(spark, "analysis of rs, (ROE) and RL-x; éRS RS2", expr) == ["RS", "RL", "ROE"]
    assert one(spark, None, expr) == []


def test_intents(spark):
    cases = {
        "Et si on simule": "STRESS_TEST", "évolution du RS": "TREND_ANALYSIS", "seuil d'alerte": "THRESHOLD_LOOKUP",
        "why RS": "INTERPRETATION", "c'est quoi": "DEFINITION", "vue d'ensemble": "DASHBOARD_OVERVIEW",
        "PNB ?": "RATIO_VALUE", "bonjour": "GENERAL",
    }
    for text, want in cases.items():
        assert one(spark, text, T.intent) == want
    assert one(spark, None, T.intent) == "GENERAL"


def test_budget(spark):
    assert one(spark, "x" * 37, T.token_estimate) == 10 and one(spark, "x" * 38, T.token_estimate) == 11
    assert one(spark, None, T.token_estimate) == 0


def test_json(spark):
    assert one(spark, ' {"a" : [1, 2]} ', T.normalise_json) == '{"a":[1,2]}'
    assert one(spark, '{oops "', T.normalise_json) == '"{oops \\""'
    assert one(spark, None, T.normalise_json) is None


def test_prompt(spark):
    assert one(spark, f" hi \n{T.CONTEXT_MARKER} ctx", T.prompt_text) == "hi"
    assert one(spark, f"{T.CONTEXT_MARKER} ctx", T.prompt_text) == f"{T.CONTEXT_MARKER} ctx"


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("a" * 10, ["a" * 10]),
        (" " + "a" * 5, [" aaaaa"]),  # short texts stay as they are
        ("aaaaaaa. bbbbbbbb", ["aaaaaaa.", "bbbbbbbb"]),
        ("aa. aaaaaaaaaaaa", ["aa. aaaaaa", "aaaaaa"]),  # stop in the first half
        ("aaaaaaaaaa.bbb", ["aaaaaaaaaa.", "bbb"]),  # the stop may be one past the window
    ],
)
def test_cut_edges(spark, text, pieces):
    assert one(spark, text, lambda c: T.chunks(c, 10)) == pieces


def test_cut_loses_nothing(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .?!\né") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.chunks("t", 37).alias("pieces")).collect()
    squeeze = lambda s: "".join(s.split())
    for r in rows:
        assert squeeze("".join(r.pieces)) == squeeze(r.t)
        assert len(r.t) <= 37 or all(len(p) <= 38 for p in r.pieces)


def test_long_text_is_chunked_whole(spark):
    body = ("Une phrase. " * 20000).strip()
    rows = spark.createDataFrame([("t", body)], "title string, content string")
    got = [r["text"] for r in C.chunk_documents(rows).orderBy("chunk_no").collect()]
    assert "".join(got).replace(" ", "") == body.replace(" ", "")


def test_chunk_prefix_and_metadata(spark):
    rows = spark.createDataFrame([(" ", "corps ", "rs", "a; b|c", None)], "titre string, body string, ratio string, keywords string, language string")
    r = C.enrich(C.chunk_documents(rows)).first()
    assert (r["title"], r["text"], r["ratio_code"], r["language"]) == ("[RS] — knowledge chunk", "[RS] — corps", "RS", "fr")
    assert r["keywords"] == ["a", "b", "c", "rs", "knowledge", "chunk", "corps", "RS"]


def test_top_of_batch_keeps_ties_in_id_order():
    ids = np.array([5, 3, 9, 1, 7])
    assert list(ids[V.top_of_batch(ids, np.array([0.5, 0.5, 0.9, 0.5, np.nan]), 2)]) == [9, 1]
    assert list(ids[V.top_of_batch(ids, np.full(5, np.nan), 2)]) == []


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    vectors[150:] = vectors[:150]  # every vector twice: ties everywhere
    vectors[0] = 0
    domains = [None, "x", "y"]
    docs = spark.createDataFrame([(i, v.tolist(), domains[i % 3]) for i, v in enumerate(vectors)], "id long, embedding array<float>, domain string").repartition(5)
    queries = [V.Query(f"q{i}", rng.normal(size=8).tolist(), domain="x" if i % 2 else None) for i in range(6)]
    got = {}
    for r in V.dense(docs, queries, 10, domain="domain").orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    for q in queries:
        open_to = [i for i in range(300) if i and (q.domain is None or domains[i % 3] in (None, q.domain))]
        v, m = np.array(q.vector), vectors.astype("float64")
        score = {i: round(float(m[i] @ v / (np.linalg.norm(m[i]) * np.linalg.norm(v))), 12) for i in open_to}
        assert got[q.name] == sorted(open_to, key=lambda i: (-score[i], i))[:10]


def test_query_reading():
    q = V.query_of("q", "Évolution du RS et de la liquidité (FPE) ?")
    assert q.ratio_codes == ["RS"] and q.parameter_codes == ["FPE"] and q.domain == "liquidity"
    assert q.terms == ["évolution", "rs", "liquidité", "fpe"]


def test_retrieve_without_vectors(spark):
    docs = spark.createDataFrame(
        [(1, "le ratio rs", "t", "RS", None, None, None), (2, "autre", "ratio", None, None, None, None)],
        "id long, content string, title string, ratio_code string, parameter_code string, domain string, embedding array<float>",
    )
    rows = V.retrieve(docs, [V.query_of("q", "ratio RS")]).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 2]
    assert rows[0]["score"] == round(1 / 61 + 1 / 61, 12)


def test_page_and_sessions(spark):
    from balancier.operators import chatlog as G

    sessions = spark.createDataFrame([(1, "u", "ACTIVE", 5), (2, "u", "ACTIVE", None), (3, "u", "ARCHIVED", 9), (4, "u", "ACTIVE", 8)],
                                     "id int, user_id string, status string, last_message_at int")
    page = G.session_page(sessions, "u")
    assert [r["id"] for r in page.items.collect()] == [4, 1, 2] and page.total_elements == 3


def test_long_conversation_splits_into_parts(spark):
    from balancier.operators import chatlog as G

    msgs = spark.range(2500).select(F.lit(1).alias("session_id"), F.col("id").alias("sequence_no"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))
    parts = G.conversation_text(msgs, part=1000).orderBy("part_no").collect()
    assert [p["messages"] for p in parts] == [1000, 1000, 500]
    assert "\n".join(p["text"] for p in parts) == "\n".join(f"user: {i}" for i in range(2500))
