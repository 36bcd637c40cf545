"""The quality model and the pipeline's stages on a small corpus."""

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from balancier.llm import quality, queries

from .cases import ODD, documents, prose
from .test_duplicates import linked, with_ids, word_list

SF = "/root/testdata/sf0.01"


def labelled(n):
    rng, rows, labels = random.Random(8), [], []
    for i, (_, text) in enumerate(prose(9, n, copies=False)):
        good = rng.random() < 0.7
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split(" "))))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_learns_and_scores_every_row(spark):
    rows, labels = labelled(400)
    docs = documents(spark, rows + [(10**6, None), (None, "x"), (5, rows[5][1])])
    table = spark.createDataFrame(labels + [(3, None), (None, 1), (999_999, 0)], "doc_id long, quality int").withColumn("place", F.lit(0))
    got = quality.score(docs, quality.train(docs, table)).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    want = dict(labels)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in want:
            assert r.predicted == want[r.doc_id]


def test_quality_never_learns_from_held_out_rows(spark):
    rows, labels = labelled(120)
    docs = documents(spark, rows)
    lies = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q) for d, q in labels]
    one, two = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, lies))
    assert (one == two).all()


def test_quality_without_labels_or_rows(spark):
    docs = documents(spark, ODD)
    weights = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, weights).collect()} == {0.5}
    assert quality.score(documents(spark, []), weights).collect() == []


def test_held_out_accuracy(spark):
    found = queries.op8_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert found.where("predicted = quality").count() >= 0.97 * found.count() > 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    good, labels = labelled(300)
    rows = good + [(1000 + d, t) for d, t in prose(4, 150)] + [(20_000 + i, t) for i, (d, t) in enumerate(ODD)]
    docs = documents(spark, rows).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_plain_versions(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "packing"]
    weights = quality.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    rejected = {r.doc_id for r in quality.score(docs, weights).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in rejected]
    groups = linked(with_ids(rows))
    rows = [(d, t) for d, t in rows if groups[d] == d]
    words = {d: word_list(t) for d, t in rows}
    counts = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    texts = {}
    for d, own in words.items():
        gone = set()
        for i in range(len(own) - 34):
            if counts[tuple(own[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        texts[d] = " ".join(w for i, w in enumerate(own) if i not in gone)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}

    out = corpus_pipeline.run(spark, corpus).collect()
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert dict(got) == want
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(want.values()) // 2048) + 1


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("carried", F.lit("clash")).withColumn("tag", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus).columns == list(corpus_pipeline.COLUMNS)
        empty = stage(spark, docs.limit(0), corpus)
        assert empty.columns == list(corpus_pipeline.COLUMNS) and empty.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), corpus).collect() == []


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Rows of one id, or of none, are documents of their own texts."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(60))
    null, same = [text() for _ in range(6)], [text() for _ in range(6)]
    copies = [(100 + i, t) for i, t in enumerate(null[:2] + same[:2])]
    near = [(200, null[2] + " more"), (1, same[2] + " more")]
    rows = [(None, t) for t in null] + [(7, t) for t in same] + copies + near + [(None, null[3]), (7, same[3]), (8, same[4]), (None, None), (9, "")]
    want = [(None, t) for t in null] + [(7, t) for i, t in enumerate(same) if i != 2] + [(1, near[1][1]), (None, ""), (9, "")]
    by_id = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = corpus_pipeline.distinct(spark, documents(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=by_id) == sorted(want, key=by_id)


def test_every_query_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
