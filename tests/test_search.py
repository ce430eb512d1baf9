"""Searches in blocks against plain loops: what they skip, what they don't, and how many tasks share the work."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions.rules import VIETNAMESE
from marlstone.operators import answering as A
from marlstone.operators import postings as P
from marlstone.operators import retrieval as R
from marlstone.operators import tagging as G
from marlstone.operators import vectors as V
from marlstone.sources.providers import OverlapReranker


def clustered(seed, n, dim=8, clusters=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim)) * 4
    rows = centres[r.integers(0, clusters, n)] + r.normal(size=(n, dim)) * 0.3
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def plain_topk(asked, vecs, k):
    out = []
    for q, v in asked:
        scored = sorted((-round(float(np.dot(v, w)), 6), i) for i, w in vecs)[:k]
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(hits):
    return sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in hits.select("qid", "id", "score", "rank").collect())


def close(got, want):
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def frames(spark, vecs, asked):
    return spark.createDataFrame(asked, "qid bigint, embedding array<double>").repartition(2), spark.createDataFrame(vecs, "id bigint, embedding array<float>").repartition(3)


@pytest.mark.parametrize("most", [1 << 14, 3])
def test_dense_in_blocks(spark, monkeypatch, most):
    """Few questions go to the vectors; many are dealt out against them in a grid, with the same plan for any number."""
    monkeypatch.setattr(V, "MOST_BROADCAST", most)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 7)
    vecs = clustered(1, 60) + [(100 + i, [1.0] * 8) for i in range(9)]  # ties
    asked = [(q, v) for q, v in vecs[:8]] + [(99, [1.0] * 8)]
    queries, vectors = frames(spark, vecs, asked)
    hits = V.dense_topk(queries, vectors, 5)
    close(found(hits), plain_topk(asked, vecs, 5))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert ("CartesianProduct" in plan) == (most == 3) and "collect" not in plan
    assert plan.count("Scan") == V.dense_topk(queries.limit(1), vectors, 5)._jdf.queryExecution().executedPlan().toString().count("Scan")
    assert V.dense_topk(queries.limit(0), vectors, 5).count() == 0 and V.dense_topk(queries, vectors.limit(0), 5).count() == 0


@pytest.mark.parametrize("most", [1 << 14, 3])
def test_index(spark, tmp_path, monkeypatch, most):
    """The index gives what a full search gives, and passes most blocks over where vectors lie in clusters."""
    monkeypatch.setattr(V, "MOST_BROADCAST", most)
    vecs = clustered(2, 600) + [(1000 + i, [0.5] * 8) for i in range(40)] + [(5000, None)]
    asked = [(q, v) for q, v in vecs[:10]] + [(77, [0.0] * 8), (78, [0.5] * 8)]
    queries, vectors = frames(spark, vecs, asked)
    V.write_index(vectors, f"file://{tmp_path}/index", per_block=20, sample=300)
    index = V.read_index(spark, f"file://{tmp_path}/index")
    heads = index.collect()
    assert sorted(i for h in heads for i in h["keys"]) == sorted(i for i, v in vecs if v is not None)  # every vector is indexed
    held = {i: v for i, v in vecs if v is not None}
    for h in heads:
        assert max(np.linalg.norm(np.array(held[i]) - h["centre"]) for i in h["keys"]) <= h["radius"] + 1e-9 and h["n"] <= 20
    result = V.index_topk(queries, index, 5)
    close(found(result.hits), plain_topk(asked, [x for x in vecs if x[1] is not None], 5))
    read = result.probed.unionByName(result.reached).where("qid < 10").count()
    assert read < 0.5 * 10 * len(heads)
    few = V.index_topk(queries, index, 2000)  # more than there are: every block is read
    assert few.hits.count() == len(asked) * 640
    assert V.index_topk(queries.limit(0), index, 5).hits.count() == 0


def texts(seed, n, common="the"):
    r = random.Random(seed)
    return [(d, " ".join([common] * r.randint(0, 3) + [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randint(1, 60))])) for d in range(n)]


def plain_bm25(queries, docs, k, k1=1.5, b=0.75):
    toks = {d: t.lower().split() for d, t in docs}
    n, avgdl = len(toks), sum(map(len, toks.values())) / max(1, len(toks))
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = []
    for q, text in queries:
        scores = {}
        for d, t in toks.items():
            tf = Counter(t)
            s = sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avgdl)) for w in text.lower().split() if tf[w])
            if round(s, 6) > 0:
                scores[d] = round(s, 6)
        out += [(q, d, s, rank) for rank, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


ASKED = [(1, "the w1 w2"), (2, "w7 w7 w299"), (3, "nothing here"), (4, "the"), (5, "w5 w11 the w1")]


@pytest.mark.parametrize("small", [True, False])
def test_bm25_either_way(spark, monkeypatch, small):
    monkeypatch.setattr(R, "is_small", lambda df: small)
    monkeypatch.setattr(R, "SHARES", 3)
    docs = texts(1, 120)
    frame = spark.createDataFrame(docs, "id bigint, text string")
    close(found(R.bm25_topk(spark.createDataFrame(ASKED, "qid bigint, query string"), frame, 7)), plain_bm25(ASKED, docs, 7))


def test_postings(spark, tmp_path):
    """A term that most texts hold lies in a block a part; parts whose bound is too low are not read."""
    docs = texts(2, 300) + [(900 + i, "rare pearl " * 30) for i in range(4)] + [(1000 + i, f"pearl {t}") for i, t in texts(9, 60)]
    frame = spark.createDataFrame(docs, "id bigint, text string")
    P.write_postings(frame, f"file://{tmp_path}/p", per_part=10)
    index = P.read_postings(spark, f"file://{tmp_path}/p")
    assert index.blocks.where("term = 'the'").count() > 20 and index.blocks.select(F.max(F.size("entries"))).first()[0] < 40
    asked = [*ASKED, (6, "pearl")]
    result = P.posting_topk(spark.createDataFrame(asked, "qid bigint, query string"), index, 4)
    close(found(result.hits), plain_bm25(asked, docs, 4))
    read = result.probed.unionByName(result.reached).groupBy("qid").count().withColumnRenamed("count", "n")
    every = result.bounds.groupBy("qid").count()
    assert read.join(every, "qid").where("n > count").count() == 0 and read.agg(F.sum("n")).first()[0] < every.agg(F.sum("count")).first()[0]


def test_postings_of_a_part_give_its_best(spark, tmp_path):
    """Of a part's documents only the k best of each question are rows; a part is documents that lie beside each other."""
    entry = lambda i, tf: {"id": i, "tf": tf, "dl": 4}
    blocks = pa.table({"term": ["a", "b"], "entries": pa.array([[entry(i, 1 + i % 3) for i in range(50)], [entry(7, 2)]], type=pa.list_(P.ENTRY))})
    asked = pa.table({"qid": [1, 1, 2], "term": ["a", "b", "none"], "weight": [1.0, 2.0, 1.0], "avgdl": [4.0] * 3})
    assert P.part_hits(blocks, asked, 3, 1.5, 0.75).select(["qid", "id"]).to_pylist() == [{"qid": 1, "id": 7}, {"qid": 1, "id": 2}, {"qid": 1, "id": 5}]
    P.write_postings(spark.createDataFrame([(i, "the same") for i in range(40)], "id bigint, text string").coalesce(1), f"file://{tmp_path}/p", per_part=10)
    held = P.read_postings(spark, f"file://{tmp_path}/p").blocks.where("term = 'the'").select("part", F.col("entries.id").alias("ids")).collect()
    assert sorted(r["ids"] for r in held) == [list(range(k, k + 10)) for k in (0, 10, 20, 30)]


def test_bm25_of_filters(spark):
    """Each question's statistics are those of the texts that its filter keeps."""
    default = VIETNAMESE.audience_default
    r = random.Random(4)
    docs = [(d, t, f"s{d % 5}" if d % 11 else None, r.choice([["a"], ["b"], ["a", "b"], [default], [default, "a"]])) for d, t in texts(3, 150)]
    tags = F.struct(F.col("tags").alias("doi_tuong"), F.array().cast("array<string>").alias("loai_van_ban"), F.lit("x").alias("do_quan_trong"))
    frame = spark.createDataFrame(docs, "id bigint, text string, source string, tags array<string>").select("id", "text", "source", tags.alias("semantic_tags"))
    filters = [(None, None), (["s1", "s2"], None), (None, "a"), (["s0", "s3", "s3"], "b"), ([], None), (["s4"], default), (None, "nobody")]
    asked = [(100 * f + q, text, sources, audience) for f, (sources, audience) in enumerate(filters) for q, text in ASKED]
    queries = spark.createDataFrame(asked, "qid bigint, query string, sources array<string>, audience string")
    want, kept = [], {}
    for f, (sources, audience) in enumerate(filters):
        kept[f] = [(d, t) for d, t, s, g in docs if (sources is None or s in sources) and (audience is None or audience in g or default in g)]
        want += plain_bm25([(100 * f + q, t) for q, t in ASKED], kept[f], 6)
    hits = R.bm25_filtered(queries, frame, 6)
    close(found(hits), sorted(want))
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()
    signed = queries.select("qid", "sources", "audience")
    listed = G.filtered(signed, frame)
    for f in kept:
        got = listed.where(f"qid = {100 * f + 1}")
        assert got.where("every").count() == (f == 0)
        if f:
            assert sorted(x["id"] for x in got.collect()) == sorted(d for d, _ in kept[f])
    totals = {x["qid"]: (x["n"], x["max_id"]) for x in G.filter_totals(signed, frame, {"n": F.count(F.lit(1)), "max_id": F.max("id")}).collect()}
    assert totals == {100 * f + q: (len(k), max(d for d, _ in k)) for f, k in kept.items() if k for q, _ in ASKED}


def test_filters_share_sets_of_sources(spark):
    """Questions of the same topics name one set; sources of the same sets are one class, however many there are."""
    rows = [(i, f"s{i % 40}", "tốt nghiệp" if i % 2 else "x") for i in range(400)]
    frame = spark.createDataFrame(rows, "id bigint, source string, text string").withColumn("semantic_tags", G.semantic_tags(F.col("text")))
    asked = spark.createDataFrame([(q, "xét tốt nghiệp" if q % 3 else "gì") for q in range(90)], "qid bigint, query string")
    signed, sets = G.topic_filters(asked, frame)
    assert sets.count() == 20 and signed.select("set").distinct().count() == 2 and signed.count() == 90
    classes, members = G.in_classes(frame, sets)
    assert classes.select("cls").distinct().count() == 2 and members.count() == 3
    spelled = {r["qid"]: r["sources"] for r in G.filter_signatures(asked, frame).collect()}
    assert spelled == {q: sorted(f"s{k}" for k in range(1, 40, 2)) if q % 3 else None for q in range(90)}


def test_bm25_keeps_no_pair_as_a_row(spark):
    """Tasks give k hits a question, not a row for each text that holds one of its words."""
    from marlstone.operators import scoring as B

    docs = spark.createDataFrame([(d, f"the w{d % 5}") for d in range(500)], "id bigint, text string").coalesce(1)
    texts_ = B.text_blocks(docs.select("id", F.split("text", " ").alias("words"), F.array(F.lit("*")).alias("places")))
    asked = spark.createDataFrame([(q, "", "the", 1.0) for q in range(20)], "qid bigint, sig string, term string, weight double")
    filters = spark.createDataFrame([("", 2.0, ["*"])], "sig string, avgdl double, places array<string>")
    hits = B.block_hits(B.asked_blocks(asked, filters, 20), texts_, False, 3, 1.5, 0.75)
    assert sorted((r["qid"], r["id"]) for r in hits.collect()) == [(q, d) for q in range(20) for d in range(3)]


def test_few_hits_meet_the_texts_where_they_lie(spark, small, monkeypatch):
    """Hits are searched for once however many steps read them, and no text is shuffled to meet them."""
    import marlstone.plans.retrieval as plans
    from marlstone.functions.frames import beside

    asked, own = [], plans.rrf_concat
    monkeypatch.setattr(plans, "rrf_concat", lambda *a: asked.append(a) or own(*a))
    assert plans.answers(spark, small).count() == plans.questions(spark, small).count()
    assert len(asked) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 99)], "qid bigint, id bigint")
        many = spark.range(9).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
        both = beside(few, many, "id")
        assert sorted((r["qid"], r["id"], r["text"]) for r in both.collect()) == [(1, 5, "t5"), (2, 5, "t5")]
        assert [r["id"] for r in beside(few.select("id"), many, "id", "left_semi").collect()] == [5]
        hits = few.where("id < 9").selectExpr("qid", "1 as rank", "id", "1.0D as score", "1.0D as rerank_score")
        chunks = many.selectExpr("id", "id as n", "'s' as source", "'a' as section", "text")
        wide = A.expanded(hits, chunks)
        for df in (both, A.reranked(beside(hits, many, "id").withColumn("query", F.lit("q")), OverlapReranker(), 5).select("qid", "id")):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["qid"], r["id"]) for r in wide.collect()) == [(1, 0), (1, 1), (1, 5), (2, 0), (2, 1), (2, 5)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_questions_of_a_block_take_little_memory(spark):
    """A block of questions is held in arrays, whatever it has met: some 12 bytes a term and 16 a hit."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from marlstone.operators import scoring as B

    one = lambda b: pa.StructArray.from_arrays(b.columns, names=b.schema.names)[0]
    n, each = 2000, 40
    terms = [f"w{i}" for i in range(500)]
    term = [(q * 7 + j * 11) % 500 for q in range(n) for j in range(each)]
    asked = one(B.row_batch(B.ASKED_DDL, (0, list(range(n)), [0] * n, [9.0], [["*"]], terms, [each * (q + 1) for q in range(n)], term, [0.5 + x / 7 for x in term])))
    texts_ = B.Texts(one(B.text_block(1, list(range(90)), [pa.array([f"w{(d * 13 + j) % 500}" for j in range(20)]) for d in range(90)], [20] * 90, [["*"]] * 90)))
    tracemalloc.start()
    held = B.Asked(asked, 20)
    held.meet(texts_, 1.5, 0.75)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < n * 1000  # as lists and arrays by question: over 3,000 bytes each
    assert held.batch().num_rows == np.count_nonzero(held.scores)


def test_questions_of_a_filter_share_blocks(spark, monkeypatch):
    """Questions are dealt out by filter: a filter's questions lie in as few blocks as hold them, none is lost."""
    from marlstone.operators import scoring as B

    monkeypatch.setattr(B, "ASKED_BLOCK", 10)
    asked = spark.createDataFrame([(q, f"s{q % 8}", "the", 1.0) for q in range(80)] + [(900 + q, "s9", "the", 1.0) for q in range(30)], "qid bigint, sig string, term string, weight double")
    filters = spark.createDataFrame([(f"s{i}", 2.0, ["*"]) for i in range(10)], "sig string, avgdl double, places array<string>")
    blocks = B.asked_blocks(asked, filters, 110, asked.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))).collect()
    assert sorted(q for b in blocks for q in b["keys"]) == [*range(80), *range(900, 930)]
    of = [{q % 8 if q < 900 else 9 for q in b["keys"]} for b in blocks]
    assert all(sum(i in x for x in of) == 1 for i in range(8)) and sum(9 in x for x in of) <= 3


def test_mean_weights_two_ways(spark):
    """The mean over a filter's terms, added up by task or by terms of equal frequencies, is the plain mean."""
    import math

    r = random.Random(8)
    cells = [(f"c{c}", k, f"t{t}", r.randint(1, 5)) for c in range(4) for k in "ab" for t in range(60) if r.random() < 0.4]
    common = [(s, f"c{c}", k) for s in ("x", "y", "z") for c in range(4) for k in "ab" if r.random() < 0.6]
    terms, sizes = spark.createDataFrame(cells, "cls string, key string, term string, df bigint"), spark.createDataFrame([("x", 100), ("y", 120), ("z", 140)], "sig string, n bigint")
    want = {}
    for s, n in (("x", 100), ("y", 120), ("z", 140)):
        dfs: dict = {}
        for c, k, t, df in cells:
            if (s, c, k) in common:
                dfs[t] = dfs.get(t, 0) + df
        want[s] = sum(math.log(n - d + 0.5) - math.log(d + 0.5) for d in dfs.values()) / len(dfs)
    for way in (R.mean_weights, R.mean_weights_by_kind):
        got = {x["sig"]: x["mean"] for x in way(terms, spark.createDataFrame(common, "sig string, cls string, key string"), sizes).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    none = R.mean_weights(terms, spark.createDataFrame([], "sig string, cls string, key string"), sizes)
    assert none.count() == 0


def test_many_questions_read_written_blocks(spark, monkeypatch, tmp_path):
    """Where both sides are dealt out, their blocks are kept, so no vector is worked out again for each part of the
    questions; and hits of many small blocks, ties among them, are those of the plain search."""
    import numpy as np

    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.integers(-2, 3, (90, 4)))]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)
    queries = vectors.where("id % 4 = 0").select(F.col("id").alias("qid"), "embedding")
    kept = []

    def keep(df):
        path = str(tmp_path / f"k{len(kept)}")
        kept.append(path)
        df.write.parquet(path)
        return spark.read.parquet(path)

    for name, n in (("MOST_BROADCAST", 5), ("VECTOR_BLOCK", 7), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(V, name, n)
    got = sorted((x["qid"], x["rank"], x["id"], x["score"]) for x in V.dense_topk(queries, vectors, 5, keep).collect())
    want = []
    for q, a in rows[::4]:
        best = sorted((-float(np.dot(a, b)), i) for i, b in rows)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert len(kept) == 2 and got == sorted(want)
