"""Runs over configurations, BERTScore, the cut by tokens, pair scoring, and sinks."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import evaluate as E
from marlstone.operators import qa as Q
from marlstone.operators.evaluation import Run
from marlstone.sources import io
from marlstone.sources.providers import CrossEncoder, DigestVectors, SharedWords, TokenCutter, cut_pair


def plain_bert(p, g):
    v = lambda ws: DigestVectors().of(ws)
    if not p or not g:
        return 0.0, 0.0, 0.0
    m = v(p) @ v(g).T
    a, b = m.max(1).mean(), m.max(0).mean()
    return a, b, 2 * a * b / (a + b)


def test_bert_score(spark, monkeypatch):
    rows = [("A", 1, "a b c a", "b c d"), ("A", 2, "same words", "same words"), ("B", 3, "", "x"), ("B", 4, None, None), ("B", 5, "x " * 50 + "y", "z y " * 30)]
    frame = spark.createDataFrame(rows, "config string, qid long, prediction string, gold string")
    got = {r["qid"]: (r["precision"], r["recall"], r["f1"]) for r in E.bert_score(frame).collect()}
    for _, qid, p, g in rows:
        assert got[qid] == pytest.approx(plain_bert((p or "").split(), (g or "").split()))
    monkeypatch.setattr(E, "MATCHED", 2)
    a, b = DigestVectors().of(list("abcde")), DigestVectors().of(list("cdx"))
    of_a, of_b = E.best_matches(a, b)
    assert np.allclose(of_a, (a @ b.T).max(1)) and np.allclose(of_b, (a @ b.T).max(0))
    times = spark.createDataFrame([("A", "a", False, 1.0), ("B", "b", True, 2.0)], "config string, label string, rag boolean, time_seconds double")
    out = {r["config"]: r for r in E.metrics(frame.withColumn("sources", F.array(F.lit("x"))).withColumn("gold_source", F.lit("x")), times).collect()}
    assert out["A"]["bertscore_f1"] == pytest.approx(50 * (got[1][2] + got[2][2])) and out["A"]["recall_at_5"] is None and out["B"]["recall_at_5"] == 100


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    """Answered questions are not asked again; failed ones are; counters and results are files that can be read."""
    folder, seen = f"file://{tmp_path}/run", []
    asked = spark.createDataFrame([(k, f"what is it that {k} means") for k in range(10)], "qid long, question string")
    gold = asked.select("qid", F.col("question").alias("gold"), F.lit("S").alias("gold_source"))
    ticks = iter(range(100))
    run = Run(spark, folder, every=3, clock=lambda: float(next(ticks)))

    def answerer(fails):
        def answer(rows):
            seen.append(sorted(r["qid"] for r in rows.collect()))
            return rows.select("qid", F.when(~F.col("qid").isin(fails), F.col("question")).alias("prediction"), F.array(F.lit("the s")).alias("sources"))

        return answer

    run.answer("A", asked.where("qid < 6"), answerer([4]))
    run.answer("A", asked, answerer([9]))
    run.answer("B", asked, answerer([]))
    assert sorted(sum(seen, [])) == sorted([*range(6), 4, *range(6, 10), *range(10)])
    counts = sorted((r["config"], r["success"], r["error"], r["skip"], r["chars"], r["time_seconds"]) for r in run.counters().collect())
    assert counts == [("A", 4, 1, 5, 92, 1.0), ("A", 5, 1, 0, 115, 1.0), ("B", 10, 0, 0, 230, 1.0)]
    out = {r["config"]: r for r in run.results(gold, {"A": "plain", "B": "more"}).collect()}
    assert out["A"]["num_samples"] == 9 and out["A"]["runs"] == 2 and out["A"]["time_seconds"] == 2.0 and out["B"]["recall_at_5"] == 100 and out["A"]["bleu"] == pytest.approx(100)
    lines = [json.loads(x) for p in tmp_path.glob("run/results/part-*") for x in p.read_text().splitlines()]
    assert {x["config"]: x["recall_at_5"] for x in lines} == {"A": None, "B": 100.0}


@pytest.mark.parametrize("limit", [5, 12, 2048])
def test_cut_by_tokens(spark, limit):
    """At most so many tokens, whole characters, and no more cut than that."""
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(file)
    own.encode_special_tokens = True
    texts = ["", None, "short", "Điều 5 khoản 2 của quy chế đào tạo " * 5, "日本語" * 9, "👍🏽 ok " * 7, "<|endoftext|> a <|endoftext|> b c d e f", "word " * 3000]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["c"] for r in frame.select("k", TokenCutter(file, limit).cut(F.col("t")).alias("c")).collect()}
    n = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] is None
            continue
        assert t.startswith(got[k]) and n(got[k]) <= limit and (got[k] == t) == (n(t) <= limit)
        if got[k] != t:
            assert n(t[: len(got[k]) + 1]) > limit or n(t[: len(got[k]) + 1]) == n(got[k]) or own.encode(t, add_special_tokens=False).offsets[limit][0] == len(got[k])
    rows = spark.createDataFrame([("q", "a" * 50, "c")], "question string, answer string, chunk_id string").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("answer").alias("content"))))
    assert n(Q.training_rows(rows, TokenCutter(file, limit)).first()["text"]) <= limit


def test_pairs_are_scored_in_batches(spark):
    assert cut_pair(list("abcdef"), list("xy"), 5) == (list("abc"), list("xy")) and cut_pair(list("ab"), list("uvwxyz"), 5) == (list("ab"), list("uvw"))
    assert cut_pair(list("abcdef"), list("uvwxyz"), 5) == (list("abc"), list("uv")) and cut_pair(["a"], ["b"], 5) == (["a"], ["b"])
    for a in range(8):
        for b in range(8):
            x, y = cut_pair(list("abcdefgh")[:a], list("stuvwxyz")[:b], 5)
            assert len(x) + len(y) == min(5, a + b)
    frame = spark.createDataFrame([(k, "one two", "two three one" if k % 2 else "nothing") for k in range(150)] + [(200, None, "x"), (201, "", None)], "k int, q string, t string")
    got = {r["k"]: r["s"] for r in frame.select("k", CrossEncoder(SharedWords(), batch=16).score(F.col("q"), F.col("t")).alias("s")).collect()}
    assert all(got[k] == (5.0 if k % 2 else -5.0) for k in range(150)) and got[200] == got[201] == -5.0


def test_json_array_and_texts(spark, tmp_path):
    rows = [(k, f'đ "{k}"\n') for k in range(30)]
    frame = spark.createDataFrame(rows, "k long, t string").repartition(4)
    io.write_json_array(frame, f"file://{tmp_path}/a", "k")
    whole = next(tmp_path.glob("a/part-*")).read_text(encoding="utf-8")
    assert [(x["k"], x["t"]) for x in json.loads(whole)] == rows and "đ" in whole and whole.startswith('[\n  {\n    "k"')
    io.write_json_array(frame.limit(0), f"file://{tmp_path}/b", "k")
    assert json.loads(next(tmp_path.glob("b/part-*")).read_text()) == []
    docs = spark.createDataFrame([("a/b", "x\ny"), ("c", ""), (None, "z")], "source string, text string")
    io.write_keyed(docs, f"file://{tmp_path}/k")
    assert sorted(map(str, io.read_keyed(spark, f"file://{tmp_path}/k").collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError):
        io.write_texts(docs, f"file://{tmp_path}/t", most=2)
    raw = spark.createDataFrame([("a", " x "), ("b", " y ")], "source string, text string")
    first = {r["source"]: (r["text"], r["was_clean"]) for r in io.clean_and_keep(raw.limit(1), f"file://{tmp_path}/c", F.trim).collect()}
    again = {r["source"]: (r["text"], r["was_clean"]) for r in io.clean_and_keep(raw, f"file://{tmp_path}/c", F.upper).collect()}
    assert first == {"a": ("x", False)} and again == {"a": ("x", True), "b": (" Y ", False)}


@pytest.mark.parametrize("most", [10, 2])
def test_texts_beyond_a_file_each(spark, tmp_path, most):
    """However many documents there are, all are written and come back."""
    docs = spark.createDataFrame([("a b", "x\ny"), ("c", ""), ("d", "z\n")], "source string, text string")
    got = io.kept_texts(docs, f"file://{tmp_path}/t", most)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
    assert len(list(tmp_path.glob("t/**/*.txt"))) == (3 if most == 10 else 0)


def test_what_fits_by_its_bytes_meets_no_tokenizer():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer, normalizers

    from marlstone.sources.providers import by_bytes, fits_by_bytes, fits_by_characters

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    assert by_bytes(own)
    assert fits_by_bytes("word " * 400, 2048) and not fits_by_characters("word " * 400, 2048)
    r = random.Random(4)
    for k in range(200):
        text = "".join(r.choice("ab \nàđế日本👍́~\x00") for _ in range(r.randint(0, 60)))
        n = len(own.encode(text, add_special_tokens=False).ids)
        for limit in (n - 1, n, 40):
            assert not fits_by_bytes(text, limit) or n <= limit
    own.normalizer = normalizers.NFKC()
    assert not by_bytes(own)


def test_strip_by_a_list_is_strip_by_the_class(spark):
    from marlstone.functions.rules import WS
    from marlstone.functions.text import WS_CHARS, strip

    assert spark.range(1).select(F.regexp_replace(F.lit(WS_CHARS), f"[{WS}]", "")).first()[0] == ""
    texts = [*(f"{c}a{c}b{c}" for c in WS_CHARS), " ", "", "\n　x\r\n", "​x​", "ế ", "x\n \n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("a"), F.regexp_replace("t", f"^[{WS}]+|[{WS}]+$", "").alias("b")).collect()
    assert all(x["a"] == x["b"] == (x["t"].strip() if x["t"] is not None else None) for x in rows)


def test_chat_rows_move_no_whole_text(spark):
    """What is joined of a chunk is as long as a row may have, not the chunk's text."""
    chunks = spark.createDataFrame([("c", "x" * 9000), ("d", ""), ("e", None)], "id string, text_for_generation string").withColumn("semantic_tags", F.expr("named_struct('doi_tuong', array('p'), 'loai_van_ban', array('k'), 'do_quan_trong', 'h')"))
    pairs = spark.createDataFrame([(c, "q?", "a") for c in "cdef"], "chunk_id string, question string, answer string")
    out = Q.chat_rows(pairs, chunks, "s")
    said = {r["chunk_id"]: r["messages"][1]["content"] for r in out.collect()}
    assert said["d"] == said["e"] == said["f"] == "q?" and said["c"].count("x") == 1200 and said["c"].endswith("q?")
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert "text_for_generation" not in node.output().mkString()
    assert [c.split("#")[0] for c in node.right().output().mkString(" ").split()] == ["chunk_id", "grounding"]
