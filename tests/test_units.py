"""Edge rows of single operators."""
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.rules import VIETNAMESE
from marlstone.operators import answering as A
from marlstone.operators import chunking as C
from marlstone.operators import evaluate as E
from marlstone.operators import generation as M
from marlstone.operators import lines as L
from marlstone.operators import qa as Q
from marlstone.operators import retrieval as R
from marlstone.operators import tagging as G
from marlstone.sources import io
from marlstone.sources.providers import CallPolicy, HashEmbedder, PlainPages, RateLimited, first_reading
from marlstone.streaming import incremental as I


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("a\nb\nc", "a b\nc"), ("word \nnext", "word\nnext"), ("x --- Trang 2/9 --- y", "x\ny"), ("\t a  \n b", "a\nb"),
    ("SV, ĐH/SV P.ĐH xSV SV.", "sinh viên, ĐH/SV P.đại học xSV sinh viên."), ("Ðiều 1", "Điều 1"), ("a\x07b[Con dấu]", "ab"), ("", ""),
])
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want


def test_clean_keeps_its_order(spark):
    """Blank lines are capped before lines are stripped, so cleaning twice may differ from once."""
    assert one(spark, "a\n\n \n\nb", T.clean_text) == "a\n\n\n\nb"
    assert one(spark, "a\n\n \n\nb", lambda t: T.clean_text(T.clean_text(t))) == "a\n\nb"


def test_fix_page(spark):
    assert one(spark, "Ill lI Il", T.fix_page) == "IIl II II"
    assert one(spark, "é", T.nfc) == "é"


@pytest.mark.parametrize("text,want", [("a\nb\na\nc\n a", "a\nb\nc"), ("a\na\nb", "a\na\nb"), ("\n\n\nx", "x"), ("", ""), ("x\nx\nx", "x")])
def test_repeated_lines(spark, text, want):
    assert one(spark, text, L.drop_repeated_lines) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", " b", "c", ""]), max_size=12), st.integers(2, 4))
def test_repeated_lines_by_counting(spark, rows, least):
    count, seen, out = {}, set(), []
    for r in rows:
        count[r.strip()] = count.get(r.strip(), 0) + 1
    for r in rows:
        k = r.strip()
        if k and count[k] >= least and k in seen:
            continue
        seen.add(k)
        out.append(r)
    assert one(spark, "\n".join(rows), lambda t: L.drop_repeated_lines(t, least)) == "\n".join(out).strip()


def test_small_functions(spark):
    assert one(spark, "a.b. c; d", T.sentences) == ["a.b.", "c;", "d"]
    assert one(spark, "Đề_1 Số-2", T.tokens) == ["đề_1", "số", "2"]
    assert one(spark, 'x ```json\n[1, [2]]\n``` y', lambda t: T.json_part(t, "[", "]")) == "[1, [2]]"
    assert one(spark, "none", lambda t: T.json_part(t, "[", "]")) is None
    assert one(spark, "ab" * 700, lambda t: T.truncated(t, 1200)) == "ab" * 600 + "..." and one(spark, "a" * 1200, lambda t: T.truncated(t, 1200)) == "a" * 1200
    assert one(spark, "", lambda t: T.header_line(F.lit("s"), t, F.lit("Điều 1"))) == "[s] - Điều 1"


def chunks(spark, text):
    docs = spark.createDataFrame([("s", text)], "source string, text string")
    return [(r["section"], r["chapter"], r["text"]) for r in C.chunk_documents(docs).orderBy("pos").collect()]


def test_sections(spark):
    body = "nội dung " * 8
    got = chunks(spark, f"{'mở ' * 20}\nChương I\nĐiều 1 {body}\nĐiều 2 {body}\nMục 1 x")
    assert [(s, c) for s, c, _ in got] == [("Phần mở đầu", ""), ("Điều 1", "Chương I"), ("Điều 2", "Chương I")]
    two = chunks(spark, f"Điều 1 {body}\nĐiều 2 {body}")
    assert [(s, c) for s, c, _ in two] == [("", "")]


@pytest.mark.parametrize("n,parts", [(2304, 1), (2305, 3)])
def test_section_sizes(spark, n, parts):
    head = "Điều 1 "
    para = ("x" * 1100 + "\n\n") * 2
    text = (head + para + "y" * n)[:n]
    assert len([c for c in chunks(spark, text + "\nĐiều 2 " + "z" * 60 + "\nĐiều 3 " + "z" * 60) if c[0] == "Điều 1"]) == parts


def fold(rows, limit, least=None, overlap=False):
    """Packing as a loop, for comparison."""
    out, buf = [], ""
    for p in rows:
        if overlap:
            p = p.strip()
            if not p:
                continue
        if len(buf) + len(p) > limit:
            if buf.strip() and (least is None or len(buf.strip()) >= least):
                out.append(buf.strip())
            dots = buf.strip().split(".")
            buf = ((". ".join(dots[-2:]) if len(dots) > 1 else "") + "\n\n" if overlap else "") + p + "\n\n"
        else:
            buf += p + "\n\n"
    if buf.strip() and (least is None or len(buf.strip()) >= least):
        out.append(buf.strip())
    return out


def test_packing(spark):
    r = random.Random(1)
    for _ in range(6):
        rows = [r.choice(["", " ", "a. b", "x" * r.randint(1, 40), "y. z " * r.randint(1, 8)]) for _ in range(12)]
        frame = spark.createDataFrame([(rows,)], "p array<string>")
        got = frame.select(C.packed(F.col("p"), 50).alias("a"), C.packed_with_overlap(F.col("p"), 50, 12).alias("b")).first()
        assert (got["a"], got["b"]) == (fold(rows, 50), fold(rows, 50, 12, True))


def test_tables(spark):
    frame = spark.createDataFrame([(["t", "|a|", "x\n |b|", "u", "|c|"],)], "p array<string>")
    assert frame.select(C.merge_tables(F.col("p")).alias("x")).first()["x"] == ["t", "|a|\nx\n |b|", "u", "|c|"]


def test_merge_tiny(spark):
    rows = [("a", i, n) for i, n in enumerate([3, 100, 5, 6, 90, 7])] + [("b", i, n) for i, n in enumerate([4, 5])]
    frame = spark.createDataFrame([(s, i, "", "", chr(97 + i) * n, f"H{i}") for s, i, n in rows], "source string, pos bigint, section string, chapter string, text string, text_with_context string")
    got = {(r["source"], r["pos"]): r for r in C.merge_tiny(frame, 80).collect()}
    assert set(got) == {("a", 1), ("a", 4), ("b", 0)}
    assert got["a", 1]["text"] == "a" * 3 + "\n" + "b" * 100
    assert got["a", 4]["text_with_context"] == "[a]\n" + "c" * 5 + "\n" + "d" * 6 + "\n" + "e" * 90 + "\nH5"
    assert got["b", 0]["text_with_context"] == "H0\n" + "b" * 5


def test_split(spark):
    schema = "id string, source string, section string, chapter string, text string"
    long = "x" * 5000
    tab = "h1\nh2\n" + "\n\n".join(["row " * 300] * 4) + "\n|"
    rows = C.split_oversized(spark.createDataFrame([("c1", "s", "", "", long), ("c2", "s", "", "", tab), ("c3", "s", "", "", "short")], schema)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert [(r["sub_index"], r["pre_norm_parent_id"]) for r in by["c1"]] == [(0, "c1")]
    assert len(by["c2"]) > 1 and all(r["text"].startswith("h1\nh2\n") for r in by["c2"])
    assert [(r["sub_index"], r["pre_norm_parent_id"]) for r in by["c3"]] == [(None, None)]


def test_tags_and_topics(spark):
    t = one(spark, "điều kiện học bổng", G.semantic_tags)
    assert (t["doi_tuong"], t["loai_van_ban"], t["do_quan_trong"]) == (["tất cả"], ["quy định"], "cao")
    assert one(spark, "GPA tốt nghiệp", G.topics) == ["tot_nghiep", "thuc_tap"]
    assert one(spark, "gv hỏi sinh viên", G.audience_of) == "sinh viên" and one(spark, "x", G.audience_of) is None


@pytest.mark.parametrize("n", [19, 20])
def test_guards(spark, n):
    """A filter that leaves under 20 chunks is not applied."""
    rows = [(i, "a" if i < n else "b", "tốt nghiệp" if i == 0 else "x") for i in range(60)]
    frame = spark.createDataFrame(rows, "id bigint, source string, text string").withColumn("semantic_tags", G.semantic_tags(F.col("text")))
    asked = spark.createDataFrame([(1, "xét tốt nghiệp"), (2, "gì")], "qid bigint, query string")
    got = {r["qid"]: r["sources"] for r in G.filter_signatures(asked, frame).collect()}
    assert got == {1: ["a"] if n == 20 else None, 2: None}


def test_variants(spark):
    assert one(spark, "bị đuổi học vì rớt môn", A.variants) == ["bị đuổi học vì rớt môn", "bị buộc thôi học vì không đạt môn"]
    assert one(spark, "Khoản 2", A.variants) == ["Khoản 2"]
    assert one(spark, "Điều 5 khoản 2", A.variants) == ["Điều 5 khoản 2", "Điều 5", "Điều 5 Khoản 2"]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 2, "y"), (1, 1, 1, "y")], "qid bigint, list_no int, rank int, id string")
    score = lambda f: {r["id"]: r["score"] for r in f(hits).collect()}
    assert score(R.rrf_concat) == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 63}, abs=1e-8)
    assert score(R.rrf_per_list) == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61}, abs=1e-8)


def expand_by_loop(hits, members, section_of, most=2):
    seen, out = {h for h in hits}, []
    for h in hits:
        added = 0
        walks = [(members[section_of[h]], "hierarchical_section")] if section_of[h] else []
        walks.append(([m for m in members[section_of[h]] if m != h], "hierarchical_parent"))
        for group, method in walks:
            for m in group:
                if m in seen or added >= most:
                    break
                seen.add(m)
                out.append((m, method))
                added += 1
    return out


def test_expansion(spark):
    r = random.Random(2)
    section_of = {i: r.choice(["", "A", "B", "C"]) for i in range(24)}
    members = {s: [i for i in range(24) if section_of[i] == s] for s in ["", "A", "B", "C"]}
    frame = spark.createDataFrame([(i, i, "src", s) for i, s in section_of.items()], "id bigint, n bigint, source string, section string")
    sets = {q: r.sample(range(24), r.randint(1, 5)) for q in range(12)}
    hits = spark.createDataFrame([(q, k + 1, h, 1.0, -2.0) for q, hs in sets.items() for k, h in enumerate(hs)], "qid bigint, rank int, id bigint, score double, rerank_score double")
    got = {}
    for row in A.expanded(hits, frame).where("method <> 'hit'").orderBy("qid", "ord").collect():
        got.setdefault(row["qid"], []).append((row["id"], row["method"]))
    assert got == {q: w for q, hs in sets.items() if (w := expand_by_loop(hs, members, section_of))}


@pytest.mark.parametrize("score,verdict", [(0.5, "CORRECT"), (0.49, "AMBIGUOUS"), (-2.0, "AMBIGUOUS"), (-2.01, "INCORRECT"), (None, "INCORRECT")])
def test_gate(spark, score, verdict):
    asked = spark.createDataFrame([(1,)], "qid bigint")
    hits = spark.createDataFrame([(1, score)] if score is not None else [], "qid bigint, rerank_score double")
    crag = A.gate(asked, hits).first()["crag"]
    assert (crag["verdict"], crag["top_score"]) == (verdict, score or 0.0)


@pytest.mark.parametrize("n,kept", [(10, 10), (11, 10)])
def test_compression(spark, n, kept):
    text = " ".join(f"Câu số {i} " + "x" * 160 + "." for i in range(n))
    row = [(1, "câu", 1, "s", "", "", text), (2, "câu", 1, "s", "", "", "z" * 1499), (3, "câu", 1, "s", "", "", "z. " * 600)]
    hits = spark.createDataFrame(row, "qid bigint, query string, ord int, source string, chapter string, section string, text string")
    for embedder in (None, HashEmbedder()):
        got = {r["qid"]: r["context"] for r in A.compressed(hits, embedder).collect()}
        assert got[1].count("Câu số") == kept and got[2] == "[s]\n" + "z" * 1499 and 3 not in got


def test_answers_and_display(spark):
    shown = spark.range(1).select(A.displayed(F.lit("a"), F.array(F.lit("s"), F.lit("s"), F.lit("t"), F.lit("u")), F.array(F.lit(""), F.lit("Điều 1"))).alias("x")).first()["x"]
    assert shown == "a\n\n📚 **Nguồn:** s, t\n📋 **Phần:** Điều 1"
    p = lambda c, m: spark.range(1).select(A.prompt(F.lit("q"), F.lit(c), F.lit(m)).alias("x")).first()["x"]
    assert p("", "") == "q" and p("", "m") == "[m]\n\nCâu hỏi: q" and "---\nc\n---" in p("c", "m")


def test_qa(spark):
    text = "Nếu sinh viên vi phạm nhiều lần thì bị kỷ luật theo quy chế hiện hành. Thủ tục gồm 3 tín chỉ và hồ sơ đầy đủ nộp. Quy định nhằm giữ trật tự trong trường học."
    frame = spark.createDataFrame([("c", "s", "Điều 1", text), ("d", "s", "", "ngắn.")], "id string, source string, section string, text string")
    rows = Q.template_pairs(frame).orderBy("ord").collect()
    assert [(r["type"], r["question"]) for r in rows] == [
        ("factual", "Điều 1 quy định những nội dung gì?"), ("factual", "Theo Điều 1, số tín chỉ được quy định như thế nào?"),
        ("conditional", "Điều gì xảy ra trong trường hợp được nêu tại Điều 1?"), ("procedural", "Theo Điều 1, thủ tục được quy định thế nào?"),
    ]
    assert spark.range(1).select(Q.answer_of(F.array(F.lit("a."), F.lit("b.")), 3).alias("x")).first()["x"] == "a.. b."


def test_parse(spark):
    reply = '```json\n[{"question": "q", "answer": "a", "type": "x"}, {"question": "q2", "answer": " "}, 5, {"question": 1, "answer": 2}]\n```'
    frame = spark.createDataFrame([("c", "s", "", reply), ("d", "s", "", "[broken"), ("e", "s", "", None)], "chunk_id string, source string, section string, reply string")
    assert [(r["question"], r["answer"], r["type"]) for r in Q.parsed_pairs(frame).orderBy("ord").collect()] == [("q", "a", "factual"), ("1", "2", "factual")]


@pytest.mark.parametrize("n,test", [(3, 0), (249, 49), (250, 50), (1000, 50)])
def test_split_sizes(spark, n, test):
    frame = spark.createDataFrame([(f"q{i}", "a", "c") for i in range(n)], "question string, answer string, chunk_id string")
    got = {r["split"]: r["count"] for r in Q.split_pairs(frame).groupBy("split").count().collect()}
    assert got.get("test", 0) == test and got["train"] == n - test


def test_metrics(spark):
    lcs = lambda a, b: E.lcs_length(a.split(), b.split())
    assert lcs("a b c d", "b x d") == 2 and lcs("a", "b") == 0 and lcs("a b a b a", "b a a b") == 3
    same = spark.createDataFrame([("A", 1, "Xin chào ab, cd ef gh.", "Xin chào ab, cd ef gh.")], "config string, qid bigint, prediction string, gold string")
    assert E.corpus_bleu(same).first()["bleu"] == pytest.approx(100)
    assert same.select(E.rouge_l("prediction", "gold").alias("x")).first()["x"] == 1.0
    assert E.bleu_of([(3, 4), (2, 3), (1, 2), (0, 1)], 4, 5) == pytest.approx(100 * math.exp(-0.25) * (3 / 4 * 2 / 3 * 1 / 2 * 1 / 2) ** 0.25)
    hit = lambda s, g: spark.createDataFrame([(s, g)], "s array<string>, g string").select(E.is_hit(F.col("s"), F.col("g")).alias("x")).first()["x"]
    assert hit(["a"], "") and not hit([], "") and hit(list("abcde"), "E") and not hit(list("abcdef"), "f")


def test_equal_pairs_are_split(spark):
    """Equal pairs, all at one place of the order: as many are test rows as of different ones."""
    frame = spark.createDataFrame([("q", "a", "c")] * 20 + [("other", "a", "c")] * 5, "question string, answer string, chunk_id string")
    got = Q.split_pairs(frame).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"test": 5, "train": 20}


def test_null_sources_keep_their_rows(spark):
    frame = spark.createDataFrame([(None, 0, "x"), ("a", 0, "y"), ("a", 1, "z"), (None, 1, "w")], "source string, pos int, text string")
    got = {r["text"]: r["id"] for r in C.with_ids(frame).collect()}
    assert got == {"x": "chunk_0000", "w": "chunk_0001", "y": "chunk_0002", "z": "chunk_0003"}
    rows = C.with_ids(frame).withColumn("section", F.lit(None).cast("string"))
    assert {r["id"]: r["siblings"] for r in C.sibling_lists(rows, "section").collect()} == {"chunk_0000": ["chunk_0001"], "chunk_0001": ["chunk_0000"], "chunk_0002": ["chunk_0003"], "chunk_0003": ["chunk_0002"]}


def test_call_policy():
    """The breaker counts refused calls, not items; the model that takes over goes on with the item at hand."""
    waits, calls = [], []

    def call(model, item):
        calls.append((model, item[0]))
        if model == "m1" and item[0] > 0:
            raise RateLimited(2.0 if item[0] == 1 else None)
        if model == "m2" and item[0] == 4:
            raise ValueError("bad")
        return f"{model}:{item[0]}"

    policy = CallPolicy(("m1", "m2"), sleep=waits.append)
    got = list(policy.run(iter([(k,) for k in range(5)]), call))
    assert got == [((0,), "m1:0"), ((1,), None), ((2,), "m2:2"), ((3,), "m2:3"), ((4,), None)]
    assert calls.count(("m1", 1)) == 3 and calls.count(("m1", 2)) == 2 and calls.count(("m2", 4)) == 3
    assert [w for w in waits if w != 1.0] == [7.0, 7.0, 7.0, 60.0, 10.0, 5.0, 5.0, 5.0]
    none = CallPolicy(("m1",), breaker=2, sleep=waits.append)
    assert [r for _, r in none.run(iter([(0,), (1,), (1,), (0,)]), call)] == ["m1:0", None, None, None]  # no model is left


def counting(folder):
    """A service that notes each call in a folder."""

    def call(model, item):
        key = item[0]
        (folder / f"{key}-{len(list(folder.glob(f'{key}-*')))}").touch()
        return {"c1": "[{broken", "c2": "no list at all", "c3": "[{]"}.get(key, f'[{{"question": "about {key}?", "answer": "{key}"}}]')

    return call


def test_calls_are_made_once(spark, tmp_path):
    """Pairs and what is done come from one reply each; a broken list is asked again and stays pending; a later run asks
    only what the log lacks."""
    frame = spark.createDataFrame([(f"c{k}", "s", "", "t") for k in range(12)], "chunk_id string, source string, section string, text string").repartition(3)
    done = spark.createDataFrame([("c0",)], "chunk_id string")
    notes = tmp_path / "notes"
    notes.mkdir()
    quick = lambda: CallPolicy(("m",), sleep=lambda s: None)
    log = f"file://{tmp_path}/log"
    pairs, now = M.generated_pairs(frame, done, F.col("text"), quick, counting(notes), log, every=4)
    assert sorted(r["chunk_id"] for r in pairs.collect()) == sorted(r["chunk_id"] for r in now.collect() if r["chunk_id"] not in ("c1", "c2"))
    assert pairs.count() == 8 and {r["chunk_id"] for r in now.collect()} == {f"c{k}" for k in range(1, 12)} - {"c3"}
    times = lambda: {k: len(list(notes.glob(f"c{k}-*"))) for k in range(12)}
    first = times()
    assert first == {k: 0 if k == 0 else 3 if k == 3 else 1 for k in range(12)}
    M.generated_pairs(frame, done, F.col("text"), quick, counting(notes), log, every=4)[0].count()
    assert times() == first | {3: 6}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("một\nhai", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"p1\fp2")
    assert [tuple(r) for r in io.read_texts(spark, str(tmp_path)).collect()] == [("a", "một\nhai")]
    pages = io.read_pages(io.read_files(spark, str(tmp_path)), lambda content: iter(content.split(b"\f")))
    read = pages.select("source", "page_no", "total_pages", first_reading(F.col("image"), [PlainPages()]).alias("text"))
    assert L.assemble_pages(read).first()["text"] == "--- Trang 1/2 ---\np1\n\n--- Trang 2/2 ---\np2"
    (tmp_path / "bad.json").write_text("{broken")
    assert io.read_or_empty(spark, str(tmp_path / "bad.json"), io.SCHEMAS["ocr_progress"]).count() == 0
    assert io.read_or_empty(spark, str(tmp_path / "none.json"), io.SCHEMAS["ocr_progress"]).count() == 0
    stage = io.write_stage(read, str(tmp_path / "stage"))
    assert stage.count() == 2
    io.write_report_csv(stage.select("source", "page_no"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfsource")


def test_resume(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    progress = spark.createDataFrame([(["a", "b"],)], "completed_files array<string>")
    outputs = spark.createDataFrame([("a", 101), ("b", 100)], "source string, length bigint")
    assert [r["source"] for r in I.finished_files(files, progress, outputs).collect()] == ["a"]
    sink = I.merge_done(str(tmp_path / "done"), "source")
    for k in range(2):  # a batch that is run again adds nothing
        sink(files, k)
    assert spark.read.parquet(str(tmp_path / "done")).count() == 3


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "z")], "source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    run = lambda: I.stream_documents(spark, str(tmp_path / "in"), "source string, text string", lambda d: d.select("source", T.clean_text(F.col("text")).alias("text")), I.merge_done(str(tmp_path / "out"), "source"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "x y"), ("b", "z")]


def test_plans_keep_their_shape(spark, small):
    """Top-k is cut before the shuffle; built-in cleaning has no Python in its plan."""
    from marlstone.plans import cleaning, retrieval

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(retrieval.bm25_topk(spark, small))
    assert not any(x in plan(cleaning.clean_text(spark, small)) for x in ("Python", "Arrow"))


def test_sizes_are_the_defaults():
    assert (VIETNAMESE.sizes.chunk, VIETNAMESE.sizes.oversized, VIETNAMESE.sizes.top_k) == (768, 3000, 20)


def test_checkpoints_settings_and_shares(spark, monkeypatch):
    from marlstone.operators.rag import latest
    from marlstone.sources.settings import Settings

    files = spark.createDataFrame([("r", "a/checkpoint-9"), ("r", "a/checkpoint-10"), ("r", "a/other"), ("s", "b/checkpoint-1")], "run string, path string")
    assert sorted((r["run"], r["step"]) for r in latest(files).collect()) == [("r", 10), ("s", 1)]
    monkeypatch.delenv("MODEL_SERVICE_KEY", raising=False)
    assert Settings.from_env().offline
    monkeypatch.setenv("MODEL_SERVICE_KEY", "k")
    assert not Settings.from_env().offline
    n = Q.held_out_share(spark.range(4000).withColumnRenamed("id", "k"), "k").where("is_eval").count()
    assert 130 < n < 270
