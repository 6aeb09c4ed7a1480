"""Small cases with known answers: the Vietnamese word lists, the quirks, the exact ways beside the fast ones."""
import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta import joins
from statuta.functions import citations as C
from statuta.functions import fixed_values as V
from statuta.functions import keywords as K
from statuta.functions import text as T
from statuta.operators import answers as A
from statuta.operators import boosts as B
from statuta.operators import chunking as CH
from statuta.operators import cleaning as CL
from statuta.operators import context as X
from statuta.operators import decisions as D
from statuta.operators import evaluation as E
from statuta.operators import matching as M
from statuta.operators import reports as P
from statuta.operators import retrieval as R
from statuta.operators import store as ST
from statuta.operators import structure as S
from statuta.operators import vectors as VE
from statuta.sources import documents as SD
from statuta.sources import lines as SL
from statuta.streaming import flows as L


def one(spark, column, **values):
    """Value of a column expression over one row of the given values."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


# ---- text -------------------------------------------------------------------


def test_page_merge_order_and_noise(spark):
    pages = spark.createDataFrame(
        [(1, "page_10", "cuối trang"), (1, "page_2", "7\na\nTrang 3\nĐiều 1. X"), (1, "page_3", "")], "doc_id long, page_key string, text string"
    )
    assert CL.merge_pages(pages).first()["text"] == "\n[PAGE_2]\nĐiều 1. X\n\n\n[PAGE_10]\ncuối trang"


def test_whitespace_is_single_pass(spark):
    assert one(spark, T.single_pass_spaces(F.col("t")), t="a   b") == "a  b"


def test_repair(spark):
    got = one(spark, T.repaired(F.col("t")), t="l. x\nl. Phạm vi C0NG| thực hi- \n ện S0")
    assert got == "l. x\n1. Phạm vi CỘNG thực hiện SỐ"


def test_tokens_fall_back_to_words(spark):
    assert one(spark, T.tokens(F.col("t")), t="Điều 5, Ủy ban") == ["điều", "5", "ủy", "ban"]
    assert one(spark, T.tokens(F.col("t")), t="?? !!") == ["??", "!!"]


def test_scope(spark):
    for query, out in (("", True), ("2+2 bằng mấy", True), ("luật 2+2", False), ("xin chào", False)):
        assert one(spark, CL.out_of_scope(F.col("q")), q=query) is out


def test_keywords(spark):
    assert one(spark, K.keywords(F.col("q")), q="Thẩm quyền xử phạt của Bộ") == ["thẩm quyền", "xử phạt", "bộ"]
    assert one(spark, K.query_type(F.col("q")), q="Thủ tục và lệ phí") == "thủ tục,phí"


def test_missing_info(spark):
    kind = K.missing_info(F.col("q"))["kind"]
    assert one(spark, kind, q="ở địa phương này thì nộp bao nhiêu vậy") == "location"
    assert one(spark, kind, q="Bao nhiêu") == "detail"


def test_document_metadata(spark):
    text = "BỘ TƯ PHÁP\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do\nSố: 12/NĐ-CP\nngày 3 tháng 4 năm 2025\nNghị định về Luật"
    assert tuple(one(spark, CL.document_metadata(F.col("t")), t=text)) == ("12/NĐ-CP", "3/4/2025", "NGHỊ ĐỊNH", "BỘ TƯ PHÁP")


# ---- structure --------------------------------------------------------------

LAW = """NGHỊ ĐỊNH
Về hộ tịch
Căn cứ Luật
Chương I
NHỮNG QUY ĐỊNH
Điều 1. Phạm vi
a) mất
1. Khoản một
Chương III của Luật Hộ tịch
a) điểm a
tiếp theo
2. Gồm: a) trong dòng
[PAGE_2]
Diu 5. Sai chính tả
Mục 1
1. Cuối
Nơi nhận: ai
bị bỏ
Phụ lục I
mẫu đơn"""


def parsed(spark, text):
    lines = S.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = S.parse(lines).orderBy("node_id").collect()
    return lines, [(r["level"], r["chuong"], r["dieu"], r["khoan"], r["diem"], r["noi_dung"], r["page_number"]) for r in rows]


def test_parse(spark):
    lines, nodes = parsed(spark, LAW)
    assert nodes == [
        ("article", "I", "1", None, None, "Phạm vi", 1),
        ("clause", "I", "1", "1", None, "Khoản một Chương III của Luật Hộ tịch", 1),
        ("point", "I", "1", "1", "a", "điểm a tiếp theo", 1),
        ("clause", "I", "1", "2", None, "Gồm", 1),
        ("point", "I", "1", "2", "a", "trong dòng", 1),
        ("article", "I", "5", None, None, "Sai chính tả", 2),
        ("clause", "I", "5", "1", None, "Cuối", 2),
    ]
    assert S.titles(lines).first()["ten_van_ban"] == "NGHỊ ĐỊNH Về hộ tịch"
    assert S.appendices(lines).first()["noi_dung"] == ["mẫu đơn"]
    dropped = {(r["content"], r["reason"]) for r in S.dropped_lines(lines).collect()}
    assert ("mất", "point without clause") in dropped and ("bị bỏ", "no open node") in dropped


def test_parse_default_chapter_and_title(spark):
    lines, nodes = parsed(spark, "Điều 1. X")
    assert nodes == [("article", "0", "1", None, None, "X", 1)]
    assert S.titles(lines).first()["ten_van_ban"] == V.UNKNOWN_TITLE


def test_parse_flat_text_replaces(spark):
    text = "Điều 1 Tên\nchờ\n1. một\nhai\na) ba\nbốn\n2. năm\nsáu"
    lines = S.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = [(r["level"], r["noi_dung"]) for r in S.parse_flat(lines).orderBy("node_id").collect()]
    assert got == [("article", ""), ("clause", "một"), ("point", "chờ hai bốn"), ("clause", "năm sáu")]


def test_chunk_leaf_lead(spark):
    point = lambda k: (k, f"nội dung {k}", 1)
    doc = (7, "Luật A", None, [], [("I", "TÊN", 1, [("3", "điều", 1, [("1", "lead", 1, [point("a"), point("b")])])])], "f")
    docs = spark.createDataFrame([doc], CH.NESTED)
    texts = [r["text"] for r in CH.chunk_leaf(docs).orderBy("at").collect()]
    assert texts == [f"Tại điểm {k} Khoản 1 Điều 3 Luật A (lead) nội dung {k}" for k in "ab"]
    typed = [r["type"] for r in CH.chunk_typed(docs).orderBy("chunk_no").collect()]
    assert typed == ["metadata", "diem", "diem"]


@pytest.mark.parametrize("n,spans", [(254, [(0, 253)]), (255, [(0, 253), (222, 254)]), (445, [(0, 253), (222, 444), (444, 444)])])
def test_token_windows(spark, n, spans):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "doc_id long, text string")
    assert [(r["start"], r["stop"]) for r in CH.token_windows(df).orderBy("start").collect()] == spans


def test_nested_documents_skip_broken(spark, tmp_path):
    (tmp_path / "a_final.json").write_text('{"doc_id": 1,\n "ten_van_ban": "A", "chuong": []}')
    (tmp_path / "b_final.json").write_text('{"doc_id": ')
    rows = SD.nested_documents(spark, f"{tmp_path}/*final.json").collect()
    assert [r["ten_van_ban"] for r in rows] == ["A"] and rows[0]["path"].endswith("a_final.json")


# ---- retrieval --------------------------------------------------------------


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, score double")


def test_rrf(spark):
    a, b = ranks(spark, [(1, 1, 1, 0.0), (1, 2, 2, 0.0)]), ranks(spark, [(1, 2, 1, 0.0), (1, 3, 2, 0.0)])
    got = {r["chunk_id"]: r["score"] for r in R.rrf_merge([a, b]).collect()}
    assert got == {2: pytest.approx(1 / 62 + 1 / 61), 1: pytest.approx(1 / 61), 3: pytest.approx(1 / 62)}


def test_proxy_score(spark):
    assert one(spark, B.proxy_score(F.lit(0), F.lit(0.6), F.lit(0.03))) == pytest.approx(8.036)


@pytest.mark.parametrize("second,skip,reason", [((1, 0.55, 0.40), True, "strong_dense_match"), ((2, 0.55, 0.40), False, "top_ranking_disagrees")])
def test_rerank_skip(spark, second, skip, reason):
    top, s1, s2 = second
    candidates = ranks(spark, [(1, 1, 1, 0.03), (1, 9, 2, 0.02)])
    dense = ranks(spark, [(1, top, 1, s1), (1, 8, 2, s2)])
    row = B.skip_decision(B.skip_features(candidates, dense)).first()
    assert (row["skip"], row["reason"]) == (skip, reason)


def vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)], f"{name} long, embedding array<float>")


def test_dense_grid_equals_broadcast(spark, monkeypatch):
    v, q = vectors(spark, 300, 1, "chunk_id"), vectors(spark, 9, 2, "query_id")
    plain = R.dense_topk(v, q, 7).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(R, "QUERY_MATRIX_ROWS", 4)
    monkeypatch.setattr(R, "VECTOR_CELL_ROWS", 50)
    assert R.dense_topk(v, q, 7).orderBy("query_id", "rank").collect() == plain
    local = np.array([r["embedding"] for r in v.orderBy("chunk_id").collect()], dtype=np.float64)
    first = np.array(q.orderBy("query_id").first()["embedding"], dtype=np.float64)
    best = np.argsort(-(local @ first))[:7]
    assert [r["chunk_id"] for r in plain if r["query_id"] == 0] == list(best)


def corpus(spark):
    rng = random.Random(3)
    words = ["the"] * 5 + [f"w{i}" for i in range(20)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(60)]


def test_bm25_brute_force_and_salted(spark, monkeypatch):
    docs, asked = corpus(spark), [(1, "the w1 w2 w1"), (2, "w3 w19"), (3, "unknown")]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, query string")
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = lambda w: sum(w in t.split() for _, t in docs)
    want = {}
    for q, text in asked:
        for c, t in docs:
            toks = t.split()
            parts = [
                math.log(1 + (n - df(w) + 0.5) / (df(w) + 0.5)) * toks.count(w) * 2.5 / (toks.count(w) + 1.5 * (0.25 + 0.75 * len(toks) / avg))
                for w in text.split() if w in toks
            ]
            if parts:
                want[q, c] = pytest.approx(sum(parts))
    got = lambda: {(r["query_id"], r["chunk_id"]): r["score"] for r in R.bm25_scores(chunks, queries).collect()}
    assert got() == want
    ranked = lambda: sorted(tuple(r) for r in R.bm25_topk(chunks, queries, 3).select("query_id", "rank", "chunk_id").collect())
    best = [(q, n + 1, c) for q in (1, 2) for n, (_, c) in enumerate(sorted((-round(s.expected, 9), c) for (p, c), s in want.items() if p == q)[:3])]
    assert ranked() == best
    monkeypatch.setattr(R, "PASS_TERMS", 2)
    monkeypatch.setattr(R, "PASS_PAIRS", 1)
    monkeypatch.setattr(R, "WAITING", 1)
    assert ranked() == best
    assert R.bm25_topk(chunks, queries.filter("query_id = 3"), 3).collect() == R.bm25_topk(chunks.limit(0), queries, 3).collect() == []
    monkeypatch.setattr(joins, "within", lambda df, rows: False)
    assert got() == want


def test_hard_negatives_skip_copies(spark):
    chunks = spark.createDataFrame([(i, "a b c" if i == 11 else f"x{i} y") for i in range(1, 31)], "chunk_id long, text string")
    near = ranks(spark, [(1, i, i, 1.0 - i / 100) for i in range(1, 31)])
    positives = spark.createDataFrame([(1, "a b c")], "query_id long, passage string")
    rows = R.hard_negatives(positives, near, chunks).filter("label = 0").orderBy("pick").collect()
    assert [r["chunk_id"] for r in rows] == [12, 13]


def test_must_include_keeps_what_a_cap_needs(spark):
    chunks = spark.createDataFrame([(i, "Đăng ký khai sinh" if i % 2 else "khác") for i in range(40)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "làm giấy khai sinh"), (2, "khác")], "query_id long, query string")
    listed = ranks(spark, [(1, 1, 1, 0.03), (1, 3, 2, 0.02)])
    forced = B.must_include(listed, queries, chunks, cap=5).orderBy("chunk_id").collect()
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in forced] == [(1, c, 0.5) for c in (5, 7, 9, 11, 13)]


def test_must_include_is_whole_without_a_cap(spark):
    chunks = spark.createDataFrame([(i, "Đăng ký khai sinh" if i % 2 else "khác") for i in range(400)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "làm giấy khai sinh"), (2, "khác")], "query_id long, query string")
    forced = B.must_include(ranks(spark, [(1, 1, 1, 0.03)]), queries, chunks).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["score"]) for r in forced) == [(1, c, 0.5) for c in range(3, 400, 2)]


def test_prefix_dedup_of_whole_texts(spark):
    df = spark.createDataFrame([(1, 1, "a" * 200 + "x"), (1, 2, "a" * 200 + "y"), (1, 3, "a" * 200 + "x")], "query_id long, rank int, text string")
    assert [r["rank"] for r in B.prefix_dedup(df).collect()] == [1]
    assert sorted(r["rank"] for r in B.prefix_dedup(df, length=None).collect()) == [1, 2]


def test_merger_boost(spark):
    text = "nghị quyết số: 202/2025/qh15 sắp xếp toàn bộ diện tích tự nhiên, quy mô dân số của thành phố hồ chí minh, tỉnh bà rịa - vũng tàu và tỉnh bình dương thành"
    chunks = spark.createDataFrame([(1, text)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "Hồ Chí Minh sáp nhập với tỉnh nào")], "query_id long, query string")
    row = B.boosted(ranks(spark, [(1, 1, 1, 0.0)]), queries, chunks, B.boost_amount, 1).first()
    assert row["boost"] == pytest.approx(0.08 + 0.70 + 0.25 + 0.18)
    forced = B.must_include(ranks(spark, [(9, 9, 1, 0.0)]), queries, chunks).first()
    assert forced["score"] == 1.30


@pytest.mark.parametrize("rows", [joins.BROADCAST_ROWS, 0])
def test_phrase_scan_brute_force(spark, rows):
    """Phrases with whole words, with parts of words only, of marks only, of one letter, absent, repeated and empty; repeated chunks."""
    docs = corpus(spark) + [(900, "a--b, c!  d"), (900, "a--b, c!  d"), (901, "--"), (902, ""), (903, "Ünïcode über--alles w3"), (904, None)]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string")
    phrases = [(1, "w1 the w2"), (2, "w3"), (3, "1 w"), (4, "the the w5 t"), (5, "w3"), (6, ""), (7, "--"), (8, "-"), (9, "b, c!"), (10, ", c!"), (11, "x"), (12, None), (13, "über--a"), (14, "cod"), (15, " the zz "), (16, "!  "), (2, "w4 w")]
    got = sorted(tuple(r) for r in M.phrase_scan(chunks, spark.createDataFrame(phrases, "phrase_id long, phrase string"), rows).collect())
    assert got == sorted((p, c) for p, ph in phrases for c, t in docs if ph is not None and t is not None and ph in t.lower())


def test_phrase_scan_has_no_python_and_no_nested_loop(spark):
    chunks = spark.createDataFrame(corpus(spark), "chunk_id long, text string")
    for rows in (joins.BROADCAST_ROWS, 0):
        plan = plan_of(M.phrase_scan(chunks, spark.createDataFrame([(1, "the w2"), (2, "")], "phrase_id long, phrase string"), rows))
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


def test_mean_pool_brute_force(spark):
    """Keys over many tasks, single parts, vectors of one component, empty vectors, a null key."""
    rng = np.random.default_rng(4)
    rows = [(int(k), rng.normal(size=3).tolist()) for k in rng.integers(0, 9, 400)] + [(50, [3.0, 4.0, 0.0]), (None, [1.0, 1.0, 0.0]), (None, [1.0, 1.0, 0.0]), (60, []), (61, [2.0])]
    got = {r["key"]: r["embedding"] for r in VE.mean_pool(spark.createDataFrame(rows, "key long, embedding array<double>").repartition(7)).collect()}
    assert set(got) == {k for k, _ in rows} and got[50] == [3.0, 4.0, 0.0] and got[60] == [] and got[61] == [2.0]
    for key in set(got) - {50, 60, 61}:
        mean = np.mean([v for k, v in rows if k == key], 0)
        assert np.allclose(got[key], mean / np.linalg.norm(mean))
    texts = VE.mean_pool(spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [5.0, 5.0])], "key string, embedding array<float>")).collect()
    assert {r["key"]: [round(x, 6) for x in r["embedding"]] for r in texts} == {"a": [0.707107, 0.707107], "b": [5.0, 5.0]}
    assert VE.mean_pool(spark.createDataFrame([], "key long, embedding array<double>")).collect() == []


# ---- text fetch ---------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("bound", [1, 5_000, 10**9])
def test_maybe_listed_loses_nothing(spark, bound):
    table = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text"))
    listed = table.filter("chunk_id % 7 = 3").select("chunk_id")
    got = {r[0] for r in joins.maybe_listed(table, listed, ["chunk_id"], bound).select("chunk_id").collect()}
    want = {i for i in range(20_000) if i % 7 == 3}
    assert want <= got and (bound < 5_000 or len(got - want) < 0.02 * 20_000)
    other = {r[0] for r in joins.maybe_listed(table, listed, ["chunk_id"], 5_000, F.col("text").endswith("1")).select("chunk_id").collect()}
    assert {i for i in range(20_000) if i % 7 == 3 or i % 10 == 1} <= other and len(other) < 6_500
    assert joins.maybe_listed(table, listed.limit(0), ["chunk_id"], bound).count() == 0


def test_lookup_beyond_the_bound_shuffles_listed_rows_only(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("x"), 100).alias("text")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    ranked = spark.createDataFrame([(q, q * 17 % 20_000) for q in range(50)] + [(77, 17)], "query_id long, chunk_id long")
    out = joins.lookup(ranked, table, ["chunk_id"], 51, rows=0)
    assert out.count() == 51 and out.filter("length(text) = 100").count() == 51
    before_exchange = joins.maybe_listed(table, ranked.select("chunk_id"), ["chunk_id"], 51)
    assert before_exchange.count() < 150


# ---- vector search ------------------------------------------------------------


@pytest.mark.parametrize("matrix_rows", [4096, 4])
def test_dense_topk_over_many_tasks(spark, matrix_rows):
    """Exact with a bound from a slice, also where very many vectors are alike; what is shuffled follows queries x k, not the tasks."""
    rng = np.random.default_rng(3)
    values = rng.integers(-3, 4, (3000, 6)).astype(float)
    values[::3] = [1, 2, 0, 1, 2, 0]
    asked = rng.integers(-3, 4, (11, 6)).astype(float)
    frame = lambda m, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{key} long, embedding array<double>")
    vectors, queries = frame(values, "chunk_id").repartition(60), frame(asked, "query_id")
    k = 5
    want = {(q, int(c), r + 1) for q, a in enumerate(asked) for r, c in enumerate(np.lexsort((np.arange(3000), -(values @ a)))[:k])}
    got = R.dense_topk(vectors, queries, k, matrix_rows=matrix_rows)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()} == want
    few = vectors.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(R.SLICES)) == 0)
    first = R.top_ranked(R.dense_partial(few, queries, k), k).filter(F.col("rank") == k)
    bounded = queries.join(first.select("query_id", F.col("score").alias("least"), F.col("chunk_id").alias("last")), "query_id", "left")
    assert R.dense_partial(vectors, bounded, k).count() < 2 * R.SLICES * k * 11 / 2 < R.dense_partial(vectors, queries, k).count()


# ---- citations --------------------------------------------------------------


@pytest.mark.parametrize(
    "out,exp,match",
    [(("5", None, None), ("5", "2", None), True), ((None, "2", None), ("5", "2", None), False), ((None, None, None), (None, None, None), False), ((None, "2", "a"), ("", "2", ""), True)],
)
def test_citation_match(spark, out, exp, match):
    row = spark.createDataFrame([(*out, *exp)], "a string, b string, c string, d string, e string, f string")
    assert row.select(C.matches(*[F.col(c) for c in "abcdef"]).alias("m")).first()["m"] is match


def test_citation_prf(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    cite = "query_id long, {} long, dieu string, khoan string, diem string"
    outputs = spark.createDataFrame([(1, 1, "5", None, None), (1, 2, "9", None, None)], cite.format("out_no"))
    expected = spark.createDataFrame([(1, 1, "5", None, None), (3, 1, "1", None, None)], cite.format("exp_no"))
    got = {r["query_id"]: tuple(r)[1:] for r in E.citation_prf(queries, outputs, expected).collect()}
    assert got == {1: (0.5, 1.0, 0.6667, 1.0), 2: (1.0, 1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0, 0.0)}


def test_citations_from_text(spark):
    got = one(spark, C.extracted(F.col("t")), t="Theo khoản 2 Điều 5 và điểm đ Khoản 3 Điều 7a. Điều 5 khoản 2")
    assert [tuple(c) for c in got][:2] == [("5", "2", "đ"), ("7a", "2", "đ")]
    assert [tuple(c) for c in one(spark, C.extracted(F.col("t")), t="khoản 3, Khoản 3 và khoản 4")] == [(None, "3", None), (None, "4", None)]


def test_abstain(spark):
    for text, yes in (("[Abstain]", True), ("Không tìm thấy quy định.", True), ("không tìm thấy " + "x" * 300, False), ("Điều 5 quy định", False)):
        assert one(spark, C.abstained(F.col("t")), t=text) is yes


# ---- decisions and context --------------------------------------------------


def decide(spark, scores, profile, text="thẩm quyền xử phạt vi phạm", query="Thẩm quyền xử phạt vi phạm hành chính"):
    ranked = spark.createDataFrame([(1, i + 1, text, float(s), "VB") for i, s in enumerate(scores)], "query_id long, rank int, text string, score_rerank double, van_ban string")
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    features = D.query_features(queries, ranked)
    row = D.gate(features, [D.profile(profile, V.GATE_PRESETS.get(profile))]).first()
    return row["decision"], row["reason"], row["tier"]


def test_gate(spark):
    assert decide(spark, [0.4, 0.1], "default") == ("abstain", "low_confidence", "none")
    assert decide(spark, [3.0, 2.999], "default") == ("ask_back", "ambiguous_query", "none")
    assert decide(spark, [0.999, 0.9989], "sigmoid") == ("answer", None, "api")
    assert decide(spark, [], "default") == ("abstain", "no_relevant_chunk", "none")


def test_fallback(spark):
    ranked = spark.createDataFrame([(1, 1, "x", 0.2, "VB")], "query_id long, rank int, text string, score_rerank double, van_ban string")
    queries = spark.createDataFrame([(1, "bao lâu rồi")], "query_id long, query string")
    row = D.fallback(D.query_features(queries, ranked)).first()
    assert (row["fallback_type"], row["missing_type"]) == ("ask_back", "detail")


def test_diversify(spark):
    rows = [(1, i + 1, i + 1, t, s, "1") for i, (s, t) in enumerate([("A", "x"), ("A", "x"), ("A", "y"), ("A", "z"), ("B", "z")])]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, text string, van_ban string, dieu string")
    assert [r["rank"] for r in X.diversify(df).orderBy("position").collect()] == [1, 3, 5]


def trimmed(spark, text, words):
    df = spark.createDataFrame([(1, 1, text, words)], "query_id long, chunk_id long, text string, keywords array<string>")
    return X.trim_rows(df).first()["trimmed"]


def test_trim(spark):
    a, b = "a" * 300, "b" * 300
    text = f"Mở đầu. {a}. Có thẩm quyền ở đây. {b}"
    assert trimmed(spark, text, ["thẩm quyền"]) == "...Có thẩm quyền ở đây...."
    assert trimmed(spark, text, ["vắng"]) == text and trimmed(spark, text, []) == text and trimmed(spark, "ngắn", ["ngắn"]) == "ngắn"
    assert trimmed(spark, text, [".*"]) == text  # words are no patterns
    # a long word run without marks is cut by reach
    assert trimmed(spark, "x" * 600 + " luật " + "y" * 600, ["luật"]) == "..." + "x" * 249 + " luật " + "y" * 249 + "..."
    # sentences that touch are one; line breaks end a sentence
    line = f"{a}\nMột luật. Hai luật.\n{b}"
    assert trimmed(spark, line, ["luật"]) == "...Một luật. Hai luật...."
    assert trimmed(spark, f"{a}\nMột luật.\n{b}\nHai luật.\nba", ["luật"]) == "...Một luật.... ...Hai luật...."


def test_trim_keeps_a_legal_block(spark):
    text = "Điều 1. " + "a" * 500 + ".\nĐiều 2. Về luật. Gì đó. " + "c" * 200 + "\nĐiều 3. " + "d" * 300
    assert trimmed(spark, text, ["luật"]) == "...Điều 2. Về luật. Gì đó. " + "c" * 200 + "..."
    # too long a block is left out
    text = "Điều 1. " + "a" * 900 + ". Về luật này. " + "c" * 300 + ".\nĐiều 3. " + "d" * 300
    assert trimmed(spark, text, ["luật"]) == "...Về luật này...."
    # the header that ends the search, behind the last hit but before the first one
    text = "b muộn. " + "a" * 500 + "\nĐiều 3. " + "d" * 300 + ". Đầu tiên x. " + "e" * 300
    assert trimmed(spark, text, ["đầu tiên", "muộn"]).startswith("b muộn....") and "Đầu tiên x" in trimmed(spark, text, ["đầu tiên", "muộn"])


def test_interval_merge(spark):
    rows = [(1, 0, 5), (1, 5, 9), (1, 12, 14), (1, 9, 11), (None, 3, 4), (None, 4, 6)]
    df = spark.createDataFrame(rows, "key long, start long, stop long")
    assert sorted((tuple(r) for r in X.interval_merge(df).collect()), key=str) == [(1, 0, 11), (1, 12, 14), (None, 3, 6)]
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), s := rng.randrange(60_000), s + rng.choice([0, 3, 20, 2000 * (rng.random() < 0.02)])) for _ in range(3000)]
    want = []
    for key in (1, 2):
        top = None
        for _, a, b in sorted(r for r in rows if r[0] == key):
            if top is not None and a <= top:
                top = max(top, b)
                want[-1] = (key, want[-1][1], top)
            else:
                top = b
                want.append((key, a, b))
    assert sorted(tuple(r) for r in X.interval_merge(spark.createDataFrame(rows, "key long, start long, stop long")).collect()) == want


def test_follow_up(spark):
    rows = [(1, 0, "user", "A?"), (1, 1, "assistant", "b"), (1, 2, "user", "thế còn B?"), (1, 3, "user", "thế còn B?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["rewritten"] for r in A.follow_up_rewrite(df).collect()}
    want = "Câu hỏi trước: A?\nCâu hỏi tiếp nối cần trả lời đầy đủ: thế còn B?"
    assert got == {0: "A?", 2: want, 3: want}


# ---- evaluation, reports, stores --------------------------------------------


def test_recall_mrr(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, r, r == 3) for r in range(1, 6)] + [(2, 7, True)], "query_id long, rank int, hit boolean")
    rows = {r["query_id"]: tuple(r)[1:] for r in E.per_query_hits(queries, hits).collect()}
    assert rows == {1: (0, 1, 1, 0.3333), 2: (0, 0, 0, 0.0)}


def test_goldset_dedup_before_label(spark):
    schema = "pos long, query string, passage string, label int, meta struct<van_ban:string,chuong:string,dieu:string,khoan:string,diem:string,chunk_index:long>"
    rows = spark.createDataFrame([(0, "q", "p", 0, None), (1, "q", "p", 1, None), (2, "r", "p", 1, None)], schema)
    assert [r["id"] for r in E.goldset_dedup(rows).collect()] == ["dev_2"]


def test_percentiles(spark):
    few = spark.createDataFrame([(float(i),) for i in range(99)], "score double")
    assert P.score_percentiles(few).count() == 0
    values = sorted(random.Random(1).choice(range(40)) * 1.0 for _ in range(137))
    row = P.score_percentiles(spark.createDataFrame([(v,) for v in values], "score double")).first()
    assert [row[k] for k in P.PERCENTILES] == [values[int(137 * p)] for p in P.PERCENTILES.values()]


def test_trailing_count_brute_force(spark):
    rng = random.Random(5)
    us = sorted(rng.randrange(0, 3 * 3600 * 10**6) for _ in range(300))
    rows = [(i, i % 2, t) for i, t in enumerate(us)]
    df = spark.createDataFrame(rows, "id long, client long, us long").select("id", "client", F.timestamp_micros("us").alias("ts"))
    got = {r["id"]: r["trailing"] for r in P.trailing_count(df, 600, 3600).collect()}
    assert got == {i: sum(c2 == c and t - 600 * 10**6 < t2 <= t for _, c2, t2 in rows) for i, c, t in rows}


def test_ablation_lift(spark):
    rows = spark.createDataFrame([(1, 0.2842), (2, 0.0825), (3, 0.3263)], "step long, r1 double")
    got = [(r["vs_first_pp"], r["step_pp"]) for r in P.ablation_lift(rows, ["r1"]).orderBy("step").collect()]
    assert got == [(0.0, None), (-20.17, -20.17), (4.21, 24.38)]


def test_store_versions(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "a b"), (1, "c")], "chunk_id long, text string")
    vectors_ = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "chunk_id long, embedding array<float>")
    root = str(tmp_path / "store")
    first = ST.commit(spark, root, chunks, vectors_)
    with pytest.raises(ValueError):
        ST.commit(spark, root, chunks, vectors_.limit(1))
    assert ST.current_version(spark, root) == first
    second = ST.commit(spark, root, chunks, vectors_)
    assert ST.current_version(spark, root) == second
    with pytest.raises(LookupError):
        ST.doc_delete({"chunks": chunks.withColumn("_key", F.col("chunk_id"))}, spark.createDataFrame([(9,)], "_key long"))


def test_store_changes(spark, tmp_path):
    """Append, repair and delete write their own rows only; every version stays readable."""
    rows = lambda *r: spark.createDataFrame(r, "chunk_id long, text string")
    vecs = lambda *ids, n=1: spark.createDataFrame([(i, [1.0] * n) for i in ids], "chunk_id long, embedding array<float>")
    root = str(tmp_path / "store")
    texts = lambda version: {r["chunk_id"]: r["text"] for r in ST.read_version(spark, root, version)["chunks"].collect()}
    terms = lambda version: sorted(r["term"] for r in ST.read_version(spark, root, version)["postings"].collect())
    with pytest.raises(LookupError):
        ST.delete(spark, root, F.lit(True))
    first = ST.append(spark, root, rows((0, "a b"), (1, "c")), vecs(0, 1))
    second = ST.append(spark, root, rows((2, "d")), vecs(2))
    assert texts(first) == {0: "a b", 1: "c"} and texts(second) == {0: "a b", 1: "c", 2: "d"} and terms(second) == ["a", "b", "c", "d"]
    for chunks, vectors_, why in ((rows((2, "x")), vecs(2), "already"), (rows((3, "x")), vecs(3, n=2), "length"), (rows((3, "x")), vecs(3, 4), "disagree")):
        with pytest.raises(ValueError, match=why):
            ST.append(spark, root, chunks, vectors_)
    third = ST.repair_version(spark, root, F.col("chunk_id") == 0, "b", "e")
    assert texts(third)[0] == "a e" and terms(third) == ["a", "c", "d", "e"] and texts(second)[0] == "a b"
    fourth = ST.delete(spark, root, F.col("chunk_id") < 2)
    assert texts(fourth) == {2: "d"} and terms(fourth) == ["d"] and ST.read_version(spark, root, fourth)["vectors"].count() == 1
    for change in (lambda: ST.delete(spark, root, F.col("chunk_id") == 0), lambda: ST.repair_version(spark, root, F.lit(True), "zzz", "y")):
        with pytest.raises(LookupError):
            change()
    assert ST.current_version(spark, root) == fourth


def test_store_of_two_writers(spark, tmp_path, monkeypatch):
    """Both read version 1 and write; exactly one version 2 comes of it, and the loser's rows are in none."""
    rows = lambda *r: spark.createDataFrame(r, "chunk_id long, text string")
    vecs = lambda *ids: spark.createDataFrame([(i, [1.0]) for i in ids], "chunk_id long, embedding array<float>")
    root = str(tmp_path / "store")
    ST.append(spark, root, rows((0, "a")), vecs(0))
    old = ST._entry(spark, root)
    with monkeypatch.context() as m:
        m.setattr(ST, "_entry", lambda *_: old)
        won = ST.append(spark, root, rows((1, "b")), vecs(1))
        for late in (lambda: ST.append(spark, root, rows((2, "c")), vecs(2)), lambda: ST.delete(spark, root, F.col("chunk_id") == 0)):
            with pytest.raises(RuntimeError, match="another writer"):
                late()
    assert ST.current_version(spark, root) == won and sorted(p.name for p in (tmp_path / "store/log").glob("*.json")) == [f"v{1:020d}.json", f"{won}.json"]
    assert sorted(r["chunk_id"] for r in ST.read_version(spark, root, won)["chunks"].collect()) == [0, 1]


def test_store_appends_and_compaction(spark, tmp_path):
    """An append reads no earlier postings; after compaction a version is one part with the same rows."""
    root = str(tmp_path / "store")
    for i in range(5):
        ST.append(spark, root, spark.createDataFrame([(i, f"w{i} x")], "chunk_id long, text string"), spark.createDataFrame([(i, [1.0 * i])], "chunk_id long, embedding array<float>"))
    fifth = ST._entry(spark, root)
    assert (fifth["n_chunks"], fifth["n_vectors"], fifth["n_postings"], len(fifth["steps"])) == (5, 5, 5, 5)
    ST.delete(spark, root, F.col("chunk_id") == 3)
    state = lambda version: {name: sorted(map(str, df.collect())) for name, df in ST.read_version(spark, root, version).items()}
    before = ST.current_version(spark, root)
    packed = ST.compact(spark, root)
    assert state(packed) == state(before) and len(ST._entry(spark, root)["steps"]) == 1
    for file in (tmp_path / "store" / ST._entry(spark, root)["steps"][0] / "postings").glob("*.parquet"):
        file.write_bytes(b"unreadable")
    entry = ST._entry(spark, root, ST.append(spark, root, spark.createDataFrame([(9, "!")], "chunk_id long, text string"), spark.createDataFrame([(9, [0.5])], "chunk_id long, embedding array<float>")))
    assert (entry["n_chunks"], entry["n_vectors"], entry["n_postings"]) == (5, 5, 5)


def test_titled_nodes_come_from_one_shuffle_of_the_lines(spark):
    lines = S.lines_of(spark.createDataFrame([(1, "NGHỊ ĐỊNH\nVề hộ tịch\nCăn cứ\nĐiều 1. X\n1. y"), (2, "x")], "doc_id long, text string"))
    out = S.parse(lines, titled=True)
    assert {(r["level"], r["ten_van_ban"]) for r in out.collect()} == {("article", "NGHỊ ĐỊNH Về hộ tịch"), ("clause", "NGHỊ ĐỊNH Về hộ tịch")}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    good, bad = SL.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a bigint")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.first()["n_malformed"] == 1


# ---- streams ----------------------------------------------------------------


def as_stream(spark, df, folder):
    df.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def file_by_file(spark, frames, folder):
    """A stream that takes the frames one a batch, in this order."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_progress_stream(spark, tmp_path):
    rows = [(1, 1, "Step 6: x"), (1, 2, "Parse"), (1, 3, "Generated 4 chunks"), (2, 4, "Merging")]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, line string").withColumn("ts", F.timestamp_seconds("line_no"))
    L.run_available(L.progress_stream(as_stream(spark, df, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["line_no"]: r["step"] for r in spark.read.schema(L._PROGRESS).parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 5, 2: 5, 3: 5, 4: 3} == {r["line_no"]: r["step"] for r in L.progress_batch(df).collect()}


def test_progress_stream_of_late_lines(spark, tmp_path):
    """Four files out of order of time, lines days behind, documents that miss files."""
    rng = random.Random(7)
    texts = ["Step 1: x", "noise", "Merging", "Parse", "Embedding", "Running OCR", "Generated 3 chunks", "other"]
    rows = [(i % 5 + 10 * (i // 60), i, rng.choice(texts), rng.randrange(10) * 100_000 + 1_000_000_000) for i in range(240)]
    rng.shuffle(rows)
    # the first three documents come in the first and third file only
    of = lambda r: rng.choice([0, 2]) if r[0] < 3 else rng.randrange(4)
    parts = [[], [], [], []]
    for r in rows:
        parts[of(r)].append(r)
    frames = [spark.createDataFrame(p, "doc_id long, line_no long, line string, s long").withColumn("ts", F.timestamp_seconds("s")) for p in parts]
    L.run_available(L.progress_stream(file_by_file(spark, frames, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.schema(L._PROGRESS).parquet(str(tmp_path / "out"))
    step = lambda df: {r["line_no"]: r["step"] for r in df.collect()}
    want = step(L.progress_batch(reduce(lambda a, b: a.unionByName(b), frames)))
    assert step(L.settled(out)) == want and out.count() == len(rows)
    # what was given out at the time: the highest step up to the line among all that had come
    live, seen = step(out), {}
    own = {}
    for part, frame in zip(parts, frames):
        own |= {r["line_no"]: r["own"] for r in frame.select("line_no", L.line_step(F.col("line")).alias("own")).collect()}
        seen |= {n: (d, s) for d, n, _, s in part}
        for d, n, _, s in part:
            assert live[n] == max(own[m] for m, (e, t) in seen.items() if e == d and (t, m) <= (s, n))


def test_rate_limit_answers_late_requests(spark, tmp_path):
    """Requests 11 minutes and longer behind are answered, against what passed then; every request has one row."""
    at = lambda *rows: spark.createDataFrame(rows, "client long, request_id long, s long").select(
        "client", "request_id", F.lit("/api/x").alias("path"), F.timestamp_seconds(F.col("s") + 10**9).alias("ts")
    )
    frames = [
        at((1, 1, 0), (1, 2, 10), (1, 3, 20), (2, 4, 0)),
        at((1, 5, 700), (1, 6, 705), (2, 7, 2000)),
        at((1, 8, 40), (1, 9, 650), (1, 10, 648), (1, 11, 660), (2, 12, 1940)),
        at((1, 13, 760), (1, 14, 765), (2, 15, 2001), (3, 16, 5)),
    ]
    L.run_available(L.rate_limit(file_by_file(spark, frames, str(tmp_path / "in")), 3, 60), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["request_id"]: (r["status"], r["late"]) for r in spark.read.schema(L._ADMITTED).parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == list(range(1, 17))
    assert [got[i] for i in (1, 2, 3, 5, 6)] == [(200, False)] * 5
    assert got[8] == (429, True)  # 665 s behind, beyond what is remembered
    # at 648 there is room; then 648, 700 and 705 fill a minute
    assert got[10] == (200, True) and got[9] == got[11] == (429, True)
    assert got[12] == (200, True) and got[13] == (200, False) and got[14] == (200, False) and got[15] == got[16] == (200, False)
    remembered = L.rate_limit(file_by_file(spark, frames, str(tmp_path / "in2")), 3, 60, late=1000)
    L.run_available(remembered, str(tmp_path / "out2"), str(tmp_path / "cp2"))
    again = {r["request_id"]: r["status"] for r in spark.read.schema(L._ADMITTED).parquet(str(tmp_path / "out2")).collect()}
    assert again[8] == 429 and len(again) == 16  # 0, 10 and 20 passed within its minute


def test_late_fits_brute_force():
    rng = random.Random(9)
    for _ in range(3000):
        limit, span = rng.randrange(1, 5), rng.randrange(1, 20)
        passed = []
        for t in sorted(rng.randrange(60) for _ in range(12)):
            if sum(t - p < span for p in passed) < limit:
                passed.append(t)
        us = rng.randrange(60)
        both = sorted([*passed, us])
        want = all(sum(e - span < p <= e for p in both) <= limit for e in both)
        assert L._late_fits(passed, us, limit, span) == want, (passed, us, limit, span)


def test_outcomes_and_contents_once_over_batches(spark, tmp_path):
    ends = [
        spark.createDataFrame(rows, "doc_id long, s long, line_no long, exit_code int, num_chunks long").withColumn("ts", F.timestamp_seconds("s"))
        for rows in ([(1, 5, 2, 0, 7), (1, 4, 1, 1, 0), (2, 1, 1, 0, 3)], [(1, 1, 0, 0, 9), (3, 1, 1, 0, 4)], [(2, 9, 9, 1, 0), (4, 1, 1, 1, 5)])
    ]
    store = spark.createDataFrame([(3, 40)], "doc_id long, num_chunks long")
    L.outcome_stream(file_by_file(spark, ends, str(tmp_path / "ends")), store, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema(L.OUTCOME).parquet(str(tmp_path / "out")).select("doc_id", "status", "num_chunks").collect()
    assert sorted(map(tuple, got)) == [(1, "failed", 0), (2, "success", 3), (3, "already_exists", 40), (4, "failed", 0)]
    docs = [spark.createDataFrame(rows, "doc_id long, text string") for rows in ([(1, "a\nb"), (2, "c")], [(3, "a\nb"), (4, "d\n\ne")], [(5, "c"), (6, "f")])]
    L.ingest_stream(file_by_file(spark, docs, str(tmp_path / "docs")), str(tmp_path / "store"), str(tmp_path / "cp2"))
    chunks = spark.read.schema(L.CHUNKS).parquet(str(tmp_path / "store/chunks")).select("doc_id", "chunk_index", "text").collect()
    assert sorted(map(tuple, chunks)) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (4, 0, "d"), (4, 2, "e"), (6, 0, "f")]


def test_rate_limit(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, i, "/api/x", i / 3.5) for i in range(31)] + [(2, 100 + i, "/api/x", rng.random() * 200) for i in range(150)] + [(1, 999, "/health", 1.0)]
    df = spark.createDataFrame(rows, "client long, request_id long, path string, s double").withColumn("ts", F.timestamp_micros(((F.col("s") + 1e9) * 1e6).cast("long"))).drop("s")
    L.run_available(L.rate_limit(as_stream(spark, df, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["request_id"]: r["status"] for r in spark.read.schema(L._ADMITTED).parquet(str(tmp_path / "out")).collect()}
    assert [got[i] for i in range(31)] == [200] * 30 + [429] and 999 not in got
    passed, want = [], {}
    for _, i, _, s in sorted((r for r in rows if r[0] == 2), key=lambda r: r[3]):
        recent = [t for t in passed if s - t < 60]
        want[i] = 200 if len(recent) < 30 else 429
        passed += [s] if want[i] == 200 else []
    assert {i: got[i] for i in want} == want


# ---- counts and scratch space -------------------------------------------------


@pytest.mark.parametrize("seconds,block", [(7200, 3600), (60, 3600), (100, 7), (1, 1), (3600, 3600), (50_000, 3600)])
def test_trailing_count_brute_force(spark, seconds, block):
    rng = random.Random(seconds)
    rows = [(rng.randrange(2), i, rng.randrange(20_000)) for i in range(150)]
    df = spark.createDataFrame(rows, "client long, request_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["request_id"]: r["trailing"] for r in P.trailing_count(df, seconds, block).collect()}
    assert got == {i: sum(c == d and 0 <= t - u < seconds for d, _, u in rows) for c, i, t in rows}


def test_unset_scratch_folder_says_what_to_set():
    from statuta import session

    class Unset:
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Unset)
