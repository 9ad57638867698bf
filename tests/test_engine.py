"""The engine's own operators: goldens, small brute-force versions, and all registered SQL at the smallest size."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evidencespark.functions import places
from evidencespark.functions import text as T
from evidencespark.operators import contents, dialogue, fuse, ingest, lifecycle, search
from evidencespark.plans import answer_queries, command_queries, ingestion_queries, layout_queries, more_queries  # noqa: F401 - they register their queries
from evidencespark.plans import queries as plans
from evidencespark.plans import relay_queries, retrieval_queries, store_queries, text_queries, view_queries  # noqa: F401
from evidencespark.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 8) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted((tuple(map(plain, r)) for r in rows), key=str) == sorted((tuple(map(plain, r)) for r in want), key=str) or sorted(map(str, rows)) == sorted(map(str, want))


def test_rrf_golden(spark):
    routes = [[("a", 1), ("b", 2)], [("b", 1), ("c", 2)]]
    frames = [spark.createDataFrame([(1, x, r) for x, r in route], "query_id int, record_id string, rank long") for route in routes]
    rows = fuse.rrf([(frames[0], 1.0), (frames[1], 1.0)]).orderBy("rank").collect()
    assert [r["record_id"] for r in rows] == ["b", "a", "c"]
    assert rows[0]["fusion_score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_budget_passes_over_what_does_not_fit(spark):
    costs = [5, 9, 3, 8, 2, 1]
    ev = spark.createDataFrame([(1, i, i, c) for i, c in enumerate(costs)], "query_id int, pos long, record_id long, tokens long")
    row = fuse.budgeted(ev, 12).first()
    assert (row["selected"], row["estimated_tokens"], row["n_omitted"]) == ("0,2,4,5", 11, 2)


def test_rerank_without_scores_keeps_fusion_order(spark):
    c = spark.createDataFrame([(1, "a", None, 0.3), (1, "b", None, 0.5), (1, "c", 0.1, 0.1)], "query_id int, record_id string, rerank_score double, fusion_score double")
    assert [r["record_id"] for r in fuse.rerank(c, 3).orderBy("rank").collect()] == ["c", "b", "a"]


def test_quota_takes_the_last_places(spark):
    pool = spark.createDataFrame([(1, i, i, "pdf" if i in (5, 7) else "md") for i in range(1, 9)], "query_id int, record_id long, pos long, kind string")
    rows = {r["record_id"]: r["place"] for r in fuse.with_quota(pool, 4, F.col("kind") == "pdf").collect()}
    assert rows == {1: 1, 2: 2, 5: 4, 7: 3}


def test_chunks_cover_the_text_and_have_the_golden_id(spark):
    import xxhash

    assert xxhash.xxh64(b"hello", seed=0).hexdigest() == "26c7827d889f6da3"
    text = " ".join(f"Word{i} of it{'.;! '[i % 4]}" for i in range(300)) + "\n\n" + "".join(f"{i:04d}" for i in range(500))
    chunks = ingest.recursive_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), 200, 30).orderBy("ordinal").collect()
    assert {c["doc_id"] for c in chunks} == {1} and all(len(c["content"]) <= 201 for c in chunks)
    at = 0
    for c in chunks:
        begin = text.index(c["content"], max(0, at - 31))
        assert begin <= at
        at = begin + len(c["content"])
    assert at == len(text)


def slow_chunks(text, size, overlap):
    """Each cut found by trying all of its window's ends."""
    import re

    out, begin = [], 0
    while True:
        if begin + size >= len(text):
            return [*out, (begin, len(text))] if begin < len(text) else out
        low, high = begin + overlap + 1, begin + size
        window = text[low : high + 1]
        ends = [low + k + 2 for k in range(len(window) - 1) if window[k : k + 2] == "\n\n"]
        ends = ends or [low + m.end() for m in re.finditer(r"[。！？!?；;.]\s*|\n+", window)]
        ends = ends or [low + k + 1 for k, c in enumerate(window) if c in " \t"]
        end = max(ends, default=high)
        out.append((begin, end))
        if end >= len(text):
            return out
        begin = max(begin + 1, end - overlap)


def test_chunk_boundaries_against_a_slow_search():
    import random

    rng = random.Random(2)
    for _ in range(600):
        text = "".join(rng.choice(["a", "b", "é", "中", " ", "\t", "\n", "\n\n", ".", "。", "! ", ";\n", "\u2003", "word"]) for _ in range(rng.randint(0, 120)))
        size = rng.randint(4, 40)
        overlap = rng.randint(0, size - 1)
        assert ingest.Boundaries(text).chunks(size, overlap) == slow_chunks(text, size, overlap), (text, size, overlap)


def test_sections_trim_blank_edges(spark):
    text = "intro\n\n# One \n\nbody\n\n## Two\nmore"
    rows = ingest.sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), ingest.HEADING).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"], r["title"]) for r in rows] == [(1, 1, None), (3, 5, "One"), (7, 8, "Two")]


@pytest.mark.parametrize(("text", "index"), [("Chapter 1 ........ 12\nShort line", True), ("Only short", False), ("A...... 3\n" + "long prose " * 9, False), ("", False)])
def test_navigation_index(spark, text, index):
    assert spark.createDataFrame([(text,)], "t string").select(T.is_navigation_index(F.col("t"))).first()[0] is index


def test_router_and_plain_text(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.exe").write_bytes(b"x")
    rows = {r["path"].rpartition("/")[2]: r for r in tables.plain_text(tables.routed(tables.objects(spark, str(tmp_path)))).collect()}
    assert (rows["a.TXT"]["parser"], rows["a.TXT"]["text"], rows["a.TXT"]["end_line"]) == ("text", "one\ntwo\nthree", 3)
    assert rows["b.txt"]["decode_error"] == "INVALID_UTF8" and rows["c.exe"]["error"] == "UNSUPPORTED_SOURCE_TYPE"


def test_schema_check(spark):
    with pytest.raises(ValueError, match="SEARCH_SCHEMA_MISMATCH"):
        tables.require_schema(spark.range(1), {"id": "string"})


def test_dense_search_of_zero_and_null_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "record_id long, vector array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["record_id"], r["score"]) for r in search.dense_topk(items, asked, 5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]


def test_dense_search_of_more_queries_than_a_block(spark):
    items = spark.range(40).selectExpr("id AS record_id", "array(cos(id / 40.0), sin(id / 40.0)) AS vector")
    asked = spark.range(20_001).selectExpr("id AS query_id", "array(cos(id % 40 / 40.0), sin(id % 40 / 40.0)) AS vector")
    rows = search.dense_topk(items, asked, 1).collect()
    assert len(rows) == 20_001 and all(r["record_id"] == r["query_id"] % 40 and r["rank"] == 1 for r in rows)


def test_dense_search_by_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (90, 3)).astype(float)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ITEM_BLOCKS", 5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, vector array<double>")
    asked = frame.where("record_id % 3 = 0").withColumnRenamed("record_id", "query_id")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    for exclude in (False, True):
        got = {(r["query_id"], r["rank"]): r["record_id"] for r in search.dense_topk(frame, asked, 5, exclude).collect()}
        want = {}
        for i in range(0, 90, 3):
            score = np.round(unit @ unit[i], 9)
            best = [j for j in sorted(range(90), key=lambda j: (-score[j], j)) if not (exclude and j == i)][:5]  # noqa: B023
            want |= {(i, n + 1): j for n, j in enumerate(best)}
        assert got == want


def test_late_lower_version_never_becomes_active(spark):
    b = spark.createDataFrame([(1, 3, True), (1, 2, True), (1, 4, False)], "document_id int, version int, finished boolean")
    assert lifecycle.active_versions(b).first()["active_version"] == 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_token_bucket_waits(spark):
    from evidencespark.streaming import tasks

    r = spark.createDataFrame([(1, i, 0.0, 5.0) for i in range(4)], "key long, seq long, at double, cost double")
    assert [x["wait"] for x in tasks.token_bucket(r, 1.0, 10.0).orderBy("seq").collect()] == [0.0, 0.0, 5.0, 10.0]
    r = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 0.0, 11.0), (1, 2, 0.0, 3.0)], "key long, seq long, at double, cost double")
    assert [x["wait"] for x in tasks.token_bucket(r, 1.0, 10.0).orderBy("seq").collect()] == [0.0, 0.0, 3.0]  # larger than the bucket: at once


def test_retention_steps(spark):
    from evidencespark.streaming import tasks

    s = [(0.5, 0.5), (0.85, 0.5), (0.95, 0.5), (0.75, 0.5), (0.6, 0.5), (0.6, 0.15), (0.6, 0.05)]
    s = spark.createDataFrame([(1, i, *u) for i, u in enumerate(s)], "key long, seq long, used double, free double")
    rows = tasks.retention(s).orderBy("seq").collect()
    assert [r["hours"] for r in rows] == [168, 96, 48, 48, 96, 48, 24] and [i for i, r in enumerate(rows) if r["paused"]] == [2, 6]


def test_percentiles_from_counts(spark):
    rows = [(t, v) for t in ("a", None) for v in (4.0, 1.0, 1.0, None, 10.0)] + [("b", None), ("c", 7.0)]
    got = lifecycle.percentiles(spark.createDataFrame(rows, "t string, value double"), "t", {"p50": 0.5, "p95": 0.95})
    assert {tuple(r) for r in got.collect()} == {("a", 2.5, 9.1), (None, 2.5, 9.1), ("b", None, None), ("c", 7.0, 7.0)}


def test_folds_go_on_over_batches_of_one_key(spark):
    from evidencespark.streaming import tasks

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    r = spark.createDataFrame([(k, i, 0.0, 5.0) for k in (1, None, 2) for i in range(7)], "key long, seq long, at double, cost double")
    s = spark.createDataFrame([(k, i, 0.95, 0.5) for k in (1, 2) for i in range(7)], "key long, seq long, used double, free double")
    spark.conf.set(key, 2)
    try:
        folds = tasks.token_bucket(r, 1.0, 10.0), tasks.retention(s)
        waits, steps = ([tuple(x) for x in f.collect()] for f in folds)
    finally:
        spark.conf.set(key, before)
    assert sorted(waits, key=str) == sorted(((k, i, max(0.0, 5.0 * (i - 1))) for k in (1, None, 2) for i in range(7)), key=str)
    assert sorted(steps) == [(k, i, h, True) for k in (1, 2) for i, h in enumerate((96, 48, 24, 6, 1, 1, 1))]
    assert not any("FlatMapGroupsInPandas" in f._jdf.queryExecution().toString() for f in folds)  # a whole group in memory


def test_stream_claims_over_two_files(spark, tmp_path):
    from evidencespark.streaming import tasks

    schema = "task_id long, delivery_id long, arrived_at timestamp, sequence long"
    for part, rows in enumerate([[(1, 1, 10, 5), (1, 2, 11, 4), (2, 3, 12, 1)], [(1, 4, 20, 5), (1, 5, 21, 6), (2, 6, 22, 2)]]):
        frame = spark.createDataFrame(rows, "task_id long, delivery_id long, at long, sequence long").selectExpr("task_id", "delivery_id", "timestamp_seconds(at) AS arrived_at", "sequence")
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/p={part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/p=*")
    assert sorted(r["delivery_id"] for r in tasks.drained(tasks.claims(stream)).collect()) == [1, 3, 5, 6]


def test_query_analysis(spark):
    from evidencespark.operators import analysis

    rows = [(1, "  how to use\u3000ＤＷ "), (2, "create data writer fails with DDS_RETCODE_TIMEOUT"), (3, ""), (4, None), (5, "DDS_DataReaderQos and DDS_A_KIND"), (6, "这个怎么用"), (7, "SDPX")]
    a = {r["id"]: r for r in analysis.analyzed(spark.createDataFrame(rows, "id int, query string")).collect()}
    assert a[1]["normalized"] == "how to use DW DataWriter DDS_DataWriter" and a[1]["ambiguous"] and len(a[1]["subqueries"]) == 3
    assert a[1]["subqueries"][2] == "DDS_Publisher_create_datawriter DDS_DataWriter_write"
    assert [(e["kind"], e["canonical"]) for e in a[2]["entities"]] == [("term", "DataWriter"), ("api", "DDS_Publisher_create_datawriter"), ("error_code", "DDS_RETCODE_TIMEOUT")]
    assert a[2]["intent"] == "troubleshooting" and a[2]["subqueries"] == [a[2]["normalized"]]
    assert a[3]["subqueries"] is None and a[4]["intent"] is None
    assert [e["kind"] for e in a[5]["entities"]] == ["term", "struct", "enum"] and a[5]["intent"] == "qos"
    assert a[6]["subqueries"][1].startswith("DDS ") and a[6]["intent"] == "general" and a[7]["entities"] == []


def test_topics_of_a_page():
    from evidencespark.operators import topics

    html = "<title>t</title><nav>menu</nav><p>outside</p><main><h1 id=top>One</h1><p>one</p><p>a &amp;  b<br>c</p><div class='left sidebar'>no</div><h2><a name=x>Two</a></h2><pre>k  1\n  l</pre><h1>Three</h1></main><footer>f</footer>"
    blocks = topics.blocks_of(html)
    assert blocks == [(1, "top", "One"), (0, "", "one"), (0, "", "a & b"), (0, "", "c"), (2, "x", "Two"), (0, "", "k 1\nl"), (1, "", "Three")]
    assert topics.sections_of(blocks) == [("One", "top", 1, 7, "one\n\na & b\n\nc"), ("One > Two", "x", 9, 12, "k 1\nl")]
    assert topics.markdown_of(blocks).startswith("# One\n\na & b\n\nc\n\n## Two") and topics.blocks_of("") == []
    assert topics.decoded("<meta charset=gbk>中".encode("gbk")).endswith("中") and topics.decoded(b"caf\xe9") == "café" and topics.decoded(b"\xef\xbb\xbfx") == "x"
    paths = ["a\\b.htm", "/A%20b.HTML#c", "../x.html", "C:/x.html", "x.png", "./a/./b.html"]
    assert [topics.topic_path(p) for p in paths] == ["a/b.htm", "A b.HTML", None, None, None, "a/b.html"]


def test_procedures_and_numerals(spark):
    raw = ["3", "0", "十", "十二", "二十", "九十九", "一百", "两", "零", "二三"]
    rows = spark.createDataFrame([(x,) for x in raw], "x string").select(ingest.step_number(F.col("x"))).collect()
    assert [r[0] for r in rows] == [3, None, 10, 12, 20, 99, None, 2, None, None]
    parts = [(0, "s", "", "Intro"), (1, "s", "H", "H\n\nStep 1: a"), (2, "s", "H", "第二步 b\n步骤 3 c"), (3, "s", "H", "step 4) d"), (4, "t", "", "Step 5: e"), (5, "t", "", "Step 7: f")]
    s = spark.createDataFrame([(1, *p) for p in parts], "doc_id int, ordinal long, scope string, heading string, text string")
    rows = ingest.coalesced_procedures(s).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["first_step"], r["last_step"], r["segments"]) for r in rows] == [(0, None, None, 1), (1, 1, 4, 3), (4, 5, 5, 1), (5, 7, 7, 1)]
    assert rows[1]["text"] == "H\n\nStep 1: a\n\n第二步 b\n步骤 3 c\n\nstep 4) d"


def test_entry_shows_faults_inside_the_subpackage(tmp_path):
    import subprocess
    import sys

    (tmp_path / "evidencespark").symlink_to(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "evidencespark"))
    entry = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")).read()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    if not os.path.exists(tmp_path / "evidencespark" / "llm" / "queries.py"):
        pytest.skip("without the subpackage there is no pipeline")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert run.returncode and "a_module_that_is_missing" in run.stderr


def test_routes_of_messages(spark):
    said = ["hello", "hi, how do I configure the history depth", "你好，超时怎么配置？", "上一条总结一下", "上一条总结一下，另外告诉我版本", "那它呢", "这个知识库讲什么", None, "它是谁"]
    rows = [(1, i, "user", text) for i, text in enumerate(said)] + [(2, 0, "assistant", "x"), (2, 1, "user", " 它是谁 ")]
    got = {(r.conv_id, r.turn): r[2:] for r in dialogue.routed(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    actions = [got[1, i][1] for i in range(len(said))]
    assert actions == ["reply", "retrieve", "retrieve", "reuse", "retrieve", "retrieve", "retrieve", "retrieve", "clarify"]
    assert got[1, 5][2] == said[4] + "那它呢" and got[1, 7][2] == "" and got[2, 1] == ("follow_up", "clarify", None)
    assert (2, 0) not in got


def test_tool_calls_from_parts(spark):
    parts = [(1, 0, 1, "a", "function", "find", '{"q"'), (1, 0, 3, "", "", "", ": 1}"), (1, 1, 2, "b", "function", "", ""), (1, 2, 4, "c", "", "last", None), (2, 0, 1, "", "", "x", "1"), (2, 0, 2, "z", "", "y", "2")]
    deltas = spark.createDataFrame(parts, "run int, index int, at int, id string, type string, name string, arguments string")
    got = sorted(tuple(r) for r in dialogue.assembled_calls(deltas).collect())
    assert got == [(1, 0, "a", "function", "find", '{"q": 1}'), (1, 2, "c", "", "last", ""), (2, 0, "z", "", "y", "12")]
    assert dialogue.assembled_calls(deltas.limit(0)).count() == 0


def test_ratios_of_no_cases_are_one(spark):
    schema = "expected string, action string, rounds long, max_rounds int, citations_ok boolean"
    assert tuple(dialogue.case_ratios(spark.createDataFrame([], schema)).first()) == (1.0, 1.0, 1.0, 1.0, 1.0, 0)
    cases = [("retrieve", "retrieve", 1, 2, True), ("retrieve", "reply", 0, 2, True), ("reply", "reply", 0, 2, False), (None, "retrieve", 3, 2, True)]
    got = dialogue.case_ratios(spark.createDataFrame(cases, schema)).first()
    assert tuple(got) == (round(2 / 3, 9), 0.5, 1.0, 0.75, 0.75, 4)


def test_places_and_paths(spark):
    rows = [("pdf", "iv", 6, 0, 0), ("pdf", "", 6, 0, 0), ("pptx", "", 2, 3, 4), ("text", "", 0, 1, 9), ("text", None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, printed string, page long, a long, b long")
    got = [r[0] for r in df.select(places.place(*map(F.col, df.columns))).collect()]
    assert got == ["文档第 iv 页（PDF 第 6 页）", "PDF 第 6 页", "第 2 页 · L3–L4", "L1–L9", ""]
    paths = {"a\\b%20c.HTM?x": "a/b c.HTM", "http://h/x//./y+z.html#t": "x/y+z.html", "../a.html": None, "a/%2e%2e/b.html": None, "/.html": None, "a.txt": None, "": None, "a%zz.xhtml": "a%zz.xhtml"}
    df = spark.createDataFrame([(k,) for k in paths], "v string")
    assert [r[0] for r in df.select(places.topic_path(F.col("v"))).collect()] == list(paths.values())


def test_provider_waits(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("Mon, 01 Jan 2024 00:00:30 GMT",), ("Sun, 31 Dec 2023 00:00:00 GMT",), ("-1",), ("nan",), ("inf",), ("soon",), ("",), (None,)], "h string")
    got = [r[0] for r in df.select(places.retry_after(F.col("h"), F.lit("2024-01-01 00:00:00").cast("timestamp"))).collect()]
    assert got == [1.5, 30.0, None, None, None, None, None, None, None]
    codes = spark.createDataFrame([("insufficient_quota",), ("Throttling.RateQuota",), ("Arrearage",), ("",), (None,)], "c string")
    assert [r[0] for r in codes.select(places.quota_used_up(F.col("c"))).collect()] == [True, False, True, False, False]


def test_order_by_contents(spark):
    topics = spark.createDataFrame([("s", "A.html"), ("s", "d/b.html"), ("s", "c.html"), ("s", "z.html"), ("t", "A.html")], "site string, path string")
    entry = '<param name="Local" value="{}">'.format
    tocs = spark.createDataFrame([("s", "d/z.hhc", entry("B.HTML") + entry("/a.html")), ("s", "e.hhc", entry("z.html") + entry("a.html") + entry("no.html")), ("u", "x.hhc", entry("A.html"))], "site string, toc_path string, content string")
    got = {(r.site, r.path): r.position for r in contents.in_order(topics, tocs).collect()}
    assert got == {("s", "d/b.html"): 1, ("s", "A.html"): 2, ("s", "z.html"): 3, ("s", "c.html"): 4, ("t", "A.html"): 1}


def test_neighbours_follow_all_anchors(spark):
    chunks = spark.createDataFrame([(d, 1, "x" if o < 4 else "y", o) for d in (1, 2) for o in range(6)] + [(3, 1, "", 0), (3, 1, "", 1)], "doc_id int, version int, topic string, ordinal long")
    anchors = spark.createDataFrame([(7, 1, 2, 1, 3), (7, 2, 1, 1, 1), (7, 3, 1, 1, 3), (7, 4, 3, 1, 0)], "query_id int, pos long, doc_id int, version int, ordinal long")
    got = [(r.doc_id, r.ordinal, r.pos, r.distance) for r in fuse.expanded(anchors, chunks).orderBy("place").collect()]
    assert got == [(2, 3, 1, 0), (1, 1, 2, 0), (1, 3, 3, 0), (3, 0, 4, 0), (2, 2, 1, -1), (1, 0, 2, -1), (1, 2, 2, 1)]


def test_index_lines_keep_their_digits(spark):
    """Each line is trimmed of blanks, and of nothing else, wherever it stands."""
    rows = [("x\n" + "y" * 45 + " ..... 1",), ("a ..... 1\nb ..... 2\nc ..... 3",), ("a\n1\n2\n3 ",), ("a ..... 1\n" + "z" * 40 + "1",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(T.is_navigation_index(F.col("text"))).collect()]
    assert got == [True, True, False, False]


# --- rates, limits and text search --------------------------------------------------------------------------


def test_rate_of_a_hot_key_at_the_edges(spark):
    import datetime

    base = datetime.datetime(2024, 1, 1)
    rows = [(i, "hot", base + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 0, 1, 299, 300, 301, 599, 600, 1500))] + [(99, None, base)]
    got = {r["id"]: round(r["rate"] * 300) for r in lifecycle.trailing_rate(spark.createDataFrame(rows, "id int, k string, ts timestamp"), 300, "k").collect()}
    at = [r[2] for r in rows[:-1]]
    assert got == {i: sum(0 <= (t - u).total_seconds() < 300 for u in at) for i, t in enumerate(at)} | {99: 1}


def test_sampled_rate(spark):
    import datetime

    base = datetime.datetime(2024, 1, 1)
    rows = [("a", base + datetime.timedelta(seconds=s)) for s in (0, 60, 61)]
    got = {r["sampled"] - int(base.timestamp()): round(r["rate"] * 300) for r in lifecycle.sampled_rate(spark.createDataFrame(rows, "k string, ts timestamp"), 300, 60, "k").collect()}
    assert got == {0: 1, 60: 2, 120: 3, 180: 3, 240: 3, 300: 2, 360: 1}


def slow_waits(rows, limit, seconds=300, block=900):
    """The limiter as it is: failures kept for a while, cleared by a success."""
    kept, out = {}, {}
    for key, i, at, success in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = [t for t in kept.get(key, []) if at - t <= seconds * 1_000_000]
        out[i] = (len(mine), max((mine[0] + block * 1_000_000 - at) / 1e6, 0.0) if len(mine) >= limit else 0.0)
        kept[key] = [] if success else [*mine, at]
    return out


def test_login_waits(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([rng.randrange(2000), 300 * rng.randrange(6)]) * 1_000_000, rng.random() < 0.1) for i in range(400)]
    for limit in (1, 3, 10):
        got = lifecycle.login_waits(spark.createDataFrame(rows, "key string, attempt_id int, at long, success boolean"), "key", limit)
        assert {r["attempt_id"]: (r["recent"], r["wait"]) for r in got.collect()} == slow_waits(rows, limit)


def test_percentiles_over_many_parts(spark):
    import random
    import statistics

    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.choice([rng.random() * 100, 7.0])) for i in range(900)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = lifecycle.percentiles(spark.createDataFrame(rows, "t string, value double").repartition(5), "t", {"q": 0.5, "top": 1.0, "low": 0.0}).collect()
    finally:
        spark.conf.set(key, before)
    for r in got:
        own = sorted(v for t, v in rows if t == r["t"])
        assert (r["q"], r["top"], r["low"]) == (round(statistics.median(own), 6), round(own[-1], 6), round(own[0], 6))


def test_pruned_search_scores_few_pairs_and_loses_none():
    """Runs of texts, a threshold that rises, common words: the best texts of a plain search, and fewer pairs scored."""
    import numpy as np

    rng = np.random.default_rng(3)
    weight = np.concatenate((np.full(5, 0.05), rng.uniform(2, 6, 195)))
    texts = [np.unique(np.concatenate((np.arange(5), rng.choice(np.arange(5, 200), 6)))) for _ in range(600)]
    part = {(d, t): weight[t] * rng.uniform(0.3, 1) for d, own in enumerate(texts) for t in own.tolist()}
    asked = [np.unique(np.concatenate((np.arange(5), rng.choice(np.arange(5, 200), 4)))) for _ in range(20)]
    block = search._Asked(np.repeat(np.arange(20), [len(a) for a in asked]), np.concatenate(asked), np.zeros(sum(map(len, asked))), 5, 6)
    scored = 0
    for a in range(0, 600, 50):
        keys = [(d, t) for d in range(a, a + 50) for t in texts[d].tolist()]
        scored += block.search(np.array([d for d, _ in keys]), np.array([t for _, t in keys]), np.array([part[k] for k in keys]))
    for q, own in enumerate(asked):
        sums = {d: round(sum(part.get((d, t), 0) for t in own.tolist()), 6) for d in range(600)}
        best = sorted(sums, key=lambda d: (-sums[d], d))[:5]
        assert block.best[q][1].tolist() == best and np.allclose(block.best[q][0], [sums[d] for d in best])
    assert scored < 600 * 20 / 4


def test_text_search_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "c b a"), (5, "a a a " * 4000), (6, "x")], "record_id long, text string")
    asked = spark.createDataFrame([(10, "a b"), (11, None), (12, ""), (13, "zzz"), (14, "x x")], "query_id long, query string")
    got = [(r["query_id"], r["record_id"]) for r in search.bm25_topk(docs, asked, 3, phrase_boost=10.0).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1), (10, 4), (10, 5), (14, 6)]
    share = {(r["query_id"], r["record_id"]): r["score"] for r in search.overlap_topk(docs, asked, 3).collect()}
    assert share == {(10, 1): 1.0, (10, 4): 1.0, (10, 5): 0.5, (14, 6): 1.0}
    assert [(r["query_id"], r["record_id"], r["times"]) for r in search.phrase_hits(docs, asked).collect()] == [(10, 1, 1)]
    for some in (docs.limit(0), docs.where("record_id = 2")):
        assert search.bm25_topk(some, asked).count() == 0 and search.overlap_topk(some, asked).count() == 0
    assert search.bm25_topk(docs, asked.limit(0)).count() == 0


# --- page layout --------------------------------------------------------------------------------------------

WORDS = "doc_id long, page long, nth long, text string, x0 double, top double, x1 double, bottom double, font_size double, bold boolean"


def words(spark, rows):
    """Words of page 1 as (text, x0, top) or (text, x0, top, size, bold, page); letters are five points wide."""
    full = [(t, x, y, *rest, *(10.0, False, 1)[len(rest) :]) for t, x, y, *rest in rows]
    return spark.createDataFrame([(1, p, i, t, float(x), float(y), x + 5.0 * len(t), y + float(s), float(s), b) for i, (t, x, y, s, b, p) in enumerate(full)], WORDS)


def slow_rows(tops, sizes):
    rows, out = [], []
    import statistics

    for top, size in zip(tops, sizes, strict=True):
        near = [r for r in rows[::-1][:4] if abs(statistics.median(r) - top) <= max(2.0, size * 0.35)]
        if near:
            near[0].append(top)
        else:
            near = [[top]]
            rows.append(near[0])
        out.append(next(i for i, r in enumerate(rows) if r is near[0]) + 1)
    return out


def test_rows_of_words():
    import random

    import numpy as np

    from evidencespark.operators import layout

    rng = random.Random(4)
    for _ in range(200):
        tops = sorted(rng.choice([rng.uniform(0, 60), 7.0 * rng.randrange(9)]) for _ in range(rng.randrange(40)))
        sizes = [rng.choice([6.0, 10.0, 18.0]) for _ in tops]
        assert layout.rows_of(np.array(tops), np.array(sizes)).tolist() == slow_rows(tops, sizes)


def test_lines_have_tabs_blanks_and_no_blanks(spark):
    from evidencespark.operators import layout

    rows = [("left", 10, 50), ("right", 100, 51), ("well", 10, 70), (",", 32, 70), ("-", 40, 70), ("known", 48, 70), ("中", 10, 90), ("文", 18, 90), ("a", 26, 90), ("far", 10, 110.0, 20.0), ("away", 50, 112.0, 20.0, True)]
    got = layout.lines(words(spark, rows)).orderBy("line").collect()
    assert [(r["text"], r["columns"]) for r in got] == [("left\tright", 2), ("well, -known", 1), ("中文 a", 1), ("far away", 1)]
    assert got[3]["bold"] and (got[0]["x0"], got[0]["top"], got[0]["x1"]) == (10.0, 50.0, 125.0)
    assert layout.lines(words(spark, rows).limit(0)).count() == 0


def test_reading_order_of_two_columns(spark):
    from evidencespark.operators import layout

    rows = [("Title-over-the-middle-of-the-page-of-text", 200, 10), ("R1", 400, 30), ("L1", 20, 36), ("R2", 400, 48), ("L2", 20, 54), ("wide-" * 40, 50, 80), ("R3", 400, 100), ("L3", 20, 106)]
    ordered = layout.in_reading_order(layout.lines(words(spark, rows)), 600.0).orderBy("position")
    assert [r["text"][:5] for r in ordered.collect()] == ["Title", "L1", "L2", "R1", "R2", "wide-", "R3", "L3"]
    three = layout.in_reading_order(layout.lines(words(spark, rows[1:4])), 600.0).orderBy("position")
    assert [r["text"] for r in three.collect()] == ["R1", "L1", "R2"]


def test_blocks_below_headings(spark):
    from evidencespark.operators import layout

    body = [(f"text{i}", 20, 60 + 12 * i) for i in range(6)]
    rows = [
        ("Part", 20, 10, 18.0), ("Chapter", 20, 35, 15.0), *body, ("•", 20, 200), ("item", 30, 200), ("a", 20, 220), ("b", 90, 220), ("c", 20, 232), ("d", 90, 232), ("Ends.", 20, 250, 18.0),
        ("Next", 20, 10, 15.0, False, 2), *[(f"more{i}", 20, 40 + 12 * i, 10.0, False, 2) for i in range(3)], ("apart", 20, 200, 10.0, False, 2), ("Alone", 20, 10, 10.0, True, 3),
    ]
    ordered = layout.in_reading_order(layout.lines(words(spark, rows)), 600.0)
    got = layout.blocks(ordered, 600.0).orderBy("page", "block").collect()
    assert [(r["page"], r["layout_type"], r["heading_path"], r["text"].split("\n\n")[-1]) for r in got] == [
        (1, "paragraph", "Part > Chapter", "\n".join(f"text{i}" for i in range(6))), (1, "list", "Part > Chapter", "• item"), (1, "table", "Part > Chapter", "| a | b |\n| c | d |"), (1, "paragraph", "Part > Chapter", "Ends."),
        (2, "paragraph", "Part > Next", "more0\nmore1\nmore2"), (2, "paragraph", "Part > Next", "apart"), (3, "heading", "Part > Next > Alone", "Alone"),
    ]
    assert got[0]["text"].startswith("Part > Chapter\n\n") and (got[0]["start_line"], got[0]["end_line"]) == (3, 8)
    assert got[2]["bbox"] == "[20.00,220.00,95.00,242.00]" and got[6]["bbox"] == "[0.00,0.00,600.00,10.00]"


# --- the retrieval plan -------------------------------------------------------------------------------------


def test_references_stand_after_their_entries(spark):
    """One that is an anchor itself is only marked, one that two entries name stands after the first."""
    from evidencespark.operators import retrieval

    anchors = spark.createDataFrame([(1, 10, 1, "chi"), (1, 11, 2, "chm"), (1, 12, 3, "chi"), (1, 13, 4, "chi"), (2, 10, 1, "chi")], "query_id long, record_id long, place long, source_type string")
    found = spark.createDataFrame([(1, 1, 11), (1, 3, 20), (1, 4, 20), (2, 1, 11)], "query_id long, place long, record_id long")
    got = retrieval.with_references(anchors, found).orderBy("query_id", "place", "kind").collect()
    assert [(r["query_id"], r["record_id"], r["kind"], r["cause"]) for r in got] == [
        (1, 10, 0, None), (1, 11, 0, 10), (1, 12, 0, None), (1, 20, 1, 12), (1, 13, 0, None), (2, 10, 0, None), (2, 11, 1, 10)
    ]


def test_budget_passes_over_what_does_not_fit(spark):
    from evidencespark.operators import retrieval

    e = spark.createDataFrame([(1, p, t) for p, t in ((1, 5), (2, 9), (3, 4), (4, 1))] + [(2, 1, 50)], "query_id long, position long, tokens long")
    got = retrieval.fitted(e, 10).orderBy("query_id", "position").collect()
    assert [r["selected"] for r in got] == [True, False, True, True, False]


def test_identifiers_come_first(spark):
    from evidencespark.operators import retrieval

    rows = [(1, "read dds_read now", 0.5, "dds_read dds_read", None), (2, "read dds_read now", 0.1, "none", "DDS_READ"), (3, "read dds_read now", 0.9, "none", ""), (4, "read dds_read now", 0.4, None, None)]
    c = spark.createDataFrame([(1, *r, None, None) for r in rows], "query_id long, record_id long, normalized string, fusion_score double, text string, symbol string, topic_title string, topic_url string")
    got = retrieval.prioritized(c).orderBy("rank").collect()
    assert [(r["record_id"], r["exact"], r["occurrences"]) for r in got] == [(2, 1, 1), (1, 0, 2), (3, 0, 0), (4, 0, 0)]


def test_texts_are_searched_where_they_lie(spark):
    import dataclasses
    import random

    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(300)] + [(300, None), (301, "Odd w1")]
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=q % 4 + 1))) for q in range(12)] + [(12, "absent w1"), (13, None)], "query_id long, query string")
    docs = spark.createDataFrame(rows, "record_id long, text string")
    index = search.text_index(docs, asked)
    found, pairs = search.pruned_topk(index, 5, 6), search._phrase_pairs(index, asked)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # no posting is shuffled
    dealt = dataclasses.replace(index, texts=None)
    assert sorted(search.top_k(found, 5).collect()) == sorted(search.top_k(search.pruned_topk(dealt, 5, 6), 5).collect())
    assert sorted(pairs.collect()) == sorted(search._phrase_pairs(dealt, asked).collect()) and not pairs.isEmpty()
    twice = search.text_index(docs.union(docs.limit(1)), asked)
    assert twice.texts is None and search.pruned_topk(twice, 5, 6).count() > 0


def test_retrieval_without_rerank_and_without_anything(spark):
    from evidencespark.operators import retrieval

    kinds = "record_id long, doc_id long, version long, ordinal long, text string, source_name string, source_type string, topic_path string, topic_title string, topic_url string, symbol string, associated_source string, anchor string, vector array<double>"
    row = lambda i, doc, n, text, kind, topic, named=None: (i, doc, 1, n, text, f"s.{kind}", kind, topic, None, None, None, named, "a", None)
    rows = [row(1, 1, 0, "alpha beta", "chi", "t.html", "s.chm"), row(2, 2, 0, "gamma", "chm", "t.html"), row(3, 2, 1, "delta", "chm", "t.html"), row(4, 3, 0, "alpha", "text", None), row(5, 4, 0, "alpha beta", "text", None)]
    chunks = spark.createDataFrame(rows, kinds)
    active = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "document_id long, active_version long")
    asked = spark.createDataFrame([(7, "alpha beta"), (8, "  "), (9, None)], "query_id long, query string")
    got = retrieval.retrieve(chunks, asked, active, retrieval.Settings(rerank=False)).evidence.orderBy("position").collect()
    assert [(r["query_id"], r["record_id"], r["role"], r["cause"], r["distance"]) for r in got] == [(7, 1, "anchor", None, 0), (7, 2, "reference", 1, 0), (7, 4, "anchor", None, 0), (7, 3, "neighbour", 2, 1)]
    assert all(r["selected"] for r in got) and got[0]["fusion_score"] and got[1]["fusion_score"] is None
    assert retrieval.retrieve(chunks.limit(0), asked, active).evidence.count() == 0


# --- nearest neighbours -------------------------------------------------------------------------------------


def test_lists_lose_no_neighbour_and_score_few_pairs(spark):
    """Clustered vectors, copies, zeros and null queries: the rows of all pairs, and less than a tenth of them scored."""
    import numpy as np

    from evidencespark.operators import nearest

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    x = np.round(centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 12)) * 0.12, 3)
    x[:30] = x[30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1500, None)]
    items = spark.createDataFrame(rows, "record_id long, vector array<double>")
    asked = items.where("record_id % 3 = 0").withColumnRenamed("record_id", "query_id")
    for own in (False, True):
        pairs = spark.sparkContext.accumulator(0)
        got = search.top_k(nearest.nearest(items, asked, 5, own, counted=pairs), 5).orderBy("query_id", "rank").collect()
        want = search.top_k(search._all_pairs(items.where("vector IS NOT NULL"), asked, 5, own), 5).orderBy("query_id", "rank").collect()
        assert got == want
    assert spark.sparkContext.accumulator(0).value == 0
    some = asked.where("vector IS NOT NULL")
    pairs = spark.sparkContext.accumulator(0)
    nearest.nearest(items, some, 5, counted=pairs).write.format("noop").mode("overwrite").save()
    assert 0 < pairs.value < 0.1 * 1500 * 500
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "record_id long, vector array<double>")
    for lists in (1, 3):
        got = search.top_k(nearest.nearest(zeros, zeros.withColumnRenamed("record_id", "query_id"), 2, lists=lists), 2).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["record_id"], r["score"]) for r in got] == [(1, 1, 0.0), (1, 2, 0.0), (2, 2, 1.0), (2, 1, 0.0), (3, 3, 1.0), (3, 1, 0.0)]
    assert nearest.nearest(items.limit(0), asked, 5).count() == 0


def test_vectors_of_two_lengths_never_meet(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "record_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, [3.0]), (9, [1.0, 1.0, 1.0]), (10, None)], "query_id long, vector array<double>")
    got = search.dense_topk(items, asked, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["record_id"], r["score"]) for r in got] == [(7, 1, 1.0), (8, 2, 1.0), (10, 1, 0.0), (10, 2, 0.0)]


# --- keyword indexes, keyed table, strict answers, traces ---------------------------------------------------


def test_chains_are_followed_and_bad_ones_found(spark):
    import random

    from evidencespark.operators import keywords

    rng = random.Random(6)
    chains = {}
    rows = []
    for n in (1, 2, 3, 8, 9, 33):
        order = [0, *rng.sample(range(1, n), n - 1)]
        order = order[: max(1, n - n // 4)]  # some blocks are on no chain
        chains[f"f{n}"] = order
        after = dict(zip(order, [*order[1:], keywords.END], strict=True))
        rows += [(f"f{n}", b, after.get(b, 0)) for b in range(n)]
    rows += [("loop", 0, 1), ("loop", 1, 2), ("loop", 2, 1), ("self", 0, 0), ("lost", 0, 7), ("lost", 1, keywords.END)]
    chain, errors = keywords.walked(spark.createDataFrame(rows, "file string, block long, next_block long"))
    assert {(r["file"], r["pos"]): r["block"] for r in chain.collect()} == {(f, i): b for f, order in chains.items() for i, b in enumerate(order)}
    assert {r["file"]: r["error"] for r in errors.collect()} == {"loop": "LOOP", "self": "LOOP", "lost": "BROKEN"}
    chain, errors = keywords.walked(spark.createDataFrame([], "file string, block long, next_block long"))
    assert chain.count() == errors.count() == 0


def test_keywords_of_a_topic_in_groups(spark):
    from evidencespark.operators import keywords

    found = spark.createDataFrame([("f", i + 1, w, [1, 1, 2] if i == 0 else [1]) for i, w in enumerate(["a, b", "A, B", *[f"k{i}" for i in range(40)]])], "file string, ordinal long, keyword string, topics array<long>")
    refs = spark.createDataFrame([("f", 1), ("f", 2)], "file string, topic long")
    got = keywords.segments(found, refs).orderBy("topic", "nth").collect()
    assert [(r["topic"], r["n_keywords"], r["symbol"], r["keyword_start"], r["keyword_end"]) for r in got] == [(1, 32, "b", 1, 33), (1, 9, "k31", 34, 42), (2, 1, "b", 1, 1)]


def test_keyed_table(spark, tmp_path):
    """Changes by key, null keys, deletion, pinned readers, writers that end early or come second."""
    from evidencespark.sources.keyed import KeyedTable

    schema = "k long, v string, n long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    shown = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    t = KeyedTable(spark, f"{tmp_path}/t", spark.createDataFrame([], schema).schema, "k", buckets=4)
    assert t.version() == 0 and t.read().count() == 0 and t.delete("k = 1") == 0
    assert t.upsert(rows((1, "a", 1), (2, "b", 1), (None, "c", 1), (2, "later", 2)), order="n") == 1
    first = t.read()
    assert t.upsert(rows((2, "new", 3), (None, "d", 3), (9, "e", 3))) == 2
    assert shown(first) == [(1, "a", 1), (2, "later", 2), (None, "c", 1)]
    assert shown(t.read()) == [(1, "a", 1), (2, "new", 3), (9, "e", 3), (None, "d", 3)] and shown(t.read(1)) == shown(first)
    assert t.delete("v = 'e' OR n = 1") == 3 and shown(t.read()) == [(2, "new", 3), (None, "d", 3)]
    assert t.delete("v = 'nothing'") == 3

    publish = t._publish
    t._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("the driver is lost"))
    with pytest.raises(RuntimeError, match="lost"):
        t.upsert(rows((5, "half", 1)))
    assert t.version() == 3 and shown(t.read()) == [(2, "new", 3), (None, "d", 3)]
    other = KeyedTable(spark, f"{tmp_path}/t", t.schema, "k", buckets=4)

    def second(version, manifest):  # another writer comes in between, once
        t._publish = publish
        other.upsert(rows((7, "other", 1)))
        return publish(version, manifest)

    t._publish = second
    assert t.upsert(rows((2, "mine", 4))) == 5 and shown(t.read()) == [(2, "mine", 4), (7, "other", 1), (None, "d", 3)]
    t.vacuum(keep=1)
    assert shown(t.read()) == [(2, "mine", 4), (7, "other", 1), (None, "d", 3)] and t.delete("true") == 6 and t.read().count() == 0


def test_strict_answers(spark):
    from evidencespark.functions import contracts

    good = '{"sufficient":false,"missing_facts":["a\\u00e9"],"reason_code":" ok "}'
    rows = [
        (good, None), ("\n" + good + " ", None), (None, "NOT_AN_OBJECT"), ("", "NOT_AN_OBJECT"), ("```" + good, "NOT_AN_OBJECT"), (good + good, "INVALID_JSON"), ('{"sufficient":false}', "MISSING_FIELD"),
        (good.replace("false", '"false"'), "INVALID_JSON"), (good.replace("]", ",1]"), "INVALID_JSON"), (good.replace('"a', '"\n'), "INVALID_JSON"), (good.replace(" ok ", "x" * 65), "BAD_REASON"), (good.replace('"a', '"' + "é" * 256), "FACT_TOO_LONG"),
    ]
    df = spark.createDataFrame(rows, "answer string, want string")
    error, sufficient, facts, reason = contracts.assessment(F.col("answer"))
    got = df.select("want", error.alias("error"), sufficient.alias("s"), facts.alias("f"), reason.alias("r")).collect()
    assert [r["error"] for r in got] == [r["want"] for r in got]
    assert (got[0]["s"], got[0]["f"], got[0]["r"]) == (False, ["aé"], "ok") and got[2]["f"] is None
    answers = [('{"queries": [" New  one ", "new one"]}', None, ["New  one"]), ('{"queries": ["OLD query", "x"]}', None, ["x"]), ('{"queries": ["old  QUERY"]}', "NO_NEW_QUERY", None), ('{"queries": []}', "NO_NEW_QUERY", None), ('{"queries": ["a","b","c"]}', "TOO_MANY_QUERIES", None), ('{"queries": ["a", " "]}', "EMPTY_QUERY", None), ('{"queries": null}', "MISSING_FIELD", None)]
    df = spark.createDataFrame(answers, "answer string, want string, new array<string>")
    error, new = contracts.rewrite(F.col("answer"), F.array(F.lit("Old query")))
    assert [(r["e"], r["n"]) for r in df.select(error.alias("e"), new.alias("n")).collect()] == [(w, n) for _, w, n in answers]


def test_spans_of_a_trace(spark):
    from evidencespark.operators import traces

    own = lambda i, **more: {"span_id": i, "parent_id": "", "start_ns": "1000", "end_ns": "2500000", "status": "0", "attributes": [], **more}
    named = lambda s: [{"key": "service.name", "value": s}]
    spans = [own("00000000000000AB"), own("AAAAAAAAAAE="), own("short"), own("00000000000000ac", status="2", end_ns="1"), own("00000000000000ad", attributes=[{"key": "stage", "value": "chunk"}, {"key": "outcome", "value": "bad"}, {"key": "stage", "value": "parse"}])]
    rows = [("t", [{"attributes": named("nobody"), "scopes": [{"spans": spans}]}, {"attributes": named("rag-go-api"), "scopes": [{"spans": []}, {"spans": spans}]}]), ("empty", None), ("none", [])]
    df = spark.createDataFrame(rows, f"trace_id string, resources {traces.TRACE}")
    got = traces.flattened(df).orderBy("nth").collect()
    assert [(r["nth"], r["span_id"], r["stage"], r["outcome"], r["truncated"]) for r in got] == [
        (1, "00000000000000ab", "rpc", "succeeded", False), (2, "0000000000000001", "rpc", "succeeded", False), (3, "00000000000000ac", "rpc", "failed", False), (4, "00000000000000ad", "chunk", "succeeded", False)
    ]
    assert (got[0]["duration_ms"], got[2]["duration_ms"]) == (2.499, 0.0)
    cut = traces.flattened(df, 2).collect()
    assert len(cut) == 2 and all(r["truncated"] for r in cut)
    assert not any(r["truncated"] for r in traces.flattened(df, 4).collect())


# --- relay --------------------------------------------------------------------------------------------------


def test_tries_go_on_after_a_restart(spark, tmp_path):
    """Two runs with one checkpoint give what the batch twin gives of all deliveries; none is tried twice."""
    import datetime

    from evidencespark.streaming import relay

    base = datetime.datetime(2024, 1, 1)
    schema = "delivery_id long, ts timestamp, failures int, lasting boolean"
    rows = [(i, base + datetime.timedelta(seconds=7 * i), i % 6, i % 4 == 1) for i in range(40)]
    parts = [spark.createDataFrame(rows[:20], schema), spark.createDataFrame([*rows[20:], rows[25]], schema)]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, relay.ROCKSDB)
    try:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            found = relay.tries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 5, 4)
            found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    newest = int(spark.createDataFrame(rows, schema).agg(F.max(F.unix_millis("ts"))).first()[0])
    want = sorted(tuple(r) for r in relay.tries_batch(spark.createDataFrame(rows, schema), 5, 4, newest).collect())
    assert got == want and {r[3] for r in got} == {"done", "failed", "retry"} and max(r[1] for r in got) == 4


def test_publication_once(spark, tmp_path):
    """A batch whose commit was lost is written again, under its own keys."""
    from evidencespark.sources.keyed import KeyedTable
    from evidencespark.streaming import relay

    schema = "id long, created_at long, body string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    t = KeyedTable(spark, f"{tmp_path}/t", spark.createDataFrame([], schema).schema, "id", buckets=2)
    upsert = t.upsert

    def lost(*a):
        upsert(*a)
        raise RuntimeError("lost before the commit")

    t.upsert = lost
    with pytest.raises(Exception, match="lost before"):
        relay.publish(source, t, f"{tmp_path}/at").awaitTermination()
    t.upsert = upsert
    for _ in range(2):
        relay.publish(source, t, f"{tmp_path}/at").awaitTermination()
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, 2, "c"), (2, 1, "b")] and t.version() == 2


def test_margins_and_printed_numbers(spark):
    from evidencespark.operators import layout

    rows = []
    for p in (1, 2, 3):
        rows += [(f"Manual part {p}", 250, 20, 10.0, False, p), *[(f"body{p}{i}", 20, 100 + 14 * i, 10.0, False, p) for i in range(4)], (f"Page {p + 6}" if p < 3 else "iv", 295, 770, 10.0, False, p)]
    rows += [("Large", 20, 40, 18.0, False, 4), ("only", 20, 200, 10.0, False, 4), ("here", 20, 214, 10.0, False, 4), ("12", 20, 300, 10.0, False, 4)]
    ordered = layout.in_reading_order(layout.lines(words(spark, [(t.replace(" ", "_"), *rest) if t.startswith("Manual") else (t, *rest) for t, *rest in rows])), 600.0)
    assert {(r["page"], r["number"]) for r in layout.printed_numbers(ordered, 800.0).collect()} == {(1, "7"), (2, "8"), (3, "iv")}
    assert [(r["margin_key"], r["on_pages"]) for r in layout.repeated_keys(layout.margin_keys(ordered, 800.0)).collect()] == [("manual_part_#", 3)]
    left = {r["text"] for r in layout.visible(ordered, 800.0).collect()}
    assert left == {f"body{p}{i}" for p in (1, 2, 3) for i in range(4)} | {"Large", "only", "here", "12"}


def test_shown_blocks(spark):
    from evidencespark.operators import layout

    long = "x" * 90
    cases = [
        ("A > B", "a >  b\n\ntext", "text"), ("A", "A", "A"), ("", "  plain ", "plain"), ("A", "other\n\ntext", "other\n\ntext"), ("", "| a | b |\n| c | |\nend", "| a | b |\n| --- | --- |\n| c |  |\nend"),
        ("", "| a | b | c |\n| d | e |", "| a | b | c |\n| --- | --- | --- |\n| d | e |  |"), ("", "| one | row |", "one row"), ("", f"| {long} | b |\n| c | d |", f"{long} b\nc d"), ("", "| a。 | b； |\n| c | d |", "a。 b；\nc d"), ("", "| | |\n| a | b |", "| | |\na b"),
    ]
    df = spark.createDataFrame([(1, 1, i, h, t) for i, (h, t, _) in enumerate(cases)], "doc_id long, page long, block long, heading_path string, text string")
    assert [r["shown"] for r in layout.displayed(df).orderBy("block").collect()] == [s for _, _, s in cases]


# --- ingestion ----------------------------------------------------------------------------------------------

TASKS = "task_id long, task_type string, task_status string, last_sequence long, job_id long, job_status string, cancelled boolean, job_generation long, version long, document_id long, document_status string, document_generation long, active_version long, corpus_status string, corpus_generation long"


def task(i, **more):
    row = {"task_id": i, "task_type": "INGEST_DOCUMENT", "task_status": "RUNNING", "last_sequence": None, "job_id": i, "job_status": "RUNNING", "cancelled": False, "job_generation": 1, "version": 2, "document_id": i, "document_status": "READY", "document_generation": 1, "active_version": None, "corpus_status": "ACTIVE", "corpus_generation": 1}
    return tuple((row | more).values())


def test_fences_of_claims(spark):
    from evidencespark.operators import ingestion

    rows = [
        task(1, last_sequence=3), task(2, task_status="SUCCEEDED"), task(3, job_status="FAILED"), task(4, cancelled=True), task(5, document_generation=2), task(6, document_generation=None, document_status=None), task(7, document_status="DELETED"),
        task(8, task_type="CLEANUP_DOCUMENT", document_status="DELETED"), task(9, task_type="CLEANUP_DATASET", corpus_status="DELETING", document_generation=None), task(10, task_type="CLEANUP_DATASET"),
    ]
    tasks = spark.createDataFrame(rows, TASKS)
    deliveries = spark.createDataFrame([(1, 1, 3), (2, 1, 4), (3, 1, 4), (4, 1, 9), (5, 1, None), (6, 99, 1), *[(10 + i, i, 1) for i in range(2, 11)]], "delivery_id long, task_id long, sequence long")
    got = {r["delivery_id"]: (r["refusal"], r["attempt"]) for r in ingestion.claims(tasks, deliveries).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 6)] == [("STALE_SEQUENCE", None), (None, 1), ("STALE_SEQUENCE", None), (None, 2), ("UNKNOWN_TASK", None)]
    assert [got[10 + i][0] for i in range(2, 11)] == ["TASK_OVER", "JOB_OVER", "CANCELLED", "STALE_GENERATION", "NO_DOCUMENT", "DELETED", None, None, "STALE_GENERATION"]


def test_active_versions_never_go_back(spark):
    from evidencespark.operators import ingestion

    rows = [task(i, document_id=1, version=v, active_version=3) for i, v in enumerate((4, 2, 6, 5, 3), 1)] + [task(6, document_id=2), task(7, document_id=3, cancelled=True), task(8, document_id=4, task_status="PENDING")]
    builds = spark.createDataFrame([(1, v, "BUILDING") for v in range(2, 7)] + [(3, 2, "BUILDING")], "document_id long, version long, status string")
    ended = spark.createDataFrame([(i, i) for i in range(1, 10)], "task_id long, at long")
    got = {r["task_id"]: (r["outcome"], r["active_version"]) for r in ingestion.completions(spark.createDataFrame(rows, TASKS), builds, ended).collect()}
    assert [got[i] for i in range(1, 6)] == [("ACTIVE", 4), ("ABANDONED", 4), ("ACTIVE", 6), ("ABANDONED", 6), ("ABANDONED", 6)]
    assert [got[i][0] for i in range(6, 10)] == ["NO_BUILD", "CANCELLED", "NOT_RUNNING", "NOT_RUNNING"]


def test_rows_of_new_jobs(spark):
    """Ids agree between tables and between runs; a batch without requests makes no rows."""
    from evidencespark.operators import ingestion

    documents = spark.createDataFrame([(1, "READY", 1, 3, True, "ACTIVE"), (2, "DELETED", 1, 2, True, "ACTIVE"), (3, "READY", 1, 2, False, "ACTIVE"), (4, "READY", 1, 2, True, "DELETING")], "document_id long, status string, generation long, next_version long, has_object boolean, corpus_status string")
    requests = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 9), (7, None)], "seq long, document_id long")
    made, outcomes = ingestion.reindex_rows(documents, requests)
    assert [(r["outcome"], r["version"]) for r in outcomes.orderBy("seq").collect()] == [("CREATED", 3), ("CREATED", 4), ("DELETED", None), ("OBJECT_MISSING", None), ("CORPUS_DELETING", None), ("NOT_FOUND", None), ("NOT_FOUND", None)]
    jobs = {r["job_id"] for r in made["jobs"].collect()}
    assert len(jobs) == 2 and jobs == {r["job_id"] for r in made["tasks"].collect()} == {r["job_id"] for r in made["builds"].collect()}
    assert {r["task_id"] for r in made["tasks"].collect()} == {r["task_id"] for r in made["outbox"].collect()} and [tuple(r) for r in made["documents"].collect()] == [(1, 5)]
    assert jobs == {r["job_id"] for r in ingestion.reindex_rows(documents, requests)[0]["jobs"].collect()}
    assert all(df.count() == 0 for df in ingestion.reindex_rows(documents, requests.limit(0))[0].values())


# --- ids, views, blanked tools ------------------------------------------------------------------------------


def test_ids_and_digests_of_requests(spark):
    import hashlib
    import json
    import uuid

    from evidencespark.functions import identity

    keys = ["a", "é/ü", 'quote " and \\ \n\t', "x" * 1000, *[f"k{i}" for i in range(40)]]
    df = spark.createDataFrame([(k, None if i % 2 else k) for i, k in enumerate(keys)], "k string, other string")
    digest = identity.request_digest({"b": F.col("other"), "a": F.col("k")})
    for r in df.select("k", "other", identity.corpus_id(F.col("k")).alias("id"), identity.staging_key(F.col("k")).alias("at"), digest.alias("digest")).collect():
        assert r["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"rag-dataset:{r['k']}")) and r["at"] == "staging/" + hashlib.sha256(r["k"].encode()).hexdigest()
        payload = json.dumps({"a": r["k"], "b": r["other"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert r["digest"] == hashlib.sha256(payload.encode()).hexdigest()
    folded = spark.createDataFrame([("Straße",), ("ΑΣ",), ("ﬁ",), (None,)], "t string").select(identity.casefolded("t")).collect()
    assert [r[0] for r in folded] == ["strasse", "ας".casefold(), "fi", None]
    odd = spark.createDataFrame([(None, "m"), ("NEW", "own"), ("INVALID_PDF", "m"), ("NEW", None)], "code string, message string")
    assert [r[0] for r in odd.select(identity.failure_message(F.col("code"), F.col("message"))).collect()] == ["", "own", identity.FAILURES["INVALID_PDF"], ""]


def test_oldest_tool_results_are_blanked_first(spark):
    rows = [(1, t, role, tokens) for t, (role, tokens) in enumerate([("system", 10), ("user", 10), ("assistant", 10), ("tool", 50), ("tool", 40), ("tool", 100)])]
    rows += [(2, 0, "system", 10), (2, 1, "tool", 900), (3, 0, "tool", 900), (3, 1, "user", 1), (3, 2, "tool", 5)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, tokens long")
    for budget, want in ((220, []), (219, [3]), (185, [3]), (184, [3, 4]), (50, [3, 4, 5])):
        got = lifecycle.blanked_tools(m.where("conv_id = 1"), budget, 0).orderBy("turn").collect()
        assert [r["turn"] for r in got if r["blanked"]] == want and all(r["tokens"] == lifecycle.BLANK_TOKENS for r in got if r["blanked"])
    rest = lifecycle.blanked_tools(m.where("conv_id > 1"), 50, 0).collect()
    assert [(r["conv_id"], r["turn"]) for r in rest if r["blanked"]] == [(3, 2)]


def test_panel_of_rates(spark):
    import datetime

    base = datetime.datetime(2024, 1, 2)
    end = int((base - datetime.datetime(1970, 1, 1)).total_seconds())
    rows = [(f"s{i}", base - datetime.timedelta(seconds=s)) for i in range(10) for s in (0, 1, 14, 299, 300, 890, 901, 5000)] + [(None, base)]
    got = lifecycle.panel(spark.createDataFrame(rows, "k string, ts timestamp"), end, "15m", "k").collect()
    assert {r["name"] for r in got} == {f"s{i}" for i in range(8)}
    ages = [r[1] for r in rows if r[0] == "s3"]
    for r in (r for r in got if r["name"] == "s3"):
        at = base + datetime.timedelta(seconds=r["sampled"] - end)
        assert round(r["value"] * 300) == sum(0 <= (at - t).total_seconds() < 300 for t in ages) and (r["sampled"] - end) % 15 == 0
    assert {r["name"] for r in lifecycle.panel(spark.createDataFrame(rows, "k string, ts timestamp"), end, "15m", "k", ["s9", "zz"]).collect()} == {"s9"}


def test_rows_of_a_long_page_and_over_batches(spark):
    """A row of many words takes time in proportion to them, and a page goes on from batch to batch."""
    import time

    import numpy as np

    from evidencespark.operators import layout

    began = time.process_time()
    assert set(layout.rows_of(np.full(40_000, 50.0), np.full(40_000, 10.0)).tolist()) == {1}
    assert time.process_time() - began < 2
    rows = [(f"w{i}", 10.0 * (i % 5), 50.0 + 20 * (i // 5)) for i in range(40)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        got = {r["text"]: r["line"] for r in layout.with_rows(words(spark, rows)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {f"w{i}": i // 5 + 1 for i in range(40)}


def test_tries_take_plain_rows():
    """A delivery is handled as rows, without a data frame for each, and the earliest of its rows counts."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from evidencespark.streaming import relay

    held, timers = [], []
    tries = relay._Tries(5_000, 3)
    tries.handle = SimpleNamespace(registerTimer=timers.append)
    tries.waiting = SimpleNamespace(exists=lambda: bool(held), update=held.append, clear=held.clear, get=lambda: held[-1])
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 6_000)
    rows = [Row(delivery_id=1, at_ms=t, failures=9, lasting=False) for t in (4_000, 1_000)]
    got = [tuple(r) for r in tries.handleInputRows((1,), iter(rows), now)]
    assert got == [(1, 1, 1_000, "retry"), (1, 2, 6_000, "retry")] and timers == [16_000]
    assert list(tries.handleInputRows((1,), iter(rows), now)) == []
    later = SimpleNamespace(getCurrentWatermarkInMs=lambda: 20_000)
    assert [tuple(r) for r in tries.handleExpiredTimer((1,), later, None)] == [(1, 3, 16_000, "failed")] and not held


def test_keyword_joins_send_no_table_through_the_driver(spark):
    from evidencespark.operators import keywords

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10m")
    try:
        leaves = spark.createDataFrame([("a", 0, 1), ("a", 1, keywords.END)], "file string, block long, next_block long")
        entries = spark.createDataFrame([("a", 0, 1, "k", 0, [1]), ("a", 1, 2, "m", 0, [1])], "file string, block long, nth long, keyword string, see_also int, topics array<long>")
        found, _ = keywords.records(keywords.walked(leaves)[0], entries)
        each = keywords.segments(found, spark.createDataFrame([("a", 1)], "file string, topic long"))
        assert each.select("text").collect()[0][0] == "k\nm"
        plan = each._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not any(c in line for line in joins for c in ("topic", "block", "pos"))  # files alone may be broadcast


def test_best_pages_meet_documents_once(spark, tmp_path):
    """Each language and slot has one best page, whatever the number of its pages; one without a text comes last (F9)."""
    pages = [(i * 50, f"http://a/{lang}/x", f"<h1>{'t' * (i % 7)}</h1>") for i in range(40) for lang in ("en",)] + [(50 * 99, "http://a/de/x", None), (50 * 98, "http://a/de/x", "<h1></h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = [(i * 50, "en") for i in range(30)] + [(50 * 70, "de"), (50 * 71, None), (3, "en")]
    spark.createDataFrame(docs, "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.reference_join(spark, str(tmp_path))
    assert {r["doc_id"]: r["page_id"] for r in found.collect()} == {i * 50: 300 for i in range(30)} | {50 * 70: 50 * 98}
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in joined  # pages come as the best ones only


def test_digest_vectors_hash_each_text_once(spark):
    """The digest is taken once for all components and their length, and the vector is the digest's bytes (F15, F16)."""
    import hashlib

    vector = T.digest_vector(F.col("text"))
    rows = spark.createDataFrame([("",), ("a text",)], "text string").withColumn("v", vector)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    for text, v in rows.collect():
        raw = [(b - 127.5) / 127.5 for b in hashlib.sha256(text.encode()).digest()[:8]]
        norm = sum(x * x for x in raw) ** 0.5
        assert v == pytest.approx([x / norm for x in raw], rel=1e-15)
    assert spark.createDataFrame([(None,)], "text string").select(vector.alias("v")).first()["v"] == [None] * 8


def test_queries_go_once_to_a_block_of_lists(spark, monkeypatch):
    """Where no bound helps, a query is sent once to each block of lists, not to each list, and nothing is lost (F8, F14)."""
    import numpy as np

    from evidencespark.operators import nearest

    x = np.random.default_rng(3).normal(size=(2500, 16))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, vector array<float>")
    asked = items.where("record_id % 5 = 0").withColumnRenamed("record_id", "query_id")
    sent, wanted = [], nearest._wanted
    monkeypatch.setattr(nearest, "_wanted", lambda *a: sent.append(wanted(*a)) or sent[-1])
    got = search.top_k(nearest.nearest(items, asked, 4, True), 4).orderBy("query_id", "rank").collect()
    assert sent[0].groupBy("id", "item_block").count().where("count > 1").count() == 0
    assert 500 <= sent[0].count() <= 500 * 4 and dict(sent[0].dtypes)["vector"] == "array<float>"
    assert got == search.top_k(search._all_pairs(items, asked, 4, True), 4).orderBy("query_id", "rank").collect()


def test_folding_holds_few_strings_at_once(monkeypatch):
    """Texts are folded in runs of a bounded size, whatever the batch, with nulls and long texts (F22)."""
    import pyarrow as pa

    from evidencespark.functions import identity

    monkeypatch.setattr(identity, "FOLDED_BYTES", 10)
    texts = pa.array(["Straße", None, "ABC", "", "x" * 50, "É" * 4, None])
    assert max(len(p) for p in identity._pieces(texts)) <= 4 and sum(map(len, identity._pieces(texts))) == 7
    assert identity._folded(texts).to_pylist() == [None if x is None else x.casefold() for x in texts.to_pylist()]
    assert identity._folded(texts[:0]).to_pylist() == []


@pytest.mark.parametrize("name", ["delete_corpora", "task_claims"])
def test_tasks_get_a_bounded_number_of_rows(spark, monkeypatch, name):
    """Jobs and deliveries are dealt to more tasks as they grow, with the same rows as before (F13, F21)."""
    from evidencespark.sources import shared

    want = sorted(map(str, plans.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    found = plans.QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, found.collect())) == want


def test_groups_of_tries_go_as_single_ones(spark):
    """Many deliveries in one call, some again, give what each gives alone, with one state and one timer for all."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from evidencespark.streaming import relay

    random.seed(5)
    base, most, now = 5_000, 4, 20_000
    rows = [(random.randrange(300), random.randrange(30_000), random.randrange(6), i % 4 == 1) for i in range(500)]
    calls = []

    def ready(processor):
        held, timers = [], set()
        processor.handle = SimpleNamespace(registerTimer=lambda t: (calls.append(t), timers.add(t)), deleteTimer=timers.remove)
        processor.waiting = SimpleNamespace(exists=lambda: bool(held), update=lambda x: held.__setitem__(slice(None), [x]), clear=held.clear, get=lambda: held[0])
        return processor, held, timers

    at = lambda t: SimpleNamespace(getCurrentWatermarkInMs=lambda: t)
    parts = [pd.DataFrame(rows[:350], columns=["delivery_id", "at_ms", "failures", "lasting"]), pd.DataFrame(rows[350:], columns=["delivery_id", "at_ms", "failures", "lasting"])]
    groups, held, timers = ready(relay._TryGroups(base, most))
    got = []
    for watermark, part in zip((0, now), parts, strict=True):
        got += list(groups.handleInputRows((0,), iter([part[:100], part[100:]]), at(watermark)))
        assert len(timers) == len(held) == 1
    assert len(calls) <= 3  # a timer for each delivery before
    for watermark in (now, 40_000, 10**6):
        while held and min(timers) <= watermark:
            timer = min(timers)
            got += list(groups.handleExpiredTimer((0,), at(watermark), None))
            timers.discard(timer)
    assert not held
    want = []
    for key in range(300):
        single, own, due = ready(relay._Tries(base, most))
        for watermark, part in zip((0, now), parts, strict=True):
            mine = [r for r in part.itertuples() if r.delivery_id == key]
            if mine:
                want += single.handleInputRows((key,), iter([dict(zip(part.columns, r[1:], strict=True)) for r in mine]), at(watermark))
        for watermark in (now, 40_000, 10**6):
            while own and min(due) <= watermark:
                timer = min(due)
                want += single.handleExpiredTimer((key,), at(watermark), None)
                due.discard(timer)
    assert sorted(map(tuple, pd.concat(got).itertuples(index=False))) == sorted((r[0], r[1], r[2], r[3]) for r in want)
    untimed = list(groups.handleInputRows((0,), iter([pd.DataFrame([(1, None, 3, False)], columns=parts[0].columns)]), at(0)))
    assert untimed[0].values.tolist() == [[1, 1, pd.NA, "retry"]] and not held


def test_a_try_due_at_the_newest_delivery_is_made(spark, tmp_path):
    import datetime

    from evidencespark.streaming import relay

    base, schema = datetime.datetime(2024, 1, 1), "delivery_id long, ts timestamp, failures int, lasting boolean"
    rows = spark.createDataFrame([(1, base, 5, False), (2, base + datetime.timedelta(seconds=5), 0, False)], schema)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, relay.ROCKSDB)
    try:
        found = relay.tries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 5, 4)
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    assert sorted(r[:2] for r in map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, 1), (1, 2), (2, 1)]


# --- page layout, page by page ------------------------------------------------------------------------------


def random_words(seed):
    """Words of two documents of several pages, with rows that jitter, columns, headings, lists, margins and page numbers."""
    import random

    random.seed(seed)
    rows = []
    for doc in (3, 8):
        for page in range(6 if doc == 3 else 4):
            number = [("Manual-" + str(page), 250.0, 20.0, 10.0, False), (f"Page {page + 4}" if page % 2 else "iv", 295.0, 770.0, 10.0, False)] if page != 2 else []
            for row in range(random.randrange(0 if number else 1, 9)):
                size, bold = random.choice([(10.0, False)] * 4 + [(13.0, False), (15.0, True), (18.0, False), (10.0, True)])
                wide = random.choice([0, 0, 60, 300])
                for col in range(random.randrange(1, 6)):
                    text = random.choice(["word", "end.", "-", "1.", "pre-", "漢字", "語", "(x", ",", "a|b", "|", "II", "…" * 4, "长；"])
                    number.append((text, 30.0 + col * (30 + wide) % 560, 60.0 + row * 17 + random.choice([0, 0.7, 1.4, 2.5]), size, bold))
            rows += [(doc, page, nth, text, x, y, x + 5.0 * len(text), y + size, size, bold) for nth, (text, x, y, size, bold) in enumerate(number)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_pages_in_memory_are_as_by_windows(spark, seed):
    import numpy as np
    import pyarrow as pa

    from evidencespark.operators import layout, pages

    rows = random_words(seed)
    names = [f.split()[0] for f in WORDS.split(", ")]
    kinds = [np.int64, np.int64, np.int64, None, *[np.float64] * 5, bool]
    table = {n: pa.array(c) if k is None else np.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)}
    ordered = pages.in_reading_order(pages.lines(table), 600.0)
    as_rows = lambda t, columns: sorted(zip(*(t[c].to_pylist() if isinstance(t[c], pa.Array) else t[c].tolist() for c in columns), strict=True))
    collected = lambda df: sorted(map(tuple, df.collect()))
    slow = layout.stored(layout.in_reading_order(layout.lines(spark.createDataFrame(rows, WORDS)), 600.0), "ordered")
    columns = [*PAGE_COLUMNS, "position"]
    assert as_rows(ordered, columns) == collected(slow.select(columns))
    numbers = [(int(ordered["doc_id"][i]), int(ordered["page"][i]), int(ordered["position"][i]), n) for i, n in pages.printed_numbers(ordered, 800.0).values()]
    assert sorted(numbers) == collected(layout.printed_numbers(slow, 800.0)) and numbers
    keyed = collected(layout.margin_keys(slow, 800.0).where("margin_key <> ''").select("doc_id", "page", "position"))
    assert as_rows(pages.taken(ordered, pages.marginal(ordered, 800.0)), ["doc_id", "page", "position"]) == keyed
    left, slow_left = pages.visible(ordered, 800.0), layout.stored(layout.visible(slow, 800.0), "left")
    assert as_rows(left, columns) == collected(slow_left.select(columns)) and len(left["page"]) < len(ordered["page"])
    for fast, windows in ((ordered, slow), (left, slow_left)):
        made = layout.blocks(windows, 600.0).select("doc_id", "page", "block", "layout_type", "heading_path", "text", "bbox", "start_line", "end_line")
        own = pages.blocks(fast, 600.0, pages.Headings())
        assert sorted(own) == collected(made) and {r[3] for r in own} >= {"paragraph", "list"}
    shown = collected(layout.displayed(made).select("doc_id", "page", "block", "shown"))
    assert sorted((*r[:3], pages.displayed(r[5], r[4])) for r in own) == shown
    cut = [pages.taken(ordered, ordered["page"] * 10 + ordered["doc_id"] == at) for at in [p * 10 + d for d in (3, 8) for p in range(6)]]
    assert [as_rows(t, columns) for t in pages.documents(cut)] == [as_rows(pages.taken(ordered, ordered["doc_id"] == d), columns) for d in (3, 8)]
    headings = pages.Headings()
    assert [r for t in cut for r in pages.blocks(t, 600.0, headings)] == pages.blocks(ordered, 600.0, pages.Headings())


def test_rows_of_many_pages_at_once(monkeypatch):
    import numpy as np

    from evidencespark.operators import layout, pages

    rng = np.random.default_rng(7)
    page = np.repeat(np.arange(40), rng.integers(1, 60, 40))
    tops, sizes = rng.integers(0, 300, len(page)) / 5, rng.choice([8.0, 10.0, 18.0], len(page))
    tops = tops[np.lexsort((tops, page))]
    tops[page == 3] = 7.0
    want = np.concatenate([layout.rows_of(tops[page == p], sizes[page == p]) for p in range(40)])
    for together in (512, 25, 0):
        monkeypatch.setattr(pages, "TOGETHER", together)
        assert pages.rows_of_pages(tops, sizes, page).tolist() == want.tolist()
    assert pages.rows_of_pages(tops[:0], sizes[:0], page[:0]).tolist() == []


PAGE_COLUMNS = ["doc_id", "page", "line", "text", "x0", "top", "x1", "bottom", "font_size", "bold", "columns"]


def test_blocks_are_shown_in_memory():
    from evidencespark.operators import pages

    cases = [("A > B", "a >  b\n\ntext", "text"), ("A", "A", "A"), ("", "| a | b |\n| c | |\nend", "| a | b |\n| --- | --- |\n| c |  |\nend"), ("", "| one | row |", "one row"), ("", "| a。 | b； |\n| c | d |", "a。 b；\nc d"), ("", "| | |\n| a | b |", "| | |\na b"), ("", "||", "||")]
    assert [pages.displayed(text, path) for path, text, _ in cases] == [shown for _, _, shown in cases]


def test_parts_of_documents_have_whole_pages(monkeypatch):
    """Documents of one id are laid out together, and a long one in parts, as in one part."""
    import pyarrow as pa

    from evidencespark.operators import pages

    texts = [(1, 50), (2, 1000), (4, 30), (4, 700), (4, 20), (5, None), (6, 0), (7, 10), (7, 15), (9, 300)]
    words = pa.array([None if n is None else [f"w{doc}x{i}" for i in range(n)] for doc, n in texts], pa.list_(pa.string()))
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts]), words], names=["doc_id", "words"]).slice(i, 3) for i in range(0, len(texts), 3)]
    found = []
    for most in (10**6, 250):
        monkeypatch.setattr(layout_queries, "RUN_WORDS", most)
        parts = [p for p in layout_queries._parts(iter(batches)) if sum(len(w) for _, w, _ in p)]
        tables = [pages.lines(layout_queries._with_margins(layout_queries._laid_out(p))) for p in parts]
        found.append(sorted(zip(*(c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in pages.joined(tables).values()), strict=True)))
        assert len(parts) == 1 or max(sum(len(w) for _, w, _ in p) for p in parts) <= 2 * most
    assert found[0] == found[1] and len(parts) > 8


@pytest.mark.parametrize("name", ["page_lines", "page_order", "page_blocks", "page_margins", "printed_page_numbers", "document_blocks"])
def test_words_of_pages_are_not_shuffled(spark, name):
    """Before, each word went through shuffles with its place, and lines through those of the windows."""
    from evidencespark.sources import shared

    folders = len(shared._written)
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    if name == "page_margins":
        assert len(shared._written) == folders + 1  # the keys of margins only
        return
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Generate" not in plan and len(shared._written) == folders
