import json

import pytest
from pyspark.sql import functions as F

from strataloom.operators import layout
from strataloom.plans.engine import Engine
from strataloom.sources import documents, parsers, providers
from strataloom.sources.store import Store
from strataloom.streaming import ingest

SPAN = "document_id bigint, page_no int, block_no int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, text string, size double, flags int"


def spans(spark, *rows):
    return spark.createDataFrame([(0, p, b, n, 0, x, float(y), x + 100, y + 10.0, t, s, f) for p, b, n, x, y, t, s, f in rows], SPAN)


def test_markdown_from_spans(spark):
    rows = spans(
        spark,
        (1, 0, 0, 50.0, 10, "Big Title", 20.0, 0),
        (1, 1, 0, 50.0, 100, "body one", 10.0, 0),
        (1, 1, 1, 50.0, 100, "body two", 10.0, 0),
        (1, 2, 0, 50.0, 300, "in the table", 10.0, 0),
        (1, 3, 0, 50.0, 400, "Contents ........ 12", 10.0, 0),
        (2, 0, 0, 50.0, 10, "3.7 Numbered part", 10.0, 0),
        (2, 1, 0, 50.0, 50, "A sentence ends here.", 14.0, 0),
        (2, 2, 0, 50.0, 80, "more body text", 10.0, 0),
    )
    tables = spark.createDataFrame([(0, 1, 40.0, 290.0, 200.0, 320.0, [["a", None], ["1\n2", "x"]])], "document_id bigint, page_no int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    got = layout.to_markdown(rows, tables).first()["text"]
    assert got == "<!-- Page 1 -->\n\n# Big Title\n\nbody one body two\n\n| a |  |\n| --- | --- |\n| 1 2 | x |\n\n<!-- Page 2 -->\n\n## 3.7 Numbered part\n\nA sentence ends here.\n\nmore body text"


def marks(spark, count, *pages):
    return spark.createDataFrame([(0, i, 1, f"t{i}", p, count) for i, p in enumerate(pages)], "document_id bigint, seq int, level int, title string, page int, page_count int")


@pytest.mark.parametrize(("count", "pages", "usable"), [(100, [1], False), (57, [2, 23, 55], False), (100, list(range(1, 97, 8)), True), (0, [1, 1, 1], False)])
def test_usable_bookmarks(spark, count, pages, usable):
    assert layout.usable_bookmarks(marks(spark, count, *pages)).first()["usable"] is usable


def test_bookmark_nodes(spark):
    pages = spark.createDataFrame([(0, i, f"p{i}") for i in range(1, 7)], "document_id bigint, page_no int, text string")
    rows = marks(spark, 6, 1, 2, 2, 3, 4, 5, 6).unionByName(spark.createDataFrame([(0, 99, 1, " Boş Sayfa ", 6, 6)], marks(spark, 6, 1).schema))
    wide = layout.usable_bookmarks(rows).first()
    assert wide["n"] == 7
    got = [(r["start_page"], r["end_page"], r["content"]) for r in layout.bookmark_nodes(rows, pages).orderBy("seq").collect()]
    assert got == [(1, 1, "p1"), (2, 2, ""), (2, 2, "p2"), (3, 3, "p3"), (4, 4, "p4"), (5, 5, "p5"), (6, 6, "p6")]


def test_items(spark):
    items = spark.createDataFrame([(0, 0, 1, "section_header", "H"), (0, 1, 1, "text", "a"), (0, 2, 2, "text", "b")], "document_id bigint, pos int, page int, label string, text string")
    assert layout.items_to_markdown(items).first()["text"] == "<!-- Page 1 -->\n\n## H\n\na\n\n<!-- Page 2 -->\n\nb"


def test_files(spark, tmp_path):
    (tmp_path / "a.MD").write_bytes("# Ç\n".encode() + b"\xff ok")
    (tmp_path / "b.exe").write_bytes(b"x")
    files = documents.read_files(spark, str(tmp_path))
    assert {(r["filename"], r["accepted"]) for r in files.collect()} == {("a.MD", True), ("b.exe", False)}
    assert documents.text_documents(files).first()["text"] == "# Ç\n ok"
    (tmp_path / "golden.json").write_text(json.dumps([{"document_id": 1, "query": "q", "expect_any": ["a"]}]))
    assert documents.golden_cases(spark, str(tmp_path / "golden.json")).first()["expect_any"] == ["a"]


def test_parsers(spark):
    empty = lambda files: spark.createDataFrame([], parsers.RAW_NODES)
    whole = lambda files: files.select("document_id", F.lit(1).alias("seq"), F.lit("h").alias("heading"), F.lit(1).alias("level"), F.lit("c").alias("content"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"))
    parsers.register("Empty", empty)
    assert parsers.get("empty") is empty
    assert parsers.get("strataloom.sources.documents:text_documents") is documents.text_documents
    with pytest.raises(KeyError):
        parsers.get("nothing")
    assert (parsers.chain("auto"), parsers.chain("pymupdf"), parsers.chain("nothing"), parsers.chain("empty")) == (["items", "layout"], ["layout"], ["layout"], ["empty", "layout"])
    files = spark.createDataFrame([("a",)], "path string")
    assert parsers.first_that_finds(files, [empty, whole]).count() == 1


def test_providers():
    sent = []

    def send(url, body, headers):
        sent.append((url, body))
        return {"embedding": [1.0], "data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], "response": "<think>x</think> hi"}

    assert providers.OllamaEmbedder("u", "nomic-embed", send).query("q") == [1.0] and sent[-1][1]["prompt"] == "search_query: q"
    assert providers.OllamaEmbedder("u", "other", send).documents(["d"]) == [[1.0]] and sent[-1][1]["prompt"] == "d"
    assert providers.OpenAIEmbedder("u", "m", "k", send).documents(["a", "b"]) == [[1.0], [2.0]]
    assert providers.OpenAIEmbedder("u", "m").documents([]) == []
    assert providers.OllamaLLM("u", "m", send).generate("p") == "hi"
    assert list(providers.ndjson_pieces([b'{"response": "a"}', b"no", b'{"response": "b"}'])) == ["a", "b"]
    assert list(providers.sse_pieces([b'data: {"choices": [{"delta": {"content": "a"}}]}', b": ping", b"data: [DONE]", b"data: x"])) == ["a"]

    class Twice:
        calls = 0

        def generate(self, prompt, json_mode=False, temperature=None):
            self.calls += 1
            return '{"a": 1}' if self.calls == 2 else "nothing"

    llm = Twice()
    assert providers.ask(llm, "p", providers.one_object) == {"a": 1} and llm.calls == 2
    assert providers.one_object('x {"a": 1,} y') == {"a": 1}
    assert providers.one_object('<think>{"b": 2}</think>```JSON\n{"a": [1, 2,], "c": {}}\n```') == {"a": [1, 2], "c": {}}
    assert providers.one_object("no") is None and providers.one_object(None) is None and providers.one_object("[1]") is None


def test_streams_factories_and_options():
    sent = []

    def lines(url, body, headers):
        sent.append((url, body, headers))
        return iter([b'{"response": "a"}', b'data: {"choices": [{"delta": {"content": "b"}}]}', b"data: [DONE]"])

    def send(url, body, headers):
        sent.append((url, body, headers))
        return {"response": "x", "choices": [{"message": {"content": "y"}}]}

    first = providers.language_model("Ollama", "u", "m", send=send, lines=lines, options={"num_ctx": 9}, keep_alive="5m")
    second = providers.language_model("openai", "u", "m", key="k", send=send, lines=lines)
    assert list(first.generate_stream("p")) == ["a"] and sent[-1][1] == {"model": "m", "prompt": "p", "stream": True, "options": {"num_ctx": 9}, "keep_alive": "5m"}
    assert list(second.generate_stream("p")) == ["b"] and sent[-1][1]["stream"] and sent[-1][2] == {"Authorization": "Bearer k"}
    assert (first.generate("p", temperature=0), second.generate("p", True, 0)) == ("x", "y")
    assert sent[-2][1]["options"] == {"num_ctx": 9, "temperature": 0} and sent[-1][1]["temperature"] == 0
    assert isinstance(providers.embedder("OLLAMA", "u", "m"), providers.OllamaEmbedder)
    for make in (providers.embedder, providers.language_model):
        with pytest.raises(ValueError):
            make("none", "u", "m")


def test_calls_are_bounded_ordered_and_tried_again(tmp_path):
    import threading
    import time

    lock, busy, most, asked = threading.Lock(), [0], [0], []

    def slow(item):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
            asked.append(item)
        time.sleep(0.02 * (item % 3))
        with lock:
            busy[0] -= 1
        return item * 10

    items = [5, 3, 5, 1, 2, 3, 4, 5, 6, 7]
    assert providers.at_once(slow, items, 3) == [10 * x for x in items]
    assert sorted(asked) == sorted(set(items)) and 1 < most[0] <= 3 and providers.at_once(slow, [], 3) == []
    failures = iter([True, True, False])

    def flaky():
        if next(failures):
            raise OSError("busy")
        return "said"

    assert providers.patiently(flaky, 3, 0.001) == "said"
    with pytest.raises(OSError):
        failures = iter([True] * 3)
        providers.patiently(flaky, 3, 0.001)


def test_equal_prompts_are_asked_once(spark, tmp_path):
    folder = str(tmp_path)

    class Model:
        def generate(self, prompt, json_mode=False, temperature=None):
            import uuid

            open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
            if prompt == "bad":
                raise OSError("no")
            return f" {prompt}! "

    class Vectors:
        def documents(self, texts):
            assert len(texts) <= 2
            return [[float(len(x))] for x in texts]

    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "b", "a", None, "bad", "b", "a"])], "k int, p string").coalesce(1)
    assert [r.said for r in sorted(providers.generate(rows, Model(), "p", "said").collect())] == ["a!", "b!", "a!", None, None, "b!", "a!"]
    assert sorted(x.name.split("-")[0] for x in tmp_path.iterdir()) == ["a", "b", "bad", "bad", "bad"]
    texts = rows.where("p is not null").withColumn("p", F.repeat("p", F.col("k") + 1))
    assert [r.embedding for r in providers.embed(texts, Vectors(), "p", batch=2).orderBy("k").collect()] == [[1.0], [2.0], [3.0], [15.0], [6.0], [7.0]]


MD = "# Abstract\nKısa özet.\n" + "\n".join(f"## Bölüm {i}\nArşiv belgesi {i} hakkında metin. Deniz {'mavi' if i == 3 else 'gri'}." for i in range(6))


def test_engine_and_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, "a.md", "/a.md", MD), (2, "b.md", "/b.md", "düz metin")], "document_id bigint, filename string, path string, text string")
    engine.index(docs)
    assert {r["document_id"] for r in engine.list_documents().collect()} == {1, 2}
    assert engine.table_of_contents(1).count() == 7
    assert [r["heading"] for r in engine.store.children(1, None).collect()] == ["Abstract"]
    asked = spark.createDataFrame([(0, 1, "mavi deniz", None), (1, 1, "mavi deniz", "flat"), (2, 7, "x", None)], "query_id bigint, document_id bigint, query string, ablation string")
    got = {r["query_id"]: r for r in engine.query(asked).collect()}
    assert "mavi" in got[0]["answer"] and got[0]["fallback_triggered"] and got[0]["context_tokens"] > 0
    assert got[1]["execution_policy"] == "Flat RAG (ablation)" and "Pasaj #1" in got[1]["answer"]
    assert got[2]["answer"] is None and got[2]["context_tokens"] == 0
    first, *rest = engine.stream(1, "mavi deniz")
    assert json.loads(first)["selected_node_ids"] and "mavi" in "".join(rest)
    engine.store.set_path("a.md", "/new.md")
    assert {r["file_path"] for r in engine.list_documents().collect()} == {"/new.md", "/b.md"}
    engine.delete(1)
    for call in (lambda: engine.delete(77), lambda: engine.document(1), lambda: list(engine.stream(1, "x"))):
        with pytest.raises(KeyError):
            call()
    assert engine.health() == {"store": True, "embedder": None, "llm": None}
    assert engine.store.read("chunks").select("document_id").distinct().collect()[0][0] == 2
    # another model: vectors go, documents stay
    again = Store(spark, str(tmp_path / "s"), "other")
    assert (again.read("documents").count(), again.read("chunks").count()) == (1, 0)


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\nx")
    engine = Engine(spark, str(tmp_path / "s"))
    ingest.watch(spark, str(tmp_path / "in"), engine.index, str(tmp_path / "status"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "b.TXT").write_text("y")
    (tmp_path / "in" / "c.md").write_text("z")

    def fails(rows):
        if rows.where("filename = 'b.TXT'").count():
            raise ValueError("no")

    ingest.watch(spark, str(tmp_path / "in"), fails, str(tmp_path / "status"), str(tmp_path / "cp")).awaitTermination()
    status = {(r["filename"], r["status"]) for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert status == {("a.md", "completed"), ("b.TXT", "failed"), ("c.md", "completed")}
    assert engine.list_documents().count() == 1
    assert spark.range(1).select(ingest.percentage(F.lit(1), F.lit(3)).alias("p")).first()["p"] == 33.3
