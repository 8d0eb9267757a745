"""Strategies, stored indexes, the command line, the followed stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.operators import lexical
from quarry.plans import store, strategies
from quarry.sources import files
from quarry.streaming import incremental

PAGES = {"a/b.md": "Routers\n\n# Paths\npackets find routes through networks", "a-b.md": "Plants\n\nleaves turn sunlight into sugar", "c.py": "def add(a, b):\n    return a + b\n"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(p, t.encode()) for p, t in PAGES.items()]
    return files.chunk_documents(files.documents(spark.createDataFrame(rows, "path string, content binary")))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "routes of packets"), (2, "sunlight")], "query_id int, query string")


def embed(rows):
    """Vectors of letter counts."""
    return rows.select("doc_idx", F.array(*(F.regexp_count(F.lower("text"), F.lit(c)).cast("double") + 0.01 for c in "abcdefghilmnoprstu")).alias("vector"))


def test_corpus_order(docs):
    got = [(r.doc_idx, r.docid) for r in strategies.ordered(docs).orderBy("doc_idx").collect()]
    assert got == [(0, "a/b.md:1-1"), (1, "a/b.md:3-4"), (2, "a-b.md:1-3"), (3, "c.py:1-2")]


def test_strategies_and_their_consolidation(docs, asked):
    params = {"embedder": embed, "bm25_k1": 1.2, "nonsense": 1, "contextualizer": lambda text: F.lit("about nets")}
    built = {}
    for name in strategies.REGISTRY:
        built[name] = strategies.build(name, params)
        assert "nonsense" not in built[name].params
        with pytest.raises(RuntimeError):
            built[name].search(asked, 2)
        built[name].index(docs)
        first = {r.query_id: r for r in built[name].search(asked, 2).where("rank = 0").collect()}
        if name not in ("turbovec", "hybrid"):
            assert first[1].docid == "a/b.md:3-4" and first[2].docid == "a-b.md:1-3"
            assert first[1].context == ("" if name == "pi-serini" else "Paths")
    assert built["hybrid"].adopt(built["lexical"], built["turbovec"])
    found = strategies.search_all({k: built[k] for k in ("lexical", "turbovec", "pi-serini")}, asked, 3).orderBy("query_id", "rank").collect()
    best = [r for r in found if r.rank == 1]
    assert [r.source_path for r in best] == ["a/b.md", "a-b.md"] and all(r.confidence == "high" and "lexical" in r.provenance for r in best)
    with pytest.raises(ValueError):
        strategies.build("none")
    with pytest.raises(RuntimeError, match="embedder"):
        strategies.build("turbovec").index(docs)


def test_store(spark, docs, asked, tmp_path):
    kept = store.IndexStore(spark, str(tmp_path))
    index = lexical.LexicalIndex.of(strategies.ordered(docs).select("doc_idx", "docid", "text"))
    assert kept.record("lexical") is None and kept.is_stale("lexical", "f1")
    kept.save_lexical(index, "f1", parameters={"bm25_k1": 1.5, "model_name": "m"})
    assert kept.record("lexical")["hyperparams"] == {"bm25_k1": 1.5} and set(kept.cached()) == {"lexical"}
    again = kept.load_lexical()
    want = lexical.lexical_search(index, asked, 3).orderBy("query_id", "rank").collect()
    assert lexical.lexical_search(again, asked, 3).orderBy("query_id", "rank").collect() == want
    assert not kept.is_stale("lexical", "f1") and kept.is_stale("lexical", "f2") and kept.is_stale("lexical", "f1", reextract=True)
    assert kept.is_stale("lexical", "f1", {"bm25_k1": 2.0}) and not kept.is_stale("lexical", "f1", {"bm25_k1": 1.5, "bit_width": 2})
    kept.save_lexical(index, "f3", name="lexical+ctx")
    assert kept.record("lexical")["retriever_name"] == "lexical+ctx"


def test_command_line(spark, tmp_path, capsys):
    for p, t in PAGES.items():
        (tmp_path / "src" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / p).write_text(t)
    (tmp_path / "src" / "t.srt").write_text("00:00:01,000 --> 00:00:02,000\nspoken words\n")
    (tmp_path / "labels.json").write_text(json.dumps({"queries": [{"id": "q", "query": "packets routes", "relevant": [{"source_path": "a/b.md", "start_line": 3, "end_line": 4}]}]}))

    def run(*args: str) -> dict:
        assert main([*args, "--store", str(tmp_path / "store")]) == 0
        return json.loads(capsys.readouterr().out)

    (tmp_path / "src" / "de.po").write_text('msgid "Open file"\nmsgstr "Datei zebra"\n\nmsgid "Close"\nmsgstr ""\n')
    (tmp_path / "src" / "talk.mp4").write_bytes(b"\0\1")
    root = str(tmp_path / "src")
    made = run("index", root)
    assert set(made) == {"lexical", "pi-serini", "treesitter"} and made["lexical"]["fresh"] is False and made["lexical"]["files"] == 6
    assert run("index", root, "--strategy", "lexical")["lexical"]["fresh"] is True
    found = run("query", root, "packets routes", "--top-k", "2")
    best = found["hits"][0]
    assert best["source_path"] == "a/b.md" and best["rank"] == 1 and best["snippet"].startswith("# Paths")
    assert best["confidence"] == "high" and best["provenance"] == ["lexical", "pi-serini", "treesitter"] and best["agreement"] == 3
    # one strategy, weights, captions, records, a transcript that is registered later
    one = run("query", root, "packets routes", "--strategy", "pi-serini", "--lucene-k1", "1.4")
    assert one["hits"][0]["rank"] == 1 and "confidence" not in one["hits"][0]
    even, heavy = (run("query", root, "packets routes", "--top-k", "1", "--weights", w)["hits"][0]["score"] for w in ("lexical=1", "lexical=4,treesitter=0"))
    assert heavy > even
    assert run("query", root, "spoken words")["hits"][0]["source_path"] == "t.srt"
    assert run("query", root, "zebra")["hits"][0]["docid"] == "de.po:1-2"
    assert all(h["source_path"] != "talk.mp4" for h in run("query", root, "hippopotamus", "--strategy", "pi-serini")["hits"])
    (tmp_path / "said.txt").write_text("a hippopotamus speaks")
    assert run("sidecar", root, "talk.mp4", str(tmp_path / "said.txt"))["registered"] == "talk.mp4"
    assert run("query", root, "hippopotamus", "--strategy", "pi-serini")["hits"][0]["source_path"] == "talk.mp4"
    assert run("stats", root)["n_files"] == 4
    tuned = run("tune", root, "--bm25-k1", "2.5")
    assert tuned["tokenizer"] in ("plain", "code") and tuned["bm25_k1"] == 2.5 and "warning" in tuned
    told = run("eval", root, str(tmp_path / "labels.json"), "--repeats", "1")
    assert told["lexical"]["recall"] == told["consolidated"]["recall"] == 1.0 and told["lexical"]["seconds_median"] > 0
    assert {r["arm"] for r in told["by_query"]} == {"lexical", "pi-serini", "treesitter", "consolidated"} and [r["confidence"] for r in told["by_confidence"]] == ["high", "medium", "low"]
    assert run("extract", root)["states"] == {"t.srt": "ok", "talk.mp4": "agent-authored"}
    for wrong in (["query", root, " "], ["query", root, "x", "--top-k", "0"], ["query", root, "x", "--weights", "none=1"], ["query", root, "x", "--weights", "lexical=-1"], ["query", str(tmp_path / "none"), "x"]):
        assert main([*wrong, "--store", str(tmp_path / "store")]) == 1


def test_record_loaders(spark):
    from quarry.sources import records

    def lines_of(rows):
        one = rows.select("path", F.posexplode(F.split("text", "\n")).alias("n", "text"))
        nothing = F.lit(None).cast("string")
        return one.select(F.concat_ws(":", "path", F.col("n").cast("string")).alias("docid"), "text", F.lit("").alias("url"), F.col("path").alias("source_path"), (F.col("n") + 1).alias("start_line"), (F.col("n") + 1).alias("end_line"), F.lit("").alias("context"), nothing.alias("metadata"))

    own = records.Registry()
    texts = spark.createDataFrame([("x/A.LOG", "one\ntwo"), ("b.md", "plain"), (".log", "a name")], "path string, text string")
    assert own.documents(texts).collect() == [] and own.split(texts)[0].count() == 3
    own.register(".log", lines_of)
    assert own.lookup("x/A.LOG") is lines_of and own.lookup(".log") is None and own.lookup("b.md") is None and own.suffixes() == [".log"]
    plain, held = own.split(texts)
    assert {r.path for r in plain.collect()} == {"b.md", ".log"}
    assert sorted((r.docid, r.text, r.start_line) for r in own.documents(held).collect()) == [("x/A.LOG:0", "one", 1), ("x/A.LOG:1", "two", 2)]
    for wrong in (lambda: own.register(".LOG", lines_of), lambda: own.register("log", lines_of)):
        with pytest.raises(ValueError):
            wrong()
    own.register(".log", lines_of, replace=True)
    own.unregister(".log")
    assert own.suffixes() == [] and records.REGISTRY.suffixes() == [".po"]


def test_followed_stream(spark, tmp_path, asked):
    def add(name: str, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, "doc_idx long, docid string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_idx long, docid string, text string").parquet(str(tmp_path / "in"))
        incremental.follow(stream, str(tmp_path / "index"), str(tmp_path / "marks")).awaitTermination(120)

    add("one", [(0, "x", "packets"), (1, "y", "sunlight")])
    add("two", [(1, "y", "routes of packets"), (2, "z", "")])
    index = incremental.opened(spark, str(tmp_path / "index"))
    assert index.n_docs == 3 and index.avgdl == pytest.approx(4 / 3)
    got = lexical.top(lexical.bm25_scores(index, asked), 1).collect()
    assert [(r.query_id, r.doc_idx) for r in got] == [(1, 1)]


def test_golds_are_all_documents_that_hold_a_text(spark, tmp_path):
    from quarry.plans import queries

    items = [(1, "alpha beta gamma delta eps"), (2, "one two"), (3, "solo"), (4, "a b c d e f g h"), (5, "beta gamma delta"), (6, "nowhere at all"), (7, "alpha beta gamma delta")]
    texts = [(10, "say alpha beta gamma delta eps now"), (11, "xalpha beta gamma delta epsy"), (12, "one two"), (13, "one  two solo"), (14, "z a b c d e f g h"), (15, None), (16, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, str(d)) for i, x in items for d, t in texts if t and x in t}
    got = [(r.query_id, r.source_path) for r in queries._golds(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)


def asked_of(served, method: str, **params) -> dict:
    return served.reply(json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params}))


def tool_of(served, name: str, **arguments) -> dict:
    made = asked_of(served, "tools/call", name=name, arguments=arguments)["result"]
    assert json.loads(made["content"][0]["text"]) == made["structuredContent"] and made["isError"] == ("error" in made["structuredContent"])
    return made["structuredContent"]


def test_tool_server_messages():
    import io

    from quarry.server import Server

    def none():
        raise AssertionError("no project is opened for these")

    served = Server(none)
    assert asked_of(served, "initialize", protocolVersion="2024-11-05")["result"]["protocolVersion"] == "2024-11-05"
    assert [t["name"] for t in asked_of(served, "tools/list")["result"]["tools"]] == ["search_domain_context", "index_project", "index_status"]
    assert served.reply('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    assert served.reply("{")["error"]["code"] == -32700 and served.reply("[]")["error"]["code"] == -32600
    assert asked_of(served, "nothing")["error"]["code"] == -32601 and asked_of(served, "tools/call", name="x")["error"]["code"] == -32602
    assert asked_of(served, "resources/read", uri="x")["error"]["code"] == -32002
    assert "Task: a task\n" in asked_of(served, "prompts/get", name="ground_implementation", arguments={"task": " a task "})["result"]["messages"][0]["content"]["text"]
    for wrong in ({"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "pool": 501}, {"query": "x", "snippet_lines": 201}, {"query": "x", "retriever": "none"}, {"query": "x", "weights": {"none": 1}}, {"query": "x", "more": 1}, {}):
        assert tool_of(served, "search_domain_context", **wrong)["error_type"] in ("ValueError", "TypeError")
    assert tool_of(served, "search_domain_context", query="x", retriever="lexical+ctx")["error_type"] == tool_of(served, "index_project", retriever="lexical+ctx")["error_type"] == "OptInRequired"
    out = io.StringIO()
    served.serve(io.StringIO('{"jsonrpc": "2.0", "id": 1, "method": "ping"}\n\n{"jsonrpc": "2.0", "id": 2, "method": "prompts/list"}\n'), out)
    assert {json.loads(x)["id"] for x in out.getvalue().splitlines()} == {1, 2}


def test_tool_server(spark, tmp_path):
    from quarry.project import Project
    from quarry.server import Server

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "b.md").write_text(PAGES["a/b.md"] + "\nand more")
    served = Server(lambda: Project(spark, str(tmp_path / "src"), str(tmp_path / "store")))
    # the lexical index is built when it is first asked for, others are named as missing
    found = tool_of(served, "search_domain_context", query="packets routes", top_k=99, snippet_lines=2)
    best = found["results"][0]
    assert best["path"] == "b.md" and best["snippet"] == "# Paths\npackets find routes through networks" and best["truncated"] and best["rank"] == 1
    assert found["retrievers"] == ["lexical"] and {s["name"] for s in found["skipped"]} == {"pi-serini", "treesitter"} and "pi-serini" in found["hint"]
    # a build that runs: another is refused, searches build nothing
    (tmp_path / "src" / "late.md").write_text("okapi")
    with served._building:
        assert tool_of(served, "index_project")["error_type"] == "BuildInProgress"
        busy = tool_of(served, "search_domain_context", query="okapi", retriever="lexical", include_snippet=False)
    assert busy["build_in_progress"] and busy["stale"] == ["lexical"] and all(h["path"] != "late.md" and h["snippet"] is None for h in busy["results"])
    made = tool_of(served, "index_project", retriever="lexical")
    assert made["ok"] and made["status"]["ready"] == ["lexical"] and made["status"]["strategies"][0]["files"] == 2 and "pi-serini" in made["status"]["recommendation"]
