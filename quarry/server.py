"""A tool server: JSON-RPC 2.0 messages, one a line, on standard input and output, as the Model Context Protocol has them.

Three tools (search_domain_context, index_project, index_status), the status as a resource, one prompt. A tool never fails
the server: what goes wrong is an answer with `error`, `error_type` and `hint`. One build runs at a time; searches meanwhile
read the indexes that are there and build nothing.
"""

from __future__ import annotations

import json
import os
import sys
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from typing import IO, Any

from pyspark.sql import functions as F

from quarry.plans.strategies import REGISTRY, search_all
from quarry.project import BUILT_IN, Project, checked, shown
from quarry.sources.files import EXTRACTABLE, SNIPPET_BYTES
from quarry.sources.scratch import stored

PROTOCOL, VERSION = "2025-06-18", "0.2"
STATUS = "quarry://index/status"
# The bounds that callers rely on.
MOST_HITS, MOST_POOL, MOST_LINES, HITS, LINES = 25, 500, 200, 5, 20
PAID = "lexical+ctx"
PAID_HINT = f"{PAID} asks a model about each chunk, which costs money; it is built by a caller's own program, never here."
INSTRUCTIONS = "Searches this project's own files. Ask search_domain_context before you write or change code, read the lines it names, and say so if it finds nothing that fits. index_status tells what is indexed; index_project indexes it."
PROMPT = "Task: {task}\n\nFirst call search_domain_context with the task in plain words and the names it is about. Read the lines that the hits name, not only their snippets. If they don't fit, ask once more in other words. Work as the code you found does, and name the lines you went by; if there are none, say that."


def _number(kind: str, low: int | None = None, high: int | None = None) -> dict:
    return {"type": kind} | ({"minimum": low} if low is not None else {}) | ({"maximum": high} if high is not None else {})


def _schema(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


STRATEGY = {"type": "string", "enum": ["all", *BUILT_IN, PAID], "default": "all"}
FLAG = {"type": "boolean"}
TOOLS = {
    "search_domain_context": (
        "Finds the places in this project's files that a question is about: ranked spans of lines with snippets, and which strategies could not be asked. top_k above 25 means 25.",
        _schema(("query",), query={"type": "string"}, retriever=STRATEGY, top_k=_number("integer", 1), pool=_number("integer", 1, MOST_POOL), weights={"type": "object", "additionalProperties": _number("number", 0)}, stale_ok=FLAG, build_missing=FLAG, include_snippet=FLAG, snippet_lines=_number("integer", 1, MOST_LINES)),
        {"readOnlyHint": False, "destructiveHint": False, "idempotentHint": True, "openWorldHint": False},
    ),
    "index_project": (
        "Builds the indexes of this project, or those whose files have changed. One build at a time.",
        _schema(retriever=STRATEGY, force=FLAG, auto=FLAG),
        {"readOnlyHint": False, "destructiveHint": False, "idempotentHint": True, "openWorldHint": False},
    ),
    "index_status": ("Which indexes there are, and whether files have changed since.", _schema(), {"readOnlyHint": True, "idempotentHint": True, "openWorldHint": False}),
}


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    """Answers messages about one project, which is opened when it is first asked for."""

    def __init__(self, opened: Callable[[], Project]):
        self._opened = opened
        self._first, self._building, self._searching = threading.Lock(), threading.Lock(), threading.Lock()

    @cached_property
    def _project(self) -> Project:
        return self._opened()

    @property
    def project(self) -> Project:
        with self._first:
            return self._project

    # -- tools

    def _is_paid(self) -> bool:
        """Whether the index that stands in the lexical one's place is that of lexical+ctx."""
        found = self.project.store.record("lexical")
        return bool(found) and found["retriever_name"] == PAID

    def _stale(self, names: list[str]) -> dict[str, bool]:
        """By strategy that is indexed: whether its files have changed; they are listed once."""
        p = self.project
        there = [n for n in names if p.store.record(n)]
        if not there:
            return {}
        mark, due = p.fingerprint(), not p.due().isEmpty()
        return {n: p.store.is_stale(n, mark, reextract=due) for n in there}

    def search_domain_context(self, query: str, retriever: str = "all", top_k: int | None = None, pool: int | None = None, weights: dict[str, float] | None = None, stale_ok: bool | None = None, build_missing: bool = False, include_snippet: bool = True, snippet_lines: int = LINES) -> dict:
        """stale_ok: True builds nothing again, False all that is stale, None only what is cheap, the lexical index."""
        checked(query, HITS if top_k is None else top_k)
        for name, value, most in (("pool", pool, MOST_POOL), ("snippet_lines", snippet_lines, MOST_LINES)):
            if value is not None and not 1 <= value <= most:
                raise ValueError(f"{name} is between 1 and {most}")
        if retriever not in STRATEGY["enum"]:
            raise ValueError(f"retriever {retriever!r} is none of {STRATEGY['enum']}")
        if wrong := sorted(n for n, w in (weights or {}).items() if n not in REGISTRY or not 0 <= w < float("inf")):
            raise ValueError(f"no weights, or not of strategies: {wrong}; strategies are {sorted(REGISTRY)}")
        if retriever == PAID:
            return {"error": "lexical+ctx isn't searched here", "error_type": "OptInRequired", "hint": PAID_HINT}
        names, k = list(BUILT_IN) if retriever == "all" else [retriever], min(top_k or HITS, MOST_HITS)
        with self._searching:
            building = self._building.locked()
            stale = self._stale(names)
            if not building:
                # a build waits for this lock, so it can't start while we write
                for n in names:
                    again = stale.get(n) and (stale_ok is False or (stale_ok is None and n == "lexical"))
                    missing = n not in stale and (build_missing or n == "lexical")
                    if (again or missing) and not (n == "lexical" and self._is_paid()):
                        self.project.index(n)
                        stale[n] = False
            opened = {n: r for n in names if (r := self.project.opened(n)) is not None}
            hits = self._hits(opened, query, k, pool, weights, retriever, include_snippet, snippet_lines) if opened else []
        skipped = [{"name": n, "reason": f"not indexed: call index_project(retriever={n!r})"} for n in names if n not in opened]
        old = [n for n in opened if stale.get(n)]
        dates = [r["created_at"] for n in opened if (r := self.project.store.record(n))]
        return {
            "root": self.project.root, "query": query, "mode": "consolidated" if retriever == "all" else "single", "retriever": retriever, "retrievers": list(opened), "skipped": skipped,
            "stale": old, "build_in_progress": building, "index": {"stale": bool(old), "created_at": max(dates, default=None)}, "results": hits, "hint": _hint(hits, list(opened), skipped, old, building),
        }

    def _hits(self, opened: dict, query: str, k: int, pool: int | None, weights: dict | None, retriever: str, snippets: bool, lines: int) -> list[dict]:
        asked = self.project.spark.createDataFrame([(1, query)], "query_id int, query string")
        found = search_all(opened, asked, k, weights, pool) if retriever == "all" else opened[retriever].search(asked, k)
        hits = shown(self.project, stored(found, "found"), 0 if retriever == "all" else 1, lines)
        for h in hits:
            first, last, text = h.get("start_line"), h.get("end_line"), h.get("snippet")
            long = first is not None and last is not None and last - first + 1 > lines
            h["path"] = h.pop("source_path")
            h["truncated"] = snippets and text is not None and (long or len(text.encode()) > SNIPPET_BYTES - 4)
            h["snippet"] = text if snippets else None
            if snippets and h["path"].lower().endswith(EXTRACTABLE):
                h["snippet_note"] = "lines of the file's transcript"
        return hits

    def index_project(self, retriever: str = "all", force: bool = False, auto: bool = False) -> dict:
        if retriever == PAID or (retriever in ("all", "lexical") and self._is_paid()):
            return {"error": "lexical+ctx isn't built here, nor is another index put in its place", "error_type": "OptInRequired", "hint": PAID_HINT}
        if retriever not in STRATEGY["enum"]:
            raise ValueError(f"retriever {retriever!r} is none of {STRATEGY['enum']}")
        if not self._building.acquire(blocking=False):
            return {"error": "a build is running", "error_type": "BuildInProgress", "hint": "Ask index_status until it is done; searches read what is there."}
        try:
            with self._searching:
                pass  # searches that began before may write
            log = []
            for n in BUILT_IN if retriever == "all" else (retriever,):
                found, fresh = self.project.index(n, auto, force)
                log.append(f"{n}: {found.lexical.n_docs} chunks, {'as they were' if fresh else 'indexed'}")
        finally:
            self._building.release()
        return {"root": self.project.root, "retriever": retriever, "force": force, "ok": True, "log": log, "status": self.index_status()}

    def index_status(self) -> dict:
        stale, rows = self._stale(list(BUILT_IN)), []
        for n in BUILT_IN:
            r = self.project.store.record(n) or {}
            opened = self.project.opened(n) if r else None
            files = opened.docs.select("source_path").distinct().count() if opened is not None else None
            rows.append({"name": n, "indexed": bool(r), "loadable": opened is not None, "stale": stale.get(n), "built_as": r.get("retriever_name"), "chunks": r.get("n_docs"), "files": files, "created_at": r.get("created_at")})
        old, none = [x["name"] for x in rows if x["stale"]], [x["name"] for x in rows if not x["loadable"]]
        advice = f"Files have changed since {', '.join(old)} was indexed: call index_project." if old else f"Not indexed: {', '.join(none)}. index_project indexes them." if none else "All is indexed and fresh."
        ready = [x["name"] for x in rows if x["loadable"] and x["stale"] is False]
        return {"root": self.project.root, "cache_dir": self.project.folder, "engine_version": VERSION, "strategies": rows, "ready": ready, "recommendation": advice, "build_in_progress": self._building.locked()}

    def called(self, name: str, arguments: dict) -> dict:
        """A tool's answer; what it raises is one, too."""
        if unknown := sorted(set(arguments) - set(TOOLS[name][1]["properties"])):
            return {"error": f"{name} has no argument {', '.join(unknown)}", "error_type": "TypeError", "hint": "See the tool's input schema."}
        try:
            return getattr(self, name)(**arguments)
        except Exception as e:  # the protocol's boundary: any failure is told
            return {"error": str(e).splitlines()[0] if str(e) else type(e).__name__, "error_type": type(e).__name__, "hint": "Mend the arguments, or ask index_status."}

    # -- messages

    def answer(self, method: str, params: dict) -> dict:
        """The result of a request."""
        if method == "initialize":
            offered = {"tools": {"listChanged": False}, "resources": {"listChanged": False, "subscribe": False}, "prompts": {"listChanged": False}}
            return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": offered, "serverInfo": {"name": "quarry", "version": VERSION}, "instructions": INSTRUCTIONS}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": s, "annotations": a} for n, (d, s, a) in TOOLS.items()]}
        if method == "tools/call":
            if params.get("name") not in TOOLS:
                raise RpcError(-32602, f"there is no tool {params.get('name')!r}")
            made = self.called(params["name"], params.get("arguments") or {})
            return {"content": [{"type": "text", "text": json.dumps(made, ensure_ascii=False, default=str)}], "structuredContent": made, "isError": "error" in made}
        if method == "resources/list":
            return {"resources": [{"uri": STATUS, "name": "index_status", "mimeType": "application/json", "description": TOOLS["index_status"][0]}]}
        if method == "resources/templates/list":
            return {"resourceTemplates": []}
        if method == "resources/read":
            if params.get("uri") != STATUS:
                raise RpcError(-32002, f"there is no resource {params.get('uri')!r}")
            return {"contents": [{"uri": STATUS, "mimeType": "application/json", "text": json.dumps(self.called("index_status", {}), default=str)}]}
        if method == "prompts/list":
            return {"prompts": [{"name": "ground_implementation", "description": "Work on a task as the project's own code does.", "arguments": [{"name": "task", "required": True}]}]}
        if method == "prompts/get":
            if params.get("name") != "ground_implementation":
                raise RpcError(-32602, f"there is no prompt {params.get('name')!r}")
            task = str((params.get("arguments") or {}).get("task", "")).strip() or "(say what it is)"
            return {"messages": [{"role": "user", "content": {"type": "text", "text": PROMPT.format(task=task)}}]}
        raise RpcError(-32601, f"there is no method {method!r}")

    def reply(self, line: str) -> dict | None:
        """The reply to one line, or nothing if it asks for none."""
        try:
            message = json.loads(line)
        except ValueError:
            return _failed(None, -32700, "not JSON")
        if not isinstance(message, dict) or not isinstance(message.get("method"), str) or not isinstance(message.get("params", {}), dict):
            # an answer to a request of ours has no method; we make none
            return _failed(message.get("id") if isinstance(message, dict) else None, -32600, "no request")
        if "id" not in message:
            return None
        try:
            return {"jsonrpc": "2.0", "id": message["id"], "result": self.answer(message["method"], message.get("params", {}))}
        except RpcError as e:
            return _failed(message["id"], e.code, str(e))

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        """Until the source ends: lines are answered as they are done, so a long build doesn't hold up a search."""
        writing = threading.Lock()

        def one(line: str) -> None:
            if (made := self.reply(line)) is not None:
                with writing:
                    sink.write(json.dumps(made, ensure_ascii=False, default=str) + "\n")
                    sink.flush()

        with ThreadPoolExecutor(8) as pool:
            for line in source:
                if line.strip():
                    pool.submit(one, line)


def _failed(number: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def _hint(hits: list, used: list[str], skipped: list[dict], stale: list[str], building: bool) -> str:
    out = []
    if not used:
        out.append("Nothing was searched, so this says nothing of the project. Call index_project(retriever='lexical') and ask again.")
    elif not hits:
        out.append("No matches. Ask once more with names or terms that the files would use; if there are none again, the project has nothing of this kind.")
    else:
        out.append("Read the lines that the hits name before you write.")
    if used and skipped:
        out.append(f"Not asked: {', '.join(s['name'] for s in skipped)}; index_project(retriever='all') indexes them.")
    if stale:
        out.append(f"Files have changed since {', '.join(stale)} was indexed; index_project brings it up to date.")
    if building:
        out.append("A build is running; what was there before it was searched.")
    return " ".join(out)


def run(opened: Callable[[], Project]) -> int:
    """Serves standard input. Whatever else prints, the JVM too, prints to standard error."""
    own = os.fdopen(os.dup(1), "w", encoding="utf-8")
    os.dup2(2, 1)
    sys.stdout = sys.stderr
    Server(opened).serve(sys.stdin, own)
    return 0
