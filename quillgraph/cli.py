"""Command line: index, query, locate, explain, status, reembed, eval. Exit codes: 0 done, 1 usage, 2 failure."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from dataclasses import asdict

from .plans import evaluation, packing
from .plans.engine import Engine
from .session import session


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise _Usage(message)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="quillgraph")
    p.add_argument("--store", default="quillgraph-store")
    p.add_argument("--embedder", help="module:name of a function from text column to vector column")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("path")
    c.add_argument("--no-embed", action="store_true")
    c.add_argument("--force", action="store_true")
    for name in ("query", "explain"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("-k", type=int, default=5)
        c.add_argument("--depth", type=int, default=2)
        c.add_argument("--json", action="store_true")
        if name == "query":
            c.add_argument("--context", action="store_true")
            c.add_argument("--budget", type=int, default=2000)
    c = sub.add_parser("locate")
    c.add_argument("symbol")
    c.add_argument("--json", action="store_true")
    sub.add_parser("status").add_argument("--json", action="store_true")
    sub.add_parser("reembed").add_argument("--full", action="store_true")
    c = sub.add_parser("eval")
    c.add_argument("cases")
    c.add_argument("-k", type=int, default=10)
    c.add_argument("--out")
    c.add_argument("--against", help="an earlier scorecard to compare with")
    return p


def render(result: dict) -> str:
    if result["intent"] == "LOCATE":
        lines = [f"{r['src_uid']}  {r['relation']}  {r['confidence']:.2f}" for r in result["references"]]
        return "\n".join([f"{result['symbol']}:", *lines]) if lines else f"{result['symbol']}: no references"
    rows = [f"{n['uid']}  {n['type']}" for n in packing.order(result)]
    return "\n".join([f"{result['intent']}: {len(rows)} nodes", *rows])


def main(argv: list[str] | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except _Usage as e:
        print(f"usage: {e}", file=sys.stderr)
        return 1
    except SystemExit as e:
        return int(e.code or 0)
    try:
        embed = None
        if a.embedder:
            module, _, name = a.embedder.partition(":")
            embed = getattr(importlib.import_module(module), name)
        with Engine(session(), a.store, embed, a.embedder or "hashing") as engine:
            say = lambda x: print(json.dumps(x, default=str, ensure_ascii=False, sort_keys=True))
            if a.command == "index":
                say(asdict(engine.index(a.path, not a.no_embed, a.force)))
            elif a.command in ("query", "explain"):
                got = engine.explain(a.text, a.k, a.depth) if a.command == "explain" else engine.ask(a.text, a.k, a.depth)
                if getattr(a, "context", False):
                    packed = packing.pack(got, a.budget)
                    say(asdict(packed)) if a.json else print(packed.text)
                else:
                    say(got) if a.json else print(render(got))
            elif a.command == "locate":
                refs = engine.locate(a.symbol)
                say(refs) if a.json else print(render({"intent": "LOCATE", "symbol": a.symbol, "references": refs}))
            elif a.command == "status":
                got = engine.status()
                say(got) if a.json else print("\n".join(f"{k}: {v}" for k, v in got.items()))
            elif a.command == "reembed":
                say({"embedded": engine.refresh_embeddings(a.full)})
            else:
                card = evaluation.run(engine, evaluation.read_cases(a.cases), a.k)
                out = card.to_dict()
                if a.out:
                    with open(a.out, "w", encoding="utf-8") as f:
                        json.dump(out, f, sort_keys=True)
                if a.against:
                    with open(a.against, encoding="utf-8") as f:
                        out["change"] = evaluation.compare(evaluation.Scorecard.from_dict(json.load(f)), card)
                say(out)
    except Exception as e:  # noqa: BLE001 - the command line reports, it doesn't trace
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
