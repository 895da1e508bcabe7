"""Evaluation of an engine on labelled cases."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..operators import metrics
from .engine import Engine

HIGH = 0.9
_KEYS = {"query", "intent", "expected_uids", "gains"}


@dataclass
class Case:
    query: str
    intent: str
    expected_uids: list[str]
    gains: dict[str, float] | None = None


@dataclass
class Scorecard:
    locate: dict = field(default_factory=dict)
    explain: dict = field(default_factory=dict)
    per_case: list = field(default_factory=list)
    broken: list = field(default_factory=list)
    k: int = 10

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, got: dict) -> Scorecard:
        if extra := set(got) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown keys: {sorted(extra)}")
        return cls(**got)


def read_cases(path: str) -> list[Case]:
    """Cases from JSON lines; other keys are refused."""
    out = []
    with open(path, encoding="utf-8") as f:
        for line in filter(str.strip, f):
            got = json.loads(line)
            if extra := set(got) - _KEYS:
                raise ValueError(f"unknown keys: {sorted(extra)}")
            out.append(Case(**got))
    return out


def run(engine: Engine, cases: list[Case], k: int = 10) -> Scorecard:
    """Metrics of all cases in one plan for each intent; cases that expect unknown nodes are broken."""
    spark = engine.spark
    wanted = spark.createDataFrame([(u,) for u in sorted({u for c in cases for u in c.expected_uids})] or [("",)], "uid string")
    known = {r.uid for r in engine.graph.nodes.join(wanted, "uid", "left_semi").select("uid").collect()}
    card = Scorecard(k=k)
    rows = {"LOCATE": [], "HIGH": [], "EXPLAIN": []}
    good: dict[str, list[tuple[int, Case]]] = {"LOCATE": [], "EXPLAIN": []}
    for n, c in enumerate(cases):
        intent = c.intent.upper()
        if not set(c.expected_uids) <= known:
            card.broken.append(c.query)
            card.per_case.append({"query": c.query, "intent": intent, "broken": True})
        elif intent == "LOCATE":
            refs = engine.locate(c.query)
            rows["LOCATE"] += [(n, r["src_uid"], p) for p, r in enumerate(refs)]
            rows["HIGH"] += [(n, r["src_uid"], p) for p, r in enumerate(refs) if r["confidence"] >= HIGH]
            good[intent].append((n, c))
        elif intent == "EXPLAIN":
            got = engine.explain(c.query, k=k)
            uid = {x["id"]: x["uid"] for x in got["nodes"]}
            first = [uid[i] for i in got.get("ranking") or got["seeds"] if i in uid]
            ordered = list(dict.fromkeys(first + sorted(uid.values())))
            rows["EXPLAIN"] += [(n, u, p) for p, u in enumerate(ordered)]
            good[intent].append((n, c))
        else:
            card.per_case.append({"query": c.query, "intent": intent, "skipped": "unsupported intent"})

    def tables(intent: str, returned: str):
        ids = spark.createDataFrame([(n,) for n, _ in good[intent]], "case_id int")
        got = spark.createDataFrame(rows[returned], "case_id int, uid string, pos int")
        want = [(n, u, float((c.gains or {}).get(u, 1.0 if not c.gains else 0.0))) for n, c in good[intent] for u in c.expected_uids]
        return ids, got, spark.createDataFrame(want, "case_id int, uid string, gain double")

    per: dict[int, dict] = {}
    for intent, names in (("LOCATE", ("precision", "recall", "f1")), ("EXPLAIN", ("recall_at_k", "mrr", "ndcg"))):
        if not good[intent]:
            values = dict.fromkeys(names, 0.0) | {"n": 0} | ({"precision_high": 0.0} if intent == "LOCATE" else {})
        else:
            one = metrics.set_metrics(*tables(intent, intent)) if intent == "LOCATE" else metrics.rank_metrics(*tables(intent, intent), k)
            per |= {r.case_id: {x: r[x] for x in names} for r in one.collect()}
            values = {x: sum(per[n][x] for n, _ in good[intent]) / len(good[intent]) for x in names} | {"n": len(good[intent])}
            if intent == "LOCATE":
                high = {r.case_id: r.precision for r in metrics.set_metrics(*tables(intent, "HIGH")).collect()}
                per = {n: v | {"precision_high": high[n]} if n in high else v for n, v in per.items()}
                values["precision_high"] = sum(high.values()) / len(high)
        setattr(card, intent.lower(), values)
    card.per_case += [{"query": c.query, "intent": i, "expected": c.expected_uids} | per[n] for i in good for n, c in good[i]]
    return card


def compare(before: Scorecard, after: Scorecard) -> dict:
    """Change of each metric that both have."""
    out = {}
    for part in ("locate", "explain"):
        a, b = getattr(before, part), getattr(after, part)
        out[part] = {k: b[k] - a[k] for k in a if k in b and k != "n"}
    return out
