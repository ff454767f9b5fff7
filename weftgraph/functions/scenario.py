"""Forecasts, simulated scenarios, chat and reports by a language model: prompts from the graph, answers cleaned.

A model is any function from a prompt to a text; the graph's part, the prompt and the cleaning are ours and deterministic.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.extract import first_object
from weftgraph.functions.text import context_text
from weftgraph.graph import Graph
from weftgraph.operators import analytics as A
from weftgraph.operators import relational as R

Completer = Callable[[str], str]
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
MAX_FORECASTS, MAX_HISTORY = 5, 50


def _number(value, low: float, high: float, default: float) -> float:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return default if x != x else min(high, max(low, x))


def risk_name(score: float) -> str:
    return "CRITICAL" if score >= 75 else "HIGH" if score >= 50 else "MEDIUM" if score >= 25 else "LOW"


def signals(g: Graph, between: DataFrame) -> dict:
    """The structural signs of conflict that a forecast starts from; lists are short by their operators' limits."""
    risk = A.global_risk(g).first().asDict()
    few = lambda df, n: [tuple(r) for r in df.limit(n).collect()]
    return risk | {
        "hotspots": [r.id for r in A.hotspots(g, between).collect()],
        "reciprocal": few(A.reciprocal_hostility(g).orderBy("a", "b"), 10),
        "triangles": few(A.conflict_triangles(g).orderBy("a", "b", "c"), 5),
    }


def clean_forecasts(answer: str | None) -> list[dict]:
    """At most five forecasts: title, probability from 0 to 1, a known severity, actors; none from a faulty answer."""
    text = first_object(answer, "{[")
    try:
        data = json.loads(text) if text else []
    except json.JSONDecodeError:
        return []
    items = data.get("forecasts", []) if isinstance(data, dict) else data
    out = []
    for x in (i for i in items if isinstance(i, dict)) if isinstance(items, list) else ():
        severity = str(x.get("severity", "")).upper()
        actors = x.get("actors") if isinstance(x.get("actors"), list) else []
        out.append({"title": str(x.get("title", "")).strip(), "probability": _number(x.get("probability"), 0, 1, 0.5), "severity": severity if severity in SEVERITIES else "MEDIUM", "actors": [str(a) for a in actors]})
    return out[:MAX_FORECASTS]


def forecast(g: Graph, between: DataFrame, complete: Completer) -> dict:
    """Signals and cleaned forecasts; a graph of fewer than three vertices has none."""
    if len(g.v.take(3)) < 3:
        return {"error": "a forecast needs three vertices", "forecasts": []}
    found = signals(g, between)
    lines = [r.line for r in R.edge_sample(g, 20).collect()]
    prompt = "\n".join(["Name up to five developments that this graph makes likely.", f"Signals: {json.dumps(found)}", "Edges:", *lines, 'Answer in JSON: {"forecasts": [{"title", "probability", "severity", "actors"}]}'])
    return found | {"forecasts": clean_forecasts(complete(prompt))}


@dataclass
class Simulation:
    scenario: str
    score: float
    label: str
    summary: str
    added: list[tuple[str, str, str, float]] = field(default_factory=list)
    removed: list[tuple[str, str]] = field(default_factory=list)


def clean_simulation(scenario: str, answer: str | None) -> Simulation:
    """A simulation from an answer: score from 0 to 100, a known label or that of the score, edges with both ends."""
    try:
        x = json.loads(first_object(answer) or "{}")
    except json.JSONDecodeError:
        x = {}
    score = _number(x.get("risk_score"), 0, 100, 0.0)
    label = str(x.get("risk_label", "")).upper()
    edges = lambda key: [e for e in x.get(key) or [] if isinstance(e, dict) and e.get("from") and e.get("to")]
    added = [(str(e["from"]), str(e["to"]), str(e.get("label", "")), _number(e.get("confidence"), 0, 1, 1.0)) for e in edges("added")]
    return Simulation(scenario, score, label if label in SEVERITIES else risk_name(score), str(x.get("summary", "")), added, [(str(e["from"]), str(e["to"])) for e in edges("removed")])


def simulate(g: Graph, scenario: str, complete: Completer) -> Simulation:
    """Asks for a scenario's effects on a sample of the graph that shows its hubs first. The graph stays as it is."""
    nodes = [r.id for r in R.top_degree(g, 30).collect()]
    lines = [r.line for r in R.edge_sample(g).collect()]
    prompt = "\n".join([f"Scenario: {scenario}", f"Actors: {', '.join(nodes)}", "Edges:", *lines, 'Answer in JSON: {"risk_score", "risk_label", "summary", "added": [{"from", "to", "label", "confidence"}], "removed": [{"from", "to"}]}'])
    return clean_simulation(scenario, complete(prompt))


def applied(g: Graph, result: Simulation) -> Graph:
    """The graph with a simulation's edges added and removed."""
    from weftgraph.operators.mutate import apply_changes

    add = g.spark.createDataFrame(result.added, "src string, dst string, label string, confidence double")
    return apply_changes(g, add, g.spark.createDataFrame(result.removed, "src string, dst string"))


def remembered(history: DataFrame, row: DataFrame) -> DataFrame:
    """The history (ts and other columns) with a row, the newest 50."""
    return history.unionByName(row).orderBy(F.desc("ts")).limit(MAX_HISTORY)


def chat(g: Graph, question: str, complete: Completer) -> str:
    """An answer from the edges near the question's vertices."""
    return complete(f"Answer from these facts only.\n{context_text(g, question)}\n\nQuestion: {question}")


def narrative(g: Graph, complete: Completer) -> str:
    """A short text on the first edges in order of arrival."""
    lines = [f"{r.src} {r.label or 'relates to'} {r.dst}" for r in g.e.orderBy(F.col("seq").asc_nulls_last(), "src", "dst").limit(25).collect()]
    return complete("Tell the state of affairs in a paragraph:\n" + "\n".join(lines))
