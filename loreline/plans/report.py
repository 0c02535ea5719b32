"""Driver-side rendering of small results: Mermaid, trees, HTML, Markdown, JSON. Inputs are bounded (limits are part of the feature)."""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame

MAX_NODES = 30


def _safe(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", name)


def mermaid(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> str:
    """Diagram of at most ``max_nodes`` nodes and the edges between them, once each."""
    names = [r[0] for r in nodes.select("qualified_name").orderBy("qualified_name").limit(max_nodes).collect()]
    shown = {_safe(n): n for n in reversed(names)}
    rows = edges.filter(edges["src"].isin(names) & edges["dst"].isin(names)).select("src", "dst").distinct().orderBy("src", "dst").collect() if names else []
    lines = ["graph TD"] + [f'    {_safe(n)}["{n.rsplit(".", 1)[-1]}"]' for n in names if shown[_safe(n)] == n]
    return "\n".join(lines + list(dict.fromkeys(f"    {_safe(a)} --> {_safe(b)}" for a, b in rows)))


def tree(edges: DataFrame, root: str, depth: int = 3, reverse: bool = False, most: int = 10_000) -> str:
    """Text tree from a root; a node is opened once. ``edges`` should be the root's call graph."""
    out = defaultdict(list)
    for a, b in edges.select("src", "dst").distinct().orderBy("src", "dst").limit(most).collect():
        out[b if reverse else a].append(a if reverse else b)
    lines, seen = [root], {root}

    def walk(node: str, level: int, pad: str) -> None:
        if level >= depth:
            return
        kids = out[node]
        for k, x in enumerate(kids):
            last = k == len(kids) - 1
            again = x in seen
            lines.append(f"{pad}{'└── ' if last else '├── '}{x}{' (seen)' if again else ''}")
            if not again:
                seen.add(x)
                walk(x, level + 1, pad + ("    " if last else "│   "))

    walk(root, 0, "")
    return "\n".join(lines)


def graph_payload(nodes: DataFrame, edges: DataFrame, most: int = 2000) -> dict:
    return {"nodes": [r.asDict() for r in nodes.orderBy("qualified_name").limit(most).collect()], "edges": [r.asDict() for r in edges.select("src", "dst", "relation_type").orderBy("src", "dst").limit(5 * most).collect()]}


def write_graph_html(nodes: DataFrame, edges: DataFrame, root: str, folder: str) -> str:
    """A page of its own with the graph as data and as a list; unsafe characters of the root become underscores in the file name."""
    payload = graph_payload(nodes, edges)
    items = "".join(f"<li>{html.escape(e['src'])} &rarr; {html.escape(e['dst'])} <small>{html.escape(e['relation_type'] or '')}</small></li>" for e in payload["edges"])
    path = Path(folder) / f"graph_{re.sub(r'[^A-Za-z0-9_.-]', '_', root)}.html"
    path.parent.mkdir(parents=True, exist_ok=True)
    data = json.dumps(payload).replace("</", "<\\/")
    path.write_text(f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(root)}</title><h1>{html.escape(root)}</h1><ul>{items}</ul><script type='application/json' id='graph'>{data}</script>")
    return str(path)


def evidence_markdown(bundle: dict, evidence: list[dict]) -> str:
    lines = [f"# {bundle.get('summary') or 'Unknown Error'}", "", f"Confidence: {bundle.get('confidence', 0):.2f}", "", "## Call chain", ""]
    lines += [f"1. `{c}`" for c in bundle.get("call_chain") or []]
    for e in evidence:
        lines += ["", f"## {e.get('file_path')}:{e.get('line_number')}", "", "```python", e.get("snippet") or "", "```"]
    return "\n".join(lines)


def save_report(text: str, path: str) -> str:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def evaluation_report(metrics: DataFrame, failures: DataFrame, folder: str) -> dict:
    """failure_report.json and .md."""
    row, hist = metrics.first().asDict(), {r[0]: r[1] for r in failures.collect()}
    save_report(json.dumps({"metrics": row, "failures": hist}, indent=2), f"{folder}/failure_report.json")
    save_report("# Retrieval evaluation\n\n" + "\n".join(f"- {k}: {v}" for k, v in {**row, **hist}.items()), f"{folder}/failure_report.md")
    return {"metrics": row, "failures": hist}
