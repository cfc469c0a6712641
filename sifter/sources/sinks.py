"""Reports: JSON, CSV, Markdown, LaTeX, and graphs as GraphML, GEXF, node-link JSON, Mermaid and SVG."""

from __future__ import annotations

import csv
import json
import math
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def write_json(path: str, payload) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def header(rows: list[dict]) -> list[str]:
    return sorted({k for r in rows for k in r})


def _cell(value) -> str:
    return "" if value is None else stable_json(value) if isinstance(value, dict | list | tuple | set) else str(value)


def write_csv(path: str, rows: list[dict]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as out:
        w = csv.writer(out)
        w.writerow(header(rows))
        w.writerows([_cell(r.get(k)) for k in header(rows)] for r in rows)


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return "_no rows_\n"
    names = header(rows)
    lines = [names, ["---"] * len(names), *([_cell(r.get(k)).replace("|", "\\|").replace("\n", " ") for k in names] for r in rows)]
    return "".join(f"| {' | '.join(x)} |\n" for x in lines)


def latex_table(rows: list[dict], caption: str = "", label: str = "") -> str:
    names = header(rows)
    special = {c: f"\\{c}" for c in "&%$#_{}"}
    safe = lambda x: "".join(special.get(c, c) for c in x)
    body = "".join(f"{' & '.join(safe(_cell(r.get(k))) for k in names)} \\\\\n" for r in rows)
    return f"\\begin{{table}}\n\\centering\n\\begin{{tabular}}{{{'l' * max(1, len(names))}}}\n\\hline\n{' & '.join(map(safe, names))} \\\\\n\\hline\n{body}\\hline\n\\end{{tabular}}\n\\caption{{{safe(caption)}}}\n\\label{{{label}}}\n\\end{{table}}\n"


def write_report(path: str, rows: list[dict], title: str = "") -> None:
    kind = Path(path).suffix.lower()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if kind == ".json":
        write_json(path, rows)
    elif kind == ".csv":
        write_csv(path, rows)
    elif kind == ".md":
        Path(path).write_text(f"# {title}\n\n" * bool(title) + markdown_table(rows))
    elif kind == ".tex":
        Path(path).write_text(latex_table(rows, title))
    else:
        raise ValueError(f"no report of kind {kind!r}")


def table_bundle(folder: str, name: str, rows: list[dict], title: str = "") -> list[str]:
    made = [f"{folder}/{name}{kind}" for kind in (".md", ".csv", ".json", ".tex")]
    for path in made:
        write_report(path, rows, title)
    return made


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs taken apart, level by level, into columns named by their path."""

    def leaves(kind: T.StructType, path: list[str]):
        for f in kind:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, [])))


def flatten_dict(value: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in value.items():
        name = f"{prefix}_{k}" if prefix else str(k)
        out |= flatten_dict(v, name) if isinstance(v, dict) else {name: v}
    return out


class GraphExport:
    """Vertices (id, label) and weighted edges, written in several forms."""

    def __init__(self, vertices: list[tuple[str, str]], edges: list[tuple[str, str, float]]):
        self.vertices, self.edges = sorted(vertices), sorted(edges)

    def mermaid(self) -> str:
        at = {v: f"n{k}" for k, (v, _) in enumerate(self.vertices)}
        lines = [
            f'  {at[v]}["{label.replace(chr(34), chr(39))}"]' for v, label in self.vertices
        ] + [f"  {at[a]} --- {at[b]}" for a, b, _ in self.edges]
        return "flowchart LR\n" + "\n".join(lines) + "\n"

    def svg(self, size: int = 640) -> str:
        n, mid = max(1, len(self.vertices)), size / 2
        at = {
            v: (mid + 0.8 * mid * math.cos(2 * math.pi * k / n), mid + 0.8 * mid * math.sin(2 * math.pi * k / n))
            for k, (v, _) in enumerate(self.vertices)
        }
        lines = "".join(
            f'<line x1="{at[a][0]:.1f}" y1="{at[a][1]:.1f}" x2="{at[b][0]:.1f}" y2="{at[b][1]:.1f}" stroke="#888"/>'
            for a, b, _ in self.edges
        )
        dots = "".join(
            f'<circle cx="{at[v][0]:.1f}" cy="{at[v][1]:.1f}" r="6"/><text x="{at[v][0] + 8:.1f}" y="{at[v][1]:.1f}" '
            f'font-size="10">{escape(label)}</text>'
            for v, label in self.vertices
        )
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">{lines}{dots}</svg>\n'

    def graphml(self) -> str:
        nodes = "".join(f'<node id={quoteattr(v)}><data key="label">{escape(label)}</data></node>' for v, label in self.vertices)
        edges = "".join(f'<edge source={quoteattr(a)} target={quoteattr(b)}><data key="weight">{w}</data></edge>' for a, b, w in self.edges)
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">{nodes}{edges}</graph></graphml>\n'

    def gexf(self) -> str:
        nodes = "".join(f"<node id={quoteattr(v)} label={quoteattr(label)}/>" for v, label in self.vertices)
        edges = "".join(
            f'<edge id="{k}" source={quoteattr(a)} target={quoteattr(b)} weight="{w}"/>' for k, (a, b, w) in enumerate(self.edges)
        )
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>{nodes}</nodes><edges>{edges}</edges></graph></gexf>\n'

    def node_link(self) -> dict:
        return {
            "directed": False,
            "nodes": [{"id": v, "label": label} for v, label in self.vertices],
            "links": [{"source": a, "target": b, "weight": w} for a, b, w in self.edges],
        }

    def write(self, stem: str) -> list[str]:
        Path(stem).parent.mkdir(parents=True, exist_ok=True)
        made = {
            ".mmd": self.mermaid(),
            ".svg": self.svg(),
            ".graphml": self.graphml(),
            ".gexf": self.gexf(),
            ".json": json.dumps(self.node_link(), indent=2, sort_keys=True),
        }
        for kind, text in made.items():
            Path(stem + kind).write_text(text)
        return [stem + k for k in made]


def layer_graph(items: list, shared) -> GraphExport:
    """A graph of one layer: items are joined if shared(a, b) has something in common."""
    from itertools import combinations

    return GraphExport(
        [(x.id, x.title) for x in items],
        [(*sorted((a.id, b.id)), float(len(common))) for a, b in combinations(items, 2) if (common := shared(a, b))],
    )
