"""Markdown tables from metric frames of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Most rows of a table in a report.
MOST_ROWS = 1000


def number(x) -> str:
    if x is None or x != x:
        return "—"
    return f"{x:.3f}" if isinstance(x, float) else str(x)


def markdown(df: DataFrame, title: str, order: list[str]) -> str:
    """A section with the frame's rows in order; a frame of more than MOST_ROWS rows is no report."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(number(x) for x in r) + " |" for r in rows]) + "\n"


def interval(low: float, high: float) -> str:
    return f"[{number(low)}, {number(high)}]"


def analysis(metrics_by: dict[str, DataFrame], confusion: DataFrame, worst: DataFrame, intervals: DataFrame, dataset: DataFrame, title: str = "Analysis") -> str:
    """A report: the dataset, one table of metrics per format with intervals, confusion matrices, the most confused pairs.

    ``metrics_by`` has a frame by model for each format; ``intervals`` is (format, model, ci_low, ci_high); ``confusion`` (model,
    gold, pred, n); ``worst`` (model, gold, pred, n). All are of bounded size."""
    parts = [f"# {title}\n", markdown(dataset, "Dataset", dataset.columns[:1])]
    bounds = {(r["format"], r["model"]): interval(r["ci_low"], r["ci_high"]) for r in intervals.limit(MOST_ROWS).collect()}
    for kind, frame in metrics_by.items():
        rows = frame.orderBy("model").limit(MOST_ROWS + 1).collect()
        head = [*frame.columns, "95 % interval"]
        lines = [f"## {kind}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
        parts.append("\n".join(lines + ["| " + " | ".join([*map(number, r), bounds.get((kind, r["model"]), "—")]) + " |" for r in rows]) + "\n")
    for model, cells in _by_model(confusion).items():
        labels = sorted({x for g, p, _ in cells for x in (g, p)})
        n = {(g, p): k for g, p, k in cells}
        lines = [f"### Confusion of {model}", "", "| gold / predicted | " + " | ".join(labels) + " |", "|" + "---|" * (len(labels) + 1)]
        parts.append("\n".join(lines + [f"| {g} | " + " | ".join(str(n.get((g, p), 0)) for p in labels) + " |" for g in labels]) + "\n")
    for model, cells in _by_model(worst).items():
        top = sorted(cells, key=lambda c: (-c[2], c[0], c[1]))[:3]
        parts.append(f"### Most confused by {model}\n\n" + "\n".join(f"* {g} taken for {p}: {n}" for g, p, n in top) + "\n")
    return "\n".join(parts)


def _by_model(df: DataFrame) -> dict[str, list[tuple]]:
    rows = df.select("model", "gold", "pred", "n").orderBy("model", "gold", "pred").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report")
    out: dict[str, list[tuple]] = {}
    for r in rows:
        out.setdefault(r["model"], []).append((r["gold"], r["pred"], r["n"]))
    return out
