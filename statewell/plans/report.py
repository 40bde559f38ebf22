"""Reports of small results, as JSON and Markdown."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame


def clean(value):
    """Without NaN and infinities, which JSON lacks."""
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def table(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a result by state; raises if it is larger than a report can be."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows of a table at most")
    return [r.asDict(recursive=True) for r in rows]


def to_json(report: dict, path: str | Path | None = None) -> str:
    text = json.dumps(clean(report), indent=2, default=str)
    if path:
        Path(path).write_text(text)
    return text


def to_markdown(report: dict) -> str:
    lines = [f"# {report.get('symbol', 'Report')}", ""]
    for name, part in report.items():
        if name == "symbol":
            continue
        lines += [f"## {name.replace('_', ' ')}", ""]
        if part is None:
            lines += ["Not available.", ""]
        elif isinstance(part, list) and part and isinstance(part[0], dict):
            head = list(part[0])
            show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
            lines += ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(show(r[h]) for h in head) + " |" for r in part), ""]
        else:
            lines += [f"- {part}", ""]
    return "\n".join(lines)


def save(report: dict, folder: str | Path) -> None:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    to_json(report, folder / "analysis_report.json")
    (folder / "analysis.md").write_text(to_markdown(report))
