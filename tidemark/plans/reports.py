"""Reports of results as text and LaTeX, and the command line: python -m tidemark.plans.reports --table ... ."""

from __future__ import annotations

import argparse
import logging
import random
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def logger(name: str = "tidemark") -> logging.Logger:
    """X36."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    return logging.getLogger(name)


def run_folder(base: str, *parts: str) -> Path:
    """A folder of the driver for reports; made if it isn't there."""
    out = Path(base).joinpath(*parts)
    out.mkdir(parents=True, exist_ok=True)
    return out


def seeded(seed: int) -> random.Random:
    """A generator of one's own; global state stays as it is. Sets numpy's, which libraries use."""
    import numpy as np

    np.random.seed(seed)
    return random.Random(seed)


def _cells(df: DataFrame, order: tuple[str, ...], rows: int, digits: int) -> list[list[str]]:
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return [[shown(v) for v in r] for r in (df.orderBy(*order) if order else df).limit(rows).collect()]


def text_table(df: DataFrame, title: str, order: tuple[str, ...] = (), rows: int = 100, digits: int = 4) -> str:
    """A titled table of the first rows in plain text."""
    cells = [df.columns, *_cells(df, order, rows, digits)]
    width = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip()
    return "\n".join([title, "=" * len(title), line(cells[0]), "  ".join("-" * w for w in width), *map(line, cells[1:])])


def latex_table(df: DataFrame, caption: str, label: str, order: tuple[str, ...] = (), rows: int = 100, digits: int = 4) -> str:
    """The same for LaTeX; special characters are escaped, the first column is aligned left, others right."""
    escaped = lambda x: "".join("\\" + c if c in "&%$#_{}" else {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}.get(c, c) for c in x)
    lines = [" & ".join(map(escaped, r)) + r" \\" for r in [df.columns, *_cells(df, order, rows, digits)]]
    kind = "l" + "r" * (len(df.columns) - 1)
    return "\n".join([r"\begin{table}", r"\centering", rf"\caption{{{escaped(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{kind}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}", r"\end{table}"])


def main(argv: list[str] | None = None) -> None:
    """Run a registered query over a folder of tables and print it, or save it as text or LaTeX."""
    from ..catalog import QUERIES

    p = argparse.ArgumentParser(description="Run a query of the engine and report its rows.")
    p.add_argument("query", choices=sorted(QUERIES))
    p.add_argument("folder", help="folder of the Parquet tables")
    p.add_argument("--rows", type=int, default=50)
    p.add_argument("--digits", type=int, default=4)
    p.add_argument("--latex", action="store_true")
    p.add_argument("--out", help="folder for the report; printed without it")
    a = p.parse_args(argv)
    df = QUERIES[a.query](SparkSession.builder.appName("tidemark").getOrCreate(), a.folder)
    order = tuple(c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct")))
    report = latex_table(df, a.query, f"tab:{a.query}", order, a.rows, a.digits) if a.latex else text_table(df, a.query, order, a.rows, a.digits)
    if a.out:
        path = run_folder(a.out) / f"{a.query}.{'tex' if a.latex else 'txt'}"
        path.write_text(report + "\n", encoding="utf-8")
        logger().info("wrote %s", path)
    else:
        print(report)


if __name__ == "__main__":
    main()
