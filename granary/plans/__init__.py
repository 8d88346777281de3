"""Plans as text and as graphs."""

from __future__ import annotations

import re

from ..operators.frame import Frame


def text(frame: Frame, mode: str = "formatted") -> str:
    return frame._df._sc._jvm.PythonSQLUtils.explainString(frame._df._jdf.queryExecution(), mode)


def dot(frame: Frame) -> str:
    """The optimised logical plan in Graphviz form."""
    tree = frame._df._jdf.queryExecution().optimizedPlan().toString().rstrip().split("\n")
    lines, above = ["digraph plan {"], []
    for i, line in enumerate(tree):
        mark = re.match(r"[\s:|+\-]*", line)[0]
        label = line[len(mark) :][:80].replace('"', "'")
        lines.append(f'  n{i} [label="{label}"];')
        while above and above[-1][0] >= len(mark):
            above.pop()
        if above:
            lines.append(f"  n{above[-1][1]} -> n{i};")
        above.append((len(mark), i))
    return "\n".join([*lines, "}"])
