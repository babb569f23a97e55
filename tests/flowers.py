"""The flower table that several tests share."""

import numpy as np


def flower_rows(n: int = 150, seed: int = 3) -> list[tuple]:
    """Three classes with four lengths, a colour with gaps and a size."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        target = i % 3
        lengths = rng.normal([5 + target, 3.0, 1.5 + 2 * target, 0.4 + 0.8 * target], 0.4)
        cells = [round(float(x), 1) for x in lengths]
        color = ["pink", "white", "purple"][int(rng.integers(3))]
        cells = [None if rng.random() < 0.05 else c for c in cells]
        color = None if rng.random() < 0.05 else color
        size = ["small", "medium", "large"][int(rng.choice(3, p=[0.4, 0.25, 0.35]))]
        category = "large-flower" if size == "large" else "small-flower"
        rows.append((f"{i}{'a' if i % 7 == 0 else ''}", *cells, color, target, size, category))
    return rows


FLOWER_COLUMNS = ["id", "sepal length (cm)", "sepal width (cm)", "petal length (cm)",
                  "petal width (cm)", "color", "target", "size", "flower_category"]
FLOWER_SCHEMA = ("id string, `sepal length (cm)` double, `sepal width (cm)` double, "
                 "`petal length (cm)` double, `petal width (cm)` double, color string, "
                 "target int, size string, flower_category string")
