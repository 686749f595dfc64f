"""Small tables with the odd cases every operator must bear."""

from __future__ import annotations

import random

#: Extra columns named like the operators' own.
DDL = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, body long, size long, "
    "h long, root long, target double, copies int, block string, first array<int>"
)
EXTRA = (None, 7, 7, 7, 7, 7, 1.5, 2, "x", [1])


def words(rng: random.Random, n: int, stems: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(2, 6))) for _ in range(n))


def frame(spark, texts, lang=None, source=None):
    """Documents numbered from 0 in the given order, or with the ids given as (id, text)."""
    rows = []
    for i, item in enumerate(texts):
        doc_id, text = item if isinstance(item, tuple) else (i, item)
        rows.append((doc_id, text, lang(i) if lang else None, source(i) if source else None, *EXTRA))
    return spark.createDataFrame(rows, DDL)


def odd_texts() -> list:
    rng = random.Random(5)
    long = words(rng, 30_000)
    return [
        None, "", " ", "\n\n", "a", "Ünï çødé \U0001f600\n\ttabs", "same text here for all of us", "same text here for all of us",
        long, long, (0, "id of another row"), (None, "no id"), (None, "no id"), (None, None), "!!! ... ???", "0123456789",
    ]


def dicts(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
