"""Small document tables with everything that may go wrong in them."""

from __future__ import annotations

import random
import re
from collections import defaultdict

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row_key long, kept string, score string, words string"
)


def documents(spark, rows, extra=True):
    """Rows (doc_id, text) as documents; with columns whose names the operators use too."""
    data = [(i, t, "en", "src0", None if t is None else len(t), 7, "x", "y", None) for i, t in rows]
    made = spark.createDataFrame(data, SCHEMA)
    return made if extra else made.select("doc_id", "text", "lang", "source", "n_chars")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def awkward():
    """Null and empty texts, blanks of all kinds, repeats, ties, a null id, a very long text."""
    base = prose(1, 120)
    return [
        (5, base), (3, base.replace(" ", "\n\t ")), (3, base), (3, base), (None, base), (None, "only null id"),
        (10, None), (11, ""), (12, " \n\x0b\x0c\r "), (13, "a"), (14, "a  b"), (15, "a b"), (16, "über straße x"),
        (17, prose(2, 30_000)), (18, "word " * 500), (19, base + " " + prose(3, 4)), (20, "### &&& | <a> $5 100%"),
    ]


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: sorted(g) for g in groups.values() for n in g}
