"""Fixtures for the document operators: hand-made rows and brute-force helpers."""

import random
import re

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
           # extra columns whose names the operators use inside
           "row long, grp long, doc string, node long, size long, bkey long, m string, p double, m1 int")


def frame(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None, 7, 8, "x", 9, 10, 11, "y", 0.5, 1) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


def prose(n, seed):
    """``n`` words that hardly repeat."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def save(docs, folder, **tables):
    for name, df in {"documents": docs, **tables}.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
