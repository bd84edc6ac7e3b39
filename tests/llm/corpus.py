"""Small inputs with every odd case, and plain Python versions of what the operators compute."""

import re
from collections import Counter

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        *[T.StructField(n, T.StringType()) for n in ("rank", "size", "d", "h", "copies", "score", "row", "gone")],
    ]
)


def frame(spark, rows):
    """``rows``: (doc_id, text, lang, source)."""
    full = [(i, t, la, so, None if t is None else len(t), *["x"] * 8) for i, t, la, so in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    words = [f"w{k}" for k in range(400)]
    long = " ".join(words) + "\n" + " ".join(reversed(words))
    base = " ".join(words[:60])
    near = base.replace("w30 ", "other ")
    return [
        (1, base, "en", "a"),
        (2, near, "en", "a"),
        (3, base, "de", None),
        (4, base.upper(), None, "b"),
        (5, None, "en", "a"),
        (6, "", "en", "b"),
        (7, " \n\t\r ", "fr", "b"),
        (8, "two words", "fr", "c"),
        (8, "two words", "fr", "c"),
        (9, "Two Words", "fr", "c"),
        (10, long, "en", "a"),
        (11, "<|endoftext|> café café 中文 \U0001f600\x00", None, None),
        (12, "a a a a a a a a a a a a", "en", "c"),
        (13, long * 20, "en", "a"),
        (14, "line one has six words here\n\nshort\nline one has six words here\nshort", "en", "b"),
        (None, base, "en", "a"),
        (None, None, None, None),
    ]


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n):
    w = words(fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def linked_groups(rows, n, percent):
    """doc_id -> (set size, smallest linked doc_id), for rows (doc_id, text) with different ids."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        common = Counter(j for g in s for j in holders[g] if j > i)
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def repeat_mask(texts, length):
    """For each text a bytearray with 1 where a string of ``length`` bytes that starts twice or more covers it."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                mask[k : k + length] = b"\1" * length
        out.append(mask)
    return out
