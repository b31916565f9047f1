"""Brute-force versions and small tables for the corpus operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(WORD, text or "")


def table(spark, rows, columns=COLUMNS):
    """Documents from (doc_id, text) or full rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, columns)


def clashing(df):
    """The same table with further columns whose names operators use inside."""
    from pyspark.sql import functions as F
    out = df
    for name in ("n", "key", "_size", "words", "print", "id", "kept", "score", "node", "y",
                 "target", "source_size", "_copies", "_n", "size", "copies", "row", "copy", "rep",
                 "place", "digest", "of"):
        out = out.withColumn(name, F.lit("clash"))
    return out


def repeats(docs, least=50):
    """doc_id -> bytes, removed, spans, digest of what stays."""
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, t in data:
        for p in range(len(t) - least + 1):
            s = t[p:p + least]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if first[t[p:p + least]] < i:
                gone[p:p + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_components(docs, percent=80):
    """doc_id -> (shingles of its last text, smallest doc_id reachable by any text)."""
    rows = [(i, shingles(t)) for i, t in docs]
    sets = dict(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(rows):
        for b, y in rows[n + 1:]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sorted(sets)}


def near_copies(seed=3, clusters=10):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = []
    for _ in range(clusters):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 70))]
        for _ in range(rnd.randint(1, 12)):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            t += [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 0, 3, 6]))]
            text = "  ".join(t)
            docs.append((len(docs) * 17 % 1009, text.upper() if rnd.random() < .2 else text))
    return docs


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1
              for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(inside),
            len(w) < 10 or 100 * len(inside) > 20 * len(w))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]
