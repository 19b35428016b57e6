"""Small document tables and plain versions of the operators' definitions."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(_LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def prose(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward():
    """Null and empty texts, null identifiers, repeated rows, other scripts, one very long text."""
    long = prose(30_000, 99)
    return [(1, None), (2, ""), (3, " \t\n"), (None, "no identifier at all here"), (4, "Same Text"), (5, "same text"), (5, "same text"), (6, "ÄÖÜ ß ÇA va"), (7, "日本語 の テキスト です よ"), (8, long), (9, long + " end"), (None, None), (10, "a")]
