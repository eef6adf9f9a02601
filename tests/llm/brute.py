"""Plain versions of the operators, for small inputs, and the awkward documents that all of them are tested with."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward():
    """Nulls in any column, empty and long texts, ties, copies, odd white space and letters outside ASCII."""
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "changed")
    texts = [
        None, "", " \t\n", "one", "a b c d e", "a b c d e", base, base, near, base + " tail", base.upper(),
        "x y  ź naïve ßİ", "l1 a\nl1 a\n\nl2\nl1 a\n", "\n", "e\n", "e\ne",
        "rep " * 40, "z" * 3000, " ".join(f"w{i % 7}" for i in range(30000)), "Under the MIT License. cc by-nc; apache license, version 2",
        "you stupid idiot , scum and tr4sh", 'he said "idiot" once', "\x00nul \x0b vt", base[:200], "a<|endoftext|>b <|ENDOFTEXT|> don't DON'T x's a.b'c (é) é. ...ab12cd,3.5 e\u0301x \u201cq\u201d.", "passage " + base[100:260] + " other",
        *alike(), f"{alike()[0]}\n{alike()[1]}\n{alike()[0]}", "\N{GRINNING FACE} " * 10 + "under the mit license",
        f"{base} {alike()[0]}", f"{base} {alike()[1]}",
    ]
    return [(i * 3 + 1, t, None if i % 5 == 0 else "en", None if i % 6 == 0 else f"s{i % 3}", None if i % 4 == 0 else len(t or "")) for i, t in enumerate(texts)]


def alike(n=1024):
    """Two words of n letters (a power of 2) with the structure on which sums of powers modulo 2 ** 64 agree."""
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


def fixture(spark, rows=None):
    """documents with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    for c in ("score", "text_hash", "key", "n", "class", "chunk", "size"):
        df = df.withColumn(c, F.lit("x"))
    return df


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)
