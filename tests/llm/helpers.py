"""Small tables with the awkward cases every operator must take."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sa", "lo", "ne") for b in ("na", "ri", "ta", "vu", "so", "pe", "li")]


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def words(text):
    return WORD.findall(lowered(text))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def docs(spark, texts):
    """Documents with ids from 0, or given as (id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def awkward(spark):
    """Null and empty texts, blanks, a very long text, repeated rows, a null id, odd characters, clashing columns."""
    long = prose(1, 30_000)
    rows = [
        (0, None), (1, ""), (2, " \t\n\x0b\x0c\r"), (3, long), (4, "one"), (5, prose(2, 60)), (5, prose(2, 60)),
        (None, prose(3, 60)), (None, None), (6, "Ünï cödé 日本語 🙂 " * 20), (7, "a\n" * 500), (8, "x" * 50_000),
    ]
    clash = "kept score rep node label word block train sequence_id rank _words _key hash n_words base_failed".split()
    return docs(spark, rows).select("*", *[F.lit(f"own {c}").alias(c) for c in clash])


def empty(spark):
    return docs(spark, [(0, "x")]).where("false")
