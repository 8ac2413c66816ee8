"""Small tables with odd rows, and plain loops to compare with."""

import re

LONG = " ".join(f"w{k % 977}{'x' * (k % 5)}" for k in range(60_000))
TEXTS = [
    None, "", " \t\n ", "one", "One two", "a b c d", "A b C d", "a b c d", "a\x0bb\x0cc\rd",
    "naïve café 東京   tail", "the cat sat on the mat and the dog ran after it over the hill",
    "the cat sat on the mat and the dog ran after it over the hill", "The cat sat on the mat and a dog ran after it over the hill.",
    "l1 a\nl1 a\n\n\nl2\nl1 a", "x y " * 300, LONG, LONG + " end", "#tag *** $5 <b>%&|</b>", "퟿\U0001f600 emoji words here",
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(spark, texts=TEXTS, **more):
    """(doc_id, text, lang, source, n_chars) with a null id, repeated rows, and columns whose names operators use inside."""
    rows = [(k if k != 3 else None, t, ["en", "de", None][k % 3], ["s1", "s2", None, "s1"][k % 4], len(t or ""), 1, 2, "x") for k, t in enumerate(texts)]
    rows += rows[10:12]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest int, copies int, verdict string"
    return spark.createDataFrame(rows, schema)


def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
