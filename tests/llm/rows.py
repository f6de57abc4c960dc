"""Documents for the operators' tests: nulls, blanks, repeated rows and ids, a long text, columns with clashing names."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"p{k}" for k in range(15))
ROWS = [
    (1, f"a b c {PASSAGE} d e", "en", "s1", 1),
    (2, f"x y {PASSAGE} z", "en", "s1", 2),
    (3, None, None, None, None),
    (4, "", "en", "s2", 0),
    (5, " \t\n ", "en", "s2", 3),
    (6, f"a b c {PASSAGE} d e", "en", "s1", 1),
    (6, f"a b c {PASSAGE} d e", "en", "s1", 1),
    (6, f"q {PASSAGE} r", "fr", "s1", 7),
    (None, f"x y {PASSAGE} z", "en", "s3", 2),
    (None, "alone", "en", None, 5),
    (9, "word " * 20_000 + PASSAGE, "en", "s3", 9),
    (10, "été naïve 😀 " * 30, "fr", "s2", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())
