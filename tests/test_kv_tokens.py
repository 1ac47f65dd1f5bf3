"""The token parser against plain Python, on odd white space and colons."""

import re

from fieldeval.functions import parse
from fieldeval.functions.base import SPACE_CHARS

TEXTS = [
    "A: 1\x1c2 B:\t\tC: x::\u3000y D:e F:",
    " : lone A:B: z\u2009\u2009 A:B:\xa0last ",
    "no key", "", "\n\t ", "A:", "A: B: C: 1", "x" * 5000 + ": v w" + "\r\n" * 3 + ":k v",
]


def plain(text: str) -> dict[str, str]:
    found, words = {}, [w for w in re.split(f"[{SPACE_CHARS}]+", text) if w]
    at = [i for i, w in enumerate(words) if w.endswith(":")]
    for i, end in zip(at, at[1:] + [len(words)]):
        if i < len(words) - 1:
            found[words[i][:-1]] = " ".join(words[i + 1 : end]) or "N/A"
    return found


def test_tokens_as_plain_python(spark, folder):
    spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "n int, t string").write.parquet(f"{folder}/t")
    rows = spark.read.parquet(f"{folder}/t").select("n", parse.parse_kv_tokens("t").alias("m")).collect()
    assert {r["n"]: r["m"] for r in rows} == {n: plain(t) for n, t in enumerate(TEXTS)}
