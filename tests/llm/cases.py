"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, key long, n long, ids string"
EMPTY = []


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["the", "on", "er", "an", "re", "tion", "é", "ñ", "ß", "st", "ing", "ha"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


TEXTS = [
    None,
    "",
    " ",
    "one",
    "a b c",
    "Hello, WORLD! it's the year 2024 — don't\tpanic\r\n\n  x",
    "'''s ''s    z ²½ Ⅷ ١٢٣ ab́c \x1c\x1f end",
    "日本語のテキスト 😀👩‍👩‍👧 <|endoftext|>",
    "a" * 5000,
    "ab" * 3000 + "!" * 700 + " " * 900 + "z",
    prose(1, 400),
    prose(1, 400),
    prose(2, 30000),
    "Released under the MIT License. mit, license; MIT\nLICENSE and the GNU General Public License",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nmit licensex",
]
ROWS = [(7 * i % 16, t, "en", "src0", 3, 5, 9, 1, "x") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[10], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def table(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
