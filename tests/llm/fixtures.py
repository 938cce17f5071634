"""Small documents with every awkward case: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, size string, shard int, `_h` string, row string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents() -> list[tuple]:
    base, shared = words(1, 300), words(2, 60)
    changed = base.split()
    changed[150] = "changed"
    lines = [words(100 + k, 25) for k in range(12)]
    near = lines[3].split()
    near[7] = "other"
    texts = [
        base, base.upper(), " ".join(changed), base, None, "", " \n\t\n ", "one", "two words", "Ünïcode ß ÄÖ " * 20, shared + "\n" + words(3, 80),
        words(4, 90) + "\n" + shared, words(5, 70) + " " + shared + " " + words(6, 70), "\n".join(lines), "\n".join([" ".join(near), *lines[5:8], words(7, 30)]),
        "\n".join(["same line of text here, twice"] * 6), words(8, 9000), "ab " * 400, "<|endoftext|> mid <|endoftext|>", lines[3], "#### $$$$ %%%% " * 60,
        "x" * 3000, words(9, 120), words(9, 120),
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("src1", "src2", None, "src0")[i % 4], len(t or ""), -i, "s", 9, "h", "r") for i, t in enumerate(texts)]
    rows.append((None, words(10, 60), None, None, 0, 0, None, None, None, None))
    rows.append(rows[10])  # a row that repeats entirely
    return rows
