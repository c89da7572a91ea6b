"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _text string, _id int, slot int, score string, kept int, _gone int, _source string"

_LONG = " ".join(f"word{k % 977}x{k}" for k in range(40_000))


def texts() -> list[tuple]:
    base = "the quick brown fox jumps over the lazy dog and runs. " * 3 + "Then it sleeps under a tree near the old river bank, quite alone. It wakes at dawn. "
    return [
        (1, base + "One more thing."),
        (2, base + "One more thing."),
        (3, base.replace("fox", "cat", 1) + "One more thing."),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, _LONG),
        (8, _LONG),
        (9, "short"),
        (10, "Short"),
        (11, "a b c"),
        (12, base.upper()),
        (13, "é" * 900 + "\n" + "ß" * 10),
        (14, "MIT License and the Apache License, or the GNU General Public License"),
        (14, "MIT License and the Apache License, or the GNU General Public License"),
        (None, "no id here at all, just a text of some words"),
        (None, None),
        (15, "x y\nz"),
        (15, "another text under the same id"),
        (16, "xy z"),
    ]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", None, "x", "y", 1, 2, "z", 3, 4, "w") for i, t in rows], COLUMNS)
