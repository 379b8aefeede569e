"""A small table with every awkward kind of row, and columns whose names an operator might use itself."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, name int, n int, `a.b` int"
BASE = "One two three four five six seven eight nine ten eleven twelve thirteen. "


def document_rows():
    rows = [
        (1, BASE, "en", "s1"),
        (2, BASE.upper(), "en", "s1"),
        (3, BASE, None, None),
        (3, BASE, None, None),  # the same row again
        (4, None, "en", "s2"),
        (5, "", "en", "s2"),
        (6, "   \n\t ", "de", "s2"),
        (None, BASE + "more", "en", "s3"),
        (None, None, None, None),
        (7, "ÄÖ É été " * 4, "fr", "s3"),
        (8, "word " * 40_000, "en", "s1"),
        (9, "".join(f"w{i} " for i in range(60_000)), "en", "s1"),
        (10, "x", "en", "s3"),
    ]
    return [(i, t, lang, s, len(t or ""), "r", "k", 1, 2, 3) for i, t, lang, s in rows]
