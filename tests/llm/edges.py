"""Documents with what every operator must bear: nulls, empty and very long texts, ties, repeats, clashing extra columns."""

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, idx long, row_no long, sig string, n long"


def documents(spark, rows):
    """rows of (doc_id, text); the extra columns clash with names that operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, 1.0, 7, None, 3, "x", 9) for i, t in rows], EXTRA)


def words(n, seed=0):
    """n invented words."""
    out, x = [], seed * 2654435761 + 12345
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("".join("aeioutnsrlhd"[(x >> (8 + 4 * k)) % 12] for k in range(2 + (x >> 40) % 6)))
    return out


def sentences(n, seed=0):
    w = words(n, seed)
    return ".\n".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


EDGES = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "Repeated row here, the same."), (5, "Repeated row here, the same."), (6, "Repeated row here, the same."), (7, "x" * 200_000), (8, sentences(30_000, 3)), (None, "no id"), (9, "Ünïcödé – ‍ 日本語 🙂 \x00 ▁▁ <|endoftext|> İstanbul")]
