"""Tables shared by the tests: the driver's smallest documents and hand-made edge cases."""

SF = "/root/testdata/sf0.001"

EDGE_TEXTS = [None, "", " \t\n ", "one", "a b c d", "a b c d e", "é ñ 日本語 😀 word",
              "the same three words the same three words " * 12,
              "line one\nline two\nline one\n\n \n", "\x00\x1f|<>#*$%&", "word " * 60,
              "long " + " ".join(f"w{i}" for i in range(20_000)), "x" * 50_000,
              "a" + " " * 100_000 + "b"]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def edge_documents(spark):
    """Edge texts twice, a null id, and columns whose names clash with computed ones."""
    rows = [(100_000 + i, t, "src", len(t or ""), "n", i, i % 2 == 0)
            for i, t in enumerate(EDGE_TEXTS)]
    rows += rows[:6] + [(None, "null id with some words here", "src", 3, "n", 1, True)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, n_chars long, s string, n_hit long, "
              "kept boolean")


def rows_of(df):
    return [r.asDict() for r in df.collect()]
