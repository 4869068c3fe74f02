"""Rows that every operator must take."""

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, "
        "print long, mark long, cell string, row long, kind string")


def docs(spark, texts, langs=None, sources=None, first=0):
    """A documents table with extra columns whose names the operators use inside."""
    rows = [(first + i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), None if t is None else len(t),
             9.5, -7, -7, -7, "cell", -7, "kind") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    long = " ".join(f"word{i % 977} thing{i % 31}" for i in range(60_000))
    return [None, "", "   \n\t ", "One.", "the same text again", "the same text again", "\u00e9\u00e8 \U0001f600 12 \n\n 34",
            long, "|".join("ab" * 40 for _ in range(300)), "x" * 5000, "\x01 \x02 <|endoftext|>"]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}
