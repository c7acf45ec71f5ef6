import pytest

#: Texts with nulls, empties, ties and repeats; extra columns whose names clash with those the operators use.
SCHEMA = "doc_id long, text string, name string, level int, node long, keep_id string"
#: Names that operators use or have used for columns of their own.
CLASHING = ["row", "id", "digest", "key", "n", "o_id", "o_digest", "o_doc_id", "o_t1", "stays", "t1", "t2", "keep", "copies", "copy", "__k_id", "__k_own", "__d_id", "__m_n", "a.b", "a`b", "label", "score", "item", "rate", "Text 2"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    rows = [
        (1, "Same Text here, twice.", "x", 1, 1, "k"),
        (2, "same text HERE, twice.", None, None, None, None),
        (2, "same text HERE, twice.", None, None, None, None),
        (3, None, "x", 1, 1, "k"),
        (4, "", "x", 1, 1, "k"),
        (5, long_text, "x", 1, 1, "k"),
        (6, long_text + " tail", "x", 1, 1, "k"),
        (7, long_text.upper(), "x", 1, 1, "k"),
        (None, "no id at all", "x", 1, 1, "k"),
        (8, "École ÉCOLE 日本語 \U0001f600 <|endoftext|>", "x", 1, 1, "k"),
        (9, "école ÉCOLE 日本語 \U0001f600 <|endoftext|>", "x", 1, 1, "k"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(spark):
    """Documents with columns of every such name, two of each text, and near copies."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words)), "short one", "short one", None, ""]
    fields = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING)
    rows = [(i, t, *(f"{c} of {i}" for c in CLASHING)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {fields}").repartition(3)
