import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The shared folder of these tests, where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield


CLASHES = ["id", "th", "size", "hash", "_cut", "_source", "_gone", "_bits", "_key", "n_lines", "n_deleted", "score", "lang_pred", "n_tokens", "class", "_turn",
           "n_found", "keep_id", "mix_size"]


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows): rows are (doc_id, text, lang, source); with extra columns whose names the operators use themselves."""
    def build(rows, clashes=True):
        ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        data = [(*r, None if r[1] is None else len(r[1])) for r in rows]
        if clashes:
            ddl += "".join(f", `{c}` string" for c in CLASHES)
            data = [(*r, *["x"] * len(CLASHES)) for r in data]
        return spark.createDataFrame(data, ddl)
    return build


LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(60_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, LONG, "en", "b"), (5, LONG, None, None),
    (6, "Same text here, with more than five words in it.", "en", "a"), (6, "Same text here, with more than five words in it.", "en", "a"),
    (7, "SAME text here, with more than five words in it.", "de", "b"), (None, "Same text here, with more than five words in it.", "en", "a"),
    (None, None, None, "a"), (8, "one two", "fr", "é"), (9, "One  TWO", "fr", "é"), (10, "日本語 и русский 🙂", "ja", "c"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
