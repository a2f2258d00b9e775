import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, near copies."""
    words = [f"wört{i * 7919 % 611}" for i in range(900)]
    near = words[:300]
    near[150] = "changed"
    texts = [
        " ".join(words[:300]), " ".join(near), " ".join(words[:300]).upper().replace("WÖRT", "Wört"), " ".join(words[200:260] + words[500:560]),
        None, "", " \n\t", "short one", "short one", "a\n\na\nb#\n", "x" * 5000, ("lorem ipsum " * 3000), " ".join(words[500:560]) + "\n" + " ".join(words[500:560]), "▁ mark ￿ 漢字 \x00 end",
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "null id text", None, None, None), (7, "short one", None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i != 9), int(i in (3, 12))) for i in range(14)] + [(None, 1, 0), (5, None, None), (3, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
