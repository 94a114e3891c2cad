import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long, part string, chunk long, place long, rank int, size string, lang_pred string, score string, xd_row string, mix_place string, words int, leaf string"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
NEAR = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 4


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, 1, "k", 2, "p", 3, 4, 5, "s", "x", "y", "z", "m", 6, "l")


EDGE = [
    row(1, NEAR), row(1, NEAR), row(2, NEAR + " 21"), row(3, None), row(4, ""), row(5, " \n\t\x0b "), row(6, "Deux mots"), row(7, "deux MOTS"), row(8, "a b c d e"), row(None, "a  b\tc d e"), row(None, None), row(9, LONG, None, None),
    row(10, LONG + " tail"), row(11, "12345 !!! ###", "de", "b"), row(12, "a b c d e", None, "b"), row(1, "another text with the same id"), row(13, "x\n\nx\nx\n" * 3), row(14, "É è ñ \x01 ￿ \U0001f600"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, KINDS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
