import pathlib
import random
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use themselves.
    "id long, mark string, kept long, print string, node string, spans string, ids string, label string, n long"
)
EXTRA = (7, "m", 1, "p", "x", "s", "i", "l", 3)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["ba", "du", "kel", "mi", "no", "ra", "sto", "tu", "ve", "zi", "é", "ß"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Rows with NULLs, empty and long texts, copies, repeated ids and planted cases."""
    passage, line = prose(1, 80), prose(2, 30)
    long = prose(3, 20_000)
    texts = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "Two words"), (None, prose(4, 60)), (None, None),
        (5, prose(5, 120)), (6, prose(5, 120)), (7, prose(5, 120) + " tail"), (7, prose(6, 50)), (7, prose(6, 50)),
        (8, long), (9, long[:50_000] + " x " + passage), (10, prose(7, 40) + "\n" + passage + "\n" + prose(8, 40)),
        (11, passage + "\r\n" + passage), (12, "\n".join([line] * 5)), (13, "ab " * 300), (14, "a" * 3000),
        (15, "中文" * 400), (16, "12 !! ?? --"), (17, "x\x00y \U0001f600 " * 30),
        (18, "mail a.b@c.de now, 1.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111, +1 (555) 123-4567."),
        (19, "no card 4111 1111 1111 1112; @ a@b c@d.e@f.g +1 2 1.2.3.4.5.6.7.8"),
        (20, "# a | b | c * $ % & < >\n# a | b | c * $ % & < >\n" + prose(9, 30)),
    ]
    langs = [None, "xx", "yy"]
    return [(i, t, langs[n % 3], "s", None if t is None else len(t), *EXTRA) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def hard():
    return hard_rows()


@pytest.fixture(scope="session")
def hard_dir(spark, tmp_path_factory, hard):
    """A folder with the hard rows as documents, and a benchmark that one of them holds."""
    folder = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame(hard, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(0, prose(1, 80), 1), (1, prose(99, 60), 1), (2, None, 1), (3, "", 1), (4, "tiny", 1), (0, prose(1, 80), 2)]
    spark.createDataFrame(items, "item_id long, text string, n long").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        f"{folder}/conversations.parquet"
    )
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder
