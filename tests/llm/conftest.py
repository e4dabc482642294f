import pandas as pd
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, n long, w string, b int, ids string, size long, spans string, kept string, score double, h string, tox_score string"


def documents(rows):
    """(doc_id, text, source) with columns whose names the operators use inside."""
    return [(i, t, "en", s, None if t is None else len(t), "k", "f", 1, "w", 2, "1,2", 3, "s", "x", 0.5, "h", "z") for i, t, s in rows]


PASSAGE = "".join(f"word{i} of a passage that is shared " for i in range(20))
NASTY = [
    (None, None, None), (None, "no id at all", "src1"), (1, "", "src1"), (2, " ", "src1"), (3, "a", "src2"), (4, None, "src2"),
    (5, "the same text twice over here", "src1"), (5, "the same text twice over here", "src1"), (5, "another text under the same id", "src3"),
    (-7, "été 日本語 😀👍🏽 \x01\x02 x\ty z　q \x85 'S it's we'll", None), (1 << 62, "you idiot, YOU IDIOT!!! go away", "src1"),
    (8, "word " * 20_000, "src1"), (9, "x" * 3000, "src2"), (10, "start one " + PASSAGE + " end one", "src1"), (11, "begin two " + PASSAGE + " finish two", "src1"),
    (12, PASSAGE, "src2"), (13, "Start One " + PASSAGE + " END one", "src1"), (100, "a perfectly plain sentence about bees and gardens", "src2"),
]


@pytest.fixture(scope="session")
def nasty(spark, tmp_path_factory):
    """A folder of small tables that hold every awkward case."""
    d = str(tmp_path_factory.mktemp("nasty"))
    spark.createDataFrame(documents(NASTY), DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, t) for i, t in [(1 << 62, 1), (100, 0), (5, 0), (None, 1), (10, None), (11, 0), (11, 1), (999, 1)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.5, -0.25]), (100, [0.5, 0.5, 0.5]), (200, []), (300, None), (1, [1.0, None]), (2, [nan]), (3, [inf]), (4, [1.0, 0.5, -0.25]), (4, [1.0, 0.5, -0.25]), (5, [0.0, 0.0, 0.0]), (6, [2.0]), (None, [1.0])]
    spark.createDataFrame([(i, v, 1, "q") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string").write.parquet(f"{d}/embeddings.parquet")
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<html><body><article><p>A &amp; B<p>C <b>d</b></article><footer>f</footer></body></html>"), (3, "u", "<article><p>cut off &am"), (4, "u", "<<<>>> <!-- x"), (5, "u", "<article>" + "<div>" * 3000 + "deep text here."), (6, "u", "<article><p>" + "long text. " * 20000)]
    spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string").write.parquet(f"{d}/pages.parquet")
    chats = [(1, 0, "system", "be brief"), (1, 1, "user", "hi \"q\" é\n"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "yes"), (2, 0, "user", None), (2, 5, "assistant", "lost"), (None, 0, "user", "x"), (3, None, "user", "y"), (4, 0, None, "z"), (5, 0, "user", ""), (6, 0, "user", "one"), (6, 0, "user", "two")]
    spark.createDataFrame([(*c, 1) for c in chats], "conv_id long, turn long, role string, text string, level int").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, nasty, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{nasty}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="session")
def texts():
    return pd.DataFrame(NASTY, columns=["doc_id", "text", "source"])
