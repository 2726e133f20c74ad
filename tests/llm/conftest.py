import random
import re

import pytest

#: Columns whose names clash with what operators use inside.
CLASHING = ("root", "slot", "batch", "keep", "score", "size", "rank", "digests", "__range", "due", "cell", "spans", "trusted", "blob")


def words(text):
    """Words by a regular expression, for comparison with the library's."""
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rnd, n, stem="w"):
    return " ".join(f"{stem}{rnd.randrange(400)}" for _ in range(n))


def make_documents():
    """Rows ``(doc_id, text, lang, source, n_chars)`` with copies, near copies, shared and leaked passages, toxic texts, junk, and rows that are odd in every way."""
    rnd = random.Random(7)
    passage, leak = prose(rnd, 60, "p"), prose(rnd, 24, "b")
    texts = [prose(rnd, rnd.randrange(20, 160)) for _ in range(60)]
    texts += [texts[0]] * 3 + [texts[1] + " more"]
    near = texts[2].split()
    near[5] = "changed"
    texts += [" ".join(near), texts[2]]
    texts += [f"{prose(rnd, 30)} {passage} {prose(rnd, 30)}" for _ in range(3)]
    texts += [f"{prose(rnd, 20)} {leak} {prose(rnd, 20)}"]
    changed = leak.split()
    changed[4] = changed[15] = "zz"
    texts += [f"{prose(rnd, 20)} {' '.join(changed)} {prose(rnd, 20)}"]
    texts += [None, "", "   \n\t ", "one", "two words", "!!! ???", prose(rnd, 9000), "Line one is here and it is long enough to be an anchor, more than sixty-four.\n\nsame\nsame\n", "Line one is here and it is long enough to be an anchor, more than sixty-four.\nsame\nother line\n", "É".join("àéîõü") * 3, "a\x00b nul"]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], "en", "s0", 5), (None, None, None, None, None), (1000, texts[5], None, None, None)]
    return rows, leak


@pytest.fixture(scope="session")
def rows():
    return make_documents()[0]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of small tables; ``documents`` has extra columns with clashing names."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("tables"))
    rows, leak = make_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(1) for c in CLASHING}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, leak), (1, "one"), (2, None), (3, ""), (None, "never seen anywhere else at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1 if k % 5 else 0, 0) for k in range(0, 60, 2)] + [(None, 1, 0), (4, None, 0), (6, 1, None), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    page = "<html><head><title>t</title></head><body><nav><li>home</li></nav><article><h1>Head</h1><p>" + "word " * 30 + "</p><p>" + "more " * 20 + "</p></article><footer>x</footer></body></html>"
    spark.createDataFrame([(0, "u", page), (0, "u", page), (1, None, None), (2, "u", ""), (None, "u", "<p>only &amp; one line</p>"), (3, "u", "<script>never closed " + "x" * 5000)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    talk = [(0, 1, "assistant", "sure"), (0, 0, "user", "look: ![image: a.png] and ![audio: b.wav 2.5] <|end|>"), (0, 2, "user", '[{"type": "document", "ref": "c.pdf", "size": 3}, {"type": "text", "text": "x"}, {"type": "odd"}]'), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 0, "user", "[not json"), (2, 0, "Sys Tem", "word " * 5000)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture
def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
