"""Inputs made to break operators: hostile parts, endless words, unclosed markup, hot seeds, ties."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import chat, decontam, html_text, mixing, tokens, wordpiece


def test_no_part_breaks_a_conversation(spark):
    texts = [
        "![audio: x 99999999999999999999999] and ![document: y 1000000001]",
        '[{"type": "text", "text": "\\ud800 a"}, {"type": "image", "ref": "\\udfff"}]',
        '[{"type": "audio", "ref": "r", "size": 1e308}, {"type": "document", "ref": "r", "size": ' + "9" * 400 + "}]",
        '[{"type": "audio", "ref": "r", "size": NaN}, {"type": "audio", "ref": "r", "size": -1}]',
        '[ {"type": "odd", "b": 1,  "a": [2]} , {"type": "text", "text": "x"} ]',
        '[{"type": 1}]', "[", "[]", "[1,]", '[{"type": "text", "text": "x"}] tail', "[" * 5000, '[{"type": "text"}, {"type": "image", "ref": ""}]',
    ]
    rows = chat.formatted(spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()
    inside = {r.conv_id: r.text.removeprefix("<|user|>\n").removesuffix("<|end|>\n") for r in rows}
    assert inside[0] == texts[0] and inside[1] == "\ufffd a<|image:0|>"
    assert inside[2] == texts[2][1:-1].replace("}, {", "}{") and inside[3] == texts[3][1:-1].replace("}, {", "}{")
    assert inside[4] == '{"type": "odd", "b": 1,  "a": [2]}x'
    assert [inside[k] for k in (5, 6, 7, 8, 9, 10)] == [texts[k] for k in (5, 6, 7, 8, 9, 10)] and inside[11] == texts[11][1:-1].replace("}, {", "}{")


def test_a_word_without_end_is_counted_in_no_time():
    rnd = random.Random(4)
    pieces = [bytes([b]) for b in range(256) if b != 33] + [b"ab", b"abc", b"cab", b" a", b"bbbb"]
    automaton = wordpiece.Automaton(pieces)
    words = [bytes(rnd.choices(b"abc", k=n)) for n in (255, 256, 257, 3000)] + [b"a" * 300 + b"!", b"!" * 400, b"x"]
    texts = pa.array([w.decode() for w in words])
    _, counts = wordpiece.text_counts(automaton, texts)
    assert counts.tolist() == [wordpiece.brute_count(b" " + w, set(pieces)) for w in words]
    began = time.perf_counter()
    assert wordpiece.text_counts(automaton, pa.array(["ab" * 500_000]))[1].tolist() == [500_001]
    assert time.perf_counter() - began < 3


def test_unclosed_markup_is_handled_in_linear_time():
    for page in ("<a" * 400_000, "<!" * 400_000, "<?" * 400_000, "</" * 400_000, "<script" * 100_000, "<pre>" * 100_000, "<!--" * 200_000, "&" * 500_000, "<" * 500_000, "<head>" * 100_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 5, page[:8]
    assert html_text.main_text("<html><head><title>t</title><body><p>the text of the page</p>") == "the text of the page"
    assert html_text.main_text("<p>what is shown</p> a < b <!-- never closed > shown") == html_text.main_text("<p>what is shown</p> a < b")
    assert "1 < 2" in html_text.main_text("<p>so 1 < 2")
    menu = "<div>Home</div><div>About us</div>"
    for article in ("word " * 800, "word " * 60):
        assert html_text.main_text(f"<nav>{menu}</nav>\n<article>\n<p>{article}</p>\n</article>") == article.strip()


def test_hot_seeds_are_laid_side_by_side():
    items = [(k, "same " * 60) for k in range(20)]
    index = decontam.Index(items)
    began = time.perf_counter()
    found = index.overlaps(tokens.words(pa.array(["same " * 2000, "same " * 11, "other words"])))
    assert time.perf_counter() - began < 5
    assert found == [(0, k, 0, 60, 60) for k in range(20)]


def brute_overlaps(doc, item, matched=decontam.MATCHED, share=decontam.SHARE, penalty=decontam.PENALTY):
    """``(start, words, matched)`` of the best stretch of all diagonals, or None."""
    least, best = min(matched, max(1, -(-len(item) * share // 1))), None
    for shift in range(-len(item) + 1, len(doc)):
        begin, end = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(begin, end)]
        value, most, stop = 0, 0, 0
        sums = [0]
        for s in same:
            sums.append(sums[-1] + (1 if s else -penalty))
        low = 0
        for k, x in enumerate(sums):
            low = min(low, x)
            value = x - low
            if value > most:
                most, stop = value, k
        start = min(range(stop + 1), key=lambda k: (sums[k], k))
        n = sum(same[start:stop])
        if n >= least and (best is None or (n, -(begin + shift + start)) > (best[2], -best[0])):
            best = (begin + shift + start, stop - start, n)
    return best


def test_places_of_overlaps_equal_brute_force(monkeypatch):
    monkeypatch.setattr(decontam, "CELLS", 50)  # many parts
    rnd = random.Random(9)
    for _ in range(12):
        item = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(14, 40))]
        docs = []
        for _ in range(6):
            copy = [w if rnd.random() > 0.1 else "x" for w in item]
            docs.append([rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 20))] + copy + [rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 20))])
        found = {d: (start, n, m) for d, _, start, n, m in decontam.Index([(0, " ".join(item))]).overlaps(tokens.words(pa.array([" ".join(d) for d in docs])))}
        for k, doc in enumerate(docs):
            want = brute_overlaps(doc, item)
            # a seed need not hit the diagonal of the best overlap; one that is reported is the best of those that are hit
            assert k not in found or want is not None and found[k][2] <= want[2]
        assert sum(found.get(k) == brute_overlaps(doc, item) for k, doc in enumerate(docs)) >= 4


def test_drawn_documents_are_those_that_are_drawn(spark):
    rnd = random.Random(6)
    rows = [(k // 3 if k % 5 == 0 else k, f"text {k}", f"s{k % 4}" if k % 7 else None, rnd.choice([None, 0, 4, 100, 10_000]), k) for k in range(300)]
    rows += [(None, "x", "s1", 50, 1), (7, "same", "s1", 100, 2), (7, "same", "s1", 100, 2)]
    for share in (0.3, 1.0, 2.5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, copies long").withColumn("odds", F.lit(1)).repartition(3)
        want = Counter((r.doc_id, r.source, r.copies) for r in mixing.mixed(docs, share=share).collect())
        out = mixing.drawn_documents(docs, share=share)
        assert out.columns == ["doc_id", "text", "source", "n_chars", "odds", "copies"]
        assert Counter((r.doc_id, r.source, r.copies) for r in out.collect()) == want
    many = spark.createDataFrame([(1, f"t{k}", "s", 100) for k in range(10)], "doc_id long, text string, source string, n_chars long")
    assert sum(r.copies for r in mixing.drawn_documents(many, share=0.55).collect()) == 5
    assert np.isfinite(mixing.SHARE)
