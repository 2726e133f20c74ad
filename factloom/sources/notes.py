"""Lessons from notes: sections of Markdown or reStructuredText, and what they rule, why, and what they cite."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import because_clauses, cites, prose_of, rule_sentence, topic_of, trimmed

LEAST_BODY = 40
_SKIPPED = ("contents", "overview", "table of contents")
_HASHES = re.compile(r"#{1,4}\s+(.*)")
_RULER = re.compile(r"([!-/:-@\[-`{-~])\1\1+\s*")


def sections(text: str) -> list[tuple[str, str]]:
    """``(title, body)`` of each section; what stands before the first heading is none. A line is a heading if it begins with hashes, or if a ruler about as long lies under it."""
    out: list[tuple[str, list[str]]] = []
    lines = text.splitlines()
    k = 0
    while k < len(lines):
        line, below = lines[k], lines[k + 1] if k + 1 < len(lines) else ""
        if m := _HASHES.fullmatch(line):
            out.append((m[1].strip(), []))
        elif line.strip() and _RULER.fullmatch(below) and len(below.strip()) + 2 >= len(line.strip()):
            out.append((line.strip(), []))
            k += 1
        elif out:
            out[-1][1].append(line)
        k += 1
    return [(title, "\n".join(body)) for title, body in out]


def note_sections(notes: DataFrame) -> DataFrame:
    """``(path, title, body)`` of ``notes (path, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n.path, *s) for n in batch.itertuples(index=False) if n.text is not None for s in sections(n.text)]
            yield pd.DataFrame(rows, columns=["path", "title", "body"])

    return notes.select("path", "text").mapInPandas(run, "path string, title string, body string")


def read_notes(spark: SparkSession, *globs: str) -> DataFrame:
    return spark.read.text(list(globs), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _labelled(predicate: str) -> Column:
    return F.transform(predicate, lambda x: F.struct(F.lit(predicate).alias("predicate"), x.alias("literal")))


def lesson_facts(sections_: DataFrame, repo: str | None = None) -> DataFrame:
    """``lesson``, ``because`` and ``cites`` facts of sections, as literals of the section's topic, all by column expressions."""
    body = F.trim("body")
    usable = sections_.withColumn("topic", topic_of(F.col("title"))).where((F.col("topic") != "") & (F.length(body) >= LEAST_BODY) & ~F.lower("topic").isin(*_SKIPPED))
    told = usable.withColumn("prose", prose_of(F.col("body"))).select(
        "path",
        "topic",
        F.array(rule_sentence(F.col("prose"))).alias("lesson"),
        because_clauses(F.col("prose")).alias("because"),
        cites(F.col("body")).alias("cites"),
    )
    rows = told.select("path", "topic", F.explode(F.concat(*map(_labelled, ("lesson", "because", "cites")))).alias("f")).where("f.literal is not null")
    literal = trimmed(F.col("f.literal"))
    return rows.select(F.lit("lesson-topic").alias("subject_kind"), F.col("topic").alias("subject_name"), F.lit(repo).cast("string").alias("subject_repo"), F.lit(None).cast("string").alias("subject_path"), F.col("f.predicate").alias("predicate"), literal.alias("object_lit"), F.lit(0.9).alias("confidence"), F.lit("det:lesson@1").alias("extractor"), F.concat(F.lit("doc:"), "path").alias("origin"), literal.alias("excerpt"))
