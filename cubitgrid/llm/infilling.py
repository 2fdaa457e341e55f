"""Fill-in-the-middle examples, cut by a matcher that keeps no list of units."""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.common import map_batches

#: A unit is a run of letters of the basic alphabet or any other single character, so units tile every text.
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def count_units(text: str) -> int:
    """First pass: only the number is kept."""
    return sum(1 for _ in UNIT.finditer(text))


def ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first `low` and the first `high` units end; one lazy iterator stops at both."""
    units, out, at = UNIT.finditer(text), 0, 0
    places = []
    for rank in (low, high):
        if rank > at:
            out = next(islice(units, rank - at - 1, None)).end()
            at = rank
        places.append(out)
    return places[0], places[1]


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that an id decides; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def example(doc_id: int | None, text: str, seed: int, plain_from: int, spm_below: int) -> tuple:
    """(number of units, form, characters of the prefix and of the middle, output)."""
    h1, h2, h3, h4 = numbers(doc_id, seed)
    n = count_units(text)
    if not text or h3 % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def examples(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each whole text as a fill-in-the-middle example.

    Of 100 texts those from plain_from on stay plain, and of the rest spm_below have the suffix first. Empty and null
    texts, and those that hold a mark of their own, are plain as well, so that every output can be read back. The id
    decides the cuts: rows that repeat an id and a text have equal examples; rows without an id share the numbers of
    the empty id. One row for each input row; other columns don't matter, and an empty table gives none. A text of any
    length is matched twice and never held as units.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, text = batch.column("doc_id"), batch.column("text")
        got = [example(i.as_py(), t.as_py() or "", seed, plain_from, spm_below) for i, t in zip(ids, text, strict=True)]
        n, form, prefix, middle, output = zip(*got, strict=True)
        columns = [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
        return pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made from. Each mark stands once in an output that isn't plain, and none of them can
    arise where a mark meets a text."""
    before, after = lambda c, mark: F.substring_index(c, mark, 1), lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), after(output, MIDDLE), after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """examples() with digests of the output and of the text read back from it, in place of the output."""
    back = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), back.alias("restored_sha256"))
