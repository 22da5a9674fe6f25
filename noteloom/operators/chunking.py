"""Cutting long texts to chunks, and reducing chunks to one summary with an injected function."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import trim_summary

MOST, OVERLAP, FINAL = 8000, 200, 2000
PARAGRAPH, SENTENCE, JOINT = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+"), "\n\n"


def _between(separator: re.Pattern, text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Spans of ``text[start:stop]`` that the separator parts."""
    for found in separator.finditer(text, start, stop):
        yield start, found.start()
        start = found.end()
    yield start, stop


def _spans(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``most`` characters: paragraphs that aren't blank; of longer ones the sentences; of longer ones plain cuts."""
    for a, b in _between(PARAGRAPH, text, 0, len(text)):
        if b - a <= most:
            if not text[a:b].isspace() and a < b:
                yield a, b
            continue
        for c, d in _between(SENTENCE, text, a, b):
            yield from ((x, min(x + most, d)) for x in range(c, max(d, c + 1), most))


def chunk(text: str | None, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most ``most`` characters, each filled with as many spans as fit, joined by a
    blank line; before a further chunk stands the tail of the one before it."""
    if not text or len(text) <= most:
        return [text] if text else []
    tail = overlap if overlap < most else most // 4
    spans = list(_spans(text, most))
    ends = list(accumulate(b - a + len(JOINT) for a, b in spans))  # where each would end if all were joined
    out, first = [], 0
    while first < len(spans):
        room = (ends[first - 1] if first else 0) + most + len(JOINT)
        last = max(first + 1, bisect_right(ends, room))
        out.append(JOINT.join(text[a:b] for a, b in spans[first:last]))
        first = last
    return [x if not (i and tail) else out[i - 1][-tail:] + JOINT + x for i, x in enumerate(out)]


def chunks(rows: DataFrame, key: str, text: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, n, chunk) of every row, numbered from 0; packing is sequential within one text only."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                owner, nth, out = [], [], []
                for k, value in enumerate(part.column(1).to_pylist()):
                    got = chunk(value, most, overlap)
                    owner += [k] * len(got)
                    nth += range(len(got))
                    out += got
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int32())), pa.array(nth, pa.int32()), pa.array(out, pa.string())], [key, "n", "chunk"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, n int, chunk string")


def first_paragraph(text: F.Column, most: int = 300) -> F.Column:
    """The summary when no model answers."""
    return F.trim(F.substring(F.split(text, r"\n\s*\n")[0], 1, most))


def reduce_texts(rows: DataFrame, key: str, text: str, summarise: Callable = first_paragraph, most: int = MOST, rounds: int = 3) -> DataFrame:
    """(key, summary): chunk, summarise (a column function), join in order, at most ``rounds`` times
    more while too long; cut to ``FINAL`` characters. Only texts still too long go on."""
    now, done = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")), []
    overlap = OVERLAP
    for nth in range(rounds + 1):
        short = summarise(F.col("chunk"))
        part = chunks(now, key, "text", most, overlap).select(key, "n", trim_summary(short).alias("s")).where("trim(s) <> ''")
        joined = part.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n\n").alias("text"))
        if nth == rounds:
            done.append(joined)
        else:
            done.append(joined.where(F.length("text") <= most))
            now, overlap = joined.where(F.length("text") > most), 100
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return rows.select(key).join(out, key, "left").select(key, trim_summary(F.coalesce("text", F.lit("")), FINAL).alias("summary"))
