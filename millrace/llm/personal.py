"""Personal information inside free text (problem 8).

Method: a character-level bidirectional LSTM with CRF transitions (tagger.py),
trained in numpy from labelled spans (train_personal.py), tags every sign of every
page in overlapping windows; in an overlap the scores of both windows are merged,
and the best path over each whole page gives the tags. Spans are read off the tags.
A span keeps to whole words, and surrounding punctuation is trimmed; nothing else
changes, adds or drops what the tagger found.

Defined results: null, empty and blank texts have no spans; null doc_ids are
kept in redaction and left out of findings; offsets count characters of the text as given;
spans don't overlap; a text of any length is done as a whole, window by window.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import pages
from millrace.llm.tagger import Tagger
from millrace.session import partitions_for, ship

WEIGHTS = Path(__file__).with_name("personal_weights.npz")
#: Characters of text that are tagged together.
CHUNK = 2_000_000

#: The kinds, in the order of the tagger's tags from 1.
KINDS = ("email", "phone", "id_number", "street", "name")
#: What the tagger sees before and behind a text.
BEFORE, BEHIND = ". ", " "
#: Bytes of Parquet that a task tags.
TASK_BYTES = 4 << 20
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street": "[STREET]", "name": "[NAME]"}
STREET, NAME = KINDS.index("street") + 1, KINDS.index("name") + 1


@lru_cache(maxsize=2)
def _tagger(weights: bytes) -> Tagger:
    return Tagger.load(io.BytesIO(weights))


def _word(view: str, at: int) -> tuple[int, int]:
    """The letters and digits around a sign."""
    a, b = at, at + 1
    while a > 0 and view[a - 1].isalnum():
        a -= 1
    while b < len(view) and view[b].isalnum():
        b += 1
    return a, b


def settle(view: str, a: int, b: int, kind: int) -> tuple[int, int] | None:
    """A tagged stretch with whole words at its ends (those that it covers at least half) and without punctuation around it; None if nothing is left."""
    while a < b and not view[a].isalnum():
        a += 1
    tagged_end = b
    while b > a and not view[b - 1].isalnum():
        b -= 1
    if a == b:
        return None
    x, y = _word(view, a)
    a = x if 2 * (min(y, b) - a) >= y - x else y
    x, y = _word(view, b - 1)
    b = y if 2 * (b - max(x, a)) >= y - x else x
    while a < b and not view[a].isalnum():
        a += 1
    while b > a and not view[b - 1].isalnum():
        b -= 1
    if a >= b:
        return None
    last = b - _word(view, b - 1)[0]
    if view[b : b + 1] == "." and ((kind == NAME and last == 1) or (kind == STREET and last <= 4 and tagged_end > b)):
        b += 1  # the point of an initial or abbreviation
    if view[a - 1 : a] in ("(", "+") and ")" in view[a:b] or view[a - 1 : a] == "+":
        a -= 1  # a code's bracket or sign
    return a, b


def _merged(tags: np.ndarray, view: str) -> list[tuple[int, int, int]]:
    """Stretches of one kind; those with only a join sign between them are one."""
    out: list[tuple[int, int, int]] = []
    for a, b, kind in pages.runs(tags).tolist():
        if out and out[-1][2] == kind and (a == out[-1][1] or (a - out[-1][1] == 1 and view[out[-1][1]] in " -'’")):
            out[-1] = (out[-1][0], b, kind)
        else:
            out.append((a, b, kind))
    return out


def spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind number) in each text, in order."""
    views = [pages.clean(t) for t in texts]
    if not any(len(v) for v, _ in views):
        return [[] for _ in texts]
    # a text begins and ends as a sentence does, and not as a window inside of a page
    whole = "\0".join(f"{BEFORE}{v}{BEHIND}" for v, _ in views)
    lengths = np.array([len(BEFORE) + len(v) + len(BEHIND) for v, _ in views])
    starts = np.cumsum(lengths + 1) - lengths - 1
    tags = pages.tag(tagger, pages.points(whole), np.stack([starts, starts + lengths], 1))
    out = []
    for at, (view, offsets) in zip((starts + len(BEFORE)).tolist(), views, strict=True):
        kept: list[tuple[int, int, int]] = []
        for a, b, kind in _merged(tags[at : at + len(view)], view):
            found = settle(view, a, b, kind)
            if found and not (kept and found[0] < kept[-1][1]):
                kept.append((*found, kind))
        out.append([(int(offsets[a]), int(offsets[b - 1]) + 1, kind) for a, b, kind in kept])
    return out


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], PLACEHOLDERS[KINDS[kind - 1]]]
        at = b
    return "".join([*parts, text[at:]])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _runner(weights, redacting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(weights.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                found = spans(tagger, [t or "" for t in texts[a:b]])
                if redacting:
                    new = [t if t is None else redact(t, f) for t, f in zip(texts[a:b], found, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(new, pa.string())], names=["doc_id", "text"])
                else:
                    rows = [(i, KINDS[k - 1], s, e) for i, f in zip(ids.slice(a, b - a).to_pylist(), found, strict=True) for s, e, k in f]
                    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                    types = (pa.int64(), pa.string(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "kind", "start_pos", "end_pos"])

    return run


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly: tagging costs far more than moving the texts, and files may have few parts or uneven ones."""
    count = partitions_for(rows, TASK_BYTES)
    dealt = rows.withColumn("_at", F.monotonically_increasing_id())
    return dealt.repartition(count, "_at").drop("_at")


def _weights(spark, path: str | Path | None):
    with open(path or WEIGHTS, "rb") as file:
        return spark.sparkContext.broadcast(file.read())  # some hundred KB, fixed by the model


def find_personal(documents: DataFrame, weights: str | Path | None = None) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of each occurrence in (doc_id, text)."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.filter("doc_id is not null and text is not null").selectExpr("cast(doc_id as long) as doc_id", "text")
    return _spread(rows).mapInArrow(_runner(_weights(spark, weights), False), "doc_id long, kind string, start_pos int, end_pos int")


def redact_personal(documents: DataFrame, weights: str | Path | None = None) -> DataFrame:
    """(doc_id, text) with a placeholder of its kind for each occurrence."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    return _spread(rows).mapInArrow(_runner(_weights(spark, weights), True), "doc_id long, text string")
