"""Personal information inside free text: places and typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.pii_model import MODEL, Tagger
from loomtext.llm.pii_text import HIDDEN, plain

#: Characters tagged at once by one task.
BLOCK_CHARS = 600_000


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows, chars = [], 0
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            rows.append(r)
            chars += len(r[1] or "")
            if chars >= BLOCK_CHARS:
                yield rows
                rows, chars = [], 0
    if rows:
        yield rows


def spans_of(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of stored texts, whose every character the network reads; those nobody sees are skipped while tagging."""
    shown, maps = [], []
    every, to = plain("".join(texts)), 0
    for t in texts:
        p, to = every[to : to + len(t)], to + len(t)
        if HIDDEN in p:
            maps.append([i for i, c in enumerate(p) if c != HIDDEN])
            p = p.replace(HIDDEN, "")
        else:
            maps.append(None)
        shown.append(p)
    return [
        s if m is None else [(m[a], m[b - 1] + 1, k) for a, b, k in s]
        for s, m in zip(tagger.find(shown, gated=False), maps)
    ]


def _find(id_type: pa.DataType, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(path)
        for rows in _blocks(batches):
            found = spans_of(tagger, [t or "" for _, t in rows])
            flat = [(k, *s) for (k, _), spans in zip(rows, found) for s in spans]
            ids, start, end, kind = zip(*flat) if flat else ((), (), (), ())
            yield pa.record_batch(
                [pa.array(ids, id_type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string())],
                names=["id", "start_pos", "end_pos", "pii_type"])

    return run


def find_pii(docs: DataFrame, id_col: str, text_col: str, model: str = MODEL) -> DataFrame:
    """(id_col, start_pos, end_pos, pii_type): places in the stored text, half-open.

    Null and empty texts have no places.  Repeated rows count once; rows of one
    id with several texts give the places of each.  Extra columns are ignored.
    Texts of any length are read whole, in overlapping windows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    t = docs.schema[id_col].dataType
    found = docs.select(id_col, text_col).where(F.length(text_col) > 0).mapInArrow(
        _find(to_arrow_type(t), model), f"id {t.simpleString()}, start_pos bigint, end_pos bigint, pii_type string")
    return found.distinct().select(F.col("id").alias(id_col), "start_pos", "end_pos", "pii_type")


def redact(docs: DataFrame, id_col: str, text_col: str, model: str = MODEL) -> DataFrame:
    """(id_col, text): the texts with ``[EMAIL]``, ``[PERSON]`` ... in those places.

    Every input row gives one row; a null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for rows in _blocks(batches):
            out = []
            for (_, text), spans in zip(rows, spans_of(tagger, [t or "" for _, t in rows])):
                for a, b, k in sorted(spans, reverse=True):
                    text = f"{text[:a]}[{k.upper()}]{text[b:]}"
                out.append(text)
            yield pa.record_batch([pa.array([r[0] for r in rows], id_type), pa.array(out, pa.string())], names=[id_col, text_col])

    from pyspark.sql.pandas.types import to_arrow_type

    t = docs.schema[id_col].dataType
    id_type = to_arrow_type(t)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {t.simpleString()}, {text_col} string")
