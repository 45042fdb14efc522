"""Encoding a corpus with a public tokenizer through a distinct-word table.

1. ``split``: documents are split once into words (the tokenizer's own pattern);
   every chunk of documents yields its word list and, per document, the word
   numbers as compact integers.  A repeated doc_id gives a row each time.
2. The chunk lists are reduced to the distinct words of the corpus, and each
   distinct word is encoded once.
3. The ids are joined back to the chunk lists by word, then to the documents by
   position within their chunk.

Only word lists (a small fraction of the text) are shuffled by word; no word,
however frequent, has more rows than there are chunks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import table

#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Documents and characters that close a chunk.
CHUNK_DOCS, CHUNK_CHARS = 4096, 4_000_000
#: Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _split(id_type: pa.DataType):
    import uuid

    schema = pa.schema([("chunk", pa.string()), ("doc", id_type), ("numbers", pa.binary()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        docs, numbers, vocab, chars = [], [], {}, 0

        def flush() -> pa.RecordBatch:
            chunk = uuid.uuid4().hex
            n = len(docs)
            out = pa.record_batch([
                pa.array([chunk] * (n + 1)), pa.array([*docs, None], id_type), pa.array([*numbers, None], pa.binary()),
                pa.array([None] * n + [list(vocab)], pa.list_(pa.string())),
            ], schema=schema)
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = find(text) if text else ()
                docs.append(doc)
                n = np.fromiter((vocab.setdefault(x, len(vocab)) for x in w), np.int32, len(w))
                # Two bytes a word as long as the chunk's numbers fit into them; the first byte says which.
                numbers.append(b"2" + n.astype(np.uint16).tobytes() if len(vocab) <= 65536 else b"4" + n.tobytes())
                chars += len(text or "")
                if len(docs) >= CHUNK_DOCS or chars >= CHUNK_CHARS:
                    yield flush()
                    docs, numbers, vocab, chars = [], [], {}, 0
        if docs:
            yield flush()

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            words = b.column(0)
            ids = [e.ids for e in tok.encode_batch(words.to_pylist(), add_special_tokens=False)]
            yield pa.record_batch([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _assemble(id_type: pa.DataType, id_col: str):
    def run(docs: pa.Table, vocab: pa.Table) -> pa.Table:
        number = vocab.column("number").to_numpy()
        lists = vocab.column("ids").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
        flat, off = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0] if len(off) else np.zeros(1, np.int64)
        start = np.zeros(len(number), np.int64)
        size = np.zeros(len(number), np.int64)
        start[number], size[number] = off[:-1], np.diff(off)
        out_ids, out_off = [], [0]
        for raw in docs.column("numbers").to_pylist():
            n = np.frombuffer(raw, np.uint16 if raw[:1] == b"2" else np.int32, offset=1)
            k = size[n]
            total = int(k.sum())
            # positions start[i], start[i]+1, ... of every word, flattened
            at = np.repeat(start[n] - np.concatenate(([0], np.cumsum(k)[:-1])) if len(n) else start[n], k) + np.arange(total)
            out_ids.append(flat[at])
            out_off.append(out_off[-1] + total)
        ids = pa.ListArray.from_arrays(
            pa.array(np.array(out_off, np.int32)), pa.array(np.concatenate(out_ids) if out_ids else np.zeros(0, np.int32), pa.int32()))
        return pa.table([docs.column("doc").cast(id_type), ids], names=[id_col, "ids"])

    return run


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str = VOCABULARY, folder: str = TOKENIZERS,
) -> DataFrame:
    """(id_col, ids ARRAY<INT>): every document's text as token ids.

    A null and an empty text both give an empty list; no special tokens are
    added, and their strings inside a text are ordinary text.  Each input row
    gives one row, also where an id repeats or is null.  Other columns are
    ignored; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark_type = docs.schema[id_col].dataType
    id_type = to_arrow_type(spark_type)
    ddl = spark_type.simpleString()
    parts = table(
        docs.select(id_col, text_col).mapInArrow(_split(id_type), f"chunk string, doc {ddl}, numbers binary, words array<string>"),
        "split",
    )
    lists = parts.where("words is not null").select("chunk", F.posexplode("words").alias("number", "word"))
    ids = lists.select("word").distinct().mapInArrow(_encode(os.path.join(folder, vocabulary + ".json")), "word string, ids array<int>")
    vocab = lists.join(ids, "word").selectExpr("chunk as in_chunk", "number", "ids")
    rows = parts.where("words is null").select("chunk", "doc", "numbers")
    return (
        rows.groupBy("chunk").cogroup(vocab.groupBy("in_chunk"))
        .applyInArrow(_assemble(id_type, id_col), f"{id_col} {ddl}, ids array<int>")
    )


def pieces(spark: SparkSession, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(id, piece BINARY): the vocabulary as a table, read from its rank file."""
    lines = spark.read.text(os.path.join(folder, vocabulary + ".tiktoken"))
    return lines.where("value <> ''").select(
        F.split("value", " ")[1].cast("int").alias("id"), F.unbase64(F.split("value", " ")[0]).alias("piece"))


def _pieces_of(shared, id_type: pa.DataType, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = pa.array(shared.value, pa.binary())
        for b in batches:
            lists = b.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            joined = table_.take(lists.flatten())  # the pieces of all ids, one after another
            ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
            body = joined.buffers()[2].to_pybytes() if len(joined) else b""
            cut = ends[at - at[0]]
            texts = [body[x:y].decode("utf-8", "replace") for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.record_batch([b.column(0).cast(id_type), pa.array(texts, pa.string())], names=[id_col, "text"])

    return run


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, text): texts from ids by joining the id-to-piece table.

    The table has one row per vocabulary entry, so its size is fixed by the
    vocabulary; it is sent once and joined by position in Arrow, and no id is
    shuffled.  An empty or null list decodes to the empty text; rows stay.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = encoded.sparkSession
    rows = {r.id: bytes(r.piece) for r in pieces(spark, vocabulary, folder).collect()}
    shared = spark.sparkContext.broadcast([rows.get(i, b"") for i in range(max(rows) + 2)])
    t = encoded.schema[id_col].dataType
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return encoded.select(id_col, ids.alias("ids")).mapInArrow(_pieces_of(shared, to_arrow_type(t), id_col), f"{id_col} {t.simpleString()}, text string")


def ranks(path: str) -> dict[bytes, int]:
    """The rank file as a dictionary (tests)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
