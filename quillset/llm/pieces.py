"""SentencePiece ids through a table of distinct chunks: when no piece of the model crosses a white-space marker, each distinct marked
word is segmented once and the ids are joined back by position.

The table belongs to a task: a corpus-wide one would shuffle one row per word position (for 0.5 GB of texts over 100 million rows) and
invented or mistyped words make it grow with the corpus, whereas a task meets nearly all its words again and again. It is emptied at
``TABLE_CHUNKS`` entries, which only costs segmenting a chunk again.

Defined results: a null text is empty (0 tokens, digests of the empty string); literal markers count as spaces, as in the library; chunks
may be whole texts (no spaces); repeated rows give repeated rows; a null ``doc_id`` stays null; no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillset.llm.shared import own_columns

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_CHUNKS, TABLE_CHUNK_CHARS, SLICE = 300_000, 64, 256


class ChunkTable:
    """Marked word -> (ids as text, decoded text); every marked word is segmented, and decoded, once.

    Every chunk starts at a marker, the first one at the dummy prefix, so chunks can be segmented apart. Words between single spaces, nearly
    all of any text, are looked up without their marker.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        # A normaliser that folds, trims or omits the dummy prefix would move chunk bounds.
        plain = self.model.encode(" a  b ", out_type=str)
        if crossing or "".join(plain) != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("this model's pieces or normaliser cross white space; its chunks cannot be segmented apart")
        self.starts = np.array([p.startswith(MARK) for p in map(self.model.id_to_piece, range(self.model.get_piece_size()))])
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}  # only of chunks that decode to something else than themselves

    def fill(self, words: set[str]) -> None:
        """Segment the words that the table lacks: in one text, whose ids are cut where a piece starts with the marker."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > TABLE_CHUNKS:
            self.ids.clear()
            self.texts.clear()
            new = list(words)
        odd = [w for w in new if MARK in w or not w]
        plain = [w for w in new if w and MARK not in w]
        if plain:
            joined = " ".join(plain)
            ids = self.model.encode(joined)
            cuts = np.flatnonzero(self.starts[ids]).tolist()
            if len(cuts) != len(plain) or self.model.decode(ids) != joined:
                odd = new
            else:
                digits = list(map(str, ids))
                self.ids.update((w, ",".join(digits[a:b])) for w, a, b in zip(plain, cuts, [*cuts[1:], len(ids)], strict=True))
        for word in odd:
            ids = self.model.encode(word) if word else [self.model.piece_to_id(MARK)]  # a marker with nothing behind it
            # Decoded behind another word, a chunk keeps the space that its own marker stands for.
            text = self.model.decode([*self.model.encode("a"), *ids])[2:]
            self.ids[word] = ",".join(map(str, ids))
            if text != word:
                self.texts[word] = text

    def encode_all(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each whole text its ids as decimal numbers joined by commas, and what they decode to."""
        chunks = []
        for text in texts:
            words = text.split(" ") if text else []
            if text and ("" in words or MARK in text):
                words = [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
            chunks.append(words)
        self.fill(set().union(*chunks))
        out = []
        for words in chunks:
            decoded = [self.texts.get(w, w) for w in words] if self.texts else words
            out.append((",".join(map(self.ids.__getitem__, words)), " ".join(decoded)))
        for word in [w for w in self.ids if len(w) > TABLE_CHUNK_CHARS]:
            del self.ids[word]
        return out


def _model_path(model: str | None) -> str:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return model


def _mapped(docs: DataFrame, path: str, schema: str, columns: Callable[[list[str], list[str]], list[pa.Array]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                both = table.encode_all([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns([b[0] for b in both], [b[1] for b in both])], names=names)

    return own_columns(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(work, schema)


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids ARRAY<INT> of every whole text."""
    numbers = lambda ids, _: [pa.array([[int(i) for i in row.split(",")] if row else [] for row in ids], pa.list_(pa.int32()))]
    return _mapped(docs, _model_path(model), "doc_id bigint, ids array<int>", numbers)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from ids, by the library's own decoding of each whole id list."""
    path = _model_path(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        decode = sentencepiece.SentencePieceProcessor(model_file=path).decode
        for batch in batches:
            texts = [decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, so ids need not leave the task."""
    sha = lambda rows: pa.array([hashlib.sha256(r.encode()).hexdigest() for r in rows], pa.string())
    columns = lambda ids, texts: [pa.array([r.count(",") + bool(r) for r in ids], pa.int64()), sha(ids), sha(texts)]
    return _mapped(docs, _model_path(model), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns)
