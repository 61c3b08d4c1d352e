"""Encoding and decoding with a SentencePiece model by a table of distinct chunks.

The model's text is the input with a marker in place of each space and one in front. If no
piece holds a marker behind another character, no merge crosses the start of a run of
markers, so every chunk (markers, then what follows up to the next marker) is encoded on
its own. Each worker segments a distinct chunk once and joins the ids back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from featshift.llm.arrays import slices

MARKER = "▁"
#: One chunk of the marked text.
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
#: A worker starts a new table when a slice would take it beyond so many chunks; results do not depend on it.
TABLE_ROWS = 400_000


class ChunkCodec:
    """Encode and decode whole texts by distinct chunks."""

    def __init__(self, model_path: str, table_rows: int = TABLE_ROWS):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        if self.model.encode(" a")[:1] == self.model.encode("a")[:1] or self.model.normalize("a  b ") != f"{MARKER}a{MARKER * 2}b{MARKER}":
            raise ValueError("the model must keep white space and put a marker in front")
        self.lone = [self.model.piece_to_id(MARKER)]
        self.table_rows = table_rows
        self.table: dict[str, str] = {}
        self.altered: dict[str, str] = {}

    def _segment(self, chunks: list[str]) -> None:
        # The model puts the first marker in front itself, and takes it away when it decodes;
        # it reads a lone marker as no text at all.
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        ids = [i if c != MARKER else self.lone for c, i in zip(chunks, ids, strict=True)]
        texts = self.model.decode(ids, num_threads=1)
        for chunk, i, text in zip(chunks, ids, texts, strict=True):
            self.table[chunk] = "," + ",".join(map(str, i))
            if chunk != MARKER and text != chunk[1:].replace(MARKER, " "):
                self.altered[chunk] = " " + text

    def encode(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids as decimal text joined by commas, and the decoded text."""
        chunks = [CHUNK.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        distinct = set().union(*chunks)
        if len(self.table) + len(distinct) > self.table_rows:
            self.table, self.altered = {}, {}
        if missing := [c for c in distinct if c not in self.table]:
            self._segment(missing)
        ids = ["".join([self.table[c] for c in found])[1:] for found in chunks]
        if self.altered.keys().isdisjoint(distinct):  # every chunk decodes to itself
            return [(i, t.replace(MARKER, " ") if t else "") for i, t in zip(ids, texts, strict=True)]
        return [(i, "".join([self.altered.get(c) or c.replace(MARKER, " ") for c in found])[1:]) for i, found in zip(ids, chunks, strict=True)]


@cache
def codec(model_path: str) -> ChunkCodec:
    """The table of this worker process, kept from task to task."""
    return ChunkCodec(model_path)


def encode_pieces(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", decoded: str | None = None, digests: bool = False,
) -> DataFrame:
    """Add the piece ids of each whole text, without begin or end ids.

    ``ids`` is an array of int; ``decoded`` names a column for the decoded text. With
    ``digests`` the columns ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` are added
    instead of ids and text. Columns of ``docs`` with these names are replaced; others stay.
    A null or empty text has no ids and decodes to the empty text.
    """
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    kept = [c for c in docs.columns if c not in added]
    source = "_text" if text in added else text
    frame = docs.select(*kept, *([docs[text].alias(source)] if source not in kept else []))
    out_fields = [f for f in frame.schema.fields if f.name != "_text"]
    schema = T.StructType([*out_fields, *(T.StructField(k, v) for k, v in added.items())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source, 2 << 20):
            rows = codec(model_path).encode(batch.column(source).to_pylist())
            if digests:
                made = [
                    pa.array([i.count(",") + 1 if i else 0 for i, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows], pa.string()),
                ]
            else:
                made = [pa.array([[int(x) for x in i.split(",")] if i else [] for i, _ in rows], pa.list_(pa.int32()))]
                made += [pa.array([d for _, d in rows], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in out_fields), *made], names=schema.names)

    return frame.mapInArrow(task, schema)
