"""Encoding and decoding with a SentencePiece vocabulary of merges.

A text's symbols are joined by an agenda of adjacent pairs, best score first and leftmost among equals, until no pair is
a piece. No piece of such a vocabulary holds a space mark after another character, or a letter beside a character that
is neither letter nor space mark, so no merge crosses a place where one follows the other: segments between such places
are encoded one by one, and each worker keeps those it has met. Every segment that an Arrow batch adds is
checked against the sentencepiece library before the batch is returned; a difference is an error.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches, vocabulary

SPACE = "▁"
_NEVER = float("inf")
#: Segments that a worker remembers; beyond, it starts afresh. Longer segments than so many characters aren't kept.
SEGMENTS, KEPT_LENGTH = 500_000, 48
#: Spaces with what follows them, or what follows something else: letters, or characters that are neither.
CUT = re.compile(r" +(?:[^\W\d_¹²³]+|(?:[^\w ]|[\d_¹²³])*)|[^\W\d_¹²³]+|(?:[^\w ]|[\d_¹²³])+")
#: Up to so many characters, the agenda is a list that is searched for its best pair; beyond, a heap.
LIST_LENGTH = 40


class PieceEncoder:
    """The vocabulary of one model file, and the segments met so far: decimal ids and the same as 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.rank[piece] = (-lib.get_score(i), i)
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        if any(len(p) > 1 and len(CUT.findall(p.replace(SPACE, " "))) > 1 for p in self.rank):
            raise ValueError("a piece crosses the places at which texts are cut into segments")
        probe = f"  aäﬁÅ\t{SPACE}b \n c "
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model's normalizer changes more than spaces")
        self.number = {piece: number for piece, (_, number) in self.rank.items()}.get
        self.score = {piece: score for piece, (score, _) in self.rank.items()}.get
        self.decimal = [str(i).encode() for i in range(lib.get_piece_size())]
        self.segments: dict[str, tuple[bytes, bytes]] = {}
        self.unchecked: dict[str, list[int]] = {}

    def agenda(self, segment: str) -> list[int]:
        """Ids of a segment: the best pair of neighbours is joined again and again."""
        symbols = self._joined_by_list(segment) if len(segment) <= LIST_LENGTH else self._joined_by_heap(segment)
        ids = list(map(self.number, symbols))
        if None not in ids:
            return ids
        return [i for s, n in zip(symbols, ids, strict=True) for i in ([n] if n is not None else map(self.byte.__getitem__, s.encode()))]

    def _joined_by_list(self, segment: str) -> list[str]:
        score, symbols = self.score, list(segment)
        agenda = [score(segment[i : i + 2], _NEVER) for i in range(len(segment) - 1)]
        while agenda and (best := min(agenda)) < _NEVER:
            i = agenda.index(best)  # the leftmost of equals
            symbols[i : i + 2] = [joined := symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(joined + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + joined, _NEVER)
        return symbols

    def _joined_by_heap(self, segment: str) -> list[str]:
        rank, n = self.rank, len(segment)
        symbols: list[str | None] = list(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = []
        for i in range(n - 1):
            if found := rank.get(segment[i : i + 2]):
                todo.append((found[0], i, segment[i : i + 2]))
        heapq.heapify(todo)
        while todo:
            _, i, joined = heapq.heappop(todo)
            j = after[i] if symbols[i] is not None else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != len(joined) or symbols[i] + symbols[j] != joined:
                continue  # one of the two has been joined to another meanwhile
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := rank.get(pair := joined + symbols[k]):
                    heapq.heappush(todo, (found[0], i, pair))
            if (h := before[i]) >= 0 and (found := rank.get(pair := symbols[h] + joined)):
                heapq.heappush(todo, (found[0], h, pair))
        return [s for s in symbols if s]

    def segment(self, key: str) -> tuple[bytes, bytes]:
        got = self.segments.get(key)
        if got is None:
            ids = self.agenda(key.replace(" ", SPACE))
            got = b",".join([self.decimal[i] for i in ids]), array("I", ids).tobytes()
            self.unchecked[key] = ids
            if len(key) <= KEPT_LENGTH:
                if len(self.segments) >= SEGMENTS:
                    self.segments.clear()
                self.segments[key] = got
        return got

    def encode(self, text: str) -> tuple[bytes, list[int]]:
        """Decimal ids joined by commas, and the ids; an empty text has none."""
        if not text:
            return b"", []
        keys = CUT.findall(" " + text.replace(SPACE, " "))
        found = list(map(self.segments.get, keys))
        if None in found:
            found = list(map(self.segment, keys))
        return b",".join([f[0] for f in found]), np.frombuffer(b"".join([f[1] for f in found]), dtype="<u4").tolist()

    def check(self) -> None:
        """Holds what was encoded since the last call against the library, which puts a space mark before each text.

        A segment that doesn't begin with one is given to it after a line feed, which no piece joins to anything.
        """
        keys = list(self.unchecked)
        marked = [len(k) > 1 and k[0] == " " for k in keys]
        given = [k[1:] if m else "\n" + k for k, m in zip(keys, marked, strict=True)]
        for key, own, ids in zip(keys, marked, self.library.encode(given, num_threads=1), strict=True):
            if (ids if own else ids[2:]) != self.unchecked[key]:
                raise ValueError(f"the agenda and the library differ on {key!r}: {self.unchecked[key]} and {ids}")
        self.unchecked.clear()


@functools.cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def piece_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", ids: bool = True) -> DataFrame:
    """Encodes and decodes whole texts: id, n_tokens, ids (unless left out), ids_sha256, decoded_sha256.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the library's decoding of the ids, in UTF-8.
    A null text is empty: no ids, and an empty decoding. Rows that repeat, null ids and very long texts are encoded like
    any other; an empty table gives no rows. Further columns of the input play no part.
    """
    bound_batches(docs.sparkSession, 256)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [slim.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)])
    arrow = to_arrow_schema(schema)

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary(model))
        for batch in batches:
            counts, hashes, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                decimal, numbers = own.encode(text or "")
                counts.append(len(numbers))
                hashes.append(hashlib.sha256(decimal).hexdigest())
                decoded.append(hashlib.sha256(own.library.decode(numbers).encode()).hexdigest())
                if ids:
                    lists.append(numbers)
            own.check()
            columns = [counts, hashes, decoded, *([lists] * ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, arrow[i + 1].type) for i, c in enumerate(columns))], schema=arrow)

    return slim.mapInArrow(encode_all, schema).withColumnRenamed("id", id_col)


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return piece_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
