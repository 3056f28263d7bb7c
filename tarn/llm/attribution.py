"""Token counts of a document's sections, from one encoding of the whole document.

Encoding sections one by one counts tokens that the whole text doesn't have. Here each text is encoded once, every token
gets its span of characters, and spans are joined with the sections as intervals.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarn.llm.common import bound_batches, vocabulary

RULES = ("majority", "first")


@functools.cache
def _encoding(path: str):
    """A byte-level encoding, and the bytes of each id's token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


#: A run of white space that is too long for the splitter's look-ahead, which goes as deep as the run is long.
LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


def _one_piece(encoding, text: str) -> list[int]:
    """The ids of one piece. The library has no public way to encode a piece without its splitter; a version without this one is told."""
    single = getattr(encoding, "_encode_single_piece", None)
    if single is None:
        raise RuntimeError("this version of tiktoken can't encode a run of white space that is too long for its splitter")
    return single(text)


def _ids(encoding, text: str) -> list[int]:
    """The ids of a text. Of a run of white space the splitter makes one piece, but for its last character where more text follows."""
    ids, at = [], 0
    for run in LONG_WHITE.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += _one_piece(encoding, text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last, of each token; tokens that share a character's bytes all cover it."""
    encoding, sizes = _encoding(path)
    ends = np.cumsum(sizes[np.array(_ids(encoding, text), dtype=np.int64)])
    if not len(ends):
        return ends, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80) - 1
    return place[np.concatenate(([0], ends[:-1]))], place[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and, of these, those that cross a boundary. Sections are adjacent; section_ends are theirs.

    ``majority``: a token goes to the section that holds most of its characters, the first of those with equally many.
    ``first``: to the section of its first character.
    """
    n = len(section_ends)
    home = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, ends - 1, side="right")
    crossing = np.flatnonzero(last > home)
    bounds = np.concatenate(([0], section_ends))
    if rule == "majority":
        for t in crossing.tolist():
            own = np.arange(home[t], last[t] + 1)
            held = np.minimum(ends[t], bounds[own + 1]) - np.maximum(starts[t], bounds[own])
            home[t] = own[np.argmax(held)]
    return np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_col: str | None = None, tokenizer: str = "byte_bpe_50k.tiktoken", rule: str = "majority") -> DataFrame:
    """A row for each section: id, section (from 0), start, end (characters), tokens, crossing.

    Sections are adjacent and cover the text. ``section_col`` holds the lengths in characters of each row's sections
    (array<int>, in order; what they leave of the text is one more section); without it every line, with its line feed,
    is a section. The tokens of a document's sections add up to those of the whole document.
    A null or empty text, and a text all of whose sections are empty, gives one section without tokens. Rows that repeat
    give their sections again. An empty table gives no rows. Further columns of the input play no part. A very long text is
    encoded once as a whole, in one task; ties between sections are settled by ``rule``.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(section_col).alias("sections")] if section_col else []))
    schema = T.StructType([slim.schema["id"], *(T.StructField(c, T.LongType()) for c in ("section", "start", "end", "tokens", "crossing"))])
    arrow = to_arrow_schema(schema)

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary(tokenizer)
        for batch in batches:
            given = batch.column(2).to_pylist() if section_col else None
            rows, columns = [], [[] for _ in range(5)]
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                if section_col:
                    ends = np.cumsum(np.array([max(0, x or 0) for x in given[row] or ()], dtype=np.int64))
                    ends = ends[ends < len(text)]
                else:
                    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
                    ends = np.flatnonzero(points == 10) + 1
                if not len(ends) or ends[-1] < len(text):
                    ends = np.append(ends, len(text))
                own, crossing = attribute(*token_spans(text, path), ends, rule)
                rows.append(np.full(len(ends), row))
                for c, x in zip(columns, (np.arange(len(ends)), np.concatenate(([0], ends[:-1])), ends, own, crossing), strict=True):
                    c.append(x)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c), pa.int64()) for c in columns)], schema=arrow)

    return slim.mapInArrow(count_all, schema).withColumnRenamed("id", id_col)


def op8_attribution(spark, sf_dir: str) -> DataFrame:
    """Token counts of every line of all documents, as part of the whole document, by the rule ``majority`` (of ties the first)."""
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
