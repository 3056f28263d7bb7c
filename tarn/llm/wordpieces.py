"""Ids of the word-end BPE tokenizer, word by word.

Its normalizer and splitter never look across white space, so a document's ids are those of its words in a row. Arrow cuts
a batch of texts into words and numbers the different ones; their ids are looked up, or learned, once for each batch. Words
that a worker has met lately are known. Of new ones letters alone are parts that the splitter leaves whole, other plain
words are taken apart where it would, and the tokenizers library encodes all new parts in one call; words with other than
plain characters go to it whole. Of all texts one in CHECKED, chosen by a hash of its bytes however long it is, and the
first one of each worker's task is encoded by the library as a whole as well; a difference is an error.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose lower case and NFC form need no context: ASCII and the precomposed Latin-1 letters.
PLAIN = re.compile(r"[\t-\r -~À-ÿ]*")
#: The splitter's own pattern (fixed value of the tokenizer file), for plain characters.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")
#: A mark between a letter and white space is a part of its own.
MARK = r"([a-z])([.,;:!?][ \t-\r])"
#: Words and hashes of compared texts that a worker remembers, twice; beyond, the older half is forgotten.
KEPT = 400_000
#: One text in so many is compared with the library's own encoding of it.
CHECKED = 50


class WordIds:
    """A worker's tokenizer, and what it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ends_part = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_part[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.compared: set[int] = set()

    def library_ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn_parts(self, new: list[bytes]) -> None:
        """Encodes parts in one call: each gives one token with a word end, its last."""
        ids = np.array(self.library.encode(b"\n".join(new).decode(), add_special_tokens=False).ids, dtype="<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends_part[ids]) + 1)).tolist()]
        if len(cuts) != len(new) + 1:
            raise ValueError("the tokenizer splits words in other places than expected")
        raw = ids.tobytes()
        self.words.update(zip(new, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _learn(self, new: list[bytes]) -> None:
        """Adds the ids of new words."""
        words, before = self.words, self.before
        parts: dict[bytes, None] = {}
        apart: list[tuple[bytes, list[bytes]]] = []
        for raw in new:
            if raw in before:
                words[raw] = before[raw]
            elif raw.isalpha():
                parts[raw] = None
            else:
                text = raw.decode()
                if PLAIN.fullmatch(text) is not None and not ("<|" in text and any(s in text for s in self.special)):
                    apart.append((raw, [x.encode() for x in SPLIT.findall(text.lower())]))
                else:
                    words[raw] = self.library_ids(text)
        parts.update((part, None) for _, own in apart for part in own if part not in words)
        if parts:
            self._learn_parts(list(parts))
        words.update((raw, b"".join(map(words.__getitem__, own))) for raw, own in apart)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts in a row, as unsigned 32-bit numbers, and where each text's begin and the last one's end. Null is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        # A-Z go to lower case in any case, but special tokens are told apart by it.
        special = pc.match_substring(texts, "<|")
        lower = pc.ascii_lower(texts)
        lower = pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, MARK, r"\1 \2"))
        numbered = split.flatten().dictionary_encode()
        different = numbered.dictionary.cast(pa.binary()).to_pylist()
        if len(self.words) > KEPT:
            self.before, self.words = self.words, {}
        ids = list(map(self.words.get, different))
        unknown = [k for k, own in enumerate(ids) if own is None]
        new = [different[k] for k in unknown]
        self._learn(new)
        for k, raw in zip(unknown, new, strict=True):
            ids[k] = self.words[raw] if len(raw) <= 64 else self.words.pop(raw)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
        known = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        own = known.take(numbered.indices)
        at, first = own.offsets.to_numpy(), split.offsets.to_numpy()
        return own.values.to_numpy()[at[0] : at[-1]], (at[first - first[0]] - at[0]).tolist()

    def check(self, raw: bytes, ids: bytes, always: bool = False) -> None:
        """Compares a text's ids with the library's, if the text is one of those to be compared; equal texts once."""
        crc = zlib.crc32(raw)
        if (always or crc % CHECKED == 0) and crc not in self.compared:
            if len(self.compared) > KEPT:
                self.compared.clear()
            self.compared.add(crc)
            text = raw.decode("utf-8", "replace")
            if self.library_ids(text) != ids:
                raise ValueError(f"a text that begins {text[:80]!r} has other ids in the tokenizers library")


@functools.cache
def word_ids(path: str) -> WordIds:
    """The worker's tokenizer."""
    return WordIds(path)


class Encoder:
    """Encodes the texts of one task, and compares those that are to be compared."""

    def __init__(self, path: str):
        self.tokenizer, self.first = word_ids(path), True

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers in a row."""
        values, bounds = self.tokenizer.encode(texts)
        out = [values[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        for text, ids in zip(texts.cast(pa.binary()), out, strict=True):
            raw = text.as_py() or b""
            self.tokenizer.check(raw, ids, self.first and bool(raw))
            self.first = self.first and not raw
        return out
