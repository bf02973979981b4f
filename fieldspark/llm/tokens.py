"""Token ids of whole texts by the tokenizers library, with a bounded memo of text chunks.

The vocabulary's splitter never joins a word to the space after it, so a text may be cut
before any single space, or single line break, that stands between two other characters:
the ids of the chunks, in order, are the ids of the text. Each worker asks the library
once per chunk and keeps the answer. Texts with neighbouring white space are cut only
where that holds. Of chunks that were not seen before, letters and the
marks after them are asked for once each, since the splitter cuts between them. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import canonical

#: Vocabulary file; a name is looked up among the public tokenizers, a path is used as it is.
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of chunks and ids a worker remembers before it starts anew, and what an entry costs besides.
MEMO, _ENTRY = 96 << 20, 150
#: Texts encoded at once.
BATCH = 256

_BESIDE = re.compile(r"\s\s|^\s|\s$")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


#: Latin letters, maybe after a line break, and marks that end the chunk: one piece each for the splitter.
_WORD = re.compile(r"(\n?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)").fullmatch


def _byte_letters() -> list[str]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_LETTERS = _byte_letters()


def vocabulary_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def split(text: str) -> tuple[str, list[str]]:
    """(first chunk, keys of the others): a key is a chunk without the space it starts with, or one that starts with a line break."""
    if _BESIDE.search(text):
        first, *rest = _SAFE.split(text)
    else:
        first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest


def _chunk(key: str) -> str:
    return key if key[:1] == "\n" else " " + key


def chunks(text: str) -> list[str]:
    """Pieces of ``text`` whose encodings concatenate to its encoding."""
    first, rest = split(text)
    return [first, *map(_chunk, rest)]


class _Ids(dict):
    """Ids of strings, asked for once each."""

    def __init__(self, ask) -> None:
        self.ask = ask

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.ask(key)
        return found


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; its memory is bounded in bytes."""

    def __init__(self, vocabulary: str, memo: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.first, self.rest, self.pieces = _Ids(self._text), _Ids(self._rest), _Ids(self._piece)
        self.held, self.limit = 0, memo

    def _kept(self, key: str, ids: bytes) -> bytes:
        self.held += len(key) + len(ids) + _ENTRY
        return ids

    def _text(self, text: str) -> bytes:
        (e,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return self._kept(text, array("I", e.ids).tobytes())

    def _rest(self, key: str) -> bytes:
        word = _WORD(key)
        if word is None:
            return self._text(_chunk(key))
        line, letters, marks = word.groups()
        if line:
            return self._kept(key, self.pieces[line] + self.pieces[letters] + self.pieces[marks])
        if marks:
            return self._kept(key, self.rest[letters] + self.pieces[marks])
        return self._piece(" " + key)

    def _piece(self, text: str) -> bytes:
        """Ids of what the splitter leaves whole, straight from the library's model."""
        letters = "".join([_LETTERS[b] for b in text.encode()])
        return self._kept(text, array("I", [t.id for t in self.model.tokenize(letters)]).tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        first, got, out = self.first.__getitem__, self.rest.__getitem__, []
        for t in texts:
            if self.held > self.limit:
                for memo in (self.first, self.rest, self.pieces):
                    memo.clear()
                self.held = 0
            f, r = split(t)
            out.append(first(f) + b"".join(map(got, r)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int | None) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, ids of each document as bytes) for (doc_id, text) batches."""
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    coder = encoder(vocabulary)
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            part = batch.slice(k, BATCH)
            yield part.column(0).to_pylist(), [i + tail for i in coder.encode(part.column(1).to_pylist())]


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
              end: int | None = 0) -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of every text, ``end`` appended."""
    def run(batches):
        for docs, ids in encoded(batches, vocabulary, end):
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return canonical(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")
