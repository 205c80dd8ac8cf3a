"""Token ids of texts, in Arrow batches."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Printable Latin letters and marks up to U+024F, but for the dotted capital I.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*").fullmatch


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A mark that ends a word of letters and is a part of its own.
_STOP = re.compile(rb"[.,;:!?](?!\S)(?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids by the word tokenizer's file.

    White space separates its words and nothing reaches across it, so the ids
    of a text are those of its words in a row. Words seen before come from
    dictionaries of bounded size: when ``words`` is full it becomes ``old``,
    from which words that come again are taken over, so that frequent ones
    stay. New words of Latin letters are normalised and split here and only
    the merges are left to the library; all others, and all words of
    tokenizers of another kind, go through the library whole.
    """

    def __init__(self, path: str, limit: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        splits = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        steps = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        self.simple = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
        if self.simple:
            self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
            self.merge = self.tokenizer.model.tokenize
            self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit = limit

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if not self.simple:
            for at in range(0, len(texts), 128):
                for e in self.tokenizer.encode_batch_fast([t or "" for t in texts[at : at + 128]], add_special_tokens=False):
                    yield np.array(e.ids, dtype=np.uint32)
            return
        new = self.new
        for t in texts:
            words = self.apart((t or "").encode("utf-8", "surrogatepass"))
            found = list(map(self.words.get, words))
            try:
                data = b"".join(found)
            except TypeError:  # some are new
                data = b"".join([new(w) if x is None else x for w, x in zip(words, found, strict=True)])
            yield np.frombuffer(data, dtype="<u4")

    @staticmethod
    def apart(data: bytes) -> list[bytes]:
        """Words of a text: A-Z lower-cased and closing marks apart, which spares entries,
        but not where special tokens or combining marks may stand (H and a line below
        aren't composed, h and a line below are)."""
        if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
            return data.split()
        return _STOP.sub(rb" \g<0>", data.lower()).split()

    def new(self, word: bytes) -> bytes:
        """The ids of a word that wasn't in ``words``, packed."""
        found = self.words.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.encoded(word)
            if len(word) <= 64:
                if len(self.words) >= self.limit:
                    self.old, self.words = self.words, {}
                self.words[word] = found
        return found

    def encoded(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if word.isalpha():  # ASCII letters only
            return self.merged(text.lower())
        if not self.latin(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = [text.lower()] if text.isalpha() else self.split(text.lower())
        return self.merged(parts[0]) if len(parts) == 1 else b"".join([self.new(p.encode()) for p in parts])

    def merged(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return _packed([x.id for x in self.merge(shown)])

    @staticmethod
    def latin(text: str) -> bool:
        """Whether lower-casing letter by letter is str.lower, nothing is to be composed, and there are no controls or marks of special tokens."""
        return _PLAIN(text) is not None and "<|" not in text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that its dictionaries serve all tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def lengths(batches: Iterable[pa.RecordBatch], path: str, extra: int) -> Iterator[pa.RecordBatch]:
    """A column ``length`` for each text: its ids plus ``extra``."""
    encode = encoder(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(x) + extra for x in encode(b.column(0).to_pylist())], pa.int64())], ["length"])


def pieces(batches: Iterable[pa.RecordBatch], path: str, end_id: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece of at most ``limit`` ids of each text."""
    encode = encoder(path)
    for b in batches:
        rows: list[tuple] = []
        for key, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, at in enumerate(range(0, len(ids), limit)):
                x = ids[at : at + limit]
                rows.append((key, k, at, len(x), zlib.crc32(x.tobytes())))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
