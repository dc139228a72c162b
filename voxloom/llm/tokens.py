"""Token ids of whole texts by a stored tokenizer, with a bounded cache of words.

The tokenizer file drops white space and never joins words across it, so a text's ids
are the ids of its ASCII-blank-separated words in order. Each distinct word is encoded by the
``tokenizers`` library and then found in a cache. A word of plain marks, digits and
Latin letters goes to the library's merge model directly, cut as the file's own pattern
cuts it; any other word, and any word with an apostrophe, goes through the library's
whole encoder. The ids are those that encoding the whole text gives (tests hold this
against the library).
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in a generation of a worker's cache; two generations are kept, about 200 bytes a word.
CACHE_WORDS = 300_000
#: Bytes of text whose words are numbered at once.
RUN_BYTES = 8_000_000
#: Letters, marks and digits whose pieces are known without the library's pattern.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
PLAIN = re.compile(f"[!-&(-~{LETTERS}]+")
STEM = re.compile(f"([{LETTERS}]+)([.,!?;:$&%*#()]*)")
PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")
#: The pattern and steps of a file for which the direct way holds.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = {}, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class _Made(dict):
    """key -> ids; a missing key comes from the generation before or is made."""

    def __init__(self, make, before: dict | None = None):
        super().__init__()
        self.make, self.before = make, before or {}

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def aged(self, limit: int) -> _Made:
        """Itself, or past the limit a new generation that falls back on this one."""
        if len(self) <= limit:
            return self
        self.before = {}
        return _Made(self.make, self)


class WordTokenizer:
    """Encodes texts to little-endian ids of ``width`` bytes."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        raw = json.loads(spec)
        self.special = tuple(t["content"] for t in raw["added_tokens"])
        pre = raw["pre_tokenizer"]["pretokenizers"]
        self.direct = pre[0]["pattern"].get("Regex") == KNOWN_PATTERN and [n["type"] for n in raw["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.letters = _byte_letters()
        self.tokenize = self.lib.model.tokenize
        self.words = _Made(self._word)

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not in the cache; its lower-case stem and its marks may be."""
        m = STEM.fullmatch(word) if self.direct else None
        if m:
            stem, marks = m.groups()
            low = stem.lower()
            if marks:
                return self.words[low] + self.words[marks]
            return self._piece(word) if low == word else self.words[low]
        if not self.direct or not PLAIN.fullmatch(word) or ("|" in word and any(s in word for s in self.special)):
            return self.pack(self.lib.encode(word, add_special_tokens=False).ids)
        pieces = PIECES.findall(word.lower())
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.words.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return next(self.encode_arrow(pa.array([text], pa.large_string())))

    def encode_arrow(self, texts: pa.Array):
        """Yields the ids of each text; null is the empty text.

        Arrow splits a run of texts at ASCII blanks and numbers its distinct words; only
        those meet the caches, and one gather lays the ids of all words out in order.
        """
        if not len(texts):
            return
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
            lists = pc.ascii_split_whitespace(texts.slice(at, until - at))
            numbered = lists.flatten().dictionary_encode()
            self.words = self.words.aged(CACHE_WORDS)
            found = list(map(self.words.__getitem__, numbered.dictionary.to_numpy(zero_copy_only=False).tolist()))
            ids = np.frombuffer(b"".join(found), dtype=self.dtype)
            sizes = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // self.width
            starts = np.cumsum(sizes, dtype=np.int32) - sizes
            word = numbered.indices.to_numpy()
            n = sizes[word]
            upto = np.r_[np.int64(0), np.cumsum(n, dtype=np.int64)]
            place = np.repeat(starts[word] - upto[:-1].astype(np.int32), n)
            place += np.arange(len(place), dtype=np.int32)
            raw = ids[place].tobytes()
            cut = (upto[lists.offsets.to_numpy()] * self.width).tolist()
            for a, b in zip(cut, cut[1:]):
                yield raw[a:b]
            at = until


_worker: dict[int, WordTokenizer] = {}


def worker_tokenizer(spec: str) -> WordTokenizer:
    """The process's tokenizer for this file's content, made once."""
    key = hash(spec)
    if key not in _worker:
        _worker.clear()
        _worker[key] = WordTokenizer(spec)
    return _worker[key]


def encode_all(spec: str, texts, end: bytes = b""):
    """Yields the ids of each text of an Arrow array, a series or a list, then ``end``."""
    arrow = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string(), from_pandas=True)
    for raw in worker_tokenizer(spec).encode_arrow(arrow):
        yield raw + end


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
