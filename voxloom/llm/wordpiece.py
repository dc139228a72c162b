"""Token counts by a linear longest-match automaton (operator 4).

Greedy word pieces (always the longest vocabulary entry that begins the rest of the word)
are counted in one pass over the bytes without building a piece. The vocabulary is a
trie; each node knows a failure link, the node where matching goes on when no child fits,
and how many pieces are popped on the way, both computed breadth first. A word costs as
many steps as it has bytes, plus one per piece.

The registered query takes the pieces of the stored tokenizer file as byte strings, the
same for the beginning and the rest of a word, over ASCII-lower-cased words between ASCII
blanks. Distinct words of a run of texts are numbered by Arrow and counted once.

Edge cases: a word with a byte that no piece can cover counts as one (unknown) token, as
in the published scheme; null and empty texts count 0; repeated rows count alike; an empty
table gives no rows; extra columns are ignored; words and texts of any length are whole.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import bounded
from voxloom.llm.tokens import RUN_BYTES, _byte_letters, _Made, read_spec

CACHE_WORDS = 500_000
NONE = -1


class LongestMatch:
    """Trie with failure links and popped-token counts over byte strings."""

    def __init__(self, first: list[bytes], rest: list[bytes] | None = None):
        """``first``: pieces that may begin a word; ``rest``: pieces further in (default: the same)."""
        self.children: list[dict[int, int]] = [{}]
        self.fail, self.pops = [NONE], [0]
        self.start = 0
        if rest is None:
            self.inner = 0
            whole = self._insert(0, first)
        else:
            self.inner = self._node()
            whole = self._insert(0, first) | self._insert(self.inner, rest)
        queue = deque([self.start] if rest is None else [self.start, self.inner])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                if v in whole:
                    self.fail[v], self.pops[v] = self.inner, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z != NONE and c not in self.children[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != NONE:
                        self.fail[v], self.pops[v] = self.children[z][c], popped
                queue.append(v)

    def _node(self) -> int:
        self.children.append({})
        self.fail.append(NONE)
        self.pops.append(0)
        return len(self.children) - 1

    def _insert(self, root: int, pieces: list[bytes]) -> set[int]:
        ends = set()
        for piece in pieces:
            u = root
            for c in piece:
                v = self.children[u].get(c)
                if v is None:
                    v = self.children[u][c] = self._node()
                u = v
            if u != root:
                ends.add(u)
        return ends

    def count(self, word: bytes) -> int:
        """Greedy pieces of the word; 1 if some byte can't be covered, 0 if it is empty."""
        children, fail, pops = self.children, self.fail, self.pops
        u, n = self.start, 0
        for c in word:
            v = children[u].get(c)
            while v is None:
                n += pops[u]
                u = fail[u]
                if u == NONE:
                    return 1
                v = children[u].get(c)
            u = v
        while u != self.inner and u != self.start:
            n += pops[u]
            u = fail[u]
            if u == NONE:
                return 1
        return n


def vocabulary(spec: str) -> list[bytes]:
    """The byte strings of a stored tokenizer's pieces, word-end marks dropped."""
    raw = json.loads(spec)
    suffix = raw["model"].get("end_of_word_suffix") or ""
    back = {c: b for b, c in _byte_letters().items()}
    special = {t["content"] for t in raw["added_tokens"]}
    out = set()
    for piece in raw["model"]["vocab"]:
        if piece not in special:
            piece = piece.removesuffix(suffix) if suffix else piece
            if piece and all(c in back for c in piece):
                out.add(bytes(back[c] for c in piece))
    return sorted(out)


_worker: dict[int, _Made] = {}


def _counts(spec: str) -> _Made:
    key = hash(spec)
    if key not in _worker:
        machine = LongestMatch(vocabulary(spec))
        _worker.clear()
        _worker[key] = _Made(machine.count)
    _worker[key] = _worker[key].aged(CACHE_WORDS)
    return _worker[key]


def count_texts(spec: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, words) of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    pieces, words = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, until - at)))
        numbered = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        known = _counts(spec)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        some = np.fromiter(map(bool, distinct), dtype=np.int64, count=len(distinct))
        index, cut = numbered.indices.to_numpy(), lists.offsets.to_numpy()
        for out, values in ((pieces, each), (words, some)):
            upto = np.r_[0, np.cumsum(values[index])]
            out[at:until] = upto[cut[1:]] - upto[cut[:-1]]
        at = until
    return pieces, words


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_words) of every row, map-only."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches):
        for batch in batches:
            pieces, words = count_texts(spec.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pieces), pa.array(words)], ["doc_id", "n_tokens", "n_words"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_words long")


def op4_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every text of ``documents``."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
