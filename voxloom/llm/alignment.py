"""Cross-tokenizer alignment (operator 12): groups of tokens of two tokenizers that cover the same bytes.

Tokenizer A (a byte-level BPE file) reads a space and the text, tokenizer B (a piece model) the text, to
which it adds the space. Every byte of the text gets a label: none, end of an A token, end of a B
token, or both. A pattern scans the labels for spans up to each both-label; the labels in a span
count the tokens of one group. The last tokens of a group are a link, and a link's weight is
the number of links of the whole corpus between the same two ids.

* A's merges stand in the order of its ids, so a rank-based encoder made of the same file gives the same ids
  several times faster; it takes texts of Latin letters and common marks. All others, and files whose merges
  stand otherwise, go through the tokenizers library.
* Of two linked ids one's bytes end with the other's, so an id has at most one partner a byte of its own
  length: all id pairs that can ever be linked are some 600,000, known from the vocabularies alone.
  Their counts are a table of fixed size, which every task adds up on its own and which is sent to all.

Edge cases: a null or empty text, and one that a tokenizer does not give back byte by byte, has no tokens (zeros,
empty groups); ties for an id's best partner all count; repeated rows count each; an
empty table gives no rows; extra columns are ignored. A text is encoded in one call; nothing is kept between texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, materialise
from voxloom.llm.tokens import _byte_letters, read_spec

TOKENS = "doc_id {id}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, n_bytes array<int>"
#: Texts that the rank-based encoder takes: characters of which all libraries know the class.
PLAIN = re.compile("[\t\n\r -~\u00a0-\u024f\u2010-\u2027]*")
#: Bytes of text whose tokens are lists at one time.
RUN = 1 << 18
#: Labels: '.' none, 'a' an A token ends here, 'b' a B token, '|' both.
LABELS = np.frombuffer(b".ab|", dtype=np.uint8)
SPAN = re.compile(rb"[^|]*\|")
MARK = "▁"
#: The pattern by which a byte-level file cuts texts: a fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def entry_bytes(spec: str) -> list[bytes]:
    """Bytes of every entry of a byte-level file, by id."""
    raw = json.loads(spec)
    byte_of = {c: b for b, c in _byte_letters().items()}
    out = {i: bytes(byte_of[c] for c in token) for token, i in raw["model"]["vocab"].items() if token not in {t["content"] for t in raw["added_tokens"]}}
    out |= {t["id"]: t["content"].encode() for t in raw["added_tokens"]}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def piece_bytes(model) -> list[bytes]:
    """Bytes of every piece, by id."""
    n = model.get_piece_size()
    return [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]


def pair_keys(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys (a << 32 | b) of all id pairs of which one's bytes end with the other's."""

    def by_bytes(entries: list[bytes]) -> dict[bytes, list[int]]:
        held: dict[bytes, list[int]] = {}
        for i, e in enumerate(entries):
            held.setdefault(e, []).append(i)
        return held

    of_a, of_b = by_bytes(a), by_bytes(b)
    keys = {i << 32 | j for i, e in enumerate(a) for k in range(len(e)) for j in of_b.get(e[k:], ())}
    keys |= {i << 32 | j for j, e in enumerate(b) for k in range(len(e)) for i in of_a.get(e[k:], ())}
    return np.array(sorted(keys), dtype=np.int64)


class Pair:
    """Both tokenizers, with the bytes of their entries."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        self.spec, self.library = spec, None
        self.b = SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = entry_bytes(spec), piece_bytes(self.b)
        self.len_a, self.len_b = (np.array([len(e) for e in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.ranks = self._ranks(json.loads(spec))

    def _ranks(self, raw: dict):
        """A rank-based encoder of the file, if its merges stand in the order of their ids and its pattern is the known one."""
        import tiktoken

        vocab, special = raw["model"]["vocab"], {t["id"] for t in raw["added_tokens"]}
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in raw["model"]["merges"]]
        pre = raw["pre_tokenizer"]
        if raw["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or any(vocab[m] != 256 + i for i, m in enumerate(joined)):
            return None
        ranks = {e: i for i, e in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, text: str) -> list[int]:
        if self.ranks and PLAIN.fullmatch(text):
            return self.ranks.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def text(self, text: str | None) -> tuple[bytes, ...]:
        """a_ids, b_ids, a_sizes, b_sizes and n_bytes as 32-bit numbers; empty if a tokenizer loses bytes."""
        if not text:
            return (b"",) * 5
        raw = (" " + text).encode()
        a, b = self.ids_a(" " + text), self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return (b"",) * 5
        a, b = np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)
        label = np.zeros(len(raw), dtype=np.uint8)
        label[np.cumsum(self.len_a[a]) - 1] += 1
        label[np.cumsum(self.len_b[b]) - 1] += 2
        sizes = np.fromiter(map(len, SPAN.findall(LABELS[label].tobytes())), dtype=np.int64)
        # labels of each tokenizer up to a span's end, that of both among them
        upto = np.cumsum(sizes) - 1
        counts = (np.diff(np.cumsum((label & bit) > 0)[upto], prepend=0) for bit in (1, 2))
        return (a.tobytes(), b.tobytes(), *(x.astype(np.int32).tobytes() for x in (*counts, sizes)))


_worker: dict[int, Pair] = {}


def worker_pair(files: Broadcast) -> Pair:
    """The process's pair for these files' content, made once."""
    key = hash(files.value)
    if key not in _worker:
        _worker.clear()
        _worker[key] = Pair(*files.value)
    return _worker[key]


def _lists(runs: list[bytes]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(r) // 4 for r in runs])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(runs), dtype=np.int32)))


def slices(batch: pa.RecordBatch, sizes: pa.Array):
    """Parts of a batch of about RUN bytes each, so that lists of numbers never exist for more than one part."""
    ends = np.cumsum(np.asarray(sizes.fill_null(0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, side="right")))
        yield batch.slice(at, until - at)
        at = until


def aligner(files: Broadcast):
    """Maps batches (doc_id, text) to batches of TOKENS."""

    def kernel(batches):
        pair = worker_pair(files)
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("text"))):
                runs = [pair.text(t) for t in part.column("text").to_pylist()]
                columns = [_lists([r[k] for r in runs]) for k in range(5)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes", "n_bytes"])
        # an idle worker keeps no buffers
        pa.default_memory_pool().release_unused()

    return kernel


def _texts(docs: DataFrame) -> DataFrame:
    return bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")))


def align_tokens(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """Per row of ``docs``: doc_id, the ids of both tokenizers, and the numbers of A tokens, B tokens and bytes of each group."""
    files = docs.sparkSession.sparkContext.broadcast((spec, model))
    return _texts(docs).mapInArrow(aligner(files), TOKENS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _links(batch: pa.RecordBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``keys`` of the pair of each link of a batch, and the ends of each row's links."""
    ids = {s: np.asarray(batch.column(f"{s}_ids").flatten()).astype(np.int64) for s in "ab"}
    last = {s: np.cumsum(np.asarray(batch.column(f"{s}_sizes").flatten()), dtype=np.int64) - 1 for s in "ab"}
    found = np.searchsorted(keys, ids["a"][last["a"]] << 32 | ids["b"][last["b"]])
    return found, np.r_[0, np.cumsum(np.asarray(batch.column("a_sizes").value_lengths()), dtype=np.int64)]


def linked_documents(docs: DataFrame, spec: str, model: bytes, keys: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_a, n_b, the digest of the groups, and ``links``, the place in ``keys`` of each link's pair, 32 bits each.

    All of it comes from the batches of ``align_tokens``, read in the same worker: the lists themselves don't leave it.
    """
    context = docs.sparkSession.sparkContext
    files, sent = context.broadcast((spec, model)), context.broadcast(keys)
    align = aligner(files)

    def kernel(batches):
        for batch in align(batches):
            links, ends = _links(batch, sent.value)
            lists = {c: (np.asarray(batch.column(c).flatten()).astype(np.int64), np.r_[0, np.cumsum(np.asarray(batch.column(c).value_lengths()), dtype=np.int64)]) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")}
            digests = []
            for i in range(batch.num_rows):
                part = [v[e[i] : e[i + 1]] for v, e in lists.values()]
                digests.append(hashlib.sha256(group_text(*part)).hexdigest() if len(part[0]) else "")
            raw = links.astype("<i4").tobytes()
            held = [raw[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            sizes = [pa.array(np.diff(lists[c][1])) for c in ("a_ids", "b_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *sizes, pa.array(digests, pa.string()), pa.array(held, pa.binary())], ["doc_id", "n_a", "n_b", "groups_sha256", "links"])

    return _texts(docs).mapInArrow(kernel, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, groups_sha256 string, links binary")


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of all links of a batch, and the ends of each row's."""
    held = batch.column("links").to_pylist()
    return np.frombuffer(b"".join(held), dtype="<i4"), np.r_[0, np.cumsum([len(h) // 4 for h in held], dtype=np.int64)].astype(np.int64)


def pair_counts(linked: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Links of the whole corpus by place in ``keys``. Each task sends one row a pair it met: at most len(keys)."""
    size = len(keys)

    def kernel(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_places(batch)[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    found = bounded(linked.select("links")).mapInArrow(kernel, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[found["k"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def best_of_b(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id."""
    b = keys & 0xFFFFFFFF
    most = np.zeros(int(b.max()) + 1 if len(b) else 0, dtype=np.int64)
    np.maximum.at(most, b, counts)
    return (counts == most[b]) & (counts > 0)


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> bytes:
    """Groups as decimal ids: ``a1,a2|b1;a3|b2,b3``."""
    n = len(a_ids) + len(b_ids)
    ids, mark = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    whole = a_sizes + b_sizes
    start = np.cumsum(whole) - whole
    at_a = np.repeat(start - (np.cumsum(a_sizes) - a_sizes), a_sizes) + np.arange(len(a_ids))
    at_b = np.repeat(start + a_sizes - (np.cumsum(b_sizes) - b_sizes), b_sizes) + np.arange(len(b_ids))
    ids[at_a], ids[at_b] = a_ids, b_ids
    mark[start + a_sizes - 1], mark[start + whole - 1] = 1, 2
    text = b"".join([_ENTRIES[x] for x in (ids * 3 + mark).tolist()])
    return text[:-1]


class _Decimal(dict):
    def __missing__(self, key: int) -> bytes:
        self[key] = found = b"%d" % (key // 3) + (b",", b"|", b";")[key % 3]
        return found


#: id * 3 + mark -> the id in decimal digits and the mark after it; three entries an id at most.
_ENTRIES = _Decimal()


def summary(linked: DataFrame, keys: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Per row: numbers of tokens, groups and links, links of the best pair of their B id, summed counts and the digest of the groups."""
    sent = linked.sparkSession.sparkContext.broadcast((counts, best_of_b(keys, counts).astype(np.int64)))

    def kernel(batches):
        for batch in batches:
            places, ends = _places(batch)
            total, good = (np.r_[0, np.cumsum(x[places], dtype=np.int64)][ends] for x in sent.value)
            groups = pa.array(np.diff(ends))
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b")] + [groups, groups, pa.array(np.diff(good)), pa.array(np.diff(total)), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"doc_id {linked.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return bounded(linked).mapInArrow(kernel, schema)


def tokenizer_files() -> tuple[str, bytes]:
    """The two files of the registered query."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return read_spec(public_tokenizers.path("byte_bpe_50k.json")), f.read()


def align(docs: DataFrame, spec: str, model: bytes) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(links of every document, id pairs, their links in the corpus)."""
    from sentencepiece import SentencePieceProcessor

    keys = pair_keys(entry_bytes(spec), piece_bytes(SentencePieceProcessor(model_proto=model)))
    linked = materialise(linked_documents(docs, spec, model, keys), "linked")
    return linked, keys, pair_counts(linked, keys)


def op12_byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and their corpus-wide counts of all documents."""
    return summary(*align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_files()))
