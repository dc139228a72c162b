"""Content-addressed token store (operator 7).

A store is a folder of three Parquet tables.

* ``segments``: chunk records (digest, n_ids, payload: ids as little-endian 16- or
  32-bit numbers) and reference records (which document uses which chunk at which place).
* ``recipes``: one record per document in ascending id order: start (ids of all documents
  before it), n_tokens, its chunks in order, and the Merkle leaf over their digests.
* ``manifest``: Merkle nodes over runs of BLOCK recipes, over each range of recipes, and
  the root.

Chunks end where a rolling hash of the last 16 ids has its low bits clear, so that the
same passage gives the same chunks at any offset; a digest is stored once. A worker
drops repeats within its task before anything moves, so a chunk that a third of all
documents hold crosses the network once per task at most.

Reading back checks every payload against its digest and every Merkle node against the
recipes, and takes each document's checksum from the CRCs of its chunks as read (a CRC
of a concatenation is a sum of carried CRCs), so no task has to hold a whole document.
``read_documents`` gives the ids themselves.

Edge cases: a null or empty text is the end id alone; repeated ids keep one recipe each,
in the order of the input's rows; a null id sorts first; an empty table gives an empty
store whose root is the hash of nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, ordered_start, scratch_path
from voxloom.llm.crc import carry, finish, raw_crc
from voxloom.llm.tokens import encode_all, read_spec, worker_tokenizer

END_ID = 2
DIGEST = 16
MIN_CHUNK, MASK, MAX_CHUNK = 256, 1023, 4096
#: Documents that a worker turns into records at a time.
SLICE = 1024
#: Recipes under one Merkle node.
BLOCK = 4096

ROWS = "kind byte, dealt binary, digest binary, n_ids int, payload binary, rid long, doc_id long, pos int"


def id_weights(n: int = 1 << 16) -> np.ndarray:
    """A fixed pseudo-random 32-bit number per id value (mod n)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(ids: np.ndarray, weights: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return cuts_of_many(ids, [0, len(ids)], weights)[0]


def cuts_of_many(ids: np.ndarray, bounds: list[int], weights: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of the streams ids[bounds[i]:bounds[i + 1]], from each stream's own start.

    One pass hashes all streams laid end to end. A hash looks back 16 ids and a chunk has
    at least MIN_CHUNK, so no cut depends on the stream before.
    """
    h = weights[ids & (len(weights) - 1)]
    for step in (1, 2, 4, 8):  # sums over the last 2, 4, 8, 16 ids, older ones shifted
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    found = np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1
    first = np.searchsorted(found, bounds).tolist()
    found = found.tolist()
    out = []
    for i, (start, end) in enumerate(zip(bounds, bounds[1:])):
        n, last, ends = end - start, 0, []
        for at in found[first[i] : first[i + 1]]:
            at -= start
            while at - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if at - last >= MIN_CHUNK and at < n:
                ends.append(at)
                last = at
        while n - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        ends.append(n)
        out.append(ends)
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def cut_rows(tok, spec: str, batch: pa.RecordBatch, end_id: int, weights: np.ndarray, seen: set[bytes]) -> pa.RecordBatch:
    """Reference records of a batch (rid, doc_id, text), and records of chunks not in ``seen``."""
    width = tok.width
    refs: list[list] = [[] for _ in range(6)]
    fresh: list[list] = [[] for _ in range(3)]
    raws = list(encode_all(spec, batch.column(2), tok.pack([end_id])))
    bounds = np.cumsum([0, *(len(r) // width for r in raws)]).tolist()
    every = cuts_of_many(np.frombuffer(b"".join(raws), dtype=tok.dtype), bounds, weights)
    for rid, doc_id, raw, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws, every, strict=True):
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        payloads = [raw[(b - n) * width : b * width] for b, n in zip(ends, sizes, strict=True)]
        digests = list(map(digest, payloads))
        k = len(ends)
        for column, values in zip(refs, ([rid.to_bytes(8, "big")] * k, digests, sizes, [rid] * k, [doc_id] * k, range(k)), strict=True):
            column.extend(values)
        for d, n, payload in zip(digests, sizes, payloads, strict=True):
            if d not in seen:
                seen.add(d)
                for column, value in zip(fresh, (d, n, payload), strict=True):
                    column.append(value)
    n_refs, n_fresh = len(refs[0]), len(fresh[0])
    none = [None] * n_fresh
    return pa.RecordBatch.from_arrays(
        [
            pa.array([1] * n_refs + [0] * n_fresh, pa.int8()),
            pa.array(refs[0] + fresh[0], pa.binary()),
            pa.array(refs[1] + fresh[0], pa.binary()),
            pa.array(refs[2] + fresh[1], pa.int32()),
            pa.array([None] * n_refs + fresh[2], pa.binary()),
            pa.array(refs[3] + none, pa.int64()),
            pa.array(refs[4] + none, pa.int64()),
            pa.array(refs[5] + none, pa.int32()),
        ],
        ["kind", "dealt", "digest", "n_ids", "payload", "rid", "doc_id", "pos"],
    )


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Tokenize ``docs`` (doc_id, text) into a store at ``path``."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))

    def chunked(batches):
        seen: set[bytes] = set()
        weights = id_weights()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield cut_rows(worker_tokenizer(spec.value), spec.value, batch.slice(at, SLICE), end_id, weights, seen)

    rows = bounded(docs).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(chunked, ROWS)
    # chunk records meet by digest, references by document; one exchange serves both
    first = F.row_number().over(Window.partitionBy("dealt").orderBy("kind", "pos"))
    kept = rows.withColumn("_n", first).where("kind = 1 or _n = 1").drop("_n", "dealt")
    kept.write.option("compression", "zstd").parquet(f"{path}/segments")

    refs = spark.read.parquet(f"{path}/segments").where("kind = 1").select("rid", "doc_id", "pos", "n_ids", "digest")
    recipe = refs.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n_ids", "digest"))).alias("chunks"), F.sum("n_ids").alias("n_tokens"))
    recipe = recipe.withColumn("leaf", F.sha2(F.concat_ws("", F.transform("chunks", lambda c: F.hex(c["digest"]))), 256))
    placed = ordered_start(recipe, ["doc_id", "rid"], "n_tokens", "start", keep_rank=True)
    placed.select("_range", "_rank", "rid", "doc_id", "start", "n_tokens", "chunks", "leaf").sortWithinPartitions("_range", "_rank").write.option("compression", "zstd").parquet(f"{path}/recipes")
    merkle(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def merkle(recipes: DataFrame) -> DataFrame:
    """(level, range, block, n, hash): runs of BLOCK recipes (0), ranges (1), the root (2)."""
    joined = lambda items: F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(items)), lambda x: x["h"])), 256)
    low = recipes.withColumn("block", F.floor(F.col("_rank") / F.lit(BLOCK))).groupBy(F.col("_range").alias("range"), "block").agg(joined(F.struct("_rank", F.col("leaf").alias("h"))).alias("hash"), F.count(F.lit(1)).alias("n"))
    mid = low.groupBy("range").agg(joined(F.struct("block", F.col("hash").alias("h"))).alias("hash"), F.sum("n").alias("n"))
    top = mid.agg(joined(F.struct("range", F.col("hash").alias("h"))).alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    none = F.lit(None).cast("long")
    shape = lambda df, level, r, b: df.select(F.lit(level).alias("level"), r.cast("int").alias("range"), b.cast("long").alias("block"), "n", "hash")
    return shape(low, 0, F.col("range"), F.col("block")).union(shape(mid, 1, F.col("range"), none)).union(shape(top, 2, none, none))


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Recompute every Merkle node from the recipes; raises on the first difference."""
    recipes = spark.read.parquet(f"{path}/recipes")
    leaf = F.sha2(F.concat_ws("", F.transform("chunks", lambda c: F.hex(c["digest"]))), 256)
    again, kept = merkle(recipes.withColumn("leaf", leaf)), spark.read.parquet(f"{path}/manifest")
    bad = again.join(kept, (again["level"] == kept["level"]) & again["range"].eqNullSafe(kept["range"]) & again["block"].eqNullSafe(kept["block"]) & (again["hash"] == kept["hash"]) & (again["n"] == kept["n"]), "left_anti")
    wrong = bad.limit(1).collect()
    if wrong:
        raise ValueError(f"the manifest of {path} does not match its recipes: {wrong[0]}")


def chunks(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(digest, raw, n): every stored chunk as read, checked against its digest."""

    def check(frames):
        for frame in frames:
            raws, ns = [], []
            for d, payload in zip(frame["digest"], frame["payload"], strict=True):
                if digest(payload) != d:
                    raise ValueError(f"chunk {d.hex()} of {path} is damaged")
                ids = np.frombuffer(payload, dtype=f"<u{width}").astype("<u4")
                raws.append(raw_crc(ids.tobytes()))
                ns.append(len(ids))
            yield pd.DataFrame({"digest": frame["digest"], "raw": raws, "n": ns})

    return spark.read.parquet(f"{path}/segments").where("kind = 0").select("digest", "payload").mapInPandas(check, "digest binary, raw long, n int")


def read_digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    recipes = spark.read.parquet(f"{path}/recipes").select("_range", "_rank", "doc_id", "start", "n_tokens", "chunks")
    ends = F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), c["n_ids"].alias("n_ids"), i.alias("i")))
    uses = recipes.select("_range", "_rank", "doc_id", "start", "n_tokens", F.explode(ends).alias("c")).select("_range", "_rank", "doc_id", "start", "n_tokens", "c.*")
    upto = Window.partitionBy("_range", "_rank").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    uses = uses.withColumn("after", F.coalesce(F.sum("n_ids").over(upto), F.lit(0)))
    found = uses.join(chunks(spark, path, width), "digest", "left")

    def carried(frames):
        for frame in frames:
            if frame["raw"].isna().any() or (frame["n"] != frame["n_ids"]).any():
                raise ValueError(f"a recipe of {path} names a chunk that is not in the store")
            frame["part"] = carry(frame["raw"].to_numpy().astype(np.uint32), 4 * frame["after"].to_numpy()).astype(np.int64)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame[["_range", "_rank", "doc_id", "start", "n_tokens", "n_ids", "part"]]

    parts = found.select("_range", "_rank", "doc_id", "start", "n_tokens", "n_ids", "after", "raw", "n").mapInPandas(carried, "_range int, _rank long, doc_id long, start long, n_tokens long, n_ids int, part long")
    docs = parts.groupBy("_range", "_rank", "doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("raw"), F.sum("n_ids").alias("n"))

    def finished(frames):
        for frame in frames:
            if (frame["n"] != frame["n_tokens"]).any():
                raise ValueError(f"a recipe of {path} does not add up")
            crc = finish(frame["raw"].to_numpy().astype(np.uint32), 4 * frame["n"].to_numpy()).astype(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "start": frame["start"], "n_tokens": frame["n"], "ids_crc32": crc})

    return docs.mapInPandas(finished, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids): the documents themselves, put together from their chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("_range", "_rank", "doc_id", "start", F.posexplode("chunks").alias("i", "c")).select("_range", "_rank", "doc_id", "start", "i", "c.digest")
    stored = spark.read.parquet(f"{path}/segments").where("kind = 0").select("digest", "payload")
    whole = uses.join(stored, "digest").groupBy("_range", "_rank", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("i", "payload"))).alias("parts"))

    def joined(frames):
        for frame in frames:
            ids = [np.frombuffer(b"".join(p["payload"] for p in parts), dtype=f"<u{width}").astype(np.int64) for parts in frame["parts"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "start": frame["start"], "ids": ids})

    return whole.mapInPandas(joined, "doc_id long, start long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents to a new store in the shared folder and read it back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "token-store")
    write_store(docs, path, default_tokenizer())
    verify_manifest(spark, path)
    return read_digests(spark, path)
