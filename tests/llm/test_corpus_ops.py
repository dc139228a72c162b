"""Small brute-force and edge-case tests of the corpus operators."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import audio, castore, crc, ftrl, graph_ann, langid, mixing, packing, quality, sharding, simhash, tokens, wordpiece
from voxloom.llm.common import fold, ordered_start, scratch_path

TOKENIZER = packing.default_tokenizer()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp string"
LONG = "alpha beta gamma " * 9000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, copies, repeated ids, clashing extra columns."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon.", "en", "a", 3, 9, 1, "x"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0, 0, ""),
        (4, "   \t\n ", "de", None, 1, 1, 1, "y"),
        (5, LONG, "en", "b", 1, 1, 1, "y"),
        (6, "The cat sat on the mat and looked at the moon.", "en", "b", 1, 1, 1, "z"),
        (6, "The cat sat on the mat and looked at the moon.", "en", "b", 1, 1, 1, "z"),
        (None, "Über den Wolken muß die Freiheit wohl grenzenlos sein", "de", "c", 1, 1, 1, "z"),
        (7, "12345 !!! ???", "en", "c", 1, 1, 1, "z"),
        (8, "le chat est sur la table, où est le chien ?", "fr", "é", 1, 1, 1, "z"),
        (9, "a\x1cb ~ don't <|endoftext|> ÀÉé 12ab", "xx", "c'\\q", 1, 1, 1, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_tokens_equal_the_library():
    tok, lib = tokens.WordTokenizer(tokens.read_spec(TOKENIZER)), library()
    for t in ["", " ", "don't I'll 'S", "<|endoftext|>x", "İstanbul ΣΑΣ ß ﬁ", "日本語 テスト。", "a\x1cb\x1d ~", "é é É", "a b c", "_x_ a-b", "ABC,,,d!", "x|y <|ENDOFTEXT|>"]:
        assert tok.encode(t) == tok.pack(lib.encode(t, add_special_tokens=False).ids), t


def test_ordered_start(spark):
    rows = spark.range(0, 1000).selectExpr("id % 211 AS doc_id", "id AS rid", "id % 7 AS n")
    got = sorted(ordered_start(rows, ["doc_id", "rid"], "n", "start").collect(), key=lambda r: (r.doc_id, r.rid))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n


def test_language(spark, odd, none):
    en = [(i, f"the house of the rising sun and the {w} was there with them", "en") for i, w in enumerate("dog cat moon tree bird fish star lake".split() * 6)]
    fr = [(100 + i, f"la maison est belle et le {w} était là avec eux", "fr") for i, w in enumerate("chien chat lune arbre oiseau lac".split() * 6)]
    docs = spark.createDataFrame(en + fr, "doc_id long, text string, lang string")
    model = langid.train_model(docs)
    rows = langid.identify(docs, model).select("lang", "_lang.*").collect()
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in langid.identify(odd, model).select("doc_id", "_lang.*").collect()}
    for k in (2, 3, 4, 7):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert langid.train_model(none).predict("some words") == ("und", 0.0)
    assert langid.identify(none, model).count() == 0
    # blocks count the same n-grams as the whole
    for text in (LONG, "", "a", "é" * 1999, "x" * 1000):
        whole = langid.gram_counts(text)
        old, langid.BLOCK = langid.BLOCK, 1000
        parts = langid.gram_counts(text)
        langid.BLOCK = old
        assert (parts == whole).all() and whole.sum() == 3 * (len(text) + 2) - 3


def test_rare_languages_keep_their_rows(spark):
    counts = {f"l{i}": 3000 for i in range(19)} | {"rare": 90}
    take = langid.quotas(counts, 1600)
    assert take["rare"] == 80 and sum(take.values()) == 1600
    assert langid.quotas({"a": 5, "b": 3000}, 100) == {"a": 5, "b": 95}
    docs = spark.range(5 * 3000 + 90).selectExpr("id AS doc_id", "'t' AS text", "IF(id < 90, 'rare', concat('l', cast(id % 5 AS string))) AS lang")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    got = {r["lang"]: r["count"] for r in langid._sample(docs, counts, 420).groupBy("lang").count().collect()}
    assert got == langid.quotas(counts, 420) and got["rare"] == 70


def test_temperature_lowers_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    s = rng.normal(size=(400, 3)) + 2 * np.eye(3)[y]
    t = ftrl.temperature(10 * s, y)
    assert 4 < t < 6.5  # the scores are ten times those whose best divisor is one half


def test_sharding(spark, odd, none):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', cast(id % 50 AS int)) AS text")
    rows = sharding.shard_documents(docs, 16, 256).collect()
    size = np.bincount([r.shard for r in rows], weights=[r.size for r in rows], minlength=16)
    assert len(rows) == 3000 and size.max() / size.min() < 1.05
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    got = {r.doc_id: r for r in sharding.shard_documents(odd, 4, 16).collect()}
    assert got[2].size == 1 and got[3].size == 1 and got[1].size == 47
    assert got[1].text_crc32 == zlib.crc32(b"The cat sat on the mat and looked at the moon.")
    assert sharding.shard_documents(none, 4, 16).count() == 0
    # rebalancing to one more shard moves slots only into it
    loads = [(i, 10 + i % 3, 1) for i in range(64)]
    old = sharding.initial_map(loads, 4)
    new = sharding.rebalance(old, loads, 5)
    moved = [(a[2], b[2]) for a, b in zip(old, new) if a[2] != b[2]]
    assert moved and all(b == 4 for _, b in moved) and new[0][0] == 1
    path = scratch_path(spark, "map")
    for rows in (old, new, old, new):  # a version stored again is not doubled
        sharding.save_map(spark, rows, path)
    assert sharding.load_map(spark, path).select("version").distinct().collect()[0][0] == 1
    assert sharding.load_map(spark, path, 0).count() == 64


def test_sharding_stores_loads_and_edits_its_map(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('ab ', cast(id % 50 AS int)) AS text")
    path = scratch_path(spark, "map")
    first = {r.doc_id: r for r in sharding.shard_documents(docs, 8, 256, path).collect()}
    again = {r.doc_id: r for r in sharding.shard_documents(docs, 8, 256, path).collect()}
    assert again == first and spark.read.parquet(path).count() == 256  # nothing moved: no new version
    # another number of shards edits the map: little more moves than the new shard holds
    grown = {r.doc_id: r for r in sharding.shard_documents(docs, 9, 256, path).collect()}
    moved = [k for k in first if grown[k].shard != first[k].shard]
    size = np.bincount([r.shard for r in grown.values()], weights=[r.size for r in grown.values()])
    assert 0.1 < len(moved) / 4000 < 0.2 and size.max() / size.min() < 1.1
    assert spark.read.parquet(path).where("version = 1").count() == 256
    assert all(grown[k].virtual_slot == first[k].virtual_slot for k in first)
    # the map is what places the rows
    other = [(2, s, (r + 1) % 9, b, n) for _, s, r, b, n in sharding.stored_map(spark, path)]
    sharding.save_map(spark, other, path)
    turned = {r.doc_id: r for r in sharding.assign(sharding.sized(docs, 256).withColumn("_row", F.monotonically_increasing_id()), sharding.load_map(spark, path)).collect()}
    assert all(turned[k].shard == (grown[k].shard + 1) % 9 for k in grown)
    # one record repeated very often: still a gapless place for each row
    same = spark.range(5000).selectExpr("7 AS doc_id", "'same' AS text")
    rows = sharding.shard_documents(same, 4, 16).collect()
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(4)) and len({r.virtual_slot for r in rows}) == 16
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 8, 128, path)


def test_mixing(spark, odd, none):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', cast(id % 4 AS string)) AS source", "repeat('w ', cast(1 + (id * 7) % 90 AS int)) AS text")
    rows = mixing.mix_documents(docs).collect()
    assert rows == mixing.mix_documents(docs).collect() or sorted(rows) == sorted(mixing.mix_documents(docs).collect())
    total = sum(r._size for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [r._source_size, r._target, 0])
        s[2] += r._size * r._copies
        assert 0 <= r._copies <= 2
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * total) < 1e-3
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 90
    got = mixing.mix_documents(odd).collect()
    assert len(got) == 11 and all(r._size * r._copies <= 2 * r._size for r in got)
    assert mixing.mixed(none).count() == 0
    assert mixing.added(["_size", "__size", "a"]) == ["___size", "_source_size", "_target", "_copies"]
    named = odd.withColumns({"_size": F.lit("kept"), "_rank": F.lit(5)})
    assert {(r["_size"], r["_rank"]) for r in mixing.mixed(named).collect()} == {("kept", 5)}
    clash = odd.withColumns({c: F.lit(1) for c in ("rate", "k", "start", "_rank", "mean", "target", "source_size")})
    again = mixing.mix_documents(clash)
    assert sorted(again.select("doc_id", "_size", "_copies").collect(), key=str) == sorted(mixing.mix_documents(odd).select("doc_id", "_size", "_copies").collect(), key=str)


def brute_targets(sizes):
    """Targets by the rule itself: fix what exceeds its cap, share the rest again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = budget - sum(fixed.values())
        got = {s: share * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if got[s] > 2 * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets_equal_the_rule(spark):
    rng = np.random.default_rng(13)
    for n in (1, 2, 3, 7, 20):
        sizes = {(None if i == 0 else f"s{i}" if i % 2 else f"é{i}"): int(rng.integers(0, 10 ** rng.integers(1, 6))) for i in range(n)}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix_has_the_tilted_rates(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('s', cast(id % 5 AS string))) AS source", "repeat('w ', cast(1 + (id * 7) % 90 AS int)) AS text")
    rows = mixing.mix_documents(docs).toPandas()
    for _, g in rows.groupby("source"):
        mean, target, full = g["_size"].mean(), g["_target"].iloc[0], g["_target"].iloc[0] >= 2 * g["_source_size"].iloc[0]
        lo, hi = -64.0, 64.0
        for _ in range(200):  # bisection on the one multiplier
            lam = (lo + hi) / 2
            rate = np.minimum(2.0, np.exp(np.minimum(lam * g["_size"] / mean, 1.0)))
            lo, hi = (lo, lam) if (rate * g["_size"]).sum() > target else (lam, hi)
        rate = 2.0 if full else rate
        assert abs((g["_size"] * g["_copies"]).sum() - target) <= 90
        # copies are the floor or the ceiling of the rate
        assert (np.abs(g["_copies"] - rate) < 1 + 1e-4).all()


def test_longest_match():
    def greedy(word, vocab):
        n, at = 0, 0
        while at < len(word):
            k = next((k for k in range(len(word), at, -1) if word[at:k] in vocab), None)
            if k is None:
                return 1
            n, at = n + 1, k
        return n

    rng = np.random.default_rng(3)
    for trial in range(60):
        vocab = {bytes(rng.integers(97, 100, rng.integers(1, 5))) for _ in range(8)}
        if trial % 2:
            vocab |= {b"a", b"b", b"c"}
        machine = wordpiece.LongestMatch(sorted(vocab))
        for _ in range(60):
            word = bytes(rng.integers(97, 100, rng.integers(0, 12)))
            assert machine.count(word) == (greedy(word, vocab) if word else 0), (word, vocab)
    first, rest = [b"un", b"a", b"u", b"n", b"f"], [b"aff", b"able", b"a", b"f", b"b"]
    assert wordpiece.LongestMatch(first, rest).count(b"unaffable") == 3
    assert wordpiece.LongestMatch(first, rest).count(b"unz") == 1


def test_token_counts_edges(odd, none):
    got = {r.doc_id: r for r in wordpiece.token_counts(odd, TOKENIZER).collect()}
    assert (got[2].n_tokens, got[3].n_tokens, got[4].n_tokens) == (0, 0, 0)
    assert got[5].n_words == 27000 and wordpiece.token_counts(none, TOKENIZER).count() == 0


def test_quality(spark, odd, none):
    good = [(i, f"the {w} sat by the quiet river and looked at the moon") for i, w in enumerate("dog cat bird fish".split() * 20)]
    bad = [(200 + i, f"{w}$$$ {w}### {w}%%% {w}$$$ {w}***") for i, w in enumerate("dog cat bird fish".split() * 20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train_model(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert all((r._quality >= 0.3) == (r.doc_id < 200) for r in rows)
    assert all(0 <= r._quality <= 1 for r in quality.scored(odd, model).collect())
    assert quality.train_model(docs, labels.limit(0)).score("x") > 0.99
    assert quality.scored(none, model).count() == 0


def test_quality_learns_from_labelled_documents_only(spark):
    good = [(i, f"the {w} sat by the quiet river and looked at the moon") for i, w in enumerate("dog cat bird fish".split() * 12)]
    bad = [(200 + i, f"{w}$$$ {w}### {w}%%% {w}$$$ {w}***") for i, w in enumerate("dog cat bird fish".split() * 12)]
    docs = spark.createDataFrame(good + bad + good[:3], "doc_id long, text string")
    labels = spark.range(1000, 30000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").union(spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int"))
    model = quality.train_model(docs, labels)
    assert all((r._quality >= 0.3) == (r.doc_id < 200) for r in quality.scored(docs, model).collect())
    one = quality.train_model(docs, labels.where("doc_id < 200 OR doc_id >= 1000"))
    assert one.score("x") > 0.99  # of these documents all have label 1
    at, v = quality.merged(np.array([5, 2, 5]), np.array([1.0, 2.0, 3.0]))
    assert at.tolist() == [2, 5] and v.tolist() == [2.0, 4.0]


def test_audio():
    rate, t = 8000, np.arange(8000 * 6) / 8000
    rng = np.random.default_rng(5)
    notes = 220 * 2 ** (rng.integers(0, 24, 60) / 12)
    song = np.concatenate([np.sin(2 * np.pi * f * t[:800]) for f in notes]).astype(np.float32)
    other = np.concatenate([np.sin(2 * np.pi * f * t[:800]) for f in 220 * 2 ** (rng.integers(0, 24, 60) / 12)]).astype(np.float32)
    fp = audio.fingerprint(audio.chroma(song, rate))
    cut = audio.fingerprint(audio.chroma(song[16 * 400 : 16 * 1500] + rng.normal(0, 0.01, 16 * 1100).astype(np.float32), rate))
    hit = audio.References({1: fp, 2: audio.fingerprint(audio.chroma(other, rate))})
    assert audio.bit_error(cut, fp, -400)[0] < audio.MAX_ERROR  # noise added, so not zero
    refs = audio.References({7: cut})
    assert refs.best(fp)[:2] == (7, 400)
    assert refs.best(audio.fingerprint(audio.chroma(other, rate))) is None
    assert len(hit.ids) == 2 and len(audio.media_print(None)) == 0 and len(audio.media_print(b"")) == 0
    assert len(audio.media_print(b"RIFF1234JUNK")) == 0 and len(audio.media_print(b"ab")) == 1


def wav(x, rate):
    import struct

    pcm = (x * 32000).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def test_audio_of_two_rates_aligns(spark):
    rng = np.random.default_rng(21)
    notes, others = (220 * 2 ** (rng.integers(0, 24, (30, 2)) / 12) for _ in range(2))

    def play(notes, rate):
        t = np.arange(int(0.4 * rate)) / rate
        return np.concatenate([0.4 * (np.sin(2 * np.pi * a * t) + np.sin(2 * np.pi * b * t)) for a, b in notes])

    high, low = play(notes, 44100), play(notes, 8000)
    clip = high[int(3.07 * 44100) : int(9.2 * 44100)]
    refs = spark.createDataFrame([(1, bytearray(wav(clip, 44100))), (2, bytearray(wav(play(others, 22050)[: 22050 * 6], 22050))), (3, bytearray(wav(clip[:4410], 44100)))], "id long, media binary")
    media = spark.createDataFrame([(7, bytearray(wav(low, 8000))), (8, bytearray(wav(high, 44100))), (9, bytearray(wav(play(others, 8000), 8000))), (10, bytearray(b"RIFF----WAVEjunk"))], "id long, media binary")
    got = {r.key: r for r in audio.align(media, "id", "media", audio.fingerprints(refs, "id", "media")).collect()}
    for k in (7, 8):
        assert got[k].ref_id == 1 and abs(got[k].matches[0].ref_sample / audio.SOUND.rate - 3.07) < 0.1, got[k]
        assert {m.ref_id for m in got[k].matches} == {1}
    assert got[9].ref_id == 2 and abs(got[9].matches[0].ref_sample) < 0.1 * audio.SOUND.rate
    assert got[10].n_ints == 0 and got[10].ref_id is None
    assert len(audio.resampled(np.zeros(44100, dtype=np.float32), 44100, 11025)) == 11025 and len(audio.resampled(np.zeros(8000, dtype=np.float32), 8000, 11025)) == 11025


def brute_print(c):
    """Filter values by plain sums over rectangles of chroma frames, bit by bit."""
    wide, out = np.hstack([c, c]).astype(float), []
    for at in range(len(c) - audio.SPAN + 1):
        code = 0
        for kind, y, h, w in audio.filters():
            mean = lambda t0, t1, y0, y1, at=at: max(wide[at + t0 : at + t1, y0:y1].sum(), 0) / ((t1 - t0) * (y1 - y0)) + audio.FLOOR
            half, quarter, mid = w // 2, max(1, w // 4), h // 2
            ratio = [
                lambda: mean(half, w, y, y + h) / mean(0, half, y, y + h),
                lambda: (mean(0, half, y + mid, y + h) + mean(half, w, y, y + mid)) / (mean(0, half, y, y + mid) + mean(half, w, y + mid, y + h)),
                lambda: 2 * mean(quarter, w - quarter, y, y + h) / (mean(0, quarter, y, y + h) + mean(w - quarter, w, y, y + h)),
                lambda: mean(0, w, y + mid, y + h) / mean(0, w, y, y + mid),
                lambda: mean(0, w, y, y + h) / mean(0, w, 0, 12),
            ][kind]()
            code = code << 2 | audio.GRAY[sum(np.log(ratio) > cut for cut in audio.CUTS)]
        out.append(code)
    return out


def test_audio_filters_against_plain_sums():
    x = audio.raw_pcm8(bytes(np.random.default_rng(22).integers(0, 256, 900).astype(np.uint8)))
    c = audio.chroma(x)
    assert audio.fingerprint(c).tolist() == brute_print(c)


def test_audio_query_edges(spark, odd, none):
    media = odd.withColumn("media", odd["text"].cast("binary"))
    refs = audio.fingerprints(media.where("doc_id = 5"), "doc_id", "media")
    got = {r.key: r for r in audio.align(media, "doc_id", "media", refs).collect()}
    assert got[5].ref_id == 5 and got[5].bit_error == 0 and got[2].n_ints == 0 and got[2].ref_id is None
    assert audio.align(none.withColumn("media", none["text"].cast("binary")), "doc_id", "media", refs).count() == 0
    old, audio.BLOCK_INTS = audio.BLOCK_INTS, 1000
    try:
        again = {r.key: r for r in audio.align(media, "doc_id", "media", refs).collect()}
    finally:
        audio.BLOCK_INTS = old
    assert again == got


def test_audio_finds_short_references_at_every_sample():
    rng = np.random.default_rng(11)
    text = lambda n: rng.choice(np.frombuffer(b"etaoinshrdlu  ", np.uint8), n).tobytes()
    for size in (12, 40, 81, 130, 200, 223, 230, 240, 400):
        ref, other = text(size), text(size)
        heard = audio.raw_pcm8(ref)
        shifted = [audio.fingerprint(audio.chroma(heard[p:])).astype("<u4").tobytes() for p in range(audio.HOP)]
        refs = audio.load([{"key": 3, "shifted": shifted, "samples": heard.tobytes() if size < audio.LONG else None, "rate": audio.RATE}])
        for before in range(100, 116):
            x = audio.raw_pcm8(text(before) + ref + text(150))
            found = refs.matches(audio.fingerprint(audio.chroma(x)), x, audio.RATE)
            assert (0, before) in {(r, at) for _, _, r, at in found}, (size, before)
            x = audio.raw_pcm8(text(before) + other + text(150))
            assert size < 81 or not refs.matches(audio.fingerprint(audio.chroma(x)), x, audio.RATE)


def test_audio_finds_every_reference_and_place(spark):
    rng = np.random.default_rng(12)
    text = lambda n: bytes(rng.choice(np.frombuffer(b"etaoinshrdlu  ", np.uint8), n)).decode()
    a, b, c, d = text(90), text(300), text(260), text(500)
    media = spark.createDataFrame([(1, text(37) + a + text(50) + b + text(61) + a + text(20) + c + text(33) + b), (2, text(700)), (3, d[:490])], "doc_id long, text string")
    named = spark.createDataFrame([(1, a), (2, b), (2, c), (2, c), (None, d)], "item_id long, text string")
    as_media = lambda t: t.withColumn("media", t["text"].cast("binary"))
    texts = {r.doc_id: r.text for r in media.collect()}
    old = audio.BLOCK_INTS
    for block in (old, 300):
        audio.BLOCK_INTS = block
        try:
            got = {r.key: r for r in audio.align(as_media(media), "doc_id", "media", audio.fingerprints(as_media(named), "item_id", "media")).collect()}
        finally:
            audio.BLOCK_INTS = old
        want = {(k, at) for k, t in ((1, a), (2, b), (2, c)) for at in range(len(texts[1])) if texts[1].startswith(t, at)}
        assert len(want) == 5 and want <= {(m.ref_id, m.ref_sample) for m in got[1].matches}
        assert len({(m.ref_id, m.ref_sample) for m in got[1].matches}) == len(got[1].matches)
        assert got[2].matches == [] and got[2].ref_id is None
        assert (None, 0) in {(m.ref_id, m.ref_sample) for m in got[3].matches} and got[3].bit_error == 0


def test_crc_of_parts():
    rng = np.random.default_rng(2)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 900, 9)]
    whole, raw, after = b"".join(parts), 0, 0
    for p in reversed(parts):
        raw ^= int(crc.carry(np.array([crc.raw_crc(p)]), np.array([after]))[0])
        after += len(p)
    assert int(crc.finish(np.array([raw]), np.array([len(whole)]))[0]) == zlib.crc32(whole)


def test_store_round_trip(spark, odd, none):
    path = scratch_path(spark, "store")
    castore.write_store(odd, path, TOKENIZER)
    castore.verify_manifest(spark, path)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    read = sorted(castore.read_documents(spark, path).collect(), key=lambda r: r.start)
    digests = sorted(castore.read_digests(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, x, d in zip(rows, read, digests, strict=True):
        ids = ids_of(r.text)
        assert x.doc_id == r.doc_id and x.ids == ids.tolist() and x.start == at
        assert (d.doc_id, d.start, d.n_tokens, d.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    stored = spark.read.parquet(f"{path}/segments").where("kind = 0")
    assert stored.count() == stored.select("digest").distinct().count()
    empty = scratch_path(spark, "store")
    castore.write_store(none, empty, TOKENIZER)
    castore.verify_manifest(spark, empty)
    assert castore.read_digests(spark, empty).count() == 0
    bad = scratch_path(spark, "store")
    for part in ("segments", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    spark.read.parquet(f"{path}/recipes").where("doc_id <> 5").write.parquet(f"{bad}/recipes")
    with pytest.raises(ValueError):
        castore.verify_manifest(spark, bad)


def test_packing(spark, odd, none):
    rows = packing.pack_documents(odd, TOKENIZER, capacity=512, unit=8).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    got = {}
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert all(n == len(ids_of(texts[d])) * (2 if d == 6 else 1) for d, n in got.items())
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(4)
    counts = {int(c): int(n) for c, n in zip(*np.unique(rng.integers(1, 60, 3000), return_counts=True))}
    plan = packing.plan_patterns(counts, 64)
    held = {}
    for pattern, times in plan:
        assert sum(c * n for c, n in pattern.items()) <= 64
        for c, n in pattern.items():
            held[c] = held.get(c, 0) + n * times
    assert held == counts
    # items over half a bin can't share one
    bound = max(-(-sum(c * n for c, n in counts.items()) // 64), sum(n for c, n in counts.items() if c > 32))
    assert sum(t for _, t in plan) <= 1.02 * bound + 2


def brute_fingerprint(text, k=3):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd, none):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    texts += [t.replace(" ", "  ", 1).upper() for t in texts[:10]] + [" ".join([*t.split()[:-1], "end"]) for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (simhash.TILE, 7):
        old, simhash.TILE = simhash.TILE, size
        try:
            got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
        finally:
            simhash.TILE = old
        fp = [brute_fingerprint(t) for t in texts]
        root = list(range(len(texts)))
        for _ in texts:
            for i in range(len(texts)):
                for j in range(len(texts)):
                    if bin(fp[i] ^ fp[j]).count("1") <= 3:
                        root[i] = root[j] = min(root[i], root[j])
        assert [got[i].component_id for i in range(len(texts))] == root
        assert [int.from_bytes(got[i].fp, "big") for i in range(len(texts))] == fp
    edge = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert edge[2].component_id == edge[3].component_id == edge[4].component_id == 2
    assert int.from_bytes(edge[2].fp, "big") == 0 and edge[6].component_id == 1
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_links_texts_not_ids(spark):
    rng = np.random.default_rng(16)
    words = [f"w{i}" for i in range(400)]
    one, two = (" ".join(rng.choice(words, 300)) for _ in range(2))
    near = one + " end"
    assert bin(brute_fingerprint(one) ^ brute_fingerprint(near)).count("1") <= 3 < bin(brute_fingerprint(one) ^ brute_fingerprint(two)).count("1")
    docs = spark.createDataFrame([(None, one), (None, two), (3, near), (4, one), (4, two)], "doc_id long, text string")
    got = {(r.doc_id, int.from_bytes(r.fp, "big")): r.component_id for r in simhash.near_duplicates(docs).collect()}
    a, b, c = (brute_fingerprint(t) for t in (one, two, near))
    assert got == {(None, a): 3, (3, c): 3, (4, a): 3, (None, b): 4, (4, b): 4}
    lone = spark.createDataFrame([(None, one), (None, one)], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(lone).collect()] == [None, None]


def test_pipeline_drops_only_similar_texts(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(3000)])
    texts = ["", " ", "one two"]
    for _ in range(60):
        base = rng.choice(words, 120)
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5):
            other = base.copy()
            other[rng.choice(120, changes, replace=False)] = "zz"
            texts.append(" ".join(other))
    for n in (5, 6, 8, 9, 12):  # short texts
        base = rng.choice(words, n)
        texts += [" ".join(base), " ".join(base[:-1])]
    # one line, often repeated, in texts that share nothing else
    line = "the same line of five words and more "
    texts += [line * 40 + " ".join(rng.choice(words, 60)) for _ in range(6)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for size in (simhash.SET_TILE, 7):
        old, simhash.SET_TILE = simhash.SET_TILE, size
        try:
            kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
        finally:
            simhash.SET_TILE = old
        assert kept == set(root)


def test_graph_search(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (None, v[0].tolist()), (2060, []), (5, v[5].tolist()), (2080, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    old, graph_ann.SHARD_ROWS = graph_ann.SHARD_ROWS, 300
    try:
        got = graph_ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    finally:
        graph_ann.SHARD_ROWS = old
    score = v.astype(float) @ v.astype(float).T
    hit = n = 0
    for q in range(0, 900, 20):
        s = score[q].copy()
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - score[q, r.vec_id]) < 1e-9 for r in mine)
        hit, n = hit + len({r.vec_id for r in mine} & set(want.tolist())), n + 20
        if q in range(100, 160):
            assert [r.vec_id for r in mine] == want.tolist()
    assert hit / n >= 0.95
    assert {r.query_id for r in got} <= set(range(0, 900, 20))
    assert graph_ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_graph_ties_go_to_the_smaller_id(spark):
    # distinct vectors of equal score to the queries: the first component decides, the rest differ
    rows = [(0, [1.0] + [0.0] * 8)] + [(i, [1.0] + [float(i >> b & 1) for b in range(8)]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(graph_ann.nearest(df, F.col("vec_id") == 0, 20).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}
    old, graph_ann.SHARD_ROWS = graph_ann.SHARD_ROWS, 60
    try:
        got = sorted(graph_ann.nearest(df, F.col("vec_id") == 0, 20).collect(), key=lambda r: r["rank"])
    finally:
        graph_ann.SHARD_ROWS = old
    assert [r.vec_id for r in got] == list(range(1, 21))


def test_graph_keeps_doubles(spark):
    rng = np.random.default_rng(18)
    v = rng.normal(size=(120, 6)) * np.array([1.0, 1.0, 1.0, 1.0, 1.0, 1e-9])
    df = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for x in (v, v * 1e140, np.vstack([v, [1e300, 0, 0, 0, 0, 0]])):
        with np.errstate(over="ignore"):
            score = x @ x.T
        for q in (0, 20):
            got = sorted((r for r in graph_ann.nearest(df(x), F.col("vec_id") % 20 == 0, 20).where(F.col("query_id") == q).collect()), key=lambda r: r["rank"])
            assert len(got) == 20 and all(r.score == pytest.approx(score[q, r.vec_id], rel=1e-12) for r in got)
            want = np.lexsort((np.arange(len(x)), -np.where(np.arange(len(x)) == q, -np.inf, score[q])))[:20]
            assert [r.vec_id for r in got] == want.tolist()


def test_fold(spark):
    got = spark.range(50).select("id", fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_cuts_do_not_depend_on_the_stream_before():
    rng = np.random.default_rng(9)
    weights = castore.id_weights()
    streams = [rng.integers(0, 49408, n).astype("<u2") for n in (0, 1, 255, 256, 257, 20000, 3, 9000)]
    bounds = np.cumsum([0, *map(len, streams)]).tolist()
    many = castore.cuts_of_many(np.concatenate(streams), bounds, weights)
    assert many == [castore.cuts(s, weights) for s in streams]
    for s, ends in zip(streams, many):
        assert ends[-1] == len(s) and all(0 < b - a <= castore.MAX_CHUNK for a, b in zip([0, *ends], ends) if len(s))
    # the same passage is cut alike after another beginning
    tail = streams[5]
    moved = castore.cuts(np.concatenate([streams[7], tail]), weights)
    shared = {e - 9000 for e in moved} & set(many[5])
    assert len(shared) >= len(many[5]) - 3
