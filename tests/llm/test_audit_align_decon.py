"""Divergence audit, token alignment and decontamination against SQL and brute force, with their edge cases."""

import functools
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.oracle import compare, connect
from voxloom.llm import alignment, divergence, queries, winnowing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, value long, rank int, item string, pos int, w string, windows string"
LONG = "alpha Beta gamma, " * 9000
TEXTS = [
    "The cat sat on the mat and looked at the moon.", None, "", "   \t\n ", LONG, "The cat sat on the mat and looked at the moon.", "a\0b\x1cc", "12345 !!! ???",
    "Über den Wolken  muß \n  die Freiheit", "x▁y ▁", "<|endoftext|> <s>x</s> <0x41>", "日本語 テスト。 émoji 😀😀 ﬁ İ", " lead", "trail ", "two  ", "a \n  b\r\n c", "don't I'll 's", "A" * 700, " ",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 5 else None, t, ["en", None, "de"][i % 3], ["a", "é", None, "b'"][i % 4], 1, 2, "x", 3, "y", "z") for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == ""


# ---- divergence


def brute_audit(rows, least, top):
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(Counter(t for d in mine for t in d[2]))
        n = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        p = {s: shares(c) for s, c in n.items()}
        for s in n:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in n if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:cut])]
    return sorted(out)


def audited(df, **kw):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(df, **kw).collect())


def test_audit_of_odd_rows(spark, odd, none):
    rows = [(t, ["en", None, "de"][i % 3], ["a", "é", None, "b'"][i % 4]) for i, t in enumerate(TEXTS * 2)]
    for least, top in ((1, 3), (2, 50), (99, 5)):
        assert audited(odd, min_docs=least, top=top) == brute_audit(rows, least, top)
    assert divergence.audit(none).collect() == []


def test_radix_select_cuts_ties_by_bytes(spark):
    r = random.Random(5)
    terms = ["".join(r.choices("abz", k=r.randint(1, 9))) for _ in range(3000)] + ["é" * k for k in range(1, 40)] + ["zz" + "q" * 30 + c for c in "abc"]
    rows = [("en", s, t, v) for s in ("a", "b", "") for t in sorted(set(terms)) for v in (r.choice([5, 5, 5, 7, (1 << 20) + 3, 1_000_000_001]) if s else 5,)]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    for top, bucket in ((1, 1), (50, 1), (50, 1000), (2000, 10), (5000, 10)):
        got = sorted((x.source, x["rank"], x.item, x.value) for x in divergence.top_terms(df, top, 2, bucket).collect())
        want = []
        for s in ("a", "b", ""):
            mine = sorted(((v, t) for _, x, t, v in rows if x == s), key=lambda y: (-y[0], y[1].encode()))[:top]
            want += [(s, k + 1, t, v) for k, (v, t) in enumerate(mine)]
        assert got == sorted(want), (top, bucket)


def test_shares_are_exact_at_large_counts(spark):
    n, total, kept = 987_654_321_987, 98_765_432_198_765, 1_234_567
    found = spark.createDataFrame([(n, total, kept)], "n long, t long, v long").select(divergence.share("n", "t", "v")).first()[0]
    assert found == 1 + 1_000_000_000 * (n + 5) // (total + 5 * kept)


# ---- alignment


@pytest.fixture(scope="module")
def files():
    return alignment.tokenizer_files()


@pytest.fixture(scope="module")
def pair(files):
    return alignment.Pair(*files)


@functools.cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def brute_groups(pair, text):
    """Groups of a whole text by plain loops over the libraries' tokens."""
    raw = (" " + (text or "")).encode()
    a = library().encode(" " + text, add_special_tokens=False).ids if text else []
    b = pair.b.encode(text) if text else []
    if not text or b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
        return []
    ends_a = list(itertools.accumulate(len(pair.bytes_a[i]) for i in a))
    ends_b = list(itertools.accumulate(len(pair.bytes_b[i]) for i in b))
    groups, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def brute_alignment(pair, texts):
    every = [brute_groups(pair, t) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for groups in every for g in groups)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for groups in every:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def digest(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_alignment_of_odd_rows(spark, odd, none, files, pair):
    short = [t if t is not LONG else None for t in TEXTS * 2]
    got = alignment.summary(*alignment.align(odd.where("text IS NULL OR length(text) < 10000"), *files)).collect()
    assert sorted(map(digest, got)) == sorted(brute_alignment(pair, [t for t, s in zip(TEXTS * 2, short) if t is None or s is not None]))
    assert {r.doc_id is None for r in got} == {True, False}
    assert alignment.summary(*alignment.align(none, *files)).collect() == []


def test_group_lists(spark, odd, files, pair):
    found = {r.doc_id: r for r in alignment.align_tokens(odd.where("text LIKE 'The cat%' AND doc_id IS NOT NULL"), *files).collect()}
    assert found
    for r in found.values():
        groups = brute_groups(pair, TEXTS[0])
        assert (r.a_ids, r.b_ids) == ([i for a, _ in groups for i in a], [i for _, b in groups for i in b]) and sum(r.n_bytes) == len(TEXTS[0]) + 1
        assert (r.a_sizes, r.b_sizes) == ([len(a) for a, _ in groups], [len(b) for _, b in groups])


def test_long_text_equals_the_library(pair):
    a, b, sizes_a, sizes_b, lengths = (np.frombuffer(x, np.int32) for x in pair.text(LONG))
    assert a.tolist() == library().encode(" " + LONG, add_special_tokens=False).ids and b.tolist() == pair.b.encode(LONG)
    assert sizes_a.sum() == len(a) and sizes_b.sum() == len(b) and lengths.sum() == len(LONG) + 1


def test_ids_of_random_texts(pair):
    assert pair.ranks is not None
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choices(["a", "the", " ", "  ", "\n", "\t", "\x1c", "　", " ", "'s", "1", ".", "é", "\r\n", "😀", "_"], k=r.randint(1, 25)))
        found = pair.text(text)
        want = brute_groups(pair, text)
        assert np.frombuffer(found[0], np.int32).tolist() == [i for a, _ in want for i in a], repr(text)
        assert np.frombuffer(found[1], np.int32).tolist() == [i for _, b in want for i in b], repr(text)
        assert np.frombuffer(found[2], np.int32).tolist() == [len(a) for a, _ in want], repr(text)


def test_all_links_are_among_the_pairs_of_the_vocabularies(pair):
    keys = alignment.pair_keys(pair.bytes_a, pair.bytes_b)
    assert len(keys) < 700_000
    held = set(keys.tolist())
    for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) < 3000").fetchall():
        assert all(a[-1] << 32 | b[-1] in held for a, b in brute_groups(pair, t))


def test_op12_against_brute_force(spark, pair):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = sorted((r.doc_id, *digest(r)) for r in queries.queries()["op12_byte_labels"](spark, SF).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(docs, brute_alignment(pair, [t for _, t in docs])))


# ---- decontamination

BENCH = "item_id string, text string, items string, fp long"


def words(text):
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def brute_hits(texts, bench):
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(item or "")
    out = []
    for t in texts:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((len(w), tuple(sorted(hit)), tuple(sorted(items))))
    return sorted(out)


def found_hits(docs, bench):
    rows = winnowing.hits(docs, bench).collect()
    assert all(a["stop"] < b["start"] for r in rows for a, b in itertools.pairwise(r.spans))
    return sorted((r.n_words, tuple(p for s in r.spans for p in range(s["start"], s["stop"])), tuple(r["items"])) for r in rows)


def test_hits_of_odd_rows(spark, odd, none):
    bench = [("1", "the CAT sat on the mat and looked"), ("2", ""), ("3", None), (None, "den wolken muß die"), ("1", "12345"), ("4", "?!"), ("10", "gamma alpha beta gamma alpha beta gamma alpha beta gamma alpha"), ("5", "sat on the mat and looked at the moon tonight"), ("6", "the cat sat on the mat and looked at the moon x")]
    table = spark.createDataFrame([(*b, "x", 1) for b in bench], BENCH)
    assert found_hits(odd, table) == brute_hits(TEXTS * 2, bench)
    empty = spark.createDataFrame([], BENCH)
    assert found_hits(odd, empty) == brute_hits(TEXTS * 2, [])
    assert found_hits(none, table) == []


def test_hits_in_random_words(spark):
    r = random.Random(11)
    texts = [" ".join(r.choices("abcd", k=r.choice([3, 9, 10, 11, 40, 400]))) for _ in range(120)]
    bench = [(str(k), " ".join(r.choices("abcd", k=r.choice([1, 2, 7, 9, 10, 12, 30])))) for k in range(40)] + [(f"c{k}", texts[k][5:60]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_hits(docs, spark.createDataFrame([(*b, "x", 1) for b in bench], BENCH)) == brute_hits(texts, bench)


def test_every_span_of_ten_words_shares_a_fingerprint():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 10, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.r_[rng.integers(0, 2**63, 7, dtype=np.uint64), shared, rng.integers(0, 2**63, 5, dtype=np.uint64)] for _ in range(2))
        assert set(winnowing.window_prints(a, 10).tolist()) & set(winnowing.window_prints(b, 10).tolist())


def test_words_of_neighbouring_texts_stay_apart(monkeypatch):
    monkeypatch.setattr(winnowing, "RUN_BYTES", 16)
    texts = ["foo", "bar", "", "Zé9 a" + "b" * 50, "foo"]
    raw, cuts = winnowing._texts(pa.record_batch({"text": pa.array(["skip", *texts])}).slice(1), "text")
    starts, ends = winnowing.word_spans(raw, cuts)
    low = winnowing._LOW[raw]
    assert [low[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["foo", "bar", "zé9", "a" + "b" * 50, "foo"]
    h = winnowing.word_hashes(low, starts, ends)
    assert h[0] == h[4] and len(set(h.tolist())) == 4


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "MAX_BITS", 1 << 16)
    r = random.Random(4)
    texts = [" ".join(r.choices("abcdefgh", k=60)) for _ in range(30)]
    bench = [(str(k), texts[k][9:90]) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = np.full(1 << 10, ~np.uint64(0))
    monkeypatch.setattr(winnowing, "bit_filter", lambda windows: bits)
    assert found_hits(docs, spark.createDataFrame([(*b, "x", 1) for b in bench], BENCH)) == brute_hits(texts, bench)
