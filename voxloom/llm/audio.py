"""Chroma audio fingerprints of a media column and their alignment (operator 6).

A recording (WAV, or raw 8-bit PCM) becomes frames of energy in the twelve pitch classes.
Sixteen rectangle filters slide over the frames through an integral image; each gives two
Gray-coded bits, so every position is one packed 32-bit integer. Two fingerprints align
by a histogram of the offsets at which integers agree in their leading bits; the share of
differing bits over the overlap tells for every offset with a vote whether the one holds the
other there. References are printed from every sample below a hop on, so that the place in a
recording need not be a multiple of the hop. A reference under LONG samples has too few
positions; it is looked for by the codes of single frames and held against the recording by
the bits of a finer fingerprint.

There are two profiles. A WAV of any rate is brought to 11,025 samples a second and cut into
frames of 4,096 (some 2.7 Hz apart, enough for pitch classes from the second octave up), so that
recordings of different rates align; its references are printed at every eighth of a hop and
need 1.7 seconds. Any other bytes are 8-bit PCM in short frames, as suits texts.

The registered query reads the text bytes of ``documents`` as 8-bit mono PCM, the media
column at hand, and finds in each of them the recordings of the reference set
``benchmark``, read the same way. The reference set goes to the executors in blocks of at
most BLOCK_INTS integers, so that what is broadcast does not grow with it.

Edge cases: null and empty media have no fingerprint and align with nothing; a recording
shorter than one position is padded with silence; a WAV reference under 1.7 seconds has too few
positions and isn't found; recordings of the two profiles never meet; repeated rows are alike; ties go to
the smaller reference id and offset; references that share an id or have none are all
looked for; one under 19 samples is tried at every sample; an unreadable WAV raises nothing and has no
fingerprint; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import bounded, materialise



@dataclass(frozen=True)
class Profile:
    """How recordings of one kind are framed; references are printed from every ``step``-th sample below a hop on."""

    rate: int
    frame: int
    hop: int
    step: int


RATE, FRAME, HOP = 8000, 64, 16
TEXT, SOUND = Profile(RATE, FRAME, HOP, 1), Profile(11025, 4096, 1364, 170)
PROFILES = {p.rate: p for p in (TEXT, SOUND)}
LOW_HZ, HIGH_HZ = 28.0, 3520.0
#: Frames under one position.
SPAN = 8
#: Leading bits that must agree for a vote.
LEAD = 16
#: Positions and share of a reference that must lie over the recording, and share of bits that may differ there.
MIN_POSITIONS, MIN_OVERLAP, MAX_ERROR = 4, 0.75, 0.12
BLOCK_INTS = 1 << 20
#: From so many samples on a reference has MIN_POSITIONS at every shift below a hop; shorter ones are also looked for by single frames.
LONG = FRAME + (SPAN - 1 + MIN_POSITIONS - 1) * HOP + HOP - 1
#: (frame, hop) at which the recording is searched for frames of short references; one lies whole within any frame + hop - 1 samples.
TIERS = ((FRAME, HOP), (16, 4))
#: Frame and hop of the bits that decide about a short reference.
FINE_FRAME, FINE_HOP = 32, 4
#: Votes or positions compared at once.
STEP = 1 << 20
#: Cuts of a filter's log ratio into four levels, and the levels' Gray code.
CUTS = (-0.2, 0.0, 0.2)
GRAY = (0, 1, 3, 2)
#: Added to every mean, so that silence compares as equal.
FLOOR = 1e-3


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames) of the sixteen filters, by rule: kinds, places and spans rotate."""
    return [(i % 5, (5 * i) % 12, (3, 4, 6, 8)[i % 4], (SPAN, SPAN * 3 // 4, SPAN // 2)[i % 3]) for i in range(16)]


def decode_wav(data: bytes) -> tuple[np.ndarray, int] | None:
    """(mono samples in -1..1, rate) of a PCM WAV of 8 or 16 bits; None if it is not one."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and form and form[0] == 1 and form[5] in (8, 16):
            width = form[5] // 8
            body = body[: len(body) // (width * form[1]) * width * form[1]]
            x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128 if width == 1 else np.frombuffer(body, "<i2").astype(np.float32) / 32768
            return x.reshape(-1, form[1]).mean(axis=1), form[2]
        at += 8 + size + size % 2
    return None


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate: means over whole steps, then linear between them."""
    k = max(1, rate // to)
    x = x[: len(x) // k * k].reshape(-1, k).mean(axis=1) if k > 1 else x
    if rate == k * to or not len(x):
        return x.astype(np.float32)
    at = np.arange(int(len(x) * to * k / rate)) * (rate / (to * k))
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def raw_pcm8(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128


@cache
def _pitch(rate: int, frame: int) -> np.ndarray:
    """(bins x 12): which pitch class a frequency bin adds to."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(hz), 12), dtype=np.float32)
    on = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    out[np.flatnonzero(on), np.round(12 * np.log2(hz[on] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(x: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames x 12) energies by pitch class, each frame of length one."""
    if len(x) == 0:
        return np.zeros((0, 12), dtype=np.float32)
    least = frame + (SPAN - 1) * hop
    return frames(np.pad(x, (0, least - len(x))) if len(x) < least else x, rate, frame, hop)


def frames(x: np.ndarray, rate: int, frame: int, hop: int) -> np.ndarray:
    """As ``chroma``, but of whole frames only."""
    if len(x) < frame:
        return np.zeros((0, 12), dtype=np.float32)
    window = np.hanning(frame).astype(np.float32)
    n = 1 + (len(x) - frame) // hop
    parts = []
    for at in range(0, n, 4096):
        m = min(4096, n - at)
        view = np.lib.stride_tricks.as_strided(x[at * hop :], (m, frame), (x.strides[0] * hop, x.strides[0]))
        spectrum = np.fft.rfft(view * window, axis=1)
        parts.append((spectrum.real**2 + spectrum.imag**2) @ _pitch(rate, frame))
    c = np.concatenate(parts)
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, c / np.maximum(norm, 1e-9), 0).astype(np.float32)


def fingerprint(c: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer per position over chroma frames."""
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    wide = np.concatenate([c.T, c.T]).astype(np.float64)  # pitch classes are a circle
    image = np.zeros((25, len(c) + 1))
    np.cumsum(wide.cumsum(axis=0), axis=1, out=image[1:, 1:])

    def mean(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        total = image[y1, t1 : t1 + n] - image[y1, t0 : t0 + n] - image[y0, t1 : t1 + n] + image[y0, t0 : t0 + n]
        return np.maximum(total, 0) / ((t1 - t0) * (y1 - y0)) + FLOOR

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, h, w in filters():
        half, quarter, mid = w // 2, max(1, w // 4), h // 2
        if kind == 0:  # later against earlier
            ratio = mean(half, w, y, y + h) / mean(0, half, y, y + h)
        elif kind == 1:  # the two diagonals
            ratio = (mean(0, half, y + mid, y + h) + mean(half, w, y, y + mid)) / (mean(0, half, y, y + mid) + mean(half, w, y + mid, y + h))
        elif kind == 2:  # middle against both ends in time
            ratio = 2 * mean(quarter, w - quarter, y, y + h) / (mean(0, quarter, y, y + h) + mean(w - quarter, w, y, y + h))
        elif kind == 3:  # upper against lower classes
            ratio = mean(0, w, y + mid, y + h) / mean(0, w, y, y + mid)
        else:  # a band against the whole octave
            ratio = mean(0, w, y, y + h) / mean(0, w, 0, 12)
        level = np.searchsorted(CUTS, np.log(ratio))
        out = (out << np.uint32(2)) | np.array(GRAY, dtype=np.uint32)[level]
    return out


def codes(c: np.ndarray) -> np.ndarray:
    """One integer per chroma frame: the fourth roots of its twelve energies in sixteen steps (one class is often much the strongest)."""
    level = np.minimum((np.sqrt(np.sqrt(np.maximum(c, 0))) * 16).astype(np.int64), 15)
    return level @ (np.int64(16) ** np.arange(12, dtype=np.int64))


def expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] numbers for each i, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class References:
    """Fingerprints of a reference set at every shift below a hop, sorted by their leading bits.

    ``prints``: (key, [fingerprint of the samples from p on, for p in 0..HOP-1]) of each
    reference, or {key: fingerprint} for the first shift only. ``short``: (samples, rate)
    of the references under LONG samples, by their place in ``prints``.
    """

    def __init__(self, prints, short: dict[int, tuple[np.ndarray, int]] | None = None, profile: Profile = TEXT):
        self.profile = profile
        items = [(k, [v]) for k, v in sorted(prints.items())] if isinstance(prints, dict) else prints
        self.ids = [k for k, _ in items]
        # an entry is a reference at a shift at which it has positions enough
        entries = [(r, p * profile.step, fp) for r, (_, fps) in enumerate(items) for p, fp in enumerate(fps) if len(fp) >= MIN_POSITIONS]
        self.of, self.shift = (np.array([e[i] for e in entries], dtype=np.int64) for i in (0, 1))
        self.size = np.array([len(e[2]) for e in entries], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.ints = np.concatenate([*(e[2] for e in entries), np.zeros(0, dtype=np.uint32)]).astype(np.uint32)
        lead = self.ints >> np.uint32(32 - LEAD)
        order = np.argsort(lead, kind="stable")
        self.lead = lead[order]
        self.entry = np.repeat(np.arange(len(entries)), self.size)[order].astype(np.int32)
        self.pos = (expand(np.zeros(len(entries), dtype=np.int64), self.size))[order].astype(np.int32)
        self.short = short or {}
        self.fine = {r: fine_print(*v) for r, v in self.short.items()}
        self.tiers = []
        for (frame, hop), least, most in zip(TIERS, (TIERS[0][0] + TIERS[0][1] - 1, TIERS[1][0] + TIERS[1][1] - 1), (LONG, TIERS[0][0] + TIERS[0][1] - 1), strict=True):
            own = [(r, x, rate) for r, (x, rate) in self.short.items() if least <= len(x) < most]
            if own:
                found = [codes(frames(x, rate, frame, 1)) for _, x, rate in own]
                code = np.concatenate(found)
                order = np.argsort(code, kind="stable")
                ref = np.repeat([r for r, _, _ in own], [len(f) for f in found])
                at = np.concatenate([np.arange(len(f)) for f in found])
                self.tiers.append((frame, hop, code[order], ref[order], at[order]))
        self.tiny = [r for r, (x, _) in self.short.items() if len(x) < TIERS[1][0] + TIERS[1][1] - 1]

    def matches(self, fp: np.ndarray, x: np.ndarray | None = None, rate: int = RATE, c: np.ndarray | None = None) -> list[tuple]:
        """(share of differing bits, votes, reference, sample at which it begins) of all that pass, each once, in order.

        ``x``, ``rate`` and ``c`` (samples and chroma of the recording) are for the short references.
        """
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for entry, offset, error, votes in self._voted(fp):
            found[int(self.of[entry]), self.profile.hop * offset - int(self.shift[entry])] = (error, votes)
        if x is not None and self.short:
            for r, at, votes in self._short(x, rate, c):
                error = self._fine_error(r, at, x, rate)
                if error <= MAX_ERROR and ((r, at) not in found or (error, -votes) < (found[r, at][0], -found[r, at][1])):
                    found[r, at] = (error, votes)
        key = lambda r: (self.ids[r] is None, self.ids[r] or 0)
        return sorted(((e, v, r, at) for (r, at), (e, v) in found.items()), key=lambda m: (m[0], -m[1], key(m[2]), m[3]))

    def _voted(self, fp: np.ndarray):
        """(entry, offset, error, votes) of every voted offset that passes the overlap and error tests."""
        lead = fp >> np.uint32(32 - LEAD)
        a, b = np.searchsorted(self.lead, lead, side="left"), np.searchsorted(self.lead, lead, side="right")
        n = b - a
        parts = []
        # at most about STEP votes are held at once
        cuts = np.searchsorted(np.cumsum(n), np.arange(STEP, n.sum() + STEP, STEP)) + 1
        for lo, hi in zip(np.r_[0, cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            if hi > lo and n[lo:hi].any():
                at = expand(a[lo:hi], n[lo:hi])
                offset = np.repeat(np.arange(lo, min(hi, len(fp))), n[lo:hi]) - self.pos[at]
                parts.append(np.unique((self.entry[at].astype(np.int64) << 32) + offset + (1 << 31), return_counts=True))
        if not parts:
            return
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        votes = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
        entry, offset = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
        low, high = np.maximum(offset, 0), np.minimum(len(fp), offset + self.size[entry])
        keep = high - low >= np.maximum(MIN_POSITIONS, MIN_OVERLAP * self.size[entry])
        entry, offset, votes, low, over = entry[keep], offset[keep], votes[keep], low[keep], (high - low)[keep]
        cuts = np.searchsorted(np.cumsum(over), np.arange(STEP, over.sum() + STEP, STEP)) + 1
        for lo, hi in zip(np.r_[0, cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            e, o, m = entry[lo:hi], offset[lo:hi], over[lo:hi]
            if not len(e):
                continue
            differ = np.bitwise_count(fp[expand(low[lo:hi], m)] ^ self.ints[expand(self.start[e] + low[lo:hi] - o, m)]).astype(np.int64)
            error = np.add.reduceat(differ, np.cumsum(m) - m) / (32 * m)
            for i in np.flatnonzero(error <= MAX_ERROR):
                yield int(e[i]), int(o[i]), float(error[i]), int(votes[lo + i])

    def _short(self, x: np.ndarray, rate: int, c: np.ndarray | None):
        """(reference, sample, frames that agree): places where a frame of a short reference has the code of a frame here."""
        for frame, hop, code, ref, pos in self.tiers:
            own = codes(c if c is not None and (frame, hop) == (FRAME, HOP) else frames(x, rate, frame, hop))
            a = np.searchsorted(code, own, side="left")
            hit = np.flatnonzero(code[np.minimum(a, len(code) - 1)] == own)
            for lo in range(0, len(hit), 4096):
                i = hit[lo : lo + 4096]
                n = np.searchsorted(code, own[i], side="right") - a[i]
                at = expand(a[i], n)
                keys, votes = np.unique((ref[at].astype(np.int64) << 40) + np.repeat(i * hop, n) - pos[at] + (1 << 39), return_counts=True)
                for k, v in zip(keys.tolist(), votes.tolist(), strict=True):
                    yield k >> 40, (k & ((1 << 40) - 1)) - (1 << 39), v
        for r in self.tiny:
            for at in range(len(x) - len(self.short[r][0]) + 1):
                yield r, at, 0

    def _fine_error(self, r: int, at: int, x: np.ndarray, rate: int) -> float:
        ref, ref_rate = self.short[r]
        lo, hi = max(0, at), min(len(x), at + len(ref))
        if rate != ref_rate or hi - lo < MIN_OVERLAP * len(ref):
            return 1.0
        mine = fine_print(x[lo:hi], rate)
        return bit_error(mine, self.fine[r] if hi - lo == len(ref) else fine_print(ref[lo - at : hi - at], rate), 0)[0]

    def best(self, fp: np.ndarray) -> tuple[int, int, float, int] | None:
        """(reference id, offset, share of differing bits, votes) with the least error, or None."""
        for error, votes, r, at in self.matches(fp)[:1]:
            return self.ids[r], -(-at // self.profile.hop), error, votes
        return None


def fine_print(x: np.ndarray, rate: int) -> np.ndarray:
    return fingerprint(chroma(x, rate, FINE_FRAME, FINE_HOP))


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, positions) where b, moved by offset, lies over a."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    if hi <= lo:
        return 1.0, 0
    differ = np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum(dtype=np.int64)
    return float(differ) / (32 * (hi - lo)), hi - lo


def samples(data: bytes | None) -> tuple[np.ndarray, Profile] | None:
    """(samples, profile) of a WAV, or of any other bytes as raw 8-bit PCM; None if there is nothing to hear."""
    if not data:
        return None
    if data[:4] != b"RIFF":
        return raw_pcm8(data), TEXT
    heard = decode_wav(data)
    if heard is None or not len(heard[0]) or heard[1] <= 0:
        return None
    return resampled(*heard, SOUND.rate), SOUND


def heard_chroma(x: np.ndarray, p: Profile) -> np.ndarray:
    return chroma(x, p.rate, p.frame, p.hop)


def media_print(data: bytes | None) -> np.ndarray:
    """Fingerprint of a WAV, or of any other bytes as raw 8-bit PCM."""
    heard = samples(data)
    return np.zeros(0, dtype=np.uint32) if heard is None else fingerprint(heard_chroma(*heard))


PRINTS = "key long, fp binary, shifted array<binary>, samples binary, rate int"


def fingerprints(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, fp, shifted, samples, rate): fp is the packed integers, little-endian.

    shifted has the integers from each printed sample below a hop on, the first of them fp; samples
    (32-bit floats) are those of raw media under LONG samples; rate tells the profile.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for k, d in zip(frame["key"], frame["data"], strict=True):
                x, p = samples(d) or (np.zeros(0, dtype=np.float32), TEXT)
                fps = [fingerprint(heard_chroma(x[at:], p)).astype("<u4").tobytes() for at in range(0, p.hop if len(x) else 1, p.step)]
                rows.append((k, fps[0], fps, x.astype("<f4").tobytes() if p == TEXT and len(x) < LONG else None, p.rate))
            out = pd.DataFrame(rows, columns=["key", "fp", "shifted", "samples", "rate"])
            yield out.astype({"key": "Int64"})

    return bounded(media).select(F.col(key).cast("long").alias("key"), F.col(column).alias("data")).mapInPandas(run, PRINTS)


def load(rows, profile: Profile = TEXT) -> References:
    """References of those rows, as ``fingerprints`` gives them, that have this profile."""
    numbers = lambda b: np.frombuffer(bytes(b), "<u4").astype(np.uint32)
    items, short = [], {}
    for r in rows:
        if r["rate"] != profile.rate:
            continue
        heard = None if r["samples"] is None else np.frombuffer(bytes(r["samples"]), "<f4").astype(np.float32)
        if heard is not None:
            short[len(items)] = (heard, r["rate"])
        # what lies past the end of a shift that is padded is no part of the reference
        whole = [p for p in range(len(r["shifted"])) if heard is None or len(heard) - p * profile.step >= profile.frame + (SPAN - 1) * profile.hop]
        items.append((r["key"], [numbers(r["shifted"][p]) for p in whole]))
    return References(items, short, profile)


FOUND = "array<struct<bit_error:double,votes:int,ref_id:long,ref_sample:long>>"


def align(media: DataFrame, key: str, column: str, references: DataFrame) -> DataFrame:
    """(key, n_ints, fp_crc32, ref_id, ref_offset, bit_error, votes, matches) of every row of ``media``.

    ``references``: as ``fingerprints`` gives them. matches holds every (reference, sample)
    that passes the overlap and error tests, least error first, and the columns before it
    the first of them. One block of references is broadcast at a time.
    """
    refs = references.where(F.length("fp") > 0).dropDuplicates(["key", "shifted", "samples", "rate"])
    refs = materialise(refs, "references")
    total = refs.agg(F.sum(F.length("fp") / 4 * HOP)).first()[0] or 0
    n_blocks = max(1, int(-(-total // BLOCK_INTS)))
    part = F.pmod(F.xxhash64("key", "fp"), F.lit(n_blocks))
    blocks = [r[0] for r in refs.select(part).distinct().collect()] or [0]
    sc = media.sparkSession.sparkContext
    passes = []
    schema = f"rid long, key long, n_ints int, fp_crc32 long, hop int, matches {FOUND}"
    source = bounded(media).select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("key"), F.col(column).alias("data"))
    for block in sorted(blocks):
        held = refs.where(part == block).collect()  # BLOCK_INTS integers, about
        shared = sc.broadcast({rate: load(held, p) for rate, p in PROFILES.items()})

        def run(frames, shared=shared):
            own = shared.value
            for frame in frames:
                rows = []
                for rid, k, data in zip(frame["rid"], frame["key"], frame["data"], strict=True):
                    x, p = samples(data) or (np.zeros(0, dtype=np.float32), TEXT)
                    c, refs_ = heard_chroma(x, p), own[p.rate]
                    fp = fingerprint(c)
                    # a padded recording's last frames are silence, so it is framed again
                    hits = refs_.matches(fp, x, p.rate, c if len(x) >= p.frame + (SPAN - 1) * p.hop else None) if len(fp) else []
                    rows.append((rid, k, len(fp), zlib.crc32(fp.astype("<u4").tobytes()), p.hop, [(e, v, refs_.ids[r], at) for e, v, r, at in hits]))
                out = pd.DataFrame(rows, columns=["rid", "key", "n_ints", "fp_crc32", "hop", "matches"])
                yield out.astype({"key": "Int64"})

        passes.append(source.mapInPandas(run, schema))
    found = reduce(DataFrame.unionByName, passes)
    if len(passes) > 1:
        order = lambda m: F.struct(m["bit_error"], -m["votes"], m["ref_id"].isNull(), m["ref_id"], m["ref_sample"])
        after = lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0)
        # one row per block
        joined = found.groupBy("rid").agg(*(F.first(c).alias(c) for c in ("key", "n_ints", "fp_crc32", "hop")), F.flatten(F.collect_list("matches")).alias("matches"))
        found = joined.withColumn("matches", F.array_sort("matches", after))
    top = F.get("matches", F.lit(0))
    return found.select("key", "n_ints", "fp_crc32", top["ref_id"].alias("ref_id"), F.ceil(top["ref_sample"] / F.col("hop")).cast("int").alias("ref_offset"), top["bit_error"].alias("bit_error"), top["votes"].alias("votes"), "matches")


def op6_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the ``documents`` media column and where recordings of ``benchmark`` lie in it."""
    media = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("media", F.col("text").cast("binary"))
    references = fingerprints(media("benchmark"), "item_id", "media")
    return align(media("documents"), "doc_id", "media", references).withColumnRenamed("key", "doc_id")
