import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwave.llm import media


def payload(text):
    b = (text or "").encode()
    n = max(1, -(-len(b) // media.FRAME)) * media.FRAME
    return b, b + b"\xff" * (n - len(b))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 16, 256]))
def test_frames_come_back_exactly(n, seed, levels):
    x = (np.random.default_rng(seed).integers(0, levels, (n, 24, 24)) * (255 // max(1, levels - 1))).astype(np.uint8)
    jpegs = media.encode_frames(x)
    assert (media.decode_frames(jpegs) == x).all()
    avi = media.write_avi(jpegs)
    assert [avi[a : a + k] for a, k in media.read_index(avi)] == jpegs
    assert avi[:4] == b"RIFF" and int.from_bytes(avi[4:8], "little") == len(avi) - 8


def test_shots_are_cut_where_pictures_change():
    dark, light = np.full((10, 24, 24), 10, np.uint8), np.full((12, 24, 24), 200, np.uint8)
    x = np.concatenate([dark, light, dark])
    assert np.flatnonzero(media.shot_starts(x, np.zeros(len(x), int))).tolist() == [0, 10, 22]
    both = media.shot_starts(np.concatenate([x, x]), np.repeat([0, 1], len(x)))
    assert (both[: len(x)] == both[len(x) :]).all()


def test_texts_round_trip(spark):
    texts = [None, "", "a", "x" * 576, "y" * 577, "é😀" * 500, "z" * 3_000_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, id int")
    stored = media.store(docs).persist()
    got = {r.id: r for r in media.facts(stored).collect()}
    kept = {r.id: bytes(r.media) for r in stored.collect()}
    for i, t in enumerate(texts):
        raw, full = payload(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(kept[i]), hashlib.sha256(kept[i]).hexdigest())
    assert got[7].feature == got[8].feature
    clips = media.clips(stored).collect()
    for i in range(len(texts)):
        own = sorted((c.clip, c.start_ms, c.end_ms, c.frames) for c in clips if c.id == i)
        assert f"clips={','.join(f'{a}-{z}' for _, a, z, _ in own)}" in got[i].feature
        assert sum(c[3] for c in own) * media.FRAME == got[i].payload_bytes


def test_nulls_empty_tables_and_damage(spark):
    assert media.facts(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    null = spark.createDataFrame([(1, 2, None)], "id long, n_bytes long, media binary")
    assert media.facts(null).first().payload_bytes is None and media.clips(null).count() == 0
    with pytest.raises(ValueError, match="not an AVI"):
        media.read_index(b"nonsense at all")


# An encoder of its own for baseline frames: codes of fixed length, all quantisers one.
DC, AC = list(range(12)), [16 * r + s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def baseline(planes, sampling, h, w, every=0):
    """A JPEG of component planes (padded to whole units) with sampling factors (across, down)."""
    i, j = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * j + 1) * i * np.pi / 16) * np.where(i == 0, np.sqrt(1 / 8), np.sqrt(1 / 4))
    zig = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
    wide, high = max(a for a, _ in sampling), max(b for _, b in sampling)
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    out, last, parts = "", [0] * len(planes), []

    def flush():
        raw = out + "1" * (-len(out) % 8)
        return int(raw or "0", 2).to_bytes(len(raw) // 8, "big").replace(b"\xff", b"\xff\x00")

    def number(v):
        size = abs(v).bit_length()
        return size, format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            parts.append(flush() + bytes([0xFF, 0xD0 + (len(parts) % 8)]))
            out, last = "", [0] * len(planes)
        y, x = divmod(mcu, across)
        for c, (a, b) in enumerate(sampling):
            for v in range(b):
                for u in range(a):
                    r, q = (y * b + v) * 8, (x * a + u) * 8
                    f = np.rint(basis @ (planes[c][r : r + 8, q : q + 8].astype(float) - 128) @ basis.T).astype(int).ravel()[zig]
                    size, bits = number(int(f[0]) - last[c])
                    last[c] = int(f[0])
                    out += format(DC.index(size), "04b") + bits
                    run = 0
                    for k in range(1, 64):
                        if not f[k:].any():
                            out += format(AC.index(0), "08b")
                            break
                        if f[k] == 0:
                            run += 1
                            if run == 16:
                                out, run = out + format(AC.index(0xF0), "08b"), 0
                            continue
                        size, bits = number(int(f[k]))
                        out, run = out + format(AC.index(16 * run + size), "08b") + bits, 0
    parts.append(flush())
    n = len(planes)
    head = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([1] * 64)) + segment(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, (a << 4) | b, 0]) for c, (a, b) in enumerate(sampling)))
    head += segment(0xC4, bytes([0x00] + [0, 0, 0, 12] + [0] * 12 + DC)) + segment(0xC4, bytes([0x10] + [0] * 7 + [len(AC)] + [0] * 8 + AC))
    if every:
        head += segment(0xDD, every.to_bytes(2, "big"))
    return head + segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0])) + b"".join(parts) + b"\xff\xd9"


@pytest.mark.parametrize("sampling,every", [([(1, 1)], 0), ([(1, 1)], 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3)])
def test_baseline_frames_are_decoded(sampling, every):
    g = np.random.default_rng(3)
    h, w = 37, 52
    full = [np.clip(np.add.outer(np.arange(64) * 2, np.arange(64)) + g.integers(-20, 20, (64, 64)), 0, 255) for _ in sampling]
    jpeg = baseline(full, sampling, h, w, every)
    assert not media.is_lossless(jpeg)
    got = media.decode_frames([jpeg, jpeg])
    assert got.shape == (2, h, w) and np.abs(got[0].astype(int) - full[0][:h, :w]).max() <= 1


def test_clips_of_baseline_videos_of_several_sizes(spark):
    frame = lambda v, h, w: baseline([np.full((64, 64), v)], [(1, 1)], h, w)
    videos = [[frame(20, 16, 24)] * 4 + [frame(220, 16, 24)] * 3, [frame(90, 40, 40)] * 5]
    stored = spark.createDataFrame([(i, bytearray(media.write_avi(v))) for i, v in enumerate(videos)], "id long, media binary")
    got = sorted((c.id, c.clip, c.frames) for c in media.clips(stored).collect())
    assert got == [(0, 0, 4), (0, 1, 3), (1, 0, 5)]


def test_damaged_media_name_their_fault():
    jpeg = baseline([np.full((16, 16), 7)], [(1, 1)], 16, 16)
    for bad, fault in ((jpeg[:2], "scan"), (jpeg[:30], "scan"), (jpeg.replace(b"\xff\xc0", b"\xff\xc2"), "baseline"), (b"xx", "JPEG")):
        with pytest.raises(ValueError, match=fault):
            media.decode_frames([bad])
    avi = media.write_avi(media.encode_frames(np.zeros((3, 24, 24), np.uint8)))
    with pytest.raises(ValueError, match="movi"):
        media.read_index(avi[:-60])
