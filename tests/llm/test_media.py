import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import media
from voxframe.llm.q_media import op9_media


def padded(text):
    b = (text or "").encode()
    return b + b"\xff" * (-len(b) % 576 if b else 576)


def check(got, texts):
    features = {}
    for r in got:
        p = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert features.setdefault(p, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    return features


def test_query_against_brute_force(spark, sf_dir, texts):
    got = op9_media(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == texts.keys()
    found = check(got, texts)
    assert len({f for _, f in found.values()}) > 0.9 * len(found)


def test_edge_cases(nasty, empty):
    got = media.features(media.encode(nasty)).collect()
    assert len(got) == nasty.count()
    assert {r.payload_bytes for r in got if r.doc_id in (22, 23)} == {576}
    assert media.features(media.encode(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_images_give_their_samples_back(data):
    assert media.samples(media.png(media.payload(data))).tobytes() == media.payload(data)


def by_hand(rows, kinds):
    """A PNG with the given filter for each row, by the format's definition."""
    out, above = [], [0] * len(rows[0])
    for row, kind in zip(rows, kinds):
        line = [kind]
        for i, x in enumerate(row):
            a, b, c = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append((x - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(bytes(line))
        above = row
    body = zlib.compress(b"".join(out))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0] * 9, [1] * 9, [2] * 9, [3] * 9, [4] * 9, [4, 1, 3, 2, 0, 4, 3, 1, 2]])
def test_all_filters_are_undone(kinds):
    rows = np.random.default_rng(1).integers(0, 256, (9, 13)).tolist()
    assert media.samples(by_hand(rows, kinds)).tolist() == rows


def test_damage_is_noticed():
    image = media.png(media.payload(b"hello world"))
    for k in range(8, len(image)):
        broken = bytearray(image)
        broken[k] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.samples(bytes(broken))
    with pytest.raises(ValueError):
        media.samples(image[:-5])


def test_near_images_have_near_hashes():
    rng = np.random.default_rng(3)
    x = np.kron(rng.integers(20, 236, (8, 8)), np.ones((12, 10)))
    bits = lambda a: np.unpackbits(np.frombuffer(media.perceptual(a.astype(np.uint8)), np.uint8))
    near, far = bits(x + rng.normal(0, 3, x.shape)), bits(rng.integers(0, 256, x.shape))
    assert (bits(x) != near).sum() <= 8 < (bits(x) != far).sum()
