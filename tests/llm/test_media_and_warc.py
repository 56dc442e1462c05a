import hashlib
import zlib

import numpy as np
import pytest

from millrace.llm import media_gif as g
from millrace.llm import warc as w


def lzw_encode(data, bits):
    """A plain LZW encoder, for streams that the writer doesn't make."""
    clear, out, n, width = 1 << bits, 0, 0, bits + 1
    table = {bytes([i]): i for i in range(clear)}

    def emit(code):
        nonlocal out, n
        out |= code << n
        n += width

    emit(clear)
    last = b""
    size = clear + 2
    for b in data:
        if last + bytes([b]) in table:
            last += bytes([b])
            continue
        emit(table[last])
        if size < 4096:
            table[last + bytes([b])] = size
            size += 1
            if size - 1 == 1 << width and width < 12:
                width += 1
        else:
            emit(clear)
            table, size, width = {bytes([i]): i for i in range(clear)}, clear + 2, bits + 1
        last = bytes([b])
    if last:
        emit(table[last])
        if size == 1 << width and width < 12:
            width += 1
    emit(clear + 1)
    return out.to_bytes(-(-n // 8), "little")


@pytest.mark.parametrize(("bits", "n"), [(8, 576), (8, 9000), (8, 20000), (2, 3000), (4, 1), (8, 1)])
def test_lzw_round_trips(bits, n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 1 << bits, n, np.uint8), (np.arange(n) // 7 % (1 << bits)).astype(np.uint8), np.zeros(n, np.uint8)):
        stream = lzw_encode(data.tobytes(), bits)
        assert np.array_equal(g.lzw_decode(stream, bits, n), data)
        again = g.pack_codes([g.lzw_codes(data.tobytes(), bits)], bits)[0]
        both = g.lzw_decode_all([(stream, bits, n), (again, bits, n), (again, bits, 5), (again[:40], bits, n), (b"", bits, n)])
        assert np.array_equal(both[0], data) and np.array_equal(both[1], data) and np.array_equal(both[2], data[:5])
        assert np.array_equal(both[3], data[: len(both[3])]) and len(both[4]) == 0
        assert plain_lzw(again, bits) == data.tolist()


def test_lzw_errors():
    with pytest.raises(ValueError):
        g.lzw_decode((258 | 300 << 9).to_bytes(3, "little"), 8, 9)
    assert len(g.lzw_decode(b"", 8, 9)) == 0
    bad = g.pack_codes([[256, 65, 300, 257]])[0]
    for decode in (lambda: g.lzw_decode(bad, 8, 9), lambda: g.lzw_decode_all([(bad, 8, 9)])):
        with pytest.raises(ValueError):
            decode()


def plain_lzw(data, bits):
    """A second decoder: bit by bit, strings as tuples."""
    flow = "".join(f"{b:08b}"[::-1] for b in data)
    clear, at, width, table, last, out = 1 << bits, 0, bits + 1, {}, None, []
    while at + width <= len(flow):
        code = int(flow[at : at + width][::-1], 2)
        at += width
        if code == clear + 1:
            break
        if code == clear:
            table, width, last = {i: (i,) for i in range(clear)}, bits + 1, None
            continue
        now = table[code] if code in table else (*last, last[0])
        out += now
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = (*last, now[0])
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
        last = now
    return out


def plain_pictures(media):
    """A second reader of what the writer makes: lists of rows of palette indices, one per frame, with the delays."""
    side = media[6] | media[7] << 8
    assert media[:6] == b"GIF89a" and media[10] == 0xF7 and media[-1] == 0x3B
    at, canvas, out = 13 + 768, [[None] * side for _ in range(side)], []
    assert media[at : at + 14] == b"\x21\xff\x0bNETSCAPE2.0"
    at += 19
    while media[at] != 0x3B:
        assert media[at : at + 3] == b"\x21\xf9\x04"
        packed, delay, hidden = media[at + 3], media[at + 4] | media[at + 5] << 8, media[at + 6]
        assert packed >> 2 == 1 and media[at + 8] == 0x2C
        left, top, wide, high = (media[at + i] | media[at + i + 1] << 8 for i in (9, 11, 13, 15))
        bits, at, body = media[at + 18], at + 19, b""
        while media[at]:
            body += media[at + 1 : at + 1 + media[at]]
            at += 1 + media[at]
        at += 1
        found = plain_lzw(body, bits)
        assert len(found) == wide * high
        for i, v in enumerate(found):
            if not (packed & 1 and v == hidden):
                canvas[top + i // wide][left + i % wide] = v
        out.append(([list(r) for r in canvas], delay))
    return out


def pictures(media):
    gif = g.decode_gif(media)
    return [p.copy() for _, p in g.compose(gif)], gif


def samples(kind, n):
    rng = np.random.default_rng(n)
    if kind == "noise":
        return rng.integers(0, 256, n, np.uint8).tobytes()
    if kind == "text":
        return (b"the same words come again and again, but not all of them. " * (n // 50 + 1))[:n]
    return b"".join(bytes([3]) * 570 + bytes([7, i % 200, 9, 9, 9, 9]) for i in range(n // 576))


@pytest.mark.parametrize("kind", ["noise", "text", "still"])
@pytest.mark.parametrize("n", [576, 1152, 576 * 300])
def test_gif_round_trip(kind, n):
    data = samples(kind, n)
    media = g.encode_gif(data)
    shown, gif = pictures(media)
    assert b"".join(p[..., 0].tobytes() for p in shown) == data
    assert all(np.array_equal(p[..., 1], p[..., 0] ^ (p[..., 0] >> 1)) and np.array_equal(p[..., 2], 255 - p[..., 0]) and (p[..., 3] == 255).all() for p in shown)
    assert [f.time for f in gif.frames] == [4 * i for i in range(n // 576)]
    if n < 10_000 or kind == "still":
        second = plain_pictures(media)
        assert bytes(v for rows, _ in second for r in rows for v in r) == data and {d for _, d in second} == {4}
    if kind == "text" and n > 576:
        assert len(media) - 800 < 0.8 * n  # strings are coded, not letters; 800: palette and headers
    if kind == "still" and n > 576:
        assert all(f.transparent is not None and f.width * f.height < 576 for f in gif.frames[1:2])


def test_large_frames_fill_the_table():
    data = np.random.default_rng(1).integers(0, 9, 128 * 128 * 2, np.uint8).tobytes()
    media = g.encode_gif(data, 128)
    shown, gif = pictures(media)
    assert b"".join(p[..., 0].tobytes() for p in shown) == data and len(gif.frames) == 2
    codes = g.lzw_codes(data[: 128 * 128])
    assert codes.count(256) > 1 and codes[-1] == 257
    assert plain_lzw(g.pack_codes([codes])[0], 8) == list(data[: 128 * 128])
    with pytest.raises(ValueError):
        g.encode_gif(data, 100)


def test_odd_files():
    with pytest.raises(ValueError):
        g.encode_gif(b"abc")
    with pytest.raises(ValueError):
        g.decode_gif(b"PNG")


def hand_made(frames, size=(4, 4)):
    """A GIF with a palette of four colours; frames: (left, top, width, height, disposal, transparent, interlaced, indices)."""
    out = b"GIF89a" + bytes([size[0], 0, size[1], 0, 0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for left, top, width, height, disposal, transparent, interlaced, indices in frames:
        out += bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 10, 0, transparent or 0, 0])
        out += bytes([0x2C, left, 0, top, 0, width, 0, height, 0, 0x40 if interlaced else 0, 2])
        code = lzw_encode(bytes(indices), 2)
        out += bytes([len(code)]) + code + b"\0"
    return out + b"\x3b"


def test_disposal_transparency_and_interlace():
    full = [1] * 16
    gif = g.decode_gif(hand_made([(0, 0, 4, 4, 1, None, False, full), (1, 1, 2, 2, 3, 0, False, [0, 2, 2, 0]), (0, 0, 1, 1, 2, None, False, [3]), (3, 3, 1, 1, 0, None, False, [2])]))
    a, b, c, d = (p.copy() for _, p in g.compose(gif))
    assert (a[..., 0] == 255).all() and [f.time for f in gif.frames] == [0, 10, 20, 30]
    assert b[1, 1].tolist() == [255, 0, 0, 255] and b[1, 2].tolist() == [0, 255, 0, 255]
    assert c[1, 2].tolist() == [255, 0, 0, 255] and c[0, 0].tolist() == [0, 0, 255, 255]
    assert d[0, 0].tolist() == [0, 0, 0, 0] and d[3, 3].tolist() == [0, 255, 0, 255]
    rows = [r for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, 8, s)]
    mixed = g.decode_gif(hand_made([(0, 0, 2, 8, 0, None, True, [r % 4 for r in rows for _ in range(2)])], (2, 8)))
    assert mixed.frames[0].indices[:, 0].tolist() == [r % 4 for r in range(8)]


def test_gif_query(docs, rows, no_docs, clashing):
    found = g.gif_features(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add(tuple(tuple(v) if isinstance(v, list) else v for v in r)[1:])
    for i, t in rows:
        (r,) = by[i]
        body = (t or "").encode()
        pay = g.payload_of(body)
        assert len(pay) % 576 == 0 and len(pay) >= max(576, len(body))
        assert r[:4] == (len(body), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        media = g.encode_gif(pay)
        assert r[4] == len(media) and r[5] == hashlib.sha256(media).hexdigest()
        second = plain_pictures(media)
        assert bytes(v for rows_, _ in second for x in rows_ for v in x) == pay
        values = np.frombuffer(pay, np.uint8)
        frames = values.reshape(-1, 576).astype(int)
        change = np.abs(np.diff(frames, axis=0)).mean() if len(frames) > 1 else 0
        shares = [int(1000 * ((values >> 4) == k).sum() / len(pay) + 0.5) for k in range(16)]
        assert r[6] == f"frames={len(frames)};s={len(frames) * 4 / 100:.2f};mean={frames.mean():.3f};change={change:.3f};hist={','.join(map(str, shares))}"
        assert list(r[7]) == [4 * k for k in range(len(frames))]
        for found_, channel in zip(r[8:11], (values, values ^ (values >> 1), 255 - values), strict=True):
            assert list(found_) == np.bincount(channel >> 4, minlength=16).tolist()
    assert len(found) == len(rows) and g.gif_features(no_docs).collect() == [] and g.gif_features(clashing).count() == 4
    one = g.gif_frames(docs).filter("doc_id = %d" % rows[0][0]).first()
    assert one.times[0] == 0 and sum(one.histograms[0]) == 3 * 576 and len(one.times) == len(one.histograms)


def test_long_texts_as_gif(spark):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(200_000))
    r = g.gif_features(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    pay = g.payload_of(text.encode())
    assert len(text) > 1 << 20 and {x[1:6] for x in map(tuple, r)} == {(len(text), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]), r[0].media_bytes)}


RECORD = "record_id long, kind string, url string, captured long, status int, headers map<string,string>, payload_digest string, payload_bytes long, canonical string"


def revisits(spark, rows, bucket=100):
    made = [(*r[:4], r[4], r[5], r[6] if len(r) > 6 else None, 3, "clash") for r in rows]
    out = w.resolve_revisits(spark.createDataFrame(made, RECORD), bucket)
    return {r.record_id: r for r in out.collect()}


def test_revisits(spark):
    tag = {"etag": '"1"', "content-length": "9", "cache-control": "a"}
    found = revisits(
        spark,
        [
            (1, "response", "http://X.org/a/", 10, 200, tag, "d1"),
            (2, "response", "http://x.org/a", 400, 200, {"etag": '"2"'}, "d2"),
            (3, "response", "http://x.org/a", 450, 500, tag, "bad"),
            (4, "revisit", "https://www.x.org:443/a#f", 390, 304, {"etag": 'W/"1"', "content-length": "0", "cache-control": "b", "connection": "close"}),
            (5, "revisit", "http://x.org/a", 500, 304, {"etag": '"1"'}),
            (6, "revisit", "http://x.org/a", 5, 304, None),
            (7, "revisit", "http://x.org/a", 10, 304, {}),
            (8, "revisit", None, 10, 304, {}),
            (9, "revisit", "http://x.org/a", None, 304, {}),
            (10, "revisit", "http://x.org/a", 9999, 304, {"last-modified": "x"}),
            (0, "revisit", "http://x.org/a", 10, 304, {}),
        ],
    )
    assert (found[4].outcome, found[4].response_id, found[4].payload_digest) == ("resolved", 1, "d1")
    assert found[4].merged_headers == {"etag": 'W/"1"', "content-length": "9", "cache-control": "b"}
    assert {i: found[i].outcome for i in (5, 6, 8, 9, 10, 0)} == {5: "validator_mismatch", 6: "no_earlier_response", 8: "no_earlier_response", 9: "no_earlier_response", 10: "validator_mismatch", 0: "no_earlier_response"}
    assert found[7].response_id == 1 and found[5].response_id is None


def test_revisits_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        kind = "response" if rng.random() < 0.4 else "revisit"
        url = "http://hot.org/" if rng.random() < 0.5 else f"http://h{rng.integers(0, 5)}.org/p"
        rows.append((i, kind, url, int(rng.integers(0, 900)), 200 if kind == "response" else 304, {}, f"d{i}"))
    found = revisits(spark, rows, 50)
    for i, kind, url, at, *_ in rows:
        if kind == "revisit":
            earlier = [(r[3], r[0]) for r in rows if r[1] == "response" and r[2] == url and (r[3], r[0]) < (at, i)]
            assert found[i].response_id == (max(earlier)[1] if earlier else None)
    assert revisits(spark, []) == {}


def test_canonical_urls(spark):
    cases = {
        "HTTP://User@WWW.Example.com:80/A/?b=2&utm_source=x&a=1#top": "example.com/A?a=1&b=2",
        "https://example.com": "example.com",
        "https://example.com/?": "example.com",
        "not a url": "not a url",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.c for r in df.select("u", w.canonical_url(df.u).alias("c")).collect()} == cases


def test_warc_files(spark, tmp_path):
    records = [
        {"record_id": "<1>", "kind": "response", "url": "http://a/", "date": "2020-01-01T00:00:00Z", "status": 200, "headers": {"etag": '"x"'}, "payload": b"body \r\n\r\n WARC/ inside"},
        {"record_id": "<2>", "kind": "warcinfo", "url": "", "date": "2020-01-01T00:00:00Z", "status": None, "headers": {}, "payload": b""},
        {"record_id": "<3>", "kind": "revisit", "url": "http://a/", "date": "2020-01-02T00:00:00Z", "status": 304, "headers": {}, "payload": b""},
    ]
    data = w.write_warc(records)
    found = list(w.parse_warc(data))
    assert [(f["record_id"], f["kind"], f["status"], f["headers"], f["payload"]) for f in found] == [(r["record_id"], r["kind"], r["status"], r["headers"], r["payload"]) for r in records]
    assert list(w.parse_warc(b"")) == [] and len(list(w.parse_warc(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort"))) == 0
    (tmp_path / "x.warc.gz").write_bytes(data)
    read = {r.record_id: r for r in w.read_warc(spark, str(tmp_path)).collect()}
    assert read["<1>"].captured == 1577836800 and read["<1>"].payload == records[0]["payload"] and read["<2>"].status is None


def test_repeated_fields():
    lines = b"Vary: a\r\nSet-Cookie: x=1; Expires=Thu, 01 Jan\r\nvary: b,\r\n c\r\nSet-Cookie: y=2\r\n"
    http = b"HTTP/1.1 200 OK\r\n" + lines + b"\r\nbody"
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    found = list(w.parse_warc(data))
    assert [f["headers"] for f in found] == [{"vary": "a, b, c", "set-cookie": "x=1; Expires=Thu, 01 Jan\ny=2"}]
    again = list(w.parse_warc(w.write_warc([f | {"record_id": "<1>", "url": "http://a/", "date": "2020-01-01T00:00:00Z"} for f in found])))
    assert [f["headers"] for f in again] == [f["headers"] for f in found] and again[0]["payload"] == b"body"
