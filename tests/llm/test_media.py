import io
import tarfile
import zlib
from hashlib import sha256

from pyarrow import fs

from tests.llm.conftest import rows_of, texts_of
from tickloom.llm import media as m
from tickloom.llm.common import shared_path


def test_png_round_trip():
    for text in ("", "a", "é" * 500, "x" * 192):
        p = m.payload_of(text)
        assert len(p) % 192 == 0 and p.rstrip(b" ") == text.encode().rstrip(b" ") and m.from_png(m.to_png(p)) == p


def test_columns(spark, documents, edge, none):
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    folder = shared_path(spark, "media-test")
    got = m.media_columns(docs, folder)
    want = []
    for i, t in texts_of(docs):
        p = m.payload_of(t)
        png = m.to_png(p)
        want.append((i, len(t.encode()), len(p), sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(png), sha256(png).hexdigest(), m.features(p, 192, len(p) // 192)))
    assert rows_of(got.select(*got.columns[:8])) == sorted(want, key=str)
    one = got.first()
    store, path = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    with store.open_input_file(f"{path}/{one['shard']}") as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        member = next(x for x in tar if x.offset_data == one["offset"])
        assert member.name == f"{one['payload_sha256']}.png" and member.size == one["media_bytes"]
    assert m.media_columns(none).count() == 0


def test_shards_close(spark, documents):
    folder = shared_path(spark, "media-test")
    folder = folder if ":/" in folder else f"file://{folder}"
    index = m.store(documents.coalesce(1), folder, shard_bytes=100_000)
    assert index.select("shard").distinct().count() > 2
    assert m.headers(m.addresses(index), folder).where("width <> 192").count() == 0


def plain_png(data):
    """Width, height and samples of an 8-bit grey PNG, by the format's rules."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows, up = zlib.decompress(packed), [], bytes(width)
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            a, b, c = line[x - 1] if x else 0, up[x], up[x - 1] if x else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, near)[kind]) % 256
        up = bytes(line)
        rows.append(up)
    return width, height, b"".join(rows)


def test_stored_members_decode_to_the_texts(spark, documents, edge):
    """What lies at each row's address, decoded without the module, is the padded text; all columns follow from it."""
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    folder = shared_path(spark, "media-test")
    folder = folder if ":/" in folder else f"file://{folder}"
    store, path = fs.FileSystem.from_uri(folder)
    shards, want, got = {}, [], []
    for _, text in texts_of(docs):
        b = text.encode()
        b += b" " * (-len(b) % 192 if b else 192)
        want.append((len(text.encode()), b))
    for r in m.media_columns(docs, folder).collect():
        if r["shard"] not in shards:
            with store.open_input_file(f"{path}/{r['shard']}") as f:
                shards[r["shard"]] = f.read()
        media = shards[r["shard"]][r["offset"] : r["offset"] + r["media_bytes"]]
        width, height, payload = plain_png(media)
        assert (r["width"], r["height"]) == (width, height) and r["media_sha256"] == sha256(media).hexdigest()
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        got.append((r["n_bytes"], payload))
    assert sorted(got) == sorted(want)
