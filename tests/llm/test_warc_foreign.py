"""Archives that other programs have written."""

import gzip

from veilspark.llm.warc import read_warc

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def record(block, version=b"1.0", kind=b"response", name=b"<urn:uuid:1>", size=None, more=b""):
    head = b"WARC/" + version + b"\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: " + name
    head += b"\r\nWARC-Target-URI: http://a.example/\r\n" + more
    head += b"Content-Length: " + str(len(block) if size is None else size).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def read(spark, folder, files):
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    rows = read_warc(spark, str(folder)).collect()
    return sorted((r["id"] or "", r["type"], None if r["payload"] is None else bytes(r["payload"]), r["error"]) for r in rows)


def test_versions_marks_and_binary_payloads(spark, tmp_path):
    marks = [b"x\r\n\r\nWARC/1.0\r\ny", b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"]
    payloads = [b"one", b"", *marks, bytes(range(256)) * 20, "é日本".encode(), b"\r\n\r\n", b"last"]
    for version in (b"1.0", b"1.1"):
        records = [record(HTTP + p, version, name=b"<%d>" % i) for i, p in enumerate(payloads)]
        records.insert(2, record(b"software: x", version, b"warcinfo"))
        records.insert(4, record(b"GET / HTTP/1.1\r\n\r\n", version, b"request"))
        expected = sorted((f"<{i}>", "response", p, None) for i, p in enumerate(payloads))
        tag = version.decode()
        assert read(spark, tmp_path / f"plain{tag}", {"a.warc": b"".join(records)}) == expected
        members = b"".join(gzip.compress(r) for r in records)
        assert read(spark, tmp_path / f"members{tag}", {"a.warc.gz": members}) == expected
        half = len(records) // 2
        two = {"a.warc.gz": gzip.compress(b"".join(records[:half])), "b.warc.gz": gzip.compress(b"".join(records[half:]))}
        assert read(spark, tmp_path / f"two{tag}", two) == expected


def test_lengths_that_do_not_fit(spark, tmp_path):
    records = [
        record(HTTP + b"good", name=b"<1>"), record(HTTP + b"long", name=b"<2>", size=len(HTTP) + 2),
        record(HTTP + b"after", name=b"<3>"), b"WARC/1.0\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n",
        record(HTTP + b"short", name=b"<4>", size=10_000),
    ]
    other = record(HTTP + b"of another file", name=b"<5>")
    got = read(spark, tmp_path / "a", {"a.warc": b"".join(records), "b.warc": other})
    assert [(r[0], r[2]) for r in got if r[3] is None] == [("<1>", b"good"), ("<3>", b"after"), ("<5>", b"of another file")]
    faults = {r[0]: r[3] for r in got if r[3] is not None}
    assert set(faults) == {"", "<2>", "<4>"} and "missing" in faults["<4>"] and "length" in faults["<2>"]


def test_segments_of_other_archives(spark, tmp_path):
    block = HTTP + b"a" * 50 + b"\r\n\r\nWARC/1.0\r\n" + b"b" * 50
    first = record(block[:70], name=b"<1>", more=b"WARC-Segment-Number: 1\r\n")
    second = record(block[70:], kind=b"continuation", name=b"<2>",
                    more=b"WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <1>\r\nWARC-Segment-Total-Length: %d\r\n" % len(block))
    files = {"a.warc": second, "b.warc": first}
    assert read(spark, tmp_path / "a", files) == [("<1>", "response", block[len(HTTP) :], None)]
    assert read(spark, tmp_path / "b", {"b.warc": first})[0][3].startswith("length 70")


def test_empty_and_blank_files(spark, tmp_path):
    assert read(spark, tmp_path / "a", {"a.warc": b"", "b.warc": b"\r\n\r\n"}) == []
