"""URL filter, licence scan, media, WARC: against plain Python."""

import hashlib
import re
import struct
import zlib

import pytest

from plumbline.llm import license_scan, media, warc
from plumbline.llm.url_filter import RULES, judge_urls

from .conftest import documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = ["http://A.Example.org/es/x?y#z", "https://example.org/en/12", "example.org/en/1", None, "", "x://", "http://www.b.com/fr/1", "http://com/de/2", "http://bcom/de/2", "http://n.org", "http://n.org?a=1/es/", "http://h/p#?q", "ftp://user@Ex.ORG:80/en/1/../é"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    best = None
    for said, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return best


def test_urls(spark, sf_dir):
    given = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = given + [(1000 + i, u) for i, u in enumerate(URLS * 2)]
    got = judge_urls(spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id long, url string, host string, score double")).collect()
    assert len(got) == len(rows)
    urls = dict(rows)
    for r in got:
        assert (r.host, r.path) == split(urls[r.page_id])
        best = ruled(r.host, r.path)
        assert r.rule == (best and best[1]) and r.verdict in ("allow", "block") and (best is None or r.verdict == best[0])


def test_the_trees_learn_the_paths(spark):
    rows = [(i, f"http://s{i % 50}.example.com/{'fr' if i % 2 else 'de'}/{'archive/' * 4 if i % 2 == 0 else ''}{i}") for i in range(400)]
    rows += [(1000 + i, f"http://s{i}.example.net/x/{'archive/' * 4 if i % 2 == 0 else ''}{i}") for i in range(40)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 0) for r in got) >= 36


def test_urls_without_labels(spark):
    got = judge_urls(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")).collect()
    assert [r.verdict for r in got] == ["allow"]
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_licences(spark, odd, empty):
    texts = ["Released under the MIT License.", "cc by cc-by, CC\tBY; ccby", "GNU General Public\nLicense, version 3. All rights reserved", "general public licenses", "This work is licensed under the GNU General Public License, version 3.", "the mit licence", "Licensed under CC BY-NC 4.0.", None, "", "Kcc by", "cc by" * 3000]
    got = license_scan.scan_licenses(documents(spark, enumerate(texts))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        found = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and 0 <= r.score <= 1
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(","))
    labels = [r.labels for r in got]
    assert labels[0] == "mit" and labels[4] == "gpl,gpl-3.0" and labels[5] == "" and labels[6] == "cc-by,cc-by-nc-4.0"
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(empty).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"


def test_all_licences_of_a_notice_are_found(spark):
    apache = "Licensed under the Apache License, Version 2.0"
    # the common words of a corpus: apache is rare, its neighbours are not
    common = ["license version 2.0, licensed"] * 30
    texts = [f"{MIT}. {BSD}. {apache}", apache.removeprefix("Licensed "), "Apache License, Version 2.0", "x " + "Apache License, Version 2.0", *common]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(documents(spark, enumerate(texts))).collect()}
    assert got[0][0] == "apache-2.0,bsd,mit" and got[1][0] == "apache-2.0"
    # a notice at the file's first word is judged as elsewhere
    assert got[2] == got[3] and got[2][0] == "apache-2.0"


def test_a_text_of_all_templates_has_all_labels(spark):
    text = ". ".join(t for _, t, _ in license_scan.TEMPLATES)
    got = license_scan.scan_licenses(documents(spark, [(1, text), (2, words(1, 50)), (3, text.upper())])).collect()
    labels = {r.doc_id: set(r.labels.split(",")) for r in got}
    assert labels[1] == labels[3] >= {label for label, _, _ in license_scan.TEMPLATES} and labels[2] == {""}


def test_template_labels_against_plain_python(spark, sf_dir):
    """A template's label is there exactly where its mandatory phrases stand in place and most of its words do."""
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER)) for r in docs.collect()}
    vocabulary = license_scan._vocabulary()
    df = {w: sum(w in set(t) for t in texts.values()) for w in vocabulary}
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) for w in vocabulary}
    want = {}
    for i, heard in texts.items():
        held = set()
        for label, said, phrases in license_scan.TEMPLATES:
            said = said.split()
            must = {k + j for p in phrases for k in range(len(said)) if said[k : k + len(p.split())] == p.split() for j in range(len(p.split()))}
            weights = [idf.get(w, 0.0) + 0.01 for w in said]
            for shift in range(-len(said), len(heard)):
                there = [0 <= shift + k < len(heard) and heard[shift + k] == w for k, w in enumerate(said)]
                if all(there[k] for k in must) and sum(w for w, t in zip(weights, there, strict=True) if t) >= 0.6 * sum(weights):
                    held.add(label)
        want[i] = held
    got = {r.doc_id: set(r.labels.split(",")) - {label for _, label in license_scan.BASE} - {""} for r in license_scan.scan_licenses(docs).collect()}
    base = {label for _, label in license_scan.BASE}
    assert got == {i: x - base for i, x in want.items()}


def test_media_round_trip(spark, odd, empty):
    got = media.text_media(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    want = sorted(hashlib.sha256(media.padded((r.text or "").encode())).hexdigest() for r in texts)
    assert sorted(r.payload_sha256 for r in got) == want
    for r in got:
        assert r.codec == "raw" and r.duration == r.frames == r.payload_bytes // 192 and len(r.keyframes) == -(-r.frames // 8)
    assert media.text_media(empty).count() == 0


def test_media_index_locates_keyframes():
    payload = media.padded(bytes(range(256)) * 400)
    stored = media.mux(payload)
    found = media.index(stored)
    assert b"".join(stored[s : s + n] for s, n in found.ranges) == payload
    assert [stored[s : s + n] for s, n in found.keyframes] == [payload[i * 192 : i * 192 + 192] for i in range(0, found.frames, 8)]
    with pytest.raises(ValueError, match="does not fit"):
        media.index(stored[:-1])


def test_media_columns_of_a_text(spark):
    texts = ["", "a" * 191, "é漢" * 500, words(1, 3000)]
    got = {r.doc_id: r for r in media.text_media(documents(spark, enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = media.mux(payload)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-16:]) and got[i].media_bytes == len(stored) and got[i].media_sha256 == hashlib.sha256(stored).hexdigest()
        # where the keyframes lie follows from the payload's place alone
        at = stored.rindex(payload)
        assert [(k.start, k.length) for k in got[i].keyframes] == [(at + f * 192, 192) for f in range(0, len(payload) // 192, 8)]


def table(codec, offset, sizes, sync=None):
    b, f, u = media._box, media._full, lambda *x: struct.pack(f">{len(x)}I", *x)
    tables = [f(b"stsd", u(1), b(codec, bytes(8))), f(b"stts", u(0)), f(b"stsc", u(1, 1, len(sizes), 1) if sizes else u(0)), f(b"stsz", u(0, len(sizes), *sizes)), f(b"stco", u(1, offset) if sizes else u(0))]
    return b(b"stbl", *tables, *([f(b"stss", u(len(sync), *sync))] if sync else []))


def track(name, handler, duration, stbl, *edits):
    b, f, u = media._box, media._full, lambda *x: struct.pack(f">{len(x)}I", *x)
    listed = [b(b"edts", f(b"elst", u(len(edits)), *(struct.pack(">IiI", d, t, 0x10000) for d, t in edits)))] if edits else []
    return b(b"trak", f(b"tkhd", u(0, 0, name, 0, duration)), *listed, b(b"mdia", f(b"mdhd", u(0, 0, 1000, duration, 0)), f(b"hdlr", u(0), handler, bytes(12)), b(b"minf", stbl)))


def test_tracks_are_kept_apart():
    """Video with a sync table, then sound without one; the tables of one are not read for the other."""
    sound, video = track(1, b"soun", 70, table(b"sowt", 0, [2, 2])), track(2, b"vide", 90, table(b"raw ", 8, [10, 20, 30], [1, 3]), (90, -1), (50, 7))
    found = media.tracks(media._box(b"moov", video, sound) + media._box(b"mdat", bytes(70)))
    assert [t.codec.strip() for t in found] == ["raw", "sowt"] and [t.duration for t in found] == [90, 70]
    assert found[0].keyframes == [(8, 10), (38, 30)] and found[0].ranges == [(8, 60)] and found[0].edits == ((90, -1), (50, 7))
    assert found[1].keyframes == [(0, 2), (2, 2)] and found[1].edits == ()
    # the video is told, wherever it stands
    assert media.index(media._box(b"moov", sound, video)) == found[0]
    with pytest.raises(ValueError, match="no track"):
        media.index(media._box(b"free", b""))


def test_fragments():
    b, f, u = media._box, media._full, lambda *x: struct.pack(f">{len(x)}I", *x)
    movie = b(b"moov", track(5, b"vide", 0, table(b"avc1", 0, [])), b(b"mvex", f(b"trex", u(5, 1, 40, 7, 0x10000))))

    def moof(*runs):
        return b(b"moof", f(b"mfhd", u(1)), b(b"traf", f(b"tfhd", u(5), flags=0x20000), *runs))

    one = moof(f(b"trun", u(3, 500, 0), flags=0x5))
    two = moof(f(b"trun", u(2, 600, 11, 12), flags=0x201), f(b"trun", u(1, 0x10000), flags=0x400))
    found = media.index(movie + one + two + b(b"mdat", bytes(9)))
    first, second = len(movie), len(movie) + len(one)
    assert (found.frames, found.duration) == (6, 240)
    assert found.ranges == [(first + 500, 21), (second + 600, 30)] and found.keyframes == [(first + 500, 7)]


@pytest.mark.parametrize("split_bytes", [200, 1000, 1 << 20])
def test_archives(spark, split_bytes):
    page = "<p>" + words(1, 30)
    rows = [(3, "http://a/\r\nX: y", page), (1, None, page), (2, "u", page), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", page), (7, "u", "\x1f\x8b\x08 " * 50), (8, "u", words(2, 4000)), (1, "u", page)]
    pages = spark.createDataFrame([(i, u, h, 5) for i, u, h in rows], "page_id long, url string, html string, payload_bytes long")
    folder = warc.fresh_path(spark, "warc-test")
    manifest = warc.write_archives(warc.with_revisits(pages), folder)
    got = warc.read_archives(manifest, folder, split_bytes=split_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        again = html == page.encode() and r.page_id != 1
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if again else ("response", None))
        assert r.payload == (None if again else html)
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("split_bytes", [150, 1000, 1 << 20])
def test_damaged_archives_are_reported(spark, tmp_path, split_bytes):
    members = [warc.record(i, "u", "response", words(i, 30).encode(), hashlib.sha256(words(i, 30).encode()).hexdigest(), 9, None) for i in range(20)]
    begins = [sum(map(len, members[:i])) for i in range(21)]
    whole = b"".join(members)

    def read(data, name):
        (tmp_path / name).write_bytes(data)
        manifest = spark.createDataFrame([(f"file://{tmp_path / name}", len(data))], "path string, bytes long")
        return warc.read_archives(manifest, f"file://{tmp_path}", ("page_id", "record_type", "url"), split_bytes, "report"), manifest

    cases = {"whole": (whole, []), "head": (whole[: begins[7]] + b"xxx" + whole[begins[7] + 3 :], [7]), "body": (whole[: begins[7] + 90] + bytes(20) + whole[begins[7] + 110 :], [7]), "tail": (whole[:-9], [19]), "cut": (whole[: begins[7] + 1] + whole[begins[8] :], [7]), "first": (b"x" + whole[1:], [0])}
    for name, (data, lost) in cases.items():
        rows, manifest = read(data, name)
        got = rows.collect()
        assert sorted(r.page_id for r in got if r.record_type == "response") == [i for i in range(20) if i not in lost], name
        assert {int(r.url.rpartition("#")[2]) for r in got if r.record_type == "damaged"} == {begins[i] for i in lost}, name
        if lost:
            with pytest.raises(Exception, match="is damaged at"):
                warc.read_archives(manifest, f"file://{tmp_path}", split_bytes=split_bytes).collect()


def test_false_magic_is_passed_over(tmp_path):
    inner = zlib.compressobj(9, zlib.DEFLATED, 31)
    decoy = inner.compress(b"not a record") + inner.flush()
    member = warc.record(1, "u", "response", b"x" * 10, hashlib.sha256(b"x" * 10).hexdigest(), 10, None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(decoy + b"\x1f\x8b\x08junk" + member + decoy + member)
    import pyarrow as pa

    for lo in range(0, len(decoy)):
        with pa.OSFile(str(path)) as f:
            assert len(list(warc._Range(f, lo, path.stat().st_size).members())) == 2
