import hashlib
import re

from plumbline.llm import fill_middle
from plumbline.llm.fill_middle import fill_in_middle, restored
from plumbline.llm.queries import QUERIES

from .conftest import documents, words


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, df):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0), *map(str, plainly(r.doc_id, r.text)), r.text or "") for r in rows)
    out = fill_in_middle(df)
    got = out.select("*", restored(out.form, out.output).alias("back")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in got) == want
    return got


def test_given_documents(spark, sf_dir):
    got = check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd, empty):
    check(spark, odd)
    assert fill_in_middle(empty).count() == 0


def test_marks_and_code_points(spark):
    texts = ["a<P>b", "<S>", "x <M", "<P" + "> ", "<<S>", "<", "P>", "<P <S <M >", "é漢字\U0001f600ab\x00c\r\n", "ÿÿþ", "A", " ", "ab", "İıſK", "﻿a"]
    got = check(spark, documents(spark, [(100 * k + i, t) for k in range(8) for i, t in enumerate(texts)]))
    assert {r.form for r in got if r.doc_id % 100 in (0, 1)} == {"plain"}
    assert len({r.form for r in got if r.doc_id % 100 == 2}) > 1


def test_slices_of_few_bytes_and_a_long_text(spark, monkeypatch):
    """Texts larger than a slice and slices of several texts give the same; the workers see the module's constant through the closure."""
    texts = [(i, words(i, 1 + 40 * (i % 7))) for i in range(40)] + [(99, words(99, 60_000))]
    check(spark, documents(spark, texts))
    import pyarrow as pa

    rows = [(i, t, *(i * k + 1 for k in (7, 11, 13, 17))) for i, t in texts[:-1]]
    batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "text", "h1", "h2", "h3", "h4"), r, strict=True)) for r in rows])
    whole = pa.Table.from_batches(fill_middle._formed(iter([batch]))).to_pylist()
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 300)
    assert pa.Table.from_batches(fill_middle._formed(iter([batch.slice(0, 5), batch.slice(5)]))).to_pylist() == whole


def test_the_query_restores_every_text(spark, sf_dir):
    rows = QUERIES["op11_fill_middle"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert all(r.output_sha256 == hashlib.sha256(plainly(r.doc_id, texts[r.doc_id])[4].encode()).hexdigest() for r in rows)
