import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from freightlens.llm import fim

MARKS = fim.Rule().marks()


def by_hand(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_written_and_restored(spark, make_docs):
    texts = ["", None, "a", "ab<", "<P", "S><M", "x<P>y", "<S>", ">>", "äöü€😀" * 40, "é‍" * 7, "line\n" * 90_000, "😀" * 200_000]
    rows = [(1000 * j + i, t) for i, t in enumerate(texts) for j in range(12)] + [(None, "no key at all"), (5, "same"), (5, "same")]
    docs = make_docs(rows).withColumns({"fim": F.lit(1), "Restored": F.lit(2)})
    out = fim.transformed(docs)
    assert out.columns == [*docs.columns, "fim_"]
    back = fim.restored(out.select("doc_id", "text", "Restored", "fim_.*"), "output", "form")
    found = back.collect()
    assert len(found) == len(rows)
    for r in found:
        n, form, first, middle, text = by_hand(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, first, middle, text)
        assert r["output_sha256"] == sha(text)
        assert r["restored_"]["text"] == (r["text"] or "") and r["restored_"]["sha256"] == sha(r["text"] or "")
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.transformed(make_docs([])).count() == 0


def test_restored_reads_outputs_and_forms_alone(spark):
    rows = [("<P>a<S>c<M>b", "psm"), ("<S>c<P>a<M>b", "spm"), ("abc", "plain"), ("abc", None), (None, "plain"), ("<P><S><M>", "psm")]
    back = fim.restored(spark.createDataFrame(rows, "output string, form string"), "output", "form").collect()
    assert [r["restored"]["text"] for r in back] == ["abc", "abc", "abc", "abc", "", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSMé😀", max_size=30), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_pieces_come_back_in_order(text, one, two, form):
    raw = text.encode()
    if any(m in raw for m in MARKS):
        return
    pieces = [(fim.TEXT, 0, len(raw))]
    for at in sorted((min(one, len(raw)), min(two, len(raw)))):
        pieces = fim.split(pieces, at)
    assert len(pieces) == 3 and b"".join(fim.stream(pieces, (raw, b""))) == raw
    buffers = (raw, b"".join(MARKS))
    written = fim.arrange(pieces, form, MARKS)
    output = b"".join(fim.stream(written, buffers))
    assert fim.digest(written, buffers) == hashlib.sha256(output).hexdigest()
    back = fim.read_parts(output, form, MARKS)
    assert b"".join(fim.stream(back, (output, b""))) == raw


def test_shares_follow_the_rule(spark, make_docs):
    docs = make_docs([(i, "some words to cut") for i in range(2000)])
    forms = dict(fim.transformed(docs, fim.Rule(rearranged=50, spm=100)).groupBy("fim.form").count().collect())
    assert set(forms) == {"plain", "spm"} and 900 < forms["spm"] < 1100
