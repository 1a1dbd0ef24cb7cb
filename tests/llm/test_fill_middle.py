import hashlib
import re

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import fill_middle as M

ROWS = "doc_id long, text string, form int, piece string, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_python(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 20:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_every_given_document(spark):
    data = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{data}/documents.parquet").to_pydict()
    expected = sorted(map(plain_python, docs["doc_id"], docs["text"]))
    df = M.op13_fill_middle(spark, data)
    got = sorted(tuple(row) for row in df.select(COLUMNS).collect())
    assert got == expected
    assert {row[2] for row in got} == {"plain", "psm", "spm"}


def test_odd_rows_and_small_chunks(spark, rows):
    texts = ["", None, "a", "\n", "<P>", "x <S> y", "<<M", "<S", "été straße 日本 a\U0001f600b", "word " * 50_000, "a" * 200_000, "<" * 999, "P>a", "<P" * 300]
    data = [(k, text) for k, text in enumerate(texts * 7)]
    data += [(3, "same row again")] * 9 + [(3, "another text")] + [(None, "no id")] * 3 + [(None, None)] * 2
    df = spark.createDataFrame([(i, t, 1, "c", "d") for i, t in data], ROWS).repartition(5)
    expected = sorted((plain_python(i, t) for i, t in data), key=repr)
    for chunk in (M.CHUNK_UNITS, 7):
        assert rows(M.fill_middle(df, chunk_units=chunk), *COLUMNS) == expected
    assert M.fill_middle(df.limit(0)).count() == 0
    by_id = {(r["doc_id"], sha(r["output"])) for r in M.outputs(df).collect()}
    assert by_id == {(e[0], e[5]) for e in expected}


def test_one_row_a_third_of_all_times(spark):
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, 3, id) AS doc_id", "IF(id % 3 = 0, 'hot text', concat('text ', id)) AS text")
    got = M.fill_middle(df)
    assert got.count() == 30_000
    assert [tuple(r) for r in got.filter("doc_id = 3").select(COLUMNS).distinct().collect()] == [plain_python(3, "hot text")]
    # One exchange; the second sort has none below it.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 2


@given(st.lists(st.text(alphabet="<>PSMab ", max_size=12), max_size=8), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_outputs_are_cut_wherever_pieces_end(parts, size):
    texts = [p for p in parts if not any(m in p for m in M.MARKERS.values())]
    prefix, middle, suffix = (texts + [""] * 3)[:3]
    whole = prefix + middle + suffix
    if any(m in whole for m in M.MARKERS.values()):
        return
    for form, output in (("psm", f"<P>{prefix}<S>{suffix}<M>{middle}"), ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}")):
        cutter, out = M.Cutter(form), []
        for at in range(0, len(output), size):
            out += cutter.feed(output[at : at + size])
        out += cutter.close()
        assert "".join(text for _, _, text in sorted(out)) == whole
        assert (cutter.chars["prefix"], cutter.chars["middle"]) == (len(prefix), len(middle))
