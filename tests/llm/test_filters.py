"""Quality rules, language identification, HTML extraction, token counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest

from postella.llm import queries
from postella.llm.gbt import fit
from postella.llm.html_extract import extract, main_text
from postella.llm.lang_id import identify
from postella.llm.quality import FEATURES, assess, keep_good
from postella.llm.token_counts import Ledger, changes, count_tokens, tokenizer

from .conftest import SF, by_id, passage, texts_of

WORD = r"[^\x20\x09-\x0D]+"


def brute_counts(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = [0] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [1] * 5
    n = sum(mark)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 1), (14, 1), (16, 1), (10, 0), (None, 1), (7, None), (8, 0), (8, 0), (99, 1)], "doc_id long, quality int")


def test_quality_of_tricky(tricky, labels):
    got = by_id([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in assess(tricky, labels).collect()])
    assert got == by_id([(d, *brute_counts(t)) for d, t in texts_of(tricky)])
    kept = assess(tricky, labels).where("kept").collect()
    assert kept and not any(r.base_failed for r in kept)
    rows = keep_good(tricky, labels)
    assert rows.columns == tricky.columns and sorted(map(str, (r[0] for r in rows.collect()))) == sorted(str(r.doc_id) for r in kept)


def test_quality_samples_at_most_so_many_rows(spark, tricky, monkeypatch):
    from postella.llm import quality

    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, m: seen.append(len(y)))
    docs = spark.createDataFrame([(i % 5, f"{passage(30, i)}") for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3, "doc_id long, quality int")
    quality.train(docs, marks, "doc_id", "text", "doc_id", "quality", 150)
    quality.train(docs, marks, "doc_id", "text", "doc_id", "quality", 1000)
    assert seen == [150, 180]


def test_quality_without_labels(tricky, empty, labels):
    out = assess(tricky, labels.limit(0)).collect()
    assert {r.score for r in out} == {None} and all(r.kept != r.base_failed for r in out)
    assert assess(empty, labels).count() == 0


def test_quality_learns(spark, documents):
    rows = {r.doc_id: r for r in queries.op7_quality_rules(spark, SF).collect()}
    for d, t in texts_of(documents):
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(rows[d].score >= 0.5) == bool(q) for d, q in label.items() if d in rows]
    assert np.mean(right) > 0.95


def test_trees_respect_constraints_and_flatten_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000) / 2 > 0).astype(float)
    t = fit(x, y, np.array([1, 0, -1]))
    assert ((t.predict(x) > 0.5) == y).mean() > 0.85
    grid = np.repeat(rng.normal(size=(50, 3)), 60, axis=0)
    for f, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, f] = np.tile(np.linspace(-3, 3, 60), 50)
        assert (sign * np.diff(t.raw(g).reshape(50, 60), axis=1) >= -1e-9).all()

    def walk(row, node):
        while t.left[node] != node:
            node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
        return t.value[node]

    assert np.allclose(t.raw(x[:40]), [t.base + sum(walk(r, root) for root in t.roots) for r in x[:40]])
    assert len(FEATURES) == 15


def test_language(spark, documents, tricky, empty):
    got = {r.doc_id: r for r in queries.op9_language_id(spark, SF).collect()}
    rows = {r.doc_id: r for r in documents.collect()}
    held = [d for d in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d in got if got[d].held_out} == set(held)
    assert np.mean([got[d].lang_pred == rows[d].lang for d in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    t = by_id([(r.doc_id, r.lang_pred) for r in identify(tricky).collect()])
    assert t[4] == t[5] == t[6] == [("und",)] and all(v[0][0] in ("en", "fr") for k, v in t.items() if k not in (4, 5, 6))
    assert identify(empty).count() == 0
    assert {r.lang_pred for r in identify(spark.createDataFrame([(2, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_language_reads_no_other_column(spark, documents):
    a = {r.doc_id: r.lang_pred for r in identify(documents).collect()}
    swapped = documents.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end lang")
    assert a == {r.doc_id: r.lang_pred for r in identify(swapped).collect()}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="page"><header><a href=/>Site</a></header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>One<b>bold</b> &eacute;&#33;&nbsp;end<p>Two <!-- no --> lines<br>here<script>var x="</p>";</script>
<div class="ad">Buy</div><aside>Side</aside><form><input value=a>Send</form><section id="comments"><p>First!</p></section><p>Last</article><footer>&copy; us</footer></body>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\nOnebold é! end\nTwo lines\nhere\nLast"
    long = "A sentence of some length that stands for the running text of an article without marked container. "
    unmarked = f"<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div class='sidebar'>{long}</div><p><a href=c>Next</a></p>"
    assert main_text(unmarked) == f"{long.strip()}\nShort.\n{long.strip()}"
    assert [main_text(x) for x in ("", "plain", "<p>cut <b", "&lt;tag&gt;", "<script>never closed")] == ["", "plain", "cut", "<tag>", ""]


def test_pages(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op6_html_extraction(spark, SF).collect()}
    assert set(got) == set(rows)
    for k, r in rows.items():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", article)]
        assert got[k].text == "\n".join(b for b in blocks if b) and got[k].n_chars == len(got[k].text) and got[k].url == r.url


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "u"), (None, "<p>x", None), (2, "", "u"), (2, "", "u"), (3, "<div>" * 3000 + "deep", "u")], "page_id long, html string, url string")
    got = sorted(((r.page_id, r.url, r.text) for r in extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", ""), (None, None, "x"), (2, "u", ""), (2, "u", ""), (3, "u", "deep")], key=repr)
    assert extract(df.limit(0)).count() == 0


def totals(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in df.collect()}


def brute_totals(rows, version="byte_bpe_50k"):
    e = tokenizer(f"/opt/tokenizers/{version}.tiktoken")
    out: dict = {}
    for _, t, lang, source in rows:
        n = out.setdefault((source, lang, version), [0, 0, 0])
        n[0] += 1
        n[1] += len(e.encode_ordinary(t or ""))
        n[2] += len((t or "").encode())
    return {k: tuple(v) for k, v in out.items()}


def test_ledger(spark, tricky, tmp_path):
    rows = [tuple(r)[:4] for r in tricky.collect()]
    counted = count_tokens(tricky).persist()
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.totals().count() == 0
    assert ledger.commit("a", changes(inserted=counted)) and not ledger.commit("a", changes(inserted=counted))
    assert totals(ledger.totals()) == brute_totals(rows)
    gone = counted.where("doc_id = 14")
    assert ledger.commit("b", changes(deleted=gone))
    assert totals(ledger.totals()) == brute_totals([r for r in rows if r[0] != 14])
    new = count_tokens(spark.createDataFrame([(1, "new text", "de", "a")], "doc_id long, text string, lang string, source string"))
    assert ledger.compact()
    assert ledger.commit("c", changes(revised=(counted.where("doc_id = 1"), new))) and not ledger.commit("b", changes(deleted=gone))
    want = brute_totals([r for r in rows if r[0] not in (1, 14)] + [(1, "new text", "de", "a")])
    assert totals(Ledger(spark, str(tmp_path / "l")).totals()) == want
    assert ledger.compact() and totals(ledger.totals()) == want
    everything = changes(deleted=count_tokens(tricky).where("doc_id is null or doc_id not in (1, 14)")).union(changes(deleted=new))
    assert ledger.commit("d", everything) and totals(ledger.totals()) == {}


def test_unmarked_data_does_not_count(spark, tricky, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    batch = changes(inserted=count_tokens(tricky))
    batch.write.parquet(str(tmp_path / "l/data/stray"))  # a writer that died before its marker
    assert ledger.totals().count() == 0 and ledger.commit("a", batch)
    assert sum(v[0] for v in totals(ledger.totals()).values()) == tricky.count()


def test_count_query(spark, documents, empty):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()]
    assert totals(queries.op8_token_counts(spark, SF)) == brute_totals(rows)
    assert count_tokens(empty).count() == 0
