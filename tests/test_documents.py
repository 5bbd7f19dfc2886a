import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.functions.text import chunk_spans, parse_html
from quadrille.operators import documents as D
from quadrille.operators import retrieval as R
from tests.conftest import rows

HTML = """<html><head><title>no</title><style>p{}</style></head><body><h1>Tïtle &amp; more</h1><p>First  para
<b>bold</b>.<p>Second.<h2>Sub</h2><table><caption>Cap</caption><tr><th rowspan=2>A</th><th colspan="2">B</th></tr>
<tr><td>1</td><td>2</td></tr></table><script>var x = "<p>";</script>tail"""


def test_parse_html():
    d = parse_html(HTML)
    assert d["text"] == "# Tïtle & more\n\nFirst para bold.\n\nSecond.\n\n## Sub\n\nCap\n| A | B |\n| 1 | 2 |\n\ntail"
    assert [(s["heading"], s["level"], d["text"][s["char_start"]:s["char_end"]]) for s in d["sections"]] == [
        ("Tïtle & more", 1, "Tïtle & more"), ("Sub", 2, "Sub")]
    cells = [(c["row"], c["col"], c["text"], c["row_span"], c["col_span"]) for c in d["tables"][0]["cells"]]
    assert cells == [(0, 0, "A", 2, 1), (0, 1, "B", 1, 2), (1, 1, "1", 1, 1), (1, 2, "2", 1, 1)]
    assert d["tables"][0]["caption"] == "Cap" and d["text"][d["tables"][0]["char_start"]:].startswith("Cap\n|")
    assert parse_html("")["text"] == ""


@pytest.mark.parametrize("seed", range(6))
def test_chunks_cover_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["wörd", "a", "  ", "\n", ". ", "! ", "x" * 9, " "]) + " " for _ in range(rng.randrange(1, 400)))
    size, overlap = rng.choice([(5, 0), (20, 5), (50, 49), (1, 0)])
    spans = chunk_spans(text, size, overlap)
    assert all(len(text[a:b].split()) == n <= size and text[a:b] == text[a:b].strip() for a, b, n in spans)
    # Every token lies in some chunk, and chunks move forward.
    covered = set()
    for a, b, _ in spans:
        covered.update(range(a, b))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(spans, spans[1:]))
    if overlap == 0:
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_chunk_checks(spark):
    df = spark.createDataFrame([(1, "One two. Three."), (2, "   "), (3, None)], "id int, text string")
    assert rows(D.chunk(df, "id", size=2, overlap=0), "id", "chunk_index", "text") == [(1, 0, "One two."), (1, 1, "Three.")]
    with pytest.raises(ValueError):
        D.chunk(df, "id", size=10, overlap=10)


def gate(spark, confidence, span, threshold=0.5):
    df = spark.createDataFrame([(confidence, span)], "confidence_score double, char_interval struct<start:int,end:int>")
    return D.confidence_gate(df, threshold).first()


def test_gate_cases(spark):
    assert gate(spark, 0.9, (0, 14))["decision"] == "PASS"
    for confidence, span, word in ((0.9, None, "ungrounded"), (0.3, (0, 10), "low confidence"), (0.9, (10, 5), "invalid char_interval"),
                                   (0.9, (-1, 5), "invalid char_interval"), (0.1, None, "ungrounded")):
        r = gate(spark, confidence, span)
        assert r["decision"] == "QUARANTINE" and word in r["reason"]
    assert gate(spark, 0.3, (0, 10))["reason"] == "low confidence: 0.300 < threshold 0.500"
    with pytest.raises(ValueError, match="confidence_threshold"):
        gate(spark, 0.9, (0, 1), 1.5)


def test_gate_mixed(spark):
    df = spark.createDataFrame([(0.9, (0, 5)), (0.8, None), (0.2, (0, 5)), (0.5, (3, 4))], "confidence_score double, char_interval struct<start:int,end:int>")
    g = D.confidence_gate(df)
    assert D.passed(g).count() == 2 and D.quarantined(g).count() == 2


def test_rules_extract_codes_with_offsets(spark):
    text = "Bank DEUTDEFF500 (LEI 7LTWFZYICNSX8D621K86) paid EUR 1,250.50 on 2024-03-01. " * 40
    df = spark.createDataFrame([(1, text)], "id int, text string")
    found = D.rebase(D.extract(D.chunk(df, "id", size=60, overlap=0), "id"))
    counts = {r[0]: r[1] for r in found.groupBy("extraction_type").count().collect()}
    assert counts == {"BankIdentifier": 40, "LegalEntityIdentifier": 40, "MonetaryAmount": 40, "Date": 40}
    for r in found.collect():
        assert text[r["char_interval"]["start"]:r["char_interval"]["end"]] == r["text_span"]
    money = found.filter("extraction_type = 'MonetaryAmount'").first()
    assert money["attributes"] == {"currency": "EUR", "amount": "1,250.50"} and money["confidence_score"] == 1.0


def test_caller_supplied_extractor(spark):
    def extractor(text):
        return [{"extraction_type": "T", "text_span": text[:3], "attributes": {"class": "fhir:Patient", "n": 1, "none": None},
                 "char_interval": None, "confidence": 0}]

    df = spark.createDataFrame([(1, "abcdef")], "id int, text string")
    r = D.extract(D.chunk(df, "id"), "id", extractor=extractor, model_id="own").first()
    assert (r["ontology_class"], r["confidence_score"], r["char_interval"], r["model_id"]) == ("fhir:Patient", 0.0, None, "own")
    assert r["attributes"] == {"n": "1", "none": None}


def test_vertices_and_triples(spark):
    text = "Paid EUR 5 and EUR 5."
    run = D.document_run(spark.createDataFrame([(1, text)], "id int, text string"), "id", {"fibo:MonetaryAmount": D.KnownClass("MonetaryAmount")}, job_id="j", store=True)
    v = run["vertices"].collect()
    assert len(v) == 1 and v[0]["mentions"] == 2 and v[0]["vertex_type"] == "MonetaryAmount" and v[0]["char_start"] == 15
    t = run["triples"]
    assert t.select("subject").distinct().count() == 1 and t.filter("predicate LIKE '%charStart'").count() == 2
    assert D.run_triples(spark, "j", "rules", "2024-01-01T00:00:00", "g").count() == 7


def test_mime(spark):
    df = spark.createDataFrame([("a.PDF",), ("b.htm",), ("c.docx",), ("d",)], "p string")
    assert [r[0].rsplit("/", 1)[1][:8] for r in df.select(D.mime_type(F.col("p"))).collect()] == ["pdf", "html", "vnd.open", "octet-st"]


def test_hyperedges_ignore_order_and_repeats(spark):
    a = [("q", "s1", "p", "o", "C"), ("q", "s2", "p", "o", "C"), ("q", "s3", "p", "o", "D")]
    schema = "question string, s string, p string, o string, class string"
    first = R.hyperedges(spark.createDataFrame(a, schema))
    again = R.hyperedges(spark.createDataFrame(a[::-1] + a, schema))
    assert rows(first) == rows(again)
    assert all(r["id"].startswith("he_") and len(r["id"]) == 67 for r in first.collect())
    scores = spark.createDataFrame([("q", "D", 0.4)], "question string, class string, score double")
    ranked = rows(R.rank_hyperedges(first, scores, 2), "class", "score", "rank")
    assert ranked == [("C", 0.0, 2), ("D", 0.4, 1)]
    with pytest.raises(ValueError):
        R.rank_hyperedges(first, scores, 21)


def test_seeds_are_capped_per_question(spark):
    seeds = spark.createDataFrame([("q", f"s{i}", i) for i in range(9)] + [("r", "s0", 0)], "question string, seed string, position int")
    assert R.first_seeds(seeds).count() == 6
    with pytest.raises(ValueError):
        R.neighbourhood(seeds, seeds, 5)


def test_odd_spans_and_tables_in_cells():
    from quadrille.functions.text import parse_html

    page = ('<table><tr><td colspan="²">a<table><tr><td>in</td><td>ner</td></tr></table>b</td><td rowspan="99999" colspan="2">c</td></tr>'
            "<tr><td>d</td><td>e</td></tr></table><p>after</p>")
    parsed = parse_html(page)
    cells = [(c["row"], c["col"], c["text"]) for c in parsed["tables"][0]["cells"]]
    assert cells == [(0, 0, "a in ner b"), (0, 1, "c"), (1, 0, "d"), (1, 3, "e")] and len(parsed["tables"]) == 1
    assert parsed["text"].endswith("after")


def test_overlap_finds_a_mention_once_and_attributes_stay(spark):
    text = " ".join(f"word{i}." for i in range(40)) + " EUR 12 here. " + " ".join(f"tail{i}." for i in range(40))
    chunks = D.chunk(spark.createDataFrame([(1, text)], "id int, text string"), "id", size=50, overlap=30)
    found = D.rebase(D.extract(chunks, "id"))
    assert found.count() > 1 and D.distinct_mentions(found, "id").count() == 1
    rows = [("T", "x", "kg:C", {"a": "1", "b": "2"}, 0, 1), ("T", "x", "kg:C", {"b": "3", "c": None}, 5, 2)]
    made = D.vertices(spark.createDataFrame([(*r[:4], (r[4], r[4] + 1), 1.0, "m", 0, r[5]) for r in rows],
                      "extraction_type string, text_span string, ontology_class string, attributes map<string,string>, "
                      "char_interval struct<start:int,end:int>, confidence_score double, model_id string, chunk_index int, id int"), "id", {}).collect()
    assert len(made) == 1 and made[0]["attributes"] == {"a": "1", "b": "3"} and made[0]["mentions"] == 2 and made[0]["char_start"] == 5


def test_table_functions_in_sql(spark):
    from quadrille.functions import tables as B

    texts = [(1, "One two. Three four five. Six."), (2, ""), (3, None), (4, "a b c d")]
    docs = spark.createDataFrame(texts, "id int, text string")
    B.register(spark, lambda text: [{"extraction_type": "Word", "text_span": w, "attributes": {"n": len(w)}} for w in text.split()[:1]])
    got = rows(spark.sql("SELECT id, c.* FROM {docs}, LATERAL text_chunks(text, 4, 2) c", docs=docs), "id", "chunk_index", "char_start", "char_end", "token_count", "chunk")
    want = rows(D.chunk(docs, "id", size=4, overlap=2), "id", "chunk_index", "char_start", "char_end", "token_count", "text")
    assert got == want and len(got) == 3
    found = rows(spark.sql("SELECT id, text_span, char_start, confidence, attributes['n'] AS n FROM {docs}, LATERAL text_findings(text)", docs=docs))
    assert found == [(1, "One", None, 1.0, "3"), (4, "a", None, 1.0, "1")]
    for wrong in ("text_chunks(text, 4, 4)", "text_chunks(id)", "text_chunks(text, id)"):
        with pytest.raises(Exception, match="overlap must|takes a text|constant"):
            spark.sql(f"SELECT * FROM {{docs}}, LATERAL {wrong}", docs=docs).collect()


def test_slices_are_bounded_by_characters():
    texts = ["x" * 300_000] * 8 + [None, "", "y" * (2 * D.SLICE_CHARS)] + ["z"] * 5
    parts = list(D._slices(iter([pd.DataFrame({"text": texts}), pd.DataFrame({"text": []})]), "text"))
    assert [t for p in parts for t in p["text"]] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p["text"]) <= D.SLICE_CHARS for p in parts) and len(parts) > 3


def test_page_texts_of_odd_pages_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    # A heading cut within a reference, references without their semicolon or not in the SQL, no or a lower heading first, a # before a paragraph, no page.
    pages = ["<body><h1>On token = &quot</h1><p>a &quot;b&quot; &amp c &ampd &am &</p>", "<h1>T</h1><p>&copy 2020 &copy; &middot y &quotz &copycat; &AMP &lt; &#39;</p>",
             "<p>a b</p>", "<h2>Sub</h2><p>x</p><h1>Top</h1><p>y</p><h1>End</h1>", "<h1>É # a</h1><p># x</p><p>## y # z</p>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["d1_page_text"]).fetchall()
    got = rows(entry.queries()["d1_page_text"](spark, str(tmp_path)), "page_id", "words", "digest", "heading", "level")
    assert got == sorted(want) and len(got) == len(pages)
