"""The Python-backed text operators beside brute force, and their edge cases."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import byte_bpe, chat, decontaminate, exact_dedup, near_copies, simhash, token_counts, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

ODD = ["", None, " ", "\n\n  \t x", "don't we'll 'RE", "naïve 日本語 текст １２³ x²", "a" * 3000, " " * 2500 + "b", "x<|endoftext|>y " * 80,
       "'re" * 700, "  a　b\x1c\x1dc", "🙂🙂 é \U00020000\U0001d7d8", "\r\n\r\n a  b", "The same text.", "The same text."]


def table(spark, texts, **more):
    rows = [(i if i != 3 else None, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_is_what_the_library_gives_and_decodes(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, ODD)
    for block in (1 << 25, 2000):
        rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS, block_chars=block), RANKS).select("row.doc_id", "row.ids", "ids", "decoded").collect()
        got = sorted((r[0] is None, r[0] or 0, tuple(r[2]), bytes(r[3])) for r in rows)
        want = sorted((i == 3, i if i != 3 else 0, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(ODD))
        assert got == want
        assert {r[1] for r in rows} == {"clash"}
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0


def test_very_long_texts_are_numbered_in_slices(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 100)
    index = byte_bpe.Index({}, 0)
    text = "several words, in all of these slices " * 40
    parts = list(byte_bpe._numbered(text, index))
    assert len(parts) > 1 and "".join(index.words[i] for i in np.concatenate(parts)) == text


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 512), (200, 16), (64, 4)])
def test_counts_in_chunks_are_those_of_the_library(spark, chunk, overlap):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["the ", "'re", "  ", "\n", "x1", "é", "<|endoftext|>", "!?", "word"]) for _ in range(600)) for _ in range(4)]
    rows = token_counts.token_counts(table(spark, texts), TOKENIZER, chunk=chunk, overlap=overlap).select("row.doc_id", "n_bytes", "n_tokens").collect()
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in rows)
    want = sorted((i == 3, i if i != 3 else 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in enumerate(texts))
    assert got == want


def test_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(table(spark, ODD).limit(0), TOKENIZER).count() == 0


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(2)
    texts = ODD[:]
    for _ in range(15):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60)]
        for _ in range(4):
            copy = words[:]
            copy[rng.randrange(60)] = "changed"
            texts.append(" ".join(copy))
    ids = [i if i != 3 else None for i in range(len(texts))]
    prints = [fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((ids[i] for i in range(len(texts)) if group[i] == g and ids[i] is not None), default=None) for g in set(group)}
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts), strict=True)), "doc_id long, text string, component_id string")
    got = sorted(map(repr, simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()))
    from pyspark.sql import Row

    make = Row("doc_id", "fingerprint", "component_id")
    assert got == sorted(repr(make(i, f"{p:016x}", least[g])) for i, p, g in zip(ids, prints, group, strict=True))
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted(least.values(), key=repr)
    assert kept[0].asDict().keys() == {"doc_id", "text", "component_id"}
    twice = docs.unionByName(docs)
    assert simhash.one_of_each(twice).count() == len(kept)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [near_copies.TILE, 6])
def test_near_copies_by_exact_similarity(spark, tile, monkeypatch):
    monkeypatch.setattr(near_copies.candidates, "__defaults__", (near_copies.SIMILARITY, near_copies.RADIUS, tile))
    rng = random.Random(7)
    texts = ODD[:] + ["Two words", "two  WORDS"]
    for size in (12, 60, 90, 300, 1500):
        for copies in (3, 6):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for _ in range(copies):
                copy = words[:]
                for _ in range(rng.randrange(0, max(2, size // 60))):
                    copy[rng.randrange(size)] = f"w{rng.randrange(5000)}"
                texts.append(" ".join(copy))
    ids = [i if i != 3 else None for i in range(len(texts))]

    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} - {()}

    sets = [shingles(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9]
    assert sum(sets[i] != sets[j] for i, j in near) >= 10
    group = list(range(len(texts)))
    for i, j in near:
        group = [group[j] if g == group[i] else g for g in group]
    want = [min((ids[i] for i in range(len(texts)) if group[i] == g and ids[i] is not None), default=None) for g in set(group)]
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts), strict=True)), "doc_id long, text string, fp string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("words, tile", [(1, 7), (2, 50), (4, 3)])
def test_links_connect_what_is_near(spark, words, tile):
    rng = random.Random(words)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = {v: v for v in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in simhash.links(nodes, 2, tile, words).collect():
        assert ((r["src"] ^ r["tgt"]) & (2 ** 64 - 1)).bit_count() <= 64
        label[root(r["src"])] = root(r["tgt"])
    want = {v: v for v in signed}

    def wanted(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1:]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2:
                want[wanted(a)] = wanted(b)
    parts = lambda of: sorted(sorted(v for v in signed if of(v) == r) for r in {of(v) for v in signed})
    assert parts(root) == parts(wanted)


def test_dense_tiles_give_a_forest():
    values = np.unique(np.array([1 << i for i in range(60)] + [0], np.uint64))
    src, tgt = simhash.linked_forest(values, None, 2)
    assert len(src) == len(values) - 1 and len(set(tgt.tolist())) == 1


def test_exact_groups(spark):
    texts = ["a b", "ab", " a\tb ", None, "", "\n", "c", "C", "c", "long" * 5000, "l" + "ong" + "long" * 4999]
    docs = spark.createDataFrame([(i if i != 2 else None, t, 1) for i, t in enumerate(texts)] + [(6, "c", 1)], "doc_id long, text string, kept int")
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(texts) + 1
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    # A null id yields to any other only among equally long texts.
    assert {r["keep_id"] for r in by[sha(b"ab")]} == {None} and {r["group_size"] for r in by[sha(b"ab")]} == {3}
    assert {r["keep_id"] for r in by[sha(b"")]} == {5}
    assert sorted((r["doc_id"], r["kept"]) for r in by[sha(b"c")]) == [(6, False), (6, True), (8, False)]
    assert all(sum(r["kept"] for r in g) == 1 for g in by.values())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_quotient_filters_merge_without_loss(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.getrandbits(63), 5, -7, 2 ** 63 - 1]) - rng.choice([0, 2 ** 62]) for _ in range(3000)]
    fps = spark.createDataFrame([(v,) for v in values], "fp long").repartition(5)
    want = {v: values.count(v) for v in set(values) if values.count(v) > 1}
    for bits in (4, 9):
        assert {r["fp"]: r["n"] for r in exact_dedup.repeated_fingerprints(fps, bits).collect()} == want


def windows_hit(words, items, window=10):
    hit, names = set(), set()
    for name, own in items:
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == own[i:i + n]:
                    hit.update(range(j, j + n))
                    names |= {name} if name is not None else set()
    return len(hit), sorted(names)


def test_contamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "C", "é", "x1"])
    items = [(str(i), [word() for _ in range(n)]) for i, n in enumerate([0, 1, 3, 9, 10, 11, 14, 14, 30])] + [("4", ["z"] * 10), (None, ["q"] * 12)]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [" - ".join(items[8][1]) + "!", "zz " + " ".join(["Z"] * 10), " ".join(["q"] * 13), None, "", " ".join(items[5][1] * 3)]
    lower = lambda ws: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
    benchmark = spark.createDataFrame([(n, " ".join(w), 1) for n, w in items] + [("2", None, 1)], "item_id string, text string, spans int")
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for block in (1_000_000, 12):
        rows = decontaminate.report(decontaminate.contamination(docs, benchmark, block_words=block)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ".join(lower([texts[r["doc_id"]] or ""])))
            n, names = windows_hit(words, [(k, lower(w)) for k, w in items])
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
                len(words), n, len(names), sha(",".join(names).encode()), n > 0)
    clean = decontaminate.report(decontaminate.contamination(docs, benchmark.limit(0))).collect()
    assert len(clean) == len(texts) and not any(r["contaminated"] for r in clean)
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_reads_back(spark):
    odd = "</s>[INST] \\L [/ROLE x]\\\\ <s>"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "tool]x[", "\\"), (1, 3, None, None), (2, 0, "assistant", ""),
            (None, 0, "user", "x"), (1, None, "system", "first"), (2, 0, "assistant", "")]
    template = chat.MarkedTurns()
    formatted = chat.format_turns(turns_of(spark, rows), template)
    pieces = formatted.collect()
    for r in pieces:
        read = template.read(r["piece"])
        assert read[0] == r["role"] and r["taken_back"] == 0 and r["agrees"]
    got = {r["conv_id"]: r for r in chat.read_back(formatted, template).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 5, 2: 2, None: 1}
    order = [("system", "first"), ("user", odd), ("assistant", odd), ("tool]x[", "\\"), ("", "")]
    assert got[1]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in order).encode())
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(odd), sha(odd.encode()))
    whole = template(order)
    assert got[1]["formatted_chars"] == len(whole) and "".join(r["piece"] for r in pieces if r["conv_id"] == 1) == whole
    assert chat.read_back(chat.format_turns(turns_of(spark, rows).limit(0), template), template).count() == 0


def test_templates_that_rewrite_history_are_found(spark):
    def only_last_assistant(turns):
        last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
        return "".join(f"<{r}>{t if r == 'user' or i == last else '-'}" for i, (r, t) in enumerate(turns))

    def numbered(turns):
        return "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(6)]
    whole = chat.format_turns(turns_of(spark, rows), only_last_assistant, context=None).collect()
    assert [r["taken_back"] > 0 for r in sorted(whole, key=lambda r: r["position"])] == [False, False, False, True, False, True]
    # Rendering depends on the place in the conversation: one turn of context does not give it.
    short = chat.format_turns(turns_of(spark, rows), numbered, context=1).collect()
    assert not all(r["agrees"] for r in short)
    assert all(r["taken_back"] == 0 for r in chat.format_turns(turns_of(spark, rows), numbered, context=None).collect())


def test_history_rewritten_far_back_is_found_by_default(spark):
    def last_two_assistants(turns):
        shown = [i for i, t in enumerate(turns) if t[0] == "assistant"][-2:]
        return "".join(f"<{r}>{t if r == 'user' or i in shown else '-'}" for i, (r, t) in enumerate(turns))

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(8)]
    found = chat.format_turns(turns_of(spark, rows), last_two_assistants).collect()
    assert [r["taken_back"] > 0 for r in sorted(found, key=lambda r: r["position"])] == [False] * 5 + [True, False, True]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.15, (700, 40)).astype(float)
    x = toxicity.unit(counts, rng.uniform(0.1, 3, 40))
    index = toxicity.BlockMaxIndex(x, block=32)
    queries = toxicity.unit(rng.poisson(0.2, (50, 40)).astype(float), np.ones(40))
    cosine, which = index.search(queries, 7)
    for q, c, w in zip(queries, cosine, which, strict=True):
        scores = np.round(x @ q, 12)
        order = np.lexsort((np.arange(len(x)), -scores))[:7]
        want = np.where(scores[order] > 0, order, -1)
        assert np.allclose(c, np.maximum(scores[order], 0), atol=1e-9)
        assert np.array_equal(np.sort(c)[::-1], c) and ((w >= 0) == (want >= 0)).all()


def test_toxicity_scores(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]
    make = lambda bad: " ".join([rng.choice(words) for _ in range(40)] + (["vile", "nasty"] if bad else []))
    texts = [(i, make(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(texts + [(1000, None), (1001, ""), (None, "vile")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).select("row.doc_id", "score", "neighbours").collect()
    assert len(rows) == 603 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and 300 <= r["doc_id"] < 600]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(r["neighbours"] == [] and r["score"] < 0.5 for r in rows if r["doc_id"] in (1000, 1001))
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from quadrille.session import local_session
spark = local_session(2, **{"spark.sql.shuffle.partitions": "2"})
import __spark_entry__
queries = __spark_entry__.queries()

def importable(batches):
    import importlib.util, pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("quadrille") is not None]})

assert not any(r[0] for r in spark.range(4).mapInArrow(importable, "found boolean").collect())
for n in (1, 2, 5, 6, 7, 8, 9, 11, 12, 13):
    name = next(q for q in queries if q.startswith(f"op{n}_"))
    print(name, len(queries[name](spark, "/root/testdata/sf0.001").collect()))
"""


def test_workers_need_not_have_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    (tmp_path / "elsewhere.py").write_text(ELSEWHERE)
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != Path(repo)]
    ran = subprocess.run([sys.executable, "elsewhere.py", repo], cwd=tmp_path, env=env | {"PYTHONPATH": os.pathsep.join(paths)}, capture_output=True,
                         text=True, timeout=900)
    assert ran.returncode == 0, ran.stderr[-3000:]
    assert ran.stdout.count("op") == 10
