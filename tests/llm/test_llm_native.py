"""The operators made of DataFrame expressions beside brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quadrille.llm import licenses, line_dedup, secrets


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_fixed_secrets(spark):
    rng = random.Random(1)
    bits = ["token", "=", " ", "abcdef", '"', "Secret:", "api_key", "APIKEY = ", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é😀", "\n", "passwd", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    texts += ['token=token"=abcdefgh', "", None, " ".join(f"token=abc{i:05d}" for i in range(700)), "token", "abcdef0123456789abcdef01"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = secrets.report(secrets.secret_spans(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r["doc_id"]] or "")
        named = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r["base_sha256"] == sha(",".join(named))
        assert set(named) <= set(r["spans"].split(",")) | {""}
    assert secrets.report(secrets.secret_spans(docs.limit(0))).count() == 0


def test_random_strings_stay_and_made_up_names_go(spark):
    rng = random.Random(6)
    alphabet = secrets.ALPHABETS["alnum"]
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) + "7a" for _ in range(200)]
    names = [f"section_{i}_of_the_common_document_version_{i % 7}_final" for i in range(200)]
    docs = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys)] + [(1000 + i, f"see {n} here") for i, n in enumerate(names)],
                                 "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.report(secrets.secret_spans(docs)).filter("spans <> ''").collect()}
    assert sum(i < 1000 for i in found) >= 185 and not any(i >= 1000 for i in found)


def best_stretches(words, templates):
    """(license, dice, first, last) by trying every stretch; ``templates`` are (name, words, key bigrams)."""
    found = []
    for number, (name, body, keys) in enumerate(templates):
        own = Counter(zip(body, body[1:], strict=False))
        needed, size = sum(own[k] for k in set(keys)), sum(own.values())
        grams = list(zip(words, words[1:], strict=False))
        for i in range(len(grams)):
            if grams[i] not in own:
                continue
            seen, best = Counter(), (0, None)
            for j in range(i, len(grams)):
                seen[grams[j]] += 1
                common = seen & own
                dice = 2 * sum(common.values()) / (j - i + 1 + size)
                if grams[j] in own and dice > best[0] and sum(common[k] for k in set(keys)) >= needed:
                    best = dice, j
            if best[0] >= 0.8 - 1e-9:
                found.append((-round(best[0], 12), i - best[1] - 1, i, number, best[1] + 1, name))
    taken = []
    for dice, _, first, _, last, name in sorted(found):
        if all(first > b or last < a for _, _, a, b in taken):
            taken.append((name, round(-dice, 6), first, last))
    return taken


def test_licenses(spark):
    rng = random.Random(2)
    templates = [("X", "one two three four five six seven eight nine ten"), ("Y", "Alpha, beta gamma delta?"), ("Z", "single"),
                 ("V2", "alpha beta gamma {delta 2}"), ("W", "two three four {five 5 five} six seven eight nine ten")]
    texts = ["", None, "one", "alpha beta", " -- Alpha\nBETA; gamma (delta)"]
    for _ in range(150):
        words = []
        for _ in range(rng.choice([1, 1, 2, 3])):
            body = re.sub("[{}?,]", "", rng.choice(templates)[1]).split()
            for _ in range(rng.randrange(0, 4)):
                i = rng.randrange(len(body))
                body[i:i + 1] = rng.choice([[], ["other"], [body[i], "more"]]) or body[:1]
            words += [rng.choice("pqrst") for _ in range(rng.randrange(5))] + body + ["two", "three"][:rng.randrange(3)]
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(6, texts[6], 0.5)], "doc_id long, text string, dice double")
    got = Counter(tuple(r) for r in licenses.report(licenses.license_matches(docs, templates))
                  .select("doc_id", "license", "dice", "first_word", "last_word").collect())
    words = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).split()
    parsed = [(name, words(body), [p for k in licenses.key_phrases(body) for p in zip(words(k), words(k)[1:], strict=False)]) for name, body in templates]
    want = Counter()
    for i, t in [*enumerate(texts), (6, texts[6])]:
        # A piece before a first separator counts as a word.
        before = int(bool(t) and not t[0].isalnum())
        want.update((i, name, dice, a + before, b + before) for name, dice, a, b in best_stretches(words(t or ""), parsed))
    assert got == want and len(want) > 100
    assert {name for _, name, *_ in want} == {"X", "Y", "V2", "W"}
    assert licenses.license_matches(docs.limit(0)).count() == 0


def test_default_templates_match_themselves(spark):
    docs = spark.createDataFrame([(i, body.replace(", ", ",\n")) for i, (_, body) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    found = {(r["doc_id"], r["template"]): r["dice"] for r in licenses.report(licenses.license_matches(docs)).collect()}
    assert all(found[i, i] == 1.0 for i in range(len(licenses.TEMPLATES)))


@pytest.mark.parametrize("text, want", [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-only"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-only"]),
    ("Covered by CC BY-NC-SA 4.0. Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"] * 2),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under CC BY 2.0.", []),
    ("Released under the MIT License. Some words between. Released under the MIT License.", ["MIT", "MIT"]),
    ("Released under the MIT License. Released under the MIT License. Licensed under the Mozilla Public License, version 2.0", ["MIT", "MIT", "MPL-2.0"]),
    (licenses.GNU_NOTICE.format(name="the GNU Affero General Public License", version="version 3"), ["AGPL-3.0-or-later"]),
    (licenses.GNU_NOTICE.format(name="the GNU General Public License", version="version 2"), ["GPL-2.0-or-later"]),
    (licenses.GNU_NOTICE.format(name="the GNU Lesser General Public License", version="version 2.1"), ["LGPL-2.1-or-later"]),
    (licenses.BSD_NOTICE, ["BSD-2-Clause"]),
])
def test_versions_and_variants(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = licenses.report(licenses.license_matches(docs)).orderBy("first_word").collect()
    assert [r["license"] for r in found] == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(rng, line, times):
    s = list(line)
    for _ in range(times):
        kind, i = rng.randrange(3), rng.randrange(len(s))
        s[i:i + (kind > 0)] = [] if kind == 1 else [rng.choice("abéx")]
    return "".join(s)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("ab ") for _ in range(rng.randrange(8, 40)))
        pairs.append((a, edited(rng, a, rng.randrange(0, 6))))
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within("a", "b", threshold).alias("w")).collect():
        assert r["w"] == (distance(r["a"], r["b"]) <= threshold)


def brute_repeats(docs, threshold):
    seen = []
    for doc_id, text in docs:
        digest = xxh64_intdigest((text or "").encode(), 42)
        key = (doc_id is None, doc_id or 0, digest - (1 << 64) if digest >> 63 else digest)
        seen += [(key + (n,), line) for n, line in enumerate((text or "").split("\n")) if len(line) >= line_dedup.LEAST]
    lines = sorted({line for _, line in seen})
    group = {line: line for line in lines}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                group[root(a)] = root(b)
    first = {}
    for at, line in seen:
        first[root(line)] = min(at, first.get(root(line), at))
    out = {}
    for at, line in seen:
        if first[root(line)] != at:
            out.setdefault(at[:3], set()).add(at[3])
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(20, 34))) for _ in range(40)]
    docs = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2])) for _ in range(rng.randrange(0, 4)))) for i in range(60)]
    docs += [(None, docs[5][1]), (7, docs[7][1]), (200, None), (201, ""), (202, "short\nshort")]
    return docs + [(300 + i, f"common head of very many lines {i % 10}{i // 10}") for i in range(40)]


@pytest.mark.parametrize("threshold, hot", [(1, 512), (1, 3), (2, 512)])
def test_repeated_lines(spark, documents, threshold, hot, monkeypatch):
    monkeypatch.setattr(line_dedup.near_pairs, "__defaults__", (1, hot))
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("lines", F.lit(1))
    got = {(r["doc_id"] is None, r["doc_id"] or 0, r["text_hash"]): set(r["lines"]) for r in line_dedup.repeats(docs, threshold=threshold).collect()}
    assert got == brute_repeats(documents, threshold)


def test_cleaned_documents(spark, documents):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "x") for i, t in documents], "doc_id long, text string, n_chars long, lines string")
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(documents) and sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(map(repr, (i for i, _ in documents)))
    gone = brute_repeats(documents, 1)
    texts = {}
    for doc_id, text in documents:
        digest = xxh64_intdigest((text or "").encode(), 42)
        own = gone.get((doc_id is None, doc_id or 0, digest - (1 << 64) if digest >> 63 else digest), set())
        texts.setdefault(doc_id, []).append(text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in own))
    for r in rows:
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0
    assert line_dedup.report(docs).count() == len(documents)
