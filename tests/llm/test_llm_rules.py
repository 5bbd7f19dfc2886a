"""Quality rules, periodic runs and structure repair beside brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import periodic, quality_rules, queries, repair

ODD = ["", None, " \t\n", "one", "a " * 4000, "é😀 x\x0b\x0cy\xa0z", "The same text here.", "The same text here.", "\n".join(["line one", "", " ", "line one", "two"] * 3)]


def docs_of(spark, texts, lang="en"):
    rows = [(i if i != 3 else None, t, lang if i % 4 else None, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, runs string, n_words int")


# --- periodic runs


def runs_of(words, least=periodic.LEAST):
    n, best = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in best.items())


def made_up(rng):
    kind, n = rng.randrange(6), rng.randrange(0, 110)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 2:
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        words = [unit[i % len(unit)] for i in range(n)]
        for _ in range(rng.randrange(3)):
            if words:
                words[rng.randrange(n)] = 9
        return words
    if kind == 3:
        part = [rng.randrange(2) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 12)
        return ((part + part[::-1] + part) * 2)[:n]
    if kind == 4:  # two stretches of one period that touch: a run for every distance between them
        part = [0, 1] * rng.randrange(2, 14)
        return [2, *part[:-1], *part[:-1], *part[:-1], 3]
    return [7] * n


def test_runs_are_those_of_brute_force():
    rng = random.Random(11)
    for _ in range(250):
        texts = [made_up(rng) for _ in range(rng.randrange(1, 6))]
        sizes = np.array([len(t) for t in texts])
        start, end, period = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), sizes)
        before = np.r_[0, np.cumsum(sizes)]
        want = sorted((s + before[i], q, e + before[i]) for i, t in enumerate(texts) for s, q, e in runs_of(t))
        assert list(zip(start.tolist(), period.tolist(), end.tolist())) == want


def test_long_periodic_texts_take_n_log_n_candidates():
    fibonacci = [0, 1]
    a = [0]
    while len(fibonacci) < 60_000:
        a, fibonacci = fibonacci, fibonacci + a
    for words, count in (([5] * 60_000, 1), (([0, 1] * 15_000)[:-1] * 2, None), (fibonacci[:60_000], None)):
        words = np.array(words, np.int64)
        s = periodic.Suffixes(words, np.zeros(len(words), np.int64), np.array([len(words)]))
        made = sum(len(at) for at, _ in periodic._candidates(s, np.array([0]), np.array([len(words)])))
        assert made < 6 * len(words) * math.log2(len(words))
        start, _, _ = periodic.find_runs(words, np.array([len(words)]))
        assert count is None or len(start) == count


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    words = np.array([rng.randrange(3) for _ in range(300)], np.int64)
    s = periodic.Suffixes(words, np.zeros(300, np.int64), np.array([300]))
    assert s.array.tolist() == sorted(range(300), key=lambda i: words[i:].tolist())


def test_runs_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 20_000)
    texts = [*ODD, "x y " * 9, "p q r s t u v w x y z " * 2, "head " + "a b c " * 5 + "tail"]
    docs = docs_of(spark, texts)
    got = {(r["row"]["doc_id"], r["row"]["runs"]): r for r in periodic.periodic_runs(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i if i != 3 else None, "clash"]
        words = (text or "").encode().split()
        want = runs_of(words)
        assert [(x["start"], x["period"], x["start"] + x["length"]) for x in r["runs"]] == want and r["n_words"] == len(words)
        gone = {k for s, q, e in want for k in range(s + q, e)}
        assert r["collapsed"] == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_repeated_stretches_of_the_query(spark):
    import zlib

    texts = [" ".join(f"w{k}" for k in range(i % 40)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    changed = 0
    for r in queries.with_periods(docs).collect():
        words, h = texts[r["doc_id"]].split(), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            changed += 1
        assert r["text"].split() == words
    assert changed


# --- structure repair


def least_repair(turns):
    """Every edit of every turn, by state of the grammar; least cost, then first audit."""
    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def insert(best):
        for _ in range(4):
            for q, (cost, audit) in list(best.items()):
                for role in "ua":
                    z = after.get((role, q))
                    if z is not None and (z not in best or (cost + 2, audit + "I") < best[z]):
                        best[z] = (cost + 2, audit + "I")
        return best

    best = {0: (0, "")}
    for initial, goes, cut in turns:
        found = {}
        for q, (cost, audit) in insert(best).items():
            options = [(q, cost + 3, "D")]
            if not goes:
                options += [(after.get((initial, q)), cost + cut, "K")]
                options += [(after.get((role, q)), cost + 2 + cut, "R") for role in "ua" if role != initial]
            for z, c, edit in options:
                if z is not None and (z not in found or (c, audit + edit) < found[z]):
                    found[z] = (c, audit + edit)
        best = found
    best = insert(best)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("lengths, times", [(range(9), 900), ((20, 31, 32, 33, 64, 70, 100), 25)])
def test_repair_is_the_cheapest_with_the_first_audit(lengths, times):
    rng = random.Random(4)
    for _ in range(times):
        turns = [(rng.choice(["s", "u", "a", "u", "a", " ", "", "x"]), rng.random() < 0.15) for _ in range(rng.choice(lengths))]
        turns = [(initial, goes, not goes and rng.random() < 0.2) for initial, goes in turns]
        assert repair.repair(turns) == least_repair(turns)


def test_repaired_roles_follow_the_grammar():
    rng = random.Random(8)
    for _ in range(300):
        turns = [(rng.choice("suax"), rng.random() < 0.2, False) for _ in range(rng.randrange(45))]
        roles = [r for r, _ in repair.repaired(repair.repair(turns)[1], ((t[0], "") for t in turns))]
        body = "".join(r[0] for r in roles)
        assert body == "" or body.removeprefix("s") == "ua" * (len(body) // 2)


def brute_report(rows):
    rows = sorted(((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x) for t, r, x in
                   ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows)))
    seen, turns, counts, illegal = set(), [], [0, 0, 0], 0
    for known, turn, _, role, text in rows:
        bare = text.rstrip(repair.BLANKS)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if turns:
            illegal += turns[-1][0] + role[:1] not in ("su", "ua", "au")
        if fault is not None:
            counts[fault] += 1
        turns.append((role[:1], fault in (0, 1), fault == 2))
    numbers = [t for known, t, *_ in rows if known]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit = least_repair(turns)
    out, places, headed = [], iter(rows), False
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(places)[3:]
        if edit == "D":
            continue
        headed = headed or not out and edit == "K" and role[0] == "s"
        if edit != "K":
            role = ("user", "assistant")[(len(out) - headed) % 2]
        out.append((role, text))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()), out


def test_reports_of_odd_conversations(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.choice([1, 2, 3, 5, 8, 40])):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 5, 9]), rng.choice(["user", "assistant", "system", "tool", None, ""]),
                         rng.choice(["Yes.", "No", "", None, " \n", "Why? \t", "Ünï!", "long " * 400]), "clash"))
    rows += rows[:40]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    found = repair.audits(turns)
    got = {r["conv_id"]: r for r in repair.report(turns, found).collect()}
    text = {}
    for r in repair.repaired_turns(turns, found).collect():
        text.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
    assert len(got) == 61
    for conv in [*range(60), None]:
        want, out = brute_report([r[1:4] for r in rows if r[0] == conv])
        r = got[conv]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == want
        assert [(a, b) for _, a, b in sorted(text.get(conv, []))] == out
    gone = repair.audits(turns.withColumn("dropped", F.lit(True))).collect()
    assert len(gone) == 61 and all((r["gaps"], r["cost"], r["audit"]) == (0, 0, "") for r in gone)
    for kind in (repair.audits(turns.limit(0)), repair.report(turns.limit(0), found.limit(0)), repair.repaired_turns(turns.limit(0), found.limit(0))):
        assert kind.count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant" if t % 2 else "user", "One. Two! Three?") for c in range(20) for t in range(12)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if k == 1:
            x = ""
        if k == 2:
            x = "One Two Three"
        want += [(c, t, "user" if k == 4 else r, x, k == 0)] * (2 if k == 3 else 1)
    assert sorted(map(repr, map(tuple, repair.damage(turns).collect()))) == sorted(map(repr, want))


# --- quality rules


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {i + k for places in where.values() if len(places) > 1 for i in places for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.encode().split():
            lines += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), lines, len(repeated)


def test_counts_of_texts():
    rng = random.Random(6)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(["a ", "b ", "c", " ", "\n", "#", "é<", "|", "\x0b", "w x y "]) for _ in range(rng.randrange(80))) for _ in range(200)]
    for text in texts:
        assert quality_rules.features(text)[:5] == brute_counts(text)
        assert all(0 <= s <= 1000 for s in quality_rules.features(text)[5:])


def test_binomial_tail_is_exact():
    from fractions import Fraction

    for k, n, rate in ((0, 40, 0.02), (3, 200, 0.02), (10, 30, 0.4), (30, 30, 0.4)):
        p = Fraction(rate)
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_tail(k, n, rate) == pytest.approx(float(want), rel=1e-9)


def corpus(n, rng, bad_share=0.2):
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        bad = rng.random() < bad_share
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        if bad:
            words = [w + "###" if rng.random() < 0.6 else w for w in words]
        elif rng.random() < 0.05:
            words = [w + "#" if rng.random() < 0.1 else w for w in words]
        rows.append((i, lang, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_cutoffs_reject_the_bad_and_keep_the_good(spark):
    rows, labels = corpus(6000, random.Random(1))
    fresh, truth = corpus(1500, random.Random(2))
    docs = spark.createDataFrame(rows + [(10_000 + i, g, t) for i, g, t in fresh], "doc_id long, lang string, text string")
    got = {r["row"]["doc_id"]: r for r in quality_rules.verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == 7500 and not any(r["base_failed"] for r in got.values())
    good = [got[10_000 + i]["kept"] for i, q in truth if q]
    bad = [got[10_000 + i]["kept"] for i, q in truth if not q]
    assert sum(bad) < 0.05 * len(bad) and sum(not k for k in good) < 0.04 * len(good)
    assert {r["row"]["lang"] for r in got.values() if r["chosen"] >= 0} == {"en", "de", None}


def test_the_limit_holds_for_uninformative_labels(spark):
    """Labels that say nothing: what is lost of the good stays below the limit, or nothing is rejected."""
    rows, _ = corpus(3000, random.Random(3))
    rng = random.Random(4)
    labels = [(i, int(rng.random() < 0.5)) for i, _, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = quality_rules.verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sum(not r["kept"] for r in out) <= 0.05 * len(out)


def test_without_enough_labels_nothing_is_rejected(spark):
    rows, labels = corpus(80, random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for known in (spark.createDataFrame(labels, "doc_id long, quality int"), none):
        assert all(r["kept"] for r in quality_rules.verdicts(docs, known).collect())


def test_rules_on_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, 0), (None, 1), (99, 1), (1, None), (2, 7)], "doc_id long, quality int")
    out = quality_rules.verdicts(docs, labels).collect()
    assert len(out) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in out)
    assert {r["row"]["n_words"] for r in out} == {1}
    assert quality_rules.verdicts(docs.limit(0), labels).count() == 0
