import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import leak, quality
from fieldloom.llm.leak import find_leaks, leak_report
from fieldloom.llm.mix import TOKENIZER, mix, source_rates
from fieldloom.llm.quality import faults, text_class, text_statistics


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(leak, "BROADCAST_ROWS", limit)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 10  # few words, so that much nearly matches
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(0, 60)), None) for i in range(25)] + [(90, None, "x"), (91, "", "x"), (92, "a b c", "x"), (93, " ".join(f"K{i}" for i in range(12)), "x")]
    docs = [(i, text(r.randint(0, 200)), "x") for i in range(40)] + [(100, None, "x"), (101, "", "x"), (102, "…".join(f"k{i}" for i in range(12)) + "!", "x"), (103, "the " * 3000, "x"), (104, "the " * 12, "x")]
    for i in range(30):
        w = words(r.choice(items)[1])
        if len(w) >= 13:
            a = r.randint(0, len(w) - 12)
            docs.append((200 + i, f"{text(20)}, {' -- '.join(w[a : a + r.choice([11, 12, 13])]).upper()}; {text(15)}", "x"))
    docs += [(300 + i, f"{text(7)} {words(items[i][1])and ' '.join(words(items[i][1]))} . {text(3)}", "x") for i in range(25)] + [(400, "so A, b; C!", "x")]
    run = {i[0]: min(12, len(words(i[1]))) for i in items}
    expected = {(d[0], i[0]) for d in docs for i in items if run[i[0]] and grams(d[1], run[i[0]]) & grams(i[1], run[i[0]])}
    assert len(expected) > 12 and (400, 92) in expected and len(set(run.values())) > 4
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, signature string")
    got = find_leaks(df, it).collect()
    assert {tuple(x)[:2] for x in got} == expected and len(got) == len(expected) and all(x["run"] == run[x["item_id"]] for x in got)
    texts, tests = {d[0]: d[1] for d in docs}, {i[0]: i[1] for i in items}
    for doc, item, n, containment in got:
        assert containment == len(grams(texts[doc], n) & grams(tests[item], n)) / len(grams(tests[item], n))
    if limit:
        named = it.select("item_id", "text", F.lit("s").alias("suite"), F.lit("t").alias("split"))
        counts = Counter(i for _, i in expected)
        assert {x["item_id"]: x["n_documents"] for x in leak_report(find_leaks(df, it), named).collect()} == {i[0]: counts[i[0]] if run[i[0]] else None for i in items}
        assert find_leaks(df.limit(0), it).collect() == [] and find_leaks(df, it.limit(0)).collect() == []


DOCS = "doc_id long, text string, source string, n_tokens string, rate string"
TARGETS = "source string, target_share double, max_repeats int"
needs_tokenizer = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no vocabulary file here")


@needs_tokenizer
def test_mix_equals_the_formula(spark):
    r = random.Random(6)
    sources = ["wiki"] * 300 + [" Wiki "] * 20 + ["CHAT"] * 60 + ["rare"] * 6 + ["other"] * 30 + [None] * 10
    docs = [(i, r.choice([None, "", *["word, <|endoftext|> é " * r.randint(1, 30)] * 20]), s, None, "x") for i, s in enumerate(sources)]
    targets = [("wiki", 0.5, 1), ("chat", 0.3, 3), ("rare", 0.1, 4), ("none", 0.1, 2), (None, 0.3, 1), ("zero", 0.0, 5)]
    mixed, report = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    report = {x["source"]: x for x in report.collect()}
    assert set(report) == {"wiki", "chat", "rare", "other", None, "none", "zero"}
    share, cap = {"wiki": 0.5 / 0.9, "chat": 0.3 / 0.9, "rare": 0.1 / 0.9}, {"wiki": 1, "chat": 3, "rare": 4}
    total = min(cap[s] * report[s]["n_tokens"] / share[s] for s in share)
    got = mixed.collect()
    used = Counter(x["doc_id"] for x in got)
    for s in share:
        rate = total * share[s] / report[s]["n_tokens"]
        assert report[s]["aimed_share"] == pytest.approx(share[s])
        assert report[s]["rate"] == pytest.approx(rate) and rate <= cap[s] + 1e-9
        for i, _, source, *_ in docs:
            if source is not None and source.strip().lower() == s:
                seeded = xxhash.xxh64_intdigest((42).to_bytes(8, "little"), 42)
                drawn = (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seeded) >> 11) / 2**53
                assert used[i] == int(report[s]["rate"]) + (drawn < report[s]["rate"] % 1)
    assert {x["source"] for x in got} <= set(share) and max(used.values()) <= 4
    tokens = Counter()
    for x in got:
        tokens[x["source"]] += x["n_tokens"]
    assert {s: report[s]["mixed_tokens"] for s in share} == {s: tokens[s] for s in share}
    assert sum(x["actual_share"] for x in report.values()) == pytest.approx(1)
    assert sorted(x["copy"] for x in got if x["doc_id"] == max(used, key=used.get)) == list(range(1, max(used.values()) + 1))


@needs_tokenizer
def test_mix_of_nothing(spark):
    for docs, targets in (([], [("a", 1.0, 1)]), ([(1, "x y", "a", None, None)], []), ([(1, None, "a", None, None)], [("a", 1.0, None)])):
        mixed, report = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
        assert mixed.collect() == [] and all(x["rate"] == 0 and x["actual_share"] is None for x in report.collect())


def test_asked_total_is_capped(spark):
    sizes = spark.createDataFrame([("a", 10, 1000), ("b", 1, 10)], "source string, n_documents long, n_tokens long")
    targets = spark.createDataFrame([("A", 0.5, 1), ("b ", 0.5, 3)], TARGETS)
    rates = {x["source"]: x["rate"] for x in source_rates(sizes, targets, 500).collect()}
    assert rates == {"a": 0.25, "b": 3.0}


def reference_statistics(text, common):
    text = text or ""
    w = [x for x in re.split("[ \t\r\n]+", text) if x]
    dense = [c for c in text if c not in " \t\r\n"]
    lines = [x for x in (y.strip(" \t\r\n") for y in text.split("\n")) if x]
    paragraphs = [x for x in (y.strip(" \t\r\n") for y in re.split("\n[ \t\r]*\n", text)) if x]
    out = {"n_words": len(w)}
    div = lambda a, b: a / b if b else None
    out["mean_word_length"] = div(len(dense), len(w))
    out["symbol_ratio"] = div(sum(unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd" for c in dense), len(dense))
    out["line_end_share"] = div(sum(x[-1] in ".!?" for x in lines), len(lines))
    out["common_word_share"] = div(sum("".join(c for c in x if c.isalpha()).lower() in common for x in w), len(w))
    out["duplicate_line_share"] = div(len(lines) - len(set(lines)), len(lines))
    out["duplicate_paragraph_share"] = div(len(paragraphs) - len(set(paragraphs)), len(paragraphs))
    covers = defaultdict(list)
    for n in (2, 3, 4):
        for i in range(len(w) - n + 1):
            covers[tuple(w[i : i + n])].append(set(range(i, i + n)))
    for n, name in quality.NGRAMS.items():
        best = max([sum(len(w[i]) for i in set().union(*c)) for g, c in covers.items() if len(c) > 1 and len(g) == n] or [0])
        out[name] = best / sum(map(len, w)) if len(w) > 1 else None
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_statistics_equal_a_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(quality, "SET_WORDS", limit)
    common = ["the", "of", "é", "die", None, "the"]
    r = random.Random(9)
    texts = [None, "", " \n\t\r\n ", "Hello.", "the of THE, d'é! ÉÉ", "😀 the 𝒳y ٣4 ½ _", "- a\n- b\n- a\n\n- a\n\n \t\n- a\n\n- b", "a\r\nb.\r\n\r\na", "x" * 100_000, "the the the the", "…"]
    texts += ["".join(r.choice(["the ", "of ", "Wörter ", "x1. ", "!\n", "\n\n", "é ", "- ", "\t", "\r\n", "Die, "]) for _ in range(r.randint(1, 120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = text_statistics(docs, spark.createDataFrame([(w,) for w in common], "word string")).withColumn("faults", faults()).collect()
    assert len(rows) == len(texts)
    for x in rows:
        expected = reference_statistics(texts[x["doc_id"]], set(common))
        assert {k: x[k] for k in expected} == expected, texts[x["doc_id"]]
        e = defaultdict(lambda: None, expected)
        bad = 5 if not e["n_words"] else (e["n_words"] < 30) + (not 3 <= e["mean_word_length"] <= 9) + (e["symbol_ratio"] > 0.1) + (e["line_end_share"] < 0.4) + (e["common_word_share"] < 0.2)
        assert x["faults"] == bad


def test_classes(spark):
    prose = "The rule of the field is the same for all of them, and the value is kept by the mapper. " * 1
    texts = [prose + " ".join(f"The part of it number {c} is set by the team, and the rest of it is {c}{c}." for c in "abcdefghij"), None, "- a: 1\n- b: 2\n- c: 3\n" * 5, "The same line of text.\n" * 20, "<x/> {{}} == ## " * 8 + "\n".join("@#$%" for _ in range(9))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = spark.createDataFrame([(w,) for w in "the of is for all and by it a".split()], "word string")
    got = {x["doc_id"]: x["c"] for x in text_statistics(docs, common).select("doc_id", text_class().alias("c")).collect()}
    assert got == {0: "prose", 1: "junk", 2: "list", 3: "boilerplate", 4: got[4]} and got[4] != "prose"
    assert text_statistics(docs.limit(0), common.limit(0)).collect() == []
