"""Dictionary phrases and unmarked secrets against brute force and planted rows."""

import math
import random
import re
from collections import Counter

from stewardspark.operators import text_scan

WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


def brute_hits(texts, phrases):
    listed = {(kind, tuple(WORD.findall(p.lower()))) for kind, p in phrases if p}
    found = Counter()
    for doc, text in texts:
        words = WORD.findall((text or "").lower())
        for kind, phrase in listed:
            if phrase:
                n = len(phrase)
                found[doc, kind] += sum(tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))
    return {(*key, n) for key, n in found.items() if n}


def test_phrases_equal_brute_force(spark):
    rnd = random.Random(7)
    words = ["Anna", "anna", "Kent", "o'neil", "Main", "Street", "é", "12", "x-ray", "the"]
    texts = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(200)]
    texts += [(300, None), (301, ""), (302, "...")]
    phrases = [("name", "Anna Kent"), ("name", "ANNA  kent"), ("name", "o'neil"), ("place", "12 Main Street"),
               ("place", "the"), ("name", "the the the the"), ("none", "?!"), ("none", None)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    listed = spark.createDataFrame(phrases, "kind string, phrase string")
    got = text_scan.dictionary_scan(df, listed)
    assert {tuple(r) for r in got.collect()} == brute_hits(texts, phrases)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert text_scan.dictionary_scan(df, listed.limit(0)).count() == 0
    assert text_scan.dictionary_scan(df.limit(0), listed).count() == 0


def test_names_and_places_are_found_by_a_list(spark):
    """Precision and recall on planted rows: every name of the list, no other capitalised words."""
    rnd = random.Random(8)
    names = [f"{a} {b}" for a in ("Maria", "Hans", "Li") for b in ("Soto", "Berg", "Wei")]
    texts, planted = [], set()
    for i in range(300):
        name = rnd.choice(names) if i % 3 == 0 else rnd.choice(["Maria Berger", "Sotomaria", "Old Wei"])
        texts.append((i, f"Report {i}: approved by {name.upper() if i % 2 else name}, see notes."))
        if i % 3 == 0:
            planted.add(i)
    listed = spark.createDataFrame([("name", n) for n in names], "kind string, phrase string")
    df = spark.createDataFrame(texts, "doc_id int, text string")
    assert {r.doc_id for r in text_scan.dictionary_scan(df, listed).collect()} == planted


def test_secrets_without_a_mark(spark):
    rnd = random.Random(9)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts, planted = [], {}
    for i in range(400):
        kind = i % 4
        if kind == 0:
            token = "".join(rnd.choices(alphabet, k=rnd.randint(24, 60))) + "a1"
            texts.append((i, rnd.choice(["use {} now", "key:{}", '"{}"', "{}"]).format(token)))
            planted[i] = token
        elif kind == 1:
            texts.append((i, f"antidisestablishmentarianism {'9' * 30} " + "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1"))
        elif kind == 2:
            texts.append((i, f"short {''.join(rnd.choices(alphabet, k=15))} and 1234567890123456789012"))
        else:
            texts.append((i, rnd.choice([None, "", "plain words and more of them"])))
    found = text_scan.unmarked_secrets(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    assert {r.doc_id: r.token for r in found} == planted
    for r in found:
        p = [n / len(r.token) for n in Counter(r.token).values()]
        assert abs(r.bits + sum(x * math.log2(x) for x in p)) < 1e-9
