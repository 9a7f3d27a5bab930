"""Each operator against a brute-force version, with nulls, ties, copies and empty tables."""

import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stewardspark.llm import (
    common,
    decontamination,
    id_coder,
    line_dedup,
    mixing,
    near_dup,
    repeats,
    token_counts,
    token_files,
    tokens,
    top_k,
    toxicity,
    url_rules,
)
from stewardspark.llm.common import components, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, row string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, nulls, empty, very long and repeated rows."""
    rng = random.Random(11)
    base = [words(rng, rng.randint(1, 150)) for _ in range(40)]
    long = words(rng, 9000, 5000)
    texts = [*base, *[base[3]] * 30, None, None, "", " \n\t ", "Ünï <|endoftext|>  x\u00a0 y", long, long[:30000]]
    texts += [base[5] + f" tail{i}" for i in range(20)]
    rows = [
        (i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), i % 2, "r") for i, t in enumerate(texts)
    ]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "tokenizer"):
        library_ids.tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return library_ids.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 2048, 2049, 7000):
        for most in (0, 15, 255, 256, 50257, 2**32 - 1):
            ids = rng.integers(0, most, n, endpoint=True).astype(np.uint32)
            assert (id_coder.decode(id_coder.encode(ids)) == ids).all()
    repeated = np.tile(np.arange(50, dtype=np.uint32), 400)
    coded = id_coder.encode(repeated)
    assert len(coded) < len(repeated)
    damaged = bytearray(coded)
    damaged[len(coded) // 2] ^= 255
    with pytest.raises(ValueError):
        id_coder.decode(bytes(damaged))


def test_coder_learns_over_the_group_and_is_quick():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 1 << 20), 5000).astype(np.uint32)
    begin = time.process_time()
    coded = id_coder.encode(ids)
    assert (id_coder.decode(coded) == ids).all()
    assert time.process_time() - begin < 4e-6 * len(ids)
    shares = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * len(coded) / len(ids) < 1.1 * -(shares * np.log2(shares)).sum()


def test_coder_damaged_head_and_lost_end():
    coded = id_coder.encode(np.arange(9000, dtype=np.uint32) % 700)
    for at in (30, 200):
        damaged = bytearray(coded)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            id_coder.decode(bytes(damaged))
    with pytest.raises(ValueError):
        id_coder.decode(coded[:-2])


def test_crc32_joined():
    a, b = b"some bytes", bytes(range(200))
    assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("group_ids", [token_files.GROUP_IDS, 700])
def test_token_files(spark, docs, corpus, folder, group_ids):
    path = f"{folder}/ids-{group_ids}"
    token_files.write_token_files(docs, path, tokens.default_tokenizer(), 2, group_ids=group_ids)
    at, want = 0, []
    for row in sorted(corpus, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*library_ids(row[1]), 2], "<u4")
        want.append((row[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_file_index(spark, path).collect()]
    assert sorted(got) == want
    parts = token_files.read_token_files(spark, path, with_ids=True).orderBy("id", "ordinal", "part").collect()
    assert sum(len(p["ids"]) for p in parts) == at


def test_token_files_empty(empty):
    assert token_files.token_files(empty, tokens.default_tokenizer()).collect() == []


def test_token_counts(docs, corpus, empty):
    got = token_counts.token_counts(docs, tokens.default_tokenizer()).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(library_ids(r[1])), n > 512) for r in corpus]
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_counts.token_counts(empty, tokens.default_tokenizer()).collect() == []


def test_encoder_equals_library_on_odd_texts():
    rng = random.Random(1)
    letters = [*"abZ1.,' \n\t\r é中!<|>ß", "\u01c5", "\u0301", "ª", "\x85", "\x1c", "\xa0", "<|endoftext|>", "'s", " foo"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    encode = tokens.Encoder(tokens.default_tokenizer())
    assert [x.tolist() for x in encode.ids(texts)] == [library_ids(t) for t in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_encoder_takes_arrow_columns(monkeypatch, kind):
    """Whole columns, and slices of them, over many groups and with nothing remembered after the first words."""
    monkeypatch.setattr(tokens, "BATCH_BYTES", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 2000)
    rng = random.Random(3)
    parts = [" a", " été", " ×x", " a÷", " Ýÿ", " naïve", "b ", " ", "\n", " 中x", " x中", " ǅa", ".", " z1", "<|endoftext|>", " µ"]
    texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(600)]
    want = [library_ids(t) for t in texts]
    column = pa.array(texts, kind)
    for first, n in ((0, 600), (7, 300), (599, 1), (600, 0)):
        encode, lengths = (tokens.Encoder(tokens.default_tokenizer(), x) for x in (False, True))
        assert [x.tolist() for x in encode.ids(column.slice(first, n))] == want[first : first + n]
        assert lengths.counts(column.slice(first, n)) == [len(x) for x in want[first : first + n]]


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a simple text", "  spaces  and\nlines ", "", "Ünïcode 中"]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r["n_tokens"] for r in token_counts.token_counts(rows, path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    rules = {
        (host, path): rng.choice(["allow", "block"])
        for host in ("net", "example.net", "a.example.net", "com", "b.com", "c.b.com", "org")
        for path in ("/", "/a", "/a/", "/a/b", "", "/ab")
        if rng.random() < 0.6
    }
    hosts = ["net", "xnet", "example.net", "z.a.example.net", "q.com", "b.com", "x.c.b.com", "org", "de", ""]
    urls = [
        f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/a/', '/a/b/c', '/abc', '?x=/a', '#/a'])}"
        for _ in range(300)
    ]
    urls += [None, "", "no scheme", "://B.COM/a", "x://y://b.com/a", "http://b.com/a?u=http://net/"] + [urls[0]] * 500
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")

    def judged(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [
            (len(h + p), len(h), h + p, v) for (h, p), v in rules.items()
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    got = {r[0]: tuple(r)[1:] for r in url_rules.judge_urls(pages, table).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(pages.filter("false"), table).collect() == []
    assert {r["verdict"] for r in url_rules.judge_urls(pages, table.filter("false")).collect()} == {"allow"}


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.fixture(scope="module")
def line_pairs():
    rng = random.Random(3)
    out = []
    for _ in range(1200):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(9, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        out.append((a, "".join(b)))
    return out


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_and_segments(spark, line_pairs, edits):
    rows = [(a, b) for a, b in line_pairs if abs(len(a) - len(b)) <= edits and len(b) > 2 * edits + 1]
    x, y = F.col("x"), F.col("y")
    def keys(line):
        return line_dedup.segment_keys(line, F.char_length(line), edits)

    def meet(line, other):
        own = F.filter(keys(line), lambda k: k["own"])["key"]
        return F.arrays_overlap(own, F.filter(keys(other)["key"], lambda k: k.isNotNull()))

    met = meet(x, y) | meet(y, x)
    got = spark.createDataFrame(rows, "x string, y string").withColumns(
        {"d": line_dedup.banded_distance("x", "y", edits), "met": met}
    )
    for row in got.collect():
        true = plain_distance(row.x, row.y)
        assert row.d == min(true, edits + 1)
        assert row.met or true > edits


def test_line_dedup(spark):
    line = "this is one line of a certain length"
    texts = [
        f"{line}\nshort\n\n  {line}  ", f"short\n{line}!\nanother line that stands alone here", line[:-1] + "HX",
        None, "", "another line that stands alone, far off", f"{line}!!!!",
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, kind string"))
    out = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"], r["kept"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert out[0] == (4, 1, [3], f"{line}\nshort\n")
    assert out[1] == (3, 2, [0, 1], "another line that stands alone here")
    assert out[2][1] == 1 and out[3] == (1, 0, [], "") and out[4] == (1, 0, [], "")
    assert out[5][1] == 0 and out[6][1] == 0
    assert line_dedup.dedup_lines(got.select("doc_id", F.lit("a").alias("text")).filter("false")).collect() == []


def within(a, b, most):
    """plain_distance(a, b) <= most, given up at the first row beyond."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        if min(now) > most:
            return False
        last = now
    return last[-1] <= most


def edited(rng, line, edits):
    out = list(line)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "é", "x"])
    return "".join(out)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    lines = []
    for n in (2, 4, 6, 7, 9, 14, 23, 30, 46, 50, 63, 70, 95, 130, 170, 250, 330, 345, 400, 700):
        for _ in range(2):
            line = "".join(rng.choice("abcdefgh ijklmnop") for _ in range(n)).strip() or "a"
            most = max(2, n // 16)
            lines += [line, *[edited(rng, line, rng.choice([1, most - 1, most, most + 1, most + 2])) for _ in range(4)]]
            at = rng.randrange(n)
            lines.append(line[:at] + "z" * most + line[at:])
            lines.append(line[: max(0, at - most)] + line[at:] + "y")
    lines = [x.strip(" ") for x in lines]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    flat = [x for t in texts for x in t.split("\n")]
    alike = {}

    def near(a, b):
        if a == b or not a or not b:
            return a == b and a != ""
        most = max(2, max(len(a), len(b)) // 16)
        if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > most:
            return False
        pair = (min(a, b), max(a, b))
        if pair not in alike:
            alike[pair] = within(a, b, most)
        return alike[pair]

    label = groups_of(flat, lambda a, b: a == b or near(a, b))
    want, at = {}, 0
    for i, t in enumerate(texts):
        n = len(t.split("\n"))
        want[i] = [j for j in range(n) if flat[at + j] and label[at + j] != at + j]
        at += n
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(map(len, want.values())) > 100
    assert got == want


def plain_simhash(text, k):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    parts = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1))] if parts else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups_of(values, near):
    """The smallest index reachable from each."""
    label = list(range(len(values)))
    while True:
        new = [min(label[j] for j in range(len(values)) if near(values[i], values[j])) for i in range(len(values))]
        if new == label:
            return label
        label = new


def test_near_duplicates(docs, corpus, empty):
    prints = [plain_simhash(r[1], 3) for r in corpus]
    ids = [r[0] for r in corpus]
    label = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = near_dup.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, label, strict=True))
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({ids[g] for g in label})
    assert near_dup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("hot", [2000, 2])
def test_links_join_all_near_values(spark, hot):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(rng.randint(0, 12)):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = sorted(int(np.uint64(v).astype(np.int64)) for v in values)
    found = near_dup.links(spark.createDataFrame([(v,) for v in signed], "value long"), 3, hot)
    got = {r["node"]: r["component"] for r in components(found).collect()}
    label = groups_of(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert all(got.get(v, v) == signed[g] for v, g in zip(signed, label, strict=True))


def test_lines_meet_in_rounds_by_length(spark, monkeypatch):
    """Each class a round of its own finds the same links, and keys of other rounds are gone by then."""
    rng = random.Random(9)
    lines = [words(rng, rng.randint(2, 60)) for _ in range(40)]
    for line in lines[:]:
        cut = rng.randrange(len(line))
        lines += [line[:cut] + line[cut + 1 :], line[:cut] + "xy" + line[cut:]]
    lines = sorted(set(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "kind long, line string")
    plain, sizes = common.stored, []

    def kept(df, purpose):
        out = plain(df, purpose)
        if purpose == "line-pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", kept)
    once = {tuple(r) for r in line_dedup.similar_lines(df, 2, 6, 16).collect()}
    assert len(sizes) == 1
    parts = [tuple(r) for r in line_dedup.similar_lines(df, 2, 6, 16, at_once=1, rounds=8).collect()]
    assert len(sizes) > 5 and max(sizes[1:]) < sizes[0]
    assert set(parts) == once and len(parts) == len(once) >= 40
    for a, b in [(a, b) for a in range(0, len(lines), 7) for b in range(a)]:
        most = max(2, max(len(lines[a]), len(lines[b])) // 16)
        near = abs(len(lines[a]) - len(lines[b])) <= most and plain_distance(lines[a], lines[b]) <= most
        assert near == ((a, b) in once or (b, a) in once)


def test_near_duplicates_broadcast_nothing_sized_by_its_values(spark, monkeypatch):
    """Spark sizes the 66 keys of a value, and the minima of a round, by the files read: none may be broadcast."""
    plans, plain = [], common.stored

    def kept(df, purpose):
        plans.append((purpose, df._jdf.queryExecution().sparkPlan().toString()))
        return plain(df, purpose)

    monkeypatch.setattr(near_dup, "stored", kept)
    monkeypatch.setattr(common, "stored", kept)
    values = near_dup.stored(spark.range(250).select(F.xxhash64("id").alias("value")), "values")
    near_dup.links(values, 3)
    components(near_dup.stored(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "pairs"))
    joined = [plan for purpose, plan in plans if purpose == "buckets" or "Join" in plan]
    assert len(joined) >= 2
    assert all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in joined)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [words(rng, n) for n in (60, 30, 12, 3, 30)] + [None, "..."]
    near = items[0].split()
    near[10] = "changed"
    texts = [
        words(rng, 50) + " " + items[0].upper() + ", " + words(rng, 20), " ".join(near) + " " + words(rng, 30),
        words(rng, 100), f"{words(rng, 5)} {items[3]} {words(rng, 40)}", items[1] + " " + items[2], None, "",
        " ".join(items[4].split()[:20]), items[1] + " " + items[2],
    ]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item long")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, bench).collect()}
    assert found == {(0, 0), (1, 0), (3, 3), (4, 1), (4, 2), (8, 1), (8, 2)}
    clean = decontamination.decontaminated(docs, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 5, 6, 7]
    assert clean.columns == docs.columns
    assert decontamination.decontaminated(docs, bench.filter("false")).count() == len(texts)
    assert decontamination.contamination(docs.filter("false"), bench).collect() == []


def plain_leaks(texts, items):
    """{(text number, item number): best similarity} over all windows as long as the item."""
    out = {}
    for j, item in enumerate(items):
        item = item.lower().split()
        k = min(5, len(item))
        theirs = Counter(tuple(item[i : i + k]) for i in range(len(item) - k + 1))
        for t, text in enumerate(texts):
            text = text.lower().split()
            if len(text) < k:
                continue
            if not theirs.keys() & {tuple(text[i : i + k]) for i in range(len(text) - k + 1)}:
                continue
            for first in range(max(1, len(text) - len(item) + 1)):
                window = text[first : first + len(item)]
                mine = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
                inner = (mine & theirs).total()
                alike = inner / (mine.total() + theirs.total() - inner)
                if alike >= 0.8:
                    out[t, j] = max(alike, out.get((t, j), 0))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    items, texts = [], []
    for i in range(360):
        n = (13, 49, 49, 94)[i % 4]
        item = words(rng, n, 5000).split()
        items.append(" ".join(item))
        near = list(item)
        # One changed word takes 5 shingles inside, one at the end; 0.8 is at n / 9 of them.
        if n == 13:
            near[-1] = "changed"
        else:
            for at in range(20, 20 + (2 if n == 94 else 1) * 20, 20):
                near[at] = "changed"
        if i % 10 == 9:
            near[0] = "other"
        texts.append(f"{words(rng, rng.randint(0, 20), 5000)} {' '.join(near)} {words(rng, rng.randint(0, 20), 5000)}")
    want = plain_leaks(texts, items)
    assert sum(0.8 <= s <= 0.85 for s in want.values()) > 250
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contamination(docs, bench).collect()}
    assert got == pytest.approx(want)
    clean = {r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {t for t, _ in want}


def test_sainte_lague_equals_quotients(spark):
    rng = random.Random(8)
    for claims, seats in (([340, 280, 160, 60], 15), ([5, 5, 5], 7), ([1000] + [1] * 30, 20), ([rng.randint(1, 99) for _ in range(40)], 33)):
        quotients = sorted((-c / (2 * k + 1), i, k) for i, c in enumerate(claims) for k in range(seats))[:seats]
        won = Counter(i for _, i, _ in quotients)
        rows = [(0, i, float(c), seats) for i, c in enumerate(claims)]
        groups = spark.createDataFrame(rows, "unit long, no long, claim double, seats long")
        for unit in (None, "unit"):
            got = {r["no"]: r["quota"] for r in mixing.sainte_lague(groups, "no", unit).collect()}
            assert got == {i: won[i] for i in range(len(claims))}


def test_mixing(docs, corpus, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus)
    size = {}
    for r in corpus:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    total, free, target = sum(size.values()), dict(zip(order, [1, 2, 3] * 9, strict=False)), {}
    while True:
        left = total - sum(target.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            del free[s]
    left = total - sum(target.values())
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    by_id = {r[0]: r[3] for r in corpus}
    taken = Counter()
    for r in got:
        source = by_id[r["doc_id"]]
        taken[source] += r["taken"]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in size)
    again = mixing.mix(docs.repartition(5)).collect()
    pick = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert pick(again) == pick(got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(empty).collect() == []


def test_segments_are_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(0, 14)).astype(float)

        def parts(lo, hi):
            best = max(((scores[a:b].sum(), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, a, b = best
            return [*parts(lo, a), (a, b, best[0]), *parts(b, hi)]

        got = toxicity.segments(scores)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in parts(0, len(scores))))
        assert all(scores[a:b].sum() == pytest.approx(s) and s > 0 for a, b, s in got)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        text = words(rng, rng.randint(20, 200)).split()
        if bad:
            at = rng.randrange(len(text))
            text[at:at] = rng.choices(["nasty", "foul", "vile"], k=4)
        rows.append((i, " ".join(text), 1))
        marks.append((i, int(bad), "x"))
    rows += [(900, None, 1), (901, "", 1), (902, "nasty foul vile " * 4000, 1), (None, "w1 w2", 1), (5, rows[5][1], 1)]
    marks += [(3, None, "x"), (4, 7, "x"), (None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(903)}
    assert all(r["held_out"] == held[r["doc_id"]] for r in got if r["doc_id"] is not None)
    truth = dict((i, m) for i, m, _ in marks[:900])
    tested = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[902]["predicted"] == 1 and by_id[900]["predicted"] == by_id[901]["predicted"] == 0
    hidden = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1).otherwise(F.col("toxic")))
    assert sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.toxicity(docs, hidden).collect()) == sorted(
        (r["doc_id"] or -1, r["score"]) for r in got
    )
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(docs.filter("false"), labels).collect() == []
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.filter("false")).collect()} == {0}


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(9)
    shared = [words(rng, 40, 4000) for _ in range(6)]
    texts = [
        " ".join(rng.choice(shared) if rng.random() < 0.4 else words(rng, rng.randint(1, 60), 4000) for _ in range(rng.randint(1, 8)))
        for _ in range(60)
    ]
    texts += [None, "", "ab" * 700, "a" * 1000, texts[4], texts[4], "é" * 300, "x" + texts[7], texts[9][:-1]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 long")
    for length, gram in ((100, 40), (64, 32), (401, 100)):
        got = {r[0]: tuple(r)[1:5] for r in repeats.remove_repeats(docs, length, gram).collect()}
        assert got == dict(enumerate(plain_repeats(texts, length)))
    assert repeats.remove_repeats(docs.filter("false")).collect() == []


def test_difference_cover():
    pairs = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert pairs == set(range(repeats.PERIOD))


def test_sorting_buckets_takes_little_memory():
    """The peak follows the block, not the buckets that a task is given."""
    rnd = np.random.default_rng(20)
    rows = []
    for i in range(800):
        body = rnd.integers(97, 123, 550, np.uint8).tobytes()
        rows += [(i, 1, i, 0, body), (i, 2, i, 0, b"x" + body[:-1])]
    types = [pa.int64()] * 4 + [pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["bucket", "k1", "k2", "first", "data"])
    tracemalloc.start()
    try:
        found = [row for out in repeats._sort_buckets(400)([batch]) for row in zip(*out.to_pydict().values(), strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(found) == sorted([(1, i, 0, 549) for i in range(800)] + [(2, i, 1, 550) for i in range(800)])
    assert peak < 60 << 20, peak


def test_cutting_slices_takes_little_memory():
    """Texts and slices become Python objects a few at a time, whatever the Arrow batch holds."""
    body = np.random.default_rng(21).integers(97, 123, 4000, np.uint8).tobytes()
    wanted = [{"bucket": b, "first": 50 * b, "starts": 151} for b in range(70)]
    part = pa.list_(pa.struct([("bucket", pa.int64()), ("first", pa.int64()), ("starts", pa.int32())]))
    columns = [pa.array([body] * 2000, pa.binary()), pa.array(range(2000)), pa.array(range(2000)), pa.array([wanted] * 2000, part)]
    batch = pa.RecordBatch.from_arrays(columns, names=["data", "k1", "k2", "wanted"])
    n = 0
    tracemalloc.start()
    try:
        for out in repeats._cut_slices(400)([batch]):
            n += out.num_rows
            assert all(len(x) == 550 for x in out.column(4).to_pylist()[:3])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000 * 70
    assert peak < 40 << 20, peak


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.3, (700, 8))
    vectors[100:300] = vectors[7]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(700, None, 0), (701, [], 0), (702, [float("nan")] * 8, 0), (703, [None] * 8, 0), (None, rows[0][1], 0), (705, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, top_k.top_k(table, table.filter("vec_id % 100 = 0"), 10, query_block=3).collect()))
    whole = np.floor(1024 * vectors).astype(np.int64)
    want = []
    for q in range(0, 700, 100):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    few = table.filter("vec_id < 4")
    assert top_k.top_k(few, few.filter("vec_id = 0"), 10).count() == 3
    assert top_k.top_k(table.filter("false"), table.filter("false")).collect() == []


@pytest.mark.parametrize("own, others", [(0, range(1, 30)), (5, range(30)), (40, range(30))])
def test_top_k_with_a_query_row_repeated(spark, own, others):
    vector = [0.5, 0.25, -0.125]
    ids = [own] * 25 + [i for i in others if i != own] + [3] * 4
    table = spark.createDataFrame([(i, vector) for i in ids], "vec_id long, embedding array<double>").coalesce(1)
    got = top_k.top_k(table, table.filter(F.col("vec_id") == own), 10)
    want = sorted(i for i in ids if i != own)[:10]
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == want


@pytest.mark.parametrize("pages_at_once", [1, 16])
def test_top_k_of_rows_that_share_ids(spark, monkeypatch, pages_at_once):
    monkeypatch.setattr(top_k, "PAGES_AT_ONCE", pages_at_once)
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 12, 90), rng.integers(-2, 3, (90, 2)))]
    rows += [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(0, [2.0, 2.0])] * 25 + [(7, [2.0, 2.0])] * 9
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = top_k.top_k(table, F.col("vec_id") % 10 == 0, 6, query_block=16).collect()
    want = []
    for i, (query, q) in enumerate(rows):
        if query % 10 == 0:
            scores = [(-int(1024 * 1024 * np.dot(q, v)), key) for j, (key, v) in enumerate(rows) if j != i]
            want += [(query, n, key, -s) for n, (s, key) in enumerate(sorted(scores)[:6], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_least_ids_keep_all_that_a_query_can_get():
    rng = np.random.default_rng(6)
    for _ in range(300):
        ids = np.sort(rng.integers(0, rng.integers(1, 12), 30))
        whole = rng.integers(0, 2, (30, 1))
        kept, _, vectors = top_k._least_ids(ids, ids, whole, 4)
        for query in range(-1, 12):
            for v in (0, 1):
                want = sorted(ids[(whole[:, 0] == v) & (ids != query)])[:4]
                assert sorted(kept[(vectors[:, 0] == v) & (kept != query)])[:4] == want


def test_ranked(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    assert all(r["v"] == r["rank"] for r in ranked(rows, F.col("v")).collect())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]}
