"""Personal data: labelers vote on spans, their reliability is estimated, a classifier decides.

Fixed patterns give the base spans, which always stay. Looser patterns propose further
spans: spelled-out addresses, numbers without a prefix or with a wrong check digit,
addresses of the longer form, names. On every span, base ones too, labelers vote for
or against or abstain: patterns, check digits and ranges, gazetteers, words before and
characters around. Expectation-maximisation over the counts of the vote patterns of
the whole corpus estimates how reliable each labeler is for each kind, without any
label. The spans so weighed train a classifier over the span's shape, neighbours and
votes, which decides what is added.
"""

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardspark.llm.common import stored

#: In the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone", "name")
EMAIL, IP, CARD, PHONE, NAME = range(5)
LABELERS = ("pattern", "form", "gazetteer", "context", "edges")
PATTERNS = 3 ** len(LABELERS)
#: Features are hashed, so that the model's size does not grow with the corpus.
BUCKETS = 1 << 12
#: An added span has at least this probability.
SURE = 0.9
#: Characters looked at on either side of a span.
AROUND = 32

# The base patterns' character sets.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
    r"(?: ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]{2,63}){1,4}"
    r"| at [A-Za-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]{2,63}){1,4})"
)
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_NAME = re.compile(r"(?<![^\W_])[A-Z][a-z]{2,15}(?: [A-Z][a-z]{1,20}){0,2}(?![^\W_])")

# Gazetteers: plain lists of our own, no fixed values of any other program.
GIVEN_NAMES = frozenset(
    "Alice Andrew Anna Anthony Barbara Brian Carlos Carol Charles Christine Daniel David Deborah "
    "Donald Dorothy Edward Elena Elizabeth Emily Emma George Hannah Hans Helen Isabel Jack James "
    "Jane Javier Jean Jennifer Jessica John Jonathan Joseph Juan Julia Karen Katharina Kenneth "
    "Kevin Laura Linda Lisa Lucas Margaret Maria Marie Matthew Michael Michelle Mohammed Nancy "
    "Nicolas Olivia Patricia Paul Pedro Peter Pierre Richard Robert Ruth Sandra Sarah Sofia "
    "Stefan Steven Susan Thomas Ursula William Wolfgang".split()
)
MAIL_ENDINGS = frozenset("com org net edu gov io info de fr es it uk nl eu ch at be pl se".split())
CUES = {
    EMAIL: "mail email e-mail write contact reach courriel correo",
    IP: "ip address host server adresse from client",
    CARD: "card visa mastercard amex credit debit payment carte tarjeta karte",
    PHONE: "phone tel telephone call mobile cell fax whatsapp telefon teléfono téléphone",
    NAME: "mr mrs ms dr name called dear herr frau monsieur madame señor señora signed regards",
}
AGAINST = frozenset("version v release isbn issn section fig figure page build eur usd no id sha".split())
_CUES = {kind: frozenset(words.split()) for kind, words in CUES.items()}
_WORD = re.compile(r"[^\W\d_][\w-]*")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the leftmost matches are, from each @ outwards, so that no run is read twice."""
    begin, at = 0, text.find("@")
    while at >= 0:
        left = begin + len(text[begin:at].rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if left < at else None
        if match:
            yield left, match.end()
        begin = match.end() if match else at + 1
        at = text.find("@", begin)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start, then kind."""
    out = [(a, EMAIL, b) for a, b in _emails(text)]
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") for p in match.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((match.start(), IP, match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group()) if match.end() - match.start() <= 38 else ""
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((match.start(), CARD, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_digits(match.group())) <= 15:
                out.append((match.start(), PHONE, match.end()))
    return sorted(out)


def _proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of what the looser patterns and the gazetteer of names find."""
    if "at" in text:
        yield from ((m.start(), EMAIL, m.end()) for m in _SPELLED.finditer(text))
    if ":" in text:
        yield from ((m.start(), IP, m.end()) for m in _LONG_IP.finditer(text))
    for match in _CARD.finditer(text):
        if 12 <= match.end() - match.start() <= 38 and 12 <= len(_digits(match.group())) <= 19:
            yield match.start(), CARD, match.end()
    for match in _LOCAL_PHONE.finditer(text):
        if 9 <= len(_digits(match.group())) <= 15:
            yield match.start(), PHONE, match.end()
    for match in _NAME.finditer(text):
        if not GIVEN_NAMES.isdisjoint(match.group().split(" ")):
            yield match.start(), NAME, match.end()


def _votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, list[str]]:
    """The votes on a span as one number, and its features."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    digits = _digits(span)
    if kind == EMAIL:
        ending = re.split(r"[^A-Za-z0-9]+", span)[-1].lower()
        form = 1 if ending.isalpha() and 2 <= len(ending) <= 12 else -1
        listed = 1 if ending in MAIL_ENDINGS else 0
    elif kind == IP:
        parts = re.split(r"[.:]", span)
        form = 1 if len(parts) == 8 or all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in parts) else -1
        listed = -1 if span.startswith(("0.", "255.")) or len(digits) == 4 else 0
    elif kind == CARD:
        form = 1 if passes_luhn(digits) else -1
        listed = 1 if digits[0] in "3456" and len(digits) >= 13 else -1
    elif kind == PHONE:
        form = 1 if 9 <= len(digits) <= 13 and len(set(digits)) > 2 else -1
        listed = 1 if span[0] == "+" and span[1] != "0" else 0
    else:
        form = 1 if " " in span else -1
        listed = 1 if span.split(" ")[0] in GIVEN_NAMES else 0
    words = [w.lower() for w in _WORD.findall(before)][-3:]
    telling = [w in _CUES[kind] for w in words if w in _CUES[kind] or w in AGAINST]
    context = 0 if not telling else 1 if telling[-1] else -1
    beside = before[-1:] + after[:1]
    edges = -1 if any(c.isalnum() or c in "_/=#" for c in beside) else 1 if beside.isspace() else 0
    votes = (1 if base else 0, form, listed, context, edges)
    number = 0
    for vote in votes:
        number = 3 * number + vote + 1
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\dA-Z_]+", "a", re.sub(r"[0-9]+", "9", span)))
    features = [f"s{shape[:24]}", f"n{min(len(span) // 4, 12)}", f"w{words[-1] if words else ''}",
                f"l{before[-1:]}", f"r{after[:1]}", *[f"v{i}{v}" for i, v in enumerate(votes)]]
    return number, features


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _covered(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that ``spans`` (start, end) cover, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _is_free(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    before = bisect_left(covered, (end,))
    return before == 0 or covered[before - 1][1] <= start


def candidates(text: str | None) -> list[tuple]:
    """(start, kind, end, base, votes, buckets) of base spans and of what is proposed beside them."""
    text = text or ""
    base = base_spans(text)
    known = set(base)
    taken = _covered((a, b) for a, _, b in base)
    proposed = (s for s in set(_proposed(text)) - known if _is_free(taken, s[0], s[2]))
    out = []
    for span in base + sorted(proposed):
        start, kind, end = span
        number, features = _votes(text, kind, start, end, span in known)
        out.append((start, kind, end, span in known, number, sorted({bucket(f) for f in features})))
    return out


_SPAN = "struct<start:int,kind:int,end:int,base:boolean,votes:int,features:array<int>>"
_SPAN_ARROW = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
         ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]
    )
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPAN_ARROW.value_type]
    for batch in batches:
        found = []
        for text in batch.column(1):
            found.append([dict(zip(names, s, strict=True)) for s in candidates(text.as_py())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, _SPAN_ARROW)], names=["id", "found"]
        )


def reliabilities(counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over the counts of the vote patterns of one kind.

    Returns the probability of personal data for each pattern, how often each labeler
    that votes votes for where it is none and where it is, and its share. Base spans,
    for which the first labeler votes, are personal data throughout. That a labeler
    abstains says nothing. It starts from the votes' majority and is held by a
    prior in which labelers rather vote right than wrong; without rows the prior is
    what results.
    """
    votes = np.array([[p // 3**i % 3 - 1 for i in reversed(range(len(LABELERS)))] for p in range(PATTERNS)])
    for_, against = (votes > 0).astype(float), (votes < 0).astype(float)
    prior = np.array([[2.0, 4.0], [4.0, 2.0]])  # votes for and against, for each truth
    base = votes[:, 0] > 0
    is_data = np.where(base, 1.0, 1 / (1 + np.exp(-1.5 * votes.sum(1))))
    for _ in range(rounds):
        soft = np.stack([counts * (1 - is_data), counts * is_data])
        share = (soft[1].sum() + 1) / (soft.sum() + 2)
        says = (soft @ for_ + prior[:, :1]) / (soft @ (for_ + against) + prior.sum(1, keepdims=True))
        logs = np.log(says) @ for_.T + np.log(1 - says) @ against.T
        odds = np.log(share / (1 - share)) + logs[1] - logs[0]
        now = np.where(base, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        if np.abs(now - is_data).max() < 1e-9:
            break
        is_data = now
    return is_data, says, float(share)


def _weights(spans: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The classifier: log-odds of each feature of each kind, and of each kind.

    Every span of the corpus counts, with the probability that the labelers' votes give
    it. At most a number for each vote pattern, then two for each feature, reach the
    driver.
    """
    counts = np.zeros((len(KINDS), PATTERNS))
    for kind, votes, n in spans.groupBy("kind", "votes").count().collect():
        counts[kind, votes] = n
    soft = [reliabilities(own)[0] for own in counts]
    rows = [(k, p, float(soft[k][p])) for k in range(len(KINDS)) for p in np.flatnonzero(counts[k]).tolist()]
    judged = spans.sparkSession.createDataFrame(rows, "kind int, votes int, p double")
    each = spans.join(judged, ["kind", "votes"]).select("kind", "p", F.explode("features").alias("feature"))
    sums = each.groupBy("kind", "feature").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    is_data, is_none = np.zeros((2, len(KINDS), BUCKETS))
    for kind, feature, p, n in sums.collect():
        is_data[kind, feature], is_none[kind, feature] = p, n - p
    of_kind = np.stack([counts.sum(1), (counts * np.array(soft)).sum(1)])
    total_data, total_none = of_kind[1] + 1.0, of_kind[0] - of_kind[1] + 1.0
    weights = np.log((is_data + 0.5) / (total_data[:, None] + 1)) - np.log(
        (is_none + 0.5) / (total_none[:, None] + 1)
    )
    seen = is_data + is_none > 0
    return np.where(seen, weights, 0.0), np.log(total_data / total_none)


def _decided(listed: list[dict], weights: np.ndarray, prior: np.ndarray, sure: float) -> list[dict]:
    """Base spans, and of the others those the classifier is sure of that overlap no other."""
    kept = [(s["start"], s["kind"], s["end"], True, 1.0) for s in listed if s["base"]]
    added = []
    for s in listed:
        if not s["base"]:
            odds = prior[s["kind"]] + weights[s["kind"], s["features"]].sum()
            added.append((-float(1 / (1 + np.exp(-np.clip(odds, -30, 30)))), s["start"], s["kind"], s["end"]))
    taken = _covered((a, b) for a, _, b, _, _ in kept)
    for p, start, kind, end in sorted(added):
        if -p >= sure and _is_free(taken, start, end):
            kept.append((start, kind, end, False, -p))
            insort(taken, (start, end))
    return [
        {"kind": KINDS[k], "start": a, "end": b, "base": base, "score": p}
        for a, k, b, base, p in sorted(kept)
    ]


_RESULT = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_RESULT_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
         ("score", pa.float64())]
    )
)


def personal_data(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sure: float = SURE
) -> DataFrame:
    """(id, spans) of each row: the personal data in its text, by start, then kind.

    A span has its kind (email, ip, card, phone, name), first code point, end
    (exclusive), whether it is a base span, and a probability, 1 for base spans. Added
    spans overlap no other span: of two, the likelier stays, then the earlier.

    Null and empty texts have no spans. Each row stands for itself, also if it or its id
    is repeated or null. An empty table gives an empty result, further columns are not
    read. A corpus without any candidate has no model to speak of and adds nothing.

    Each whole text is scanned once, in a task; only spans, votes and hashed features
    are stored. Votes and features of all spans of the corpus are counted.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    found = _found(docs, id_column, text_column)
    weights = _model(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_decided(listed, *weights.value, sure) for listed in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _RESULT_ARROW)], names=["id", "spans"]
            )

    return found.mapInArrow(decide, f"id {kind}, spans {_RESULT}").withColumnRenamed("id", id_column)


def _found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    return stored(rows.mapInArrow(_scan, f"id {kind}, found array<{_SPAN}>"), "spans")


def _model(found: DataFrame):
    each = found.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    return found.sparkSession.sparkContext.broadcast(_weights(each))


def redacted(text: str | None, spans: Sequence[dict]) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first."""
    if text is None:
        return None
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out += [text[done : span["start"]], f"<{span['kind']}>"]
        done = max(done, span["end"])
    return "".join([*out, text[done:]])


def without_personal_data(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sure: float = SURE
) -> DataFrame:
    """``docs``, all columns and rows, with the spans of ``personal_data`` replaced by their kind.

    Of overlapping base spans all that they cover is replaced by the first one's kind.
    A null text stays null. Texts are scanned once for the model and once to redact.
    """
    weights = _model(_found(docs, id_column, text_column))
    at = docs.columns.index(text_column)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SPAN_ARROW.value_type]
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                listed = [dict(zip(names, s, strict=True)) for s in candidates(text)]
                texts.append(redacted(text, _decided(listed, *weights.value, sure)))
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(redact, docs.schema)
