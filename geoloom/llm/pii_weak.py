"""Personal data by weak supervision: labelers vote on candidate spans, and no span is labelled by hand.

Candidates come from several sources: patterns (the base kinds, account numbers, long numbers, and the parts of
runs of digits that no base kind takes as a whole), a gazetteer of given names, and titles and cue words before
capitalised words. Pattern, gazetteer and context labelers each vote for, against or not at all. What they vote is counted over the whole
corpus by pattern of votes (a table bounded by the number of patterns); expectation-maximisation estimates from
it how reliable each labeler is and how likely each pattern is personal data, and a logistic regression on
votes, kind and shape is trained on those likelihoods. It decides which candidates are added to the base spans.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common

#: In the order of spans that begin together; the first four are the base kinds, which always stay.
KINDS = ("email", "ip", "card", "phone", "number", "iban", "name")
BASE = 4
LABELERS = ("checksum", "gazetteer", "cue", "counter_cue", "edges", "shape", "company")
ROUNDS, SMOOTHING, PRIOR, RIDGE = 60, 1.0, 5.0, 1.0
#: What the labelers are taken for before any vote is seen: chances of - 0 + where there is no personal data, and where there is.
BELIEFS = {
    "checksum": ((0.6, 0.3, 0.1), (0.002, 0.298, 0.7)),
    "gazetteer": ((0.3, 0.5, 0.2), (0.05, 0.45, 0.5)),
    "cue": ((0.01, 0.84, 0.15), (0.01, 0.49, 0.5)),
    "counter_cue": ((0.5, 0.49, 0.01), (0.002, 0.988, 0.01)),
    "edges": ((0.3, 0.01, 0.69), (0.03, 0.01, 0.96)),
    "shape": ((0.2, 0.5, 0.3), (0.05, 0.5, 0.45)),
    "company": ((0.01, 0.64, 0.35), (0.01, 0.39, 0.6)),
}
THRESHOLD = 0.5
#: Characters before a span that the cue labelers read, and the reach of the company labeler.
CONTEXT, NEARBY = 40, 150

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z", re.ASCII)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_GROUP = re.compile(r"[0-9]++")
_CAPITAL = "[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ]"
_WORD = _CAPITAL + r"[a-zß-öø-ÿāăąćčďđēęěğģīįłńňōőœřśşšťūůűźżž]+(?:[-'’]" + _CAPITAL + r"?[a-zß-öø-ÿ]+)?"
#: Two capitalised words (the first may be a known given name), or one or two after a title or a cue.
_NAME = re.compile(rf"(?<![\w.@-])({_WORD})\x20({_WORD})(?![\w@])")
_TITLED = re.compile(rf"(?<![\w.@-])(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme)\.?|Herrn?|Frau|Señora?|Monsieur|Madame|[Nn]ame:|[Kk]ontakt:|[Cc]ontact:|[Nn]ombre:|[Nn]om:|[Pp]atient(?:in)?:?)\x20({_WORD}(?:\x20{_WORD})?)(?![\w@])")

#: Gazetteers: common given names, words of address before names, providers of mail, beginnings of card numbers, calling codes.
GIVEN = frozenset(
    """
    James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Andrew Kevin Brian George Edward
    Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Emma Olivia Laura Helen
    Peter Hans Klaus Jürgen Wolfgang Günter Dieter Werner Uwe Stefan Andreas Christian Matthias Florian Lukas Jonas Felix Björn Jörg Götz
    Anna Maria Sabine Monika Petra Ursula Renate Claudia Katrin Anja Birgit Heike Silke Ingrid Gisela Käthe Bärbel Hannah Lena Sophie
    Pierre Jean Jacques Michel André Philippe Nicolas François René Étienne Jérôme Benoît Luc Guillaume Antoine Mathieu Émile Gérard Hervé Rémi
    Marie Camille Nathalie Isabelle Sylvie Catherine Hélène Céline Aurélie Élodie Zoé Chloé Manon Inès Anaïs Amélie Geneviève Brigitte Véronique Margaux
    Juan José Carlos Luis Miguel Javier Antonio Manuel Francisco Jesús Pablo Diego Andrés Álvaro Raúl Sergio Iván Óscar Rubén Ángel
    Carmen Lucía Elena Sofía Isabel Pilar Teresa Rosa Cristina Marta Beatriz Inés Mónica Verónica Begoña Raquel Silvia Rocío Julia Ana
    """.split()
)
MAIL = ("mail", "gmail", "outlook", "hotmail", "yahoo", "gmx", "web", "smtp")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
#: Words before a span that speak for personal data or against it.
_CUE = re.compile(r"(?i)e-?mail|mail(?:to)?\b|phone|tel\b|call|mobile|fax|card|visa|account|konto|iban|ssn|contact|name|nombre|\bnom\b|mr\b|mrs\b|\bms\b|\bdr\b|prof\b|herr|frau|señor|monsieur|madame|kontakt|teléfono|tarjeta|courriel|carte|address|user|client|customer|patient")
#: What follows a name that is a place's or a company's.
_AFTER = re.compile(r"\x20(?:Street|Road|Avenue|Lane|Square|Straße|Platz|Allee|Rue|Calle|Plaza|University|Institute|School|Hospital|Museum|Airport|GmbH|AG|Inc|Ltd|LLC|Corp|S\.A|SARL|SL)\b")
_COUNTER = re.compile(r"(?i)isbn|version|order|invoice|serial|model|sha|md5|hash|uuid|revision|build|issue|page|no\.|#|=|https?:")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds: leftmost matches of each, those that fail dropped."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        if (m := _DOMAIN.match(text, at + 1)) and (start := _run_start(text, at, end)) < at:
            out.append((start, "email", m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CHAIN.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_order)


_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, at: int, least: int) -> int:
    """Where the run of characters of an address before `at` begins, not before `least`."""
    while at > least and text[at - 1] in _LOCAL_CHARACTERS:
        at -= 1
    return at


def _order(span: tuple[int, str, int]) -> tuple:
    return span[0], KINDS.index(span[1]), span[2]


def candidates(text: str, base: list[tuple[int, str, int]], given: frozenset[str] = GIVEN) -> list[tuple[int, str, int]]:
    """Spans of the other kinds, apart from the base ones."""
    found = [(m.start(), "iban", m.end()) for m in _IBAN.finditer(text)]
    for m in _CHAIN.finditer(text):
        if 9 <= len(_digits(m[0])) <= 19:
            found.append((m.start(), "number", m.end()))
        elif len(m[0]) > 19:  # several numbers side by side
            found += [(m.start() + g.start(), "number", m.start() + g.end()) for g in _GROUP.finditer(m[0]) if 9 <= g.end() - g.start() <= 19]
    found += [(m.start(1), "name", m.end(1)) for m in _TITLED.finditer(text)]
    found += [(m.start(), "name", m.end()) for m in _NAME.finditer(text) if m[1] in given]
    out: list[tuple[int, str, int]] = []
    taken = sorted(base)
    begins = [a for a, _, _ in taken]
    for a, k, b in found:  # those found first keep their place
        i = bisect.bisect_left(begins, b)
        if not any(e > a for _, _, e in taken[max(0, i - 4) : i]):
            out.append((a, k, b))
            i = bisect.bisect_left(begins, a)
            begins.insert(i, a)
            taken.insert(i, (a, k, b))
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _issuer(digits: str) -> int:
    """Whether a card number's beginning and length go together."""
    n = len(digits)
    if digits.startswith("4"):
        return 1 if n in (13, 16, 19) else -1
    if digits[:2] in ("34", "37"):
        return 1 if n == 15 else -1
    if digits[:2] in ("51", "52", "53", "54", "55", "65") or digits.startswith("6011"):
        return 1 if n == 16 else -1
    return 1 if digits[:2] in ("35", "36") and n in (14, 16) else 0


def _checksum(kind: str, value: str, digits: str) -> int:
    if kind == "email":
        return 1 if value.rpartition(".")[2].isalpha() and len(value.rpartition(".")[2]) > 1 else -1
    if kind == "ip":
        return -1 if digits.startswith("0") or value.startswith(("127.", "255.")) else 1
    if kind == "card":
        return _issuer(digits)
    if kind == "phone":
        return 1 if len(digits) >= 11 else 0
    if kind == "iban":
        return 1 if _iban(value) else -1
    if kind == "number":
        if m := re.fullmatch(r"([0-9]{3})-([0-9]{2})-([0-9]{4})", value):
            return -1 if m[1] in ("000", "666") or m[1] >= "900" or m[2] == "00" or m[3] == "0000" else 1
        return (1 if luhn(digits) else -1) if len(digits) >= 13 else 0
    return 0


def _gazetteer(kind: str, value: str, digits: str, given: frozenset[str]) -> int:
    if kind == "email":
        return 1 if value.partition("@")[2].lower().startswith(MAIL) else 0
    if kind == "ip":
        return -1 if value.startswith(("10.", "192.168.")) else 0
    if kind == "card":
        return 1 if digits.startswith(CARD_STARTS) else 0
    if kind == "phone":
        return 1 if digits.startswith(CALLING) else -1
    if kind == "number":
        return 0 if len(digits) < 13 else 1 if digits.startswith(CARD_STARTS) and _issuer(digits) > 0 else -1
    if kind == "iban":
        return 1 if value[:2] in IBAN_COUNTRIES else -1
    return 1 if value.split(" ")[0] in given else 0


def votes(text: str, span: tuple[int, str, int], near: bool, given: frozenset[str] = GIVEN) -> str:
    """One of + - 0 for each labeler. near: another span begins within NEARBY characters."""
    a, kind, b = span
    value, before = text[a:b], text[max(0, a - CONTEXT) : a]
    digits = _digits(value)
    cue = 1 if _CUE.search(before) else 0
    counter = -1 if _COUNTER.search(before[-16:]) or kind == "name" and _AFTER.match(text, b) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    edges = -1 if left.isalnum() or right.isalnum() or left in ("_", "=", "/") else 1
    if kind == "name":
        shape = 1 if " " in value else 0
    else:
        shape = -1 if digits and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 1 if re.search(r"[ -]", value) else 0
    return "".join("-0+"[v + 1] for v in (_checksum(kind, value, digits), _gazetteer(kind, value, digits, given), cue, counter, edges, shape, int(near)))


def _kind_and_shape(text: str, span: tuple[int, str, int]) -> str:
    a, kind, b = span
    return f"{kind}|{min(3, (b - a) // 8)}"


class Model:
    """Reliabilities of the labelers and a classifier, from counts of (kind|length|votes)."""

    def __init__(self, counts: dict[str, int]):
        self.features = sorted(counts)
        n = np.array([counts[f] for f in self.features], np.float64)
        v = np.array([[{"-": 0, "0": 1, "+": 2}[c] for c in f.split("|")[2]] for f in self.features], np.int64).reshape(-1, len(LABELERS))
        kind = np.array([KINDS.index(f.split("|")[0]) for f in self.features], np.int64)
        self.posterior, self.reliability = self._maximise(n, v, kind)
        x = np.stack([self.row(f) for f in self.features]) if self.features else np.zeros((0, self.row("name|0|" + "0" * len(LABELERS)).size))
        self.weights = self._regress(x, self.posterior, n)
        z = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        self.probability = dict(zip(self.features, z.tolist(), strict=True))

    @staticmethod
    def _maximise(n: np.ndarray, v: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihood of personal data by row, and P(vote | personal data or not) by labeler, begun with BELIEFS.

        A labeler is as reliable for a kind as its votes on that kind say, and BELIEFS as PRIOR times as many.
        """
        beliefs = np.array([[BELIEFS[x][y] for x in LABELERS] for y in (0, 1)])
        given = np.repeat(beliefs[:, :, None], len(KINDS), axis=2)  # by class, labeler, kind and vote
        prior, p = np.full(len(KINDS), 0.5), np.zeros(len(n))
        whole = np.bincount(kind, weights=n, minlength=len(KINDS))
        for _ in range(ROUNDS):
            odds = np.log(prior[kind]) - np.log(1 - prior[kind])
            for j in range(len(LABELERS)):
                odds = odds + np.log(given[1, j, kind, v[:, j]]) - np.log(given[0, j, kind, v[:, j]])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            # held near one half, or a kind that is mostly personal data ends as nothing else
            prior = (np.bincount(kind, weights=n * p, minlength=len(KINDS)) + SMOOTHING + PRIOR * whole / 2) / ((1 + PRIOR) * whole + 2 * SMOOTHING)
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                for j in range(len(LABELERS)):
                    c = np.bincount(kind * 3 + v[:, j], weights=w, minlength=3 * len(KINDS)).reshape(-1, 3) + (SMOOTHING + PRIOR * whole[:, None]) * beliefs[y, j]
                    given[y, j] = c / c.sum(axis=1, keepdims=True)
        return p, given

    @staticmethod
    def row(feature: str) -> np.ndarray:
        kind, length, vote = feature.split("|")
        out = [1.0, *(float(kind == k) for k in KINDS), *(float(length == str(i)) for i in range(4))]
        for c in vote:
            out += [float(c == "+"), float(c == "-")]
        return np.array(out)

    @staticmethod
    def _regress(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Newton's method for a ridge-penalised logistic regression on likelihoods."""
        w = np.zeros(x.shape[1])
        for _ in range(25):
            z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (z - y)) + RIDGE * w
            h = (x * (n * z * (1 - z))[:, None]).T @ x + RIDGE * np.eye(len(w))
            step = np.linalg.solve(h, gradient)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        return w


_ITEMS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("feature", pa.string())]))


def _items(given: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                made = []
                for text in part.column(1).to_pylist():
                    base = base_spans(text)
                    both = sorted(base + candidates(text, base, given), key=_order)
                    begins = [a for a, _, _ in both]
                    items = []
                    for i, (a, k, b) in enumerate(both):
                        # others that begin at the same place are the same text
                        near = any(0 < abs(begins[j] - a) <= NEARBY for j in (bisect.bisect_left(begins, a) - 1, bisect.bisect_right(begins, a)) if 0 <= j < len(both))
                        items.append({"kind": k, "start": a, "end": b, "feature": f"{_kind_and_shape(text, (a, k, b))}|{votes(text, (a, k, b), near, given)}"})
                    made.append(items)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, _ITEMS)], names=["doc_id", "items"])

    return run


def label(docs: DataFrame, given: frozenset[str] = GIVEN) -> tuple[DataFrame, Model]:
    """doc_id and items (kind, start, end, feature) of each row of docs (doc_id, text), and the model fitted to all of them.

    given: the gazetteer of given names. Null and empty texts have no items; repeated rows have theirs each and vote
    each; without rows the model knows no feature; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    items = common.materialise(rows.mapInArrow(_items(given), "doc_id long, items array<struct<kind:string,start:int,end:int,feature:string>>"), "pii")
    # kinds, lengths and votes bound the number of features, whatever the corpus
    counts = items.select(F.explode("items.feature").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()
    return items, Model({r.feature: r.n for r in counts})


def find(docs: DataFrame, threshold: float = THRESHOLD, given: frozenset[str] = GIVEN) -> DataFrame:
    """doc_id and spans (kind, start, end, probability) of each row of docs (doc_id, text): base spans, and those the classifier adds.

    Code points, end exclusive. Null and empty texts have no spans; repeated rows have theirs each (and vote each);
    other columns are not read. A probability of just the threshold adds the span.
    """
    items, model = label(docs, given)
    known = dict(model.probability)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                kept = [(x, known[x["feature"]]) for x in row]
                out.append([{"kind": x["kind"], "start": x["start"], "end": x["end"], "probability": round(p, 9)} for x, p in kept if x["kind"] in KINDS[:BASE] or p >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans)], names=["doc_id", "spans"])

    return items.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,probability:double>>")


def op5_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of all documents; n_spans counts added spans too."""
    found = find(common.table(spark, sf_dir, "documents"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:BASE]))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
