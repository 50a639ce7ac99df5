"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay. Looser patterns give further candidates. Labelers of three sorts
(patterns and checksums, gazetteers, context words) vote on every span of either sort or abstain. Expectation-maximisation
over the counts of vote combinations estimates how reliable each labeler is, and so how likely each combination is private.
A logistic span classifier learns those probabilities from the spans' shapes and contexts, and decides on the candidates.
Counts of combinations cover all rows; their number is bounded by their definition, whatever the input.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.llm.stored import stored

KINDS = ("email", "ip", "card", "phone")
ACCEPTED_FROM = 0.9
EM_ROUNDS = 50

# The base patterns. Each is written so that a search is linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE = {
    "email": re.compile(
        r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{2,63})+"
    ),
    "ip": re.compile(r"(?<![:\w])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![:\w])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){14,18}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[ -])?\(?[0-9]{2,5}\)?[ -][0-9]{3}[ -]?[0-9]{3,4}(?![\w-])"),
}

# Gazetteers and context words.
_TOP_DOMAINS = frozenset("com org net edu gov int de fr es it uk eu us ca ch at nl be se no dk pl ru cn jp br in io info".split())
_CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 61 62 64 65 81 82 86 90 91".split())
_ISSUERS = tuple("34 35 36 37 38 4 51 52 53 54 55 60 62 64 65 22 23 24 25 26 27".split())
_NEAR = {
    "email": "mail email e-mail contact write reply correo courriel kontakt".split(),
    "ip": "ip host server address from client adresse dirección".split(),
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta".split(),
    "phone": "phone tel telephone mobile cell call fax telefon téléphone teléfono whatsapp".split(),
}
_AGAINST = "isbn version release order invoice page ref sku serial part article section chapter doi id token hash".split()
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")

LABELERS = ("pattern", "checksum", "gazetteer", "near", "against", "border")
Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield "email", start, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[Span]:
    for chain in _NUMBERS.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(significant := part.lstrip("0")) <= 3 and int(significant or 0) <= 255 for part in own):
                yield "ip", at, end
            at = end + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes_luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The strict patterns' matches: kind, start, end in code points; kinds in order, then starts."""
    found = [*_emails(text), *_ips(text)]
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            found.append(("card", match.start(), match.end()))
    for match in _PHONE.finditer(text):
        if 8 <= len(_digits(match.group())) <= 15:
            found.append(("phone", match.start(), match.end()))
    return found


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """The loose patterns' matches that touch no base span and no loose one of an earlier kind."""
    found: list[Span] = []
    for kind in KINDS:
        if kind == "email" and "at" not in text:
            continue
        taken = sorted((start, end) for _, start, end in [*base, *found])
        starts = [start for start, _ in taken]
        # The furthest end of all spans up to one, as spans of several kinds may lie in each other.
        reached = list(itertools.accumulate((end for _, end in taken), max))
        for match in _LOOSE[kind].finditer(text):
            start, end = match.span()
            before = bisect_left(starts, end)
            if not before or reached[before - 1] <= start:
                found.append((kind, start, end))
    return found


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """What the labelers say on a span: 1 private, -1 not, 0 nothing; in the order of :data:`LABELERS`."""
    kind, start, end = span
    own = text[start:end]
    digits = _digits(own)
    if kind == "email":
        checksum = 1 if "@" in own and "." in own.partition("@")[2] else 0
        gazetteer = 1 if re.split(r"[^A-Za-z]+", own.rstrip(")]"))[-1].lower() in _TOP_DOMAINS else -1
    elif kind == "ip":
        checksum = 1 if ":" in own or all(part == "0" or part[:1] != "0" for part in own.split(".")) else -1
        gazetteer = -1 if digits[:1] == "0" or own.startswith("127.") else 0
    elif kind == "card":
        checksum = 1 if passes_luhn(digits) else -1
        gazetteer = 1 if digits.startswith(_ISSUERS) else -1
    else:
        checksum = 1 if 10 <= len(digits) <= 13 else 0
        gazetteer = 1 if own.startswith("+") and digits.startswith(_CALLING_CODES) else 0
    around = {word.lower() for word in _WORD.findall(text[max(0, start - 32) : start])}
    near = 1 if around.intersection(_NEAR[kind]) else 0
    against = -1 if around.intersection(_AGAINST) else 0
    touches = (start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and text[end].isalnum())
    return 1 if is_base else 0, checksum, gazetteer, near, against, -1 if touches else 0


def shape(text: str, span: Span) -> tuple[str, ...]:
    """What the classifier sees of a span: its kind with its digits, its separators, and the sorts of characters around it."""
    kind, start, end = span
    own = text[start:end]
    n_digits = min(len(_digits(own)), 20)
    separators = "".join(c for c in " -.()+:@" if c in own)

    def sort(c: str) -> str:
        return "end" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "mark"

    before, after = sort(text[start - 1 : start] if start else ""), sort(text[end : end + 1])
    return f"{kind} {n_digits if kind != 'email' else ''}", f"{kind} {separators}", f"before {before}", f"after {after}"


def estimated(patterns: dict[tuple[str, tuple[int, ...]], float]) -> dict[tuple[str, tuple[int, ...]], float]:
    """How likely each combination of kind and votes is private, by expectation-maximisation over their counts.

    Each labeler has, per kind, a probability of each vote on private and on other spans; a kind has a share of private
    spans. The start is the majority of votes.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in KINDS:
        own = sorted(key for key in patterns if key[0] == kind)
        if not own:
            continue
        count = np.array([patterns[key] for key in own], dtype=float)
        vote = np.array([key[1] for key in own]) + 1
        private = np.clip(0.5 + 0.2 * (vote - 1).sum(axis=1), 0.05, 0.95)
        for _ in range(EM_ROUNDS):
            likelihood = []
            for weight in (count * (1 - private), count * private):
                chance = np.stack(
                    [np.bincount(vote[:, k], weights=weight, minlength=3) + 1.0 for k in range(vote.shape[1])]
                )
                chance /= chance.sum(axis=1, keepdims=True)
                share = (weight.sum() + 1) / (count.sum() + 2)
                likelihood.append(np.log(share) + np.log(chance[np.arange(vote.shape[1]), vote]).sum(axis=1))
            private = 1 / (1 + np.exp(np.clip(likelihood[0] - likelihood[1], -50, 50)))
        out |= dict(zip(own, private.tolist(), strict=True))
    return out


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights of shape features and labeler votes."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -10.0

    def probability(self, seen: tuple[str, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights.get(name, 0.0) for name in seen), -50, 50))))

    @classmethod
    def fit(cls, seen: list[tuple[str, ...]], private: np.ndarray, count: np.ndarray, rounds: int = 500) -> SpanClassifier:
        """Gradient descent on soft labels, each combination weighted by its count."""
        if not seen:
            return cls()
        names = sorted({name for own in seen for name in own})
        place = {name: k for k, name in enumerate(names)}
        design = np.zeros((len(seen), len(names) + 1))
        design[:, -1] = 1
        for i, own in enumerate(seen):
            design[i, [place[name] for name in own]] = 1
        weights, share = np.zeros(len(names) + 1), count / count.sum()
        for _ in range(rounds):
            guess = 1 / (1 + np.exp(-np.clip(design @ weights, -50, 50)))
            weights -= 2.0 * (design.T @ (share * (guess - private)) + 1e-4 * weights)
        return cls(dict(zip(names, weights[:-1].tolist(), strict=True)), float(weights[-1]))


def _seen(text: str, span: Span, vote: tuple[int, ...]) -> tuple[str, ...]:
    own = [f"{span[0]} {name} {v}" for name, v in zip(LABELERS, vote, strict=True) if name != "pattern"]
    return (*shape(text, span), *own)


_MAY_HOLD = re.compile(rb"[0-9@]|at ?[\])]")
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                                  ("votes", pa.string()), ("seen", pa.string())]))
_FOUND_SCHEMA = "found array<struct<kind string, start int, end int, base boolean, votes string, seen string>>"


def described(raw: bytes | None) -> list[dict]:
    """Base spans and candidates of a text, with their votes and what the classifier sees."""
    if not raw or not _MAY_HOLD.search(raw):
        return []
    text = raw.decode()
    base = base_spans(text)
    out = []
    for is_base, spans in ((True, base), (False, loose_spans(text, base))):
        for span in spans:
            vote = votes(text, span, is_base)
            out.append(dict(zip(("kind", "start", "end"), span, strict=True)) | {
                "base": is_base, "votes": ",".join(map(str, vote)), "seen": "|".join(_seen(text, span, vote)),
            })
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, the described spans of the whole ``text`` of every row; none for a null or empty text."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [described(raw.as_py()) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND_TYPE)], ["doc_id", "found"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(per_batch, f"doc_id {key_type}, {_FOUND_SCHEMA}")


def train(found: DataFrame) -> SpanClassifier:
    """Estimate the labelers over all rows, then fit the classifier to the estimates.

    What reaches the driver are counts of combinations of votes and shapes, whose number does not grow with the rows.
    """
    spans = found.select(F.explode("found").alias("span"))
    rows = spans.groupBy("span.kind", "span.votes", "span.seen").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda row: (row["kind"], row["votes"], row["seen"]))
    keys = [(row["kind"], tuple(map(int, row["votes"].split(",")))) for row in rows]
    patterns: dict[tuple[str, tuple[int, ...]], float] = {}
    for key, row in zip(keys, rows, strict=True):
        patterns[key] = patterns.get(key, 0) + row["n"]
    likely = estimated(patterns)
    return SpanClassifier.fit(
        [tuple(row["seen"].split("|")) for row in rows],
        np.array([likely[key] for key in keys]),
        np.array([row["n"] for row in rows], dtype=float),
    )


def decided(found: list[dict], model: SpanClassifier) -> list[Span]:
    """Base spans, and the candidates that the classifier accepts; kinds in order, then starts."""
    kept = [
        (own["kind"], own["start"], own["end"])
        for own in found
        if own["base"] or model.probability(tuple(own["seen"].split("|"))) >= ACCEPTED_FROM
    ]
    return sorted(kept, key=lambda span: (KINDS.index(span[0]), *span[1:]))


def spans_found(found: DataFrame, model: Broadcast[SpanClassifier]) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of kind:start:end, by kind as in :data:`KINDS`, then start."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            base = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in row if s["base"]] for row in rows]
            spans = [[f"{kind}:{start}:{end}" for kind, start, end in decided(row, model.value)] for row in rows]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    key_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(per_batch, f"doc_id {key_type}, base array<string>, spans array<string>")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``spans`` of every row, by a model trained on the same rows.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; other columns are not read; repeated
    rows are found each. Without any span there is nothing to train and nothing to add.
    """
    found = stored(candidates(docs), "personal-data")
    return spans_found(found, docs.sparkSession.sparkContext.broadcast(train(found)))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, then longest, counts."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, model: Broadcast[SpanClassifier]) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns and rows stay, ``n_chars`` follows the text if it is
    there. Texts without spans, nulls included, stay as they are."""
    names, at = docs.columns, docs.columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for i, raw in enumerate(batch.column(at).cast(pa.large_binary())):
                spans = decided(described(raw.as_py()), model.value)
                if spans:
                    changed[i] = redacted(raw.as_py().decode(), spans)
            if not changed:
                yield batch
                continue
            texts = batch.column(at).to_pylist()
            for i, text in changed.items():
                texts[i] = text
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                numbers = columns[k].to_pylist()
                for i, text in changed.items():
                    numbers[i] = len(text)
                columns[k] = pa.array(numbers, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(per_batch, docs.schema)
