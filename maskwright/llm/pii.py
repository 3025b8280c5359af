"""Operator 6, personal data: labelers vote, EM weighs them, a classifier decides on spans."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

#: Kinds in the order in which spans with one start are listed (fixed).
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The contract's patterns; a match never starts inside a run of digits, so the
# look-behinds and possessive repeats change no match, only the time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates that only the vote can turn into spans: anything that looks a little like a kind, wrong forms included.
WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s(?=[\w-]{1,63}\sdot\s))[\w-]{1,63}(?:(?:\s?\.\s?|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[A-Za-z0-9-]{1,63})+", re.I),
    "ip": re.compile(r"(?<![\w.:])(?:[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|[.,_])\s?[0-9]{1,3}){3}|(?:[0-9a-fA-F]{1,4}:){5,7}[0-9a-fA-F]{1,4})(?![\w.:])"),
    "card": re.compile(r"(?<![\w.])[0-9](?:[ ./_-]?[0-9]){12,18}(?![\w.])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\s?|\(?00?)?\(?[0-9][0-9() ./-]{5,17}[0-9](?![\w.])"),
    "secret": re.compile(r"(?<![\w+/=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,128}(?![\w+/=-])"),
}
#: Kinds that only the vote finds come after those of the contract.
FOUND = (*KINDS, "secret")
#: What a text must hold for a wide form to be tried.
HINT = {"email": re.compile(r"@|\bat\b", re.I), "ip": re.compile("[0-9]"), "card": re.compile("[0-9]{2}"), "phone": re.compile("[0-9]{2}"), "secret": re.compile(r"[A-Za-z0-9+/_=-]{20}")}
#: Gazetteers: common ends of domains, first digits of card schemes, names of fields that hold secrets.
ENDS = frozenset("com org net edu gov mil int info biz io dev app me co uk de fr es it nl be ch at eu us ca au in jp cn br mx ar se no dk fi pl pt ru example test".split())
SCHEMES = ("4", "34", "37", "51", "52", "53", "54", "55", "2221", "2720", "6011", "65", "35", "36", "38", "62")
FIELDS = re.compile(r"(?:token|secret|passw(?:or)?d|api[ _-]?key|credential|auth|bearer)\W{0,6}$", re.I)
#: Words that announce a kind of data shortly before it, and words that announce something else.
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reply|address|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|client|gateway", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|cell|dial|sms|reach|anruf|appel|llama", re.I),
    "secret": re.compile(r"token|secret|passw|key|credential|auth|bearer", re.I),
}
AGAINST = re.compile(r"version|release|order|invoice|isbn|\bid\b|page|date|part|serial|commit|sha|hash|section|figure|\bv\.?$", re.I)
REACH = 40
LABELERS = ("form", "gazetteer", "context", "border", "shape")
PATTERNS = len(FOUND) * 3 ** len(LABELERS)
SPAN = "struct<kind:int,start:int,end:int,pattern:int,features:array<int>>"
COLUMNS = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, wide array<{SPAN}>"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, dotted domain; linear in the text."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _free(found: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of ``found`` the leftmost spans that meet neither ``taken`` nor each other."""
    out, end, k, far = [], 0, 0, 0
    for a, kind, b in sorted(found):
        while k < len(taken) and taken[k][0] < b:
            far = max(far, taken[k][2])
            k += 1
        if a >= max(end, far):
            out.append((a, kind, b))
            end = b
    return out


def _shape(value: str, kind: int) -> tuple[int, int, list[int]]:
    """(digits, kinds of separators, lengths of the runs between separators) of a value."""
    runs = re.findall(r"[0-9A-Za-z]+", value)
    seps = set(re.findall(r"[^0-9A-Za-z]+", value.strip("()+ ")))
    return sum("0" <= c <= "9" for c in value), len(seps), list(map(len, runs))


def votes(text: str, start: int, kind: int, end: int) -> int:
    """The labelers' votes (0 against, 1 none, 2 for), packed in base 3 with the kind on top."""
    value, name = text[start:end], FOUND[kind]
    digits = "".join(c for c in value if "0" <= c <= "9")
    n, seps, runs = _shape(value, kind)
    before = text[max(0, start - REACH) : start]
    if kind == 0:
        labels = re.split(r"[^A-Za-z0-9-]+", value.rstrip("])} "))
        last = labels[-1].lower()
        form = 2 if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", value) else 1
        gazetteer = 2 if last in ENDS else 0 if not last.isalpha() or len(last) > 12 else 1
        shape = 0 if len(last) < 2 else 2 if re.search(r"@|[\[({]\s?at", value, re.I) else 1
    elif kind == 1:
        parts = re.findall("[0-9a-fA-F]+", value)
        ranged = ":" in value or all(len(p) <= 3 and p.isdigit() and int(p) <= 255 for p in parts)
        form = 2 if ranged else 0
        gazetteer = 0 if parts[0] in ("0", "1", "2", "3") and len(value) < 10 else 1
        shape = 2 if seps == 1 and not re.search(r"[,_]", value) else 0
    elif kind == 2:
        form = 2 if 13 <= n <= 19 and luhn(digits) else 0
        gazetteer = 2 if digits.startswith(SCHEMES) else 0
        shape = 2 if seps <= 1 and (runs in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) or len(runs) == 1) else 0
    elif kind == 3:
        form = 2 if 10 <= n <= 15 and value[0] in "+(0" else 0 if not 9 <= n <= 15 else 1
        gazetteer = 2 if value.startswith("+") else 1 if len(digits) >= 10 and digits[-10] in "23456789" and digits[-7] in "23456789" else 0
        shape = 0 if seps == 0 or re.fullmatch(r"(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\1[0-9]{1,2}.*|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{2,4}.*", value) else 2 if 2 <= len(runs) <= 6 and max(runs) <= 5 else 1
    else:
        form = 2 if n >= 4 and len(set(value)) >= 10 else 0
        gazetteer = 2 if FIELDS.search(before) else 1
        mixed = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        shape = 0 if re.search(r"[A-Za-z]{8}|-[A-Za-z]+-|[0-9]{12}", value) else 2 if mixed >= 2 else 1
    context = 0 if AGAINST.search(before[-16:]) else 2 if CONTEXT[name].search(before) else 1
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    border = 0 if any(c.isalnum() or c == "_" for c in around) else 2
    code = kind
    for vote in (form, gazetteer, context, border, shape):
        code = code * 3 + vote
    return code


#: Inputs of the final classifier: first of each group of 0/1 features.
GROUPS = {"votes": 0, "kind": 15, "digits": 20, "separators": 41, "runs": 47, "before": 55, "after": 87, "mark": 119}
WIDTH = 128


def features(text: str, start: int, kind: int, end: int, pattern: int) -> list[int]:
    """The features that hold for a span: votes, kind, the shape of the value, its neighbours (hashed), its first mark."""
    value = text[start:end]
    n, seps, runs = _shape(value, kind)
    vote = [pattern // 3**k % 3 for k in range(len(LABELERS) - 1, -1, -1)]
    word = lambda found: zlib.crc32(found[0].lower().encode()) % 32 if found else 0
    before = re.findall(r"\w+", text[max(0, start - REACH) : start])[-1:]
    after = re.findall(r"\w+", text[end : end + REACH])[:1]
    mark = {"+": 0, "(": 1, "0": 2, "@": 3}.get(value[0], 4 if "@" in value else 5 if "." in value else 6)
    out = [3 * k + v for k, v in enumerate(vote)]
    out += [GROUPS["kind"] + kind, GROUPS["digits"] + min(n, 20), GROUPS["separators"] + min(seps, 5), GROUPS["runs"] + min(len(runs), 7)]
    return out + [GROUPS["before"] + word(before), GROUPS["after"] + word(after), GROUPS["mark"] + mark]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and free wide candidates of a text."""
    base, wide = base_spans(text), []
    for kind, name in enumerate(FOUND):
        if HINT[name].search(text):
            wide += [(m.start(), kind, m.end()) for m in WIDE[name].finditer(text)]
    return base, _free(wide, base) if wide else []


def described(text: str) -> tuple[list[tuple[int, int, int]], list[dict], list[dict]]:
    """Base spans, and base and wide spans with votes and features."""
    base, wide = scan(text)
    out = []
    for spans in (base, wide):
        codes = [votes(text, *s) for s in spans]
        out.append([{"kind": k, "start": a, "end": b, "pattern": c, "features": features(text, a, k, b, c)} for (a, k, b), c in zip(spans, codes, strict=True)])
    return base, *out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, digest, and all candidate spans with their votes and features, in one pass over the texts."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in batch.column(1).to_pylist():
            base, *held = described(text)
            n = [0, 0, 0, 0]
            for _, kind, _ in base:
                n[kind] += 1
            listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
            rows.append((*n, hashlib.sha256(listed.encode()).hexdigest(), *held))
        return {"doc_id": batch.column(0)} | dict(zip(("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "wide"), zip(*rows, strict=True), strict=True))

    return S.map_batches(S.texts(docs, id_col, text_col), run, COLUMNS)


@dataclass(frozen=True)
class Reliability:
    """EM's estimate: chance that a candidate of each kind is real, and each labeler's vote chances."""

    prior: np.ndarray  # by kind
    chances: np.ndarray  # labeler, truth, vote


def _unpack(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(LABELERS)
    return patterns // 3**n, np.stack([patterns // 3**k % 3 for k in range(n - 1, -1, -1)], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, Reliability]:
    """Chance that a candidate with each vote pattern is real, from the votes' agreement alone.

    Starts at the votes' majority; each round re-estimates every labeler's
    chances given the truth (with one added count) and then the truths. A
    labeler that does not vote (1) says nothing either way.
    """
    kind, vote = _unpack(patterns)
    real = np.clip(0.5 + 0.9 * (vote.astype(float) - 1).sum(axis=1) / len(LABELERS), 0.05, 0.95)
    prior, chances = np.full(len(FOUND), 0.5), np.full((len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        for k in range(len(FOUND)):
            mine = kind == k
            prior[k] = (counts[mine] @ real[mine] + 1) / (counts[mine].sum() + 2)
        for j in range(len(LABELERS)):
            for truth, weight in ((0, 1 - real), (1, real)):
                seen = np.bincount(vote[:, j], counts * weight, minlength=3) + 1
                chances[j, truth] = seen / (seen[0] + seen[2])
                chances[j, truth, 1] = 1
        odds = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(len(LABELERS)):
            odds += np.log(chances[j, 1, vote[:, j]] / chances[j, 0, vote[:, j]])
        real = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return real, Reliability(prior, chances)


def train_classifier(spans: DataFrame, real: dict[int, float], rounds: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of EM's soft labels on the features of all spans (pattern, features): weights, the last one constant.

    Each round every partition sums its part of gradient and curvature; Spark
    adds the parts, and WIDTH + 1 squared numbers reach the driver.
    """
    d, w = WIDTH + 1, np.zeros(WIDTH + 1)
    label = np.full(PATTERNS, 0.5)
    label[list(real)] = list(real.values())

    for _ in range(rounds):
        sent = spans.sparkSession.sparkContext.broadcast((w, label))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w, label = sent.value
            total = np.zeros((d + 1, d))
            for batch in batches:
                if batch.num_rows:
                    x = _design(batch.column(1).to_pylist())
                    p = 1 / (1 + np.exp(-x @ w))
                    total[:d] += (x * (p * (1 - p))[:, None]).T @ x
                    total[d] += x.T @ (p - label[batch.column(0).to_numpy()])
            yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "part": total.ravel()})

        cells = spans.select("pattern", "features").mapInArrow(sums, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("v")).collect()
        flat = np.zeros((d + 1) * d)
        for c in cells:
            flat[c["cell"]] = c["v"]
        total = flat.reshape(d + 1, d)
        step = np.linalg.solve(total[:d] + ridge * np.eye(d), total[d] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _design(features_: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(features_), WIDTH + 1))
    x[:, WIDTH] = 1
    for k, f in enumerate(features_):
        x[k, f] = 1
    return x


def learn(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier, learnt from the votes on all candidates of all documents.

    The votes' patterns, PATTERNS at most, are counted and go to the driver,
    where EM estimates the labelers and the chance that each pattern is real;
    the classifier learns these chances from what spans and neighbours look
    like. Without candidates it accepts nothing.
    """
    spans = found.select(F.explode(F.concat("base", "wide")).alias("s")).select("s.pattern", "s.features")
    rows = spans.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    if not rows:
        return np.concatenate([np.zeros(WIDTH), [-30.0]])
    patterns, counts = np.array([r["pattern"] for r in rows]), np.array([float(r["n"]) for r in rows])
    real, _ = expectation_maximisation(patterns, counts)
    return train_classifier(spans, dict(zip(patterns.tolist(), real.tolist(), strict=True)))


def chance(features_: Column, weights: np.ndarray) -> Column:
    """The classifier's chance that a span with these features is real."""
    table = F.array(*[F.lit(float(x)) for x in weights[:WIDTH]])
    score = F.aggregate(features_, F.lit(float(weights[WIDTH])), lambda s, f: s + F.get(table, f))
    return 1 / (1 + F.exp(-score))


def detect(docs: DataFrame, least: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base counts and digest, and all spans.

    Wide candidates become spans where the classifier's chance is ``least`` or
    more; nothing else decides. Null and empty texts have no spans (digest of
    nothing); repeated rows and equal ids are handled row by row; an empty
    table gives no rows. Spans lie in the document's row, so no key gathers
    rows of several documents.
    """
    found = S.save(find(docs, id_col, text_col), "pii-candidates")
    weights = learn(found)
    added = F.filter("wide", lambda s: chance(s["features"], weights) >= least)
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    spans = F.array_sort(F.concat(F.transform("base", place), F.transform(added, place)))
    names = F.array(*[F.lit(k) for k in FOUND])
    listed = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", listed.alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span (start, kind, end) replaced by its kind; spans that overlap go together."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{FOUND[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` counted anew; other columns unchanged.

    Null texts stay null; repeated rows and rows without an id are masked like
    others; an empty table stays empty; columns of any name pass. Texts are
    read once for their spans, saved with these, and rewritten where they lie;
    none is shuffled.
    """
    spans = T.StructType.fromDDL(f"base array<{SPAN}>, wide array<{SPAN}>")

    @F.pandas_udf(spans)
    def found(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([described(t or "")[1:] for t in text], columns=["base", "wide"])

    held = S.save(docs.select(F.struct("*").alias("row"), found("text").alias("s")), "pii-spans")
    weights = learn(held.select("s.base", "s.wide"))
    kept = F.concat("s.base", F.filter("s.wide", lambda s: chance(s["features"], weights) >= least))
    flat = F.flatten(F.transform(kept, lambda s: F.array(s["start"], s["kind"], s["end"])))

    @F.pandas_udf(T.StringType())
    def rewritten(text: pd.Series, flat: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, list(zip(*[iter(map(int, f))] * 3))) for t, f in zip(text, flat, strict=True)], dtype=object)

    new = F.when(F.size(kept) > 0, rewritten(F.col("row.text"), flat)).otherwise(F.col("row.text"))
    rows = held.select("row", new.alias("text"))
    count = lambda c: F.length("text").cast(docs.schema[c].dataType)
    return rows.select(*[F.col("text") if c == "text" else count(c).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])
