"""Personal data: exact base patterns, and looser candidates that boosted trees accept.

Generators propose overlapping spans of the four kinds, among them written-out
addresses ("name at host dot com"), numbers in unusual groupings and numbers
that run into the next one.  Trees learn from spans that the base patterns
confirm or refuse, from confirmed ones rewritten into the looser forms, and from
decoys: rewritten spans whose digits are wrong, parts of spans, and ordinary
words around "at" and "dot".  Loose candidates that the texts hold themselves
have no label and aren't learned from.  A threshold for each kind is set on
rewritten spans and decoys of texts the trees haven't seen.  Accepted spans that
overlap a base span or a better one are dropped; base spans always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .sampling import bounded, held_out

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[\[({]\x20?at\x20?[\])}]\x20?", r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
#: Looser forms.  A match starts and ends at the edge of a word.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:\x20@\x20[A-Za-z0-9-]{{1,63}}(?:\x20?\.\x20?[A-Za-z0-9-]{{2,63}}){{1,4}}|{_AT}[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT})[A-Za-z0-9-]{{2,63}}){{1,4}}|(?:@|\x20at\x20)[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.,\[(]{1,2}\x20?(?:dot)?[\])]?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-]{1,2}[0-9]{4}(?![0-9])",
}
#: Whether a text can hold a span at all.
MAYBE = r"[0-9@]|[\[({]\x20?at\x20?[\])}]|\bdot\b"
#: Texts that the trees learn from, and examples drawn from them, at most.
TEXTS, EXAMPLES = 4000, 200_000
TREES, LEAVES_DEPTH, RATE, PRECISION = 40, 3, 0.3, 0.98
CONTEXT = 24
# Where a number's first digit can't start a match, its others can't either; without the look-behind they would all be tried.
_BASE = {k: re.compile((r"(?<![0-9])" if k == "ip" else "") + v) for k, v in BASE.items()}
_LOOSE = {k: re.compile(v) for k, v in LOOSE.items()}
_HINT = {"email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|addr|host|server", re.I), "card": re.compile(r"card|visa|pay|credit", re.I), "phone": re.compile(r"tel|phone|call|mobil|fax", re.I)}
FEATURES = ["kind", "length", "digits", "letters", "marks", "spaces", "at", "dots", "words_out", "luhn", "most_part", "first_digit", "parts", "last_part", "hint", "digit_before", "digit_after", "letter_before", "letter_after", "digits_near", "known_end", "name_marks", "short_parts"]
_ENDS = ("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk", "eu")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    """The base's check of a match of its pattern."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


def matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """All matches of the base pattern, leftmost first; addresses are sought around each @."""
    if kind != "email":
        yield from (m.span() for m in _BASE[kind].finditer(text))
        return
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {k: [(a, b) for a, b in matches(k, text) if passes(k, text[a:b])] for k in KINDS}


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    d = _digits(s)
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", s) if p]
    numbers = [int(p[:9]) for p in parts if p.isascii() and p.isdigit()]
    letters = sum(c.isalpha() for c in s)
    name = re.split(r"[\x20\[({@]", s, maxsplit=1)[0]
    return [
        KINDS.index(kind), len(s), len(d), letters, len(s) - len(d) - letters, s.count(" "), s.count("@"), s.count("."), len(re.findall(r"[\[({\x20](?:at|dot)[\])}\x20]", s)),
        float(bool(d) and luhn(d)), max(numbers, default=-1), int(d[0]) if d else -1, len(parts), len(parts[-1]) if parts else 0, float(bool(_HINT[kind].search(before))),
        float(before[-1:].isdigit()), float(after[:1].isdigit()), float(before[-1:].isalpha()), float(after[:1].isalpha()), len(_digits(before)) + len(_digits(after)), float(bool(parts) and parts[-1].lower() in _ENDS),
        sum(c in "._%+-" or c.isdigit() for c in name), sum(len(p) < 3 for p in parts),
    ]


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of every generator that aren't base spans themselves."""
    found = set()
    for k in KINDS:
        own = set(base[k])
        found.update((k, *m.span()) for m in _LOOSE[k].finditer(text) if m.span() not in own)
    return sorted(found)


def loosened(kind: str, s: str, pick: int) -> str:
    """A base span in one of the looser forms."""
    if kind == "email":
        at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", " . "))[pick % 5]
        name, host = s.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s.replace(".", (" . ", "[.]", "(dot)")[pick % 3])
    d = _digits(s)
    if kind == "card":
        return ("-", " ", ".", "/", "--")[pick % 5].join((d[:4], d[4:8], d[8:12], d[12:16]))
    d = d[-10:]
    return ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+1 ({}) {}-{}", "001 {} {} {}")[pick % 5].format(d[:3], d[3:6], d[6:])


def varied(kind: str, s: str, pick: int, words: list[str]) -> str:
    """A base span of the same kind with other names or digits."""
    r = random.Random(pick * len(KINDS) + KINDS.index(kind))
    if kind == "email":
        w = [x.lower() for x in words if x.isascii() and len(x) > 2] or ["name"]
        name = r.choice(("{}.{}", "{}_{}", "{}{}", "{}-{}")).format(r.choice(w), r.choice((r.choice(w), str(r.randrange(1, 9999)))))
        return name + "@" + ".".join([*(r.choice(w) for _ in range(r.randrange(1, 3))), r.choice(_ENDS)])
    if kind == "ip":
        return ".".join(str(r.choice((r.randrange(10), r.randrange(100), r.randrange(256)))) for _ in range(4))
    d = "".join(str(r.randrange(10)) for _ in range(15 if kind == "card" else 9))
    if kind == "phone":
        return str(r.randrange(2, 10)) + d
    d = str(r.randrange(3, 7)) + d[1:]
    return next(d + c for c in "0123456789" if luhn(d + c))


def decoy(kind: str, s: str, pick: int, words: list[str]) -> str:
    """Something that a generator proposes and that isn't personal data."""
    if kind == "email":
        w = [x for x in words if x.isascii() and x.isalpha()] or ["look", "this", "that"]
        end = _ENDS[pick % len(_ENDS)] if pick % 2 else w[(pick + 2) % len(w)]
        return f"{w[pick % len(w)]} at {w[(pick + 1) % len(w)]} dot {end}"
    if kind == "ip":
        parts = s.split(".")
        if pick % 2:
            return ", ".join(parts)
        parts[pick % 4] = str(256 + pick * 37 % 700)
        return (" . ", "[.]", ", ")[pick % 3].join(parts)
    d = list(_digits(s))
    if kind == "card":
        d[pick % 16] = str((int(d[pick % 16]) + 1 + pick % 8) % 10)
        return loosened(kind, "".join(d), pick)
    d = "".join(d[-10:])
    return ("{0}-{1}-{2}-" + d[:4], "{2}-{1}-{0}", "{0}{1}.{2}" + d[:3])[pick % 3].format(d[:3], d[3:6], d[6:])


def examples(doc: int, text: str) -> list[tuple[int, int, int, list[float]]]:
    """(document, label, 1 where it is no base match, features) of confirmed and refused matches, rewritten ones and decoys."""
    base = base_spans(text)
    out = []

    def planted(kind: str, a: int, b: int, s: str, label: int, lead: str = "") -> None:
        before = text[:a][-2 * CONTEXT :] + lead
        out.append((doc, label, 1, features(kind, before + s + text[b : b + 2 * CONTEXT], len(before), len(before) + len(s))))

    for k in KINDS:
        good = set(base[k])
        for a, b in matches(k, text):
            out.append((doc, int((a, b) in good), 0, features(k, text, a, b)))
            if (a, b) not in good:
                continue
            s, pick = text[a:b], doc + a
            words = re.findall(r"[A-Za-z]+", text[max(0, a - 400) : a + 400])
            for i in range(2):
                for like in (s, varied(k, s, pick + i, words)):
                    if k != "card" or len(_digits(like)) == 16:
                        planted(k, a, b, loosened(k, like, pick + i), 1)
                        planted(k, a, b, decoy(k, like, pick + 3 * i, words), 0)
            if k == "email":  # a plain name is an address only where the text says so
                w = [x.lower() for x in words if len(x) > 2] or ["name"]
                host = varied(k, s, pick, words).split("@", 1)[1] if pick % 2 else s.split("@", 1)[1]
                planted(k, a, b, loosened(k, w[pick % len(w)] + "@" + host, 0), 1, ("mail ", "contact: ", "write to ")[pick % 3])
            planted(k, a, b, s[: max(1, len(s) * 2 // 3)], 0)
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), MAYBE), False))
        rows = [r for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for r in examples(doc, text.as_py())]
        if rows:
            doc, label, loose, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(label, pa.int32()), pa.array(loose, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array([0] * len(rows), pa.int32())], names=["doc_id", "label", "loose", "x", "model"])


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple:
    """A regression tree: (feature, cut, left, right), or a leaf's value."""
    value = -grad.sum() / (hess.sum() + 1.0)
    if depth == 0 or len(x) < 20:
        return (float(value),)
    best = (1e-6, None, None)
    whole = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)))[:-1]
        if not len(cuts):
            continue
        at = np.searchsorted(cuts, x[:, f], "left")
        g, h = (np.cumsum(np.bincount(at, w, len(cuts) + 1))[:-1] for w in (grad, hess))
        gain = g**2 / (h + 1.0) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1.0) - whole
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), f, float(cuts[i]))
    if best[1] is None:
        return (float(value),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], grad[left], hess[left], depth - 1), grow(x[~left], grad[~left], hess[~left], depth - 1))


def _leaf(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _leaf(tree[2], x[left]), _leaf(tree[3], x[~left])
    return out


def likely(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for t in trees:
        total += RATE * _leaf(t, x)
    return 1 / (1 + np.exp(-total))


def fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The trees, from four fifths of the texts, and each kind's threshold from what isn't a base match in the rest, as one row."""
    rows = rows.assign(order=rows["x"].map(tuple)).sort_values(["doc_id", "label", "order"], kind="stable")
    x, y = np.array(rows["x"].tolist(), float), rows["label"].to_numpy(float)
    check = (rows["doc_id"].to_numpy() // 4) % 5 == 0
    trees: list[tuple] = []
    total = np.zeros(int((~check).sum()))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(grow(x[~check], p - y[~check], p * (1 - p), LEAVES_DEPTH))
        total += RATE * _leaf(trees[-1], x[~check])
    scored = likely(trees, x[check])
    loose = rows["loose"].to_numpy()[check] == 1
    limits = []
    for k in range(len(KINDS)):
        own = (x[check][:, 0] == k) & loose
        s, t = scored[own], y[check][own]
        order = np.argsort(-s)
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        fit_ = np.flatnonzero(right >= PRECISION)
        limits.append(float(max(0.5, s[order][fit_[-1]])) if len(fit_) else 2.0)
    return pd.DataFrame({"trees": [repr(trees)], "limits": [limits]})


def train(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple], list[float]]:
    """Trees and thresholds from at most ``TEXTS`` texts that can hold a span, and ``EXAMPLES`` examples in them; none of either kind where nothing is found.

    Of several rows with one id the text that is first in order is learned from.
    """
    import ast

    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit("all").alias("stratum")).where("doc_id is not null and text is not null")
    drawn = bounded(rows.where(F.col("text").rlike("[0-9]{3}|@")).select("doc_id", "stratum").distinct(), "stratum", "doc_id", TEXTS)
    texts = rows.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = cut(texts.mapInArrow(_examples, "doc_id long, label int, loose int, x array<double>, model int"))
    rate = EXAMPLES / max(EXAMPLES, found.count())
    # One group of a bounded number of examples.
    learned = found.where(F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) <= rate * (1 << 30)).groupBy("model").applyInPandas(fit, "trees string, limits array<double>").collect()
    return (ast.literal_eval(learned[0]["trees"]), list(learned[0]["limits"])) if learned else ([], [2.0] * len(KINDS))


def spans_of(text: str, trees: list[tuple], limits: list[float]) -> tuple[dict, dict]:
    """Base spans, and all spans, of each kind in order."""
    base = base_spans(text)
    extra = candidates(text, base)
    all_ = {k: list(v) for k, v in base.items()}
    if extra and trees:
        p = likely(trees, np.array([features(k, text, a, b) for k, a, b in extra]))
        taken = [(a, b) for v in base.values() for a, b in v]
        for i in np.argsort(-p, kind="stable"):
            k, a, b = extra[i]
            if p[i] >= limits[KINDS.index(k)] and all(b <= c or d <= a for c, d in taken):
                taken.append((a, b))
                all_[k].append((a, b))
    return base, {k: sorted(v) for k, v in all_.items()}


def _written(spans: dict) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def _find(model, redact):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, limits = model.value
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            maybe = pc.match_substring_regex(texts, MAYBE).to_pylist()
            rows = []
            for doc, text, look in zip(batch.column("doc_id").to_pylist(), texts, maybe, strict=True):
                if not look:
                    rows.append((doc, 0, 0, 0, 0, none, "", text.as_py() if redact else None))
                    continue
                s = text.as_py()
                base, all_ = spans_of(s, trees, limits)
                if not redact:
                    rows.append((doc, *(len(base[k]) for k in KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(all_), None))
                    continue
                hidden, at = [], 0
                for a, b, k in sorted((a, b, k) for k in KINDS for a, b in all_[k]):
                    if b > at:
                        hidden += [s[at : max(a, at)], f"[{k}]" if a >= at else ""]
                        at = b
                rows.append((doc, *(len(base[k]) for k in KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(all_), "".join(hidden) + s[at:]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def find(docs: DataFrame, model: tuple[list[tuple], list[float]], *, doc_col: str = "doc_id", text_col: str = "text", redact: bool = True) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, ``base_sha256``, ``spans`` and ``redacted`` text for each row.

    Null texts are empty and have no spans.  Repeated rows are searched each, and
    a text of any length whole.  Spans of one kind don't overlap; a card and a
    phone number may.  Of overlapping loose spans the likelier stays, and of
    equally likely ones the first in order of kind and place.  ``redacted`` has ``[kind]`` in place of each
    span; it is null if ``redact`` is false.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find(shared, redact), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def detect(docs: DataFrame, *, redact: bool = True) -> DataFrame:
    """Learn from the rows that aren't held out and search every row of ``docs``."""
    return find(docs, train(docs.where(~held_out(F.col("doc_id")))), redact=redact)
