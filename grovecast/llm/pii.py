"""Personal data by a semi-Markov conditional random field over whole spans.

Exact patterns give the base spans, which always stay. Around them, candidate segments (numbers with unusual
separators, addresses written with "at" and "dot") are scored by features of the whole span: digit counts, grouping,
checksum, context word, boundaries. The weights are the maximum-likelihood estimate over segmentations of synthetic
sentences (forward-backward over the lattice of candidates), and dynamic programming over the candidates of a text
chooses boundaries and kinds together. An entity has at most MAX_SPAN characters, so the lattice stays local.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
MAX_SPAN = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each kind; matches that fail their test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out["email"].append((a, done))
        at = text.find("@", at + 1)
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out["phone"].append(m.span())
    return out


# candidates ---------------------------------------------------------------------------------------------------------

_NUMBERS = re.compile(r"(?<![0-9A-Za-z_])\+?\(?[0-9](?:[ .()/\- ‐-―]{0,3}[0-9]){6,}(?![0-9A-Za-z_])")
_GROUP = re.compile(r"[0-9]+")
_SPOKEN = re.compile(
    r"(?i)(?<![\w.])([\w.+-]{1,40})\s?(?:\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s)|@)\s?([\w-]{1,40})((?:\s?(?:\(dot\)|\[dot\]|\{dot\}|(?<=\s)dot(?=\s))\s?[\w-]{1,20}){1,4})(?!\w)"
)
_SPOKEN_HINT = re.compile(r"(?i)[(\[{\s]dot[)\]}\s]")
#: addresses of hosts with their dots set apart or in brackets, and those of eight hexadecimal groups
_HOST = re.compile(r"(?i)(?<![\w.])[0-9]{1,3}(?:(?:\s?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\))\s?|\sdot\s|\s\.\s?|\.\s)[0-9]{1,3}){3}(?!\w|\.\w)")
_HOST6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
_CONTEXT = {
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp telefon telefono teléfono téléphone rufnummer".split()),
    "card": frozenset("card visa mastercard amex credit karte tarjeta carte".split()),
    "ip": frozenset("ip host server address addr".split()),
    "email": frozenset("mail email e-mail contact write correo courriel".split()),
    "other": frozenset("isbn order invoice version id ref no number date sku serial part ean bestellung pedido commande".split()),
}


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of segments that the model may choose; no longer than MAX_SPAN."""
    out = []
    for m in _NUMBERS.finditer(text):
        a, b = m.span()
        if b - a <= MAX_SPAN:
            for kind in ("phone", "card"):
                out.append((a, b, kind))
        groups = [(a + g.start(), a + g.end()) for g in _GROUP.finditer(m.group())]
        for x, (s, _) in enumerate(groups if len(groups) > 1 else ()):  # part of a longer run of groups
            s -= s > a and text[s - 1] == "("
            s -= s > a and text[s - 1] == "+"
            n = 0
            for p, e in groups[x : x + 19]:
                n += e - p
                if n > 19 or e - s > MAX_SPAN:
                    break
                if n >= 7 and (s, e) != (a, b):
                    out += [(s, e, "phone"), (s, e, "card")]
    if _SPOKEN_HINT.search(text):
        for m in _SPOKEN.finditer(text):
            if m.end() - m.start() <= MAX_SPAN:
                out.append((m.start(), m.end(), "email"))
    for pattern in (_HOST, _HOST6):
        out += [(*m.span(), "ip") for m in pattern.finditer(text) if m.end() - m.start() <= MAX_SPAN]
    return out


def context(text: str, start: int) -> str:
    before = text[max(0, start - 24) : start].lower()
    for word in reversed(re.findall(r"[^\W\d_][\w-]*", before)[-2:]):
        for kind, words in _CONTEXT.items():
            if word in words:
                return kind
    return "none"


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Names of the features of one whole span."""
    s = text[start:end]
    d = _NOT_DIGIT.sub("", s)
    seps = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", s))))
    groups = "-".join(str(min(len(g), 9)) for g in _GROUP.findall(s))
    ctx = context(text, start)
    out = [f"{kind}:bias", f"{kind}:context={ctx}", f"{kind}:seps={seps[:4]}", f"{kind}:n={min(len(d), 20)}"]
    if kind == "email":
        tail = re.findall(r"[\w-]+", s)[-1]
        out += [f"email:tail={2 <= len(tail) <= 6 and tail.isalpha()}", f"email:spoken={bool(re.search(r'[(\[{]', s))}", f"email:dots={len(re.findall('(?i)dot', s))}"]
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        hexadecimal = ":" in s
        out = [f"ip:bias={hexadecimal}", f"ip:context={ctx}", f"ip:fits={hexadecimal or all(int(x) <= 255 and (x == '0' or x[0] != '0') for x in parts)}", f"ip:bracket={'[' in s or '(' in s or '{' in s}"]
        out.append(f"ip:letters={hexadecimal and re.search('[a-fA-F]', s) is not None}")
    else:
        inner = (start > 1 and text[start - 2 : start].strip()[-1:].isdigit()) or text[end : end + 2].strip()[:1].isdigit()
        out += [f"{kind}:groups={groups}", f"{kind}:inner={inner}", f"{kind}:plus={s[0] == '+'}", f"{kind}:paren={'(' in s}"]
        out.append(f"{kind}:uneven={len(set(re.findall(r'[^0-9+()]+', s)))}")
        if kind == "card":
            out.append(f"card:luhn={13 <= len(d) <= 19 and luhn(d)}")
            out.append(f"card:varied={len(set(d)) > 3}")
    return out


class Model:
    """Log-linear scores of spans; text outside entities scores nothing."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(n, 0.0) for n in names)

    def best(self, text: str, fixed: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The best set of candidates that overlap neither each other nor the fixed spans."""
        return decode((a, b, k, self.score(features(text, a, b, k))) for a, b, k in outside(candidates(text), fixed))


def outside(cands: list[tuple[int, int, str]], fixed: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The candidates that overlap none of the fixed spans, which are sorted: one search in their union for each."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in fixed:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    if not starts:
        return cands
    out = []
    for c in cands:
        k = bisect_left(starts, c[1]) - 1  # the last range that begins before the candidate ends
        if k < 0 or ends[k] <= c[0]:
            out.append(c)
    return out


def decode(scored: Iterable[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Viterbi over segment ends."""
    scored = sorted((x for x in scored if x[3] > 0), key=lambda x: (x[1], x[0], x[2]))
    ends = sorted({x[1] for x in scored})
    at = {e: i + 1 for i, e in enumerate(ends)}
    best, back = [0.0] * (len(ends) + 1), [None] * (len(ends) + 1)
    k = 0
    for i, e in enumerate(ends, 1):
        best[i] = best[i - 1]
        while k < len(scored) and scored[k][1] == e:
            a, b, kind, s = scored[k]
            j = bisect_right(ends, a)
            if best[j] + s > best[i]:
                best[i], back[i] = best[j] + s, (j, (a, b, kind))
            k += 1
    out, i = [], at[ends[-1]] if ends else 0
    while i:
        if back[i]:
            i, span = back[i]
            out.append(span)
        else:
            i -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e300 else a


def marginals(cands: list[tuple[int, int, str]], scores: list[float]) -> list[float]:
    """Probability of each candidate under the model, by forward-backward over the cut points."""
    points = sorted({p for a, b, _ in cands for p in (a, b)})
    at = {p: i for i, p in enumerate(points)}
    n = len(points)
    into, out_of = [[] for _ in range(n)], [[] for _ in range(n)]
    for k, (a, b, _) in enumerate(cands):
        into[at[b]].append((at[a], scores[k]))
        out_of[at[a]].append((at[b], scores[k]))
    fwd, bwd = [0.0] * n, [0.0] * n
    for i in range(1, n):
        fwd[i] = fwd[i - 1]
        for j, s in into[i]:
            fwd[i] = _log_add(fwd[i], fwd[j] + s)
    for i in range(n - 2, -1, -1):
        bwd[i] = bwd[i + 1]
        for j, s in out_of[i]:
            bwd[i] = _log_add(bwd[i], bwd[j] + s)
    return [math.exp(min(0.0, fwd[at[a]] + s + bwd[at[b]] - fwd[-1])) for (a, b, _), s in zip(cands, scores, strict=True)]


def synthetic(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """One sentence with its true spans: personal data in odd spellings, or numbers that are none."""
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pre = " ".join(word() for _ in range(rng.randint(1, 5)))
    post = " ".join(word() for _ in range(rng.randint(1, 5)))
    which = rng.randrange(11)
    lead, s, kind = "", "", None
    if which == 0:
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" AT ", " DOT ")])
        s, kind = word() + at + word() + dot + rng.choice(["com", "org", "net", "de", "fr", "es"]), "email"
        lead = rng.choice(["", "", "mail ", "contact "])
    elif which in (1, 2):
        shape = rng.choice(["({}) {}-{}|3 3 4", "{}-{}-{}|3 3 4", "{}.{}.{}|3 3 4", "00{} {} {} {}|2 2 3 4", "0{} {} {} {} {}|1 2 2 2 2", "{} {}-{}|3 3 4", "0{}-{}|3 7", "0{}/{}|3 6", "0{} {}|3 7", "0{}-{}|2 8"])
        form, sizes = shape.split("|")
        s, kind = form.format(*(digits(int(n)) for n in sizes.split())), "phone"
        lead = rng.choice(["call ", "phone ", "tel ", "mobile ", ""])
        if not lead and ("(" not in s and s.count("-") < 2):
            lead = "tel "
        if rng.random() < 0.2:  # several in one run
            more = form.format(*(digits(int(n)) for n in sizes.split()))
            gap = rng.choice([" / ", "  ", " - "])
            head = f"{pre} {lead}"
            return f"{head}{s}{gap}{more} {post}", [(len(head), len(head) + len(s), kind), (len(head) + len(s) + len(gap), len(head) + len(s) + len(gap) + len(more), kind)]
    elif which in (3, 4):
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice([".", "/", "  ", "–"])
        s, kind = sep.join(d[i : i + 4] for i in range(0, 16, 4)), "card"
        lead = rng.choice(["card ", "visa ", ""])
    elif which == 5:
        s = rng.choice([digits(16), digits(8), digits(10), digits(12), digits(20), digits(14)])
        while 13 <= len(s) <= 19 and luhn(s):
            s = digits(len(s))
        lead = rng.choice(["order ", "id ", "", "invoice ", "ref "])
    elif which == 6:
        s = rng.choice([f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(4)}-{digits(4)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}"])
        lead = rng.choice(["isbn ", "date ", "", "version ", "no "])
    elif which == 7:
        s = f"{word()} at {word()}. {word().title()}"
    elif which == 8:
        s = ".".join(digits(rng.randint(1, 3)) for _ in range(5))
        lead = rng.choice(["version ", ""])
    elif which == 9:
        lead = rng.choice(["ip ", "host ", "", "server "])
        if rng.random() < 0.4:
            s = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.5 else f"{rng.randrange(4096, 65536):x}:{rng.randrange(65536):x}::{rng.randrange(65536):x}"
        else:
            s = rng.choice(["[.]", "(.)", " dot ", "[dot]", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
            if not lead and " . " in s:
                lead = "ip "
        kind = "ip"
    else:
        s = rng.choice([" . ", ". ", "[.]"]).join(str(rng.choice([rng.randint(0, 9), rng.randint(256, 999)])) for _ in range(4))
        if all(int(x) <= 255 for x in re.findall("[0-9]+", s)):
            s += "99"
        if rng.random() < 0.3:
            s = f"{digits(2)}:{digits(2)}:{digits(2)}"
        lead = rng.choice(["no ", "version ", ""])
    head = f"{pre} {lead}"
    text = f"{head}{s} {post}"
    return text, [(len(head), len(head) + len(s), kind)] if kind else []


_FITTED: dict[tuple[int, int], Model] = {}


def fit(sentences: int = 1500, rounds: int = 12, seed: int = 7) -> Model:
    """Maximum likelihood with a small ridge, by stochastic gradient over synthetic sentences; the same at every run."""
    if (sentences, rounds) in _FITTED:
        return _FITTED[sentences, rounds]
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, true = synthetic(rng)
        base = [s for spans in base_spans(text).values() for s in spans]
        cands = outside(candidates(text), sorted(base))
        if cands:
            data.append((cands, [features(text, *c) for c in cands], [float(c in true) for c in cands]))
    w: dict[str, float] = {}
    for r in range(rounds):
        rng.shuffle(data)
        rate = 0.5 / (1 + 0.3 * r)
        for cands, feats, truth in data:
            probs = marginals(cands, [sum(w.get(f, 0.0) for f in fs) for fs in feats])
            for fs, p, t in zip(feats, probs, truth, strict=True):
                if abs(t - p) > 1e-4:
                    for f in fs:
                        w[f] = w.get(f, 0.0) * (1 - 1e-4) + rate * (t - p)
    return _FITTED.setdefault((sentences, rounds), Model(w))


_ANY = re.compile(r"[0-9@]")


def find(text: str | None, model: Model) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) by kind."""
    none = {k: [] for k in KINDS}
    if not text or not (_ANY.search(text) or _SPOKEN_HINT.search(text)):
        return none, none
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    for a, b, kind in model.best(text, sorted(s for v in base.values() for s in v)):
        every[kind].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def mask(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Each maximal covered range becomes the name of its first span's kind in angle brackets."""
    every = sorted((a, -b, k) for k, v in spans.items() for a, b in v)
    out, last = [], 0
    for a, b, k in every:
        b = -b
        if a >= last:
            out += [text[last:a], f"<{k}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def personal_data(docs: DataFrame) -> DataFrame:
    """FOUND for each row of docs (doc_id, text): counts of the base spans, their digest, and all spans of the model.

    Positions are code points, ends exclusive. A null or empty text has no spans. Repeated rows give repeated results;
    other columns are ignored; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit())

    def run(batches):
        model = sent.value
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, every = find(text, model)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, every.values()))))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            cols = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """docs with all their columns and rows; every span of personal data in text is replaced by its kind. Nulls stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fit())
    at = docs.columns.index("text")

    def run(batches):
        model = sent.value
        for b in batches:
            texts = [mask(t, s) if t and any((s := find(t, model)[1]).values()) else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, pa.string()).cast(b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
