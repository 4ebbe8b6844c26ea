"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss."""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import numbered_columns

KINDS = ("email", "ip", "card", "phone")
#: What the model tells apart: the kinds that have a base pattern, and secrets (keys, tokens, passwords), which have none.
ALL_KINDS = (*KINDS, "secret")
Span = tuple[str, int, int]

# The base patterns. A look-behind skips starts inside a run of digits, which would only repeat a failure.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

#: Stretches that may hold entities: numbers with at most three marks between digits, and what stands around an at sign.
_NUMBERS = re.compile(r"\+?\(?[0-9](?:[\x20().+-]{0,3}[0-9])*+")
_AT = re.compile(r"@|\(at\)|\[at\]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
#: Long runs of letters and digits, which may be secrets if they hold both; such stretches are cut into whole words.
_RUN = re.compile(r"[A-Za-z0-9]{12,}+")
_WORD = re.compile(r"[A-Za-z0-9]+|.", re.S)
_JOINED = frozenset("_-/+=.")
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|bearer|credential)[\w-]*[\x20\"']*[=:\x20]*[\x20\"']*$")
#: Tokens of one entity at most; the dynamic program looks back no further.
LONGEST = 24
REACH = 64
#: Characters of a secret of several words at most (one word may have any length), and in front of it that are looked at.
SECRET, BEFORE = 128, 24


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _parts_fit(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those that fail their check are dropped. Code points, end exclusive.

    Every pattern passes over the text once, however long its runs are.
    """
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _parts_fit(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def regions(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches worth a look beside the spans that are taken: numbers, long words with digits, and the surroundings of at signs."""
    out = []
    if _DIGIT.search(text):
        out = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7 and len(_DIGIT.findall(m.group())) >= 4]
    if "@" in text or "[at]" in text or "(at)" in text:
        for m in _AT.finditer(text):
            k = bisect.bisect_right(taken, (m.start(), len(text))) - 1
            if k < 0 or taken[k][1] <= m.start():
                out.append((max(0, m.start() - REACH), min(len(text), m.end() + REACH)))
    if _DIGIT.search(text):
        out += _secret_regions(text)
    return out


def _secret_regions(text: str) -> list[tuple[int, int]]:
    """Runs of letters and digits with all that is joined to them, each looked at once."""
    out: list[tuple[int, int]] = []
    belongs = lambda c: c in _JOINED or c.isascii() and c.isalnum()
    for m in _RUN.finditer(text):
        known = out[-1][1] if out else 0
        if m.end() <= known or not _mixed(m.group()) or m.start() and text[m.start() - 1].isalnum():
            continue
        low, high = m.start(), m.end()
        while low > known and belongs(text[low - 1]):
            low -= 1
        while high < len(text) and belongs(text[high]):
            high += 1
        out.append((low, high))
    return out


def _mixed(s: str) -> bool:
    return not (s.isdigit() or s.isalpha())


def _look(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[str, ...]:
    """Features of the whole span of tokens i to j."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    n = len(digits)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", s))
    before, after = text[a - 1 : a], text[b : b + 1]
    edge = ("L" if before.isalnum() or before in "+@" and before else "") + ("R" if after.isalnum() or after == "@" and after else "")
    out = [f"edge {edge}", f"digits {n if n < 20 else 'many'}"]
    groups = re.findall("[0-9]+", s)
    marks = "".join(sorted(set(re.sub(r"[A-Za-z]+", "a", re.sub("[0-9]", "", s)))))
    out.append(f"marks {marks}")
    if shape == "9.9.9.9":
        out.append(f"quad {_parts_fit(s)}")
    if 14 <= n <= 19 and not set(marks) - set(" -"):
        out.append(f"card {luhn(digits)} {len({len(g) for g in groups[:-1]}) <= 1}")
    if 10 <= n <= 15 and not set(marks) - set("+ ().-"):
        out.append(f"phone {s[0] == '+'} {len(groups) >= 3} {'(' in s}")
    if re.fullmatch(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", s, re.A):
        out.append("mail")
    return tuple(out)


def _look_secret(text: str, a: int, b: int) -> tuple[str, ...]:
    """Features of a whole span that may be a secret."""
    s = text[a:b]
    kinds = ("lower" if re.search("[a-z]", s) else "") + ("UPPER" if re.search("[A-Z]", s) else "") + ("hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "")
    turns = len(re.findall("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", s))
    size = next((str(k) for k in (12, 16, 20, 24, 32, 40, 64) if len(s) <= k), "more")
    edge = ("L" if a and text[a - 1].isalnum() else "") + ("R" if text[b : b + 1].isalnum() else "")
    harsh = max((len(x) for x in re.findall("[b-df-hj-np-tv-z]+", s.lower())), default=0)  # consonants in a row, rare in words
    named = bool(_NAMED.search(text, max(0, a - BEFORE), a))
    return (f"S edge {edge}", f"S {kinds} {size}", f"S turns {min(5, turns * 12 // len(s))}", f"S marks {''.join(sorted(set(s) & _JOINED))}", f"S named {named}", f"S named {named} {min(3, turns)}", f"S turns {min(5, turns * 12 // len(s))} {kinds}", f"S harsh {min(7, harsh)}", f"S harsh {min(7, harsh)} {kinds}")


def lattice(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, tuple[str, ...]]]]]:
    """Tokens of a region, and for each end the candidate segments that end there as ``(first token, features)``."""
    mail = bool(_AT.search(text, low, high))
    if not mail and any(_mixed(m.group()) for m in _RUN.finditer(text, low, high)):
        return _secret_lattice(text, low, high)
    tokens = [(low + m.start(), low + m.end()) for m in _TOKEN.finditer(text[low:high])]
    digit = [text[a].isdigit() for a, _ in tokens]
    word = [text[a].isalnum() for a, _ in tokens]
    ends: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
    for j in range(1, len(tokens) + 1):
        if not (word[j - 1] if mail else digit[j - 1]):
            continue
        for i in range(max(0, j - LONGEST), j):
            first = text[tokens[i][0]]
            size = tokens[j - 1][1] - tokens[i][0]
            if 7 <= size <= REACH and (word[i] or first in "+("):
                ends.setdefault(j, []).append((i, _look(text, tokens, i, j)))
    return tokens, ends


def _secret_lattice(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, tuple[str, ...]]]]]:
    tokens = [(low + m.start(), low + m.end()) for m in _WORD.finditer(text[low:high])]
    ends: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
    for j in range(1, len(tokens) + 1):
        if not text[tokens[j - 1][0]].isalnum():
            continue
        for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if not text[a].isalnum():
                if text[a] in _JOINED:
                    continue
                break
            if b - a > SECRET and i < j - 1:
                break
            if b - a >= 12 and _mixed(re.sub("[^A-Za-z0-9]", "", text[a:b])):
                ends.setdefault(j, []).append((i, _look_secret(text, a, b)))
    return tokens, ends


class SemiMarkov:
    """Scores of segment features for each kind; what is in no entity is passed token by token at score 0."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, kind: str, look: tuple[str, ...]) -> float:
        w = self.weights
        return w.get((kind, "bias"), -2.0) + sum(w.get((kind, f), 0.0) for f in look)

    def best(self, text: str, low: int, high: int) -> list[Span]:
        """Boundaries and kinds of the highest joint score; ties go to fewer entities."""
        tokens, ends = lattice(text, low, high)
        top = [0.0] * (len(tokens) + 1)
        back: list[tuple[int, str] | None] = [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            top[j] = top[j - 1]
            for i, look in ends.get(j, ()):
                for kind in ALL_KINDS:
                    if (s := top[i] + self.score(kind, look)) > top[j]:
                        top[j], back[j] = s, (i, kind)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
        return out[::-1]

    def learn(self, text: str, gold: set[Span], rate: float) -> float:
        """One step up the likelihood of the gold segmentation, by forward and backward sums over all segmentations."""
        tokens, ends = lattice(text, 0, len(text))
        n = len(tokens)
        segments = [(i, j, k, look, self.score(k, look)) for j in ends for i, look in ends[j] for k in ALL_KINDS]
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for s in segments:
            by_end.setdefault(s[1], []).append(s)
            by_start.setdefault(s[0], []).append(s)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[j - 1], *(ahead[s[0]] + s[4] for s in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = _log_sum([behind[i + 1], *(behind[s[1]] + s[4] for s in by_start.get(i, ()))])
        loss = ahead[n]
        for i, j, kind, look, score in segments:
            hit = (kind, tokens[i][0], tokens[j - 1][1]) in gold
            loss -= score if hit else 0.0
            pull = hit - math.exp(ahead[i] + score + behind[j] - ahead[n])
            if abs(pull) > 1e-4:
                for f in ("bias", *look):
                    w = self.weights.get((kind, f), -2.0 if f == "bias" else 0.0)
                    self.weights[kind, f] = w + rate * (pull - 1e-3 * w)
        return loss


def _log_sum(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


def _card_number(r: random.Random, size: int = 16, good: bool = True) -> str:
    head = "".join(r.choice("0123456789") for _ in range(size - 1))
    last = next(c for c in "0123456789" if luhn(head + c) == good)
    return head + last


def examples(n: int, seed: int = 5) -> Iterator[tuple[str, set[Span]]]:
    """Made-up stretches with their entities: one or two items of any kind, or of none, next to each other."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        x = _card_number(r, r.choice([16, 16, 16, 15, 19, 14]))
        return r.choice([x, x, " ".join(x[i : i + 4] for i in range(0, len(x), 4)), "-".join(x[i : i + 4] for i in range(0, len(x), 4))])

    def phone() -> str:
        return r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)}-{d(3)}-{d(7)}", f"+{d(2)}.{d(3)}.{d(3)}.{d(4)}"])

    def ip() -> str:
        return ".".join(str(r.randrange(256)) for _ in range(4))

    def email() -> str:
        name = r.choice(["ann", "j.doe", "info", "max_x"]) + r.choice(["", d(2)])
        return r.choice([f"{name}@mail{d(1)}.example.com", f"{name} (at) example (dot) org", f"{name}[at]example.net", f"{name} @ example.com"])

    def other() -> str:
        return r.choice([_card_number(r, 16, False), d(9), d(12), f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}.{d(3)}.{d(3)}", f"1{d(2)}.3{d(2)}.4{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", d(22), f"0.{d(8)}", f"{d(3)}-{d(4)}", f"20{d(2)} 20{d(2)} 20{d(2)}", f"{d(3)} {d(3)} {d(3)}", d(20) + " " + d(16)])

    makers = {"card": card, "phone": phone, "ip": ip, "email": email, "": other}
    for _ in range(n):
        text, gold = r.choice(["", "", "x "]), set()
        for k in range(r.choice([1, 1, 2, 2, 3])):
            kind = r.choice(["card", "phone", "ip", "", "", "email" if k == 0 else "card"])
            item = makers[kind]()
            if kind == "" and k and text[-2:-1].isdigit():
                text += "a "
            if kind:
                gold.add((kind, len(text), len(text) + len(item)))
            text += item + " "
            if kind == "":
                text += "b "
        yield text.rstrip(), gold


def secret_examples(n: int, seed: int = 6) -> Iterator[tuple[str, set[Span]]]:
    """Made-up long words: keys with and without a name in front, and names of files, versions and goods that are none."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, digits = "0123456789abcdef", "0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = ["report", "invoice", "holiday", "picture", "archive", "release", "summary", "backup"]

    def secret() -> str:
        return r.choice([pick(hexa, r.choice([16, 18, 24, 32, 40, 64])), pick(upper + digits, r.choice([20, 24, 32])), pick(upper + upper.lower() + digits, r.choice([20, 24, 32, 40])), pick(hexa.upper(), 40), pick(upper + "234567", r.choice([16, 20, 26, 32]))])

    def other() -> str:
        w = r.choice(words)
        return r.choice([f"{w}{pick(digits, 8)}", f"{w}{r.choice(words)}{pick(digits, 4)}", f"{w.capitalize()}{r.choice(words).capitalize()}{pick(digits, 2)}", f"{w}-{r.choice(words)}-{pick(digits, 4)}", f"{w}_{pick(digits, 8)}_{r.choice(words)}", f"{pick(digits, 8)}{w}{r.choice(words)}", f"{w}{pick(digits, 1)}{r.choice(words)}", f"{w}{pick(digits, 4)}{r.choice(words)}".upper(), f"{w}{r.choice(words)}{pick(digits, 2)}".upper()])

    for _ in range(n):
        text, gold = r.choice(["", "see ", "and the "]), set()
        if r.random() < 0.6:
            text += r.choice(["token = \"", "password=", "api_key: ", "secret ", "pwd:", "", "", "the ", "of ", "key="])
            item = secret()
            while not _mixed(item):
                item = secret()
            gold.add(("secret", len(text), len(text) + len(item)))
        else:
            text += r.choice(["", "the ", "file=", "name: ", "in "])
            item = other()
        text += item
        yield text + r.choice(["", "\" x", " of", "."]), gold


@lru_cache(maxsize=4)
def train(n: int = 500, rounds: int = 6) -> SemiMarkov:
    """A model of ``n`` made-up stretches of numbers and mail addresses and three times as many of long words; the same on every run."""
    model, data = SemiMarkov(), [*examples(n), *secret_examples(3 * n)]
    random.Random(1).shuffle(data)
    for k in range(rounds):
        for text, gold in data:
            model.learn(text, gold, 0.3 / (1 + k))
    return model


def find_spans(text: str | None, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the model's are added where they overlap none that is there already."""
    base = base_spans(text or "")
    if not text:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    free = lambda a, b: not any(x < b and a < y for x, y in taken[max(0, bisect.bisect_right(taken, (a, a)) - 4) : bisect.bisect_left(taken, (b, b))])  # noqa: E731  at most one span of each kind reaches over a place
    out = list(base)
    done = -1
    for low, high in sorted(regions(text, taken)):
        k = bisect.bisect_right(taken, (low, len(text))) - 1
        if k >= 0 and high <= taken[k][1]:
            continue
        for kind, a, b in model.best(text, low, high):
            if a >= done and free(a, b):
                out.append((kind, a, b))
                done = b
    return base, ordered(out)


def private_spans(docs: DataFrame, model: SemiMarkov | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, arrays of (kind, start, end) in code points; columns of these names are replaced.

    Whole texts, one after another within a task; nothing is shuffled. Regions are long only where a text is one long
    number, and the dynamic program is linear in them. Null and empty texts have no spans; repeated rows stay, with equal
    spans. Of segmentations with equal scores the one of fewer entities counts, of those the one found first from the
    left. An empty table gives an empty one; a model's span that overlaps a base span is left out.
    """
    model = model or train()
    fresh = ["base_spans", "spans"]
    keep = [c for c in docs.columns if c.lower() not in fresh]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, at = numbered_columns(docs, keep, text_col)
    span = "array<struct<kind:string,start:long,end:long>>"
    kinds = [f.dataType.simpleString() for f in plain.schema.fields[: len(keep)]] + [span, span]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t, shared.value) for t in batch.column(at).to_pylist()]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            columns = [pa.array([as_rows(f[k]) for f in found], arrow) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[f"c{i}" for i in range(len(keep) + 2)])

    return plain.mapInArrow(task, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*keep, *fresh)


def pii_digest(docs: DataFrame) -> DataFrame:
    """The spans of ``docs`` (doc_id, text) as text, base spans counted by kind; ``n_added`` counts what the model added, and
    ``n_secret`` its secrets. Rows as in ``private_spans``."""
    out = private_spans(docs.select("doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k, c="base_spans": F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    added = (F.size("spans") - F.size("base_spans")).cast("long")
    return out.select("doc_id", *counts, F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"), added.alias("n_added"), count("secret", "spans"), (F.size("spans") > 0).alias("private"))
