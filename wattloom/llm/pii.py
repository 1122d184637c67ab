"""Personal data: exact base patterns, and a linear-chain CRF that adds what the patterns miss.

The CRF tags the white-space tokens around anything with a digit, an at sign or a spelled-out `[at]`
or `dot`, from word-shape features of the token and its neighbours.  It is trained by gradient on the
likelihood of a small labelled table (below: the templates of written-out data and of look-alikes)
and decoded by Viterbi over numpy batches.  A tagged run counts only if its characters make a valid
value of its kind, and never displaces a base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, whole_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BASE = {k: re.compile(p) for k, p in PATTERNS.items()}
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*")

#: The labelled table: lines whose marked parts are data of a kind; # stands for a digit to fill in.
LABELLED = """
mail <email>jo.smith [at] example [dot] org</email> for the rest
reach me under <email>anna (at) firma.de</email> or later
<email>k.lee at mail dot example dot com</email> is the address
contact <email>info[at]shop.example.com</email> today.
our desk <email>sales (at) shop (dot) net</email> answers
write <email>first.last at corp dot com</email> soon
call <phone>(###) ###-####</phone> after six
my number is <phone>###-###-####</phone> now
phone <phone>0## ### ## ## ##</phone> or come by
tel. <phone>0#### / ######</phone> in the office
fax <phone>(0##) ####-####</phone> and sign
ring <phone>###.###.####</phone> please
card <card>4###/####/####/####</card> was charged
paid by <card>5###.####.####.####</card> on friday
number <card>4### . #### . #### . ####</card> expires
host <ip>##[.]#[.]##[.]###</ip> was seen
from <ip>##(.)##(.)#(.)##</ip> at night
the block <ip>1## . ## . # . ##</ip> is closed
version 2.0. of the license
released under 4.0. and later
token = "##a#b##c#d##e#f#" was set
password=##ab##cd##ef here
key AK##X##Y##Z in the log
on 20##-##-## the team met
chapter # of ## and page ###
about ## percent of ### rows
room ### at the end of hall #
it costs #,### or ##.## each
at the dot of ten they met at home
a dot and a line at the top
order ###### was sent at ##:##
ids ##-## and ## follow
score #.## then #.## at last
years 19## to 20## in all
line ### | ## | ### | ##
"""


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """Whether a match of the base pattern passes the kind's own check."""
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (n.lstrip("0") for n in text.split(".")))
    if kind in ("card", "phone"):
        digits = "".join(_DIGIT.findall(text))
        return 14 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 10 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: from each at sign back over the local part, so that a long run
    without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip pattern: four numbers at a time of each chain of numbers and dots."""
    for m in _CHAIN.finditer(text):
        numbers = m.group().split(".")
        at = m.start()
        for i in range(0, len(numbers) - 3, 4):
            size = sum(map(len, numbers[i : i + 4])) + 3
            yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start, then kind, in time linear in the text.  Card
    and phone matches begin at the first digit of a run and at a plus sign, which no run holds twice."""
    found = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(a, b, "ip") for a, b in _ips(text)]
        found += [(m.start(), m.end(), k) for k in ("card", "phone") if k == "card" or "+" in text for m in _BASE[k].finditer(text)]
    return sorted((s for s in found if valid(s[2], text[s[0] : s[1]])), key=lambda s: (s[0], KINDS.index(s[2])))


def written(kind: str, text: str) -> bool:
    """Whether a written-out value, brought to its plain form, is one of its kind."""
    text = " ".join(text.split())
    if kind == "email":
        plain = re.sub(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s", "@", text, flags=re.I)
        plain = re.sub(r"\s?[\[({<]\s?(dot|\.)\s?[\])}>]\s?|\sdot\s", ".", plain, flags=re.I)
        return plain != text and [*_emails(plain)] == [(0, len(plain))]
    if kind == "ip":
        plain = re.sub(r"\s?[\[({]\s?(\.|dot)\s?[\])}]\s?|\s\.\s", ".", text)
        return plain != text and [*_ips(plain)] == [(0, len(plain))] and valid("ip", plain)
    digits = "".join(_DIGIT.findall(text))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]{4}(\s?[./]\s?[0-9]{4}){2,3}", text)) and valid("card", text)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"\(?0?[0-9]{1,5}\)?([ ./-]{1,3}[0-9]{2,6}){1,5}", text)) and not _DATE.fullmatch(text)


# ---- the chain -------------------------------------------------------------------------------

TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_TOKEN = re.compile(r"\S+")
_CUE = re.compile(r"[0-9@]|[\[({]\s*(?:at|dot|\.)\s*[\])}]|\bdot\b", re.I)
_RUNS = [(re.compile("[A-Z]+"), "X"), (re.compile("[a-z]+"), "x"), (re.compile("[0-9]+"), "9"), (re.compile(r"[^\x00-\x7f]+"), "u")]
#: A part goes on only after its own beginning.
BARRED = np.array([[-1e4 if b and b % 2 == 0 and (a + 1) // 2 != b // 2 else 0.0 for b in range(len(TAGS))] for a in range(len(TAGS))])
REACH = 5
DECODED = 200_000


def shape(token: str) -> str:
    s = token.replace("X", "A").replace("x", "a").replace("9", "0")
    for run, mark in _RUNS:
        s = run.sub(mark, s)
    return s


def features(tokens: list[str]) -> list[list[str]]:
    shapes = [shape(t) for t in tokens]
    low = [t.lower().strip(".,;:!?\"'") for t in tokens]
    digits = [min(sum(map(str.isdigit, t)), 9) for t in tokens]
    at = lambda a, i: a[i] if 0 <= i < len(a) else "^"
    return [
        [f"s={shapes[i]}", f"l={at(shapes, i - 1)}", f"r={at(shapes, i + 1)}", f"ls={at(shapes, i - 1)},{shapes[i]}", f"sr={shapes[i]},{at(shapes, i + 1)}", f"w={low[i]}", f"lw={at(low, i - 1)}", f"rw={at(low, i + 1)}", f"d={digits[i]}", "b"]
        for i in range(len(tokens))
    ]


@dataclass
class Chain:
    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def scores(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores, padded, and lengths."""
        size = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), size.max(initial=1), len(TAGS)))
        for i, s in enumerate(sequences):
            for j, names in enumerate(features(s)):
                out[i, j] = self.emit[[self.index[n] for n in names if n in self.index]].sum(axis=0)
        return out, size

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each sequence: Viterbi over all sequences at once."""
        e, size = self.scores(sequences)
        n, longest, k = e.shape
        best, back = self.first + e[:, 0], np.zeros((n, longest, k), np.int8)
        final = best.copy()
        for t in range(1, longest):
            s = best[:, :, None] + self.move
            back[:, t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, t]
            final = np.where((size > t)[:, None], best, final)
        tags = np.zeros((n, longest), np.int64)
        now = final.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            live = size > t
            tags[live, t] = now[live]
            if t:
                now = np.where(live, back[np.arange(n), t, now], now)
        return [tags[i, :m] for i, m in enumerate(size)]


def labelled_table(copies: int = 12, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """The table's lines with digits filled in, as tokens and tags: once as they stand, then with other
    names inside the addresses and other words, numbers or nothing around the marked parts."""
    rng, out, around = np.random.default_rng(seed), [], []
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def name() -> str:
        return "".join(rng.choice(letters, rng.integers(2, 9)))

    def other(word: str) -> str:
        kind = rng.integers(0, 4)
        return (word, str(rng.integers(0, 10 ** int(rng.integers(1, 7)))), name(), str(rng.choice(around or [word])))[kind]

    for copy in range(copies):
        for line in LABELLED.strip().splitlines():
            line = re.sub("#", lambda m: str(rng.integers(1, 10)), line)
            tokens, tags, kind, begun = [], [], None, False
            for piece in re.split(r"(</?[a-z]+>)", line):
                if piece.startswith("<"):
                    kind, begun = (None if piece[1] == "/" else piece[1:-1]), False
                    continue
                for word in piece.split():
                    if copy and kind == "email" and word.isalpha() and word not in ("at", "dot", "mail", "com", "org", "de", "net"):
                        word = name()
                    if kind is None and not copy:
                        around.append(word)
                    elif kind is None and "<" in line:
                        word = other(word)
                    tokens.append(word)
                    tags.append(TAGS.index(f"{'I' if begun else 'B'}-{kind}") if kind else 0)
                    begun = kind is not None
            lead = int(rng.integers(0, 3)) if copy and tags[0] == 0 and "<" in line else 0
            while lead and tags[0] == 0 and len(tags) > 1:
                tokens, tags, lead = tokens[1:], tags[1:], lead - 1
            out.append((tokens, tags))
    return out


def train_chain(rows: list[tuple[list[str], list[int]]], steps: int = 120, ridge: float = 1e-3) -> Chain:
    """Adam on the mean conditional log-likelihood; forward-backward over all lines at once."""
    index = {n: i for i, n in enumerate(sorted({n for tokens, _ in rows for names in features(tokens) for n in names}))}
    k, n, longest = len(TAGS), len(rows), max(len(t) for t, _ in rows)
    size = np.array([len(t) for t, _ in rows])
    width = len(features(["a"])[0])
    ids, gold = np.full((n, longest, width), len(index)), np.zeros((n, longest), int)
    for i, (tokens, tags) in enumerate(rows):
        ids[i, : size[i]] = [[index[f] for f in names] for names in features(tokens)]
        gold[i, : size[i]] = tags
    live = np.arange(longest) < size[:, None]
    w = [np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    lse = lambda a, axis: np.log(np.exp(a - (t := a.max(axis=axis, keepdims=True))).sum(axis=axis)) + t.squeeze(axis)
    one = np.eye(k)
    for step in range(1, steps + 1):
        e = w[0][ids].sum(axis=2)
        move, start = w[1] + BARRED, w[2] + BARRED[0]
        f, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        f[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            f[:, t] = np.where(live[:, t, None], lse(f[:, t - 1, :, None] + move, 1) + e[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], lse(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        diff = (one[gold] * live[:, :, None] - p) / n
        g_emit = np.zeros_like(w[0])
        np.add.at(g_emit, ids, diff[:, :, None, :])
        g_emit[-1] = 0
        g_move = np.zeros((k, k))
        for t in range(1, longest):
            q = np.exp(f[:, t - 1, :, None] + move + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]) * live[:, t, None, None]
            g_move += (one[gold[:, t - 1]][:, :, None] * one[gold[:, t]][:, None, :] * live[:, t, None, None] - q).sum(axis=0) / n
        for i, g in enumerate((g_emit, g_move, diff[:, 0].sum(axis=0))):
            g = g - ridge * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w[i] = w[i] + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Chain(index, w[0][:-1], w[1] + BARRED, w[2] + BARRED[0])


def _regions(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets around the cues: REACH tokens on either side, joined where they meet."""
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([a for a, _ in tokens])
    hit = np.unique(np.searchsorted(starts, cues, "right") - 1)
    near = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(near, np.maximum(hit - REACH, 0), 1)
    np.add.at(near, np.minimum(hit + REACH + 1, len(tokens)), -1)
    at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return [[tokens[i] for i in run] for run in np.split(at, cut) if len(run)]


def _by_length(regions: list[tuple[int, list[tuple[int, int]]]]) -> Iterator[list[tuple[int, list[tuple[int, int]]]]]:
    """Whole regions, shortest first, in lists of at most DECODED tokens with the padding; a longer
    region is a list of its own."""
    part: list[tuple[int, list[tuple[int, int]]]] = []
    for region in sorted(regions, key=lambda r: len(r[1])):
        if part and (len(part) + 1) * len(region[1]) > DECODED:
            yield part
            part = []
        part.append(region)
    if part:
        yield part


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and (text[b - 1] in ".,;:!?\"'>" or text[b - 1] == ")" and text.count("(", a, b) < text.count(")", a, b)):
        b -= 1
    while a < b and text[a] in "\"'<,;:":
        a += 1
    return a, b


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The runs that spans in the order of their starts cover."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def added_spans(texts: list[str], bases: list[list[tuple[int, int, str]]], chain: Chain) -> list[list[tuple[int, int, str]]]:
    """Spans of the chain that are valid written-out values and touch no base span.  Regions share no
    token, so the added spans never touch each other."""
    where = [(i, region) for i, text in enumerate(texts) for region in _regions(text)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    taken = [_merged(spans) for spans in bases]
    for part in _by_length(where):
        tagged = chain.decode([[texts[i][a:b] for a, b in region] for i, region in part])
        for (i, region), tags in zip(part, tagged):
            j = 0
            while j < len(tags):
                kind, stop = int(tags[j] + 1) // 2, j + 1
                if kind:
                    while stop < len(tags) and tags[stop] == 2 * kind:
                        stop += 1
                    a, b = _trimmed(texts[i], region[j][0], region[stop - 1][1])
                    before = bisect_left(taken[i], b, key=lambda s: s[0]) - 1  # the last base run that begins before b
                    free = before < 0 or taken[i][before][1] <= a
                    if free and written(KINDS[kind - 1], texts[i][a:b]):
                        out[i].append((a, b, KINDS[kind - 1]))
                j = stop
    return out


def find_spans(texts: list[str], chain: Chain) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    bases = [base_spans(t) for t in texts]
    added = added_spans(texts, bases, chain)
    return [(b, sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2])))) for b, a in zip(bases, added)]


def _written_down(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _parts(column: pa.Array, limit: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in lists of about `limit` characters."""
    part, size, first = [], 0, 0
    for i, x in enumerate(column):
        text = x.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= limit:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans, of every whole text.

    Null and empty texts have no spans; repeated or null ids give a row each; offsets are code
    points; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(train_chain(labelled_table()))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = []
            for _, texts in _parts(batch.column(1)):
                for base, spans in find_spans(texts, shared.value):
                    n = [sum(k == kind for _, _, k in base) for kind in KINDS]
                    out.append((*n, hashlib.sha256(_written_down(base).encode()).hexdigest(), _written_down(spans), len(spans) - len(base), len(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first, as [KIND]."""
    out, at, until = [], 0, 0
    for a, b, kind in spans:
        if a >= until:
            out += [text[at:a], f"[{kind.upper()}]"]
        until = at = max(until, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of its texts replaced and n_chars, where there is one, counted again; a
    null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(train_chain(labelled_table()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            at = batch.schema.get_field_index("text")
            new = [redacted(t, spans) for _, texts in _parts(batch.column(at)) for t, (_, spans) in zip(texts, find_spans(texts, shared.value))]
            valid_rows = batch.column(at).is_valid().to_pylist()
            text = pa.array([t if ok else None for t, ok in zip(new, valid_rows)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
