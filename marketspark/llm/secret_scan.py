"""Secrets in text: fixed patterns, and a battery of randomness tests for other tokens.

Patterns give the base spans. Any other run of 20 or more token characters with letters
and digits is a candidate. Its encoding is the smallest alphabet that covers it; a
chi-squared test of uniform symbols, a runs test and a serial-correlation test each give
a probability under "random", combined by Fisher's method. Written words pass such tests
the more often the shorter they are, so long letter-only tokens of the same corpus serve
as decoys: per length class, candidates are accepted down to the probability at which
the estimated false discovery rate ``(decoys + 1) / candidates`` stays within ``FDR``.
All tokens of all texts enter the counts, which merge per task.

Defined cases: a null text is empty and has no spans (hash of the empty string). Spans
are in code points with exclusive ends. Repeated rows give equal rows, null ids stay.
An empty table gives no rows; without candidates nothing is added.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.llm.text import map_batches
from marketspark.session import stage

# Fixed patterns.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGITS, UPPER, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from small to large, each in the order of its symbols' values.
ENCODINGS = (
    ("hex", DIGITS + LETTERS[:6]), ("hex_upper", DIGITS + UPPER[:6]), ("base32", UPPER + "234567"), ("base36", DIGITS + LETTERS),
    ("base36_upper", DIGITS + UPPER), ("base62", DIGITS + UPPER + LETTERS), ("base64", UPPER + LETTERS + DIGITS + "+/"),
    ("base64url", UPPER + LETTERS + DIGITS + "-_"), ("any", DIGITS + UPPER + LETTERS + "+/-_="),
)
RANKS = [{c: i for i, c in enumerate(symbols)} for _, symbols in ENCODINGS]
LENGTHS = (20, 24, 32, 48, 96)
FDR = 0.05
STEPS = 24  # half decades of probability

SPANS = "array<struct<start:int,kind:int,stop:int>>"
TOKENS = "array<struct<start:int,stop:int,length_class:int,step:int,decoy:boolean>>"


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, freedom: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    v = 2 / (9 * freedom)
    return 0.5 * math.erfc((((x / freedom) ** (1 / 3)) - (1 - v)) / math.sqrt(v) / math.sqrt(2))


def random_probability(token: str) -> float:
    """Combined probability of the three tests if the token were uniform over its inferred alphabet."""
    body = token.rstrip("=") or token
    ranks = next((r for r in RANKS if all(c in r for c in body)), RANKS[-1])
    values, n, size = [ranks[c] for c in body], len(body), len(ranks)
    bins = max(2, min(size, n // 5))
    counts, widths = [0] * bins, [0] * bins
    for v in range(size):
        widths[v * bins // size] += 1
    for v in values:
        counts[v * bins // size] += 1
    uniform = _chi_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths)), bins - 1)

    high = [v * 2 >= size for v in values]
    up, down = sum(high), n - sum(high)
    if up and down:
        runs, mean = 1 + sum(a != b for a, b in pairwise(high)), 2 * up * down / n + 1
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs_p = _two_sided((runs - mean) / spread)
    else:
        runs_p = 1e-12

    mean = sum(values) / n
    power = sum((v - mean) ** 2 for v in values)
    if power:
        serial = sum((a - mean) * (b - mean) for a, b in pairwise(values)) / power
        serial_p = _two_sided((serial + 1 / n) * math.sqrt(n))
    else:
        serial_p = 1e-12
    half = -sum(math.log(max(p, 1e-12)) for p in (uniform, runs_p, serial_p))
    return math.exp(-half) * (1 + half + half * half / 2)  # chi-squared tail with six degrees of freedom


def _step(p: float) -> int:
    return min(STEPS, int(-2 * math.log10(max(p, 1e-12))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, length class, step, decoy) of long tokens outside the base spans; letter-only ones are decoys."""
    found, at = [], 0
    for m in TOKEN.finditer(text):
        token = m[0]
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if any(b[0] < m.end() for b in base[at:at + 1]):
            continue
        letters, digits = any(c.isalpha() for c in token), any(c.isdigit() for c in token)
        if letters:
            length_class = sum(len(token) >= x for x in LENGTHS)
            found.append((m.start(), m.end(), length_class, _step(random_probability(token)), not digits))
    return found


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("base", "tokens")) -> DataFrame:
    """Columns ``keep`` followed by the base spans and the tested tokens of every whole text."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_scanned"))
    out = T.StructType(source.schema.fields[:-1] + [T.StructField(names[0], T._parse_datatype_string(SPANS)), T.StructField(names[1], T._parse_datatype_string(TOKENS))])

    def step(batch):
        spans, tested = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            base = base_spans(text or "")
            spans.append([{"start": a, "kind": k, "stop": b} for a, k, b in base])
            tested.append([{"start": a, "stop": b, "length_class": c, "step": s, "decoy": d} for a, b, c, s, d in tokens(text or "", base)])
        return [*batch.columns[:-1], spans, tested]

    return map_batches(source, out, step)


def accepted_steps(scanned: DataFrame, column: str = "tokens", rate: float = FDR) -> dict[int, int]:
    """Largest accepted step per length class; counts over all tokens, at most one row per class and step comes back."""
    counts = (
        scanned.select(F.inline(F.col(column)))
        .groupBy("length_class", "step")
        .agg(F.count_if("decoy").alias("decoys"), F.count_if(~F.col("decoy")).alias("candidates"))
        .collect()
    )
    cuts = {}
    for c in {r.length_class for r in counts}:
        decoys = candidates = 0
        for r in sorted((r for r in counts if r.length_class == c), key=lambda r: r.step):
            decoys, candidates = decoys + r.decoys, candidates + r.candidates
            if candidates and (decoys + 1) / candidates <= rate:
                cuts[c] = r.step
    return cuts


def added_spans(column: Column, cuts: dict[int, int]) -> Column:
    """Accepted candidates of a tokens column, as spans of the last kind."""
    def accepted(token: Column) -> Column:
        chosen = F.lit(False)
        for length_class, step in sorted(cuts.items()):
            chosen = chosen | ((token["length_class"] == length_class) & (token["step"] <= step))
        return chosen & ~token["decoy"]

    return F.transform(F.filter(column, accepted), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    scanned = stage(scan(docs, [id_col], text_col))
    every = F.sort_array(F.concat(F.col("base"), added_spans(F.col("tokens"), accepted_steps(scanned, rate=rate))))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return scanned.select(id_col, number(0), number(1), number(2), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(every).alias("spans"))


def redact(text: str | None, cuts: dict[int, int], mark: str = "[SECRET]") -> str | None:
    """``text`` with every base span and accepted token replaced by ``mark``; overlapping spans become one."""
    if not text:
        return text
    base = base_spans(text)
    spans = [(a, b) for a, _, b in base] + [(a, b) for a, b, c, s, decoy in tokens(text, base) if not decoy and s <= cuts.get(c, -1)]
    if not spans:
        return text
    out, at = [], 0
    for start, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, rate: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """All documents with their secrets replaced by ``mark``; ``n_chars`` follows where a text changed.

    Thresholds come from a first scan of all texts; the second changes row by row, so no text is shuffled.
    """
    cuts = accepted_steps(scan(docs.select("text"), [], "text"), rate=rate)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def step(batch):
        columns, texts = list(batch.columns), batch.column(at).to_pylist()
        columns[at] = [redact(t, cuts, mark) for t in texts]
        if length is not None:
            columns[length] = [n if a == b else len(b) for n, a, b in zip(batch.column(length).to_pylist(), texts, columns[at])]
        return columns

    return map_batches(docs, docs.schema, step)
