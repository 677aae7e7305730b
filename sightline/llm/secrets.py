"""Secret scans: patterns, and character Markov models of random strings.

Three patterns give the base spans. The method adds spans: every run of
characters that may stand in a key, less what base spans cover of it, is scored
by two character Markov models, one of random strings and one of ordinary
identifiers, trained from a labelled sample. A run whose log-likelihood ratio
favours random strings by enough is a span of kind ``markov``; else its best
stretch is, if that does, in whole tokens, and the rest is scored again. Random strings of under
``SHORTEST`` characters, or under ``LEAST`` without digits, cannot be told from
words and are not found.

A row is scanned by itself, in Arrow batches; nothing is shuffled.

Cases. Null or empty text: no spans. Offsets are code points, ends exclusive.
Null ids are passed on; repeated rows are scanned each; empty tables give empty
results. Very long texts are scanned whole, in time linear in their runs and
spans (runs beyond ``PART`` characters are judged in parts, which are joined). A
column of ``keep`` must not be named like a result; other columns never clash.
Random names that are no secrets, such as UUIDs, are marked too: nothing in
their characters tells them apart.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table
from .resident import lean, parts

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A shortest run or stretch of one that is scored, and the least ratio in nats, in all and a character.
LEAST, RATIO, RATIO_EACH = 20, 12.0, 0.4
#: Shorter stretches, down to this, count if they have letters and digits: fewer letters alone are often a word.
SHORTEST = 8
#: Characters of a run that are judged together, so that time stays linear in very long runs.
PART = 1 << 14
#: What ends a token within a run.
SEPARATORS = "/=-_"
# an equals sign ends a run, as a name's or as padding
_RUN = re.compile(rf"(?:[A-Za-z0-9+/_-]{{{LEAST},}}|(?=[A-Za-z+/_-]{{0,{LEAST - 2}}}[0-9])[A-Za-z0-9+/_-]{{{SHORTEST},{LEAST - 1}}})={{0,2}}")
_MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")

# Fixed words of which the ordinary identifiers of the training sample are made.
WORDS = """account active agent amount archive article average banner batch border bridge buffer button calendar cancel center
chapter chart client column comment common compile component config constant content control counter create customer
default delivery design device direction discount distance domain driver element employee engine environment estimate
example execute expression feature filter folder format function general graph handler height horizontal image index
initial instance interface invoice journal label latest length library listener manager master matrix measure memory
method mobile module morning movement network number operation order origin package parameter partition pattern
performance person platform position price priority product program property provider purchase quantity question
reason reference register release remote report resource result scanner school search security sequence service
setting signature software standard status strategy string student subject support switch table template terminal
thread timeout toolbar transaction transform transport tutorial university upload validation variable vehicle vertical
visible warning website width workflow writing""".split()
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(CHARS), np.int64)
_CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))


def labelled_sample(n: int = 6000) -> list[tuple[str, int]]:
    """Strings and labels (1: random), made by rule, the same every time."""
    out = []
    for i in range(n):
        d = hashlib.sha512(f"sample-{i}".encode()).digest()
        size = 20 + d[0] % 30
        out.append(((d.hex(), base64.b64encode(d).decode(), base64.urlsafe_b64encode(d).decode(), base64.b32encode(d).decode(), base64.b64encode(d).decode().replace("+", "a").replace("/", "Q"))[i % 5][:size], 1))
        w = [WORDS[int.from_bytes(d[2 * j:2 * j + 2], "big") % len(WORDS)] for j in range(2 + d[1] % 4)]
        style = i % 7
        s = ("_".join(w), "-".join(w), "".join(x.title() for x in w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper(), "/".join(w), "".join(w))[style]
        out.append((s + str(d[60] % 100) * (d[61] % 4 == 0), 0))
    return out


def train(sample: list[tuple[str, int]], smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratios of characters given the one before (row; last row and column: start, other)."""
    n = np.full((2, len(CHARS) + 1, len(CHARS) + 1), smooth)
    for s, y in sample:
        c = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(n[y], (np.append(len(CHARS), c[:-1]), c), 1)
    p = np.log(n / n.sum(axis=2, keepdims=True))
    return p[1] - p[0]


_RATIOS: list[np.ndarray] = []


def ratios(s: str) -> np.ndarray:
    """How much each character of a string speaks for the random model, in nats."""
    if not _RATIOS:
        _RATIOS.append(train(labelled_sample()))
    c = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
    return _RATIOS[0][np.append(len(CHARS), c[:-1]), c]


def ratio(s: str) -> float:
    """How much a string speaks for the random model, in nats."""
    return float(ratios(s).sum())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def _free(start: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the covered stretches (disjoint, in order, all ending after the start) leave of a run."""
    out = []
    for a, z in covered:
        if a >= end:
            break
        if start < a:
            out.append((start, a))
        start = z
    return [*out, (start, end)] if start < end else out


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans in order of their starts as disjoint stretches."""
    out: list[tuple[int, int]] = []
    for a, _, z in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def _random(s: str) -> bool:
    if len(s) < SHORTEST or len(s) < LEAST and not _MIXED.search(s):
        return False
    r = ratio(s)
    return r >= RATIO and r >= RATIO_EACH * len(s)


def _to_tokens(s: str, start: int, end: int) -> tuple[int, int]:
    """A stretch with the tokens at its ends whole: those more than half in it; others go."""
    before = max(s.rfind(x, 0, start) for x in SEPARATORS) + 1
    after = min((i for x in SEPARATORS if (i := s.find(x, end)) >= 0), default=len(s))
    cut = [before - 1, *(i for i in range(before, after) if s[i] in SEPARATORS), after]
    whole = [(a + 1, z) for a, z in zip(cut[:-1], cut[1:], strict=True) if 2 * (min(z, end) - max(a + 1, start)) > z - a - 1]
    a, z = (whole[0][0], whole[-1][1]) if whole else (start, end)
    return (a, z) if _random(s[a:z]) else (start, end)


def stretches(run: str) -> list[tuple[int, int]]:
    """Where a run is random: all of it, or its best stretch, and what lies beside that. Runs over ``PART`` are taken in parts."""
    out, left = [], [(a, min(a + PART, len(run))) for a in range(0, len(run), PART)]
    while left:
        a, z = left.pop()
        s = run[a:z]
        if _random(s):
            out.append((a, z))
        elif len(s) >= SHORTEST:
            sums = np.append(0.0, np.cumsum(ratios(s) - RATIO_EACH))
            end = int((sums - np.minimum.accumulate(sums)).argmax())
            start = int(sums[:end + 1].argmin())
            if _random(s[start:end]):
                start, end = _to_tokens(s, start, end)
                out.append((a + start, a + end))
                left += [(a, a + start), (a + end, z)]
    # parts of one random run are one stretch
    joined: list[tuple[int, int]] = []
    for a, z in sorted(out):
        if joined and a == joined[-1][1] and a % PART == 0:
            joined[-1] = joined[-1][0], z
        else:
            joined.append((a, z))
    return joined


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the models find."""
    out, covered, at = [], _union(base), 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        last = at
        while last < len(covered) and covered[last][0] < end:
            last += 1
        for s, e in _free(start, end, covered[at:last]):
            out += [(s + a, 3, s + z) for a, z in stretches(text[s:e])]
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans) -> str:
    """The text with each secret replaced by its kind; overlapping spans are one."""
    out, at = [], 0
    for s, k, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """``keep``, counts by kind, ``base_sha256``, ``spans``, and if ``redacted`` the text without its secrets (null stays null)."""
    ship(docs.sparkSession)
    d = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("__text"))
    new = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")] + [("redacted", "string")] * redacted
    names, kinds = [*keep, *(n for n, _ in new)], {"long": pa.int64(), "string": pa.string()}

    @lean()
    def run(batches):
        for b in parts(batches):
            rows = []
            for x in b.column(b.num_columns - 1):
                t = x.as_py() or ""
                base = base_spans(t)
                spans = sorted(base + added_spans(t, base))
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append([*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), *[redact(t, spans) if x.is_valid else None] * redacted])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(new)
            yield pa.record_batch([*b.columns[:-1], *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, new, strict=True))], names=names)

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]]
    return d.mapInArrow(run, ", ".join([*types, *(f"`{n}` {k}" for n, k in new)]))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the secrets of every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
