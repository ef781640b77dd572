"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

Ordinary words cost a byte-level vocabulary few tokens; random strings cost
nearly a token for every character or two. A run of 20 or more key characters,
or what the fixed patterns' spans leave of it, is reported as `random` when it has
fewer than RATIO characters a token, unless it is a digest of a known length, a
UUID, a number, or an identifier: parts between separators that are plain words,
capitalised words or short numbers. A part of 20 or more letters in one case is
such a word only if it has RATIO characters a token itself, else it is reported.

Every span is in code points, end exclusive, over the whole text.

Defined results: a null text is empty and has no spans; texts and runs of any
length are scanned whole, in time in proportion to them; spans that start
together stand in the order of KINDS; repeated rows are scanned alike, one by
one; an empty table gives an empty result; `redact` keeps
all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from phonolake.llm import tokens
from phonolake.llm.common import column, ship, table

#: Kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every access and hex match lies inside one such run, so one scan finds all three.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Parts of identifiers that look like one word, but need not be.
LETTERS = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]{20,}|[A-Z]{20,})(?![A-Za-z0-9])")
#: Characters a token below which a run counts as random.
RATIO = 2.0
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512. Fixed values.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-fA-F]+|sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORDS_ONLY = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def known(s: str) -> bool:
    """Whether s is a digest of a known length, a UUID, a number or an identifier."""
    if s.isdigit() or UUID.fullmatch(s):
        return True
    if DIGEST.fullmatch(s) and (s.startswith("sha") or len(s) in DIGEST_LENGTHS):
        return True
    parts = [p for p in re.split(r"[-_/=+]+", s) if p]
    return all(WORDS_ONLY.fullmatch(p) or _camel(p) for p in parts)


def _camel(part: str) -> bool:
    """Words run together: pieces of four letters on average, and a number only at the end."""
    pieces = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", part)
    letters = [p for p in pieces if not p.isdigit()]
    return bool(letters) and sum(map(len, letters)) >= 4 * len(letters) and not any(p.isdigit() for p in pieces[:-1])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if "=" in text or ":" in text else []
    for run in RUN.finditer(text):
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text, run.start(), run.end())]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def left_over(start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the base spans, in order of start, leave of start .. end."""
    out = []
    for a, b, _ in base:
        if start < a:
            out.append((start, min(a, end)))
        start = max(start, b)
        if start >= end:
            break
    return [*out, (start, end)] if start < end else out


def random_spans(text: str, base: list[tuple[int, int, str]], vocabulary: str) -> list[tuple[int, int, str]]:
    found, at = [], 0
    held: list[tuple[int, int, str]] = []
    dense = lambda a, b: b - a < RATIO * len(tokens.byte_bpe(vocabulary).encode_ordinary(text[a:b]))
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():  # base is in order of start, so is the scan
            held.append(base[at])
            at += 1
        held = [s for s in held if s[1] > m.start()]
        whole = known(m[0])
        for a, b in left_over(m.start(), m.end(), held):
            if b - a < 20:
                continue
            if whole or known(text[a:b]):
                found += [(w.start(), w.end(), "random") for w in LETTERS.finditer(text, a, b) if dense(w.start(), w.end())]
            elif dense(a, b):
                found.append((a, b, "random"))
    return found


def spans(text: str | None, vocabulary: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans; both by start, then kind."""
    base = base_spans(text or "")
    return base, sorted(base + random_spans(text or "", base, vocabulary), key=lambda s: (s[0], KINDS.index(s[2])))


def listed(found: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """For each row: key, counts by kind, base_sha256, and spans as kind:start:end."""
    ship(docs.sparkSession)
    slim = docs.select(column(docs, key).alias("key"), column(docs, text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [spans(t.as_py(), vocabulary) for t in batch.column(1)]
            count = lambda k: pa.array([sum(s[2] == k for s in every) for _, every in made], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[count(k) for k in KINDS], pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in made], pa.string()), pa.array([listed(e) for _, e in made], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return slim.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", vocabulary: str = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """docs with every span of its texts replaced by the mark; overlapping spans are one."""
    ship(docs.sparkSession)

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for a, b, _ in spans(t, vocabulary)[1]:
            if b <= at:
                continue
            if a >= at:
                out += [t[at:a], mark]
            at = b
        return "".join([*out, t[at:]])

    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([clean(t.as_py()) for t in batch.column(place)], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
