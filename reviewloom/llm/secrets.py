"""Secret scan: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick automaton over all keywords runs once through each text. Only
at its hits the expression of the keyword's kind is tried, anchored there. Runs
of hexadecimal digits have no keyword: every 12th character is probed, since a
run of 24 covers two neighbouring probes, and only there a run is measured.
Kinds that carry their own checksum are kept only if it holds.

Texts are scanned as UTF-8 bytes; all keywords and expressions are ASCII, so no
match starts or ends inside a character. Spans are given in code points.

Defined results: null and empty texts have no spans; a text of any length is
scanned whole; every row is scanned by itself, so ties and repeated rows give
equal results; other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewloom.llm.common import query, slices, table

# Keywords and expressions of the base kinds.
ASSIGN_KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS_KEYWORD = "akia"
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 24
HEX_STRIDE = HEX_LEAST // 2

# Kinds with a checksum, in the order in which ties are listed.
# A code host's token ends in the CRC-32 of its 30 random characters, in base 62.
HOST_TOKEN_KEYWORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
HOST_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# A signed web token starts with a JSON object that names its algorithm.
WEB_TOKEN_KEYWORD = "eyj"
WEB_TOKEN = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
KINDS = ["assign", "access", "hex", "host", "web"]

Span = tuple[int, int, str]


def _base62_crc(text: str) -> str:
    n, out = binascii.crc32(text.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def _host_token_ok(m: re.Match) -> bool:
    return _base62_crc(m.group(1)) == m.group(2)


def _web_token_ok(m: re.Match) -> bool:
    head = m.group(1)
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word in ASSIGN_KEYWORDS:
        auto.add_word(word, ("assign", len(word)))
    auto.add_word(ACCESS_KEYWORD, ("access", len(ACCESS_KEYWORD)))
    for word in HOST_TOKEN_KEYWORDS:
        auto.add_word(word, ("host", len(word)))
    auto.add_word(WEB_TOKEN_KEYWORD, ("web", len(WEB_TOKEN_KEYWORD)))
    auto.make_automaton()
    return auto


def _hex_runs(raw: str) -> Iterator[tuple[int, int]]:
    end = 0
    for probe in re.finditer(r"[0-9a-f]{2,}", raw[HEX_STRIDE - 1::HEX_STRIDE]):
        # One group of neighbouring probes may hold several runs.
        for k in range(probe.start(), probe.end()):
            at = HEX_STRIDE - 1 + k * HEX_STRIDE
            if at < end:
                continue
            start = at
            while start > end and raw[start - 1] in "0123456789abcdef":
                start -= 1
            end = HEX.match(raw, at).end()
            if end - start >= HEX_LEAST:
                yield start, end


def scan(text: str | None, auto: ahocorasick.Automaton) -> list[Span]:
    """Spans (start, end, kind) of one text, by start and then kind."""
    if not text:
        return []
    # One character per byte: positions of all expressions are byte positions.
    data = text.encode("utf-8", "surrogatepass")
    raw = data.decode("latin-1")
    found: list[Span] = []
    end = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in auto.iter(data.lower().decode("latin-1")):
        start = last - n + 1
        if start < end[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(raw, start)
            good = m is not None and len(m.group(2)) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(raw, start)
            good = m is not None and m.end() - start >= ACCESS_LEAST
        elif kind == "host":
            m = HOST_TOKEN.match(raw, start)
            good = m is not None and _host_token_ok(m)
        else:
            m = WEB_TOKEN.match(raw, start)
            good = m is not None and _web_token_ok(m)
        if m is not None:
            end[kind] = m.end()
            if good:
                found.append((start, m.end(), kind))
    found += [(a, b, "hex") for a, b in _hex_runs(raw)]
    if len(data) != len(text):
        point = _points(data, sorted({p for a, b, _ in found for p in (a, b)}))
        found = [(point[a], point[b], kind) for a, b, kind in found]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _points(data: bytes, at: list[int]) -> dict[int, int]:
    """Code points before each of the sorted byte positions."""
    out, last, n = {}, 0, 0
    for p in at:
        n += len(data[last:p].decode("utf-8", "surrogatepass"))
        out[p], last = n, p
    return out


def find_secrets(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and `found`, an array of (kind, start, end, value)."""
    item = "struct<kind:string,start:int,end:int,value:string>"
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                    ("value", pa.string())]))

    def run(batches):
        auto = automaton()
        for batch in slices(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                rows.append([{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in scan(t, auto)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, kind_type)], names=["row_id", "found"])

    slim = docs.selectExpr(f"`{row_id}` AS row_id", f"`{text}` AS text")
    kind = slim.schema["row_id"].dataType.simpleString()
    return (slim.mapInArrow(run, f"row_id {kind}, found array<{item}>")
            .withColumnRenamed("row_id", row_id))


BASE = KINDS[:3]


@query("op5_secrets")
def op5_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    line = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    base = "filter(found, s -> s.kind IN ('assign', 'access', 'hex'))"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(found, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE],
        f"sha2({line.format(base)}, 256) AS base_sha256", f"{line.format('found')} AS spans")
