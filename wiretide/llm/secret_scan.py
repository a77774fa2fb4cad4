"""Secrets in texts: fixed patterns, and long strings that dictionary-primed zstandard can't shorten.

A candidate of the method is a run of 16 or more token characters with a letter and a digit, at most 64 characters
after a sensitive word, that no pattern has found.  Its novelty is the number of bytes that it adds to the compressed
surroundings, with a dictionary of the corpus's words and of common identifiers: what the context or the dictionary has costs next to nothing,
a random key costs most of its entropy.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs [0-9a-f]+ that are long enough
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]")
KINDS = ("assign", "access", "hex", "novel")
#: Words that make their surroundings sensitive, in lower case.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private key", "bearer", "auth", "signature", "access key")
NEAR = 64
AROUND = 512
LEVEL = 3
#: The dictionary's identifiers.
IDENTIFIERS = (
    "public static void return class function import from export const let var def self this null None true false "
    "string integer boolean float double array object list map set key value index name type size length count "
    "request response header content-type application/json authorization bearer token access_token refresh_token "
    "client_id client_secret username password passwd secret api_key apikey private_key public_key signature "
    "https://www.example.com http://localhost:8080 /usr/local/bin /etc/config.yaml .github/workflows main.py index.html "
    "select insert update delete where order by group by timestamp datetime created_at updated_at version description "
    "configuration environment production development documentation implementation authentication initialization"
)

#: Most frequent words of the corpus that join the dictionary, and the most bytes of it.
WORDS = 4096
MOST_DICTIONARY = 64 << 10
_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


def _size(data: bytes, dictionary: bytes) -> int:
    if dictionary not in _compressors:
        _compressors.clear()
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        _compressors[dictionary] = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(_compressors[dictionary].compress(data))


def novelty(before: str, candidate: str, after: str, dictionary: bytes = IDENTIFIERS.encode()) -> int:
    """Compressed bytes that the candidate adds to what stands around it, in lower case: a name in another case is no news."""
    around = (before + after).lower().encode()
    return _size(around + candidate.lower().encode(), dictionary) - _size(around, dictionary)


def corpus_dictionary(df: DataFrame, text_col: str = "text") -> bytes:
    """The fixed identifiers after the corpus's most frequent words without digits, counted over all texts; WORDS of them at most
    (the bound of what comes to the driver), the most frequent last, where a reference is cheapest."""
    word = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]{4,24}"), 0)).alias("w")
    top = df.select(word).groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(WORDS).collect()
    return (" ".join(r.w for r in reversed(top)) + " " + IDENTIFIERS).encode()[-MOST_DICTIONARY:]


Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern, without those too short."""
    low = text.encode().lower()
    out: list[Span] = []
    if any(w in low for w in (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[Span], least: int = 10, rate: float = 0.5, dictionary: bytes = IDENTIFIERS.encode()) -> list[Span]:
    """Candidates that add ``least`` bytes and ``rate`` bytes a character."""
    low = text.encode().lower()
    if not any(w.encode() in low for w in SENSITIVE):
        return []
    sensitive = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
    out: list[Span] = []
    done = -1
    i = 0
    for word in sensitive.finditer(text):
        for m in CANDIDATE.finditer(text, max(done, word.end()), min(len(text), word.end() + NEAR + 512)):
            if m.start() > word.end() + NEAR:
                break
            # a candidate is a whole run, wherever the search began or ended
            s, e = m.start(), m.end()
            while s > 0 and RUN.match(text, s - 1):
                s -= 1
            while e < len(text) and CANDIDATE.match(text, e - 15, e + 1):
                e += 1
            done = e
            while i < len(base) and base[i][2] <= s:
                i += 1
            if any(b[0] < e and s < b[2] for b in base[max(0, i - 2) : i + 3]):
                continue
            c = text[s:e]
            if not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)):
                continue
            # copies of the candidate say nothing of it: they leave its surroundings
            wide = AROUND + len(c)
            before, after = text[max(0, s - wide) : s].replace(c, "")[-AROUND:], text[e : e + wide].replace(c, "")[:AROUND]
            new = novelty(before, c, after, dictionary)
            if new >= least and new >= rate * len(c):
                out.append((s, 3, e))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, rate: float = 0.5, dictionary: bytes | None = None) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points).

    Null and empty texts have no spans (the digest of an empty string).  Overlapping spans of different kinds all
    count; repeated rows and null ids keep their rows; an empty table gives none; other columns are left out.  Very long
    texts are read whole.
    """

    known = corpus_dictionary(df, text_col) if dictionary is None else dictionary

    def run(values: pa.Array) -> list[pa.Array]:
        counts, digests, spans = [], [], []
        for text in values.to_pylist():
            base = base_spans(text) if text else []
            counts.append([sum(s[1] == k for s in base) for k in range(3)])
            digests.append(hashlib.sha256(render(base).encode()).hexdigest())
            spans.append(render(sorted(base + novel_spans(text, base, least, rate, known)) if text else []))
        return [*(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests), pa.array(spans)]

    fields = [T.StructField("n_" + k, T.LongType()) for k in KINDS[:3]] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return append_columns(df, text_col, fields, run, [id_col])
