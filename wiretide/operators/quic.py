"""What a QUIC Initial packet says of its client: opened by Spark's own AES, with keys derived from the connection id.

The keys are public by design.  Header protection needs one AES block (ECB's first block), the payload is AES-GCM; both
are JVM expressions.  Only the key derivation and the CRYPTO frames go through Arrow functions.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.columns import let
from .decode import number
from .protocols import WHO, parse_hello, parser, port_is, read

# Salts and key labels by version.
SALTS = {
    "00000001": (bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a"), "quic"),
    "6B3343CF": (bytes.fromhex("0dede3def700a6db819381be6e269dcbf9bd2ed9"), "quicv2"),
    "FF00001D": (bytes.fromhex("afbfec289993d24c9e9786f19c6111e04390a899"), "quic"),
}


def _expand(secret: bytes, label: str, size: int) -> bytes:
    name = b"tls13 " + label.encode()
    info = struct.pack(">HB", size, len(name)) + name + b"\0"
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = hmac.new(secret, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:size]


def initial_keys(version: str, dcid: bytes) -> dict | None:
    """The client's key, iv and header key of Initial packets."""
    if version not in SALTS:
        return None
    salt, label = SALTS[version]
    client = _expand(hmac.new(salt, dcid, hashlib.sha256).digest(), "client in", 32)
    return {"key": _expand(client, f"{label} key", 16), "iv": _expand(client, f"{label} iv", 12), "hp": _expand(client, f"{label} hp", 16)}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = 1 << (data[at] >> 6)
    return int.from_bytes(data[at : at + n]) & ((1 << (8 * n - 2)) - 1), at + n


def parse_crypto(data: bytes) -> dict | None:
    """The ClientHello in a packet's CRYPTO frames, in whatever order they stand."""
    parts, at = {}, 0
    while at < len(data):
        kind, at = _varint(data, at)
        if kind in (0, 1):
            continue
        if kind == 6:
            off, at = _varint(data, at)
            size, at = _varint(data, at)
            parts[off] = data[at : at + size]
            at += size
            continue
        break
    whole = b""
    for off in sorted(parts):
        if off > len(whole):
            break
        whole += parts[off][len(whole) - off :]
    if len(whole) < 40:
        return None
    hello = parse_hello(b"\x16\x03\x01" + struct.pack(">H", min(len(whole), 65535)) + whole)
    return hello and hello | {"ja4": "q" + hello["ja4"][1:]}


_HELLO = pa.struct([("sni", pa.string()), ("alpn", pa.list_(pa.string())), ("version", pa.string()), ("ja3_string", pa.string()), ("ja3", pa.string()), ("ja4", pa.string()), ("cipher_count", pa.int64()), ("extension_count", pa.int64())])


_OPENING = pa.struct([("version", pa.string()), ("key", pa.binary()), ("iv", pa.binary()), ("hp", pa.binary()), ("pn_at", pa.int32()), ("length", pa.int32())])


def parse_header(data: bytes) -> dict | None:
    """Keys of an Initial packet, where its packet number stands and how long what follows is."""
    version, n = data[1:5].hex().upper(), data[5]
    keys = initial_keys(version, data[6 : 6 + n]) if n <= 20 else None
    if keys is None:
        return None
    at = 6 + n
    at += 1 + data[at]
    size, at = _varint(data, at)
    length, at = _varint(data, at + size)
    if at + 20 > len(data) or not 20 <= length <= len(data) - at:
        return None
    return keys | {"version": version, "pn_at": at, "length": length}


_header = parser(_OPENING)(parse_header)


def hellos(packets: DataFrame) -> DataFrame:
    """Names and fingerprints from the Initials of clients."""
    d = F.col("payload")
    p = packets.where((F.col("protocol") == 17) & port_is(443, 80) & (F.octet_length("payload") >= 60) & (number(d, F.lit(0), 1).bitwiseAND(0xC0) == 0xC0))
    p = p.select(*WHO, "payload", _header("payload").alias("k")).where("k IS NOT NULL")
    at, size = F.col("k.pn_at"), F.col("k.length")
    mask = F.aes_encrypt(F.substring(d, at + 5, F.lit(16)), F.col("k.hp"), F.lit("ECB"), F.lit("PKCS"))

    def opened(m: Column) -> Column:
        """The packet's plain bytes; m is the header's mask."""
        byte = lambda i: number(d, at + i, 1).bitwiseXOR(number(m, F.lit(i + 1), 1))

        def with_first(b0: Column) -> Column:
            n = (b0.bitwiseAND(3) + 1).cast("int")
            pn = F.when(n == 1, byte(0)).when(n == 2, byte(0) * 256 + byte(1)).when(n == 3, byte(0) * 65536 + byte(1) * 256 + byte(2)).otherwise(byte(0) * 16777216 + byte(1) * 65536 + byte(2) * 256 + byte(3))
            return let(pn, lambda v: F.try_aes_decrypt(F.concat(nonce(v), F.substring(d, at + n + 1, size - n)), F.col("k.key"), F.lit("GCM"), F.lit("DEFAULT"), head(b0, n, v)))

        return let(number(d, F.lit(0), 1).bitwiseXOR(number(m, F.lit(0), 1).bitwiseAND(15)), with_first)

    def nonce(v: Column) -> Column:
        return F.concat(F.substring("k.iv", 1, 8), F.unhex(F.lpad(F.hex(number(F.col("k.iv"), F.lit(8), 4).bitwiseXOR(v)), 8, "0")))

    def head(b0: Column, n: Column, v: Column) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(b0), 2, "0")), F.substring(d, F.lit(2), at - 1), F.unhex(F.substring(F.lpad(F.hex(v), 16, "0"), F.lit(17) - 2 * n, 2 * n)))

    p = p.select(*WHO, F.col("k.version").alias("quic_version"), let(mask, opened).alias("open"))
    schema = T.StructType([p.schema[c] for c in (*WHO, "quic_version")] + list(from_arrow_type(_HELLO)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(parse_crypto, x) for x in b.column(len(WHO) + 1).to_pylist()]
            keep = pa.array([i for i, r in enumerate(rows) if r], pa.int64())
            said = pa.array([r for r in rows if r], _HELLO)
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in b.columns[: len(WHO) + 1]] + said.flatten(), names=schema.names)

    return p.mapInArrow(run, schema)
