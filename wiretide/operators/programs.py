"""What Windows programs say of themselves: machine, sections, imports."""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .protocols import parser

# Machines, and imports that malware needs more often than others.
MACHINES = {0x14C: "x86", 0x8664: "x64", 0x1C0: "ARM", 0xAA64: "ARM64"}
SUSPICIOUS_IMPORTS = (
    "VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "NtUnmapViewOfSection", "SetWindowsHookEx", "GetAsyncKeyState", "IsDebuggerPresent",
    "CheckRemoteDebuggerPresent", "NtQueryInformationProcess", "CryptEncrypt", "CryptGenKey", "InternetOpenUrlA", "URLDownloadToFileA", "WinExec", "ShellExecuteA",
    "CreateServiceA", "RegSetValueExA", "AdjustTokenPrivileges", "LookupPrivilegeValueA", "EnumProcesses", "Process32First", "GetTickCount",
)
_PLAIN = {n.rstrip("AW") for n in SUSPICIOUS_IMPORTS}


def _text(data: bytes, at: int) -> str:
    return data[at : data.index(b"\0", at, at + 256)].decode("latin-1")


def parse_program(data: bytes) -> dict | None:
    head = struct.unpack_from("<I", data, 60)[0]
    if data[:2] != b"MZ" or data[head : head + 4] != b"PE\0\0":
        return None
    machine, count, stamp, _, _, size = struct.unpack_from("<HHIIIH", data, head + 4)
    wide = struct.unpack_from("<H", data, head + 24)[0] == 0x20B
    tables = head + 24 + (112 if wide else 96)
    import_at = struct.unpack_from("<I", data, tables + 8)[0]
    spans, sections = [], []
    for i in range(min(count, 96)):
        at = head + 24 + size + 40 * i
        name = data[at : at + 8].rstrip(b"\0").decode("latin-1")
        virtual, where, length, place = struct.unpack_from("<IIII", data, at + 8)
        spans.append((where, max(virtual, length), place))
        body = data[place : place + min(length, 1 << 20)]
        bits = -sum(n / len(body) * math.log2(n / len(body)) for n in Counter(body).values()) if body else 0.0
        sections.append({"name": name, "size": length, "entropy": round(bits, 3)})

    def offset(rva: int) -> int:
        for where, length, place in spans:
            if where <= rva < where + length:
                return rva - where + place
        raise ValueError("outside all sections")

    names: list[str] = []
    at = offset(import_at) if import_at else 0
    while at and len(names) < 4096:
        lookup, _, _, dll, thunk = struct.unpack_from("<IIIII", data, at)
        if not dll:
            break
        library = _text(data, offset(dll)).lower()
        stem = library.rsplit(".", 1)[0] if library.endswith((".dll", ".ocx", ".sys")) else library
        entry, step = offset(lookup or thunk), 8 if wide else 4
        while len(names) < 4096:
            value = int.from_bytes(data[entry : entry + step], "little")
            if not value:
                break
            ordinal = value >> (8 * step - 1)
            names.append(f"{stem}.ord{value & 0xFFFF}" if ordinal else f"{stem}.{_text(data, offset(value & 0x7FFFFFFF) + 2)}")
            entry += step
        at += 20
    return {
        "machine": MACHINES.get(machine, f"0x{machine:x}"), "compiled": stamp, "sections": sections, "imphash": hashlib.md5(",".join(names).lower().encode()).hexdigest() if names else None,
        "suspicious": [n.split(".", 1)[1] for n in names if n.split(".", 1)[1].rstrip("AW") in _PLAIN][:20],
    }


_program = parser(pa.struct([("machine", pa.string()), ("compiled", pa.int64()), ("sections", pa.list_(pa.struct([("name", pa.string()), ("size", pa.int64()), ("entropy", pa.float64())]))), ("imphash", pa.string()), ("suspicious", pa.list_(pa.string()))]))(parse_program)


def programs(files: DataFrame) -> DataFrame:
    """Windows programs among carved files (with their data)."""
    p = files.where(F.substring("data", 1, 2) == F.lit(b"MZ"))
    return p.select(*[c for c in files.columns if c != "data"], F.sha2("data", 256).alias("sha256"), _program("data").alias("p")).where("p IS NOT NULL").select("*", "p.*").drop("p")
