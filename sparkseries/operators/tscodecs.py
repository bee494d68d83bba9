"""Binary codecs of whole series: Gorilla, Simple8b, XOR; one value per (series, block)."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.scratch import ship_package


class _Bits:
    def __init__(self) -> None:
        self.value, self.n, self.out = 0, 0, bytearray()

    def put(self, v: int, bits: int) -> None:
        self.value = self.value << bits | v & (1 << bits) - 1
        self.n += bits
        while self.n >= 8:
            self.n -= 8
            self.out.append(self.value >> self.n & 0xFF)
        self.value &= (1 << self.n) - 1

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value << (8 - self.n) & 0xFF]) if self.n else b"")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = int.from_bytes(data, "big"), 0
        self.size = len(data) * 8

    def get(self, bits: int) -> int:
        self.at += bits
        return self.data >> (self.size - self.at) & (1 << bits) - 1


# Prefixes and widths of the delta-of-delta classes (Pelkonen 2015).
_CLASSES = ((0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12))


def gorilla_encode(times: list[int], values: list[float]) -> bytes:
    """Times (any integer unit) as deltas of deltas, values as XOR with the one before."""
    b = _Bits()
    b.put(len(times), 32)
    last_t = last_d = last_v = 0
    lead = trail = -1
    for i, (t, x) in enumerate(zip(times, values)):
        v = struct.unpack(">Q", struct.pack(">d", x))[0]
        if i == 0:
            b.put(t, 64)
            b.put(v, 64)
        else:
            d = t - last_t
            dd = d - last_d
            if dd == 0:
                b.put(0, 1)
            else:
                for prefix, size, width in _CLASSES:
                    if -(1 << width - 1) < dd <= 1 << width - 1:
                        b.put(prefix, size)
                        b.put(dd - 1 + (1 << width - 1), width)
                        break
                else:
                    b.put(0b1111, 4)
                    b.put(dd, 66)
            last_d = d
            xor = v ^ last_v
            if xor == 0:
                b.put(0, 1)
            else:
                zeros, ends = min(31, 64 - xor.bit_length()), (xor & -xor).bit_length() - 1
                if lead >= 0 and zeros >= lead and ends >= trail:
                    b.put(0b10, 2)
                else:
                    lead, trail = zeros, ends
                    b.put(0b11, 2)
                    b.put(lead, 5)
                    b.put(64 - lead - trail - 1, 6)
                b.put(xor >> trail, 64 - lead - trail)
        last_t, last_v = t, v
    return b.done()


def gorilla_decode(data: bytes) -> tuple[list[int], list[float]]:
    r = _Reader(data)
    n = r.get(32)
    signed = lambda x, w: x - (1 << w) if x >> (w - 1) else x
    times, values, d, v, lead, trail = [], [], 0, 0, 0, 0
    for i in range(n):
        if i == 0:
            times.append(signed(r.get(64), 64))
            v = r.get(64)
        else:
            if r.get(1):
                width = None
                for _, _, w in _CLASSES:
                    if not r.get(1):
                        width = w
                        break
                d += r.get(width) + 1 - (1 << width - 1) if width else signed(r.get(66), 66)
            times.append(times[-1] + d)
            if r.get(1):
                if r.get(1):
                    lead = r.get(5)
                    trail = 64 - lead - r.get(6) - 1
                v ^= r.get(64 - lead - trail) << trail
        values.append(struct.unpack(">d", struct.pack(">Q", v))[0])
    return times, values


# Fixed values: (values per word, bits each) of the selectors, most values first.
_PACKS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


def simple8b_encode(values: list[int]) -> bytes:
    """Non-negative integers below 2**60 in 64-bit words (runs of ones take no bits)."""
    out, at = [struct.pack(">I", len(values))], 0
    while at < len(values):
        for selector, (n, bits) in enumerate(_PACKS):
            part = values[at : at + n]
            if bits == 0:
                if len(part) == n and all(x == 1 for x in part):
                    break
            elif (len(part) == n or selector >= 2 and len(part) < n and at + len(part) == len(values)) and all(0 <= x < 1 << bits for x in part):
                break
        else:
            raise ValueError("values must be in 0 .. 2**60 - 1")
        word = selector << 60
        if bits:
            for k, x in enumerate(part):
                word |= x << k * bits
        out.append(struct.pack(">Q", word))
        at += len(part)
    return b"".join(out)


def simple8b_decode(data: bytes) -> list[int]:
    total = struct.unpack_from(">I", data)[0]
    out: list[int] = []
    for at in range(4, len(data), 8):
        word = struct.unpack_from(">Q", data, at)[0]
        n, bits = _PACKS[word >> 60]
        n = min(n, total - len(out))
        out += [1] * n if bits == 0 else [word >> k * bits & (1 << bits) - 1 for k in range(n)]
    return out


def zigzag(x: int) -> int:
    return x << 1 if x >= 0 else (-x << 1) - 1


def unzigzag(x: int) -> int:
    return x >> 1 if not x & 1 else -(x + 1 >> 1)


def xor_encode(values: list[float]) -> list[int]:
    bits = [struct.unpack(">q", struct.pack(">d", v))[0] for v in values]
    return [a ^ b for a, b in zip(bits, [0, *bits])]


def xor_decode(words: list[int]) -> list[float]:
    out, last = [], 0
    for w in words:
        last ^= w
        out.append(struct.unpack(">d", struct.pack(">q", last))[0])
    return out


def compress_series(series, algorithm: str = "GORILLA", block: str = "1 day") -> DataFrame:
    """(keys, block start, n, data): each series cut into time blocks, so a block bounds what one task holds."""
    from .series import bucket

    df = series.df.withColumn("block", bucket(series.ts, block)).select(*series.keys, "block", *series.order, series.value)
    ship_package(df.sparkSession)
    keys, order, value, ts = [*series.keys, "block"], series.order, series.value, series.ts
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        times = frame[ts].astype("datetime64[us]").astype("int64").tolist()
        if algorithm == "GORILLA":
            data = gorilla_encode(times, frame[value].astype(float).tolist())
        elif algorithm == "SIMPLE8B":
            deltas = [a - b for a, b in zip(times, [0, *times])]
            data = simple8b_encode([zigzag(d) for d in deltas]) + frame[value].astype(">f8").to_numpy().tobytes()
        else:
            raise ValueError(algorithm)
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "n": [len(frame)], "data": [data]})

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, data binary")


def decompress_series(blocks: DataFrame, keys: tuple[str, ...] = (), algorithm: str = "GORILLA") -> DataFrame:
    """(keys, ts, value) of the blocks."""
    ship_package(blocks.sparkSession)
    kinds = dict(blocks.dtypes)

    def run(frames):
        for frame in frames:
            parts = []
            for row in frame.to_dict("records"):
                data = bytes(row["data"])
                if algorithm == "GORILLA":
                    times, values = gorilla_decode(data)
                else:
                    cut = len(data) - 8 * row["n"]
                    steps = [unzigzag(x) for x in simple8b_decode(data[:cut])]
                    times = pd.Series(steps).cumsum().tolist()
                    values = list(struct.unpack(f">{row['n']}d", data[cut:]))
                parts.append(pd.DataFrame({**{k: [row[k]] * len(times) for k in keys}, "ts": pd.to_datetime(times, unit="us"), "value": values}))
            yield pd.concat(parts) if parts else pd.DataFrame({k: [] for k in [*keys, "ts", "value"]})

    return blocks.mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["ts timestamp_ntz, value double"]))
