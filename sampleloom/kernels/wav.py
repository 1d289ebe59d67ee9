"""WAV headers and samples, without Spark."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

# Format tags of the WAVE registry.
PCM, FLOAT, ALAW, MULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
NAMES = {0x0002: "Microsoft ADPCM", 0x0011: "IMA ADPCM", 0x0031: "GSM 6.10", 0x0050: "MPEG", 0x0055: "MPEG Layer 3", 0x0161: "Windows Media Audio", 0x00FF: "AAC", 0xF1AC: "FLAC", 0x674F: "Ogg Vorbis"}


class UnsupportedWav(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    tag: int
    channels: int
    rate: float
    bits: int
    offset: int  # of the samples
    frames: int
    whole: bool = True  # whether the file has all the frames that its header says, and says any

    @property
    def frame_bytes(self) -> int:
        return self.channels * (self.bits // 8)

    @property
    def dtype(self) -> str:
        if self.tag in (ALAW, MULAW):
            return "int16"
        return f"float{self.bits}" if self.tag == FLOAT else f"int{self.bits}"


def read_header(f: BinaryIO, size: int) -> Header:
    """Walks the chunks; only their heads are read. A data chunk of unknown or too great length ends with the file."""
    riff, _, wave = struct.unpack("<4sI4s", f.read(12).ljust(12, b"\0"))
    if riff not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise UnsupportedWav("not a WAV file")
    fmt, at = None, 12
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            raw = f.read(min(length, 40))
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            if tag == EXTENSIBLE and len(raw) >= 26:
                tag = struct.unpack("<H", raw[24:26])[0]
            fmt = tag, channels, rate, bits
        elif name == b"data":
            if fmt is None:
                raise UnsupportedWav("samples come before their format")
            tag, channels, rate, bits = fmt
            ok = {PCM: (8, 16, 24, 32), FLOAT: (32, 64), ALAW: (8,), MULAW: (8,)}.get(tag)
            if ok is None:
                raise UnsupportedWav(f"codec {NAMES.get(tag, 'unknown')} (format tag 0x{tag:04X}) can't be read")
            if bits not in ok or not channels:
                raise UnsupportedWav(f"{bits}-bit samples in {channels} channels can't be read")
            there = min(length, size - at - 8)
            return Header(tag, channels, float(rate), bits, at + 8, there // (channels * bits // 8), 0 < length == there)
        at += 8 + length + (length & 1)
    raise UnsupportedWav("no samples")


def _integers(raw: bytes, bits: int) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8
    return np.frombuffer(raw, f"<i{bits // 8}").astype(np.int32)


def mulaw(code: np.ndarray) -> np.ndarray:
    """ITU-T G.711, to the 16-bit scale."""
    c = ~code.astype(np.int32) & 0xFF
    size = (((c & 0x0F) << 3) + 0x84 << ((c >> 4) & 7)) - 0x84
    return np.where(c & 0x80, -size, size)


def alaw(code: np.ndarray) -> np.ndarray:
    c = code.astype(np.int32) ^ 0x55
    e, m = (c >> 4) & 7, (c & 0x0F) << 4
    size = np.where(e == 0, m + 8, (m + 0x108) << np.maximum(e - 1, 0))
    return np.where(c & 0x80, size, -size)


def decode(raw: bytes, h: Header) -> np.ndarray:
    """(channels, frames) float64; integers by the largest positive value of their width."""
    if h.tag == FLOAT:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float64)
    elif h.tag in (ALAW, MULAW):
        x = (alaw if h.tag == ALAW else mulaw)(np.frombuffer(raw, np.uint8)) / 32767.0
    else:
        x = _integers(raw, h.bits) / float((1 << h.bits - 1) - 1)
    return x.reshape(-1, h.channels).T


def decode_raw(raw: bytes, h: Header) -> np.ndarray:
    """(channels, frames) int32 in the stored width."""
    if h.tag != PCM or h.bits == 24:
        raise UnsupportedWav(f"raw reads of {h.bits}-bit {'float' if h.tag == FLOAT else 'integer'} samples are refused")
    return _integers(raw, h.bits).reshape(-1, h.channels).T


def make_header(rate: float, channels: int, frames: int, bit_depth: int, floating: bool = False) -> bytes:
    if not rate or int(rate) != rate or rate < 0:
        raise ValueError("the sample rate has to be a whole number greater than 0")
    if not channels or channels < 0:
        raise ValueError("at least one channel is needed")
    if channels > 1024 and rate < 1024:
        raise ValueError("there are more channels than frames a second; were rate and channels swapped?")
    if bit_depth not in ((32, 64) if floating else (8, 16, 24, 32)):
        raise ValueError(f"{bit_depth} bits can't be written")
    width = channels * bit_depth // 8
    size = frames * width
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(0xFFFFFFFF, 36 + size + (size & 1)), b"WAVE", b"fmt ", 16, FLOAT if floating else PCM, channels, int(rate), int(rate) * width, width, bit_depth, b"data", min(0xFFFFFFFF, size))


def encode(x: np.ndarray, bit_depth: int, floating: bool = False) -> bytes:
    """(channels, frames) to interleaved samples: clamped, scaled, rounded half to even."""
    if floating:
        return np.ascontiguousarray(x.T, f"<f{bit_depth // 8}").tobytes()
    v = np.rint(np.clip(x.T, -1, 1) * ((1 << bit_depth - 1) - 1)).astype(np.int64).ravel()
    if bit_depth == 8:
        return (v + 128).astype(np.uint8).tobytes()
    if bit_depth == 24:
        return np.ascontiguousarray(v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return v.astype(f"<i{bit_depth // 8}").tobytes()
