"""Ogg as a media column: whole files in, checked pages, packets, streams and times out.

The reader finds pages by their capture pattern, verifies each page's checksum, reassembles packets from the lacing
values (a packet ends at a value under 255 and may go on over pages), keeps logical streams apart by their serial
number, and derives times from granule positions: a page tells the position of the last packet that ends on it, and the
packets before it get positions in between, in proportion to their lengths. A further stream of a serial number that was
used before (a chained file) is a stream of its own. Pages with a bad checksum are left out and counted, and the packet
they interrupt is dropped rather than patched up. The writer makes such files of 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .common import over_texts

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_NONE = -1

#: Our codec header: name, version, channels, samples a second, bits a sample, payload bytes of the stream.
_CODEC = struct.Struct("<8sBBIBQ")
_NAME = b"\x7fRAWPCM8"


def checksum(page: bytes) -> int:
    """CRC-32 as Ogg has it: polynomial 04C11DB7, high bit first, from 0, not inverted.

    zlib's has the same polynomial, low bit first and inverted, so bytes and result are mirrored around it.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    serial: int
    sequence: int
    granule: int
    flags: int
    lacing: bytes
    body: bytes

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(b"OggS", 0, self.flags, self.granule, self.serial, self.sequence, 0, len(self.lacing))
        page = head + self.lacing + self.body
        return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


@dataclass
class Stream:
    """One logical stream: its packets, whole ones only, and the granule position that a page told for each, or -1."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    begun: bool = False
    ended: bool = False
    _open: list[bytes] | None = None
    _next: int | None = None

    def positions(self) -> list[float]:
        """The position at the end of each packet; between those that pages told, by the packets' lengths.

        Before the first told one positions grow from 0; after the last, nothing tells them and they are -1, as are all
        of a stream that tells none.
        """
        out, start, known = [-1.0] * len(self.packets), 0, 0.0
        for i, told in enumerate(self.granules):
            if told == _NONE:
                continue
            total = sum(map(len, self.packets[start : i + 1]))
            done = 0
            for j in range(start, i):
                done += len(self.packets[j])
                out[j] = known + (told - known) * done / total if total else known
            out[i], start, known = float(told), i + 1, float(told)
        return out

    def disorder(self) -> int:
        """How often a page tells an earlier position than a page before it."""
        told = [g for g in self.granules if g != _NONE]
        return sum(a > b for a, b in zip(told, told[1:]))


@dataclass
class Media:
    """streams: by serial number, the last of each; earlier: those before it of the same number, as they ended."""

    streams: dict[int, Stream]
    pages: int
    bad_pages: int
    skipped_bytes: int
    earlier: list[Stream] = field(default_factory=list)


def write(streams: list[tuple[int, list[bytes], list[int]]], page_body: int = 4080) -> bytes:
    """An Ogg file of streams (serial, packets, granule position after each packet), their pages taking turns.

    The first packet of each stream stands alone on its first page. page_body: bytes after which a page is closed.
    """
    paged = []
    for serial, packets, granules in streams:
        pages: list[Page] = []
        lacing, body, granule, continued = bytearray(), bytearray(), _NONE, False

        def close(ends: bool = False, serial=serial, pages=pages) -> None:
            nonlocal lacing, body, granule, continued
            flags = continued | 2 * (not pages) | 4 * ends
            pages.append(Page(serial, len(pages), granule, flags, bytes(lacing), bytes(body)))
            continued = bool(lacing) and lacing[-1] == 255
            lacing, body, granule = bytearray(), bytearray(), _NONE

        for i, (packet, at) in enumerate(zip(packets, granules, strict=True)):
            for start in range(0, len(packet) + 1, 255):
                if len(lacing) == 255 or len(body) >= page_body:
                    close()
                part = packet[start : start + 255]
                lacing.append(len(part))
                body += part
            granule = at
            if i == 0 and len(packets) > 1:
                close()
        close(ends=True)
        paged.append(pages)
    out = []
    for turn in range(max(map(len, paged), default=0)):
        out += [pages[turn].to_bytes() for pages in paged if turn < len(pages)]
    return b"".join(out)


def read(data: bytes) -> Media:
    """The streams of an Ogg file, however damaged."""
    media = Media({}, 0, 0, 0)
    at = 0
    while (found := data.find(b"OggS", at)) >= 0:
        media.skipped_bytes += found - at
        page = None
        if len(data) >= found + _HEAD.size:
            _, version, flags, granule, serial, sequence, crc, segments = _HEAD.unpack_from(data, found)
            body_at = found + _HEAD.size + segments
            lacing = data[found + _HEAD.size : body_at]
            end = body_at + sum(lacing)
            if version == 0 and len(lacing) == segments and end <= len(data):
                whole = data[found:end]
                if checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc:
                    page = Page(serial, sequence, granule, flags, lacing, data[body_at:end])
        if page is None:
            media.bad_pages += 1
            media.skipped_bytes += 4
            at = found + 4
            continue
        media.pages += 1
        at = end
        held = media.streams.get(page.serial)
        if held is not None and page.flags & 2:  # its first page again: a chained stream
            media.earlier.append(media.streams.pop(page.serial))
        _take(media.streams.setdefault(page.serial, Stream(page.serial)), page)
    media.skipped_bytes += len(data) - at
    for s in [*media.earlier, *media.streams.values()]:
        s.lost += s._open is not None
        s._open = None
    return media


def _take(s: Stream, page: Page) -> None:
    s.pages += 1
    s.begun |= bool(page.flags & 2)
    s.ended |= bool(page.flags & 4)
    whole = s._next in (None, page.sequence)
    if not whole or (s._open is not None) != bool(page.flags & 1):
        s.lost += s._open is not None or bool(page.flags & 1)
        s._open = None
    dropping = bool(page.flags & 1) and s._open is None
    s._next = (page.sequence + 1) % 2**32
    complete, at = [], 0
    for n in page.lacing:
        part = page.body[at : at + n]
        at += n
        if not dropping:
            s._open = [] if s._open is None else s._open
            s._open.append(part)
        if n < 255:
            if not dropping:
                complete.append(b"".join(s._open))
                s._open = None
            dropping = False
    s.packets += complete
    s.granules += [_NONE] * (len(complete) - 1) + [page.granule] * bool(complete)


def store(payload: bytes, rate: int = 8000, packet: int = 960) -> bytes:
    """payload as 8-bit samples of two mono streams, whose packets take turns to carry it."""
    pieces = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    streams = []
    for k in range(2):
        own = pieces[k::2]
        total, granules = 0, [0]
        for p in own:
            total += len(p)
            granules.append(total)
        streams.append((k + 1, [_CODEC.pack(_NAME, 1, 1, rate, 8, total), *own], granules))
    return write(streams)


def load(data: bytes) -> tuple[bytes, list[float], Media]:
    """Of what `store` made: the payload, the seconds of each stream, and all that was found.

    Raises ValueError if a page is bad or a packet is missing.
    """
    media = read(data)
    streams = [media.streams[k] for k in sorted(media.streams)]
    if media.bad_pages or media.skipped_bytes or media.earlier or any(s.lost or not (s.begun and s.ended) for s in streams):
        raise ValueError("damaged Ogg file")
    seconds, own = [], []
    for s in streams:
        name, _, _, rate, _, total = _CODEC.unpack(s.packets[0])
        if name != _NAME or sum(map(len, s.packets[1:])) != total:
            raise ValueError("not a whole stream of samples")
        seconds.append(s.positions()[-1] / rate)
        own.append(s.packets[1:])
    longest = max(map(len, own), default=0)
    return b"".join(p[i] for i in range(longest) for p in own if i < len(p)), seconds, media


def padded(raw: bytes | None, unit: int = 192) -> bytes:
    """raw and spaces up to a positive multiple of unit."""
    raw = raw or b""
    return raw + b" " * (unit - len(raw) % unit if len(raw) % unit or not raw else 0)


def stored_column(text):
    """A binary column: the Ogg file of each text's padded bytes; a null text counts as empty.

    Equal texts give equal files; a text of any length is stored whole; an empty table gives an empty column. Nothing but
    the text is looked at, so ids may be null or repeated and other columns cannot clash.
    """
    return over_texts(lambda texts: pa.array([store(padded(t)) for t in texts], pa.binary()), "binary")(text)


PROBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _probe(data: bytes | None) -> dict | None:
    if data is None:
        return None
    payload, seconds, media = load(data)
    streams = list(media.streams.values())
    n = len(payload)
    samples = np.frombuffer(payload, np.uint8)
    times = np.bincount(samples, minlength=256)
    level = np.arange(256) - 128
    power, above = int((times * level * level).sum()) / n, samples > int((times * level).sum()) / n + 128
    turns = int((above[1:] != above[:-1]).sum())
    ends = [np.array(s.positions()) for s in streams]
    longest = max(float(np.diff(e, prepend=0).max()) for e in ends)
    told = hashlib.sha256(b"".join(np.round(e * 1000).astype(np.int64).tobytes() for e in ends)).hexdigest()[:16]
    feature = f"streams={len(streams)};pages={media.pages};packets={sum(len(s.packets) for s in streams)};seconds={','.join(f'{x:.6f}' for x in seconds)};longest={longest:.3f};times={told};disorder={sum(s.disorder() for s in streams)};power={power:.4f};crossings={turns}"
    return {
        "payload_bytes": n,
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
        "feature": feature,
    }


def probed_column(media):
    """A column of struct PROBED for a binary column of files that `store` made; null for null."""
    kind = pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in PROBED.split(", ")])
    return over_texts(lambda files: pa.array([_probe(f) for f in files], kind), PROBED)(media)


def inspected_column(media):
    """A column of struct about any Ogg file, damaged ones too: pages, bad_pages, and an array of streams, chained ones too.

    positions: of each packet, in samples or what the codec counts; disorder: steps back. Null for null; an empty file has
    no page and no stream.
    """
    one = pa.struct([("serial", pa.int64()), ("pages", pa.int64()), ("packets", pa.int64()), ("lost", pa.int64()), ("bytes", pa.int64()), ("granule", pa.int64()), ("disorder", pa.int64()), ("positions", pa.list_(pa.float64()))])
    kind = pa.struct([("pages", pa.int64()), ("bad_pages", pa.int64()), ("skipped_bytes", pa.int64()), ("streams", pa.list_(one))])

    def of(data: bytes | None) -> dict | None:
        if data is None:
            return None
        m = read(data)
        streams = [{"serial": s.serial, "pages": s.pages, "packets": len(s.packets), "lost": s.lost, "bytes": sum(map(len, s.packets)), "granule": max(s.granules, default=_NONE), "disorder": s.disorder(), "positions": s.positions()} for s in [*m.earlier, *(s for _, s in sorted(m.streams.items()))]]
        return {"pages": m.pages, "bad_pages": m.bad_pages, "skipped_bytes": m.skipped_bytes, "streams": streams}

    returns = "pages long, bad_pages long, skipped_bytes long, streams array<struct<serial: long, pages: long, packets: long, lost: long, bytes: long, granule: long, disorder: long, positions: array<double>>>"
    return over_texts(lambda files: pa.array([of(f) for f in files], kind), returns)(media)
