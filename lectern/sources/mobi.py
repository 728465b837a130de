"""Text of MOBI books (the Palm database format), uncompressed or in PalmDOC compression."""

from __future__ import annotations

import re
import struct

from .html import html_to_markdown

MOST_UNPACKED = 40 << 20


def palmdoc(raw: bytes) -> bytes:
    """One record: bytes as they are, runs of them, copies of what came before, and a space with a letter."""
    out, at = bytearray(), 0
    while at < len(raw):
        c = raw[at]
        at += 1
        if 1 <= c <= 8:
            out += raw[at : at + c]
            at += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        else:
            pair = c << 8 | (raw[at] if at < len(raw) else 0)
            at += 1
            back, count = pair >> 3 & 0x7FF, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("a copy from before the record")
            for _ in range(count):
                out.append(out[-back])
    return bytes(out)


def _trailing(record: bytes, flags: int) -> int:
    """Bytes at a record's end that are no text, by the header's flags."""
    size = 0
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            number, shift = 0, 0
            for k in range(1, 5):
                if len(record) - size - k < 0:
                    break
                c = record[len(record) - size - k]
                number |= (c & 0x7F) << shift
                shift += 7
                if c & 0x80:
                    break
            size += number
    if flags & 1 and len(record) > size:
        size += (record[len(record) - size - 1] & 3) + 1
    return size


def read_mobi(raw: bytes) -> dict:
    """Markdown and title of a book."""
    count = struct.unpack_from(">H", raw, 76)[0]
    starts = [struct.unpack_from(">I", raw, 78 + 8 * k)[0] for k in range(count)] + [len(raw)]
    head = raw[starts[0] : starts[1]]
    packing, _, length, records, _, protection = struct.unpack_from(">HHIHHH", head, 0)
    if protection:
        raise PermissionError("protected by DRM")
    if packing not in (1, 2):
        raise ValueError("the text is in a compression that isn't read")
    encoding, flags, title = "cp1252", 0, raw[:32].split(b"\0")[0].decode("latin-1").replace("_", " ")
    if head[16:20] == b"MOBI":
        size, _, code = struct.unpack_from(">III", head, 20)
        encoding = "utf-8" if code == 65001 else "cp1252"
        at, chars = struct.unpack_from(">II", head, 84)
        title = head[at : at + chars].decode(encoding, "replace") or title
        flags = struct.unpack_from(">H", head, 242)[0] if size >= 228 and len(head) >= 244 else 0
    parts, left = [], MOST_UNPACKED
    for k in range(1, min(records, count - 1) + 1):
        record = raw[starts[k] : starts[k + 1]]
        record = record[: len(record) - _trailing(record, flags)]
        parts.append(palmdoc(record) if packing == 2 else record)
        left -= len(parts[-1])
        if left < 0:
            raise ValueError("unpacks to too much")
    text = b"".join(parts)[: length or None].decode(encoding, "replace")
    text = re.sub(r"(?i)<mbp:pagebreak[^>]*>", "<hr>", text)
    return {"markdown": html_to_markdown(text), "title": title.strip() or None}
