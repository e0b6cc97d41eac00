"""Text of PDF files, for where no PDF library is installed: pages in order, lines as they are shown.

Reads plain and Flate streams, object streams, and fonts with a ToUnicode map; other fonts count as Latin.
Encrypted files and scanned pages give no text. A file whose streams unpack to more than ``most`` bytes is refused.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


MOST_UNPACKED = 20 << 20


class Pdf:
    def __init__(self, data: bytes, most: int = MOST_UNPACKED):
        self.room = most
        self.heads: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJECT.finditer(data):
            self._add(int(m[1]), m[2])

    def _add(self, number: int, body: bytes) -> None:
        head, mark, rest = body.partition(b"stream")
        self.heads[number] = head
        if not mark:
            return
        raw = rest[: rest.rfind(b"endstream")].lstrip(b"\r").removeprefix(b"\n")
        if b"/FlateDecode" in head:
            try:
                raw = zlib.decompressobj().decompress(raw, self.room + 1)
            except zlib.error:
                raw = b""
            self.room -= len(raw)
            if self.room < 0:
                raise ValueError("its streams unpack to too much")
        self.streams[number] = raw
        if b"/ObjStm" in head and (n := re.search(rb"/N\s+(\d+)", head)) and (first := re.search(rb"/First\s+(\d+)", head)):
            at = int(first[1])
            table = list(map(int, raw[:at].split()[: 2 * int(n[1])]))
            starts = [at + x for x in table[1::2]] + [len(raw)]
            for k, own in enumerate(table[::2]):
                self.heads.setdefault(own, raw[starts[k] : starts[k + 1]])

    def references(self, head: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/" + name + rb"\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", head, re.S)
        if not m:
            return []
        return [int(m[2])] if m[2] else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]

    def inner(self, head: bytes, name: bytes) -> bytes:
        """The dictionary under a name: written out from there on, or another object's."""
        found = self.references(head, name)
        if found:
            return self.heads.get(found[0], b"")
        at = re.search(rb"/" + name + rb"\s*<<", head)
        return head[at.end() :] if at else b""

    def pages(self) -> list[tuple[bytes, bytes]]:
        """Each page's dictionary and its resources, which it may have from above."""
        out: list[tuple[bytes, bytes]] = []
        roots = [r for h in self.heads.values() if re.search(rb"/Type\s*/Catalog", h) for r in self.references(h, b"Pages")]
        waiting, seen = [(r, b"") for r in roots], set()
        while waiting:
            number, above = waiting.pop(0)
            head = self.heads.get(number, b"")
            if number in seen:
                continue
            seen.add(number)
            resources = self.inner(head, b"Resources") or above
            kids = self.references(head, b"Kids")
            if kids:
                waiting = [(k, resources) for k in kids] + waiting
            else:
                out.append((head, resources))
        return out

    def maps(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """By font name, what its codes stand for."""
        fonts = self.inner(resources, b"Font").split(b">>")[0]
        out = {}
        for name, number in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", fonts):
            held = self.references(self.heads.get(int(number), b""), b"ToUnicode")
            if held and held[0] in self.streams:
                out[b"/" + name] = unicode_map(self.streams[held[0]])
        return out

    def text(self) -> str:
        return "\n".join(page_text(b"\n".join(self.streams.get(n, b"") for n in self.references(head, b"Contents")), self.maps(resources)) for head, resources in self.pages())


def _bytes(digits: bytes) -> bytes:
    digits = b"".join(digits.split())
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def unicode_map(cmap: bytes) -> dict[bytes, str]:
    told = lambda digits: _bytes(digits).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        codes = _HEX.findall(block)
        out |= {_bytes(a): told(b) for a, b in zip(codes[::2], codes[1::2], strict=False)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, listed, first in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:\[(.*?)\]|<([^>]*)>)", block, re.S):
            a, b, size = int(low, 16), int(high, 16), len(_bytes(low))
            names = [told(x) for x in _HEX.findall(listed)] if listed else [told(first)[:-1] + chr(ord(told(first)[-1]) + k) for k in range(min(b - a, 0xFFFF) + 1)]
            out |= {(a + k).to_bytes(size, "big"): x for k, x in enumerate(names) if a + k <= b}
    return out


def shown(token: bytes, codes: dict[bytes, str] | None) -> str:
    """The text of a string in parentheses or of hexadecimal digits."""
    if token[:1] == b"<":
        raw = _bytes(token[1:-1])
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1] not in b"89" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if not codes:
        return raw.decode("cp1252", "replace")
    size = len(next(iter(codes)))
    return "".join(codes.get(raw[k : k + size], "") for k in range(0, len(raw), size))


def page_text(content: bytes, maps: dict[bytes, dict[bytes, str]]) -> str:
    lines, stack, font, height = [""], [], None, None

    def down() -> None:
        if lines[-1]:
            lines.append("")

    for token in _TOKEN.findall(content):
        if not token.isalpha() and token not in (b"'", b'"', b"T*"):
            stack.append(token)
            continue
        strings = [t for t in stack if t[:1] in (b"(", b"<")]
        if token == b"Tf" and len(stack) >= 2:
            font = maps.get(stack[-2])
        elif token in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1]) != 0 or token in (b"T*", b"'", b'"'):
            down()
        elif token == b"Tm" and len(stack) >= 6:
            if height is not None and float(stack[-1]) != height:
                down()
            height = float(stack[-1])
        if token in (b"Tj", b"'", b'"') and strings:
            lines[-1] += shown(strings[-1], font)
        elif token == b"TJ":
            for t in stack:
                if t[:1] in (b"(", b"<"):
                    lines[-1] += shown(t, font)
                elif t not in (b"[", b"]") and t[:1] != b"/" and float(t) < -200 and not lines[-1].endswith(" "):
                    lines[-1] += " "
        elif token == b"ET":
            down()
        stack = []
    return "\n".join(x.strip() for x in lines if x.strip())
