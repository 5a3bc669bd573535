"""Text of plain PDF files with the standard library: pages of text blocks by size and weight, headings by comparison with the body.

Reads files whose text stands in content streams (plain or deflated) in one-byte encodings, as most writers make them;
encrypted files, object streams and fonts with other encodings give no text and hence an error for the file. Another
parser can be passed to ``loaders.load_documents``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"(": b"(", b")": b")", b"\\": b"\\"}

# --- fixed values: what counts as a heading or a list item
HEADING_CHARS, LARGER, LARGEST = 120, 1.5, 4.0
BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")


def _literal(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    body = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
    return re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S).decode("latin-1")


def _lines(content: bytes) -> list[tuple[float, str, float, bool]]:
    """``y, text, size, bold`` of each line of a content stream, in the order drawn."""
    out: list[list] = []
    stack: list[bytes] = []
    size, font, y, leading, scale = 0.0, b"", 0.0, 0.0, 1.0

    def show(text: str) -> None:
        if out and abs(out[-1][0] - y) < 0.5:
            out[-1][1] += text
        else:
            out.append([y, text, size * scale, b"bold" in font.lower()])

    numbers = lambda n: [float(x) for x in stack[-n:]]
    for token in _TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
            stack.append(token)
            continue
        try:
            if token == b"Tf":
                font, size = stack[-2], float(stack[-1])
            elif token == b"BT":
                y, scale = 0.0, 1.0
            elif token in (b"Td", b"TD"):
                y += numbers(2)[1]
                leading = -numbers(2)[1] if token == b"TD" else leading
            elif token == b"TL":
                leading = numbers(1)[0]
            elif token == b"T*":
                y -= leading
            elif token == b"Tm":
                y, scale = numbers(6)[5], abs(numbers(6)[3]) or 1.0
            elif token in (b"Tj", b"'", b'"'):
                y -= leading if token != b"Tj" else 0
                show(_literal(stack[-1]))
            elif token == b"TJ":
                begin = len(stack) - 1 - stack[::-1].index(b"[")
                for part in stack[begin + 1 :]:
                    if part[:1] in b"(<":
                        show(_literal(part))
                    elif part != b"]" and float(part) < -200:  # a gap as wide as a blank
                        show(" ")
        except (ValueError, IndexError):
            pass
        stack = []
    return [(a, b, c, d) for a, b, c, d in out if b.strip()]


def _streams(raw: bytes) -> list[bytes]:
    """Content streams of the pages, in the order of the page objects."""
    objects = {int(n): body for n, body in _OBJECT.findall(raw)}
    out = []
    for number in sorted(objects):
        body = objects[number]
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        listed = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        parts = []
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", listed[1]) if listed else []:
            own = objects.get(int(ref), b"")
            if m := _STREAM.search(own):
                parts.append(zlib.decompress(m[1]) if b"FlateDecode" in own else m[1])
        out.append(_named(b"\n".join(parts), body, objects))
    return out


def _named(content: bytes, page: bytes, objects: dict[int, bytes]) -> bytes:
    """The content with its fonts' names in place of their labels, which tell weights."""
    for label, ref in re.findall(rb"/(F\w*)\s+(\d+)\s+\d+\s+R", page):
        if base := re.search(rb"/BaseFont\s*/([^\s/>]+)", objects.get(int(ref), b"")):
            content = re.sub(rb"/" + re.escape(label) + rb"(?=\s)", b"/" + base[1], content)
    return content


def pdf_blocks(raw: bytes) -> list[dict]:
    """``text, kind, level, page`` of each block: lines closer than one and a half sizes that look alike stand together."""
    pages = [_lines(content) for content in _streams(raw)]
    sizes = Counter()
    for lines in pages:
        for _, text, size, _ in lines:
            sizes[round(size, 1)] += len(text)
    body = sizes.most_common(1)[0][0] if sizes else 0.0
    out = []
    for number, lines in enumerate(pages, 1):
        groups: list[list] = []
        for y, text, size, bold in lines:
            if groups and groups[-1][2:4] == [round(size, 1), bold] and 0 < groups[-1][4] - y <= 1.5 * max(size, 1):
                groups[-1][0] += "\n" + text.strip()
                groups[-1][4] = y
            else:
                groups.append([text.strip(), None, round(size, 1), bold, y])
        for text, _, size, bold, _ in groups:
            short = len(text) <= HEADING_CHARS and text.count("\n") <= 1
            if short and (size >= body + LARGER or (bold and size >= body)):
                kind, level = "heading", 1 if size >= body + LARGEST else 2
            else:
                kind, level = ("list_item", 0) if BULLET.match(text) else ("paragraph", 0)
            out.append({"text": BULLET.sub("", text) if kind == "list_item" else text, "kind": kind, "level": level, "page": number})
    return out
