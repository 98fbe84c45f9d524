"""Readable text of raw e-mail messages, without the standard library's object model.

``text_parts`` walks a message once (headers, multipart tree, transfer encoding,
character set) and returns every text part, attached ones included; ``readable_text``
joins them with HTML markup undone.  Both accept damaged input: cut-off base64, unknown
character sets, unterminated multiparts and messages without headers give the text that
can still be read.  ``None`` and empty messages give no parts.
"""

from __future__ import annotations

import binascii
import codecs
import html
import re

# Names of MIME headers and of HTML elements that break the running text.
_HEADER = re.compile(r"(?im)^content-(type|transfer-encoding):[ \t]*(.*(?:\n[ \t].*)*)")
_BOUNDARY = re.compile(r'(?i)boundary[ \t]*=[ \t]*(?:"([^"\n]+)"|([^\s;"]+))')
_CHARSET = re.compile(r"(?i)charset[ \t]*=[ \t]*[\"']?([^\s;\"']+)")
_HEADER_LINE = re.compile(r"[!-9;-~]+:")
_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>")
_BLOCK = re.compile(
    r"(?i)</?(?:p|div|blockquote|table|tr|ul|ol|li|h[1-6]|html|body|pre|section|article|header|footer|hr)\b[^>]*>"
)
_BREAK = re.compile(r"(?i)<(?:br|td|th|img)\b[^>]*>|</t[dh]\s*>")
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")


def _decode_bytes(data: bytes, charset: str) -> str:
    """Declared character set first; then UTF-8; then Windows-1252."""
    for name in (charset, "utf-8"):
        try:
            return codecs.decode(data, name)
        except UnicodeDecodeError as e:
            if codecs.lookup(name).name == "utf-8" and e.start >= len(data) - 3:
                return data[: e.start].decode("utf-8")  # the part was cut inside a character
        except (LookupError, TypeError, ValueError):
            pass
    return data.decode("cp1252", "replace")


def _decode(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        clean = _NOT_BASE64.sub("", body.split("=", 1)[0] if body.rstrip().endswith("=") else body)
        try:
            return _decode_bytes(binascii.a2b_base64(clean[: len(clean) // 4 * 4] + _tail(clean)), charset)
        except (binascii.Error, ValueError):
            return ""
    if encoding == "quoted-printable":
        if body.isascii():
            return _decode_bytes(binascii.a2b_qp(body.encode("ascii")), charset)
        try:
            data = body.encode(charset)
        except (LookupError, UnicodeEncodeError, TypeError):
            data, charset = body.encode("utf-8", "replace"), "utf-8"
        return _decode_bytes(binascii.a2b_qp(data), charset)
    return body


def _tail(clean: str) -> str:
    """The last 2 or 3 base64 characters, padded; a single one holds no byte."""
    rest = clean[len(clean) // 4 * 4 :]
    return rest + "=" * (4 - len(rest)) if len(rest) > 1 else ""


def text_parts(raw: str | None) -> list[tuple[bool, str]]:
    """(is HTML, decoded text) of each text part, in order, however deep it lies."""
    out: list[tuple[bool, str]] = []
    left = [(raw, True)] if raw else []
    while left:
        entity, top = left.pop()
        if not entity:
            continue
        if "\r" in entity:
            entity = entity.replace("\r\n", "\n").replace("\r", "\n")
        if entity.startswith("\n"):
            head, body = "", entity[1:]
        elif not top or _HEADER_LINE.match(entity) or entity.startswith("From "):
            head, _, body = entity.partition("\n\n")
        else:
            head, body = "", entity
        kind, encoding = "text/plain", ""
        for m in _HEADER.finditer(head):
            if m[1][0] in "tT" and m[1].lower() == "type":
                kind = m[2]
            else:
                encoding = m[2].strip().lower()
        low = kind.lstrip()[:24].lower()
        if low.startswith("multipart/"):
            b = _BOUNDARY.search(kind)
            if not b:
                out.append((False, body))
                continue
            pieces = []
            for piece in ("\n" + body).split("\n--" + (b[1] or b[2]))[1:]:
                if piece.startswith("--"):
                    break
                # the delimiter's own line ends here; what follows is headers, or a blank line and text
                if "\n" in piece:
                    pieces.append((piece[piece.find("\n") + 1 :], False))
            left += reversed(pieces)
        elif low.startswith("message/"):
            left.append((body, False))
        elif low.startswith("text/"):
            charset = _CHARSET.search(kind)
            out.append((low.startswith("text/html"), _decode(body, encoding, charset[1] if charset else "utf-8")))
    return out


def html_text(markup: str) -> str:
    """Markup undone: blocks become paragraphs, inline tags vanish, entities are read."""
    if "<" in markup:
        if "<!--" in markup or "<s" in markup or "<S" in markup or "<h" in markup or "<t" in markup or "<H" in markup:
            markup = _HIDDEN.sub(" ", markup)
        markup = _TAG.sub("", _BREAK.sub("\n", _BLOCK.sub("\n\n", markup)))
    return html.unescape(markup) if "&" in markup else markup


def readable_parts(raw: str | None) -> list[str]:
    return [html_text(text) if is_html else text for is_html, text in text_parts(raw)]


def readable_text(raw: str | None) -> str:
    return "\n\n".join(readable_parts(raw))
