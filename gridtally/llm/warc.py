"""WARC records: bytes out and bytes in, one record at a time."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import BinaryIO

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
INFO_TYPE = "application/warc-fields"

# Extension fields, which readers that do not know them skip.
PAGE_FIELD, REFERS_FIELD = "WARC-Page-ID", "WARC-Refers-To-Page-ID"

INFO, RESPONSE, REVISIT = "warcinfo", "response", "revisit"

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gridtally:warc")


class BrokenArchive(ValueError):
    """An archive that does not hold what its headers, or its manifest, say."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(name: str) -> str:
    """The same id for the same name, always."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"


def header_safe(value: str) -> str:
    """Blanks, controls and what is not ASCII percent-encoded, so that a value is one line."""
    return "".join(
        c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
        for c in value
    )


def record(fields: Mapping[str, str | None], block: bytes) -> bytes:
    """One record; fields that are None are left out, digest and length are added."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_head(payload_bytes: int) -> bytes:
    """The response head that belongs to a page of so many bytes."""
    lines = [
        "HTTP/1.1 200 OK",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {payload_bytes}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member of its own, without a time, so that equal records are equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass(frozen=True)
class Read:
    fields: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.fields["warc-type"]

    def http(self) -> tuple[dict[str, str], bytes]:
        """Head fields and body of the response in the block."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _fields(head.decode().split("\r\n")[1:]), body


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(stream: BinaryIO) -> Iterator[Read]:
    """All records of a stream that is not compressed (any more), verified."""
    while first := stream.readline():
        if first.rstrip() != VERSION.encode():
            raise BrokenArchive(f"no record starts with {first[:40]!r}")
        lines = []
        while line := stream.readline().rstrip(b"\r\n"):
            lines.append(line.decode())
        fields = _fields(lines)
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise BrokenArchive(f"{fields.get('warc-record-id')} is cut off")
        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise BrokenArchive(f"{fields.get('warc-record-id')} is not what its digest says")
        yield Read(fields, block)
