"""Single objects on the driver: leader, directory, fields and whole records from bytes, for tools and tests.

Frames of records never go through these; ``scan`` decodes them with column functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from leafmill.errors import InvalidRecordError
from leafmill.sources.model import BIBLIOGRAPHIC

_LEADER = re.compile(rb"([0-9]{5})([\x21-\x7E])([\x21-\x7E])([\x20-\x7E])([\x20-\x7E])([\x20-\x7E])22([0-9]{5})([\x20-\x7E])([\x20-\x7E])([\x20-\x7E])4500")
_ENTRY = re.compile(rb"([0-9]{3})([0-9]{4})([0-9]{5})")
_SUBFIELD = re.compile(rb"\x1f([0-9A-Za-z])([^\x1e\x1f]*)")


@dataclass(frozen=True)
class Leader:
    length: int
    status: str
    type: str
    idef1: str
    idef2: str
    encoding: str
    base_addr: int
    idef3: str
    idef4: str
    idef5: str

    @classmethod
    def from_bytes(cls, raw: bytes) -> Leader:
        found = _LEADER.fullmatch(raw)
        if not found:
            raise InvalidRecordError("invalid leader")
        return cls(*(int(v) if len(v) == 5 else v.decode() for v in found.groups()))

    def __str__(self) -> str:
        return f"{self.length:05d}{self.status}{self.type}{self.idef1}{self.idef2}{self.encoding}22{self.base_addr:05d}{self.idef3}{self.idef4}{self.idef5}4500"

    @property
    def is_bibliographic(self) -> bool:
        return self.type in BIBLIOGRAPHIC

    @property
    def is_community_information(self) -> bool:
        return self.type == "q"

    @property
    def bibliographic_level(self) -> str | None:
        return self.idef1 if self.is_bibliographic and self.idef1 != " " else None

    @property
    def kind_of_data(self) -> str | None:
        return self.idef1 if self.is_community_information and self.idef1 != " " else None

    @property
    def type_of_control(self) -> str | None:
        return self.idef2 if self.is_bibliographic and self.idef2 != " " else None


@dataclass(frozen=True)
class Entry:
    tag: str
    length: int
    start: int

    @classmethod
    def from_bytes(cls, raw: bytes) -> Entry:
        found = _ENTRY.fullmatch(raw)
        if not found or not int(found[2]):
            raise InvalidRecordError("invalid directory entry")
        return cls(found[1].decode(), int(found[2]), int(found[3]))


def directory(raw: bytes) -> list[Entry]:
    """The entries of a directory, which ends with a field terminator."""
    if len(raw) < 13 or len(raw) % 12 != 1 or raw[-1:] != b"\x1e":
        raise InvalidRecordError("invalid directory")
    return [Entry.from_bytes(raw[i : i + 12]) for i in range(0, len(raw) - 1, 12)]


@dataclass(frozen=True)
class Subfield:
    code: str
    value: bytes

    @classmethod
    def from_bytes(cls, raw: bytes) -> Subfield:
        found = _SUBFIELD.fullmatch(raw)
        if not found:
            raise InvalidRecordError("invalid subfield")
        return cls(found[1].decode(), found[2])


@dataclass(frozen=True)
class Field:
    """A control field has a value, a data field indicators and subfields."""

    tag: str
    value: bytes | None = None
    indicators: str = ""
    subfields: tuple[Subfield, ...] = ()


@dataclass(frozen=True)
class Record:
    leader: Leader
    fields: tuple[Field, ...]
    raw: bytes

    @classmethod
    def from_bytes(cls, raw: bytes) -> Record:
        """A record with its terminator.  Fields are read one after the other; bytes left over in the end are ignored."""
        leader = Leader.from_bytes(raw[:24])
        end = raw.find(b"\x1e", 24) + 1
        if leader.length <= leader.base_addr + 1 or not end:
            raise InvalidRecordError("invalid length")
        entries, size = directory(raw[24:end]), leader.length - leader.base_addr - 1
        body = raw[end : end + size]
        if raw[end + size :] != b"\x1d" or len(body) != size:
            raise InvalidRecordError("invalid size")
        fields, at = [], 0
        for entry in entries:
            if entry.tag.startswith("00"):
                value, stop = body[at : at + entry.length - 1], at + entry.length - 1
                if body[stop : stop + 1] != b"\x1e":
                    raise InvalidRecordError("invalid control field")
                fields.append(Field(entry.tag, value))
            else:
                stop = body.find(b"\x1e", at)
                if stop < 0 or not re.match(rb"[ a-z0-9]{2}", body[at:stop]):
                    raise InvalidRecordError("invalid data field")
                subs, rest = [], body[at + 2 : stop]
                for part in re.findall(rb"\x1f[^\x1f]*|[^\x1f]+", rest):
                    subs.append(Subfield.from_bytes(part))
                fields.append(Field(entry.tag, None, body[at : at + 2].decode(), tuple(subs)))
            at = stop + 1
        return cls(leader, tuple(fields), raw)

    @property
    def control_number(self) -> bytes | None:
        return next((f.value for f in self.fields if f.tag == "001"), None)

    def is_utf8(self) -> bool:
        try:
            for f in self.fields:
                for value in [f.value] if f.value is not None else [s.value for s in f.subfields]:
                    value.decode()
        except UnicodeDecodeError:
            return False
        return True
