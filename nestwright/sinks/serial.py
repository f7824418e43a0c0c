"""JSON texts and files of single documents, on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from nestwright.errors import SinkError, SourceError


def dumps(value: object, pretty: bool = False) -> bytes:
    """UTF-8 JSON, compact or indented by two; numbers that JSON lacks (NaN, infinities) are an error."""
    try:
        text = json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))
    except (TypeError, ValueError) as e:
        raise SinkError(f"no JSON: {e}") from e
    return text.encode()


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def loads(text: bytes | str) -> object:
    try:
        return json.loads(text, parse_constant=_no_number)
    except ValueError as e:
        raise SourceError(f"no JSON: {e}") from e


def write_json(value: object, path: str | Path, pretty: bool = True) -> int:
    """Writes a file in one step, its folders too; the number of bytes."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    data, part = dumps(value, pretty), target.with_name(target.name + ".part")
    part.write_bytes(data)
    os.replace(part, target)
    return len(data)


def read_json(path: str | Path) -> object:
    try:
        return loads(Path(path).read_bytes())
    except OSError as e:
        raise SourceError(f"{path} cannot be read") from e


def read_items(path: str | Path, size: int = 1 << 16) -> Iterator[object]:
    """Items of a file that holds one JSON array, one after another; little more than the item at hand is held."""
    decoder, space = json.JSONDecoder(parse_constant=_no_number), " \t\n\r"
    text, at, end, step = "", 0, False, size

    def more() -> None:
        """The text from here on, and as much again."""
        nonlocal text, at, end
        data = f.read(step)
        text, at, end = text[at:] + data, 0, not data

    def mark() -> str:
        """The next character that is no space, which is passed; none at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in space:
                at += 1
            if at < len(text):
                at += 1
                return text[at - 1]
            if end:
                return ""
            more()

    try:
        with open(path, encoding="utf-8-sig") as f:
            if mark() != "[":
                raise ValueError("no array")
            after = mark()
            if after != "]":
                at -= len(after)
                while True:
                    begins = mark()
                    at -= len(begins)
                    while True:
                        try:
                            item, to = decoder.raw_decode(text, at)
                        except ValueError:
                            if end:
                                raise
                        else:
                            if to + 3 <= len(text) or end:  # else a number may go on, as in 1e+5
                                break
                        more()
                        step *= 2
                    at, step = to, size
                    yield item
                    if (after := mark()) == "]":
                        break
                    if after != ",":
                        raise ValueError("neither a comma nor the array's end after an item")
            if mark():
                raise ValueError("text after the array")
    except OSError as e:
        raise SourceError(f"{path} cannot be read") from e
    except ValueError as e:
        raise SourceError(f"no JSON: {e}") from e
