"""Files by address, for what runs in Python beside Spark's own readers: any store that Arrow's file systems reach."""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def at(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of an address or an absolute path."""
    system, path = fs.FileSystem.from_uri(address)
    return system, path.rstrip("/")


def children(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """What is in a folder, by name; nothing where there is no folder."""
    return sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda x: x.path)


def put(system: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a file so that it is there whole or not at all."""
    put_lines(system, path, [content])


def put_lines(system: fs.FileSystem, path: str, pieces: Iterable[bytes], held: int = 1 << 20) -> int:
    """Write pieces in a row, about `held` bytes of them at a time, so that the file is there whole
    or not at all; how many there were. None make no file."""
    passing, out, n = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}", None, 0
    try:
        for piece in pieces:
            if out is None:
                system.create_dir(posixpath.dirname(path), recursive=True)
                out = system.open_output_stream(passing, buffer_size=held)
            out.write(piece)
            n += 1
    except BaseException:
        if out is not None:
            out.close()
            system.delete_file(passing)
        raise
    if out is not None:
        out.close()
        system.move(passing, path)
    return n


def lines(system: fs.FileSystem, path: str, held: int = 1 << 20) -> Iterator[str]:
    """A file's lines, read as they are asked for; line feeds alone end them."""
    with system.open_input_stream(path, buffer_size=held) as source, io.TextIOWrapper(source, "utf-8", newline="\n") as text:
        for line in text:
            yield line.removesuffix("\n")


def content(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as held:
        return held.read()
