"""RESP: request frames, inline commands, replies in both protocols, and a Spark data source over log files.

    spark.dataSource.register(RespSource)
    spark.read.format("resp").load(path)        # (file, offset, seq, cmd, args)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.functions.text import score_text
from tessera.plans.machine import Reply

# Limits of a frame.
MAX_ARGS, MAX_BULK, MAX_LINE = 1_048_576, 512 << 20, 64 << 10
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("a"): 7}


class ProtocolError(ValueError):
    pass


def split_inline(line: bytes) -> list[bytes]:
    """Words of an inline command: blanks separate, quotes group, backslash escapes inside double quotes."""
    words, i, n = [], 0, len(line)
    while i < n:
        if line[i] in b" \t\r\n\0\x0b\x0c":
            i += 1
            continue
        word, quote = bytearray(), 0
        while True:
            if i >= n:
                if quote:
                    raise ProtocolError("unbalanced quotes in request")
                break
            c = line[i]
            if quote == 34 and c == 92 and i + 1 < n:
                if line[i + 1] == ord("x") and i + 3 < n and all(x in b"0123456789abcdefABCDEF" for x in line[i + 2 : i + 4]):
                    word.append(int(line[i + 2 : i + 4], 16))
                    i += 4
                else:
                    word.append(_ESCAPES.get(line[i + 1], line[i + 1]))
                    i += 2
            elif quote == 39 and line[i : i + 2] == b"\\'":
                word.append(39)
                i += 2
            elif quote and c == quote:
                if i + 1 < n and line[i + 1] not in b" \t\r\n\0\x0b\x0c":
                    raise ProtocolError("unbalanced quotes in request")
                i += 1
                break
            elif not quote and c in b" \t\r\n\0\x0b\x0c":
                break
            elif not quote and c in (34, 39):
                quote = c
                i += 1
            else:
                word.append(c)
                i += 1
        words.append(bytes(word))
    return words


def _line(raw: bytes, at: int) -> tuple[bytes, int] | None:
    end = raw.find(b"\r\n", at)
    return None if end < 0 else (raw[at:end], end + 2)


def parse(raw: bytes, at: int = 0) -> tuple[list[bytes], int] | None:
    """One request from ``at`` and the place behind it; None when bytes are missing."""
    if at >= len(raw):
        return None
    if raw[at] != 42:
        end = raw.find(b"\n", at)
        if end < 0:
            if len(raw) - at > MAX_LINE:
                raise ProtocolError("too big inline request")
            return None
        return split_inline(raw[at:end].rstrip(b"\r")), end + 1
    head = _line(raw, at)
    if head is None:
        return None
    count, at = _size(head[0][1:], MAX_ARGS, "invalid multibulk length"), head[1]
    words = []
    for _ in range(max(0, count)):
        head = _line(raw, at)
        if head is None:
            return None
        if head[0][:1] != b"$":
            raise ProtocolError(f"expected '$', got '{chr(head[0][0]) if head[0] else ''}'")
        size, at = _size(head[0][1:], MAX_BULK, "invalid bulk length"), head[1]
        if size < 0:
            raise ProtocolError("invalid bulk length")
        if at + size + 2 > len(raw):
            return None
        words.append(raw[at : at + size])
        at += size + 2
    return words, at


def _size(text: bytes, limit: int, message: str) -> int:
    if not text.lstrip(b"-").isdigit() or int(text) > limit:
        raise ProtocolError(message)
    return int(text)


def parse_all(raw: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, words) of every whole request; a torn tail is left."""
    at = 0
    while (found := parse(raw, at)) is not None:
        words, end = found
        if words:
            yield at, words
        at = end


def records(words: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(w), w) for w in words)


def encode(reply: Reply, protocol: int = 2) -> bytes:
    """Reply bytes."""
    kind, v = reply
    three = protocol == 3
    if kind == "status":
        return b"+%s\r\n" % v
    if kind == "error":
        return b"-%s\r\n" % v.encode()
    if kind == "int":
        return b":%d\r\n" % v
    if kind == "bulk":
        return b"$%d\r\n%s\r\n" % (len(v), v)
    if kind == "null":
        return b"_\r\n" if three else b"$-1\r\n"
    if kind == "nullarray":
        return b"_\r\n" if three else b"*-1\r\n"
    if kind == "bool":
        return (b"#t\r\n" if v else b"#f\r\n") if three else b":%d\r\n" % v
    if kind == "double":
        text = score_text(v)
        return b",%s\r\n" % text if three else b"$%d\r\n%s\r\n" % (len(text), text)
    if kind == "map":
        body = b"".join(encode(k, protocol) + encode(x, protocol) for k, x in v)
        return (b"%%%d\r\n" % len(v) if three else b"*%d\r\n" % (2 * len(v))) + body
    mark = b"~" if kind == "set" and three else b"*"
    return mark + b"%d\r\n" % len(v) + b"".join(encode(x, protocol) for x in v)


class _Part(InputPartition):
    """The records of a file that begin in [start, end); both are places where a record may be cut."""

    def __init__(self, path: str, start: int, end: int, size: int):
        self.path, self.start, self.end, self.size = path, start, end, size


#: Bytes read to find the next record, and requests in a row that must parse there.
_WINDOW, _CHAIN = 1 << 20, 8


def _opened(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, root


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a path, by name."""
    from pyarrow import fs

    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path.rstrip("/")
    return [(prefix + x.path[len(root.rstrip("/")) :], x.size) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]


def next_record(f, at: int, size: int) -> int:
    """The first place from ``at`` on where a chain of requests begins; ``size`` where there is none."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    window = _WINDOW
    while True:
        base = max(0, at - 2)
        f.seek(base)
        raw = f.read(min(window, size - base))
        whole = base + len(raw) >= size
        place = raw.find(b"\r\n*")
        while place >= 0:
            seat, steps = place + 2, 0
            try:
                while steps < _CHAIN and (found := parse(raw, seat)) is not None:
                    seat, steps = found[1], steps + 1
                    if seat < len(raw) and raw[seat] != 42:
                        raise ProtocolError("not a chain")
                if steps == _CHAIN or (whole and (steps or seat == len(raw))):
                    return base + place + 2
            except ProtocolError:
                pass
            place = raw.find(b"\r\n*", place + 1)
        if whole:
            return size
        window *= 4


def _read(part: _Part, strict: bool):
    """(file, offset, seq, cmd, args) of the part's records.

    A part ends where the next one begins. Both find that place on their own; if the records of this one do not lead to
    it, bytes inside a value have passed for a record, and the read fails rather than give wrong commands.
    """
    system, path = _opened(part.path)
    with system.open_input_file(path) as f:
        start, stop = next_record(f, part.start, part.size), next_record(f, part.end, part.size)
        f.seek(start)
        raw, base, step = b"", start, 1 << 22
        while base < stop:
            more = f.read(min(step, part.size - base - len(raw)))
            raw, at = raw + more, 0
            while base + at < stop and (found := parse(raw, at)) is not None:
                words, end = found
                if words:
                    yield part.path, base + at, base + at, words[0].decode("latin-1").upper(), words[1:]
                at = end
            raw, base, step = raw[at:], base + at, max(1 << 22, len(raw) - at)
            if not more:
                if strict:
                    raise ProtocolError(f"torn record at {base} of {part.path}")
                return
        if base != stop:
            raise ProtocolError(f"records of {part.path} do not lead to {stop}; read it with splitBytes=0")


class RespReader(DataSourceReader):
    """Parts of at most ``splitBytes`` bytes (0: a part a file). A torn tail is dropped (mode=PERMISSIVE) or refused (mode=FAILFAST)."""

    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.split = int(options.get("splitBytes", options.get("splitbytes", 1 << 26)))

    def partitions(self):
        out = []
        for path, size in _files(self.path):
            step = self.split or size
            out += [_Part(path, at, min(at + step, size), size) for at in range(0, size, step)] if size else []
        return out or [_Part(self.path, 0, 0, 0)]

    def read(self, partition):
        if partition.size:
            yield from _read(partition, self.strict)


class RespStreamReader(DataSourceStreamReader):
    """Growing files below a path: an offset is the end of the last whole record of each file."""

    def __init__(self, options):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        out = {}
        for path, size in _files(self.path):
            system, root = _opened(path)
            with system.open_input_file(root) as f:
                at, window = size, _WINDOW
                while at == size and size:
                    back = max(0, size - window)
                    at = next_record(f, back, size) if back else 0
                    if not back:
                        break
                    window *= 4
                f.seek(at)
                raw, seat = f.read(size - at), 0
                while (found := parse(raw, seat)) is not None:
                    seat = found[1]
                out[path] = at + seat
        return out

    def partitions(self, start: dict, end: dict):
        return [_Part(path, start.get(path, 0), at, at) for path, at in sorted(end.items()) if at > start.get(path, 0)]

    def read(self, partition):
        system, path = _opened(partition.path)
        with system.open_input_file(path) as f:
            f.seek(partition.start)
            raw = f.read(partition.end - partition.start)
        for at, words in parse_all(raw):
            yield partition.path, partition.start + at, partition.start + at, words[0].decode("latin-1").upper(), words[1:]

    def commit(self, end: dict) -> None:
        pass


class RespSource(DataSource):
    """``seq`` is the offset of the record, so it orders the commands of a file."""

    @classmethod
    def name(cls):
        return "resp"

    def schema(self):
        return "file string, offset long, seq long, cmd string, args array<binary>"

    def reader(self, schema):
        return RespReader(self.options)

    def streamReader(self, schema):
        return RespStreamReader(self.options)
