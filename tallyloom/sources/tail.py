"""Streaming tail of growing log files: only complete lines, each once, by byte offset.

Spark's file source reads a file once and never again, so growing files need a source of their own. Its
offset is the number of complete bytes of each file; a file that shrank is read anew from its start.
Registered as ``log_tail``; the option ``path`` is a folder that the executors reach too.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").load(folder)     # rel, byte_offset, text
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_STEP = 1 << 16
#: Bytes that one task reads (about), so that a large file's backlog is dealt over tasks; files that one task opens, so that small ones share it.
MOST, FILES = 1 << 26, 1024


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Span(InputPartition):
    """The lines of a file that begin in [start, stop); ``first`` is where reading began, ``end`` where the complete lines end."""

    def __init__(self, path: str, rel: str, first: int, start: int, stop: int, end: int):
        self.path, self.rel, self.first, self.start, self.stop, self.end = path, rel, first, start, stop, end


class _Share(InputPartition):
    """What one task reads: a span of a large file, or several files."""

    def __init__(self, spans: list[_Span]):
        self.spans = spans


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _complete(self, filesystem, path: str, size: int) -> int:
        """The end of the file's last complete line. It depends on the file alone, so a restarted query never falls behind what it has read."""
        at = size
        with filesystem.open_input_file(path) as f:
            while at:
                start = max(0, at - _STEP)
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                at = start
        return 0

    def latestOffset(self) -> dict:
        from pyarrow import fs

        filesystem, root = _filesystem(self.root)
        cut = len(root.rstrip("/")) + 1
        own = [x for x in filesystem.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(".jsonl")]
        stamps = {x.path[cut:]: (x.size, x.mtime_ns) for x in own}
        # Only what changed since the last look is opened.
        news = [x for x in own if self.known.get(x.path[cut:], (None,))[0] != stamps[x.path[cut:]]]
        with ThreadPoolExecutor(16) as pool:
            ends = list(pool.map(lambda x: self._complete(filesystem, x.path, x.size), news))
        self.known = {rel: self.known.get(rel) for rel in stamps} | {x.path[cut:]: (stamps[x.path[cut:]], end) for x, end in zip(news, ends)}
        return {"files": json.dumps({rel: end for rel, (_, end) in self.known.items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        a, b = json.loads(start["files"]), json.loads(end["files"])
        _, root = _filesystem(self.root)
        out = []
        for rel, stop in sorted(b.items()):
            first = 0 if stop < a.get(rel, 0) else a.get(rel, 0)  # a file that has shrunk is another one
            out += [_Span(f"{root.rstrip('/')}/{rel}", rel, first, s, min(stop, s + MOST), stop) for s in range(first, stop, MOST)]
        least = min(MOST, max(1 << 20, sum(x.stop - x.start for x in out) // 64))
        shares, held = [], 0
        for span in out:
            if not shares or held + span.stop - span.start > least or len(shares[-1].spans) >= FILES:
                shares.append(_Share([]))
                held = 0
            shares[-1].spans.append(span)
            held += span.stop - span.start
        return shares

    def read(self, share: _Share):
        for span in share.spans:
            yield from self._lines(span)

    def _lines(self, span: _Span):
        filesystem, _ = _filesystem(self.root)
        with filesystem.open_input_file(span.path) as f:
            at, held, skip = span.start, b"", span.start > span.first
            if skip:  # the line that covers the byte before belongs to the span before
                at -= 1
            f.seek(at)
            pos = at
            while at < span.stop:
                if b"\n" not in held:
                    more = f.read(min(_STEP, span.end - pos))
                    if not more:
                        return
                    pos += len(more)
                    held += more
                    continue
                *own, held = held.split(b"\n")
                for line in own:
                    if at >= span.stop:
                        return
                    if not skip:
                        yield span.rel, at, line.removesuffix(b"\r").decode("utf-8", "replace")
                    skip = False
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        """Nothing to keep: offsets come from the files and from Spark's checkpoint."""


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "rel string, byte_offset long, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])
