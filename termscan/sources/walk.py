"""Complete listings of file trees, and reading of chosen files.

Spark's file sources leave out every name that starts with ``.`` or ``_``
(``__init__.py`` among them) and open a file before looking at its path.  Here
directories are listed by tasks, one level of the tree per job, large ones in
pages, and contents are read only for the files that passed the path and size filters.

The functions that run in tasks are nested so that they are shipped by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.sources.sinks import stored

# ``root`` names the file system, ``name`` the file within it: file names are
# never parsed as addresses, whatever characters they hold.
# ``skipped`` says why a directory was not listed or a file not read.
# ``pages`` above 1: the directory has too many entries for one task.
ENTRY_SCHEMA = "root string, name string, path string, is_dir boolean, length bigint, modification_time timestamp, skipped string, pages int"
PIECE_SCHEMA = "path string, piece bigint, content binary, ahead binary, skipped string"
CONTENT_SCHEMA = "path string, length bigint, modification_time timestamp, content binary, skipped string"

# Entries of a directory that a task lists; a larger one is listed by several.
PAGE_ENTRIES = 20_000
# Bytes of content per task and per Arrow batch.
TASK_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 32 * 1024 * 1024
# How far a cut may move to fall between characters.  Longer only would be a run
# of over a hundred first halves of UTF-16 pairs, each without its second.
CUT_SLACK = 256


def _lister(page_entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib
        from datetime import datetime, timezone

        from pyarrow import fs

        schema = pa.schema([
            ("root", pa.string()), ("name", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()),
            ("length", pa.int64()), ("modification_time", pa.timestamp("us", tz="UTC")), ("skipped", pa.string()), ("pages", pa.int32()),
        ])

        def local(folder: str, mine: Callable[[str], bool]) -> Iterator[tuple]:
            with os.scandir(folder) as found:
                for entry in found:
                    if mine(entry.name) and not entry.is_symlink():
                        try:
                            stat = entry.stat(follow_symlinks=False)
                        except FileNotFoundError as problem:
                            yield entry.name, False, 0, None, type(problem).__name__
                            continue
                        folders = entry.is_dir(follow_symlinks=False)
                        yield entry.name, folders, 0 if folders else stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), None

        def remote(system: fs.FileSystem, folder: str, mine: Callable[[str], bool]) -> Iterator[tuple]:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.type != fs.FileType.NotFound and mine(info.base_name):
                    yield info.base_name, info.type == fs.FileType.Directory, max(info.size or 0, 0), info.mtime, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema)

        systems: dict[str, tuple[fs.FileSystem, str]] = {}
        # Small directories share a batch.
        rows: list[tuple] = []
        for batch in batches:
            for root, name, page, pages in zip(*[batch.column(c).to_pylist() for c in ("root", "name", "page", "pages")]):
                if root not in systems:
                    systems[root] = fs.FileSystem.from_uri(root)
                system, top = systems[root]
                prefix = root.removesuffix(top) if root.endswith(top) else ""
                folder = top if name is None else name
                mine = (lambda entry: zlib.crc32(entry.encode()) % pages == page) if pages > 1 else (lambda entry: True)  # noqa: B023
                own: list[tuple] = []
                count = 0
                try:
                    found = local(folder, mine) if isinstance(system, fs.LocalFileSystem) else remote(system, folder, mine)
                    for entry, is_dir, length, modified, skipped in found:
                        count += 1
                        if pages > 1 or count <= page_entries:
                            place = f"{folder.rstrip('/')}/{entry}"
                            own.append((root, place, prefix + place, is_dir, length, modified, skipped, 1))
                        if pages > 1 and len(own) == page_entries:
                            yield batch_of(own)
                            own = []
                except (FileNotFoundError, PermissionError) as problem:
                    # Anything else fails the task, which is then repeated.
                    own = [(root, folder, prefix + folder, False, 0, None, type(problem).__name__, 1)]
                if pages == 1 and count > page_entries:
                    # Too many for one task: list it again in pages, each the names of one hash.
                    own = [(root, name, prefix + folder, True, 0, None, None, -(-count // page_entries))]
                rows += own
                if len(rows) >= page_entries:
                    yield batch_of(rows)
                    rows = []
        yield batch_of(rows)

    return entries


def _reader(batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([
            ("path", pa.string()), ("length", pa.int64()),
            ("modification_time", pa.timestamp("us", tz="UTC")), ("content", pa.binary()), ("skipped", pa.string()),
        ])
        systems: dict[str, fs.FileSystem] = {}
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for root, name, path, length, modified in zip(*[column.to_pylist() for column in batch.columns]):
                data, skipped = None, None
                try:
                    if root not in systems:
                        systems[root] = fs.FileSystem.from_uri(root)[0]
                    system = systems[root]
                    with system.open_input_stream(name) as stream:
                        data = stream.read()
                    size += len(data)
                except (FileNotFoundError, PermissionError) as problem:
                    skipped = type(problem).__name__
                rows.append((path, length, modified, data, skipped))
                if size >= batch_bytes:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema)

    return contents


def _piece_reader(piece_bytes: int, ahead_bytes: int, batch_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([
            ("path", pa.string()), ("piece", pa.int64()), ("content", pa.binary()), ("ahead", pa.binary()), ("skipped", pa.string()),
        ])
        # Byte order marks, longest first, with the bytes of a code unit.
        marks = ((b"\xff\xfe\x00\x00", 4), (b"\x00\x00\xfe\xff", 4), (b"\xff\xfe", 2), (b"\xfe\xff", 2))

        def whole_from(data: bytes, at: int, mark: bytes, unit: int) -> int:
            """The first place from ``at`` where no character is cut."""
            if unit == 1:
                # At most three bytes continue a character; further ones are malformed, each for itself.
                end = min(at + 3, len(data))
                while at < end and data[at] & 0xC0 == 0x80:
                    at += 1
            elif unit == 2:
                # The decoder takes whatever follows the first half of a pair with it: cut after a unit that is none.
                end, upper = at + CUT_SLACK - 2, int(mark[0] == 0xFF)
                while at < end and at + upper < len(data) and 0xD8 <= data[at + upper] <= 0xDB:
                    at += 2
                at += 2
            return min(at, len(data))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema)

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for root, name, path, length, piece in zip(*[column.to_pylist() for column in batch.columns]):
                try:
                    system, _ = fs.FileSystem.from_uri(root)
                    with system.open_input_file(name) as file:
                        head = file.read_at(4, 0)
                        start = piece * piece_bytes
                        data = file.read_at(max(min(length - start, piece_bytes + ahead_bytes + 2 * CUT_SLACK), 0), start)
                except (FileNotFoundError, PermissionError) as problem:
                    rows.append((path, piece, None, None, type(problem).__name__))
                    continue
                mark, unit = next((m for m in marks if head.startswith(m[0])), (b"\xef\xbb\xbf", 1))
                first = whole_from(data, 0, mark, unit) if piece else 0
                last = whole_from(data, piece_bytes, mark, unit) if start + piece_bytes < length else len(data)
                stop = whole_from(data, last + ahead_bytes, mark, unit)
                # A mark that tells the encoding; decoding drops one, or two where a code unit has several bytes.
                told = mark if unit == 1 else mark * 2
                rows.append((path, piece, (told if piece else b"") + data[first:last], told + data[last:stop], None))
                size += len(data)
                if size >= batch_bytes:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return contents


def walk(
    spark: SparkSession, roots: Sequence[str], enter: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``root, name, path, length, modification_time, skipped`` of all files below the roots.

    ``enter`` filters a table of directories (``path``) before they are
    listed, which skips whole subtrees.  Links are passed over.  A directory
    that has vanished or must not be read is a row with the reason in
    ``skipped``; any other failure fails the task, so no subtree is lost
    unseen.  Each level is stored, so a lost executor repeats one level only.
    A directory of more than ``PAGE_ENTRIES`` entries is only counted, then
    listed once more in pages by the hash of names, a task each: none holds
    more than about a page, and a repeated task lists the same page.
    """
    for root in roots:
        try:
            fs.FileSystem.from_uri(root)
        except (pa.ArrowInvalid, OSError) as problem:
            raise ValueError(f"{root} cannot be listed by tasks; use include_hidden=False") from problem
    most = spark.sparkContext.defaultParallelism * 4
    tops = [root.rstrip("/") or "/" for root in roots]
    frontier = spark.createDataFrame([(top, None, top, 0, 1) for top in tops], "root string, name string, path string, page int, pages int")
    directories = len(roots)
    levels: list[DataFrame] = []
    while directories:
        if enter is not None:
            frontier = enter(frontier)
        spread = frontier.repartition(min(directories, most), "path", "page")
        levels.append(stored(spread.mapInArrow(_lister(PAGE_ENTRIES), ENTRY_SCHEMA), "listing"))
        below = levels[-1].where("is_dir").select("root", "name", "path", "pages")
        frontier = below.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
        directories = frontier.count()
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.where("NOT is_dir").drop("is_dir", "pages")


def read_contents(listing: DataFrame) -> DataFrame:
    """Add ``content`` to a listing, or the reason in ``skipped`` for files gone or not readable.

    Files are spread by path over as many tasks as their total size needs.
    """
    size = listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    chosen = listing.select("root", "name", "path", "length", "modification_time").repartition(int(tasks), "path")
    return chosen.mapInArrow(_reader(BATCH_BYTES), CONTENT_SCHEMA)


def read_pieces(listing: DataFrame, piece_bytes: int, ahead_bytes: int) -> DataFrame:
    """``path, piece, content, ahead, skipped``: files of any length in pieces of about ``piece_bytes``.

    Cuts fall between characters, and every piece begins with a mark of the
    file's encoding, so it is decoded like a file.  ``ahead`` holds the bytes
    that follow, some ``ahead_bytes``.  Either may be ``CUT_SLACK`` bytes off.  Pieces are read independently of each
    other, in as many tasks as their total size needs.
    """
    if piece_bytes % 4 or ahead_bytes % 4:
        raise ValueError("pieces must hold whole code units of any encoding: use multiples of 4")
    size = listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {piece_bytes}")))
    chosen = listing.where("length > 0").select("root", "name", "path", "length", pieces.alias("piece")).repartition(int(tasks), "path", "piece")
    return chosen.mapInArrow(_piece_reader(piece_bytes, ahead_bytes, BATCH_BYTES), PIECE_SCHEMA)
