"""A data source of chunks from paged object listings, for batches and streams.

A bucket is read in ranges of about RANGE objects, a partition each: the range's pages are read one after another, objects are grouped by prefix, and the last group of a
page that is not the last is held back, since it may go on. A chunk is there once it has its last-written file; a last group without it is still being written and gives no row,
anywhere else it is `incomplete`. A chunk that does not begin right after the one before, or after the resume point, is a `gap`; a range looks back for the whole chunk before it.

A stream's offset is the last whole chunk of each bucket; it is found from the end of the listing, so a trigger lists what is new and no more, and a
restarted stream goes on after its offset.

Places in a bucket are compared as keys: a chunk lies at its prefix with a slash, so that no range splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "dataset string, prefix string, first_block bigint, last_block bigint, size bigint, n_files int, state string"
#: Objects a page holds, as in the listing protocol.
PAGE = 1000
#: Objects of a bucket that one partition lists.
RANGE = 500_000
#: The file of a chunk that is written last.
REQUIRED = "blocks.parquet"


def manifest(path: str):
    """A lister over inventories: Parquet files (key, size) under path/bucket=.../, sorted by key within each file. Row groups are found by the statistics in
    the footers and read when a walk comes to them, so a page costs what it holds, wherever it lies."""

    class Manifest:
        def __init__(self):
            self._walks: dict = {}  # where the last page of a bucket ended, with the walk that goes on from there

        def _folder(self, bucket: str | None = None):
            import pyarrow.fs as pf

            fs, root = pf.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else f"file://{path}")
            return fs, fs.get_file_info(pf.FileSelector(root if bucket is None else f"{root}/bucket={bucket}"))

        def buckets(self) -> list[str]:
            return sorted(i.base_name.partition("=")[2] for i in self._folder()[1] if i.base_name.startswith("bucket="))

        def _groups(self, bucket: str) -> list:
            """(least key, largest key or None if unknown, rows, reader of the rows) of each row group."""
            import pyarrow.parquet as pq

            def reader(file, i):
                def read():
                    rows = file.read_row_group(i, columns=["key", "size"])
                    return list(zip(rows.column("key").to_pylist(), rows.column("size").to_pylist(), strict=True))

                return read

            fs, infos = self._folder(bucket)
            out = []
            for one in sorted(i.path for i in infos if i.base_name.endswith(".parquet")):
                file = pq.ParquetFile(one, filesystem=fs)
                at = file.schema_arrow.names.index("key")
                for i in range(file.num_row_groups):
                    group = file.metadata.row_group(i)
                    known = group.column(at).statistics
                    least, most = (known.min, known.max) if known is not None and known.has_min_max else ("", None)
                    out.append((least, most, group.num_rows, reader(file, i)))
            return out

        def cuts(self, bucket: str, rows: int) -> list[str]:
            """Keys that cut a bucket into ranges of about that many objects."""
            out, n = [], 0
            for least, _, size, _ in sorted(self._groups(bucket), key=lambda g: g[0]):
                if n >= rows:
                    out.append(least)
                    n = 0
                n += size
            return out

        def walk(self, bucket: str, after: str):
            """Objects beyond a key, in order; row groups are merged where they overlap."""
            import heapq

            todo = sorted((g for g in self._groups(bucket) if g[1] is None or g[1] > after), key=lambda g: g[0], reverse=True)
            runs: list = []
            while todo or runs:
                while todo and (not runs or todo[-1][0] <= runs[0][0][0]):
                    _, most, _, read = todo.pop()
                    rows = iter([r for r in read() if r[0] > after])
                    if not runs and (not todo or most is not None and most < todo[-1][0]):  # nothing overlaps it
                        yield from rows
                        continue
                    if first := next(rows, None):
                        heapq.heappush(runs, (first, len(todo), rows))
                if not runs:
                    continue
                first, number, rows = runs[0]
                yield first
                if following := next(rows, None):
                    heapq.heapreplace(runs, (following, number, rows))
                else:
                    heapq.heappop(runs)

        def page(self, bucket: str, after: str, limit: int):
            """The first objects beyond a key, and whether there are more."""
            from itertools import islice

            at, following, rows = self._walks.pop(bucket, (None, None, None))
            if at != after:
                rows = self.walk(bucket, after)
                following = next(rows, None)
            if following is None:
                return [], False
            out = [following, *islice(rows, limit - 1)]
            following = next(rows, None)
            if following is not None:
                self._walks[bucket] = out[-1][0], following, rows
            return out, following is not None

        def last(self, bucket: str, file: str, upto: str | None = None):
            """The last key with this file name, of folders up to `upto`; row groups are read from the end."""
            best = None
            for least, most, _, read in sorted(self._groups(bucket), key=lambda g: (g[1] is None, g[1] or ""), reverse=True):
                if best is not None and most is not None and most <= best:
                    break
                if upto is None or f"{least.rpartition('/')[0]}/" <= upto:
                    found = [k for k, _ in read() if k.rpartition("/")[2] == file and (upto is None or f"{k.rpartition('/')[0]}/" <= upto)]
                    best = max([*found, *([] if best is None else [best])], default=None)
            return best

    return Manifest()


def chunk_source(lister, name: str = "chunk_listing") -> type[DataSource]:
    """The source over a lister, to be registered with a session; a class of its own, so that it travels with the query."""
    schema, page_size, range_size, required = SCHEMA, PAGE, RANGE, REQUIRED

    def blocks(prefix: str) -> tuple[int, int]:
        first, last = prefix.rpartition("/")[2].split("-")[:2]
        return int(first), int(last)

    def groups(bucket: str, after: str, limit: int):
        """(prefix, objects, is the last of the bucket), page by page."""
        held: list = []
        while True:
            page, more = lister.page(bucket, after, limit)
            held += page
            if page:
                after = page[-1][0]
            at = 0
            while at < len(held):
                folder = held[at][0].rpartition("/")[0] + "/"
                end = at
                while end < len(held) and held[end][0].startswith(folder):
                    end += 1
                if end == len(held) and more:
                    break  # may go on with the next page
                yield folder[:-1], held[at:end], end == len(held)
                at = end
            held = held[at:]
            if not more:
                return

    def chunks(part, limit: int):
        """Rows of the chunks of a range."""
        seen = part.resume
        if part.start != place(part.resume):
            found = (lister.last(part.bucket, required, part.start) or "").rpartition("/")[0]
            seen = max(found, part.resume, key=place)
        expected = blocks(seen)[1] + 1 if seen else None
        for prefix, objects, last in groups(part.bucket, part.start, limit):
            if place(prefix) <= part.start:
                continue
            if part.until is not None and place(prefix) > part.until:
                return
            whole = any(key.endswith(required) and key.rpartition("/")[2] == required for key, _ in objects)
            if not whole and last:
                return
            first, end = blocks(prefix)
            state = "incomplete" if not whole else "gap" if expected is not None and first != expected else "ok"
            if whole:
                expected = end + 1
            yield f"s3://{part.bucket}", prefix, first, end, sum(size for _, size in objects), len(objects), state

    def place(prefix: str) -> str:
        return f"{prefix}/" if prefix else ""

    class Range(InputPartition):
        """Chunks at places beyond start up to until (None: all), of those after the resume point's prefix."""

        def __init__(self, bucket: str, resume: str, start: str, until: str | None):
            self.bucket, self.resume, self.start, self.until = bucket, resume, start, until

    def ranges(bucket: str, resume: str, until: str | None, rows: int) -> list[Range]:
        inner = [c for c in lister.cuts(bucket, rows) if c > place(resume) and (until is None or c < place(until))]
        ends = [place(resume), *inner, None if until is None else place(until)]
        return [Range(bucket, resume, a, b) for a, b in zip(ends, ends[1:])]

    class Batch(DataSourceReader):
        def __init__(self, limit: int, rows: int):
            self.limit, self.rows = limit, rows

        def partitions(self):
            return [r for b in lister.buckets() for r in ranges(b, "", None, self.rows)]

        def read(self, partition):
            return chunks(partition, self.limit)

    class Stream(DataSourceStreamReader):
        def __init__(self, limit: int, rows: int):
            self.limit, self.rows = limit, rows

        def initialOffset(self):
            return {}

        def latestOffset(self):
            found = {b: lister.last(b, required) for b in lister.buckets()}
            return {b: key.rpartition("/")[0] for b, key in found.items() if key is not None}

        def partitions(self, start, end):
            return [r for b, until in end.items() if place(until) > place(start.get(b, "")) for r in ranges(b, start.get(b, ""), until, self.rows)]

        def read(self, partition):
            return chunks(partition, self.limit)

        def commit(self, end):
            pass

    class Chunks(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def _sizes(self) -> tuple[int, int]:
            return int(self.options.get("page", page_size)), int(self.options.get("range", range_size))

        def reader(self, schema):
            return Batch(*self._sizes())

        def streamReader(self, schema):
            return Stream(*self._sizes())

    return Chunks


def read_chunks(spark: SparkSession, lister, page: int = PAGE, stream: bool = False, rows: int = RANGE) -> DataFrame:
    """The chunks of all buckets, as a batch or a stream."""
    spark.dataSource.register(chunk_source(lister))
    reader = spark.readStream if stream else spark.read
    return reader.format("chunk_listing").option("page", str(page)).option("range", str(rows)).load()
