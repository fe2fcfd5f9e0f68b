"""What the training-data operators share: Arrow map helpers, tokenisers, shared-folder tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step takes at most (a longer text is a step of its own).
STEP_BYTES = 4 << 20

#: Byte map of the contract's words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased:
#: everything that is not a-z, 0-9 or part of a non-ASCII code point becomes a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII code points, A-Z lower-cased."""
    return text.translate(FOLD).split()


class HashMemo(dict):
    """64-bit hash per word, remembered; emptied when it holds `cap` words, so memory stays bounded."""

    def __init__(self, cap: int = 300_000):
        super().__init__()
        self.cap = cap

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.cap:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Sends this package to the executors, once per application, so that they need no installation of it."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        to = Path(tempfile.mkdtemp(prefix="lakekeel-ship-")) / "lakekeel.zip"
        with zipfile.ZipFile(to, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)
    return df


def arrow_map(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose step yields plain dicts of columns for `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in step(batches):
            arrays = [
                pa.array(columns[f.name], type=f.type, from_pandas=False)
                if not isinstance(columns[f.name], pa.Array)
                else columns[f.name].cast(f.type)
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return ship(df).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one is set only where none is configured and driver and executors are one process (tests)."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakekeel-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakekeel-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranges(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most `limit` (or hold one item)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like these that are not taken, in any case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
