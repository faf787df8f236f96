"""Files that Spark has no reader or writer for: stores of ragged arrays, and a text file for each group; both are committed whole or not at all."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..plans.materialize import col

#: Bytes of values of one partition of a store, and of one file that is written.
PART_BYTES = 64 << 20
#: Bytes of values that a reader holds at once.
BATCH_BYTES = 4 << 20
ATTEMPTS = "_attempts"


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- ragged stores


@dataclass(frozen=True)
class Block:
    """An array inside a store file: where its numbers begin, how many there are, and of what kind."""

    start: int
    count: int
    kind: str

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize

    def read(self, f, first: int, last: int) -> np.ndarray:
        """Numbers from first up to last, and no other bytes."""
        f.seek(self.start + first * self.width)
        return np.frombuffer(f.read((last - first) * self.width), dtype=self.kind)


def blocks(f) -> dict[str, Block]:
    """The arrays of a zip of npy members, by name; only directories and headers are read. Members that are compressed, or not one-dimensional, are an error."""
    out = {}
    with zipfile.ZipFile(f) as z:
        for m in z.infolist():
            if m.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{m.filename} is compressed, so no range of it can be read")
            f.seek(m.header_offset + 26)
            lengths = np.frombuffer(f.read(4), dtype="<u2")
            at = m.header_offset + 30 + int(lengths.sum())
            f.seek(at)
            head = io.BytesIO(f.read(min(m.file_size, 1 << 16)))
            version = np.lib.format.read_magic(head)
            shape, _, kind = np.lib.format.read_array_header_1_0(head) if version == (1, 0) else np.lib.format.read_array_header_2_0(head)
            if len(shape) != 1:
                raise ValueError(f"{m.filename} has {len(shape)} dimensions")
            out[m.filename.removesuffix(".npy")] = Block(at + head.tell(), shape[0], kind.str)
    return out


def cuts(f, offsets: Block, part_values: int) -> list[int]:
    """Rows at which a store is cut so that a part has about part_values values: each found by binary search in the offsets, without reading them all."""
    rows = offsets.count - 1
    at = lambda i: int(offsets.read(f, i, i + 1)[0])
    out, total = [0], at(rows) if rows > 0 else 0
    for want in range(part_values, total, part_values):
        low, high = out[-1], rows
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if at(middle) < want else (low, middle)
        if out[-1] < low < rows:
            out.append(low)
    return [*out, rows]


def store_rows(f, arrays: dict[str, Block], first: int, last: int, wanted: frozenset[str] | None = None, batch_bytes: int = BATCH_BYTES) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """(ids, values) of rows from first up to last, in batches; of values only the ranges of wanted ids are read, neighbouring ones together."""
    ids, offsets, values = arrays["ids"], arrays["offsets"], arrays["values"]
    step = max(1, batch_bytes // max(ids.width, 8))
    for begin in range(first, last, step):
        end = min(last, begin + step)
        names = [x if isinstance(x, str) else x.decode() if isinstance(x, bytes) else str(x) for x in ids.read(f, begin, end).tolist()]
        at = offsets.read(f, begin, end + 1).astype(np.int64).tolist()
        keep = [i for i, name in enumerate(names) if wanted is None or name in wanted]
        k = 0
        while k < len(keep):
            j = k + 1
            while j < len(keep) and keep[j] == keep[j - 1] + 1 and (at[keep[j] + 1] - at[keep[k]]) * values.width <= batch_bytes:
                j += 1
            low = at[keep[k]]
            some = values.read(f, low, at[keep[j - 1] + 1])
            yield [names[i] for i in keep[k:j]], [some[at[i] - low : at[i + 1] - low] for i in keep[k:j]]
            k = j


@dataclass
class StoreRange(InputPartition):
    path: str
    first: int
    last: int


class RaggedStore(DataSource):
    """Format "ragged_store": (store, id, values) of npz files with the arrays ids, offsets (one more than ids) and values; a file or a folder of them.

    Options: path; ids, offsets, values: names of the arrays; part_bytes; pushdown: whether filters id = x and id IN (...) are taken over, so that only values of these rows are
    read (read_store() sets it where spark.sql.python.filterPushdown.enabled is on). Written rows (id, values) become files of about part_bytes each; null ids are "" and null values empty. Ids may repeat. A store without rows gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "ragged_store"

    def schema(self) -> str:
        return "store string, id string, values array<float>"

    def reader(self, schema) -> StoreReader:
        return (PushingStoreReader if self.options.get("pushdown") == "true" else StoreReader)(self.options)

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], overwrite, int(self.options.get("part_bytes", PART_BYTES)))


class StoreReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.wanted = options["path"], None
        self.names = {n: options.get(n, n) for n in ("ids", "offsets", "values")}
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def _arrays(self, f) -> dict[str, Block]:
        found = blocks(f)
        return {n: found[x] for n, x in self.names.items()}

    def partitions(self) -> list[StoreRange]:
        fs, path = _file_system(self.path)
        info = fs.get_file_info(path)
        if info.type == pa.fs.FileType.Directory:
            files = sorted(x.path for x in fs.get_file_info(pa.fs.FileSelector(path)) if x.type == pa.fs.FileType.File and x.base_name.endswith(".npz"))
        else:
            files = [path]
        out = []
        for file in files:
            with fs.open_input_file(file) as f:
                arrays = self._arrays(f)
                if arrays["ids"].count + 1 != arrays["offsets"].count:
                    raise ValueError(f"{file}: {arrays['offsets'].count} offsets of {arrays['ids'].count} ids")
                at = cuts(f, arrays["offsets"], max(1, self.part_bytes // arrays["values"].width))
            out += [StoreRange(file, a, b) for a, b in zip(at, at[1:], strict=False) if a < b]
        return out or [StoreRange("", 0, 0)]

    def read(self, part: StoreRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = _file_system(self.path)
        schema = pa.schema([("store", pa.string()), ("id", pa.string()), ("values", pa.list_(pa.float32()))])
        name = part.path.rsplit("/", 1)[-1]
        with fs.open_input_file(part.path) as f:
            for ids, values in store_rows(f, self._arrays(f), part.first, part.last, self.wanted):
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([*values, np.empty(0)]).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids), lists], schema=schema)


class PushingStoreReader(StoreReader):
    """Takes filters of ids over; Spark lets a reader do so only where its setting is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if isinstance(x, (EqualTo, In)) and x.attribute == ("id",):
                ids = frozenset([x.value] if isinstance(x, EqualTo) else x.value)
                self.wanted = ids if self.wanted is None else self.wanted & ids
            else:
                yield x


# ---------------------------------------------------------------- writers that commit


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class AttemptWriter(DataSourceArrowWriter):
    """Each task writes into a folder of its own under _attempts; commit moves the folders of the tasks that count to their place, and what other attempts left goes.

    A task that fails, or that another attempt of the same partition overtakes, leaves nothing behind: its folder is not in the commit.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def files(self, batches: Iterator[pa.RecordBatch], put: Callable[[str, bytes], None], stream: Callable) -> int:
        """Write this task's files; how many."""
        raise NotImplementedError

    def finished(self, fs: pa.fs.FileSystem, base: str, folders: list[str]) -> None:
        """After the folders have been moved."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _file_system(self.path)
        name = uuid.uuid4().hex
        folder = f"{base}/{ATTEMPTS}/{self.job}/{name}"
        fs.create_dir(folder, recursive=True)

        def put(file: str, data: bytes) -> None:
            with fs.open_output_stream(f"{folder}/{file}") as f:
                f.write(data)

        return Written(name, self.files(batches, put, lambda file: fs.open_output_stream(f"{folder}/{file}")))

    def _sweep(self, fs: pa.fs.FileSystem, base: str) -> None:
        fs.delete_dir(f"{base}/{ATTEMPTS}/{self.job}")
        if not fs.get_file_info(pa.fs.FileSelector(f"{base}/{ATTEMPTS}")):
            fs.delete_dir(f"{base}/{ATTEMPTS}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _file_system(self.path)
        old = [x for x in fs.get_file_info(pa.fs.FileSelector(base, allow_not_found=True)) if x.base_name != ATTEMPTS]
        if old and not self.overwrite:
            old = []
        folders = []
        for n, m in enumerate(messages):
            if m is not None and m.files:
                fs.move(f"{base}/{ATTEMPTS}/{self.job}/{m.folder}", f"{base}/part-{self.job}-{n:05}")
                folders.append(f"{base}/part-{self.job}-{n:05}")
        for x in old:
            fs.delete_dir(x.path) if x.type == pa.fs.FileType.Directory else fs.delete_file(x.path)
        fs.create_dir(base, recursive=True)
        self.finished(fs, base, folders)
        if fs.get_file_info(f"{base}/{ATTEMPTS}/{self.job}").type == pa.fs.FileType.Directory:
            self._sweep(fs, base)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _file_system(self.path)
        if fs.get_file_info(f"{base}/{ATTEMPTS}/{self.job}").type == pa.fs.FileType.Directory:
            self._sweep(fs, base)


class StoreWriter(AttemptWriter):
    def __init__(self, path: str, overwrite: bool, part_bytes: int) -> None:
        super().__init__(path, overwrite)
        self.part_bytes = part_bytes

    def files(self, batches, put, stream) -> int:
        ids, values, size, n = [], [], 0, 0

        def close() -> None:
            nonlocal ids, values, size, n
            out = io.BytesIO()
            np.savez(out, ids=np.array(ids, dtype="U"), offsets=np.cumsum([0, *map(len, values)]).astype(np.int64), values=np.concatenate(values).astype(np.float32))
            put(f"{n:05}.npz", out.getvalue())
            ids, values, size, n = [], [], 0, n + 1

        for b in batches:
            names = dict(zip(b.schema.names, b.columns, strict=True))
            for name, v in zip(names["id"].to_pylist(), names["values"], strict=True):
                v = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0)
                ids.append("" if name is None else str(name))
                values.append(v)
                size += 4 * len(v) + 8
                if size >= self.part_bytes:
                    close()
        if ids:
            close()
        return n

    def finished(self, fs, base, folders) -> None:
        """Files of the tasks side by side: a store is one flat folder."""
        for folder in folders:
            for x in fs.get_file_info(pa.fs.FileSelector(folder)):
                fs.move(x.path, f"{base}/{folder.rsplit('/', 1)[-1]}-{x.base_name}")
            fs.delete_dir(folder)


class GroupFiles(DataSource):
    """Format "group_files": rows (base, line), each base's rows together and in order, become one text file a base, and index.tsv says which.

    Options: path; least: bases with fewer lines have no file; suffix. Use write_groups(), which puts rows in order.
    """

    @classmethod
    def name(cls) -> str:
        return "group_files"

    def writer(self, schema, overwrite: bool) -> GroupWriter:
        return GroupWriter(self.options["path"], overwrite, int(self.options.get("least", 1)), self.options.get("suffix", "_members.txt"))


class GroupWriter(AttemptWriter):
    HEAD = "base\tn\tfile\n"

    def __init__(self, path: str, overwrite: bool, least: int, suffix: str) -> None:
        super().__init__(path, overwrite)
        self.least, self.suffix = least, suffix

    def files(self, batches, put, stream) -> int:
        index, now, held, out, n, files = None, None, [], None, 0, 0

        def close() -> None:
            nonlocal out, held, n, files, index
            if out is not None:
                out.close()
                files += 1
                index = index or stream("_index.tsv")
                index.write(f"{now}\t{n}\t{quote(now, safe=' ')}{self.suffix}\n".encode())
            out, held, n = None, [], 0

        for b in batches:
            for base, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if base != now:
                    close()
                    now = base
                n += 1
                held.append(line)
                if n >= self.least:  # so few lines are held, whatever the base's size
                    out = out or stream(f"{quote(base, safe=' ')}{self.suffix}")
                    out.write("".join(x + "\n" for x in held).encode())
                    held = []
        close()
        if index is not None:
            index.close()
        return files

    def finished(self, fs, base, folders) -> None:
        with fs.open_output_stream(f"{base}/index.tsv") as out:
            out.write(self.HEAD.encode())
            for folder in folders:
                with fs.open_input_stream(f"{folder}/_index.tsv") as f:
                    for line in f.read().decode().splitlines():
                        name, n, file = line.split("\t")
                        out.write(f"{name}\t{n}\t{folder.rsplit('/', 1)[-1]}/{file}\n".encode())
                fs.delete_file(f"{folder}/_index.tsv")


def register(spark: SparkSession) -> None:
    for source in (RaggedStore, GroupFiles):
        spark.dataSource.register(source)


def write_groups(rows: DataFrame, base: str, line: str, path: str, least: int = 2, suffix: str = "_members.txt") -> None:
    """A file for each base with `least` different lines or more, which are in order, and index.tsv (base, n, file). Null bases and lines are left out; what stood at path goes."""
    register(rows.sparkSession)
    slim = rows.select(col(base).cast("string").alias("base"), col(line).cast("string").alias("line")).where("base is not null and line is not null").distinct()
    slim.repartition("base").sortWithinPartitions("base", "line").write.format("group_files").mode("overwrite").option("least", least).option("suffix", suffix).save(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(base, n, file, line): the index of write_groups() and the lines of its files."""
    index = spark.read.csv(f"{path}/index.tsv", sep="\t", header=True, schema="base string, n long, file string")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select(F.col("value").alias("line"), F.array_join(F.slice(F.split("_metadata.file_path", "/"), -2, 2), "/").alias("at"))
    return index.join(lines, F.replace("file", F.lit("%"), F.lit("%25")) == F.replace("at", F.lit("%20"), F.lit(" "))).select("base", "n", "file", "line")


def write_store(rows: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """rows (id, values) as a ragged store; what stood at path goes."""
    register(rows.sparkSession)
    rows.select(F.col("id").cast("string").alias("id"), F.col("values").cast("array<float>").alias("values")).write.format("ragged_store").mode("overwrite").option("part_bytes", part_bytes).save(path)


def read_store(spark: SparkSession, path: str, **options) -> DataFrame:
    """(store, id, values) of a ragged store; see RaggedStore for its options."""
    register(spark)
    pushdown = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format("ragged_store").options(path=path, pushdown=pushdown, **options).load()
