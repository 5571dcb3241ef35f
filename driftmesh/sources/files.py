"""Checkpoints, exports and a VTK writer."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage


def fresh(spark: SparkSession) -> str:
    """A new folder's path under the one that the cluster shares; in local mode, where none is set, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{path}/driftmesh-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: plans stay short, and lost executors don't matter to what is written."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` wrote and that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "written_at", None):
            jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """A checkpoint as Parquet; ``by`` lays it out in folders, which reads can skip."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def save_by_owner(df: DataFrame, path: str, coords: tuple[str, ...]) -> None:
    """A checkpoint in a folder a processor (column proc_id), with a manifest: proc_id, n and the box lo<i>, hi<i> that its rows fill."""
    df.write.mode("overwrite").partitionBy("proc_id").parquet(f"{path}/rows")
    bounds = [f(c).alias(f"{e}{i}") for i, c in enumerate(coords) for e, f in (("lo", F.min), ("hi", F.max))]
    df.groupBy("proc_id").agg(F.count("*").alias("n"), *bounds).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def files_for(spark: SparkSession, path: str, boxes: DataFrame) -> DataFrame:
    """to, proc_id: which of a checkpoint's folders a processor with the box lo<i>, hi<i> (to, hi excluded) has to read; both tables have a row a processor."""
    dims = sum(c.startswith("lo") for c in boxes.columns)
    held, meet = spark.read.parquet(f"{path}/manifest"), F.lit(True)
    for i in range(dims):
        meet = meet & (F.col(f"m.hi{i}") >= F.col(f"b.lo{i}")) & (F.col(f"m.lo{i}") < F.col(f"b.hi{i}"))
    return boxes.alias("b").join(F.broadcast(held.alias("m")), meet).select("b.to", "m.proc_id")


def load_part(spark: SparkSession, path: str, lo: tuple, hi: tuple, coords: tuple[str, ...]) -> DataFrame:
    """The rows of a checkpoint in a box (hi excluded), read from the folders whose boxes meet it; the manifest (a row a writer) names them."""
    box = spark.range(1).select(F.lit(0).alias("to"), *[F.lit(x).alias(f"{e}{i}") for e, xs in (("lo", lo), ("hi", hi)) for i, x in enumerate(xs)])
    names = sorted(r["proc_id"] for r in files_for(spark, path, box).collect())
    rows = spark.read.parquet(f"{path}/rows").where(F.col("proc_id").isin(names))
    for c, x, y in zip(coords, lo, hi, strict=True):
        rows = rows.where((F.col(c) >= x) & (F.col(c) < y))
    return rows.withColumnRenamed("proc_id", "writer")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_frame(df: DataFrame, path: str, iteration: int, time: float | None = None) -> None:
    """Appends one frame of a simulation in its own folder."""
    out = df.withColumn("iteration", F.lit(iteration))
    if time is not None:
        out = out.withColumn("time", F.lit(float(time)))
    out.write.mode("append").partitionBy("iteration").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _VtkWriter(DataSourceWriter):
    """One legacy ASCII file a task.  Rows are streamed to scratch files of the task; the whole file is put under
    ``_temporary`` of the target and gets its name in commit, so that a repeated task leaves one file and a failed job none."""

    def __init__(self, schema, options):
        self.names, self.path, self.kind = schema.names, options["path"], options.get("kind", "points")
        self.coords = options.get("coords", "x,y,z").split(",")
        self.ends = options.get("ends", "").split(",")

    def _points(self, r) -> list[list[float]]:
        """The corners of a row's shape."""
        at = lambda names: [float(r[c]) if c in self.names else 0.0 for c in names]
        if self.kind == "points":
            return [at(self.coords)]
        lo, hi = at(self.coords), at(self.ends)
        if self.kind == "lines":
            return [lo, hi]
        return [[(hi if k >> a & 1 else lo)[a] for a in range(3)] for k in range(8)]  # VTK's voxel order

    def write(self, rows):
        fs, base = FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path)
        scalars = [c for c in self.names if c not in self.coords and c not in self.ends]
        n = corners = 0
        with ExitStack() as stack:
            points, *values = (stack.enter_context(TemporaryFile("w+")) for _ in range(1 + len(scalars)))
            for r in rows:
                shape = self._points(r)
                points.writelines(" ".join(map(str, p)) + "\n" for p in shape)
                for c, f in zip(scalars, values, strict=True):
                    f.write(f"{float('nan') if r[c] is None else float(r[c])}\n")
                n, corners = n + 1, corners + len(shape)
            if not n:
                return _Written([])
            name = f"part-{uuid.uuid4().hex}.vtk"
            fs.create_dir(f"{base}/_temporary", recursive=True)
            with fs.open_output_stream(f"{base}/_temporary/{name}") as out:
                put = lambda text: out.write(text.encode())
                k = corners // n
                unstructured = self.kind == "boxes"
                put(f"# vtk DataFile Version 3.0\n{self.kind}\nASCII\nDATASET {'UNSTRUCTURED_GRID' if unstructured else 'POLYDATA'}\nPOINTS {corners} double\n")
                self._copy(points, put)
                put(f"{'CELLS' if unstructured else 'LINES' if k == 2 else 'VERTICES'} {n} {n * (k + 1)}\n")
                for i in range(n):
                    put(f"{k} {' '.join(str(i * k + j) for j in range(k))}\n")
                if unstructured:
                    put(f"CELL_TYPES {n}\n")
                    for _ in range(n):
                        put("11\n")
                put(f"{'POINT' if k == 1 else 'CELL'}_DATA {n}\n")
                for c, f in zip(scalars, values, strict=True):
                    put(f"SCALARS {c} double 1\nLOOKUP_TABLE default\n")
                    self._copy(f, put)
        return _Written([name])

    @staticmethod
    def _copy(f, put) -> None:
        f.seek(0)
        while text := f.read(1 << 20):
            put(text)

    def _settle(self, messages, keep: bool) -> None:
        fs, base = FileSystem.from_uri(self.path) if "://" in self.path else (LocalFileSystem(), self.path)
        for m in messages:
            for name in m.names if m else ():
                if keep:
                    fs.move(f"{base}/_temporary/{name}", f"{base}/{name}")
                else:
                    fs.delete_file(f"{base}/_temporary/{name}")

    def commit(self, messages):
        self._settle(messages, True)

    def abort(self, messages):
        self._settle(messages, False)


class VtkSource(DataSource):
    """df.write.format("vtk").option("path", folder or URI on storage that executors share).option("coords", "x,y,z")

    kind: points (default), lines or boxes; the latter two have their other end in the columns ``ends``.
    """

    @classmethod
    def name(cls):
        return "vtk"

    def writer(self, schema, overwrite):
        return _VtkWriter(schema, dict(self.options))


def write_vtk(df: DataFrame, path: str, coords: tuple[str, ...] = ("x", "y", "z"), ends: tuple[str, ...] = (), kind: str = "points") -> None:
    """A VTK file a partition of df, with its numeric columns besides the coordinates as scalars."""
    df.sparkSession.dataSource.register(VtkSource)
    df.write.format("vtk").option("path", path).option("coords", ",".join(coords)).option("ends", ",".join(ends)).option("kind", kind).mode("append").save()


#: Points of a piece that a task holds at once, and what the binary part starts with.
POINTS, _DATA = 1 << 16, b'<AppendedData encoding="raw">\n_'

_HEAD = '<?xml version="1.0"?>\n<VTKFile type="{}" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n'


def _place(path: str):
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


class _VtpWriter(DataSourceArrowWriter):
    """A binary VTP piece a task: arrays are streamed to scratch files of the task, then put one after another as appended blocks.

    Pieces get their names in commit, which also writes the index (.pvtp) of all of them.  Integers are Int64 (null: the
    least integer), other numbers Float64 (null: NaN).
    """

    def __init__(self, schema, options):
        self.path, self.name = options["path"], options.get("name", "particles")
        self.coords = options.get("coords", "x,y,z").split(",")
        whole = ("byte", "short", "integer", "long")
        self.fields = [(f.name, "Int64" if f.dataType.typeName() in whole else "Float64") for f in schema if f.name not in self.coords]

    def _array(self, c: pa.Array, kind: str) -> bytes:
        if kind == "Int64":
            return pc.fill_null(c.cast(pa.int64()), -(2**63)).to_numpy().astype("<i8").tobytes()
        return pc.fill_null(c.cast(pa.float64()), float("nan")).to_numpy().astype("<f8").tobytes()

    def write(self, batches):
        fs, base = _place(self.path)
        n = 0
        with ExitStack() as stack:
            spots, *values = (stack.enter_context(TemporaryFile("w+b")) for _ in range(1 + len(self.fields)))
            for b in batches:
                at = [np.frombuffer(self._array(b.column(c), "Float64"), "<f8") if c in b.schema.names else np.zeros(b.num_rows) for c in self.coords]
                spots.write(np.column_stack(at).astype("<f8").tobytes())
                for (c, kind), f in zip(self.fields, values, strict=True):
                    f.write(self._array(b.column(c), kind))
                n += b.num_rows
            if not n:
                return _Written([])
            name, offset, arrays = f"{self.name}-{uuid.uuid4().hex}.vtp", 0, []
            for c, kind, parts, size in (("Points", "Float64", 3, 24 * n), *((c, kind, 1, 8 * n) for c, kind in self.fields), ("connectivity", "Int64", 1, 8 * n), ("offsets", "Int64", 1, 8 * n)):
                arrays.append(f'<DataArray type="{kind}" Name="{c}" NumberOfComponents="{parts}" format="appended" offset="{offset}"/>')
                offset += 8 + size
            fs.create_dir(f"{base}/_temporary", recursive=True)
            with fs.open_output_stream(f"{base}/_temporary/{name}") as out:
                head = f'<PolyData><Piece NumberOfPoints="{n}" NumberOfVerts="{n}" NumberOfLines="0" NumberOfStrips="0" NumberOfPolys="0">\n<Points>{arrays[0]}</Points>\n'
                body = f"<PointData>{''.join(arrays[1:-2])}</PointData>\n<Verts>{''.join(arrays[-2:])}</Verts>\n</Piece></PolyData>\n"
                out.write((_HEAD.format("PolyData") + head + body + '<AppendedData encoding="raw">\n_').encode())
                for f, size in ((spots, 24 * n), *((f, 8 * n) for f in values)):
                    out.write(np.uint64(size).tobytes())
                    f.seek(0)
                    while data := f.read(1 << 20):
                        out.write(data)
                for first in (0, 1):  # each point is a vertex of its own
                    out.write(np.uint64(8 * n).tobytes())
                    for a in range(0, n, 1 << 17):
                        out.write(np.arange(a + first, min(a + (1 << 17), n) + first, dtype="<i8").tobytes())
                out.write(b"\n</AppendedData></VTKFile>\n")
        return _Written([name])

    def commit(self, messages):
        fs, base = _place(self.path)
        names = sorted(name for m in messages if m for name in m.names)
        fs.create_dir(base, recursive=True)
        for name in names:
            fs.move(f"{base}/_temporary/{name}", f"{base}/{name}")
        data = "".join(f'<PDataArray type="{kind}" Name="{c}"/>' for c, kind in self.fields)
        pieces = "".join(f'<Piece Source="{name}"/>\n' for name in names)
        index = f'<PPolyData GhostLevel="0"><PPoints><PDataArray type="Float64" Name="Points" NumberOfComponents="3"/></PPoints><PPointData>{data}</PPointData>\n{pieces}</PPolyData></VTKFile>\n'
        with fs.open_output_stream(f"{base}/{self.name}.pvtp") as out:
            out.write((_HEAD.format("PPolyData") + index).encode())

    def abort(self, messages):
        fs, base = _place(self.path)
        for name in [name for m in messages if m for name in m.names]:
            fs.delete_file(f"{base}/_temporary/{name}")


class VtpSource(DataSource):
    """df.write.format("vtp").option("path", folder or URI).option("coords", "x,y,z").option("name", "particles")"""

    @classmethod
    def name(cls):
        return "vtp"

    def writer(self, schema, overwrite):
        return _VtpWriter(schema, dict(self.options))


def write_vtp(df: DataFrame, path: str, coords: tuple[str, ...] = ("x", "y", "z"), name: str = "particles") -> None:
    """A binary VTP piece a partition of df and an index of them, with numeric columns besides the coordinates as point data."""
    df.sparkSession.dataSource.register(VtpSource)
    df.write.format("vtp").option("path", path).option("coords", ",".join(coords)).option("name", name).mode("append").save()


def read_vtp(spark: SparkSession, path: str, name: str = "particles", coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The points that ``write_vtp`` wrote, through the index; a piece is read by one task, POINTS points at a time.  Without pieces there are no rows."""
    index = "\n".join(r["value"] for r in spark.read.text(f"{path}/{name}.pvtp").collect())  # a line a piece
    fields = re.findall(r'<PDataArray type="(\w+)" Name="([^"]*)"/>', index)
    schema = ", ".join([*(f"{c} double" for c in coords), *(f"`{c}` {'long' if kind == 'Int64' else 'double'}" for kind, c in fields)])
    pieces = re.findall(r'<Piece Source="([^"]*)"/>', index)
    if not pieces:
        return spark.createDataFrame([], schema)
    names = [c for _, c in fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _place(path)
        for b in batches:
            for piece in b.column("piece").to_pylist():
                with fs.open_input_file(f"{base}/{piece}") as f:
                    head = b""
                    while (at := head.find(_DATA)) < 0 and (more := f.read(1 << 16)):
                        head += more
                    start, head = at + len(_DATA), head[:at].decode()
                    n = int(re.search(r'NumberOfPoints="(\d+)"', head)[1])
                    arrays = {m[2]: ("<i8" if m[1] == "Int64" else "<f8", int(m[3])) for m in re.finditer(r'type="(\w+)" Name="([^"]*)" NumberOfComponents="\d" format="appended" offset="(\d+)"', head)}

                    def take(c: str, first: int, k: int, parts: int = 1, f=f, arrays=arrays, start=start) -> np.ndarray:
                        kind, offset = arrays[c]
                        f.seek(start + offset + 8 + 8 * parts * first)
                        return np.frombuffer(f.read(8 * parts * k), kind)

                    for first in range(0, n, POINTS):
                        k = min(POINTS, n - first)
                        spots = take("Points", first, k, 3).reshape(k, 3)
                        cols = [*(np.ascontiguousarray(spots[:, i]) for i in range(3)), *(take(c, first, k) for c in names)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*coords, *names])

    return spark.createDataFrame([(x,) for x in pieces], "piece string").repartitionByRange(len(pieces), "piece").mapInArrow(parse, schema)


def write_subset(df: DataFrame, path: str, flag: str = "subset") -> None:
    """As CSV with the subset's number under the name that viewers know."""
    write_csv(df.withColumnRenamed(flag, "SubsetNumber"), path)


def write_grid(grid: DataFrame, path: str, axes: tuple[str, ...], spacing: tuple, low: tuple, ghost: DataFrame | None = None) -> None:
    """Nodes as VTK points at their places; with ``ghost`` also the halo, told apart by is_ghost."""
    out = grid if ghost is None else grid.withColumn("is_ghost", F.lit(0)).unionByName(ghost.select(*grid.columns).withColumn("is_ghost", F.lit(1)))
    names = ("x", "y", "z")[: len(axes)]
    at = [(F.col(a) * s + lo).alias(x) for a, s, lo, x in zip(axes, spacing, low, names, strict=True)]
    write_vtk(out.select(*at, *[c for c in out.columns if c not in axes]), path, names + ("z",) * (len(names) == 2))


def write_levels(amr: DataFrame, path: str) -> None:
    """A refinement hierarchy, one folder a level."""
    save(amr, path, "lvl")


def write_staggered(faces: DataFrame, path: str, axes: tuple[str, ...], places: dict[str, list[tuple]]) -> None:
    """A staggered grid, one folder a component, each value at its own place: half a cell along every axis on which it is staggered."""
    rows = [
        F.struct(F.lit(c).alias("component"), *[(F.col(a) + (0.0 if o[i] < 0 else 0.5)).alias(x) for i, (a, x) in enumerate(zip(axes, "xyz", strict=False))], F.col(c).cast("double").alias("value"))
        for c, offs in places.items() for o in offs[:1]
    ]
    save(faces.select(F.explode(F.array(*rows)).alias("r")).select("r.*"), path, "component")


def write_decomposition(boxes: DataFrame, near: DataFrame, ghost: DataFrame, path: str) -> None:
    """Sub-domains as VTK boxes, processors' neighbours and ghost boxes as CSV, in three folders."""
    dims = sum(c.startswith("lo") for c in boxes.columns)
    write_vtk(boxes, f"{path}/subdomains", tuple(f"lo{i}" for i in range(dims)), tuple(f"hi{i}" for i in range(dims)), "boxes")
    write_csv(near, f"{path}/near")
    write_csv(ghost, f"{path}/ghosts")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, axes: tuple[str, ...]) -> None:
    """Vertices with their owners as VTK points, edges as VTK lines between their ends' places."""
    pad = tuple(axes) + ("__z",) * (3 - len(axes))
    write_vtk(vertices.select(*axes, "gid", "proc_id"), f"{path}/vertices", pad)
    for c, e in (("src", "a"), ("dst", "b")):
        edges = edges.join(vertices.select(F.col("gid").alias(c), *[F.col(a).alias(f"{e}_{a}") for a in axes]), c)
    ends = [tuple(f"{e}_{a}" for a in pad) for e in ("a", "b")]
    write_vtk(edges.select("src", "dst", *[x for end in ends for x in end[: len(axes)]]), f"{path}/edges", *ends, "lines")
