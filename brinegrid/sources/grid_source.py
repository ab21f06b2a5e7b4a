"""Array files as long grid tables: a Python data source for NetCDF classic files and Zarr v2 stores.

    spark.dataSource.register(GridDataSource)
    spark.read.format("brine_grid").option("path", p).option("variable", "thetao").load()

Rows: file, ti, t, j, i, lat, lon, v; dense, with nulls where the array has none. One input partition per stored chunk
of time slices. Options: path (comma list; folders are Zarr stores), variable (else thetao, sst, tos, else the first with
three or four dimensions), depth_index (else the level closest to 0), bbox (`lat0,lat1,lon0,lon1`, both ends included).
With a bbox only its rows (NetCDF) or the chunks that it touches (Zarr) are read, and of four dimensions only one level.
Paths with a scheme are opened by pyarrow's file systems (HDFS, S3, GCS), others are local. NetCDF-4 (HDF5) needs the
optional package h5py and raises without it.
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..columns import GRID_VARIABLES

SCHEMA = "file string, ti int, t timestamp_ntz, j int, i int, lat double, lon double, v double"
# NetCDF classic type codes.
_NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
# Names of coordinate variables.
_TIME, _DEPTH, _LAT, _LON = ("time",), ("depth", "lev", "level"), ("latitude", "lat"), ("longitude", "lon", "long")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _read_all(files: pafs.FileSystem, path: str) -> bytes:
    with files.open_input_file(path) as f:
        return f.read()


class NetCDF:
    """A NetCDF classic file (CDF-1, -2, -5): header, attributes, and slices of variables along the first dimension."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.at = located(path)
        with self.files.open_input_file(self.at) as f:
            head = f.read(4)
            if head[:3] != b"CDF":
                raise ValueError(f"{path}: not a NetCDF classic file")
            self._wide = head[3] == 5
            self._off = ">i4" if head[3] == 1 else ">i8"
            self._f = f
            self.records = self._count()
            self.dims = [(n, s) for n, s in self._list(lambda: (self._name(), self._count()))]
            self.attrs = self._attributes()
            self.vars = {v["name"]: v for v in self._list(self._variable)}
        self._f = None
        self.record_size = sum(v["vsize"] for v in self.vars.values() if v["record"])
        only = [v for v in self.vars.values() if v["record"]]
        if len(only) == 1:  # a single record variable is not padded
            self.record_size = int(np.prod([s for _, s in only[0]["dims"][1:]], dtype=np.int64)) * np.dtype(only[0]["type"]).itemsize

    def _int(self, kind: str) -> int:
        return int(np.frombuffer(self._f.read(np.dtype(kind).itemsize), kind)[0])

    def _count(self) -> int:
        return self._int(">i8" if self._wide else ">i4")

    def _name(self) -> str:
        n = self._count()
        return self._f.read(n + -n % 4)[:n].decode()

    def _list(self, one) -> list:
        self._int(">i4")
        return [one() for _ in range(self._count())]

    def _attributes(self) -> dict:
        def one():
            name, kind, n = self._name(), np.dtype(_NC_TYPES[self._int(">i4")]), self._count()
            size = n * kind.itemsize
            raw = self._f.read(size + -size % 4)[:size]
            return name, raw.decode("utf-8", "replace").rstrip("\0") if kind.kind == "S" else np.frombuffer(raw, kind).tolist()

        return {k: v[0] if isinstance(v, list) and len(v) == 1 else v for k, v in self._list(one)}

    def _variable(self) -> dict:
        name = self._name()
        dims = [self.dims[self._count()] for _ in range(self._count())]
        attrs, kind, vsize = self._attributes(), _NC_TYPES[self._int(">i4")], self._count()
        begin = self._int(self._off)
        return {"name": name, "dims": dims, "attrs": attrs, "type": kind, "vsize": vsize, "begin": begin, "record": bool(dims) and dims[0][1] == 0}

    def shape(self, name: str) -> list[int]:
        v = self.vars[name]
        return [self.records if s == 0 else s for _, s in v["dims"]]

    def read(self, name: str, window: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
        """A variable, or the part of it within (from, to) for its first dimensions. Whole rows of the last dimension are read."""
        v, shape = self.vars[name], self.shape(name)
        kind = np.dtype(v["type"])
        with self.files.open_input_file(self.at) as f:
            if not shape:
                f.seek(v["begin"])
                return np.frombuffer(f.read(kind.itemsize), kind)[0]
            full = [*window, *((0, n) for n in shape[len(window) :])]
            steps = [int(np.prod(shape[k + 1 :], dtype=np.int64)) * kind.itemsize for k in range(len(shape))]
            if v["record"]:
                steps[0] = self.record_size
            lead = full[: max(len(full) - 2, int(v["record"]))]
            rest = full[len(lead) :]  # a block of rows, a row, or a single value, for each index of the others
            (low, high), step = (rest[0], steps[len(lead)]) if rest else ((0, 1), kind.itemsize)
            parts = []
            for idx in np.ndindex(*[z - a for a, z in lead]):
                f.seek(v["begin"] + sum((a + i) * n for (a, _), i, n in zip(lead, idx, steps)) + low * step)
                parts.append(np.frombuffer(f.read((high - low) * step), kind))
        flat = np.concatenate(parts) if parts else np.zeros(0, kind)
        out = flat.reshape([z - a for a, z in full[:-1]] + [shape[-1] if len(rest) == 2 else -1])
        return out[..., full[-1][0] : full[-1][1]] if len(rest) == 2 else out.reshape([z - a for a, z in full])

    def names(self) -> list[str]:
        return list(self.vars)

    def dim_names(self, name: str) -> list[str]:
        return [n for n, _ in self.vars[name]["dims"]]

    def var_attrs(self, name: str) -> dict:
        return self.vars[name]["attrs"]

    def time_chunk(self, name: str) -> int:
        return 1


class Zarr:
    """A Zarr v2 store in a folder: uncompressed, zlib, gzip, zstd or blosc chunks."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.at = located(path.rstrip("/"))
        self.meta = {}
        for n in sorted(f.base_name for f in self.files.get_file_info(pafs.FileSelector(self.at)) if f.type == pafs.FileType.Directory):
            if self._there(m := f"{self.at}/{n}/.zarray"):
                self.meta[n] = json.loads(_read_all(self.files, m))
        if not self.meta:
            raise ValueError(f"{path}: no Zarr v2 arrays")

    def _there(self, path: str) -> bool:
        return self.files.get_file_info(path).type == pafs.FileType.File

    def names(self) -> list[str]:
        return list(self.meta)

    def var_attrs(self, name: str) -> dict:
        p = f"{self.at}/{name}/.zattrs"
        return json.loads(_read_all(self.files, p)) if self._there(p) else {}

    def dim_names(self, name: str) -> list[str]:
        return self.var_attrs(name).get("_ARRAY_DIMENSIONS", [])

    def shape(self, name: str) -> list[int]:
        return self.meta[name]["shape"]

    def time_chunk(self, name: str) -> int:
        return self.meta[name]["chunks"][0]

    def _chunk(self, name: str, idx: tuple) -> np.ndarray:
        m = self.meta[name]
        kind = np.dtype(m["dtype"])
        fill = m["fill_value"]
        if isinstance(fill, str):
            fill = float(fill.replace("Infinity", "inf"))
        path = f"{self.at}/{name}/" + m.get("dimension_separator", ".").join(map(str, idx))
        if not self._there(path):
            return np.full(m["chunks"], np.nan if fill is None else fill, dtype=kind if fill is not None or kind.kind == "f" else "f8")
        raw = _read_all(self.files, path)
        how = (m.get("compressor") or {}).get("id")
        if m.get("filters"):
            raise ValueError(f"{self.path}: filters are not read")
        if how == "zlib":
            raw = zlib.decompress(raw)
        elif how == "gzip":
            raw = gzip.decompress(raw)
        elif how == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=int(np.prod(m["chunks"])) * kind.itemsize)
        elif how == "blosc":
            raw = unblosc(raw)
        elif how:
            raise ValueError(f"{self.path}: compressor {how} is not read")
        return np.frombuffer(raw, kind).reshape(m["chunks"], order=m.get("order", "C"))

    def read(self, name: str, window: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
        """An array, or the part of it within (from, to) for its first dimensions. Only chunks that hold some of it are read."""
        m = self.meta[name]
        shape, chunks = m["shape"], m["chunks"]
        full = [*window, *((0, n) for n in shape[len(window) :])]
        out = np.empty([z - a for a, z in full], dtype=np.dtype(m["dtype"]))
        for idx in np.ndindex(*[-(-z // c) - a // c if z > a else 0 for (a, z), c in zip(full, chunks)]):
            at = [a // c + k for (a, _), c, k in zip(full, chunks, idx)]
            span = [(max(a, k * c), min(z, (k + 1) * c)) for (a, z), c, k in zip(full, chunks, at)]
            block = self._chunk(name, tuple(at))
            out[tuple(slice(x - a, y - a) for (x, y), (a, _) in zip(span, full))] = block[tuple(slice(x - k * c, y - k * c) for (x, y), c, k in zip(span, chunks, at))]
        return out


# How blosc numbers its compressors, with what reads them here.
_BLOSC = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def unblosc(raw: bytes) -> bytes:
    """The content of a blosc 1 buffer. Of its compressors, blosclz is not read."""
    _, _, flags, size, total, block, _ = struct.unpack("<BBBBIII", raw[:16])
    if flags & 2:  # stored as it is
        return raw[16 : 16 + total]
    codec = _BLOSC.get(flags >> 5)
    if codec is None:
        raise ValueError("blosc with blosclz is not read")

    def plain(part: bytes, n: int) -> bytes:
        if len(part) == n:
            return part
        return zlib.decompress(part) if codec == "zlib" else pa.decompress(part, n, codec, asbytes=True)

    out = []
    for k, at in enumerate(struct.unpack(f"<{-(-total // block)}i", raw[16 : 16 + 4 * -(-total // block)])):
        n = min(block, total - k * block)
        # a whole block is split into one stream for each byte of an element, unless its header says no
        streams = size if not flags & 16 and size <= 16 and block // size >= 128 and n == block else 1
        parts = []
        for _ in range(streams):
            (length,) = struct.unpack("<i", raw[at : at + 4])
            parts.append(plain(raw[at + 4 : at + 4 + length], n // streams))
            at += 4 + length
        b = np.frombuffer(b"".join(parts), np.uint8)
        if flags & 1 and size > 1:
            m = n // size * size
            b = np.concatenate([b[:m].reshape(size, -1).T.ravel(), b[m:]])
        elif flags & 4:
            m = n // size // 8 * 8 * size
            bits = np.unpackbits(b[:m].reshape(size * 8, -1), axis=1, bitorder="little")
            b = np.concatenate([np.packbits(bits.T, axis=1, bitorder="little").ravel(), b[m:]])
        out.append(b.tobytes())
    return b"".join(out)


class HDF:
    """A NetCDF-4 (HDF5) file, by the optional package h5py."""

    def __init__(self, path: str):
        try:
            import h5py
        except ImportError:
            raise ValueError(f"{path}: NetCDF-4 (HDF5) files need the package h5py; or convert them to NetCDF classic or Zarr") from None
        files, at = located(path)
        self.path, self._h5 = path, h5py.File(files.open_input_file(at), "r")

    def names(self) -> list[str]:
        return [n for n, v in self._h5.items() if hasattr(v, "shape")]

    def shape(self, name: str) -> list[int]:
        return list(self._h5[name].shape)

    def dim_names(self, name: str) -> list[str]:
        return [d[0].name.rsplit("/", 1)[-1] if len(d) else "" for d in self._h5[name].dims]

    def var_attrs(self, name: str) -> dict:
        plain = lambda v: v.decode() if isinstance(v, bytes) else v.ravel()[0] if isinstance(v, np.ndarray) and v.size == 1 else v
        return {k: plain(v) for k, v in self._h5[name].attrs.items() if k not in ("DIMENSION_LIST", "REFERENCE_LIST")}

    def time_chunk(self, name: str) -> int:
        return (self._h5[name].chunks or [1])[0]

    def read(self, name: str, window: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
        return self._h5[name][tuple(slice(a, z) for a, z in window) or ...]


def open_store(path: str) -> NetCDF | Zarr | HDF:
    files, at = located(path.rstrip("/"))
    if at.endswith(".zarr") or files.get_file_info(at).type == pafs.FileType.Directory:
        return Zarr(path)
    with files.open_input_file(at) as f:
        head = f.read(4)
    return HDF(path) if head[1:4] == b"HDF" else NetCDF(path)


def decode_times(values: np.ndarray, units: str) -> list[dt.datetime]:
    """Numbers with units like `hours since 1950-01-01 00:00:00`."""
    m = re.match(r"\s*(\w+?)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ](\d+):(\d+)(?::(\d+))?)?", units)
    if not m:
        raise ValueError(f"time units not understood: {units!r}")
    scale = {"day": 86400, "hour": 3600, "hr": 3600, "minute": 60, "min": 60, "second": 1, "sec": 1}[m[1].lower()]
    start = dt.datetime(*(int(x) for x in m.groups("0")[1:]))
    return [start + dt.timedelta(microseconds=round(float(v) * scale * 1e6)) for v in np.ravel(values)]


def pick_variable(store, wanted: str | None = None) -> str:
    names = store.names()
    if wanted:
        if wanted not in names:
            raise ValueError(f"no variable {wanted!r} among {names}")
        return wanted
    for v in GRID_VARIABLES:
        if v in names:
            return v
    rest = [n for n in names if len(store.shape(n)) >= 3]
    if not rest:
        raise ValueError(f"no grid variable among {names}")
    return rest[0]


def _coord(store, names: tuple[str, ...]) -> str | None:
    low = {n.lower(): n for n in store.names()}
    return next((low[n] for n in names if n in low), None)


def axes(store, variable: str) -> dict:
    """times, lats, lons, and the depth levels if the variable has that dimension."""
    dims = [d.lower() for d in store.dim_names(variable)]
    t, lat, lon, depth = (_coord(store, n) for n in (_TIME, _LAT, _LON, _DEPTH))
    if not lat or not lon:
        raise ValueError("latitude or longitude coordinate not found")
    times = decode_times(store.read(t), store.var_attrs(t).get("units", "days since 1970-01-01")) if t else [None] * store.shape(variable)[0]
    four = len(store.shape(variable)) == 4
    levels = [float(x) for x in store.read(depth)] if depth and four else [0.0] * (store.shape(variable)[1] if four else 0)
    return {"times": times, "lats": [float(x) for x in store.read(lat)], "lons": [float(x) for x in store.read(lon)], "depths": levels, "dims": dims}


def surface_level(depths: list[float]) -> int:
    """The level closest to 0, the first on a tie."""
    return min(range(len(depths)), key=lambda k: abs(depths[k]))


class GridDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brine_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


class Slices(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.paths = [p.strip() for p in o["path"].split(",") if p.strip()]
        self.variable = o.get("variable")
        self.depth = int(o["depth_index"]) if "depth_index" in o else None
        self.bbox = json.loads("[" + o["bbox"] + "]") if o.get("bbox") else None
        if self.bbox is not None and len(self.bbox) != 4:
            raise ValueError("bbox needs four numbers: lat0,lat1,lon0,lon1")

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            store = open_store(p)
            v = pick_variable(store, self.variable)
            step, n = max(1, store.time_chunk(v)), store.shape(v)[0]
            out += [Slices(p, a, min(step, n - a)) for a in range(0, n, step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, count = partition.value
        store = open_store(path)
        v = pick_variable(store, self.variable)
        ax = axes(store, v)
        attrs = store.var_attrs(v)
        lats, lons = np.array(ax["lats"]), np.array(ax["lons"])
        js, is_ = np.arange(len(lats)), np.arange(len(lons))
        if self.bbox:
            js, is_ = js[(lats >= self.bbox[0]) & (lats <= self.bbox[1])], is_[(lons >= self.bbox[2]) & (lons <= self.bbox[3])]
        level = ()
        if len(store.shape(v)) == 4:
            d = self.depth if self.depth is not None else surface_level(ax["depths"])
            level = ((d, d + 1),)
        j0, j1, i0, i1 = (js[0], js[-1] + 1, is_[0], is_[-1] + 1) if len(js) and len(is_) else (0, 0, 0, 0)
        for ti in range(first, first + count):
            if not j1:
                break
            a = store.read(v, ((ti, ti + 1), *level, (int(j0), int(j1)), (int(i0), int(i1))))
            raw = a.reshape(a.shape[-2:])[np.ix_(js - j0, is_ - i0)]
            x = raw.astype(np.float64)
            for k in ("_FillValue", "missing_value"):
                if k in attrs and attrs[k] is not None:
                    x[raw == np.asarray(attrs[k]).astype(raw.dtype)] = np.nan
            x = (x * float(attrs.get("scale_factor", 1)) + float(attrs.get("add_offset", 0))).ravel()
            n = len(x)
            jj, ii = np.repeat(js, len(is_)), np.tile(is_, len(js))
            cols = [
                pa.array([path] * n, pa.string()), pa.array(np.full(n, ti, np.int32)), pa.array([ax["times"][ti]] * n, pa.timestamp("us")), pa.array(jj.astype(np.int32)), pa.array(ii.astype(np.int32)),
                pa.array(lats[jj]), pa.array(lons[ii]), pa.array(x, mask=np.isnan(x)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "ti", "t", "j", "i", "lat", "lon", "v"])


def write_netcdf(path: str, dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], record: str | None = None) -> None:
    """A small NetCDF classic (64-bit offset) writer, for fixtures and exchange. Numbers only; record names the unlimited dimension."""
    codes = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)

    def attributes(attrs: dict) -> bytes:
        if not attrs:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(attrs))
        for k, v in attrs.items():
            if isinstance(v, str):
                out += text(k) + struct.pack(">i", 2) + text(v)
            else:
                a = np.atleast_1d(np.asarray(v, dtype=getattr(v, "dtype", "f8")))
                raw = a.astype(a.dtype.newbyteorder(">")).tobytes()
                out += text(k) + struct.pack(">ii", codes[a.dtype.str[1:]], a.size) + raw + b"\0" * (-len(raw) % 4)
        return out

    names = list(dims)
    head = b"CDF\x02" + struct.pack(">i", dims[record] if record else 0)
    head += struct.pack(">ii", 10, len(dims)) + b"".join(text(n) + struct.pack(">i", 0 if n == record else s) for n, s in dims.items()) + attributes({})
    metas, sizes = [], []
    for n, (vd, arr, at) in variables.items():
        each = arr.nbytes // (dims[record] if record and vd and vd[0] == record else 1)
        sizes.append(each + -each % 4)
        metas.append((text(n) + struct.pack(">i", len(vd)) + b"".join(struct.pack(">i", names.index(d)) for d in vd) + attributes(at) + struct.pack(">ii", codes[arr.dtype.str[1:]], sizes[-1])))
    length = len(head) + 8 + sum(len(m) + 8 for m in metas)
    is_rec = [bool(record) and bool(vd) and vd[0] == record for vd, _, _ in variables.values()]
    begins, at = [0] * len(metas), length
    for k, r in enumerate(is_rec):
        if not r:
            begins[k], at = at, at + sizes[k]
    for k, r in enumerate(is_rec):
        if r:
            begins[k], at = at, at + sizes[k]
    alone = sum(is_rec) == 1
    files, at = located(path)
    with files.open_output_stream(at) as f:
        f.write(head + struct.pack(">ii", 11, len(metas)) + b"".join(m + struct.pack(">q", b) for m, b in zip(metas, begins)))
        big = [arr.astype(arr.dtype.newbyteorder(">")) for _, arr, _ in variables.values()]
        for k, r in enumerate(is_rec):
            if not r:
                raw = big[k].tobytes()
                f.write(raw + b"\0" * (sizes[k] - len(raw)))
        for t in range(dims[record] if record else 0):
            for k, r in enumerate(is_rec):
                if r:
                    raw = big[k][t : t + 1].tobytes()
                    f.write(raw if alone else raw + b"\0" * (sizes[k] - len(raw)))
