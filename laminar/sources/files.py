"""Readers and writers of mesh files, contact tables, edge lists and catalogs."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTACT = "v1 int, u1 int, v2 int, u2 int, verdict string, penetration float, angle_deg float, t1 int, t2 int, s1 long, s2 long"

#: TIFF tags that a plane needs, and the bytes of their field types.
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 339: "format"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}


def decode_tiff(data: bytes) -> np.ndarray:
    """One uncompressed plane in strips, float32 or uint8. Anything else is refused."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    said: dict[str, list[int]] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = at + 2 + 12 * i
        tag, kind, n = struct.unpack(order + "HHI", data[entry : entry + 8])
        if tag in _TAGS and kind in (1, 3, 4):
            size = _SIZES[kind] * n
            begin = entry + 8 if size <= 4 else struct.unpack(order + "I", data[entry + 8 : entry + 12])[0]
            said[_TAGS[tag]] = list(struct.unpack(order + str(n) + {1: "B", 3: "H", 4: "I"}[kind], data[begin : begin + size]))
    if said.get("compression", [1]) != [1] or said.get("samples", [1]) != [1]:
        raise ValueError("compressed or multi-sample TIFF planes are not read")
    kind = {(32, 3): "f4", (8, 1): "u1"}.get((said["bits"][0], said.get("format", [1])[0]))
    if kind is None:
        raise ValueError("only float32 and uint8 planes are read")
    raw = b"".join(data[o : o + c] for o, c in zip(said["offsets"], said["counts"]))
    return np.frombuffer(raw, order + kind).reshape(said["height"][0], said["width"][0])


def encode_tiff(plane: np.ndarray) -> bytes:
    """The plane as one uncompressed strip."""
    plane = np.ascontiguousarray(plane, "<f4" if plane.dtype.kind == "f" else "u1")
    height, width = plane.shape
    entries = [(256, 4, width), (257, 4, height), (258, 3, plane.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, plane.nbytes), (339, 3, 3 if plane.dtype.kind == "f" else 1)]
    pad = plane.nbytes % 2
    out = struct.pack("<2sHI", b"II", 42, 8 + plane.nbytes + pad) + plane.tobytes() + b"\0" * pad + struct.pack("<H", len(entries))
    for tag, kind, value in entries:
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return out + struct.pack("<I", 0)


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of all mesh folders below a path, each with x.tif, y.tif, z.tif and, if there is one, mask.tif.

    A folder is known by its whole path (folder), and called by its last part (surface). Its planes meet in one group; a missing or odd-shaped plane is an error. A mask counts where its shape fits;
    other mask kinds are not applied. Validity follows the marks and the mask (see mesh.with_validity)."""
    from pyspark.sql.types import BooleanType, FloatType, IntegerType, StringType, StructField, StructType

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("plane"), "content").where(F.col("plane").isin("x", "y", "z", "mask"))

    def cells(table: pa.Table) -> pa.Table:
        folder = table["folder"][0].as_py()
        planes = {p: decode_tiff(c) for p, c in zip(table["plane"].to_pylist(), table["content"].to_pylist())}
        if missing := {"x", "y", "z"} - set(planes):
            raise ValueError(f"{folder}: no {sorted(missing)} plane")
        shape = planes["x"].shape
        if any(planes[k].shape != shape for k in "yz"):
            raise ValueError(f"{folder}: planes differ in shape")
        mask = planes.get("mask")
        ok = np.ones(shape, bool) if mask is None or mask.shape != shape else mask != 0
        v, u = np.indices(shape).reshape(2, -1)
        return pa.table({"surface": pa.array([folder.rsplit("/", 1)[-1]] * v.size), "folder": pa.array([folder] * v.size), "v": v.astype(np.int32), "u": u.astype(np.int32), **{k: planes[k].astype(np.float32).ravel() for k in "xyz"}, "valid": ok.ravel()})

    schema = StructType([StructField("surface", StringType()), StructField("folder", StringType()), StructField("v", IntegerType()), StructField("u", IntegerType()), *[StructField(k, FloatType()) for k in "xyz"], StructField("valid", BooleanType())])
    return named.groupBy("folder").applyInArrow(cells, schema)


def read_obj(spark: SparkSession, path: str, u_scale: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, x, y, z) and triangles (id, a, b, c, tag) of an OBJ file; tag is the mean texture u times u_scale, null without."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("w"))
    from pyspark.sql import Window

    def numbered(kind: str) -> DataFrame:
        return text.where(F.get("w", F.lit(0)) == kind).withColumn("id", F.row_number().over(Window.orderBy("line")))

    points = numbered("v").select("id", *[F.get("w", F.lit(i + 1)).cast("float").alias(k) for i, k in enumerate("xyz")])
    coords = numbered("vt").select("id", F.get("w", F.lit(1)).cast("double").alias("tu"))
    part = lambda i, k: F.nullif(F.get(F.split(F.get("w", F.lit(i)), "/"), F.lit(k)), F.lit("")).cast("long")
    faces = numbered("f").select("id", *[part(i + 1, 0).alias(c) for i, c in enumerate("abc")], F.array(*[part(i + 1, 1) for i in range(3)]).alias("t"))
    tags = faces.select("id", F.explode("t").alias("k")).join(coords.withColumnRenamed("id", "k"), "k").groupBy("id").agg(F.avg("tu").alias("tu"), F.count("*").alias("n")).where("n = 3")
    tag = F.floor(F.col("tu") * u_scale).cast("int") if u_scale else F.lit(None).cast("int")
    return points, faces.join(tags, "id", "left").select("id", "a", "b", "c", tag.alias("tag"))


def read_contacts(spark: SparkSession, path: str, verdict: str | None = None) -> DataFrame:
    """Contacts by column name, single surface or several; a missing margin is null, one surface column alone is refused."""
    found = spark.read.option("header", True).csv(path)
    have = set(found.columns)
    if missing := {"v1", "u1", "v2", "u2", "verdict"} - have:
        raise ValueError(f"no {sorted(missing)} in {path}")
    if len(have & {"surf1", "surf2"}) == 1:
        raise ValueError("one surface column without the other")
    kinds = {"v1": "int", "u1": "int", "v2": "int", "u2": "int", "verdict": "string", "penetration": "float", "angle_deg": "float"}
    renamed = {"t1": ("tri1", "int"), "t2": ("tri2", "int"), "s1": ("surf1", "long"), "s2": ("surf2", "long")}
    out = [(F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]
    out += [(F.col(c).cast(k) if c in have else F.lit(0 if n[0] == "s" else None).cast(k)).alias(n) for n, (c, k) in renamed.items()]
    found = found.select(*out)
    return found if verdict is None else found.where(F.col("verdict") == verdict)


def out_of_range(contacts: DataFrame, rows: int, columns: int) -> DataFrame:
    """Contacts counted as inside the grid's quads or out of it; none is dropped unseen."""
    inside = F.lit(True)
    for i in (1, 2):
        inside = inside & F.col(f"v{i}").between(0, rows - 2) & F.col(f"u{i}").between(0, columns - 2)
    return contacts.agg(F.count_if(inside).alias("n_inside"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_outside"))


def write_contacts(contacts: DataFrame, path: str) -> None:
    """CSV in total order, numbers with six significant digits as C prints them."""
    def general(c):
        exponent = F.floor(F.log10(F.abs(F.col(c).cast("double"))))
        plain = F.regexp_replace(F.regexp_replace(F.round(F.col(c).cast("double"), 6).cast("decimal(38,6)").cast("string"), r"0+$", ""), r"\.$", "")
        return F.when(F.col(c) == 0, "0").when(exponent.between(-4, 5), plain).otherwise(F.format_string("%.5e", F.col(c).cast("double"))).alias(c)

    order = ["v1", "u1", "t1", "v2", "u2", "t2", "s1", "s2"]
    out = contacts.orderBy(*order).select("v1", "u1", "v2", "u2", "verdict", general("penetration"), F.format_string("%.2f", F.col("angle_deg").cast("double")).alias("angle_deg"), F.col("t1").alias("tri1"), F.col("t2").alias("tri2"), F.col("s1").alias("surf1"), F.col("s2").alias("surf2"))
    out.write.option("header", True).csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Surface pairs a, b in file order: CSV with such a header, or two words a line; # begins a comment."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    words = lines.select("ordinal", F.split("line", r"[,\s]+").alias("w")).where(F.size("w") >= 2)
    named = words.select("ordinal", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
    return named.where("NOT (lower(a) = 'a' AND lower(b) = 'b')")


def read_catalog(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Segments of one sample of a JSON catalog {samples: {id: {segments: {id: {...}}}}}, windings last where unknown."""
    schema = "samples map<string, struct<segments: map<string, struct<long_id: string, grid: array<int>, volume: string>>>>"
    said = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = said.select(F.explode(F.col("samples")[sample]["segments"]).alias("segment", "s"))
    winding = F.nullif(F.regexp_extract(F.coalesce("s.long_id", "segment"), r"w(\d{3})(?:_|$)", 1), F.lit("")).cast("int")
    return rows.select("segment", "s.*", winding.alias("winding")).orderBy(F.col("winding").asc_nulls_last(), "segment")


def point_collection(points: DataFrame, name: str) -> DataFrame:
    """One JSON document with all points (id, x, y, z), by id."""
    entry = F.struct(F.col("id").cast("string").alias("key"), F.struct(F.array("x", "y", "z").alias("p")).alias("value"))
    return points.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("points")).select(F.to_json(F.struct(F.lit(name).alias("name"), "points")).alias("value"))


def write_surface_folder(vertices: DataFrame, path: str) -> None:
    """One surface as a mesh folder on the driver's own disk: planes, mask and meta.json. Removed cells are -1 and masked."""
    import os

    cells = vertices.select("v", "u", "x", "y", "z", "valid").toArrow()
    v, u = cells["v"].to_numpy(), cells["u"].to_numpy()
    shape = int(v.max()) + 1, int(u.max()) + 1
    valid = np.zeros(shape, "u1")
    valid[v, u] = cells["valid"].to_numpy()
    os.makedirs(path, exist_ok=True)
    box = []
    for k in "xyz":
        plane = np.full(shape, -1, np.float32)
        plane[v, u] = cells[k].to_numpy()
        box.append([float(plane[valid > 0].min()), float(plane[valid > 0].max())] if valid.any() else [0.0, 0.0])
        with open(f"{path}/{k}.tif", "wb") as f:
            f.write(encode_tiff(plane))
    with open(f"{path}/mask.tif", "wb") as f:
        f.write(encode_tiff(valid * np.uint8(255)))
    with open(f"{path}/meta.json", "w") as f:
        json.dump({"bbox": [[b[0] for b in box], [b[1] for b in box]]}, f)
