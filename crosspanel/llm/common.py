"""What the operators share: table access, the shared folder, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, `[\x20\x09-\x0D]`. bytes.split() splits on exactly these.
BLANKS = " \t\n\x0b\x0c\r"

SHARED = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs in one process."""
    found = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"a cluster needs a shared folder: set {SHARED}")
        found = "file://" + tempfile.mkdtemp(prefix="crosspanel-")
        spark.conf.set(SHARED, found)
    return found


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_out(rows: DataFrame, wanted: DataFrame, key: str, n_wanted: int, most_bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """Rows whose `key`, a hash, may be among those of `wanted`, and rows whose key surely is not; nothing is shuffled.

    What goes to the executors is a bitmap of 32 to 64 bits for each of `n_wanted` keys, and of 2 ** `most_bits` bits
    (16 MB) at most, whatever the tables hold. Where more keys are wanted than it can tell apart more rows are among the
    first; an exact join must follow for them.
    """
    bits = min(most_bits, max(15, (32 * n_wanted).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(23)), F.lit(2**bits))
    bits_of = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits_of = stage(bits_of, "bits")  # both results look it up
    found = rows.select(F.struct("*").alias("row"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).join(F.broadcast(bits_of), "bucket", "left")
    own = F.conv(F.hex(F.substring(F.col("bits"), F.call_function("div", F.col("at"), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    there = F.coalesce(F.call_function("getbit", own, (F.col("at") % 8).cast("int")) == 1, F.lit(False))
    return found.where(there).select("row.*"), found.where(~there).select("row.*")


def only_wanted(rows: DataFrame, wanted: DataFrame, key: str, n_wanted: int, most_bits: int = 27) -> DataFrame:
    """Rows whose `key` may be among those of `wanted`: most others are left behind before anything is shuffled."""
    return sorted_out(rows, wanted, key, n_wanted, most_bits)[0]


def remainder(doc_id, modulus: int):
    """crc32 of an id as text, modulo `modulus`: what the held-out splits go by. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def pack_ints(values) -> bytes:
    """Whole numbers as little bytes: byte planes one after another, compressed. For columns that get shuffled."""
    values = np.ascontiguousarray(values, np.int64)
    wide = np.int64 if len(values) and (values.max() > 2**31 - 1 or values.min() < -(2**31)) else np.int32
    planes = values.astype(wide).view(np.uint8).reshape(-1, np.dtype(wide).itemsize).T
    return bytes([np.dtype(wide).itemsize]) + zstandard.compress(planes.tobytes(), 1)


def unpack_ints(data: bytes) -> np.ndarray:
    """What pack_ints was given."""
    wide = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{wide}").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings as one compressed block."""
    return len(lengths := pack_ints([len(x) for x in words])).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    """What pack_words was given."""
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack_ints(data[4 : 4 + n])).tolist()
    text = zstandard.decompress(data[4 + n :])
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
