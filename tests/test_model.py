import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.model import Chunker, Compression, SettingError, decode_chunk_list, encode_chunk_list, parse_hex, parse_repo_path, parse_size, pax_record
from cairn.operators.codecs import compress, decompress, decrypted, encrypted, password_key


def test_settings():
    assert Chunker.parse("rabin/4") == Chunker("rabin", 4096) and str(Chunker.parse("ae")) == "ae/8"
    assert Compression.parse("zlib/2") == Compression("deflate", 2) and Compression.parse("lzma2/2") == Compression("lzma", 2) and Compression.parse("xz/3") == Compression("lzma", 3)
    assert Compression.parse("brotli") == Compression("brotli", 5) and Compression.parse("none") is None
    for bad in ("zstd/1", "deflate/x", "deflate/10"):
        with pytest.raises(SettingError):
            Compression.parse(bad)
    assert [parse_size(s) for s in ("100b", "2K", "3m", "1g", "1T")] == [100, 2048, 3 << 20, 1 << 30, 1 << 40]
    for bad in ("100", "", "k", "1.5k", "-1k"):
        with pytest.raises(SettingError):
            parse_size(bad)
    assert parse_repo_path("r::b::a::c") == ("r", "b", "a::c") and parse_repo_path("") == ("default", None, None) and parse_repo_path("r::") == ("r", None, None)
    assert parse_hex("0a FF\n1b") == b"\x0a\xff\x1b"
    with pytest.raises(SettingError):
        parse_hex("abc")


def test_chunk_list_codec():
    chunks = [("0" * 32, 0), ("0011223344556677" + "8899aabbccddeeff", 1)]
    data = encode_chunk_list(chunks)
    assert len(data) == 40 and data[36:40] == b"\1\0\0\0" and data[20:28] == bytes.fromhex("7766554433221100")
    assert decode_chunk_list(data) == chunks


def test_record_length_counts_itself():
    for n in range(80, 120):
        record = pax_record("k", b"v" * n)
        assert int(record.split(b" ")[0]) == len(record)


@pytest.mark.parametrize("method,levels", [("deflate", range(1, 10)), ("brotli", range(1, 12)), ("lzma", range(1, 10)), ("lz4", range(1, 12))])
def test_codecs(method, levels):
    data = bytes(i**3 % 256 for i in range(16384))
    for level in levels:
        codec = Compression(method, level)
        packed = compress(data, codec)
        assert decompress(packed, codec) == data and len(packed) < len(data)
    assert decompress(compress(b"", codec), codec) == b"" and compress(data, None) == data


def test_encryption(spark):
    df = spark.createDataFrame([(b"test123",)], "d binary")
    key, other = password_key("one"), password_key("two")
    assert bytes(df.select(decrypted(encrypted(F.col("d"), key), key)).first()[0]) == b"test123"
    with pytest.raises(Exception, match="AES"):
        df.select(decrypted(encrypted(F.col("d"), key), other)).first()
    tampered = F.concat(F.lit(b"\1"), F.substring(encrypted(F.col("d"), key), 2, 1000))
    with pytest.raises(Exception, match="AES"):
        df.select(decrypted(tampered, key)).first()


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_formats(spark):
    cases = {0: "0 Byte", 511: "511 Byte", 670: "0.7 KiB", 453170: "442.5 KiB", 2100000: "2.0 MiB", 113920: "111.2 KiB", 1 << 40: "1.0 TiB"}
    for n, shown in cases.items():
        assert one(spark, scalars.format_size(F.lit(n).cast("long"))) == shown
    assert one(spark, scalars.format_duration(F.lit(7322.2))) == "2:02:02.2"
    assert one(spark, scalars.format_speed(F.lit(2048), F.lit(2.0))) == "1.0 KiB/s"
    assert one(spark, scalars.parse_size(F.lit("12K"))) == 12288 and one(spark, scalars.parse_size(F.lit("12"))) is None
    assert one(spark, scalars.percent_saved(F.lit(1), F.lit(0))) is None


def test_globs(spark):
    def hit(pattern, path):
        return one(spark, scalars.excluded(F.lit(path), [pattern]))

    assert hit("*.tmp", "/a/b.tmp") and hit("*.tmp", "/b.tmp/c") and not hit("*.tmp", "/a/b.tmpx")
    assert hit("/a", "/a/x") and not hit("/a", "/b/a") and hit("a", "/b/a")
    assert hit("/a/**/z", "/a/b/c/z") and not hit("/a/*/z", "/a/b/c/z") and hit("/a/?", "/a/b") and not hit("/a/?", "/a/bc")
    assert not hit("# x", "/# x") and not hit("", "/a") and hit("a.b", "/a.b") and not hit("a.b", "/axb")


def test_paths(spark):
    assert one(spark, scalars.ancestors(F.lit("/a/b/c"))) == ["/", "/a", "/a/b"] and one(spark, scalars.ancestors(F.lit("/a"))) == ["/"]
    assert one(spark, scalars.parent(F.lit("/a"))) == "/" and one(spark, scalars.parent(F.lit("/"))) is None and one(spark, scalars.parent(F.lit("/a/b"))) == "/a"
    assert one(spark, scalars.device_number(scalars.device_major(F.lit(2049)), scalars.device_minor(F.lit(2049)))) == 2049
