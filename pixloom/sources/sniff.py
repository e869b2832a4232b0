"""Format of a file by its first bytes, as one expression over ``binaryFile`` content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magic bytes in the order in which formats are tried, in hexadecimal.
MAGIC = (
    ("bands", r"^(1B50|90)(3[0-9]|3B)*71"),
    ("pnm", r"^503[1-6]"),
    ("jpeg", r"^FFD8"),
    ("png", r"^89504E470D0A1A0A"),
    ("gif", r"^474946383[79]61"),
    ("bmp", r"^424D"),
    ("tiff", r"^(49492A00|4D4D002A)"),
    ("psd", r"^38425053"),
    ("hdr", r"^233F(52414449414E4345|52474245)0A"),
    ("pic", r"^5380F634"),
    ("gd2", r"^67643200"),
    ("wbmp", r"^0000(8[0-9A-F]|9[0-9A-F]|[A-F][0-9A-F])*(0[1-9A-F]|[1-7][0-9A-F])(8[0-9A-F]|9[0-9A-F]|[A-F][0-9A-F])*(0[1-9A-F]|[1-7][0-9A-F])"),
)


def format_of(content: Column) -> Column:
    """The name of the format; null for an empty file, a lone line end, or unknown bytes."""
    head = F.hex(F.substring(content, 1, 64))
    chain = F.when(F.octet_length(content) == 0, None).when(head == "0A", None)
    for name, pattern in MAGIC[:-1]:
        chain = chain.when(head.rlike(pattern), name)
    footer = F.substring(content, -18, 18)
    # A TGA of the old kind has no mark: a map or none, a known kind, a known depth.
    plain = r"^..(0001|0002|0003|0009|000A|000B|0101|0109).{26}(08|0F|10|18|20)"
    chain = chain.when(footer == F.lit(b"TRUEVISION-XFILE.\x00"), "tga")
    for name, pattern in MAGIC[-1:]:
        chain = chain.when(head.rlike(pattern), name)
    return chain.when(head.rlike(plain), "tga")
