"""CRC-32 of ASCII text in DuckDB SQL, which has no such function (Spark has)."""

#: A one-row table ``crc`` with the list ``tab``: the checksum's remainders by byte.
CRC_TABLE = """crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) as tab)"""


def crc32_sql(text: str) -> str:
    """The checksum of ``text``, where a table ``crc`` is joined."""
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda s: ord(s)::bigint)), "
            "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::bigint)")
