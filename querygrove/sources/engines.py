"""Spelling of a few functions that Spark SQL and the oracle engine name differently."""

from __future__ import annotations


class SparkText:
    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def to_bytes(self, x: str) -> str:
        return f"encode({x}, 'UTF-8')"

    def epoch(self, x: str) -> str:
        return f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {x})"

    def joined(self, x: str, order: str) -> str:
        return f"listagg({x}, ',') WITHIN GROUP (ORDER BY {order})"

    def bom(self) -> str:
        return "decode(unhex('EFBBBF'), 'UTF-8')"

    def capital(self, x: str) -> str:
        return f"concat(upper(substr({x}, 1, 1)), substr({x}, 2))"


class OracleText:
    def octets(self, x: str) -> str:
        return f"CAST(strlen({x}) AS BIGINT)"

    def to_bytes(self, x: str) -> str:
        return f"encode({x})"

    def epoch(self, x: str) -> str:
        return f"CAST(floor(epoch({x})) AS BIGINT)"

    def joined(self, x: str, order: str) -> str:
        return f"string_agg({x}, ',' ORDER BY {order})"

    def bom(self) -> str:
        return "chr(65279)"

    def capital(self, x: str) -> str:
        return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


SPARK = SparkText()
ORACLE = OracleText()
