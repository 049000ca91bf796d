"""SAM headers: lines, reference sequences, read groups and program lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Header:
    """Header lines without their line breaks."""

    lines: list[str]

    def _of(self, kind: str) -> list[dict[str, str]]:
        return [dict(f.split(":", 1) for f in x.split("\t")[1:] if ":" in f) for x in self.lines if x.split("\t", 1)[0] == kind]

    @property
    def references(self) -> list[tuple[str, int]]:
        return [(f["SN"], int(f.get("LN", 0))) for f in self._of("@SQ") if "SN" in f]

    @property
    def library(self) -> str:
        """Id of the first read group, empty without one; metrics carry it."""
        return next((f.get("ID", "") for f in self._of("@RG")), "")

    def table(self, spark: SparkSession) -> DataFrame:
        """tid, name and length of each reference sequence."""
        return spark.createDataFrame([(i, n, l) for i, (n, l) in enumerate(self.references)], "tid int, name string, length int")

    def with_program(self, program: str, version: str, command: str) -> Header:
        """With a program line, whose fields hold no tabs; program ids in use get a number."""
        used, name, k = {f.get("ID") for f in self._of("@PG")}, program, 1
        while name in used:
            name, k = f"{program}.{k}", k + 1
        return Header([*self.lines, f"@PG\tID:{name}\tVN:{version}\tCL:{' '.join(command.split())}"])

    def text(self) -> str:
        return "".join(f"{x}\n" for x in self.lines)
