"""Files by what is in them: the first FASTA is the target, others stack on the query axis; a PAF file lies over both or stands alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kmerloom.model import EngineError
from kmerloom.sources import fasta, paf
from kmerloom.sources.heads import HEAD, head_of

__all__ = ["HEAD", "Intake", "fasta_slot", "head_of", "kind_of", "route"]

NAMES = {"fasta": (".fa", ".fasta", ".fna"), "paf": (".paf",)}


@dataclass
class Intake:
    target: str | None = None
    query: list[str] = field(default_factory=list)
    paf: str | None = None


def kind_of(spark: SparkSession, path: str) -> str:
    """By the name, else by the first bytes."""
    bare = path.lower().removesuffix(".gz")
    for kind, ends in NAMES.items():
        if bare.endswith(ends):
            return kind
    head = head_of(spark, path)
    if fasta.looks_like_fasta(head):
        return "fasta"
    if paf.looks_like_paf(head):
        return "paf"
    raise EngineError(f"{path} is neither FASTA nor PAF.")


def route(spark: SparkSession, paths: list[str]) -> Intake:
    out = Intake()
    for path in paths:
        if kind_of(spark, path) == "paf":
            out.paf = path
        elif out.target is None:
            out.target = path
        else:
            out.query.append(path)
    return out


def fasta_slot(spark: SparkSession, path: str) -> DataFrame:
    """An axis from one file; a PAF file in its place is an error that says so."""
    if kind_of(spark, path) == "paf":
        raise EngineError(f"{path} is a PAF file; a FASTA file is needed here.")
    return fasta.read_axis(spark, path)
